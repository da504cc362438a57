"""Text measures as column expressions: words, sentences, syllables, readability, tokens, signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Filler words of queries, folded.
STOPWORDS = {
    "en": (
        "a an the and or but of for to in on at by with from as is are was were be been it its this that these those how what which who whom why "
        "when where do does can i you your my me we our us vs versus near best top"
    ).split(),
    "es": (
        "el la los las un una unos unas y o u e de del al a en por para con sin sobre entre que como cual cuales quien donde cuando es son ser esta este "
        "estos estas esto lo le les se su sus mi mis tu tus mas muy mejor mejores vs cerca"
    ).split(),
}
#: What counts as a quotable figure.
STATISTIC = r"(?i)(\d+\.?\d*\s*%|\$\d[\d,]*|\d+\s+out\s+of\s+\d+|\d+\s+de\s+cada\s+\d+|\d+x\s|\b\d+(?:[.,]\d+)?\s*(?:million|billion|thousand|millones|millón|millon|mil|k\b))"
#: How a text defines its subject.
DEFINES = {
    "en": r"(?i)\b(?:is\s+(?:a|an|the)\s+\w|refers\s+to\s+|means\s+|defined\s+as\s+|helps\s+(?:you|businesses|teams))",
    "es": r"(?i)\b(?:es\s+(?:un|una|el|la|lo)\s+\w|son\s+(?:los|las|unos|unas)\s+\w|se\s+refiere\s+a\s+|significa\s+|se\s+define\s+como\s+|consiste\s+en\s+|ayuda\s+a\s+(?:las?\s+)?(?:empresas|equipos|personas)|te\s+ayuda\s+a\s+)",
}
_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāēīōūşšžčćğ", "aaaaaaceeeeiiiinooooouuuuyyaeiousszccg"


def words(text: Column) -> Column:
    """Tokens between white space that hold a letter or digit of any script."""
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w.rlike(r"[\p{L}\p{N}]"))


#: Silent endings of a word, and what is dropped after them.
_SILENT, _LAST_Y = r"(?:[^laeiouy]es|ed|[^laeiouy]e)(?!\S)", r"y(?!\S)"


def syllables(text: Column) -> Column:
    """Of all words: 1 for up to three characters; else the vowel groups left without silent endings, at least 1.

    Taken over the whole text at once: short words and those without a letter or digit are cut out first, and words left
    without a vowel count 1 each."""
    longer = F.regexp_replace(F.lower(text), r"(?<!\S)(?:\S{1,3}|[^\p{L}\p{N}\s]+)(?!\S)", " ")
    n_longer = F.regexp_count(longer, F.lit(r"\S+"))
    bare = F.regexp_replace(F.regexp_replace(longer, _SILENT, ""), _LAST_Y, "")
    voiced = F.regexp_count(bare, F.lit(r"(?<!\S)[^\saeiouy]*[aeiouy]"))
    return F.size(words(text)) - n_longer + F.regexp_count(bare, F.lit("[aeiouy]{1,2}")) + n_longer - voiced


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"\S")


def sentences(text: Column) -> Column:
    found = F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: s.rlike(r"\S"))))
    return F.when(is_blank(text), 0).otherwise(found)


def paragraphs(text: Column) -> Column:
    found = F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"\n\s*\n"), lambda s: s.rlike(r"\S"))))
    return F.when(is_blank(text), 0).otherwise(found)


def half_up(x: Column, digits: int = 0) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def reading_ease(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    score = 206.835 - 1.015 * (n_words / n_sentences) - 84.6 * (n_syllables / n_words)
    return F.when(n_words > 0, half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 1)).otherwise(0.0)


def grade_level(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    score = 0.39 * (n_words / n_sentences) + 11.8 * (n_syllables / n_words) - 15.59
    return F.when(n_words > 0, half_up(F.greatest(F.lit(0.0), score), 1)).otherwise(0.0)


def ease_label(score: Column) -> Column:
    out = F.when(score >= 90, "very easy")
    for least, label in ((80, "easy"), (70, "fairly easy"), (60, "standard"), (50, "fairly difficult"), (30, "difficult")):
        out = out.when(score >= least, label)
    return out.otherwise("very difficult")


def fold(text: Column) -> Column:
    """Lower case without Latin accents, precomposed or combining."""
    return F.regexp_replace(F.translate(F.lower(text), _ACCENTED, _PLAIN), r"\p{Mn}+", "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def significant(text: Column, lang: Column | None = None) -> Column:
    """Query tokens without the filler of their language, of all known ones if it is null; all tokens if nothing else is left."""
    every = F.array(*[F.lit(w) for w in sorted({w for ws in STOPWORDS.values() for w in ws})])
    filler = every
    if lang is not None:
        filler = F.when(lang.isNull(), every)
        for code, ws in STOPWORDS.items():
            filler = filler.when(F.lower(F.substring(lang, 1, 2)) == code, F.array(*map(F.lit, ws)))
        filler = filler.otherwise(F.array().cast("array<string>"))
    kept = F.filter(tokens(text), lambda w: ~F.array_contains(filler, w))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens(text))


def missing(query: Column, text: Column) -> Column:
    """Different query tokens that a text's tokens lack, whatever their number."""
    one = lambda a, b: (F.length(a) >= 3) & ((b == F.concat(a, F.lit("s"))) | (b == F.concat(a, F.lit("es"))))
    return F.filter(F.array_distinct(query), lambda q: ~F.exists(text, lambda t: (q == t) | one(q, t) | one(t, q)))


#: The two-letter language codes of ISO 639-1.
LANGUAGES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy "
    "ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv "
    "mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw "
    "sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
).split()
#: Languages whose bare code is often meant as a country's, and what would say that.
CONFUSABLE = {"uk": "en-GB", "eu": "", "no": "nb-NO", "is": "he-IL or en-IL", "ms": "en-MS", "se": "sv-SE", "id": "id-ID"}
_CODE = r"(?i)^([a-z]{2})(?:-([a-z]{4}))?(?:-([a-z]{2}|\d{3}))?$"


def language_of(code: Column) -> Column:
    """The language of a code of the documented shape, x-default as it is; null for anything else."""
    lang = F.lower(F.regexp_extract(code, _CODE, 1))
    return F.when(F.lower(code) == "x-default", "x-default").when(lang.isin(LANGUAGES), lang)


def region_of(code: Column) -> Column:
    region = F.upper(F.regexp_extract(code, _CODE, 3))
    return F.when(language_of(code).isNotNull() & (region != ""), region)


def lang_code(code: Column) -> Column:
    """A language code in normal case, an underscore taken for a hyphen; null if it is of another shape or of no language."""
    c = F.replace(code, F.lit("_"), F.lit("-"))
    script = F.initcap(F.regexp_extract(c, _CODE, 2))
    shown = F.concat_ws("-", language_of(c), F.when(script != "", script), region_of(c))
    return F.when(language_of(c).isNotNull(), shown)


def meant_region(code: Column) -> Column:
    """What a bare language code that looks like a country's should have been, empty if there is nothing; null if it reads fine."""
    out = F.lit(None).cast("string")
    for lang, better in CONFUSABLE.items():
        out = F.when(F.lower(code) == lang, better).otherwise(out)
    return out


def defines_something(text: Column, lang: Column) -> Column:
    """Null for a language without patterns; any language's for a text that declares none. A word begins after
    anything but an ASCII letter, digit or underscore."""
    code = F.lower(F.substring(lang, 1, 2))
    en, es = (text.rlike(DEFINES[c].replace(r"(?i)\b", "(?i)(?<![A-Za-z0-9_])", 1)) for c in ("en", "es"))
    return F.when(lang.isNull(), en | es).when(code == "en", en).when(code == "es", es)


def entity_density(text: Column) -> Column:
    """Share of capitalised tokens that do not begin a sentence. Sentences end at . ! and ?, tokens also at white space."""
    capitalised = F.regexp_count(text, F.lit(r"(?<![^\s.!?])\p{Lu}\p{L}"))
    first = F.regexp_count(text, F.lit(r"(?:^|[.!?])\s*\p{Lu}\p{L}"))
    return F.coalesce(F.try_divide(capitalised - first, F.regexp_count(text, F.lit(r"[^\s.!?]+"))), F.lit(0.0))

"""Benchmark decontamination by template canonicalisation, with DataFrame operations only.

Numbers, names and units are replaced by typed placeholders, everything else is
lower-cased and stripped of punctuation, so that a question whose values were
changed has the same template. Windows of ``window`` template tokens are hashed
and joined to those of the benchmark; an item whose distinct windows are found
in a document to a share of ``coverage`` or more is a candidate. A candidate
whose template has placeholders is aligned with the document, and its slots
must be consistent: equal values in the item are equal in the document, and
different ones different. Otherwise it is another text of the same form.

* number: digits with separators, with a sign or a per cent mark;
* unit: a unit of the fixed list after a number;
* name: a word with a capital and a small letter after it that follows a word without the end of a sentence, or
  any word with a capital right after a small letter; so text in capitals only has no names.

A capital at the beginning of a sentence may be a name or not. Such words are
plain in a text's narrow windows and names in its wide ones, which are taken
where the two differ. An item is looked for in three forms: the narrow one, the
wide one if it has at least ``window`` different plain words (else any sentence
of names would do), and one with its names as plain words, for texts in
capitals or small letters only, where names can't be told.

A window counts wherever it is found, if it holds a plain word: numbers, names and
units alone are in any table. So an item without plain words is not looked for. Slots are checked at every offset between
item and document that holds a share of ``coverage`` of the item's windows, and
at the one that holds most of them; one consistent offset is enough.

Items with fewer tokens than a window are looked for as one window of their own
length. All different texts of an item's id are looked for; items without an id
or tokens match nothing. Null and empty documents match nothing; long ones are
read whole. Rows that repeat an id and its text get the same result each. The
benchmark's windows are broadcast only if there are at most ``broadcast_rows``
of them, else both sides are shuffled. Columns other than those named are
ignored, whatever their names; an empty benchmark finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.llm.common import materialize

#: Units that follow a number.
UNITS = (
    "kg g mg lb lbs oz km m cm mm mi ft in miles mile meters metres meter metre kilometers kilometres feet foot inches inch yards yard "
    "hours hour hrs hr minutes minute mins min seconds second secs sec days day weeks week months month years year "
    "dollars dollar cents cent euros euro pounds pound l ml liters litres liter litre gallons gallon degrees degree percent mph kph"
).split()
_SPACE = r"\x20\x09-\x0D"
#: Marks that stand before a number or name, before a unit, and before a capital that begins a sentence.
_MARK, _UNIT_MARK, _INITIAL_MARK = "\x01", "\x02", "\x03"
_ENDS = ".,;:!?\"'`()[]{}<>*#&|_~-…“”‘’«»¿¡"
_NAME_OR_NUMBER = rf"\p{{Lu}}(?<=[^.!?:;{_SPACE}][{_SPACE}].)(?:(?=\p{{Ll}})|(?<=\p{{Ll}}[{_SPACE}].))[\p{{L}}\p{{M}}'’-]*|[+-]?\p{{N}}+(?:[.,:/]\p{{N}}+)*%?"
_INITIAL = rf"\p{{Lu}}(?=\p{{Ll}})(?<=(?:^|[{_SPACE}])[\"'(\[“‘«¿¡]{{0,2}}.)"
_UNIT = rf"(\x01[+-]?\p{{N}}[^{_SPACE}]*[{_SPACE}])({'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])"


def template(text: Column) -> Column:
    """The tokens of a text, lower-cased and without punctuation at their ends; what varies has a mark before its value."""
    marked = F.regexp_replace(F.regexp_replace(text, f"[{_MARK}{_UNIT_MARK}{_INITIAL_MARK}]", ""), _NAME_OR_NUMBER, f"{_MARK}$0")
    marked = F.lower(F.regexp_replace(marked, _INITIAL, f"{_INITIAL_MARK}$0"))
    marked = F.regexp_replace(marked, _UNIT, f"$1{_UNIT_MARK}$2")
    return F.filter(F.transform(F.split(marked, rf"[{_SPACE}]+"), lambda t: F.btrim(t, F.lit(_ENDS))), lambda t: t != "")


def _has(token: Column, mark: str) -> Column:
    return F.contains(token, F.lit(mark))


def _kind(token: Column, wide: bool) -> Column:
    """The token in the template: itself, or what stands for it."""
    digit = F.substring_index(token, _MARK, -1).rlike(r"^[+-]?\p{N}")
    typed = F.concat(F.substring_index(token, _MARK, 1), F.when(digit, "<num>").otherwise("<name>"))
    initial = F.concat(F.substring_index(token, _INITIAL_MARK, 1), F.lit("<name>")) if wide else F.replace(token, F.lit(_INITIAL_MARK), F.lit(""))
    return F.when(_has(token, _MARK), typed).when(_has(token, _INITIAL_MARK), initial).when(F.startswith(token, F.lit(_UNIT_MARK)), "<unit>").otherwise(token)


def _value(token: Column) -> Column:
    for mark in (_MARK, _UNIT_MARK, _INITIAL_MARK):
        token = F.substring_index(token, mark, -1)
    return token


def _hashes(tokens: Column) -> Column:
    """Of one text, as an array of one so that nothing is computed twice: the hashes of its tokens, narrow (a) and wide (b)."""
    narrow = F.transform(F.array(tokens), lambda t: F.struct(t.alias("t"), F.transform(t, lambda x: F.xxhash64(_kind(x, False))).alias("a")))
    wider = lambda h, t: F.when(_has(t, _INITIAL_MARK), F.xxhash64(_kind(t, True))).otherwise(h)
    return F.transform(narrow, lambda x: F.struct(x["a"].alias("a"), F.zip_with(x["a"], x["t"], wider).alias("b")))


def _windows(tokens: Column, sizes: list[int], narrow: bool = True, wide: bool = True) -> Column:
    """hash and place of each window of so many tokens: the narrow ones, and the wide ones (where both are asked for, those
    that differ)."""
    kind = "array<struct<h:bigint,at:int>>"

    def of_size(a: Column, b: Column, size: int) -> Column:
        last = F.size(a) - size + 1
        rows = lambda x, places: F.transform(places, lambda i: F.struct(F.xxhash64(F.lit(size), *[F.get(x, i + (k - 1)) for k in range(size)]).alias("h"), i.alias("at")))
        every = F.sequence(F.lit(1), last)
        if narrow and wide:
            differ = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: F.element_at(a, i) != F.element_at(b, i))
            around = F.array_distinct(F.flatten(F.transform(differ, lambda i: F.sequence(F.greatest(F.lit(1), i - size + 1), F.least(i, last)))))
            found = F.concat(rows(a, every), rows(b, around))
        else:
            found = rows(a if narrow else b, every)
        return F.when(F.size(a) >= size, found).otherwise(F.array().cast(kind))

    def of(x: Column) -> Column:
        found = [of_size(x["a"], x["b"], size) for size in sizes]
        return found[0] if len(found) == 1 else F.concat(*found)

    return F.transform(_hashes(tokens), of)[0]


def _slots(df: DataFrame, key: str, at: str, value: str, wide: Column) -> DataFrame:
    """A row per placeholder: its place, type and value."""
    token = F.col("token")
    marked = _has(token, _MARK) | _has(token, _UNIT_MARK) | (wide & _has(token, _INITIAL_MARK))
    rows = df.select(key, wide.alias("wide"), F.posexplode("tokens").alias("i", "token")).where(marked)
    return rows.select(key, (F.col("i") + 1).alias(at), _kind(token, True).alias("kind"), _value(token).alias(value))


def forms(benchmark: DataFrame, window: int, item_col: str, item_text_col: str) -> DataFrame:
    """item_id, tokens, wide, form: what is looked for of each item's texts."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()
    items = items.select("item_id", template(F.col("text")).alias("tokens"), template(F.lower("text")).alias("small"))
    form = lambda tokens, wide: F.struct(F.col(tokens).alias("tokens"), F.lit(wide).alias("wide"))
    plain = F.filter("tokens", lambda t: ~_has(t, _MARK) & ~_has(t, _UNIT_MARK) & ~_has(t, _INITIAL_MARK))
    as_wide = F.exists("tokens", lambda t: _has(t, _INITIAL_MARK)) & (F.size(F.array_distinct(plain)) >= window)
    found = F.array_distinct(F.array_compact(F.array(form("tokens", False), F.when(as_wide, form("tokens", True)), form("small", False))))
    rows = items.select("item_id", F.inline(found)).where(F.size("tokens") > 0)
    return rows.withColumn("form", F.xxhash64("item_id", "tokens", "wide")).distinct()


def _own_windows(items: DataFrame, size: int, wide: bool) -> DataFrame:
    """form, h, at: the windows of items that hold a plain word; others are in any text with enough numbers or names."""
    plain = F.transform("tokens", lambda t: ~_has(t, _MARK) & ~_has(t, _UNIT_MARK) & ~(F.lit(wide) & _has(t, _INITIAL_MARK)))
    rows = items.select("form", plain.alias("plain"), F.inline(_windows(F.col("tokens"), [size], not wide, wide)))
    return rows.where(F.exists(F.slice("plain", F.col("at"), size), lambda x: x)).select("form", "h", "at")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 5, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """uid, item_id, found (share of the item's windows), verbatim: the pairs found; uid is the hash of a document's id and text."""
    items = materialize(forms(benchmark, window, item_col, item_text_col), "items")
    length = F.least(F.size("tokens"), F.lit(window))
    sizes = sorted(r[0] for r in items.select(length.alias("n")).distinct().collect()) or [window]  # at most `window` numbers
    own = [_own_windows(items.where((length == s) & (F.col("wide") == w)), s, w) for s in sizes for w in (False, True)]
    wanted = own[0]
    for more in own[1:]:
        wanted = wanted.union(more)
    wanted = materialize(wanted.withColumnRenamed("at", "item_at"), "windows")
    total = wanted.groupBy("form").agg(F.count_distinct("h").alias("total"), F.count("*").alias("places"))
    small = wanted.count() <= broadcast_rows
    side = lambda df: F.broadcast(df) if small else df

    texts = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("uid"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def windows(rows: DataFrame) -> DataFrame:
        return rows.select("uid", F.inline(_windows(template(F.col("text")), sizes)))

    hits = windows(texts).join(side(wanted.select("form", "h").distinct()), "h").select("uid", "form", "h").distinct()
    pairs = hits.groupBy("uid", "form").agg(F.count("*").alias("n")).join(total, "form")
    pairs = materialize(pairs.where(F.col("n") >= coverage * F.col("total")).select("uid", "form", (F.col("n") / F.col("total")).alias("found"), "places"), "pairs")

    # slots: of each pair, at each offset that holds enough of the item's windows and at the one that holds most
    item_slots = materialize(_slots(items, "form", "item_at", "item_value", F.col("wide")), "slots")
    open_pairs = pairs.join(item_slots.select("form").distinct(), "form", "left_semi")
    with_slots = texts.join(open_pairs.select("uid").distinct(), "uid", "left_semi").dropDuplicates(["uid"])
    offsets = windows(with_slots).join(side(wanted), "h").groupBy("uid", "form", (F.col("at") - F.col("item_at")).alias("offset")).agg(F.count_distinct("item_at").alias("n"))
    offsets = materialize(offsets.join(open_pairs, ["uid", "form"]), "offsets")
    most = offsets.groupBy("uid", "form").agg(F.max("n").alias("most"))
    offsets = offsets.join(most, ["uid", "form"]).where((F.col("n") >= coverage * F.col("places")) | (F.col("n") == F.col("most"))).select("uid", "form", "offset")
    doc_slots = _slots(with_slots.select("uid", template(F.col("text")).alias("tokens")), "uid", "at", "value", F.lit(True))
    aligned = offsets.join(item_slots, "form").withColumn("at", F.col("item_at") + F.col("offset")).join(doc_slots, ["uid", "at", "kind"])
    place = ["uid", "form", "offset"]
    values = aligned.groupBy(*place, "kind", "item_value", "value").agg(F.lit(1).alias("one"))
    by_item = values.groupBy(*place, "kind", "item_value").agg(F.count("*").alias("ways"), F.min(F.col("item_value") == F.col("value")).alias("same"))
    by_doc = values.groupBy(*place, "kind", "value").agg(F.count("*").alias("ways"), F.lit(True).alias("same"))
    verdict = by_item.select(*place, "ways", "same").union(by_doc.select(*place, "ways", "same"))
    verdict = verdict.groupBy(*place).agg((F.max("ways") == 1).alias("consistent"), F.min("same").alias("same"))
    at_best = offsets.join(verdict, place, "left").groupBy("uid", "form").agg(
        F.max(F.coalesce("consistent", F.lit(True))).alias("consistent"), F.max(F.coalesce("consistent", F.lit(True)) & F.coalesce("same", F.lit(True))).alias("same")
    )
    return (
        pairs.join(at_best, ["uid", "form"], "left")
        .where(F.coalesce("consistent", F.lit(True)))
        .join(items.select("form", "item_id"), "form")
        .groupBy("uid", "item_id")
        .agg(F.max("found").alias("found"), F.max(F.coalesce("same", F.lit(True))).alias("verbatim"))
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, contaminated, items (ids in order), found (the largest share), reworded (any found item with other values): a row per input row."""
    kinds = docs.schema[id_col].dataType.simpleString()
    per_doc = matches(docs, benchmark, id_col=id_col, text_col=text_col, **options).groupBy("uid").agg(
        F.sort_array(F.collect_set("item_id")).alias("items"), F.max("found").alias("found"), F.max(~F.col("verbatim")).alias("reworded")
    )
    per_doc = materialize(per_doc, "contaminated")
    rows = docs.select(F.col(id_col).cast(kinds).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("uid"))
    return rows.join(per_doc, "uid", "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast(per_doc.schema["items"].dataType)).alias("items"), F.coalesce("found", F.lit(0.0)).alias("found"), F.coalesce("reworded", F.lit(False)).alias("reworded")
    )

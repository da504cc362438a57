"""Language, toxicity, Katz scores and token counts: brute force, held-out accuracy, edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitelode.llm import katz, langid, token_counts, toxicity
from sitelode.llm.common import remainder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_fold_is_crc32_of_the_id_as_text(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").withColumn("r", remainder("doc_id", 7)).collect()
    assert all(r.r == zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 7 for r in rows)


def test_language_of_held_out_documents(spark, documents):
    held = remainder("doc_id", 4) == 2
    of_lang = langid.profiles(documents.where(~held))
    got = langid.identify(documents, of_lang, held).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got) > 0
    assert all(0 <= r.score <= 1 for r in got)


def test_out_of_place_by_hand(spark):
    of_lang = {"aa": langid.ranked(*np.unique(langid.ngrams("aba aba"), return_counts=True), 300).tolist(), "bb": langid.ranked(*np.unique(langid.ngrams("xyz"), return_counts=True), 300).tolist()}
    lang, score = langid.OutOfPlace(of_lang, 300)("aba aba")
    assert (lang, score) == ("aa", 1.0)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "123 ½ ² Ⅷ ① ..."), (4, "aba"), (4, "aba")], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in langid.identify(rows, of_lang).collect())
    assert got[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)] and [g[1] for g in got[3:]] == ["aa", "aa"]
    assert langid.profiles(spark.createDataFrame([], "text string, lang string")) == {}


def chain_by_hand(e, start, step):
    """Marginals of the toxic state by enumeration."""
    n = len(e)
    total = on = None
    weights = {}
    for bits in range(2**n):
        y = [bits >> i & 1 for i in range(n)]
        s = start[y[0]] + sum(e[i] * y[i] for i in range(n)) + sum(step[y[i - 1]][y[i]] for i in range(1, n))
        weights[tuple(y)] = math.exp(s)
    total = sum(weights.values())
    on = [sum(w for y, w in weights.items() if y[i]) / total for i in range(n)]
    return on


def test_marginals_match_enumeration():
    rng = random.Random(2)
    start, step = np.array([0.3, -0.2]), np.array([[0.5, -1.0], [-0.3, 0.9]])
    chains = [[rng.uniform(-2, 2) for _ in range(n)] for n in (1, 5, 8, 3, 7)] * 12
    e = np.array([v for c in chains for v in c])
    first = np.zeros(len(e), bool)
    first[np.cumsum([0] + [len(c) for c in chains])[:-1]] = True
    p = toxicity.marginals(e, first, start, step)[2]
    want = [v for c in chains for v in chain_by_hand(c, start, step)]
    assert np.allclose(p, want)


def test_toxic_words_are_found_with_offsets(spark):
    rng = random.Random(7)
    clean = [f"w{i}" for i in range(50)]
    rows, labels = [], []
    for i in range(300):
        w = [rng.choice(clean) for _ in range(30)]
        if i % 3 == 0:
            w[rng.randrange(30)] = rng.choice(["awful", "Nasty!"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "")], "doc_id long, text string")
    held = remainder("id", 5) == 0
    model = toxicity.fit_sample(*toxicity.sample(docs, spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int"), held))
    got = {r.doc_id: r for r in toxicity.score(docs, model, spans=True).collect()}
    assert all(got[i].predicted == y for i, y in labels)
    text = dict(rows)
    assert {text[i][s.start : s.end] for i, r in got.items() if i < 900 for s in r.spans} <= {"awful", "Nasty!"}
    assert got[900].predicted == got[901].predicted == 0 and got[900].score == got[901].score
    columns = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score_of(model, F.col("text")).alias("s")).collect()}
    assert all(abs(columns[i] - r.score) < 1e-12 for i, r in got.items())


def test_toxicity_scores_match_enumeration(spark):
    """A text's score is the logistic of its largest marginal and their sum, taken here from all labellings."""
    model = toxicity.Model({"w=bad": 6.0, "p3=bad": 1.0, "w=dull": 2.5}, -4.0, (0.5, -0.5), ((0.4, -0.6), (-0.2, 0.7)), (-3.0, 4.0, 1.5))
    texts = ["bad day", "a dull Bad! b", "", None, "bad\u00a0day x", "x " * 3 + "badly"]
    docs = spark.createDataFrame([(i, t, 1.0, True, "m") for i, t in enumerate(texts)], "doc_id long, text string, score double, held_out boolean, spans string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, t in enumerate(texts):
        e = [model.emission(w) for w in (t or "").replace("\u00a0", "_").split()]
        p = chain_by_hand(e, model.start, model.step) if e else []
        z = model.curve[0] + model.curve[1] * max(p, default=0) + model.curve[2] * math.log1p(sum(p))
        if "\u00a0" not in (t or ""):
            assert got[i] == pytest.approx(1 / (1 + math.exp(-z)))
    spans = {r.doc_id: r.score for r in toxicity.score(docs, model, spans=True).collect()}
    assert spans == pytest.approx(got)


def test_models_on_odd_tables(spark):
    columns = "doc_id long, text string, lang string, score double, held_out boolean, row long, n string, known int, size int"
    rows = [(1, "some words here", "en", 1.0, True, 1, "n", 1, 1), (1, "some words here", "en", 1.0, True, 1, "n", 1, 1), (None, None, None, None, None, None, None, None, None), (2, "", "en", 1.0, True, 1, "n", 1, 1), (3, "word " * 150_000, "en", 0.0, False, 0, "", 0, 0)]
    docs = spark.createDataFrame(rows, columns)
    model = toxicity.fit_sample(*toxicity.sample(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")))
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    for run in (lambda d: langid.identify(d, langid.profiles(docs)), lambda d: toxicity.score(d, model), lambda d: token_counts.token_counts(d, path)):
        got = run(docs).collect()
        assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 2, 3] and run(docs.limit(0)).count() == 0
        same = [r for r in got if r.doc_id == 1]
        assert same[0] == same[1]
    counted = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    assert counted[None] == counted[2] == 0 and counted[3] == 150_000


def out_of_place_by_hand(text, of_lang, top=300):
    words = __import__("re").findall(r"[^\W\d_]+", (text or "").lower())
    s = f" {' '.join(words)} "
    grams = Counter(g for n in (1, 2, 3) for g in (s[i : i + n] for i in range(len(s) - n + 1)) if g != " " and (n < 3 or g[1] != " "))
    if not words:
        return "und", 0.0
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    own = sorted(map(code, grams), key=lambda c: (-counts[c], c))[:top] if (counts := {code(g): n for g, n in grams.items()}) else []
    far = {lang: sum(min(abs(p.index(c) - i), top) if c in p else top for i, c in enumerate(own)) for lang, p in of_lang.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (top * len(own))


def test_languages_match_brute_force(spark, documents):
    of_lang = langid.profiles(documents)
    docs = documents.limit(60).cache()
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, of_lang).collect()}
    for r in docs.collect():
        lang, score = out_of_place_by_hand(r.text, of_lang)
        assert got[r.doc_id][0] == lang and got[r.doc_id][1] == pytest.approx(score)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = toxicity.fit_sample(*toxicity.sample(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert toxicity.score(docs, model).first().predicted == 0


def brute_katz(rows, k=5):
    tok = lambda t: (t or "").encode().lower().split() + ["</s>"]
    train = [tok(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    d1 = katz.good_turing(Counter(c.values()), k)
    disc = lambda x, d: x * d[x] if x <= k else x
    p1 = {w: disc(x, d1) / n for w, x in c.items()}
    unknown = 1 - sum(p1.values())
    pairs = Counter(p for t in train for p in zip(["</s>"] + t[:-1], t, strict=True))
    d2 = katz.good_turing(Counter(pairs.values()), k)
    after = {}
    for (h, w), x in pairs.items():
        after.setdefault(h, {})[w] = x
    size, alpha = {}, {}
    for h, m in after.items():
        kept = sum(disc(x, d2) for x in m.values())
        size[h] = sum(m.values()) + (kept >= sum(m.values()) * (1 - 1e-12))
        alpha[h] = (1 - kept / size[h]) / (1 - sum(p1[w] for w in m))

    def p(h, w):
        m = after.get(h, {})
        return disc(m[w], d2) / size[h] if w in m else alpha.get(h, 1) * p1.get(w, unknown)

    out = {}
    for i, t in rows:
        ws = tok(t)
        hs = ["</s>"] + ws[:-1]
        out[i] = (len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), sum(math.log10(p(h, w)) for h, w in zip(hs, ws, strict=True)))
    sums = [sum(p(h, w) for w in c) + p(h, object()) for h in list(after)[:50]]
    return out, sums


def test_katz_matches_brute_force_and_sums_to_one(spark, documents, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(9001, None), (9002, "only unknown zzzzq words")]
    rows.append(rows[0])
    want, sums = brute_katz(rows)
    assert all(abs(s - 1) < 1e-9 for s in sums)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(katz, "BUCKET", 20_000)
    # the lists are shortcuts: their sizes change no score
    for lists in ({}, {"hot_words": 100, "hot_pairs": 50, "split_at": 500}, {"hot_words": 0, "hot_pairs": 0}, {"hot_words": 3000, "hot_pairs": 5000, "split_at": 100}):
        got = katz.katz_scores(df, katz.fold(), **lists).collect()
        assert len(got) == len(rows)
        for r in got:
            n, known, total, base, score = want[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
            assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_word_keys(monkeypatch):
    monkeypatch.setattr(katz, "STROKE", 64)
    rng = random.Random(4)
    texts = ["".join(rng.choices("aBé \t\n\x0b\u00a0", k=rng.choice([0, 1, 5, 40, 400]))) for _ in range(300)] + ["x" * 500, " " * 200, "y " * 300]
    keys, n = katz.WordKeys()(pa.array(texts))
    words = [t.encode().lower().split() for t in texts]
    assert n.tolist() == [len(w) for w in words]
    pairs = set(zip((w for ws in words for w in ws), keys.tolist(), strict=True))
    assert len(pairs) == len({w for w, _ in pairs}) == len({k for _, k in pairs}) and all(k < 0 for _, k in pairs)
    own = np.unique(keys)
    got = katz.Numbers(own[::2].copy())(own)
    assert got[::2].tolist() == list(range(1, len(own[::2]) + 1)) and (got[1::2] == own[1::2]).all()


def test_katz_edges(spark):
    columns = "doc_id long, row long, key string, score string, text string"
    rows = [(1, 5, "k", "s", "a b " * 60_000 + "x" * 100_000), (1, 5, "k", "s", None), (None, None, None, None, ""), (3, 1, "k", "s", "a b"), (3, 1, "k", "s", "a b"), (4, 1, "", "", "a" * 100)]
    docs = spark.createDataFrame(rows, columns)
    got = katz.katz_scores(docs).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (1, 1), (1, 120_002), (3, 3), (3, 3), (4, 2)]
    assert all(r.n_known == r.n_tokens and math.isfinite(r.score) for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    unlearned = katz.katz_scores(docs, F.lit(True)).collect()
    assert len(unlearned) == 6 and all(r.n_known == r.train_tokens == r.score == 0 for r in unlearned)
    assert katz.katz_scores(docs.limit(0)).collect() == []


def test_katz_without_documents(spark):
    assert katz.katz_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_counts_match_the_library(spark, documents):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    odd = ["", "don't <|endoftext|> stop", "<|startoftext|><|startoftext|>", "İ̘ ǅ x\x85y", "日本語 かな 123", "a" * 3000, "₏ ꟱ x"]
    rows = [(r.doc_id, r.text) for r in documents.limit(60).collect()] + [(8000 + i, t) for i, t in enumerate(odd)] + [(7999, None), (8000, "again")]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path, limit=100, frequent=50).collect()
    want = sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)


def test_only_files_of_one_kind_are_counted(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    token_counts.check_file(tokenizers.path("word_bpe_49k.json"))
    others = [p for p in __import__("pathlib").Path(tokenizers.path("word_bpe_49k.json")).parent.glob("*.json") if p.name != "word_bpe_49k.json"]
    for path in others:
        with pytest.raises((ValueError, KeyError, AttributeError)):
            token_counts.check_file(str(path))

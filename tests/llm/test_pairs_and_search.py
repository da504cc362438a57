"""Near-duplicates and nearest neighbours against brute force, and their edge cases."""

import random

import numpy as np
import xxhash

from sitelode.llm import simhash, vptree

DOCS = "doc_id long, text string, fingerprint string, component_id string"


def brute_fingerprint(text, size=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] if w else []
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(grams)) if grams else 0


def brute_components(fps, linked):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and linked(fps[a], fps[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(80)) for _ in range(12)]
    rows = []
    for t in base:
        for _ in range(rng.randint(1, 6)):
            w = t.split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w))
    return rows + ["", None, "One", "one", "two words", "A b C d", "a B c D", " \t "]


def test_components_match_brute_force(spark):
    texts = corpus()
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS), split_at=3).collect()}
    fps = {i: brute_fingerprint(t) for i, t, *_ in rows}
    want = brute_components(fps, lambda a, b: bin(a ^ b).count("1") <= 3)
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == want


def test_similar_documents_link_near_copies_only(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(2000)]
    rows, groups = [], []
    for g in range(20):
        w = [rng.choice(vocab) for _ in range(200)]
        for k in range(4):
            v = list(w)
            for _ in range(k):  # each changed word changes five of 196 shingles
                v[rng.randrange(len(v))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(v)))
            groups.append(g)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), split_at=5).collect()}
    assert [got[i] for i, _ in rows] == [4 * groups[i] for i, _ in rows]


def test_similar_documents_at_the_similarity(spark):
    """Pairs of 0.8 or just above, pairs just below, and pairs whose repeated shingles outweigh the others."""
    rng = random.Random(11)
    rows, want = [], {}
    for g in range(90):
        w = [f"g{g}x{rng.randrange(10**6)}" for _ in range(200)]
        line = w[20:32]
        if g % 3 == 2:
            other = w + line * 30
        else:  # w has 196 shingles; a new tail of n words takes n of them and adds n
            n = 21 if g % 3 == 0 else 24  # 175 / 217 = 0.806, 172 / 220 = 0.782
            other = w[:-n] + [f"new{g}x{i}" for i in range(n)]
        sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (w, other)]
        alike = len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.8
        assert alike == (g % 3 != 1)
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(other))]
        want |= {2 * g: 2 * g, 2 * g + 1: 2 * g if alike else 2 * g + 1}
    for split_at in (1000, 1):
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), split_at=split_at).collect()}
        assert got == want


def test_pairs_on_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.similar_documents(empty).count() == 0
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, None), (3, "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 2), (3, 2)]


def test_ids_beyond_doubles_and_very_long_texts(spark):
    big, long = 2**53 + 1, "w " * 200_000
    rows = [(big, "a b c d", "x", "y"), (None, "a b c d", "x", "y"), (big + 1, long, "x", "y"), (big + 2, long, "x", "y"), (big + 2, "q r s t u v", "x", "y")]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, big), (big, big), (big + 1, big + 1), (big + 2, big + 1), (big + 2, big + 2)]
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.similar_documents(docs).collect())
    assert got == [(0, big), (big, big), (big + 1, big + 1), (big + 2, big + 1), (big + 2, big + 2)]


def test_hot_keys_are_spread(spark):
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(k, k) for k in range(2, 40)], "u long, x long")
    right = left.groupBy("u").count().withColumnRenamed("count", "n").withColumn("m", simhash.F.col("u") * 10)
    got = simhash._spread_join(left, right, "u", share=3).select("u", "x", "m").collect()
    assert sorted(map(tuple, got)) == sorted((r.u, r.x, r.u * 10) for r in left.collect())


def test_marginal_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[501] == 500


def test_search_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    x[50:250] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1100, [0.0] * 8), (1200, [1.0, None] + [0.0] * 6), (1300, [float("nan")] * 8), (1400, [1.0, 2.0]), (None, [1.0] * 8)]
    v = vptree.usable(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"))
    got = vptree.nearest(v, v.where("id % 100 = 0"), k=10, shard_rows=100, block_rows=3).collect()
    want = set()
    for q in range(0, 600, 100):
        d = sorted((float(np.sqrt(((x[q] - x[i]) ** 2).sum())), i) for i in range(600) if i != q)[:10]
        want |= {(q, n + 1, i) for n, (_, i) in enumerate(d)}
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == want
    relaxed = vptree.nearest(v, v.where("id % 100 = 0"), k=10, factor=1.2, shard_rows=100, block_rows=3).collect()
    assert len({(r.query_id, r.vec_id) for r in relaxed} & {(a, c) for a, _, c in want}) >= 0.9 * len(want)


def test_search_among_equal_and_infinite_distances(spark):
    rows = [(i, [float(j == i) for j in range(1200)]) for i in range(1200)]
    v = vptree.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = vptree.nearest(v, v.where("id % 400 = 0"), k=3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (400, 1, 0), (400, 2, 1), (400, 3, 2), (800, 1, 0), (800, 2, 1), (800, 3, 2)]
    far = [(i, [(-1.0) ** i * 1e200, float(i)]) for i in range(300)]
    v = vptree.usable(spark.createDataFrame(far, "vec_id long, embedding array<double>"))
    got = vptree.nearest(v, v.where("id % 100 = 0"), k=200, shard_rows=90).collect()
    want = [(q, s, i) for q in (0, 100, 200) for s, i in sorted((float(abs(i - q)) if i % 2 == 0 else float("inf"), i) for i in range(300) if i != q)[:200]]
    assert [(r.query_id, r.score, r.vec_id) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == want


def test_search_without_vectors(spark):
    v = vptree.usable(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert vptree.nearest(v, v).count() == 0

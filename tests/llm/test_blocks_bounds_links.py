"""Repeated passages, bounded clusters and aligned tokenizers against brute force, and their edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from sitelode.llm import alignment, anchors, elkan

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "Hello world", "Hello  world", "Hello world\n", "line\nline\n\n  tabs\there", "\n \n", "a\n b \n c",
    "café naïve 你好世界 \U0001f600\U0001f600", "x▁y", "▁", "a b c", "a\x1cb\x1c c", "tail 　 x", "<|endoftext|> <s> </s> <unk> <0x41>",
    "don't can't I'LL 12345 67,890.12", "\x00 \x07 b", "é ́ x", "﻿bom ﬁ ①", "w" * 3000, "word " * 2000, "  deep   runs    of     blanks ", "​ ᠎ \u0085 a\u0085 b",
]


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    from tokenizers.pre_tokenizers import ByteLevel

    assert sorted(ByteLevel.alphabet()) == sorted(alignment.byte_alphabet())
    letters = alignment.byte_alphabet()

    def spans(tokens):
        out, at = [], 0
        for i, t in tokens:
            out.append((i, at, at + len(t)))
            at += len(t)
        return out

    found, counts = [], Counter()
    for text in texts:
        x = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        y = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in (b.encode(text) if text else []) for p in [b.id_to_piece(i)]]
        whole = (" " + text).encode() if text else None
        if b"".join(t for _, t in x) != whole or b"".join(t for _, t in y) != whole:
            x = y = []
        x, y = spans(x), spans(y)
        links = [(i, j) for i, s, e in x for j, u, v in y if s < v and u < e] if len(x) < 500 else sweep(x, y)
        cuts = sorted({e for _, _, e in x} & {e for _, _, e in y})
        groups, lo = [], 0
        for cut in cuts if len(x) < 500 else []:
            groups.append(",".join(str(i) for i, s, _ in x if lo <= s < cut) + "|" + ",".join(str(i) for i, s, _ in y if lo <= s < cut))
            lo = cut
        counts.update(links)
        found.append([len(x), len(y), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""])
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(na, nb, g, len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), h if na < 500 else None) for na, nb, g, k, h in found], counts


def sweep(x, y):
    out, j = [], 0
    for i, s, e in x:
        while y[j][2] <= s:
            j += 1
        at = j
        while at < len(y) and y[at][1] < e:
            out.append((i, y[at][0]))
            at += 1
    return out


@pytest.mark.parametrize("frequent", [500_000, 7, 0])
def test_alignment_matches_brute_force(spark, frequent):
    rng = random.Random(2)
    vocab = ["the", "Tokenizer", "naïve", "x1", "12", "...", "你好", "(so)", "co-operate", "\n", "  ", "\t"]
    texts = TEXTS + [rng.choice([" ", ""]).join(rng.choice(vocab) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, a string, n int")
    got, pairs = alignment.align_documents(docs, A, B, frequent=frequent, salts=3)
    got = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    want, counts = brute_alignment(texts)
    for i, w in enumerate(want):
        assert got[i][:-1] == w[:-1] and (w[-1] is None or got[i][-1] == w[-1]), repr(texts[i])[:80]
    assert {(r.a, r.b): r.n for r in pairs.collect()} == dict(counts)
    assert all(got[i] == (0, 0, 0, 0, 0, 0, "") for i in (0, 1, TEXTS.index("▁"), TEXTS.index("x▁y")))


def test_alignment_forgets_and_learns_again(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "a", "▁", "  x", f"w{rng.randrange(50)}"][: 5 if i % 5 else 2]) for _ in range(30)).encode() for i in range(80)]
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(80)), "text": pa.array(texts, pa.binary())})
    monkeypatch.setattr(alignment, "_tokenizers", lambda *paths, made=alignment.Tokenizers(A, B): made)
    want = pa.Table.from_batches(alignment._per_document(iter([rows]), A, B))
    monkeypatch.setattr(alignment, "MOST_LINKS", 100)
    for most in (3, 20, 40):
        monkeypatch.setattr(alignment, "MOST_SEGMENTS", most)
        assert pa.Table.from_batches(alignment._per_document(iter([rows]), A, B)).combine_chunks() == want.combine_chunks()


def test_alignment_of_odd_tables(spark):
    got, pairs = alignment.align_documents(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert got.count() == 0 and pairs.count() == 0
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (2, None)]
    got, _ = alignment.align_documents(spark.createDataFrame(rows, "doc_id long, text string"), A, B)
    assert sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in got.collect()) == [(0, 2, 6), (1, 2, 6), (1, 2, 6), (2, 0, 0)]
    raw = spark.createDataFrame([(1, bytearray(b"a\xff b")), (2, bytearray(b"a b"))], "doc_id long, text binary")
    assert sorted((r.doc_id, r.n_a) for r in alignment.align_documents(raw, A, B)[0].collect()) == [(1, 0), (2, 2)]


def brute_clusters(rows, k, rounds, seed):
    first = sorted(rows, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [list(x) for _, x in first]

    def nearest(x):
        return min((sum((p - q) ** 2 for p, q in zip(x, one, strict=True)), j) for j, one in enumerate(c))

    for _ in range(rounds):
        at = [nearest(x)[1] for _, x in rows]
        for j in range(len(c)):
            if own := [x for (_, x), i in zip(rows, at, strict=True) if i == j]:
                c[j] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    return [(i, *nearest(x)[::-1]) for i, x in rows], c


def test_clusters_match_brute_force(spark):
    rng = np.random.default_rng(4)
    for x in (rng.integers(-3, 4, (400, 3)), rng.integers(-300, 300, (600, 3)) // 10 * 10, np.zeros((30, 3), np.int64), rng.integers(-(2**27) + 1, 2**27, (50, 3))):
        rows = [(int(i), [int(v) for v in r]) for i, r in enumerate(x)]
        want, c = brute_clusters(rows, 5, 3, 7)
        state, got_c = elkan.cluster(spark.createDataFrame(rows, "vec_id long, x array<int>"), 5, 3, 7)
        assert got_c.tolist() == c
        got = sorted((r.vec_id, r.cluster, sum((p - q) ** 2 for p, q in zip(r.x, c[r.cluster], strict=True))) for r in state.collect())
        assert got == want


def test_bounds_hold_and_leave_distances_out(spark):
    rng = np.random.default_rng(5)
    middle = rng.integers(-4000, 4000, (8, 6))
    x = middle[rng.integers(0, 8, 3000)] + rng.integers(-50, 50, (3000, 6))
    rows = [(int(i), [int(v) for v in r]) for i, r in enumerate(x)]
    state, c = elkan.cluster(spark.createDataFrame(rows, "vec_id long, x array<int>"), 8, 3, 1)
    found = state.collect()
    for r in found[::50]:
        d = [sum((p - q) ** 2 for p, q in zip(r.x, one, strict=True)) ** 0.5 for one in c.tolist()]
        assert r.upper >= d[r.cluster] and all(low <= real for low, real in zip(r.lower, d, strict=True))
    assert sum(r.asked for r in found) < 0.5 * 8 * 4 * len(found)


def test_clusters_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, x string, cluster int"
    assert elkan.clusters(elkan.integers(spark.createDataFrame([], schema))).count() == 0
    one = [0.5] * 64
    rows = [(1, one), (1, one), (None, [-0.001] * 64), (2, None), (3, [float("nan")] * 64), (4, one[:63]), (5, [None, *one[1:]]), (6, [1e30, *one[1:]]), (7, [float("inf"), *one[1:]])]
    got = elkan.clusters(elkan.integers(spark.createDataFrame([(*r, "y", 3) for r in rows], schema))).collect()
    assert sorted((r.vec_id or 0, r.distance) for r in got) == [(0, 0), (1, 0), (1, 0)] and {r.inertia for r in got} == {0}
    assert {r.centroid_sha256 for r in got if r.vec_id is None} == {hashlib.sha256(",".join(["-1"] * 64).encode()).hexdigest()}


def brute_kept(texts, window):
    words = [(t or "").encode().split() for t in texts]
    starts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if starts[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "chunk_words"), [(5, 40), (6, 10**6), (35, 300), (1, 50)])
def test_repeats_match_brute_force(spark, window, chunk_words):
    rng = random.Random(window)
    vocab = [f"w{i}" for i in range(6 if window < 35 else 40)]
    passage = [f"p{i}" for i in range(window + 7)]
    texts = [None, "", " \t", "one", "same " * (3 * window), "same " * window, "same " * (window - 1), "A b " * 40, "a B " * 40, "a\x1cb\u00a0c " * window, "ä\x0bö\x0cü " * 20]
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 4 * window))]
        if i % 3 == 0:  # passages a little shorter, as long and longer than a window, at any offset
            lo = rng.randrange(8)
            w[len(w) // 2 : len(w) // 2] = passage[lo : lo + window + rng.randint(-1, 4)]
        texts.append(" ".join(w))
    texts += texts[20:25]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, chunk string, start int").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in anchors.remove_repeats(docs, window, chunk_words=chunk_words).collect()}
    assert [got[i] for i in range(len(texts))] == brute_kept(texts, window)


def test_repeats_in_hot_and_odd_tables(spark):
    assert anchors.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    line = " ".join(f"l{i}" for i in range(50))
    texts = [f"a{i} {line} b{i}" for i in range(3000)] + ["x y"] * 500
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = anchors.remove_repeats(docs).groupBy("n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(2, 0, 500), (52, 50, 3000)]
    far = " ".join(str(i) for i in range(200_000))
    two = spark.createDataFrame([(1, far + " " + line), (1, line + " " + far[:50_000])], "doc_id long, text string")
    assert sorted((r.n_words, r.n_removed) for r in anchors.remove_repeats(two).collect()) == sorted((n, r) for n, r, _ in brute_kept([far + " " + line, line + " " + far[:50_000]], 35))

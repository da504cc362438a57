"""SimHash near-duplicates by pivot distance tables.

Every text gets a 64-bit fingerprint. Fingerprints at Hamming distance
``radius`` or less are linked and linked documents form components.

Candidates come from blocks: 64 bits are cut into ``blocks`` blocks; two
fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of
them, so joining on every choice of that many blocks loses no pair. The pivot
table holds the Hamming distance of each fingerprint to fixed reference
fingerprints; by the triangle inequality a pair whose coordinates differ by
more than the radius anywhere can't be linked and is discarded before the
exact distance is taken.

Only distinct fingerprints are compared, so copies cost nothing. A block key
shared by more than ``split_at`` fingerprints is dealt out as pairs of chunks,
each a group of its own, so no task holds such a key whole; each group returns
the edges of a spanning forest, never all its pairs.

Nulls and texts without words have fingerprint zero and are linked like any
other. Texts are read whole, however long. Rows with the same doc_id are kept;
a null doc_id stays in the result with its component. Columns other than the id
and the text are ignored, whatever their names; empty tables give an empty
result.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.llm.common import materialize, words

SEED = 42
PIVOTS = 16


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(w) <= size:
        return np.array([h(b" ".join(w), SEED)], np.uint64)
    return np.array([h(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(size)), strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is one if it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long, one row per input row. Ids pass through untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(shingle_hashes(t.as_py(), shingle)) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fps: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds t0 and t1: the distances to sixteen reference fingerprints, a byte each."""
    rng = random.Random(seed)
    refs = [rng.getrandbits(64) for _ in range(PIVOTS)]

    def packed(part: list[int]):
        cells = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(r)))).cast("long"), 8 * i) for i, r in enumerate(part)]
        return reduce(lambda a, b: a.bitwiseOR(b), cells)

    return fps.withColumns({"t0": packed(refs[:8]), "t1": packed(refs[8:])})


def _block_masks(blocks: int, radius: int) -> list[int]:
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (before == root).all():
            break
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sets of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _alike(i: np.ndarray, j: np.ndarray, root: list[int], sets: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs of at least the similarity; those that others have linked already are left out. root: changed in place."""

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y and jaccard(np.frombuffer(sets[a], np.uint64), np.frombuffer(sets[b], np.uint64)) >= similarity:
            root[max(x, y)] = min(x, y)
            yield a, b


def _group_edges(fp: np.ndarray, table: np.ndarray, side: np.ndarray, radius: int, sig: np.ndarray | None, equal: float, sets: np.ndarray | None = None, similarity: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Links within one group, each node to the first of its part; rows of sides 0 and 1 are only compared across."""
    n, links = len(fp), []
    linked = list(range(n))
    one = np.flatnonzero(side == 0) if side.any() else np.arange(n)
    other = np.flatnonzero(side == 1) if side.any() else one
    for at in range(0, len(one), 256):
        rows = one[at : at + 256]
        near = np.ones((len(rows), len(other)), bool)
        for c in range(table.shape[1]):  # the largest coordinate difference decides
            near &= np.abs(table[rows, c][:, None] - table[other, c][None, :]) <= radius
        i, j = np.nonzero(near)
        i, j = rows[i], other[j]
        keep = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        i, j = i[keep], j[keep]
        if sig is not None:
            parts = [(sig[i[k : k + 20_000]] == sig[j[k : k + 20_000]]).mean(axis=1) >= equal for k in range(0, len(i), 20_000)]
            keep = np.concatenate(parts) if parts else np.zeros(0, bool)
            i, j = i[keep], j[keep]
        if sets is not None:
            once = i < j if one is other else np.ones(len(i), bool)
            pairs = np.array(list(_alike(i[once], j[once], linked, sets, similarity)), np.int64).reshape(-1, 2)
            i, j = pairs[:, 0], pairs[:, 1]
        links.append((i, j))
    a, b = (np.concatenate(x) for x in zip(*links, strict=True)) if links else (np.empty(0, np.int64),) * 2
    root = _roots(n, a, b)
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


_GROUP = ["k", "key", "a", "b"]


def _link_sorted(batches: Iterator[pd.DataFrame], radius: int, equal: float, similarity: float) -> Iterator[pd.DataFrame]:
    """Rows come sorted by group. A group is worked on once its last row has come. node names a row's fingerprint;
    sig, if there is one, its minima; shingles, if there are any, its set."""
    rest: list[pd.DataFrame] = []

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, node = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["node"].to_numpy(np.int64)
        table = np.concatenate([pdf[c].to_numpy(np.int64).astype("<i8").view(np.uint8).reshape(-1, 8) for c in ("t0", "t1")], axis=1).astype(np.int16)
        side = pdf["side"].to_numpy()
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), -1) if "sig" in pdf else None
        sets = pdf["shingles"].to_numpy() if "shingles" in pdf else None
        g = pdf[_GROUP].to_numpy(np.int64)
        new = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]).any(axis=1)])
        out_a, out_b = [], []
        for s, e in zip(new, np.r_[new[1:], len(g)], strict=True):
            if e - s > 1:
                i, j = _group_edges(fp[s:e], table[s:e], side[s:e], radius, None if sig is None else sig[s:e], equal, None if sets is None else sets[s:e], similarity)
                out_a.append(node[s + i])
                out_b.append(node[s + j])
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return pd.DataFrame({"u": join(out_a), "v": join(out_b)})

    for pdf in batches:
        if not len(pdf):
            continue
        g = pdf[_GROUP].to_numpy(np.int64)
        if rest and (g == g[0]).all() and (rest[0][_GROUP].to_numpy(np.int64)[0] == g[0]).all():
            rest.append(pdf)  # still the same group
            continue
        pdf = pd.concat([*rest, pdf], ignore_index=True)
        g = pdf[_GROUP].to_numpy(np.int64)
        last = int(np.argmax((g == g[-1]).all(axis=1)))
        rest = [pdf.iloc[last:]]
        if last:
            yield work(pdf.iloc[:last])
    if rest:
        yield work(pd.concat(rest, ignore_index=True))


def _link_groups(keyed: DataFrame, radius: int, split_at: int, payload: DataFrame | None = None, equal: float = 0.0, similarity: float = 0.0) -> DataFrame:
    """u, v: links within groups of keyed (node, k, key and, if there is no payload by node, fp, t0, t1)."""
    shared = materialize(keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    chunks = F.ceil(F.col("n") / split_at).cast("int")
    own = F.when(chunks > 1, F.pmod(F.xxhash64("node"), chunks).cast("int")).otherwise(0)
    pairs = F.transform(
        F.sequence(F.lit(0), chunks - 1),
        lambda j: F.struct(F.least(own, j).alias("a"), F.greatest(own, j).alias("b"), (own > j).cast("int").alias("side")),
    )
    dealt = keyed.join(shared, ["k", "key"]).select(*keyed.columns, F.inline(pairs))
    if payload is not None:
        dealt = dealt.join(payload, "node")
    dealt = dealt.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "node")
    return dealt.mapInPandas(lambda it: _link_sorted(it, radius, equal, similarity), "u long, v long").distinct()


def links(fps: DataFrame, radius: int = 3, blocks: int = 5, split_at: int = 1000) -> DataFrame:
    """u, v: edges between distinct fingerprints (column fp) whose components are those of all links."""
    masks = _block_masks(blocks, radius)
    keyed = pivot_table(fps.select("fp").distinct()).select(
        F.col("fp").alias("node"), "fp", "t0", "t1", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("k", "key")
    )
    return _link_groups(keyed, radius, split_at)


def _spread_join(left: DataFrame, right: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """left joined to right, which has a row per key and in n how many rows of left have it. Keys of more than a thousandth
    of them, a thousand at most, are joined by broadcast, so that no task gets all rows of such a key."""
    total = right.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * share > total
    frequent, other = right.where(hot).drop("n"), right.where(~hot).drop("n")
    rest = left.join(F.broadcast(frequent.select(key)), key, "left_anti").join(other, key)
    return left.join(F.broadcast(frequent), key).unionByName(rest)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root: the smallest node that each node of edges (u, v) reaches, by alternating large and small stars."""
    now = materialize(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = state(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")), "low")
        # large star: every larger neighbour goes to the smallest of the neighbourhood
        large = _spread_join(both.where("v > u"), low.where("n > 0"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.where("u <> v"), "large")
        # small star: the smaller neighbours and the node itself go to the smallest of them
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = _spread_join(large, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = materialize(small.where("u <> v").distinct(), "small")
        before, seen = seen, state(now)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _with_least(rows: DataFrame, tree: DataFrame, value: Column) -> DataFrame:
    """rows (node, ...) plus least: the smallest value of any row of the component; tree: node, root."""
    nodes = rows.groupBy("node").agg(F.min(value).alias("least"), F.count("*").alias("rows"))
    rooted = materialize(nodes.join(tree, "node", "left").select("node", "least", "rows", F.coalesce("root", "node").alias("root")), "rooted")
    of_root = materialize(rooted.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("n")), "roots")
    members = _spread_join(rooted.select("node", "root", "rows"), of_root, "root").select("node", "least", F.col("rows").alias("n"))
    return _spread_join(rows, materialize(members, "members"), "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, blocks: int = 5, split_at: int = 1000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of the component), one row per input row."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    tree = components(links(fps, radius, blocks, split_at))
    rows = _with_least(fps.withColumn("node", F.col("fp")), tree, F.col("doc_id"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


_MINIMA, _BAND = 125, 5


def _minima(hashes: np.ndarray) -> bytes:
    """16 bits each of the smallest value of so many permutations of the shingle hashes."""
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(1, 1 << 63, _MINIMA, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, _MINIMA, np.uint64)
    least = np.full(_MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        x = hashes[i : i + 4096, None] * a + b
        x ^= x >> np.uint64(29)  # high bits of a product depend on all bits below
        least = np.minimum(least, x.min(axis=0))
    return ((least >> np.uint64(13)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """node, shingles: the sorted set of the shingle hashes of each text and the hash of that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                sets = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in b.column("text").slice(lo, 500)]
                yield pa.RecordBatch.from_arrays([_nodes(sets), pa.array(sets, pa.binary())], ["node", "shingles"])

    return rows.select("text").mapInArrow(run, "node long, shingles binary")


def _nodes(sets: list[bytes]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(x, SEED) for x in sets], np.uint64).view(np.int64))


def similar_documents(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 28, tolerance: float = 0.2, split_at: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, uid, component_id, keeper for texts whose sets of word shingles are alike to a degree: one row per input row.

    uid is the hash of a row's id and text, component_id the smallest id of the component (null if it has none), keeper the
    uid of the row with that id, of the smallest of them if several have it.

    Fingerprints are those of the sets. At a similarity of 0.8 they differ in about ten bits, too many for blocks of bits.
    Blocks are taken from the smallest values of permuted shingle hashes instead: five of them in one of 25 groups (a pair
    at 0.8 is missed once in twenty thousand). Pairs of a block go through the pivot table, the Hamming distance and the
    share of equal minima, all of them wide: more than 28 bits, or less than the similarity by `tolerance`, come less than
    once in a hundred thousand pairs at 0.8. What they link are groups of candidates; within these, a pair is linked if its
    sets of shingles have the similarity, taken exactly. Texts without words are one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in part.column("text")]
                fp = pa.array(np.array([fingerprint(h) for h in sets], np.uint64).view(np.int64))
                sig = pa.array([_minima(h) for h in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("uid"), _nodes([h.tobytes() for h in sets]), fp, sig], ["doc_id", "uid", "node", "fp", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("uid"), F.col(text_col).alias("text"))
    rows = materialize(texts.mapInArrow(run, f"doc_id {kind}, uid long, node long, fp long, sig binary"), "fingerprints")
    nodes = materialize(pivot_table(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("sig").alias("sig"), F.min("uid").alias("uid"))), "nodes")
    bands = F.array(*[F.xxhash64(F.substring("sig", 1 + i * 2 * _BAND, 2 * _BAND)) for i in range(_MINIMA // _BAND)])
    keyed = nodes.select("node", F.posexplode(bands).alias("k", "key"))
    near = components(_link_groups(keyed, radius, split_at, nodes.drop("uid"), similarity - tolerance))
    near = materialize(near.union(near.select("root", "root")).distinct(), "candidates")
    # the sets of candidates only, of one text a node
    chosen = nodes.join(near, "node", "left_semi").select("uid")
    sets = shingle_sets(texts.join(chosen, "uid", "left_semi"), shingle).dropDuplicates(["node"])
    payload = materialize(nodes.drop("uid").join(near, "node", "left_semi").join(sets, "node"), "sets")
    keyed = near.select("node", F.lit(0).alias("k"), F.col("root").alias("key"))
    tree = components(_link_groups(keyed, radius, split_at, payload, similarity - tolerance, similarity))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "uid")
    out = _with_least(rows.select("doc_id", "uid", "node"), tree, order)
    return out.select("doc_id", "uid", F.col("least.doc_id").alias("component_id"), F.col("least.uid").alias("keeper"))

"""Centroid clustering with Elkan's bounds.

Each vector keeps the number of its centroid, an upper bound of its distance to
it and a lower bound of its distance to each centroid. When centroids have moved,
the bounds move by as much; a distance is calculated only where the bounds and
half the distance between two centroids leave open which of them is nearer.
Bounds are doubles, always rounded to the safe side, and a distance is left out
only if it is larger for certain, so ties are seen and go to the smaller number.
Every distance that is calculated is an exact integer.

The bounds travel with the vectors: a round reads the vectors as the round before
has written them and writes them again, no row is shuffled, and only sums of at
most centroids x components numbers come to the driver.

Vectors of another length, null ones and those with null or non-finite components
take no part; nor do those with an integer of 2**27 or more either way, as no long
holds all their distances. Rows that repeat an id are vectors each; a null id
counts as an empty one where starts are drawn, and starts of one hash are taken in
the order of their components. With fewer vectors than centroids each starts one. An
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelode.llm.common import materialize

#: From here on an integer is too large: 64 squares of twice as much fill a long.
LIMIT = 2**27
#: What rounding of a square root and a sum can take from a bound, generously.
_DOWN, _UP = 1 - 2.0**-48, 1 + 2.0**-48


def integers(vectors: DataFrame, dims: int = 64, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, x (array of ints): the vectors that take part, each component times `scale`, rounded down."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    rows = vectors.where((F.size(vec_col) == dims) & F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda a: a * F.lit(scale)).alias("x"))
    return rows.where(F.forall("x", lambda a: F.abs(a) < float(LIMIT))).select("vec_id", F.transform("x", lambda a: F.floor(a).cast("int")).alias("x"))


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id: at most `k` rows come to the driver."""
    first = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)).orderBy("h", "x").limit(k)
    return np.array([r.x for r in first.select("x").collect()], np.int64)


def square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def half_between(c: np.ndarray) -> np.ndarray:
    """Half the distances between centroids, rounded down; a centroid is infinitely far from itself, so it is never asked."""
    half = np.sqrt(np.array([square(c, one) for one in c], np.float64)) * (0.5 * _DOWN)
    np.fill_diagonal(half, np.inf)
    return half


def assign(x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centroid, upper bound and lower bounds of each vector, and how many distances it took. The arrays given are left alone."""
    a, upper, lower, asked = a.copy(), upper.copy(), lower.copy(), np.zeros(len(x), np.int64)
    own = half[a].min(axis=1)
    rows = np.flatnonzero(~(own > upper))  # for the others every centroid is further for certain
    rows = rows[~((lower[rows] > upper[rows, None]) | (half[a[rows]] > upper[rows, None])).all(axis=1)]
    x, at, low = x[rows], a[rows], lower[rows]
    best = square(x, c[at])
    up = np.sqrt(best.astype(np.float64)) * _UP
    low[np.arange(len(rows)), at] = np.sqrt(best.astype(np.float64)) * _DOWN
    asked[rows] += 1
    for j in range(len(c)):
        near = np.flatnonzero((at != j) & ~(low[:, j] > up) & ~(half[at, j] > up))
        d = square(x[near], c[j])
        low[near, j] = np.sqrt(d.astype(np.float64)) * _DOWN
        asked[rows[near]] += 1
        closer = (d < best[near]) | (d == best[near]) & (j < at[near])
        won = near[closer]
        at[won], best[won] = j, d[closer]
        up[won] = np.sqrt(d[closer].astype(np.float64)) * _UP
    a[rows], upper[rows], lower[rows] = at, up, low
    return a, upper, lower, asked


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind, copy=False)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel()))


def _round(batches: Iterator[pa.RecordBatch], c: np.ndarray, moved: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One assignment. moved: how far each centroid has gone since the bounds were made, rounded up."""
    half = half_between(c)
    for b in batches:
        if not b.num_rows:
            continue
        x, a = _matrix(b.column(1), c.shape[1], np.int64), b.column(2).to_numpy().astype(np.int64)
        upper = (b.column(3).to_numpy() + moved[a]) * _UP
        lower = np.maximum(_matrix(b.column(4), len(c), np.float64) * _DOWN - moved, 0)
        a, upper, lower, asked = assign(x, a, upper, lower, c, half)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(a, pa.int32()), pa.array(upper), _lists(lower), pa.array(asked + b.column(5).to_numpy())], ["vec_id", "x", "cluster", "upper", "lower", "asked"])


def _sums(batches: Iterator[pa.RecordBatch], k: int, dims: int) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for b in batches:
        a = b.column(0).to_numpy()
        x = _matrix(b.column(1), dims, np.int64)
        for j in np.unique(a):
            total[j] += x[a == j].sum(axis=0)
            n[j] += (a == j).sum()
    j, pos = np.nonzero(np.broadcast_to(n[:, None] > 0, total.shape))
    yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(pos, pa.int32()), pa.array(total[j, pos]), pa.array(n[j])], ["cluster", "pos", "total", "n"])


def means(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids' next places: exact means rounded down; those without vectors stay."""
    k, dims = c.shape
    parts = state.select("cluster", "x").mapInArrow(lambda it: _sums(it, k, dims), "cluster int, pos int, total long, n long")
    c = c.copy()
    for r in parts.groupBy("cluster", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k x dims rows at most
        c[r.cluster, r.pos] = r.total // r.n
    return c


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """vec_id, x, cluster, upper, lower, asked after `rounds` moves of the centroids and one more assignment; the centroids.

    rows: as integers() returns them. asked: how many distances to a centroid were calculated for a vector."""
    c = starts(rows, k, seed)
    state = rows.select(
        "vec_id", "x", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.array_repeat(F.lit(0.0), len(c)).alias("lower"), F.lit(0).cast("long").alias("asked")
    )
    if not len(c):
        return state, c
    moved = np.zeros(len(c))
    for i in range(rounds + 1):
        state = materialize(state.mapInArrow(lambda it, c=c, moved=moved: _round(it, c, moved), state.schema), "round")
        if i < rounds:
            last, c = c, means(state, c)
            moved = np.sqrt(square(c, last).astype(np.float64)) * _UP
    return state, c


def clusters(rows: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row a vector. A sum that no long holds is null."""
    spark = rows.sparkSession
    state, c = cluster(rows, k, rounds, seed)
    if not len(c):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = b.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(square(_matrix(b.column(1), c.shape[1], np.int64), c[a]))], ["vec_id", "cluster", "distance"])

    found = state.select("vec_id", "x", "cluster").mapInArrow(distances, "vec_id long, cluster int, distance long")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows at most
    whole = sum(int(r.s) for r in sums)
    fits = lambda n: int(n) if n < 2**63 else None
    each = [(r.cluster, fits(r.s), fits(whole), hashlib.sha256(",".join(map(str, c[r.cluster].tolist())).encode()).hexdigest()) for r in sums]
    each = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """DuckDB's SQL: every distance of every round, without bounds."""
    nearest = """a{i} AS MATERIALIZED (
  SELECT v.n, c.j, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
  FROM v CROSS JOIN c{i} c QUALIFY row_number() OVER (PARTITION BY v.n ORDER BY d, c.j) = 1)"""
    moved = """m{i} AS (
  SELECT a.j, p.pos, sum(v.x[p.pos])::HUGEINT AS s, count(*) AS cnt, (s - (s % cnt + cnt) % cnt) // cnt AS t FROM a{i} a JOIN v USING (n) CROSS JOIN (SELECT unnest(range(1, {dims} + 1)) AS pos) p GROUP BY a.j, p.pos),
c{next} AS MATERIALIZED (
  SELECT c.j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT j, list(t::BIGINT ORDER BY pos) AS x FROM m{i} GROUP BY j) m USING (j))"""
    steps = ",\n".join(x for i in range(rounds) for x in (nearest.format(i=i), moved.format(i=i, next=i + 1, dims=dims)))
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: abs(64 * e::DOUBLE) >= {LIMIT})) = 0),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), x) - 1)::INT AS j, x FROM v QUALIFY j < {k}),
{steps},
{nearest.format(i=rounds)}
SELECT v.vec_id, a.j AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.j)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (n) JOIN c{rounds} c USING (j)
"""


ORACLE = _oracle()

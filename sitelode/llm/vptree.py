"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are dealt into shards of about ``shard_rows`` by a hash of their id and
content. Each shard's tree is built once, and the queries stream through it in
blocks of ``block_rows``, so neither side is ever whole in one place. A query
first searches one shard, its own; the k-th distance found there is a bound that
it takes along to all others, so most of their subtrees are left out at once. A
subtree is left out if the triangle inequality keeps it further away than the
k-th distance so far divided by ``factor``: factor 1 is exact, larger ones
search less. Each shard returns at most k candidates a query; the nearest of all
shards are kept.

Distances are computed on the original vectors in double precision, ties go to
the smaller id. Vectors that are null, zero or hold null or non-finite values
take no part, nor do rows without an id or with another length than the query.
Rows that repeat an id are candidates each, but none is a candidate for a query
of its own id; of queries that repeat an id the one with the smallest vector
counts. A distance too large for a double is infinite, and no subtree is left out by it. An empty table gives no rows; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelode.llm.common import materialize

_LEAF = 64
#: A split whose smaller side has less than this part of the rows makes no node, so trees are shallow.
_LEAST = 16
#: Stands for no candidate.
_NONE = np.iinfo(np.int64).max
#: What rounding may add to a bound.
_SLACK = 1e-9


@dataclass
class Node:
    rows: np.ndarray
    point: int = -1
    radius: float = 0.0
    inner: Node | None = None
    outer: Node | None = None


def build(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> Node:
    """A node's own rows are a leaf's, or those of its vantage point, which stays in a subtree too."""
    node = Node(rows)
    stack = [node]
    while stack:
        at = stack.pop()
        if len(at.rows) <= _LEAF:
            continue
        point = int(rng.choice(at.rows))
        d = np.sqrt(((x[at.rows] - x[point]) ** 2).sum(axis=1))
        radius = float(np.median(d))
        near = d <= radius
        if near.all():
            near = d < radius
        if min(near.sum(), (~near).sum()) * _LEAST < len(near):
            continue  # nearly all at one distance: a leaf, whatever its size
        at.point, at.radius = point, radius if (d <= radius).sum() == near.sum() else float(d[near].max())
        at.inner, at.outer = Node(at.rows[near]), Node(at.rows[~near])
        at.rows = at.rows[:0]
        stack += [at.inner, at.outer]
    return node


class Search:
    """All queries of a block against one tree."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, bound: np.ndarray, k: int, factor: float):
        self.x, self.ids, self.q, self.q_ids, self.k, self.factor = x, ids, q, q_ids, k, factor
        self.best_d = np.repeat(bound[:, None], k, axis=1)
        self.best_id = np.full((len(q), k), _NONE)
        self.looked = 0

    def leaf(self, rows: np.ndarray, who: np.ndarray) -> None:
        for a in range(0, len(rows), 1024):
            part = rows[a : a + 1024]
            for b in range(0, len(who), 64):
                w = who[b : b + 64]
                d = np.sqrt(((self.q[w][:, None, :] - self.x[part][None, :, :]) ** 2).sum(axis=2))
                own = self.q_ids[w][:, None] == self.ids[part][None, :]
                d[own] = np.inf
                self.looked += d.size
                all_d = np.concatenate([self.best_d[w], d], axis=1)
                all_id = np.concatenate([self.best_id[w], np.where(own, _NONE, self.ids[part])], axis=1)
                order = np.lexsort((all_id, all_d), axis=1)[:, : self.k]
                self.best_d[w] = np.take_along_axis(all_d, order, axis=1)
                self.best_id[w] = np.take_along_axis(all_id, order, axis=1)

    def open(self, who: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The queries for which a subtree at least `bound` away may hold something nearer, or as near with a smaller id."""
        return who[~(bound * self.factor > self.best_d[who, -1] * (1 + _SLACK) + _SLACK)]  # infinite distances leave it open

    def run(self, node: Node, who: np.ndarray) -> None:
        """Each query's own side of a split comes first; the other one waits until the nearest so far are known."""
        stack: list[tuple[Node, np.ndarray, np.ndarray | None]] = [(node, who, None)]
        while stack:
            node, who, bound = stack.pop()
            who = who if bound is None else self.open(who, bound)
            if not len(who):
                continue
            if node.inner is None:
                self.leaf(node.rows, who)
                continue
            d = np.sqrt(((self.q[who] - self.x[node.point]) ** 2).sum(axis=1))
            inside = d <= node.radius
            gap = np.abs(d - node.radius)
            stack += [(node.inner, who[~inside], gap[~inside]), (node.outer, who[inside], gap[inside]), (node.outer, who[~inside], None), (node.inner, who[inside], None)]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
    """The rows of each shard, kind and length that follow each other."""
    key = np.stack([batch.column(c).to_numpy() for c in ("shard", "kind", "dim")], axis=1)
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
        yield tuple(key[i].tolist()), batch.slice(i, j - i)


def _matrix(rows: pa.RecordBatch, dim: int) -> np.ndarray:
    return rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _search(batches: Iterator[pa.RecordBatch], k: int, factor: float, block_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted: of each shard its vectors, then queries, both by their length."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    trees: dict[int, tuple[np.ndarray, np.ndarray, Node]] = {}
    now = None
    for batch in batches:
        for (shard, kind, dim), rows in _runs(batch) if batch.num_rows else ():
            if shard != now:
                held, trees, now = {}, {}, shard
            if kind == 0:
                held.setdefault(dim, []).append((rows.column("id").to_numpy(), _matrix(rows, dim).copy()))
                continue
            if dim not in held:
                continue
            if dim not in trees:
                ids, x = (np.concatenate(p) for p in zip(*held[dim], strict=True))
                order = np.argsort(ids, kind="stable")
                trees[dim] = x[order], ids[order], build(x[order], np.arange(len(ids)), np.random.default_rng(shard))
            x, ids, tree = trees[dim]
            for lo in range(0, rows.num_rows, block_rows):
                part = rows.slice(lo, block_rows)
                q_ids = part.column("id").to_numpy()
                search = Search(x, ids, _matrix(part, dim), q_ids, part.column("bound").to_numpy(), k, factor)
                search.run(tree, np.arange(len(q_ids)))
                i, j = np.nonzero(search.best_id < _NONE)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q_ids[i], search.best_id[i, j], search.best_d[i, j])], ["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, v (array of doubles), dim: the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda a: a != 0)).withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, shard_rows: int = 8000, block_rows: int = 2000) -> DataFrame:
    """query_id, rank, vec_id, score. vectors and queries as usable() returns them."""
    queries = materialize(queries.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "queries")
    shards = max(1, -(-vectors.count() // shard_rows))
    # the row itself is hashed too: copies of one id are dealt out as well
    shard = F.pmod(F.xxhash64(F.lit(1), "id", "v"), F.lit(shards)).cast("int")
    own = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(shards)).cast("int")
    columns = ["shard", F.col("kind").cast("int"), F.col("dim").cast("int"), "id", "v", "bound"]
    left = vectors.select("id", "v", "dim", shard.alias("shard"), F.lit(0).alias("kind"), F.lit(0.0).alias("bound")).select(*columns)

    def search(asked: DataFrame) -> DataFrame:
        rows = left.unionByName(asked.withColumn("kind", F.lit(1)).select(*columns)).repartition("shard").sortWithinPartitions("shard", "kind", "dim")
        return rows.mapInArrow(lambda it: _search(it, k, factor, block_rows), "query_id long, vec_id long, score double")

    near = materialize(search(queries.select("id", "v", "dim", own.alias("shard"), F.lit(float("inf")).alias("bound"))), "own")
    found = near
    if shards > 1:
        bound = near.groupBy(F.col("query_id").alias("id")).agg(F.max("score").alias("bound"), F.count("*").alias("n")).where(F.col("n") == k).select("id", "bound")
        others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda x: x != own)
        asked = queries.join(bound, "id", "left").select("id", "v", "dim", F.coalesce("bound", F.lit(float("inf"))).alias("bound"), F.explode(others).alias("shard"))
        found = near.union(search(asked))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same in DuckDB's SQL, by brute force: ten neighbours of each id divisible by 100.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT DISTINCT ON (vec_id) vec_id, e FROM v WHERE vec_id % 100 = 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.e, v.e) AS score FROM q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INT AS rank, vec_id, score
FROM d QUALIFY rank <= 10
"""

"""Removal of repeated passages by fixed-block anchors.

Each text is cut into non-overlapping reference blocks of (window + 1) // 2 words. A
window of words always holds one whole block of its text, so if it occurs again, the
other occurrence holds the same words at the same offset. Two rounds follow:

1. Probe. Every rolling window of a block's length is looked up among the reference
   blocks. It is a hit if it equals one and occurs more than once.
2. Extend. A hit is extended to all full windows that hold it. Those whose words occur
   more than once are repeats; overlapping ones form the maximal exact repeats.

No pairs of occurrences are made: in both rounds windows meet others of their hash in
a bucket, and each place learns only that it isn't alone. Words are numbered within
chunks of consecutive rows, so a place is a chunk and a number. A task sends each hash
that a part of its texts holds once, however often it occurs there, so passages that
very many documents share are small wherever they meet. Hashes of the first round have
40 bits within a bucket of about two million; what they take for equal by mistake the
second round, which has 128 bits, corrects.

Null and empty texts have no words; texts shorter than a window lose none. Texts are
taken whole, however long (up to 2**30 words). Rows that repeat an id or a text are texts each,
so of copies nothing stays that is a window long. An empty table gives no rows; columns
other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelode.llm.common import materialize

#: Words of a chunk, if its texts are shorter; windows of a bucket.
CHUNK_WORDS, BUCKET_WINDOWS = 2**20, 2**21
#: Distinct words whose hashes a task holds.
MOST_WORDS = 500_000
_FIRST, _AGAIN = np.uint32(1 << 31), np.uint32(1 << 30)
_PLACE = np.uint32((1 << 30) - 1)
_PACKETS = "bucket int, chunk long, keys binary, places binary"
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class _Words(dict):
    """Word to number; the number's hash is in `lanes`."""

    def __init__(self):
        self.hashes: list[bytes] = []
        self.lanes = np.zeros((0, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        self.hashes.append(xxhash.xxh3_128_digest(word))
        self[word] = n = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        """The two hashes of each word."""
        if len(self) > MOST_WORDS:
            self.__init__()
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.lanes) < len(self):
            self.lanes = np.frombuffer(b"".join(self.hashes), np.uint64).reshape(-1, 2)
        return self.lanes[at]


_WORDS = _Words()
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared and so on, modulo 2**64."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        _POWERS[base] = held = np.cumprod(held)
    return held[:n]


def rolling(lane: np.ndarray, size: int, base: int) -> np.ndarray:
    """A hash of each run of `size` words, by prefix sums of a polynomial modulo 2**64, its bits mixed."""
    n = len(lane) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(lane) + 1, np.uint64)
    np.cumsum(lane * _powers(base, len(lane)), out=sums[1:])
    h = (sums[size:] - sums[:n]) * _powers(pow(base, -1, 2**64), n)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):  # the low bits alone would not tell orders apart
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def _planes(places: np.ndarray) -> bytes:
    """Bytes of one weight side by side: the upper ones hardly vary and compress well."""
    return places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _places(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _packets(chunk: int, keys: np.ndarray, width: int, bucket: np.ndarray, place: np.ndarray, first: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The windows of a part of a chunk, by bucket: each distinct key once, with its first place, whether any of its places begins a
    reference block, and whether it occurs again here. Places of keys that do so are known already and go ahead, without keys.

    keys: windows x lanes, of which `width` bytes are sent."""
    order = np.lexsort(keys.T)
    k = keys[order]
    new = np.r_[True, (k[1:] != k[:-1]).any(axis=1)]
    at = np.flatnonzero(new)
    n = np.diff(np.r_[at, len(k)])
    sure = np.sort(place[order][np.repeat(n > 1, n)])
    head = order[at]
    value = place[head] | np.where(np.logical_or.reduceat(first[order], at), _FIRST, np.uint32(0)) | np.where(n > 1, _AGAIN, np.uint32(0))
    by = np.lexsort((place[head], bucket[head]))
    head, value = head[by], value[by]
    raw = np.ascontiguousarray(keys[head]).view(np.uint8).reshape(len(head), -1)[:, :width]
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket[head]) != 0])
    ends = [*cuts[1:].tolist(), len(head)]
    rows = [(int(bucket[head[i]]), raw[i:j].tobytes(), _planes(value[i:j])) for i, j in zip(cuts.tolist(), ends, strict=True)]
    if len(sure):
        rows.append((chunk % buckets, b"", _planes(sure)))
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
        ["bucket", "chunk", "keys", "places"],
    )


def _met(packets: pa.Table, width: int, anchored: bool) -> pa.Table:
    """The places of a bucket whose key has come from more than one part, and if `anchored` from a reference block."""
    keys, chunks, places = (packets.column(c).to_pylist() for c in ("keys", "chunk", "places"))
    out = [(c, p) for c, k, p in zip(chunks, keys, places, strict=True) if not k]
    sent = [i for i, k in enumerate(keys) if k]
    if sent:
        raw = np.frombuffer(b"".join([keys[i] for i in sent]), np.uint8).reshape(-1, width)
        lanes = np.zeros((len(raw), -(-width // 8) * 8), np.uint8)
        lanes[:, :width] = raw
        lanes = lanes.view(np.uint64)
        value = np.concatenate([_places(places[i]) for i in sent])
        order = np.lexsort(lanes.T)
        k = lanes[order]
        at = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
        n = np.diff(np.r_[at, len(k)])
        hit = n > 1
        if anchored:
            hit &= np.logical_or.reduceat((value[order] & _FIRST) > 0, at)
        told = np.zeros(len(value), bool)
        told[order] = np.repeat(hit, n)
        told &= (value & _AGAIN) == 0
        for i, lo, hi in zip(sent, *_bounds([len(keys[i]) // width for i in sent]), strict=True):
            if told[lo:hi].any():
                out.append((chunks[i], _planes(value[lo:hi][told[lo:hi]] & _PLACE)))
    return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "places": pa.array([p for _, p in out], pa.binary())})


def _bounds(sizes: list[int]) -> tuple[list[int], list[int]]:
    ends = np.cumsum([0, *sizes]).tolist()
    return ends[:-1], ends[1:]


def _split(texts: list[bytes | None]) -> list[list[bytes]]:
    return [(t or b"").split() for t in texts]  # bytes.split() splits at exactly the six ASCII white-space characters


def _dealt(batches: Iterator[pa.RecordBatch], chunk_words: int) -> Iterator[pa.RecordBatch]:
    """Rows with their chunk, and the number of their first word in it."""
    from pyspark import TaskContext

    chunk, at = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        chunks, starts, sizes = [], [], []
        for text in b.column(1):
            n = len((text.as_py() or b"").split())
            if at and at + n > chunk_words:
                chunk, at = chunk + 1, 0
            chunks.append(chunk)
            starts.append(at)
            sizes.append(n)
            at += n
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), b.column(0), b.column(1)], ["chunk", "start", "n_words", "doc_id", "text"])


def _begins(starts: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: where windows of `size` words begin, their place in the chunk, their place in the text."""
    n = np.maximum(sizes - size + 1, 0)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return within + np.repeat(np.cumsum(sizes) - sizes, n), (within + np.repeat(starts, n)).astype(np.uint32), within


def _probes(batches: Iterator[pa.RecordBatch], block: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        chunks = b.column(0).to_numpy()
        cuts = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1]]).tolist() if len(chunks) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(chunks)], strict=False):
            words = _split(b.column(2).slice(lo, hi - lo).to_pylist())
            sizes = np.array([len(w) for w in words], np.int64)
            at, place, within = _begins(b.column(1).slice(lo, hi - lo).to_numpy(), sizes, block)
            if len(at):
                h = rolling(_WORDS.of([w for t in words for w in t])[:, 0], block, _BASES[0])[at]
                bucket = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
                yield from _packets(int(chunks[lo]), (h & np.uint64(2**40 - 1))[:, None], 5, bucket, place, within % block == 0, buckets)


def _hits(found: pa.Table) -> np.ndarray:
    return np.unique(np.concatenate([_places(p) for p in found.column("places").to_pylist()])).astype(np.int64)


def _extended(docs: pa.Table, found: pa.Table, window: int, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Full windows around the hits of a chunk."""
    if not docs.num_rows or not found.num_rows:
        return
    hits = _hits(found)
    order = np.argsort(docs.column("start").to_numpy(), kind="stable")
    starts, sizes = docs.column("start").to_numpy()[order], docs.column("n_words").to_numpy()[order]
    some = (np.searchsorted(hits, starts + sizes) > np.searchsorted(hits, starts)) & (sizes >= window)
    if not some.any():
        return
    words = _split(docs.column("text").take(pa.array(order[some])).to_pylist())
    at, place, within = _begins(starts[some], sizes[some], window)
    reach = np.searchsorted(hits, place.astype(np.int64) + (window - block), side="right") > np.searchsorted(hits, place.astype(np.int64))
    at, place, within = at[reach], place[reach], within[reach]
    if len(at):
        lanes = _WORDS.of([w for t in words for w in t])
        keys = np.stack([rolling(np.ascontiguousarray(lanes[:, i]), window, _BASES[i])[at] for i in (0, 1)], axis=1)
        bucket = ((keys[:, 1] >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
        yield from _packets(docs.column("chunk")[0].as_py(), keys, 16, bucket, place, within >= 0, buckets)


def _kept(docs: pa.Table, found: pa.Table, window: int) -> pa.Table:
    """What is left of the texts of a chunk."""
    hits = _hits(found) if found.num_rows else np.zeros(0, np.int64)
    starts = docs.column("start").to_numpy()
    n_words, removed, digest = [], [], []
    for start, words in zip(starts.tolist(), _split(docs.column("text").to_pylist()), strict=True):
        own = hits[slice(*np.searchsorted(hits, (start, start + len(words))))] - start
        marks = np.zeros(len(words) + 1, np.int64)
        np.add.at(marks, own, 1)
        np.add.at(marks, np.minimum(own + window, len(words)), -1)
        gone = np.cumsum(marks[:-1]) > 0
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if len(own) else words
        n_words.append(len(words))
        removed.append(len(words) - len(kept))
        digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
    return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})


def repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = CHUNK_WORDS) -> tuple[DataFrame, DataFrame]:
    """chunk, start, n_words, doc_id, text: the texts; chunk, places: where windows begin whose words also begin elsewhere."""
    spark, block = docs.sparkSession, (window + 1) // 2
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    texts = materialize(texts.mapInArrow(lambda it: _dealt(it, chunk_words), f"chunk long, start long, n_words long, doc_id {kind}, text binary"), "texts")
    words = texts.agg(F.sum("n_words").alias("n")).first().n or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), words // BUCKET_WINDOWS)

    probes = texts.select("chunk", "start", "text").mapInArrow(lambda it: _probes(it, block, buckets), _PACKETS)
    hits = probes.groupBy("bucket").applyInArrow(lambda t: _met(t, 5, True), "chunk long, places binary")
    hits = materialize(hits, "hits")

    def extended(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = list(_extended(left, right, window, block, buckets))
        return pa.Table.from_batches(parts) if parts else pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "places": pa.array([], pa.binary())})

    full = texts.select("chunk", "start", "n_words", "text").groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(extended, _PACKETS)
    found = full.groupBy("bucket").applyInArrow(lambda t: _met(t, 16, False), "chunk long, places binary")
    return texts, materialize(found, "repeats")


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per input row. Words in a window that begins anywhere else too are removed."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts, found = repeats(docs, window, id_col, text_col, chunk_words)
    both = texts.select("chunk", "start", "doc_id", "text").groupBy("chunk").cogroup(found.groupBy("chunk"))
    return both.applyInArrow(lambda left, right: _kept(left, right, window), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


#: The same in DuckDB's SQL: every window of 35 words as a text.
ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (SELECT r, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i : i + 34], ' ') END AS run FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
again AS (SELECT run FROM p WHERE run IS NOT NULL GROUP BY run HAVING count(*) > 1),
m AS (SELECT p.r, p.i, p.word, coalesce(max((a.run IS NOT NULL)::INT) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
      FROM p LEFT JOIN again a ON p.run = a.run),
k AS (SELECT r, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM m GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

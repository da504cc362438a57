"""Katz back-off scoring of documents.

The model is a bigram model over all training words. Unigram and bigram counts
are Good-Turing discounted; what the discount frees goes to unseen events
through back-off weights that make every distribution sum to one exactly.

* order 1: P1(w) = d(c) c / N for a word with training count c; the mass left
  is that of the unknown word, which counts as one type.
* order 2: P(k|h) = d(c) c(h,k) / c(h) if the pair was seen, else a(h) P1(k),
  with a(h) the free mass of h divided by the order-1 mass of what h has not
  been followed by. A history that was never seen backs off at no cost.

Every token is looked up in that order: the pair, then the weight of its
history and the word. The tables are ``words`` (a row a word, partitioned by
its key) and the bigrams, bucketed by their history: a row holds all pairs of
the histories of one bucket as packed columns, and a history with more than
``split_at`` tokens is dealt out over the buckets by pair. Tokens are sent to
their pair's bucket and each document's sums come back, so neither side is ever
whole in one place, and the number of buckets follows that of the tokens.

Lists of the most frequent words (``hot_words`` at most) and pairs
(``hot_pairs`` at most) go to every task. They are shortcuts that change no
score: what is in them is looked up where the text is read.

A word is known by 63 bits of a hash of its bytes, A-Z lowered: with ten million
different words the chance that any two are taken for one is about 5e-6. Both lists and what is
split follow training counts, so a held-out fold is meant to be one by a hash: a
pair that fills held-out texts and is in no training text stays in one bucket.

A null text counts as an empty one: just the end. Texts are read whole, however
long. Rows that repeat an id are scored each. With no training text at all, all
words are unknown. Columns other than the id and the text are ignored; empty
tables give an empty result.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.llm.common import materialize, new_folder, remainder

#: The number of a text's end, which is also the history of its first word. Frequent words have the numbers after it, all
#: others negative keys.
END = 0
SIGN = 1 << 63
#: Tokens that a task holds at once, and tokens a bucket.
CHUNK, BUCKET = 500_000, 200_000
#: Bytes of text that are hashed at a stroke.
STROKE = 1 << 20


def good_turing(of_counts: dict[int, int], k: int = 5) -> list[float]:
    """Discount factors for counts 0 to k; of_counts[r]: how many events have count r. Above k nothing is discounted.

    Katz's formula needs regular counts of counts. Where it leaves (0, 1), half a count is taken off instead."""
    n = [of_counts.get(r, 0) for r in range(k + 2)]
    out = [1.0]
    cut = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    return c * np.where(c < len(d), np.array(d)[np.minimum(c, len(d) - 1)], 1.0)


class WordKeys:
    """Keys of the words of many texts at a stroke: a polynomial in random values of the bytes, modulo 2^64 and mixed.

    A word's value is a difference of running sums, times the inverse power of its place."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        rng = np.random.default_rng(42)
        self.value = rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
        self.value[65:91] = self.value[97:123]
        self.in_word = np.ones(256, bool)
        self.in_word[[32, *range(9, 14)]] = False
        self._grow(STROKE)

    def _grow(self, n: int) -> None:
        powers = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])
        self.power, self.inverse = powers(self.BASE), powers(pow(self.BASE, -1, 1 << 64))

    def _segments(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """First and end of what is hashed at a stroke, and the ends of texts in it; a long text is cut at white space."""
        at = 0
        while at < len(data):
            stop = int(ends[max(np.searchsorted(ends, at + STROKE, "right") - 1, 0)])
            if stop <= at:  # no text ends within a stroke
                stop, size = int(ends[np.searchsorted(ends, at, "right")]), STROKE
                while at + size < stop:
                    blank = np.flatnonzero(~self.in_word[data[at : at + size]])
                    if len(blank):
                        stop = at + int(blank[-1]) + 1
                        break
                    size *= 2
            yield at, stop, ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, stop, "right")]
            at = stop

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The keys of all words in order, and how many each text has. Keys are negative."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        ends = offsets[1:] - offsets[0]
        keys, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, hi, stops in self._segments(data, ends):
            part = data[lo:hi]
            if len(part) >= len(self.power):
                self._grow(len(part))
            inside = self.in_word[part]
            begins, closes = inside.copy(), inside.copy()
            begins[1:] &= ~inside[:-1]
            closes[:-1] &= ~inside[1:]
            cut = stops - lo
            begins[cut[cut < len(part)]] = inside[cut[cut < len(part)]]
            closes[cut - 1] = inside[cut - 1]
            begin, close = np.flatnonzero(begins), np.flatnonzero(closes) + 1
            sums = np.r_[np.uint64(0), np.cumsum(self.value[part] * self.power[: len(part)])]
            keys.append(_mixed((sums[close] - sums[begin]) * self.inverse[begin]))
            starts.append(begin + lo)
        before = np.searchsorted(np.concatenate(starts), np.r_[0, ends])
        return (np.concatenate(keys) | np.uint64(SIGN)).view(np.int64), np.diff(before)


class Numbers:
    """The numbers of frequent words. Most are found in a table of slots by the key's bits, the others by bisection."""

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys)
        self.sorted = keys[self.order]
        self.keys = np.r_[np.int64(0), keys]
        self.bits = np.uint64(64 - 21)
        self.slot = np.zeros(1 << 21, np.int32)
        self.slot[self._slots(keys)] = np.arange(1, len(keys) + 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return keys.view(np.uint64) << np.uint64(1) >> self.bits

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of those that have one, else the keys."""
        at = self.slot[self._slots(keys)]
        out = np.where(self.keys[at] == keys, at, keys)
        left = np.flatnonzero((out < 0) & (at > 0))
        if len(left):
            wanted = keys[left]
            place = np.minimum(np.searchsorted(self.sorted, wanted), len(self.sorted) - 1)
            out[left] = np.where(self.sorted[place] == wanted, self.order[place] + END + 1, wanted)
        return out


@dataclass
class Unigrams:
    """Order 1: totals and, by number, the frequent words. split: histories that are dealt out by pair, with their size and weight."""

    keys: np.ndarray
    count: np.ndarray
    p: np.ndarray
    unknown: float
    size: int
    discount: list[float]
    split: np.ndarray
    log_size: np.ndarray = field(default_factory=lambda: np.zeros(0))
    log_a: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def is_split(self, h: np.ndarray) -> np.ndarray:
        return (h >= 0) & self.split[np.maximum(h, 0)]


def pack(a: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes: small numbers take little room."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).reshape(-1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """An even spread of 64-bit values."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def pair_order(h: np.ndarray, k: np.ndarray, split: np.ndarray) -> np.ndarray:
    """What pairs are sorted by: the upper half, which decides the bucket, comes from the history or, if it is split, the pair."""
    of_h = _mixed(h.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    of_pair = _mixed(of_h + k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(split, of_pair, of_h) & np.uint64(0xFFFFFFFF00000000) | of_pair >> np.uint64(32)


def _dealt(q: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Bucket, first and end of each run of sorted values that share a bucket."""
    of = (q >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    yield from zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(q)], strict=True)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new row begins in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _read(batches: Iterator[pa.RecordBatch], numbers: Numbers) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.RecordBatch]]]:
    """Codes of many texts end to end, with an end before the first and after each; their numbers of tokens; their rows."""
    key = WordKeys()

    def laid_out() -> tuple[np.ndarray, np.ndarray, list[pa.RecordBatch]]:
        n = np.concatenate(counts)
        x = np.full(n.sum() + len(n) + 1, END, np.int64)
        x[np.arange(1, n.sum() + 1) + np.repeat(np.arange(len(n)), n)] = np.concatenate(parts)
        return x, n + 1, rows

    parts, counts, rows, size = [], [], [], 0
    for whole in batches:
        for lo in range(0, whole.num_rows, 200):
            b = whole.slice(lo, 200)
            keys, n = key(b.column("text"))
            parts.append(numbers(keys))
            counts.append(n)
            rows.append(b)
            size += len(keys)
            if size > CHUNK:
                yield laid_out()
                parts, counts, rows, size = [], [], [], 0
    if rows:
        yield laid_out()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


# order 1


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held, size = WordKeys(), [], 0

    def out() -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held))
        at = _runs(keys)
        return pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(np.diff(np.r_[at, len(keys)]))], ["key", "c"])

    for b in batches:
        for lo in range(0, b.num_rows, 2000):
            held.append(key(b.column("text").slice(lo, 2000))[0])
            size += len(held[-1])
            if size > 4 * CHUNK:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _histogram(counts: DataFrame) -> dict[int, int]:
    """How many events have each count: a row for each different count, of which there are fewer than the square root of twice the sum."""
    return {r.c: r.n for r in counts.groupBy("c").agg(F.sum("n").alias("n")).collect()}


def _threshold(histogram: dict[int, int], most: int) -> int:
    """The smallest count that at most `most` events reach."""
    total, least = 0, max(histogram, default=0) + 1
    for c in sorted(histogram, reverse=True):
        total += histogram[c]
        if total > most:
            break
        least = c
    return least


# order 2

_PAIRS = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("k", pa.binary()), ("c", pa.binary())])


def _count_pairs(batches: Iterator[pa.RecordBatch], one: Unigrams, buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of pairs of many texts, a row per bucket."""
    for x, _, _ in _read(batches, Numbers(one.keys)):
        h, k = x[:-1], x[1:]
        q = pair_order(h, k, one.is_split(h))
        order = np.argsort(q)
        h, k, q = h[order], k[order], q[order]
        at = _runs(h, k)
        c = np.diff(np.r_[at, len(h)])
        h, k, q = h[at], k[at], q[at]
        yield _batch([(b, pack(np.diff(h[i:j], prepend=0)), pack(k[i:j]), pack(c[i:j])) for b, i, j in _dealt(q, buckets)], _PAIRS)


_TABLE = "bucket int, h binary, n binary, k binary, c binary, values array<long>, freqs array<long>, rare array<long>, split array<struct<h:long,c:long,low:array<long>,mass:double>>, split_rare array<struct<h:long,k:long>>"


def _merge(batches: Iterator[pa.RecordBatch], one: Unigrams, most: int, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row per bucket: its histories, how many pairs each has, the pairs' words and counts in order; and how many pairs have
    each count, what other words there are but frequent ones, and what is known here of histories that are split."""
    for b in batches:
        for bucket, parts in zip(b.column("bucket").to_pylist(), b.column("parts"), strict=True):
            parts = parts.as_py()
            h, k, c = np.concatenate([np.cumsum(unpack(p["h"])) for p in parts]), *(np.concatenate([unpack(p[f]) for p in parts]) for f in "kc")
            order = np.lexsort((k, h))
            h, k, c = h[order], k[order], c[order]
            at = _runs(h, k)
            h, k, c = h[at], k[at], np.add.reduceat(c, at)
            first = _runs(h)
            own, n = h[first], np.diff(np.r_[first, len(h)])
            values, freqs = np.unique(c, return_counts=True)
            split, mass = one.is_split(own), np.add.reduceat(np.where(k >= 0, one.p[np.maximum(k, 0)], 0.0), first)
            parts_of = [{"h": own[i], "c": c[s : s + n[i]].sum(), "low": [int((c[s : s + n[i]] == r).sum()) for r in range(1, most + 1)], "mass": mass[i]} for i, s in zip(np.flatnonzero(split), first[split], strict=True)]
            in_split = np.repeat(split, n) & (k < 0)
            rare_of = [{"h": x, "k": y} for x, y in zip(h[in_split].tolist(), k[in_split].tolist(), strict=True)]
            row = {"bucket": [bucket], "h": [pack(np.diff(own, prepend=0))], "n": [pack(n)], "k": [pack(k)], "c": [pack(c)], "values": [values], "freqs": [freqs], "rare": [np.unique(k[k < 0])], "split": [parts_of], "split_rare": [rare_of]}
            yield pa.RecordBatch.from_pydict(row, out)


def _arrow_types(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


@dataclass
class Bucket:
    """The histories of a bucket, ascending, and their pairs, those of a history in the order of their words."""

    own: np.ndarray
    first: np.ndarray
    of: np.ndarray
    k: np.ndarray
    c: np.ndarray
    value: np.ndarray
    log_size: np.ndarray
    kept: np.ndarray
    size: np.ndarray

    @classmethod
    def of_row(cls, row: dict, one: Unigrams, d2: list[float]) -> Bucket:
        empty = np.zeros(0, np.int64)
        own, n, k, c = (empty if row[f] is None else unpack(row[f]) for f in "hnkc")
        own, first = np.cumsum(own), np.cumsum(n) - n
        value = discounted(c, d2)
        kept, size = (np.add.reduceat(v, first) if len(first) else v for v in (value, c))
        size = np.where(kept < size * (1 - 1e-12), size, size + 1)
        log_size, split = np.log10(size), one.is_split(own)
        log_size[split] = one.log_size[own[split]]
        return cls(own, first, np.repeat(np.arange(len(own)), n), k, c, value, log_size, kept, size)

    def log_p(self) -> np.ndarray:
        return np.log10(self.value) - self.log_size[self.of]


def _frequent(batches: Iterator[pa.RecordBatch], one: Unigrams, d2: list[float], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs of frequent words that have at least a count, with their log probability."""
    for b in batches:
        for row in b.to_pylist():
            of = Bucket.of_row(row, one, d2)
            h = of.own[of.of]
            at = np.flatnonzero((of.c >= least) & (of.k >= 0) & (h >= 0))
            yield pa.RecordBatch.from_pydict({"h": h[at].astype(np.int32), "k": of.k[at].astype(np.int32), "s": of.log_p()[at]})


# scores


@dataclass
class Pairs:
    """The most frequent pairs, sorted by their order."""

    q: np.ndarray
    h: np.ndarray
    k: np.ndarray
    s: np.ndarray

    def find(self, q: np.ndarray, h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of many pairs is, and whether it is there."""
        if not len(self.q):
            return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
        at = np.minimum(np.searchsorted(self.q, q), len(self.q) - 1)
        return at, (self.h[at] == h) & (self.k[at] == k)


def _sent(doc_id: pa.DataType) -> pa.Schema:
    return pa.schema(
        [("bucket", pa.int32()), ("block", pa.int64()), ("h", pa.binary()), ("k", pa.binary()), ("row", pa.binary()), ("doc_id", pa.list_(doc_id)), ("held_out", pa.list_(pa.bool_()))]
        + [("n_tokens", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())), ("base_score", pa.list_(pa.float64())), ("score", pa.list_(pa.float64()))]
    )


def _send(batches: Iterator[pa.RecordBatch], one: Unigrams, hot: Pairs, buckets: int, log_base0: float) -> Iterator[pa.RecordBatch]:
    """Texts come in blocks. Of each, a row of what is known of its texts by frequent words and pairs alone (its bucket is
    negative), and a row per bucket of all other tokens."""
    log_c, known = np.log10(one.count + 1.0), one.count > 0
    for i, (x, lengths, rows) in enumerate(_read(batches, Numbers(one.keys))):
        block, n = TaskContext.get().partitionId() << 32 | i, len(lengths)
        h, k, row = x[:-1], x[1:], np.repeat(np.arange(n), lengths)
        numbered = k >= 0
        base = np.bincount(row[numbered], log_c[k[numbered]], n) - log_base0 * lengths
        n_known = np.bincount(row[numbered], known[k[numbered]], n)
        q = pair_order(h, k, one.is_split(h))
        order = np.argsort(q)
        h, k, q, row = h[order], k[order], q[order], row[order]
        at, found = hot.find(q, h, k)
        score = np.bincount(row[found], hot.s[at[found]], n)
        rest = ~found
        h, k, q, row = h[rest], k[rest], q[rest], row[rest]
        ids = pa.chunked_array([b.column("doc_id") for b in rows])
        schema = _sent(ids.type)
        held = pa.chunked_array([b.column("held_out") for b in rows])
        yield _batch([(-1 - block % (1 << 30), block, None, None, None, ids.to_pylist(), held.to_pylist(), lengths, n_known.astype(np.int64), base, score)], schema)
        if len(q):
            yield _batch([(b, block, pack(np.diff(h[i:j], prepend=0)), pack(k[i:j]), pack(row[i:j]), *[None] * 6) for b, i, j in _dealt(q, buckets)], schema)


def _look_up(of: Bucket, log_a: np.ndarray, count: np.ndarray, one: Unigrams, h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token, the log probability, but for what P1 adds to an unseen pair of a word without a number; the count of its
    word if that has no number and the pair was seen, else 0; and whether P1 is still to be added."""
    split, numbered = one.is_split(h), k >= 0
    s, c, seen = np.zeros(len(h)), np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    s[split] = one.log_a[h[split]]
    if len(of.own):
        at = np.minimum(np.searchsorted(of.own, h), len(of.own) - 1)
        there = of.own[at] == h
        s[there] = log_a[at[there]]
        names = np.unique(of.k)
        width = len(names)
        word = np.minimum(np.searchsorted(names, k), width - 1)
        pairs = of.of * width + np.searchsorted(names, of.k)
        wanted = at * width + word
        pair = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
        seen = there & (names[word] == k) & (pairs[pair] == wanted)
        s[seen] = of.log_p()[pair[seen]]
        c[seen] = count[pair[seen]]
    add = ~seen & numbered
    s[add] += np.log10(one.p[k[add]])
    c[numbered] = 0
    return s, c, ~seen & ~numbered


def _answer(batches: Iterator[pa.RecordBatch], one: Unigrams, d2: list[float], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Looks up the tokens that came to each bucket and sums them up by text: a row per block of texts."""
    sums: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
    size = 0

    def done() -> pa.RecordBatch:
        rows = []
        for block, parts in sums.items():
            row, s, c, open_row, open_k = (np.concatenate(p) for p in zip(*parts, strict=True))
            own, at = np.unique(row, return_inverse=True)
            total = [np.bincount(at, v, len(own)) for v in (s, np.log10(c + 1.0), c > 0)]
            rows.append((block, pack(own), total[0].tobytes(), total[1].tobytes(), pack(total[2]), open_row, open_k, *[None] * 6))
        return _batch(rows, out)

    for b in batches:
        for row in b.to_pylist():
            if row["bucket"] < 0:
                yield _batch([(p["block"], *[None] * 6, *(p[f] for f in out.names[7:])) for p in row["parts"]], out)
                continue
            of = Bucket.of_row(row, one, d2)
            count = np.zeros(len(of.k), np.int64)
            p1 = one.p[np.maximum(of.k, 0)]
            if len(rare := row["counts"] or []):
                key, c = np.array([(r["key"], r["c"]) for r in rare], np.int64).T
                order = np.argsort(key)
                at = np.flatnonzero(of.k < 0)
                count[at] = c[order][np.searchsorted(key[order], of.k[at])]
                p1[at] = discounted(count[at], one.discount) / one.size
            mass = np.add.reduceat(p1, of.first) if len(of.first) else p1
            log_a, split = np.log10((1 - of.kept / of.size) / np.maximum(1 - mass, 1e-12)), one.is_split(of.own)
            log_a[split] = one.log_a[of.own[split]]
            h, k = np.concatenate([np.cumsum(unpack(p["h"])) for p in row["parts"]]), np.concatenate([unpack(p["k"]) for p in row["parts"]])
            s, c, open_ = _look_up(of, log_a, count, one, h, k)
            end = 0
            for p in row["parts"]:
                rows = unpack(p["row"])
                i, end = end, end + len(rows)
                still = open_[i:end]
                sums[p["block"]].append((rows.astype(np.int32), s[i:end].copy(), c[i:end].copy(), rows[still], k[i:end][still]))
            size += len(h)
            if size > 4 * CHUNK:
                yield done()
                sums.clear()
                size = 0
    if sums:
        yield done()


def _documents(batches: Iterator[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row per text of each block."""
    for b in batches:
        for block, parts in zip(b.column("block").to_pylist(), b.column("parts").to_pylist(), strict=True):
            texts = next(p for p in parts if p["doc_id"] is not None)
            n = len(texts["doc_id"])
            s, base, known = np.array(texts["score"]), np.array(texts["base_score"]), np.array(texts["n_known"])
            for p in parts:
                if p["row"] is not None:
                    at = unpack(p["row"])
                    s[at] += np.frombuffer(p["s"])
                    base[at] += np.frombuffer(p["b"])
                    known[at] += unpack(p["known"])
            columns = [np.full(n, block), np.arange(n), texts["doc_id"], texts["held_out"], texts["n_tokens"], known, base, s]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out.types, strict=True)], schema=out)


def katz_scores(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", hot_words: int = 250_000, hot_pairs: int = 1_000_000, split_at: int = 200_000, k: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability): one row per input row."""
    spark = docs.sparkSession
    fold = F.lit(False) if held_out is None else held_out
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), fold.alias("held_out"))
    train = texts.where(~F.col("held_out")).select("text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # order 1
    counts = materialize(train.mapInArrow(_count_words, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "words")
    ends = train.count()
    by_c = _histogram(counts.withColumn("n", F.lit(1)))
    total, types = sum(c * n for c, n in by_c.items()) + ends, sum(by_c.values()) + bool(ends)
    d1 = good_turing({c: by_c.get(c, 0) + (c == ends) for c in range(1, k + 2)}, k)
    seen_mass = sum(n * float(discounted(np.array(c), d1)) for c, n in [*by_c.items(), (ends, 1)])
    size1 = max(total, 1) if seen_mass < total * (1 - 1e-12) else total + 1  # what is left is never nothing
    unknown = 1 - seen_mass / size1
    top = counts.where(F.col("c") >= _threshold(by_c, hot_words)).toArrow()  # bounded by the threshold
    keys, c = top["key"].to_numpy(), top["c"].to_numpy()
    order = np.lexsort((keys, -c))
    c = np.r_[ends, c[order]].astype(np.int64)
    p1 = discounted(c, d1) / size1
    p1[END] = p1[END] or unknown
    one = Unigrams(keys[order], c, p1, unknown, size1, d1, c > split_at)
    log_unknown = float(np.log10(unknown))

    # order 2
    buckets, table_types = total // BUCKET + 1, _arrow_types(_TABLE)
    counted = train.mapInArrow(lambda it: _count_pairs(it, one, buckets), "bucket int, h binary, k binary, c binary").repartition("bucket")
    merged = counted.groupBy("bucket").agg(F.collect_list(F.struct("h", "k", "c")).alias("parts")).mapInArrow(lambda it: _merge(it, one, k, table_types), _TABLE)
    name = f"sitelode_katz_{uuid.uuid4().hex}"
    merged.repartition(partitions, "bucket").write.option("path", new_folder(spark, "katz")).bucketBy(partitions, "bucket").saveAsTable(name)
    pairs = spark.table(name)
    by_c2 = _histogram(pairs.select(F.inline(F.arrays_zip(F.col("values").alias("c"), F.col("freqs").alias("n")))))
    d2 = good_turing(by_c2, k)
    rare_counts = pairs.select("bucket", F.explode("rare").alias("key")).join(counts, "key").groupBy("bucket").agg(F.collect_list(F.struct("key", "c")).alias("counts"))
    # histories that are split: bounded, as they are frequent words
    of_split = pairs.select(F.inline("split")).groupBy("h").agg(F.sum("c").alias("c"), F.array(*[F.sum(F.col("low")[r]) for r in range(k)]).alias("low"), F.sum("mass").alias("mass")).collect()
    factor = F.element_at(F.array(*map(F.lit, d1)), F.least(F.col("c") + 1, F.lit(len(d1))).cast("int"))
    value = F.when(F.col("c") < len(d1), factor * F.col("c")).otherwise(F.col("c").cast("double")) / size1
    rare_mass = {r.h: r.mass for r in pairs.select(F.inline("split_rare")).withColumnRenamed("k", "key").join(counts, "key").groupBy("h").agg(F.sum(value).alias("mass")).collect()} if of_split else {}
    one.log_size, one.log_a = np.zeros(len(c)), np.zeros(len(c))
    for r in of_split:
        kept = r.c - sum(n * i * (1 - d2[i]) for i, n in enumerate(r.low, 1))
        size = r.c if kept < r.c * (1 - 1e-12) else r.c + 1
        one.log_size[r.h] = np.log10(size)
        one.log_a[r.h] = np.log10((1 - kept / size) / max(1 - r.mass - rare_mass.get(r.h, 0.0), 1e-12))
    least = _threshold(by_c2, hot_pairs)
    top2 = pairs.select("h", "n", "k", "c").mapInArrow(lambda it: _frequent(it, one, d2, least), "h int, k int, s double").toArrow()  # bounded by the threshold
    h2, k2, s2 = (top2[f].to_numpy() for f in "hks")
    q2 = pair_order(h2.astype(np.int64), k2.astype(np.int64), one.is_split(h2))
    order = np.argsort(q2)
    hot = Pairs(q2[order], h2[order], k2[order], s2[order])

    # scores
    kind = docs.schema[id_col].dataType.simpleString()
    per_text = f"doc_id array<{kind}>, held_out array<boolean>, n_tokens array<long>, n_known array<long>, base_score array<double>, score array<double>"
    log_base0 = float(np.log10(total + types + 1))
    sent = texts.mapInArrow(lambda it: _send(it, one, hot, buckets, log_base0), f"bucket int, block long, h binary, k binary, row binary, {per_text}")
    sent = sent.repartition(partitions, "bucket").groupBy("bucket").agg(F.collect_list(F.struct(*sent.columns[1:])).alias("parts"))
    asked = sent.join(pairs.select("bucket", "h", "n", "k", "c"), "bucket", "left").join(rare_counts, "bucket", "left")
    answers = f"block long, row binary, s binary, b binary, known binary, open_row array<long>, open_key array<long>, {per_text}"
    types_out = _arrow_types(answers)
    sums = materialize(asked.mapInArrow(lambda it: _answer(it, one, d2, types_out), answers), "sums")
    kept = ["row", "s", "b", "known", *sums.columns[7:]]
    rows = f"block long, row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    row_types = _arrow_types(rows)
    per_doc = sums.groupBy("block").agg(F.collect_list(F.struct(*kept)).alias("parts")).mapInArrow(lambda it: _documents(it, row_types), rows)
    # unseen pairs of words that are in no list
    opened = sums.select("block", F.inline(F.arrays_zip(F.col("open_row").alias("row"), F.col("open_key").alias("key")))).join(counts, "key", "left")
    opened = opened.groupBy("block", "row").agg(
        F.sum(F.coalesce(F.log10(value), F.lit(log_unknown))).alias("more_s"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("more_b"), F.count("c").alias("more_known")
    )
    plus = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    return per_doc.join(opened, ["block", "row"], "left").select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "more_known"), F.lit(total).cast("long").alias("train_tokens"), plus("base_score", "more_b"), plus("score", "more_s")
    )


def fold(modulus: int = 7, held: int = 2, id_col: str = "doc_id") -> Column:
    return remainder(id_col, modulus) == held

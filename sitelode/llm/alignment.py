"""Alignment of two tokenizers: which tokens of one overlap which of the other.

A text with a space before it is cut by both. Ends of tokens are running sums of
their lengths in bytes; where both have an end, a group ends. Two tokens are
linked if their bytes overlap: for each token of A the first and last such token
of B are searched for, and the runs in between are expanded by repetition.

Where a blank stands between two characters that are no white space, both
tokenizers begin a token: A's pre-tokens and B's pieces never cross such a place
(for B this is checked against its pieces). So texts are aligned segment by segment
from one such blank to the next, each distinct segment of a task once, many at a
time as one stream of bytes; what a document needs is put together from there.

How often a pair of ids is linked is counted in two shuffles: by pair and a salt
first, by pair alone then, after each task has summed its own. Counts return to
documents by a join on the pair, but for the ``frequent`` most frequent pairs (of
24 bytes each, so their table has a fixed bound), which are looked up where a
document is read. A's ids times B's ids bound the pairs, whatever the input.

Null and empty texts, texts that are no UTF-8 and texts that either tokenizer
doesn't give back byte by byte have no tokens. Texts are cut whole, however long.
Rows that repeat an id are documents each; an empty table gives no rows; columns
other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelode.llm.common import materialize

#: Distinct segments that a task holds at once, and their characters.
MOST_SEGMENTS, MOST_CHARS = 200_000, 8_000_000
#: Segments that are cut into tokens as one text.
TOGETHER = 10_000
#: Links of documents that are put together at a time.
MOST_LINKS = 2_000_000
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _expanded(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, n of them, for each."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


class Tokenizers:
    """Both tokenizers, the bytes of each of their tokens, and the segments that were aligned lately."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are Spark's
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError(f"{path_b} has pieces that cross blanks between words")
        self.len_a, self.len_b = (np.array([len(t) for t in v], np.int64) for v in (self.bytes_a, self.bytes_b))
        #: An id with what follows it in the digest: the next one of its side, the other side, the next group.
        self.written = [f"{i}{c}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for c in ",|;"]
        self.clear()

    def clear(self) -> None:
        """Forgets the segments. Of each: whether it comes back, tokens, groups, links and the digest's text; links in one array."""
        self.known: dict[str, int] = {}
        self.chars = 0
        self.texts: list[str] = []
        self.facts = np.zeros((0, 5), np.int64)  # comes back, n_a, n_b, n_groups, n_links
        self.links = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def make_room(self) -> None:
        """Forgets the segments that were used once, or all but the most used half."""
        if len(self.known) <= MOST_SEGMENTS and self.chars <= MOST_CHARS:
            return
        keep, names = np.flatnonzero(self.uses > 1), list(self.known)
        if len(keep) > MOST_SEGMENTS // 2:
            keep = np.sort(np.argsort(-self.uses, kind="stable")[: MOST_SEGMENTS // 2])
        names, texts, facts = [names[i] for i in keep.tolist()], [self.texts[i] for i in keep.tolist()], self.facts[keep]
        links, start = self.links[_expanded(self.start[keep], facts[:, 4])], np.cumsum(facts[:, 4]) - facts[:, 4]
        self.clear()
        if (chars := sum(map(len, names))) <= MOST_CHARS // 2:
            self.known, self.texts, self.facts, self.links, self.start = {s: i for i, s in enumerate(names)}, texts, facts, links, start
            self.chars, self.uses = chars, np.zeros(len(names), np.int64)

    @staticmethod
    def segments(text: str) -> list[str]:
        """The parts of a text, each without the blank before it."""
        parts = text.split(" ")
        return parts if parts == text.split() else BOUNDARY.split(text)

    def learn(self, segments: list[str]) -> None:
        """Aligns segments that are not yet known."""
        plain = [s for s in segments if s == s.strip()]
        if len(plain) < len(segments):
            self.add(*self.one_by_one([s for s in segments if s != s.strip()]))
        for i in range(0, len(plain), TOGETHER):
            part = plain[i : i + TOGETHER]
            self.add(*(self.together(part) or self.one_by_one(part)))

    def together(self, segments: list[str]) -> tuple | None:
        """Tokens of segments as of one text, if it comes back and both tokenizers have an end where a segment ends."""
        text = " ".join(segments)
        ids_a, ids_b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        whole = (" " + text).encode()
        if not b"".join([self.bytes_a[i] for i in ids_a]) == whole == b"".join([self.bytes_b[i] for i in ids_b]):
            return None
        a, b, last = np.array(ids_a, np.int64), np.array(ids_b, np.int64), np.cumsum(np.array([len(s.encode()) + 1 for s in segments], np.int64))
        ends = [np.cumsum(size[ids]) for size, ids in ((self.len_a, a), (self.len_b, b))]
        at = [np.searchsorted(e, last) for e in ends]
        if any((e[i] != last).any() for e, i in zip(ends, at, strict=True)):
            return None
        return segments, np.ones(len(segments), bool), a, np.diff(at[0] + 1, prepend=0), b, np.diff(at[1] + 1, prepend=0)

    def one_by_one(self, segments: list[str]) -> tuple:
        """Tokens of segments; those that don't come back have none."""
        ids_a = [e.ids for e in self.a.encode_batch([" " + s for s in segments], add_special_tokens=False)]
        ids_b = self.b.encode(segments, num_threads=1)
        whole = [b" " + s.encode() for s in segments]
        ok = np.array([b"".join([self.bytes_a[i] for i in x]) == w == b"".join([self.bytes_b[i] for i in y]) for x, y, w in zip(ids_a, ids_b, whole, strict=True)], bool)
        out = [segments, ok]
        for ids in (ids_a, ids_b):
            ids = [x if good else [] for x, good in zip(ids, ok.tolist(), strict=True)]
            out += [np.array([t for x in ids for t in x], np.int64), np.array([len(x) for x in ids], np.int64)]
        return tuple(out)

    def add(self, segments: list[str], ok: np.ndarray, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> None:
        found = align(a, b, self.len_a, self.len_b)
        last = np.r_[0, found.ends_a][np.cumsum(n_a)]
        groups = np.diff(np.searchsorted(found.cuts, last, side="right"), prepend=0)
        of_link = np.repeat(np.arange(len(segments)), n_a)[found.link_a]
        links = np.bincount(of_link, minlength=len(segments))
        text = self.digest_text(a, b, found)
        at = np.r_[0, np.cumsum(n_a + n_b)].tolist()
        texts = ["".join(text[lo:hi])[:-1] for lo, hi in zip(at, at[1:], strict=False)]
        self.known |= {s: len(self.texts) + i for i, s in enumerate(segments)}
        self.chars += sum(map(len, segments))
        self.texts += texts
        self.start = np.r_[self.start, len(self.links) + np.cumsum(links) - links]
        self.links = np.r_[self.links, a[found.link_a] << 32 | b[found.link_b]]
        self.facts = np.concatenate([self.facts, np.stack([ok, n_a, n_b, groups, links], axis=1).astype(np.int64)])
        self.uses = np.r_[self.uses, np.zeros(len(segments), np.int64)]

    def digest_text(self, a: np.ndarray, b: np.ndarray, found: Alignment) -> list[str]:
        """The tokens of both sides group by group, each with what follows it."""
        before = np.searchsorted(found.group_b, found.group_a, side="left")  # tokens of B in earlier groups
        behind = np.searchsorted(found.group_a, found.group_b, side="right")
        code = np.empty(len(a) + len(b), np.int64)
        end_a, end_b = (np.r_[g[1:] != g[:-1], True] if len(g) else np.zeros(0, bool) for g in (found.group_a, found.group_b))
        code[np.arange(len(a)) + before] = a * 3 + end_a
        code[np.arange(len(b)) + behind] = b * 3 + 2 * end_b
        return [self.written[c] for c in code.tolist()]


class Alignment:
    """Ends of both sides' tokens, common ends, groups, and links as places in both sides."""

    __slots__ = ("ends_a", "ends_b", "cuts", "group_a", "group_b", "link_a", "link_b")


def align(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> Alignment:
    """a, b: the ids of two streams of tokens with the same bytes; len_a, len_b: each id's bytes."""
    out = Alignment()
    out.ends_a, out.ends_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    out.cuts = np.intersect1d(out.ends_a, out.ends_b, assume_unique=True)
    out.group_a, out.group_b = np.searchsorted(out.cuts, out.ends_a), np.searchsorted(out.cuts, out.ends_b)
    first = np.searchsorted(out.ends_b, out.ends_a - len_a[a], side="right")
    n = np.searchsorted(out.ends_b, out.ends_a, side="left") - first + 1
    out.link_a = np.repeat(np.arange(len(a)), n)
    out.link_b = _expanded(first, n)
    return out


@lru_cache(maxsize=2)
def _tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One a process, as tasks follow each other in it."""
    return Tokenizers(path_a, path_b)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and how long they are."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return at, np.diff(np.r_[at, len(new)])


def _decoded(text: bytes | None) -> str:
    try:
        return (text or b"").decode()
    except UnicodeDecodeError:
        return ""


def _per_document(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[pa.RecordBatch]:
    tok = _tokenizers(path_a, path_b)

    def out(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        parts = [tok.segments(t) if t else [] for t in texts]
        tok.make_room()
        new = list(dict.fromkeys(s for p in parts for s in p if s not in tok.known))
        if new:
            tok.learn(new)
        places = [np.fromiter(map(tok.known.__getitem__, p), np.int64, len(p)) for p in parts]
        places = [p if tok.facts[p, 0].all() else p[:0] for p in places]
        digests = [hashlib.sha256(";".join([tok.texts[i] for i in p.tolist()]).encode()).hexdigest() if len(p) else "" for p in places]
        size = np.array([len(p) for p in places], np.int64)
        flat, of_part = np.concatenate([*places, np.zeros(0, np.int64)]), np.repeat(np.arange(len(places)), size)
        totals = [np.bincount(of_part, tok.facts[flat, j], minlength=len(places)).astype(np.int64) for j in range(1, 5)]
        tok.uses += np.bincount(flat, minlength=len(tok.uses))
        n = tok.facts[flat, 4]
        doc, link = np.repeat(of_part, n), tok.links[_expanded(tok.start[flat], n)]
        order = np.lexsort((link, doc))
        doc, link = doc[order], link[order]
        runs, freq = _runs(doc, link)
        offsets = pa.array(np.searchsorted(doc[runs], np.arange(len(places) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (link[runs] >> 32, link[runs] & 0xFFFFFFFF, freq)]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(t) for t in totals), pa.array(digests, pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "n"])

    for b in batches:
        texts, lo, size = [], 0, 0
        for i, text in enumerate(b.column(1)):
            texts.append(_decoded(text.as_py()))
            size += len(texts[-1])
            if size > MOST_LINKS or i + 1 == b.num_rows:
                yield out(b.column(0).slice(lo, len(texts)), texts)
                texts, lo, size = [], i + 1, 0


def _pairs(b: pa.RecordBatch, at: int) -> np.ndarray:
    """The pairs of a batch as one number each; A's ids at the column `at`, B's behind."""
    return b.column(at).flatten().to_numpy().astype(np.int64) << 32 | b.column(at + 1).flatten().to_numpy()


def _summed(batches: Iterator[pa.RecordBatch], salts: int) -> Iterator[pa.RecordBatch]:
    """How often a task's documents hold each pair. One salt a task, so that a frequent pair's sums meet in several places first."""
    from pyspark import TaskContext

    salt, codes, counts, waiting, size = TaskContext.get().partitionId() % salts, np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merge() -> tuple[np.ndarray, np.ndarray]:
        both, n = np.concatenate([codes, *(c for c, _ in waiting)]), np.concatenate([counts, *(n for _, n in waiting)])
        order = np.argsort(both, kind="stable")
        at, _ = _runs(both := both[order])
        return both[at], np.add.reduceat(n[order], at) if len(at) else n

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(codes >> 32, pa.int32()), pa.array(codes & 0xFFFFFFFF, pa.int32()), pa.array(np.full(len(codes), salt), pa.int32()), pa.array(counts)], ["a", "b", "salt", "n"])

    for batch in batches:
        waiting.append((_pairs(batch, 0), batch.column(2).flatten().to_numpy().astype(np.int64)))
        size += len(waiting[-1][0])
        if size > MOST_LINKS:
            (codes, counts), waiting, size = merge(), [], 0
            if len(codes) > MOST_LINKS:
                yield out()
                codes, counts = codes[:0], counts[:0]
    codes, counts = merge()
    yield out()


def _valued(batches: Iterator[pa.RecordBatch], codes: np.ndarray, counts: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums over the pairs whose counts are at hand; the others stay lists."""
    codes, counts, best = (v.value for v in (codes, counts, best))
    for b in batches:
        if not b.num_rows:
            continue
        pair, freq = _pairs(b, 1), b.column(3).flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
        at = np.minimum(np.searchsorted(codes, pair), max(len(codes) - 1, 0))
        known = codes[at] == pair if len(codes) else np.zeros(len(pair), bool)
        sums = []
        for value in (best, counts):
            total = np.zeros(b.num_rows, np.int64)
            if len(codes):
                np.add.at(total, doc[known], freq[known] * value[at[known]])
            sums.append(pa.array(total))
        rest = np.flatnonzero(~known)
        offsets = pa.array(np.searchsorted(doc[rest], np.arange(b.num_rows + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v[rest].astype(np.int32))) for v in (pair >> 32, pair & 0xFFFFFFFF, freq)]
        yield pa.RecordBatch.from_arrays([b.column(0), *sums, *lists], ["row", "known_best", "known_sum", "a", "b", "n"])


def pair_counts(per_doc: DataFrame, salts: int = 16) -> DataFrame:
    """a, b, n: how often A's and B's ids are linked in all documents; best: whether no other A id is linked to that B id more often."""
    parts = per_doc.select("a", "b", "n").mapInArrow(lambda it: _summed(it, salts), "a int, b int, salt int, n long")
    counts = parts.groupBy("a", "b", "salt").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "pairs")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each of B's ids at most
    return counts.join(F.broadcast(most), "b").select("a", "b", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = 500_000, salts: int = 16) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), and pair_counts().

    path_a: a byte-level BPE file for tokenizers; path_b: a model for sentencepiece whose pieces don't cross words."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    per_doc = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        lambda it: _per_document(it, path_a, path_b),
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, n array<int>",
    )
    per_doc = materialize(per_doc.withColumn("row", F.monotonically_increasing_id()), "links")
    counts = materialize(pair_counts(per_doc, salts), "counts")
    top = counts.orderBy(F.desc("n"), "a", "b").limit(frequent).toArrow()  # at most `frequent` rows of 24 bytes
    a, b, n, best = (top.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n", "best"))
    order = np.argsort(codes := a << 32 | b)
    held = [spark.sparkContext.broadcast(v[order]) for v in (codes, n, best)]
    valued = per_doc.select("row", "a", "b", "n").mapInArrow(lambda it: _valued(it, *held), "row long, known_best long, known_sum long, a array<int>, b array<int>, n array<int>")
    valued = materialize(valued, "valued")
    rest = valued.select("row", F.inline(F.arrays_zip("a", "b", F.col("n").alias("freq"))))
    rest = rest.join(counts, ["a", "b"]).groupBy("row").agg(F.sum(F.col("freq") * F.col("best")).alias("more_best"), F.sum(F.col("freq") * F.col("n")).alias("more_sum"))
    whole = per_doc.drop("a", "b", "n").join(valued.select("row", "known_best", "known_sum"), "row").join(rest, "row", "left")
    n_best, count_sum = (F.col(f"known_{c}") + F.coalesce(F.col(f"more_{c}"), F.lit(0)) for c in ("best", "sum"))
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", n_best.alias("n_best"), count_sum.alias("count_sum"), "groups_sha256"), counts

"""Language identification by rank-order profiles.

A profile is the list of the ``top`` most frequent character n-grams (one to
three letters, words padded with blanks), most frequent first, ties by code
point. A document's distance to a language is the sum, over its own most
frequent n-grams, of how far each is out of place in the language's profile;
an n-gram that the profile lacks counts ``top``. The nearest language wins,
ties by name. Profiles are built from all training documents.

A text that is null or has no letter gives ``und`` with score 0, as does every
text when nothing could be learned. score is one minus the distance as a share
of the largest possible. Texts are read whole, however long. Rows that repeat an
id are predicted each; an empty table gives no rows. Columns other than those
named are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")
_BLANK = 32


def ngrams(text: str | None) -> np.ndarray:
    """The n-grams of a text's letters as integers, 21 bits a character."""
    letters = _LETTERS.findall(text.lower()) if text else []
    if not letters:
        return np.empty(0, np.int64)
    c = np.frombuffer(f" {' '.join(letters)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    blank = c == _BLANK
    pairs = c[:-1] << 21 | c[1:]
    triples = (pairs[:-1] << 21 | c[2:])[~blank[1:-1]]
    return np.concatenate([c[~blank], pairs, triples])


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, ties to the smaller code."""
    if len(codes) > 4 * top:  # what can't be among the first is left out before sorting
        least = np.partition(counts, -top)[-top]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:top]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    size = 0

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            codes, n = np.unique(ngrams(text), return_counts=True)
            held[lang].append((codes, n))
            size += len(codes)
            if size > 1_000_000:
                held = defaultdict(list, {k: [merged(v)] for k, v in held.items()})
                size = sum(len(v[0][0]) for v in held.values())
                if size > 500_000:
                    yield from out()
                    held, size = defaultdict(list), 0
    yield from out()


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = 300) -> dict[str, list[int]]:
    """Each language's n-grams, most frequent first: `top` numbers a language."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    first = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= top)
    out: dict[str, list[int]] = defaultdict(list)
    for r in sorted(first.select("lang", "code", "rank").collect(), key=lambda r: (r.lang, r.rank)):
        out[r.lang].append(r.code)
    return dict(out)


class OutOfPlace:
    """Distances of a text to all profiles at once."""

    def __init__(self, of_lang: dict[str, list[int]], top: int):
        self.langs, self.top = sorted(of_lang), top
        self.codes = np.unique(np.array([c for v in of_lang.values() for c in v], np.int64))
        self.rank = np.full((len(self.codes), len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, np.array(of_lang[lang], np.int64)), j] = np.arange(len(of_lang[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        codes, n = np.unique(ngrams(text), return_counts=True)
        if not len(codes) or not len(self.codes):
            return UNKNOWN, 0.0
        own = ranked(codes, n, self.top)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == own
        rank = self.rank[at]
        away = np.abs(rank - np.arange(len(own))[:, None])
        away[(rank < 0) | ~known[:, None]] = self.top
        far = np.minimum(away, self.top).sum(axis=0)
        best = int(np.argmin(far))
        return self.langs[best], 1 - float(far[best]) / (self.top * len(own))


def _predict(batches: Iterator[pa.RecordBatch], of_lang: dict[str, list[int]], top: int) -> Iterator[pa.RecordBatch]:
    judge = OutOfPlace(of_lang, top)
    for b in batches:
        got = [judge(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, of_lang: dict[str, list[int]], held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", top: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.lit(False) if held_out is None else held_out).alias("held_out"))
    return rows.mapInArrow(lambda it: _predict(it, of_lang, top), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def score_of(of_lang: dict[str, list[int]], text: Column, top: int = 300) -> Column:
    """The score of a text as a column: how near the nearest profile is."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = OutOfPlace(of_lang, top)
        for texts in batches:
            yield pa.array([judge(t.as_py())[1] for t in texts], pa.float64())

    return score(text)

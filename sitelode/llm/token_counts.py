"""Token counts by distinct pre-tokens.

A tokenizer's pieces depend on the pre-token alone, so each distinct pre-token
is encoded once, and a document's count is the sum over its pre-tokens of
frequency times pieces; no ids are kept. The most frequent pre-tokens (at most
``frequent`` of them, each at most ``LONGEST`` bytes, so the table has a fixed
bound) are summed where the document is read; all the others are joined by
their 64-bit hash. No pre-token crosses white space, so the distinct ones are taken
from distinct words.

A null text counts as an empty one: no bytes, no tokens. Texts are counted whole,
however long. Rows with the same id are counted apart; an empty table gives no
rows. Columns other than the id and the text are ignored, whatever their names. A row
number is fixed when the table of documents is written, so repeated rows stay apart.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelode.llm.common import materialize

LONGEST = 64
#: Distinct words and pre-tokens that a task holds at once.
MOST_WORDS = 150_000
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Fixed values of the tokenizer's file: its pre-token pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Python takes the first for white space, which the tokenizer doesn't, and lowers the last by what surrounds it.
ODD = r"[\x1c-\x1f\u03a3]"
#: Scripts whose character classes are long settled; other texts are split by the library itself, as its Unicode tables may be older.
SETTLED = r"[\x00-\u052F\u1E00-\u206F\u20A0-\u20BF\u2100-\u218B\u3000-\u30FF\u4E00-\u9FA5\uAC00-\uD7A3\uFF00-\uFF60]*"


#: How a file must normalise and split texts to be counted here.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITS = [
    {"type": "Split", "pattern": {"Regex": PRE_TOKEN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def check_file(path: str) -> None:
    """Raises ValueError for a tokenizer's file that treats texts in another way than this module does."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    special = tuple(t["content"] for t in found.get("added_tokens") or [] if t["special"] and not t["normalized"])
    same = (
        (found.get("normalizer") or {}).get("normalizers") == NORMALIZERS and (found.get("pre_tokenizer") or {}).get("pretokenizers") == SPLITS
        and special == SPECIAL and len(special) == len(found["added_tokens"])
    )
    if not same:
        raise ValueError(f"{path} normalises or splits texts in another way than is counted here")


class PreTokens:
    """Splits texts as the word-level BPE file does. Special strings in a text are tokens of their own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are Spark's; the library's threads only add memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.slow_normal, self.pre = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.find, self.settled, self.odd = regex.compile(PRE_TOKEN).findall, regex.compile(SETTLED).fullmatch, regex.compile(ODD).search
        self.cut = regex.compile("|".join(map(regex.escape, SPECIAL))).split

    def parts(self, text: str) -> list[str]:
        """What is between special strings."""
        return self.cut(text) if "<|" in text else [text]

    def plain(self, text: str) -> bool:
        """Whether Python's own functions treat a text as the library does."""
        return self.settled(text) is not None and self.odd(text) is None

    @staticmethod
    def normal(text: str) -> str:
        """A plain text as the tokenizer's file normalises it, but for its white space."""
        return unicodedata.normalize("NFC", text).lower()

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if self.plain(text):
            return self.find(self.normal(text))
        text = self.slow_normal(text)
        return [text[a:b] for _, (a, b) in self.pre(text)]

    def sizes(self, pre_tokens: list[str]) -> list[int]:
        """Pieces of pre-tokens, which are normal already. Texts can't be split any more after this."""
        from tokenizers import normalizers

        self.tokenizer.normalizer = normalizers.Sequence([])
        return [len(e.ids) for i in range(0, len(pre_tokens), 500) for e in self.tokenizer.encode_batch(pre_tokens[i : i + 500], add_special_tokens=False)]


@lru_cache(maxsize=2)
def _pre_tokens(path: str, use: str) -> PreTokens:
    """One a process and use, as tasks follow each other in it."""
    return PreTokens(path)


def _distinct(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    split = _pre_tokens(path, "split")
    words: Counter = Counter()
    pieces: Counter = Counter()
    held = 0

    def out() -> pa.RecordBatch:
        for word, n in words.items():
            for p in split.find(word):
                pieces[p] += n
        return pa.RecordBatch.from_pydict({"piece": pa.array(list(pieces), pa.string()), "n": pa.array(list(pieces.values()), pa.int64())})

    for b in batches:
        for text in b.column(0):
            for part in split.parts(text.as_py()) if text.is_valid else []:
                if split.plain(part):
                    words.update(split.normal(part).split())
                else:
                    pieces.update(split.pieces(part))
                held += len(part)
            if len(words) + len(pieces) > MOST_WORDS or held > 200 * MOST_WORDS:
                yield out()
                words.clear()
                pieces.clear()
                held = 0
    yield out()


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    split = _pre_tokens(path, "sizes")
    for b in batches:
        sizes = split.sizes(b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], ["piece", "n", "tokens"])


def _per_document(batches: Iterator[pa.RecordBatch], path: str, known: dict[str, int]) -> Iterator[pa.RecordBatch]:
    split = _pre_tokens(path, "split")
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            size, rare, freq = [], [], []
            for text in part.column(1).to_pylist():
                parts = split.parts(text) if text else [""]
                counts = Counter(split.pieces(parts[0]) if len(parts) == 1 else [p for part in parts for p in split.pieces(part)])
                rest = [p for p in counts if p not in known]
                size.append(len(parts) - 1 + sum(known[p] * n for p, n in counts.items() if p in known))
                rare.append(np.array([xxhash.xxh64_intdigest(p.encode(), 42) for p in rest], np.uint64).view(np.int64))
                freq.append(np.array([counts[p] for p in rest], np.int64))
            nbytes = pc.fill_null(pc.binary_length(part.column(1).cast(pa.binary())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), nbytes, pa.array(size, pa.int64()), pa.array(rare, pa.list_(pa.int64())), pa.array(freq, pa.list_(pa.int64()))],
                ["doc_id", "n_bytes", "known", "rare", "freq"],
            )


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", frequent: int = 100_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per input row. path: the tokenizer's file, of the kind of word_bpe_49k.json."""
    check_file(path)
    texts = docs.select(F.col(text_col).alias("text"))
    pieces = texts.mapInArrow(lambda it: _distinct(it, path), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = materialize(pieces.mapInArrow(lambda it: _encode(it, path), "piece string, n long, tokens long"), "pieces")
    top = pieces.where(F.octet_length("piece") <= LONGEST).orderBy(F.desc("n"), "piece").limit(frequent).select("piece", "tokens")
    known = {r.piece: r.tokens for r in top.collect()}  # at most `frequent` short strings

    kind = docs.schema[id_col].dataType.simpleString()
    per_doc = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lambda it: _per_document(it, path, known), f"doc_id {kind}, n_bytes long, known long, rare array<long>, freq array<long>"
    )
    per_doc = materialize(per_doc.withColumn("row", F.monotonically_increasing_id()), "documents")
    rare = per_doc.select("row", F.inline(F.arrays_zip("rare", "freq"))).withColumnRenamed("rare", "h")
    by_hash = pieces.select(F.xxhash64("piece").alias("h"), "tokens").groupBy("h").agg(F.max("tokens").alias("tokens"))
    sums = rare.join(by_hash, "h").groupBy("row").agg(F.sum(F.col("freq") * F.col("tokens")).alias("more"))
    n = (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens")
    return per_doc.join(sums, "row", "left").select("doc_id", "n_bytes", n).withColumn("over_limit", F.col("n_tokens") > limit)

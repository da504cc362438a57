"""Toxic spans and documents by a linear-chain conditional random field.

Two states, clean and toxic. A token's features are its lower-cased form
without punctuation at its ends and the first three, four and five characters
of that. Tokens are labelled for training from document labels: in a toxic
document a token is toxic if one of its features is found in toxic documents
at least ``odds`` times as often as in clean ones, counting each pair of
neighbours once; in clean documents every token is clean. Weights are fitted by the gradient of the conditional
likelihood; forward-backward marginals give each token's probability, and a
logistic curve over a document's largest marginal and their sum gives its score.

The model is fitted in one task on at most ``per_class`` labelled documents of either label
of at most eight times ``longest`` characters, those whose ids hash lowest; scoring covers all whole
texts. Null and empty texts get the score of a text without toxic tokens.
Without labels of both kinds no token is toxic and the score is the share of
toxic labels (0 if there are none). Long texts are scored whole. Repeated rows
are scored each; where labels repeat an id its largest label counts; null labels
are ignored. An empty table gives no rows; columns other than those named are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelode.llm.common import WORD

_TOKEN = re.compile(WORD)
#: What str.split() splits at and WORD doesn't.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ENDS = ".,;:!?\"'()[]{}<>*#%&$|-_"
_LENGTHS = (3, 4, 5)
_BLOCK = 128


def tokens_of(text: str | None) -> list[str]:
    """The words of a text, split at ASCII white space only."""
    text = text or ""
    return _TOKEN.findall(text) if _ODD.search(text) else text.split()


def features(token: str) -> list[str]:
    w = token.lower().strip(_ENDS)
    return [f"w={w}", *(f"p{k}={w[:k]}" for k in _LENGTHS if len(w) >= k)] if w else []


@dataclass
class Model:
    weight: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    start: tuple[float, float] = (0.0, 0.0)
    step: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def emission(self, token: str) -> float:
        return self.bias + sum(self.weight.get(f, 0.0) for f in features(token))


def marginals(e: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages and the probability of the toxic state, for many chains end to end.

    e: the toxic state's emission score; first: where a chain begins; start, step: scores of states and of changes.
    A chain's beginning forgets what came before, so all chains are one product of 2 x 2 matrices. It is taken in
    blocks side by side: the blocks' own products, then the vectors that enter each block, then the messages inside."""
    n = len(e)
    if not n:
        return np.empty((0, 2)), np.empty((0, 2)), np.empty(0)
    blocks = -(-n // _BLOCK)
    size = blocks * _BLOCK
    x = np.zeros(size)
    x[:n] = np.exp(np.clip(e, -30, 30))
    begins = np.ones(size, bool)
    begins[:n] = first
    begins[0] = True
    x[n:] = 1.0
    s, t = np.exp(start), np.exp(step)
    # m[i][j]: from state i to state j, (step in the block, block)
    cut = lambda a: np.ascontiguousarray(a.reshape(blocks, _BLOCK).T)
    m00, m10 = cut(np.where(begins, s[0], t[0, 0])), cut(np.where(begins, s[0], t[1, 0]))
    m01, m11 = cut(np.where(begins, s[1], t[0, 1]) * x), cut(np.where(begins, s[1], t[1, 1]) * x)
    p00, p01, p10, p11 = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for i in range(_BLOCK):
        p00, p01, p10, p11 = p00 * m00[i] + p01 * m10[i], p00 * m01[i] + p01 * m11[i], p10 * m00[i] + p11 * m10[i], p10 * m01[i] + p11 * m11[i]
        z = p00 + p01 + p10 + p11
        p00, p01, p10, p11 = p00 / z, p01 / z, p10 / z, p11 / z
    into, back = np.empty((blocks, 2)), np.empty((blocks, 2))
    a, b = 0.5, 0.5
    products = np.stack([p00, p01, p10, p11], axis=1).tolist()
    for k, (q00, q01, q10, q11) in enumerate(products):
        into[k] = a, b
        a, b = a * q00 + b * q10, a * q01 + b * q11
        a, b = a / (a + b), b / (a + b)
    a, b = 0.5, 0.5
    for k in range(blocks - 1, -1, -1):
        q00, q01, q10, q11 = products[k]
        back[k] = a, b
        a, b = q00 * a + q01 * b, q10 * a + q11 * b
        a, b = a / (a + b), b / (a + b)
    fa, fb, ba, bb = (np.empty((_BLOCK, blocks)) for _ in range(4))
    a, b = into[:, 0], into[:, 1]
    for i in range(_BLOCK):
        a, b = a * m00[i] + b * m10[i], a * m01[i] + b * m11[i]
        z = a + b
        a, b = a / z, b / z
        fa[i], fb[i] = a, b
    a, b = back[:, 0], back[:, 1]
    for i in range(_BLOCK - 1, -1, -1):
        ba[i], bb[i] = a, b
        a, b = m00[i] * a + m01[i] * b, m10[i] * a + m11[i] * b
        z = a + b
        a, b = a / z, b / z
    flat = lambda y: y.T.reshape(-1)[:n]
    fa, fb, ba, bb = map(flat, (fa, fb, ba, bb))
    on = fb * bb
    return np.stack([fa, fb], axis=1), np.stack([ba, bb], axis=1), on / (on + fa * ba)


def _by_document(p: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest and the sum of each document's values, 0 for documents without tokens."""
    most, total = np.zeros(len(lengths)), np.zeros(len(lengths))
    full = np.flatnonzero(lengths)
    if len(full):
        at = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
        most[full], total[full] = np.maximum.reduceat(p, at), np.add.reduceat(p, at)
    return most, total


def expected_changes(fwd: np.ndarray, bwd: np.ndarray, e: np.ndarray, step: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """How often each state is expected to follow each, in the order of step; inner: tokens that begin no chain. Taken in
    parts, so that little is held at once."""
    total = np.zeros(4)
    for at in range(0, len(inner), 100_000):
        part = inner[at : at + 100_000]
        x = np.exp(np.clip(e[part], -30, 30))
        into = (bwd[part, 0], x * bwd[part, 1])
        weights = [fwd[part - 1, i] * np.exp(step[i, j]) * into[j] for i in (0, 1) for j in (0, 1)]
        z = sum(weights)
        total += [(w / z).sum() for w in weights]
    return total


def fit(texts: list[str], toxic: list[int], share: float, odds: float = 20.0, rounds: int = 30, penalty: float = 0.01) -> Model:
    """Fits the field on a bounded sample; share: how many of all labelled documents are toxic."""
    y_doc = np.array(toxic, np.int64)
    model = Model(curve=(math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0))
    if not (0 < y_doc.sum() < len(y_doc)):
        return model
    tokens = [tokens_of(t) for t in texts]
    lengths = np.array([len(ws) for ws in tokens])
    place: dict[str, int] = {}
    word = np.array([place.setdefault(w, len(place)) for ws in tokens for w in ws], np.int64)
    del tokens
    of_word = [features(w) for w in place]
    first = np.zeros(len(word), bool)
    first[np.concatenate([[0], np.cumsum(lengths[lengths > 0])[:-1]])] = True
    on = np.repeat(y_doc, lengths)
    # a feature counts once for each pair of neighbours, or near copies of one document would make its words seem telling
    before, after = np.roll(word, 1), np.roll(word, -1)
    before[first], after[np.roll(first, -1)] = -1, -1
    found = (Counter(), Counter())
    for label in (0, 1):
        triples = np.unique(np.stack([word, before, after], axis=1)[on == label], axis=0)
        for w, n in zip(*np.unique(triples[:, 0], return_counts=True), strict=True):
            for f in of_word[w]:
                found[label][f] += int(n)
        if label:
            bad = len(triples)
        else:
            good = len(triples)
    least = max(3, math.ceil(0.004 * y_doc.sum()))
    ratio = lambda f: (found[1][f] + 0.5) / (bad + 1) / ((found[0][f] + 0.5) / (good + 1))
    hot = {f for f, n in found[1].items() if n >= least and ratio(f) >= odds}
    names = sorted(f for f in found[0] | found[1] if found[0][f] + found[1][f] >= least)
    index = {f: i for i, f in enumerate(names)}
    width = 1 + len(_LENGTHS)
    rows = np.full((len(of_word), width), len(names), np.int32)
    for i, fs in enumerate(of_word):
        own = [index[f] for f in fs if f in index]
        rows[i, : len(own)] = own
    x = rows[word]
    y = (np.array([any(f in hot for f in fs) for fs in of_word])[word] & (on == 1)).astype(np.float64)
    inner = np.flatnonzero(~first)
    changes = np.bincount((2 * y[inner - 1] + y[inner]).astype(np.int64), minlength=4).astype(np.float64)

    def emissions(w: np.ndarray, bias: float) -> np.ndarray:
        e = np.full(len(x), bias)
        for c in range(width):
            e += w[x[:, c]]
        return e

    params = np.zeros(len(names) + 1 + 1 + 2 + 4)  # weights, an unused one, bias, start, step
    params[len(names) + 1] = -4.0
    n_w = len(names) + 1
    mean, var = np.zeros_like(params), np.zeros_like(params)
    for it in range(1, rounds + 1):
        w, bias, start, step = params[:n_w], params[n_w], params[n_w + 1 : n_w + 3], params[n_w + 3 :].reshape(2, 2)
        e = emissions(w, bias)
        fwd, bwd, p = marginals(e, first, start, step)
        miss = y - p
        grad = np.zeros_like(params)
        for c in range(width):
            grad[:n_w] += np.bincount(x[:, c], miss, n_w)
        grad[:n_w] -= penalty * w
        grad[len(names)] = 0
        grad[n_w] = miss.sum()
        grad[n_w + 1 : n_w + 3] = (1 - y[first]).sum() - (1 - p[first]).sum(), miss[first].sum()
        grad[n_w + 3 :] = changes - expected_changes(fwd, bwd, e, step, inner) - penalty * step.reshape(-1)
        grad /= max(y.sum(), 1.0)
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        params = params + 0.4 * (mean / (1 - 0.9**it)) / (np.sqrt(var / (1 - 0.99**it)) + 1e-6)
        params[len(names)] = 0
    w, step, start = params[:n_w], params[n_w + 3 :].reshape(2, 2), params[n_w + 1 : n_w + 3]
    model.weight = {f: float(v) for f, v in zip(names, w, strict=False) if abs(v) > 1e-3}
    model.bias, model.start, model.step = float(params[n_w]), tuple(start.tolist()), tuple(map(tuple, step.tolist()))
    _, _, p = marginals(emissions(w, params[n_w]), first, start, step)
    most, total = _by_document(p, lengths)
    model.curve = _logistic(np.stack([np.ones(len(most)), most, np.log1p(total)], axis=1), y_doc, share)
    return model


def _logistic(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float, float]:
    """Newton's method, each class weighing what it has among all labelled documents."""
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    b = np.zeros(z.shape[1])
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (y - p)) - ridge @ b
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge
        d = np.linalg.solve(h, g)
        b = b + d * min(1.0, 5 / max(np.abs(d).max(), 1e-9))
        if np.abs(d).max() < 1e-6:
            break
    return tuple(b.tolist())


def sample(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, per_class: int = 1000, longest: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[DataFrame, float]:
    """text, toxic of at most per_class documents a label, and the share of toxic labels among all that may be learned from."""
    named = labels.select(F.col("doc_id").alias("id"), F.col(label_col).alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull())
    if held_out is not None:
        named = named.where(~held_out)
    one = named.groupBy("id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r["count"] for r in one.groupBy("toxic").count().collect()}
    # twice as many ids as texts, as some are without a text or have a long one
    picked = [one.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(2 * per_class) for c in (0, 1)]
    ids = picked[0].union(picked[1])  # at most 4 * per_class rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= 8 * longest))
    rows = texts.join(F.broadcast(ids), "id").groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("id").alias("id"))
    kept = [rows.where(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)]
    total = sum(counts.values())
    return kept[0].union(kept[1]).select("text", F.col("toxic").cast("int").alias("toxic")), counts.get(1, 0) / total if total else 0.0


def fit_sample(rows: DataFrame, share: float) -> Model:
    """The model of a bounded sample (text, toxic), fitted in one task; only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for b in batches:
            texts += b.column("text").to_pylist()
            toxic += b.column("toxic").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (toxic[i], texts[i]))
        model = fit([texts[i] for i in order], [toxic[i] for i in order], share)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(model))], pa.binary())], ["model"])

    fitted = rows.repartition(1).mapInArrow(run, "model binary").first()
    return Model(**pickle.loads(fitted["model"])) if fitted else fit([], [], share)


def _score(batches: Iterator[pa.RecordBatch], model: Model, spans: bool, at_least: float) -> Iterator[pa.RecordBatch]:
    known: dict[str, float] = {}
    start, step = np.array(model.start), np.array(model.step)

    def emissions(ws: list[str]) -> list[float]:
        if len(known) > 100_000:
            known.clear()
        for w in set(ws).difference(known):
            known[w] = model.emission(w)
        return [known[w] for w in ws]

    for b in batches:
        for lo in range(0, b.num_rows, 200):
            part = b.slice(lo, 200)
            texts = part.column(1).to_pylist()
            tokens = [tokens_of(t) for t in texts]
            lengths = np.array([len(ws) for ws in tokens], np.int64)
            e = np.array([v for ws in tokens for v in emissions(ws)])
            first = np.zeros(len(e), bool)
            if len(e):
                first[np.concatenate([[0], np.cumsum(lengths[lengths > 0])[:-1]])] = True
            p = marginals(e, first, start, step)[2]
            most, total = _by_document(p, lengths)
            z = model.curve[0] + model.curve[1] * most + model.curve[2] * np.log1p(total)
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            arrays, names = [part.column(0), part.column(2), pa.array(score)], ["doc_id", "held_out", "score"]
            if spans:
                ends, out = np.cumsum(lengths), [[] for _ in texts]
                hits = np.flatnonzero(p >= at_least)
                of_doc = np.searchsorted(ends, hits, side="right")
                for d in np.unique(of_doc).tolist():  # places are looked for in texts that have any
                    found = [m.span() for m in _TOKEN.finditer(texts[d])]
                    at = hits[of_doc == d]
                    out[d] = [{"start": found[k][0], "end": found[k][1], "p": float(q)} for k, q in zip((at - ends[d] + lengths[d]).tolist(), p[at], strict=True)]
                arrays.append(pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(arrays, names)


def score(docs: DataFrame, model: Model, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", spans: bool = False, at_least: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row; with spans also the offending tokens' offsets in characters."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.lit(False) if held_out is None else held_out).alias("held_out"))
    out = f"doc_id {kind}, held_out boolean, score double" + ", spans array<struct<start:int,end:int,p:double>>" * spans
    return rows.mapInArrow(lambda it: _score(it, model, spans, at_least), out).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score_of(model: Model, text: Column) -> Column:
    """The score of a text as a column."""

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            n = len(texts)
            batch = pa.RecordBatch.from_arrays([pa.nulls(n), texts, pa.nulls(n)], ["doc_id", "text", "held_out"])
            yield pa.concat_arrays([pa.array([], pa.float64()), *(b.column(2) for b in _score(iter([batch]), model, False, 0.5))])

    return scores(text)

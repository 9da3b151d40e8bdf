"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. What it looks like, what its neighbours look like
and their labels decide; the forward-backward marginals of its lines, weighted
by their lengths, make the score of a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents, those with the smallest hash of their
#: id, are learnt from, each with all its lines.
TRAIN_DOCS = 2_000
#: One document in so many is held out of learning, by crc32 of its id.
FOLDS = 5
THRESHOLD = 0.3
#: Padded line slots that one forward-backward pass holds.
SLOTS = 1 << 20
#: Padded line slots that one pass of learning holds.
TRAIN_SLOTS = 1 << 16

_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _PUNCT, _SYMBOL, _BAR, _BANG, _HIGH, _OTHER = range(11)
_CLASSES = 11


def _byte_classes() -> np.ndarray:
    kind = np.full(256, _OTHER, np.int64)
    for chars, k in (("abcdefghijklmnopqrstuvwxyz", _LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), ("0123456789", _DIGIT), (" \t\r\n\x0b\x0c", _SPACE), (".?", _STOP), (",;:'\"()-", _PUNCT), ("#*$%&<>@^~=+_{}[]\\/", _SYMBOL), ("|", _BAR), ("!", _BANG)):
        kind[list(chars.encode())] = k
    kind[128:] = _HIGH
    return kind


_KIND = _byte_classes()
#: Features of one line: shares of the byte classes, then five of its words.
LINE_FEATURES = _CLASSES + 5


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the lines that hold more than white space."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if not lines:
        return np.zeros((0, LINE_FEATURES), np.float32), np.zeros(0, np.int64)
    coded = [x.encode("utf-8", "replace") for x in lines]
    sizes = np.array([len(c) for c in coded])
    kinds = _KIND[np.frombuffer(b"".join(coded), np.uint8)]
    line = np.repeat(np.arange(len(lines)), sizes)
    counts = np.bincount(line * _CLASSES + kinds, minlength=len(lines) * _CLASSES).reshape(-1, _CLASSES)
    out = np.empty((len(lines), LINE_FEATURES), np.float32)
    out[:, :_CLASSES] = counts / sizes[:, None]
    for k, x in enumerate(lines):
        words = x.split()
        last = words[-1][-1]
        out[k, _CLASSES:] = (math.log1p(len(words)), len(set(words)) / len(words), len(x) / len(words) / 10, last in ".?!…\"'»”)", words[0][:1].isupper())
    return out, np.array([len(x) for x in lines])


def with_neighbours(f: np.ndarray) -> np.ndarray:
    """Features of a line, of the line before and the line after, and a one."""
    none = np.zeros((1, f.shape[1]), f.dtype)
    edge = np.zeros((len(f), 2), f.dtype)
    if len(f):
        edge[0, 0] = edge[-1, 1] = 1
    return np.hstack([f, np.vstack([none, f[:-1]])[: len(f)], np.vstack([f[1:], none])[: len(f)], edge, np.ones((len(f), 1), f.dtype)])


@dataclass(frozen=True)
class Chain:
    """Weights of the good label, and the gain of each pair of labels."""

    weights: np.ndarray
    pairs: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return with_neighbours((features - self.mean) / self.scale) @ self.weights


def forward_backward(scores: np.ndarray, lengths: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals of good, expected pairs of labels, log partition) of padded chains.

    ``scores`` (chains, steps) favour good over bad.
    """
    n, steps = scores.shape
    gain = np.stack([np.zeros_like(scores), scores], axis=2)
    alpha, beta = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
    alpha[:, 0] = gain[:, 0]
    for t in range(1, steps):
        alpha[:, t] = np.logaddexp(alpha[:, t - 1, :1] + pairs[0], alpha[:, t - 1, 1:] + pairs[1]) + gain[:, t]
    for t in range(steps - 2, -1, -1):
        after = gain[:, t + 1] + beta[:, t + 1]
        step = np.stack([np.logaddexp(pairs[0, 0] + after[:, 0], pairs[0, 1] + after[:, 1]), np.logaddexp(pairs[1, 0] + after[:, 0], pairs[1, 1] + after[:, 1])], axis=1)
        beta[:, t] = np.where((t + 1 < lengths)[:, None], step, 0)
    total = np.logaddexp(*(alpha + beta)[:, 0].T)
    good = np.exp(np.minimum(0, (alpha + beta)[:, :, 1] - total[:, None]))
    inside = np.arange(1, steps)[None, :] < lengths[:, None]
    expected = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            log = alpha[:, :-1, i] + pairs[i, j] + gain[:, 1:, j] + beta[:, 1:, j] - total[:, None]
            expected[i, j] = np.exp(np.minimum(0, log))[inside].sum()
    return good, expected, total


def fit(chains: list[np.ndarray], labels: list[int], rounds: int = 150, rate: float = 0.05, decay: float = 1e-3) -> Chain:
    """Maximum likelihood by Adam; every line of a document has its label.

    Without documents of both labels the weights are zero and scores even.
    """
    mean, scale = np.zeros(LINE_FEATURES, np.float32), np.ones(LINE_FEATURES, np.float32)
    width = 3 * LINE_FEATURES + 3
    if len(set(labels)) < 2:
        return Chain(np.zeros(width), np.zeros((2, 2)), mean, scale)
    stacked = np.vstack(chains)
    mean, scale = stacked.mean(axis=0), stacked.std(axis=0) + 1e-2
    batches, at = [], 0
    order = sorted((k for k in range(len(chains)) if len(chains[k])), key=lambda k: len(chains[k]))
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * len(chains[order[stop]]) <= TRAIN_SLOTS:
            stop += 1
        group = order[at:stop]
        lengths, good = np.array([len(chains[k]) for k in group]), np.array([labels[k] for k in group], float)
        inside = np.arange(lengths.max())[None, :] < lengths[:, None]
        batches.append((np.vstack([with_neighbours((chains[k] - mean) / scale) for k in group]), np.repeat(good, lengths), lengths, inside))
        at = stop
    sizes, bad = np.array([len(c) for c in chains]), np.array(labels) == 0
    steps = np.maximum(sizes - 1, 0)
    seen = np.array([[steps[bad].sum(), 0], [0, steps[~bad].sum()]], float)
    w, m, v = (np.zeros(width + 4) for _ in range(3))
    for k in range(1, rounds + 1):
        pairs = w[width:].reshape(2, 2)
        grad = np.r_[np.zeros(width), seen.ravel()]
        for flat, y, lengths, inside in batches:
            scores = np.zeros(inside.shape)
            scores[inside] = flat @ w[:width]
            good, expected, _ = forward_backward(scores, lengths, pairs)
            grad[:width] += (y - good[inside]) @ flat
            grad[width:] -= expected.ravel()
        grad = grad / len(stacked) - decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Chain(w[:width], w[width:].reshape(2, 2), mean, scale)


def score_texts(texts: list[str | None], model: Chain) -> np.ndarray:
    """Length-weighted share of good lines; a text without words scores 0."""
    made = [line_features(t or "") for t in texts]
    out = np.zeros(len(texts))
    order = sorted((k for k in range(len(texts)) if len(made[k][0])), key=lambda k: len(made[k][0]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * len(made[order[stop]][0]) <= SLOTS:
            stop += 1
        group = order[at:stop]
        lengths = np.array([len(made[k][0]) for k in group])
        scores, sizes = np.zeros((len(group), lengths.max())), np.zeros((len(group), lengths.max()))
        for r, k in enumerate(group):
            scores[r, : lengths[r]] = model.emissions(made[k][0])
            sizes[r, : lengths[r]] = made[k][1]
        good, _, _ = forward_backward(scores, lengths, model.pairs)
        out[group] = (good * sizes).sum(axis=1) / sizes.sum(axis=1)
        at = stop
    return np.clip(out, 0, 1)


def held_out(id_col: str):
    """Whether crc32 of the id as text falls in the fold not learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Chain:
    """Fit on a bounded sample of the labelled documents outside the held-out fold.

    Labels that are null, or that disagree about a document, are not used.
    """
    agreed = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("z"))
    chosen = agreed.where("y = z").where(~held_out("id")).orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS).select("id", "y")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "id")  # TRAIN_DOCS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [line_features(t or "")[0].ravel().tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(made, pa.list_(pa.float32()))], ["id", "y", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.select("id", "t", "y").mapInArrow(run, f"id {kind}, y int, f array<float>").orderBy(F.xxhash64("id"), "id", F.xxhash64("f")).limit(TRAIN_DOCS).collect()
    chains = [(np.array(r["f"], np.float32).reshape(-1, LINE_FEATURES), r["y"]) for r in rows if r["f"]]
    return fit([c for c, _ in chains], [y for _, y in chains])


def score_documents(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score), one row per input row; null and empty texts score 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(batch.column(1).to_pylist(), model), pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score at least ``threshold``."""

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(score_texts(texts.tolist(), model))

    return docs.where(score(F.col(text_col)) >= threshold)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) with a model learnt from ``labels``."""
    scored = score_documents(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

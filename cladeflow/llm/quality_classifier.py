"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated scores.

Every unit of a text (its words by hash, and their shapes) has a sparse random index vector; a word's vector sums the
index vectors of its neighbours in the fitted sample. A document is the mean of its units' vectors. A network of two
layers learns from document labels, and a temperature fitted on rows it hasn't seen calibrates its probabilities.

Defined results: null and empty texts have the score of a zero vector; without labelled rows of both classes every
score is 0.5; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cladeflow.llm import common, labelled

BITS, DIM, SHAPE_DIM = 15, 32, 64
SHAPES = 256


def index_vectors(n: int, dim: int, seed: int, ones: int = 4) -> np.ndarray:
    """Sparse ternary vectors: half of the places +1, half -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, dim), np.float32)
    places = rng.random((n, dim)).argsort(1)[:, :ones]
    out[np.arange(n)[:, None], places] = np.where(np.arange(ones) % 2, -1, 1)
    return out


SHAPE_INDEX = index_vectors(SHAPES, SHAPE_DIM, 5)


def units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, each word's document, and each document's shares of shapes."""
    w = common.Words(raw, offsets)
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), w.count)
    bucket = (w.hash >> np.uint64(64 - BITS)).astype(np.int64)

    def inside(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(mask, out=c[1:])
        return c[w.end] - c[w.start]

    upper = inside((raw >= 65) & (raw <= 90))
    digit = inside((raw >= 48) & (raw <= 57))
    mark = inside((raw > 32) & (raw < 48) | (raw > 57) & (raw < 65) | (raw > 90) & (raw < 97) | (raw > 122) & (raw < 127))
    size = w.end - w.start
    case = np.where(upper == 0, 0, np.where(upper == 1, 1, 2))
    shape = ((case * 2 + (digit > 0)) * 4 + np.minimum(mark, 3)) * 4 + np.minimum(np.maximum(size - 1, 0) // 4, 3)  # below 96
    end = raw[w.end - 1] if len(size) else np.zeros(0, np.uint8)
    tail = 96 + np.where(end < 128, np.where((end | 32) - 97 < 26, 0, end), 1).astype(np.int64)  # below 224
    counts = np.bincount(doc * SHAPES + shape, minlength=n * SHAPES) + np.bincount(doc * SHAPES + tail, minlength=n * SHAPES)
    again = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])) + 1
    counts += np.bincount(doc[again] * SHAPES + 224, minlength=n * SHAPES)
    windows, to = w.shingles(3)
    twice = np.zeros(n)
    for d in range(n):
        g = windows[to[d] : to[d + 1]]
        twice[d] = len(g) - len(np.unique(g))
    counts[np.arange(n) * SHAPES + 225] += twice.astype(np.int64)
    return bucket, doc, counts.reshape(n, SHAPES) / np.maximum(w.count, 1)[:, None]


class Model:
    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.layers: list[np.ndarray] = []
        self.centre = self.scale = None
        self.temperature = 1.0

    def pool(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bucket, doc, shapes = units(raw, offsets)
        n = len(offsets) - 1
        words = np.zeros((n, DIM), np.float32)
        has = np.bincount(doc, minlength=n)
        if len(doc):
            first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            words[doc[first]] = np.add.reduceat(self.vectors[bucket], first, axis=0)
            words /= np.maximum(has, 1)[:, None]
        norm = np.sqrt((words * words).sum(1, keepdims=True))
        return np.hstack([words, shapes.astype(np.float32) @ SHAPE_INDEX, norm, np.log1p(has)[:, None] / 8, np.sqrt(shapes[:, 224:226])]).astype(np.float32)

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return (np.maximum((x - self.centre) / self.scale @ a + b, 0) @ c + d)[:, 0]

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(offsets) - 1, 0.5)
        z = self.logits(self.pool(raw, offsets)).astype(np.float64) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def word_vectors(rows: pa.Table, seed: int) -> np.ndarray:
    """Random indexing: each word sums its own and its two neighbours' index vectors on either side, rotated by distance.

    Every word of every row counts; per_class alone bounds the rows."""
    index = index_vectors(1 << BITS, DIM, seed)
    out = index.copy()
    for raw, offsets in labelled.chunks(rows.column("text")):
        bucket, doc, _ = units(raw, offsets)
        for gap in (1, 2):
            same = np.flatnonzero(doc[gap:] == doc[:-gap])
            a, b = bucket[same], bucket[same + gap]
            np.add.at(out, a, np.roll(index, gap, 1)[b])
            np.add.at(out, b, np.roll(index, -gap, 1)[a])
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


def fit(rows: pa.Table, sizes: dict[int, int], hidden: int = 32, epochs: int = 40, rate: float = 0.003, seed: int = 3) -> Model:
    model = Model(word_vectors(rows, seed))
    y = rows.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return model
    x = np.vstack([model.pool(*c) for c in labelled.chunks(rows.column("text"))])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    check, learn = order[: max(2, len(y) // 6)], order[max(2, len(y) // 6) :]
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    cost = np.array([sizes[0] / n[0], sizes[1] / n[1]])[y].astype(np.float32)
    cost /= cost.mean()
    model.centre, model.scale = x[learn].mean(0), x[learn].std(0) + 1e-3
    shapes = [(x.shape[1], hidden), (hidden,), (hidden, 1), (1,)]
    model.layers = [rng.normal(0, (2 / s[0]) ** 0.5, s).astype(np.float32) if len(s) == 2 else np.zeros(s, np.float32) for s in shapes]
    first, second = [np.zeros(s, np.float32) for s in shapes], [np.zeros(s, np.float32) for s in shapes]
    u, step = (x - model.centre) / model.scale, 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(learn), max(1, len(learn) // 128)):
            a, b, c, d = model.layers
            h = np.maximum(u[batch] @ a + b, 0)
            p = 1 / (1 + np.exp(-np.clip((h @ c + d)[:, 0], -30, 30)))
            e = ((p - y[batch]) * cost[batch] / max(1, len(batch)))[:, None].astype(np.float32)
            back = (e @ c.T) * (h > 0)
            grads = [u[batch].T @ back + 1e-4 * a, back.sum(0), h.T @ e + 1e-4 * c, e.sum(0)]
            step += 1
            for k, g in enumerate(grads):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model.layers[k] = model.layers[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    z = model.logits(x[check]).astype(np.float64)
    loss = lambda t: float((cost[check] * np.logaddexp(0, np.where(y[check] == 1, -z, z) / t)).sum())
    model.temperature = min(np.geomspace(0.5, 8, 41), key=loss)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 4000) -> Model:
    """per_class bounds the labelled rows that are used."""
    rows, sizes = labelled.training_rows(docs, labels, label, per_class)
    return fit(rows, sizes)


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.3, **kw) -> DataFrame:
    return labelled.scored(docs, model.score, threshold, **kw)


def op9_quality_classifier(spark, sf_dir):
    from cladeflow.runtime import fewer_files, table

    docs = table(spark, sf_dir, "documents")
    # a row of scores is small: the table's partitions would each become a tiny file
    return fewer_files(score_quality(docs, train(docs, table(spark, sf_dir, "labels"))), docs.rdd.getNumPartitions())

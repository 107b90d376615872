"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

Each sentence has a probability from hashed words; noisy-or joins them to the document's, and the words' weights are
trained from document labels through it. The sentences that carry a document's score are located by byte spans.

Defined results: null and empty texts have the score of the noise floor; without labelled rows of both classes every
score is that floor; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeflow.llm import common, labelled
from cladeflow.runtime import ship

#: Bytes that part words: ASCII but letters and digits.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Bytes that end a sentence: . ! ? and a new line.
STOP = np.zeros(256, bool)
STOP[[0x2E, 0x21, 0x3F, 0x0A]] = True
#: A word's features are itself and its beginnings of so many bytes, for languages that build words from stems.
PREFIXES = (4, 5, 6, 7, 8)
BITS = 20
FLOOR = 0.01


def sentences(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, common.Words]:
    """Each word's feature hashes (0: none) by kind, each sentence's first word, each sentence's document, and the words."""
    w = common.Words(raw, offsets, APART)
    features = [w.hash]
    for n in PREFIXES:
        long = w.end - w.start > n
        h = np.zeros(len(w.start), np.uint64)
        h[long] = w.span_hash(w.start[long], w.start[long] + n) ^ np.uint64(n)
        features.append(h)
    mark = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(STOP[raw], out=mark[1:])
    doc = np.repeat(np.arange(len(w.count)), w.count)
    part = mark[w.start]
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return features, first, doc[first], w


class Model:
    """Weights of the features that tell, by their whole hashes, and the bias of a sentence."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias = hashes[order], weights[order], bias
        self.maybe = np.zeros(1 << BITS, bool)
        self.maybe[(self.hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def sentence_logits(self, features: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        """The sum of a sentence's features and the bias; a sentence without any is never toxic, however many a text has."""
        out, told = np.full(len(first), self.bias), np.zeros(len(first), bool)
        for h in features if len(self.hashes) else ():
            at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - BITS)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            hit = self.hashes[k] == h[at]
            part = np.searchsorted(first, at[hit], side="right") - 1
            np.add.at(out, part, self.weights[k[hit]])
            told[part] = True
        return np.where(told, out, -1e9)

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's score, and the bytes [start, end) of its worst sentence, the first of equals; -1 without a sentence that tells."""
        features, first, doc, w = sentences(raw, offsets)
        n = len(offsets) - 1
        start, end = np.full(n, -1), np.full(n, -1)
        if not len(first):
            return np.full(n, FLOOR), start, end
        logits = self.sentence_logits(features, first)
        quiet = -np.logaddexp(0, logits)  # log(1 - p) of each sentence
        total = np.bincount(doc, weights=quiet, minlength=n)
        order = np.lexsort((-logits, doc))
        worst = order[np.flatnonzero(np.concatenate([[True], doc[order][1:] != doc[order][:-1]]))]
        worst = worst[logits[worst] > -1e9]
        host, last = doc[worst], np.append(first, len(w.start))[worst + 1] - 1
        start[host], end[host] = w.start[first[worst]] - offsets[host], w.end[last] - offsets[host]
        return 1 - (1 - FLOOR) * np.exp(total), start, end


def tells(df: np.ndarray, n: list[int], least: float) -> np.ndarray:
    """Features whose log odds of toxic documents stand so many standard errors above none."""
    odds = np.log((df[1] + 0.5) / (n[1] + 1)) - np.log((df[0] + 0.5) / (n[0] + 1))
    return (odds > 1.5) & (odds > least * np.sqrt(1 / (df[1] + 0.5) + 1 / (df[0] + 0.5))) & (df[1] >= 4)


def fit(rows: pa.Table, sizes: dict[int, int], epochs: int = 200, rate: float = 0.2, decay: float = 0.01, least: float = 3.2) -> Model:
    """Gradient descent through noisy-or over the features that tell.

    Classes count as often as all labelled rows have them, not as the bounded sample does."""
    silent = Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    y = rows.column("y").to_numpy()
    if len(set(y.tolist())) < 2:
        return silent
    n = [int((y == k).sum()) for k in (0, 1)]
    df, at_doc = np.zeros((2, 1 << BITS)), 0
    for raw, offsets in labelled.chunks(rows.column("text")):
        features, first, doc, w = sentences(raw, offsets)
        own = np.repeat(np.arange(len(w.count)), w.count)
        seen = np.unique(np.concatenate([own[h > 0] << BITS | (h[h > 0] >> np.uint64(64 - BITS)).astype(np.int64) for h in features]))
        kind = y[at_doc + (seen >> BITS)]
        for k in (0, 1):
            df[k] += np.bincount(seen[kind == k] & ((1 << BITS) - 1), minlength=1 << BITS)
        at_doc += len(w.count)
    loose = tells(df, n, least - 1)
    h_, s_, d_, at_doc, at_part = [], [], [], 0, 0
    for raw, offsets in labelled.chunks(rows.column("text")):
        features, first, doc, w = sentences(raw, offsets)
        for h in features:
            at = np.flatnonzero(loose[(h >> np.uint64(64 - BITS)).astype(np.int64)] & (h > 0))
            part = np.searchsorted(first, at, side="right") - 1
            h_.append(h[at])
            s_.append(at_part + part)
            d_.append(at_doc + doc[part])
        at_doc, at_part = at_doc + len(w.count), at_part + len(first)
    h, part, doc = map(np.concatenate, (h_, s_, d_))
    hashes, which = np.unique(h, return_inverse=True)
    pairs = np.unique(np.stack([which, doc]), axis=1) if len(h) else np.zeros((2, 0), np.int64)
    exact = np.stack([np.bincount(pairs[0][y[pairs[1]] == k], minlength=len(hashes)) for k in (0, 1)])
    good = tells(exact, n, least)
    if not good.any():
        return silent
    new = np.cumsum(good) - 1
    use = good[which]
    which, part, doc = new[which[use]], part[use], doc[use]
    hashes = hashes[good]
    parts, one, local = np.unique(part, return_index=True, return_inverse=True)  # sentences that have a telling feature
    host = doc[one]
    w, bias = np.full(len(hashes), 2.0), -2.0
    g2, gb2 = np.full(len(w), 1e-8), 1e-8
    cost = np.array([sizes[0] / n[0], sizes[1] / n[1]])[y]
    cost = cost / cost.sum()
    for _ in range(epochs):
        z = np.bincount(local, weights=w[which], minlength=len(parts)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        q = (1 - FLOOR) * np.exp(np.bincount(host, weights=-np.logaddexp(0, z), minlength=len(y)))
        pull = np.where(y == 1, -q / np.maximum(1 - q, FLOOR), 1.0) * cost
        dz = pull[host] * p
        grad = np.bincount(which, weights=dz[local], minlength=len(w)) + decay * w / len(y)
        g2 += grad * grad
        w -= rate * grad / np.sqrt(g2)
        gb = float(dz.sum())
        gb2 += gb * gb
        bias -= rate * gb / np.sqrt(gb2)
    return Model(hashes, w, float(bias))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 4000) -> Model:
    """per_class bounds the labelled rows that are used."""
    rows, sizes = labelled.training_rows(docs, labels, label, per_class)
    return fit(rows, sizes)


def locate(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentences with at least this probability: id, byte span, score."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.pieces_of(batch, "text", 1 << 20):
                raw, offsets = common.text_bytes(b.column("text"))
                features, first, doc, w = sentences(raw, offsets)
                p = 1 / (1 + np.exp(-np.clip(model.sentence_logits(features, first), -40, 40)))
                at = np.flatnonzero(p >= least)
                last = np.append(first, len(w.start))[at + 1] - 1 if len(at) else at
                base = offsets[doc[at]]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(doc[at])), pa.array(w.start[first[at]] - base), pa.array(w.end[last] - base), pa.array(p[at])], names=["id", "span_start", "span_end", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, span_start long, span_end long, score double").withColumnRenamed("id", id_col)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.5, **kw) -> DataFrame:
    """Scores, and the byte span of the sentence that carries most of each; null where no sentence tells."""
    return labelled.scored(docs, model.score, threshold, more=("span_start", "span_end"), **kw)


def op10_toxicity(spark, sf_dir):
    from cladeflow.runtime import table

    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))

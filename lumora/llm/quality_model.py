"""6. Quality classifier: supervised subword embeddings.

Words, pairs of words and character n-grams hash into one table of learned vectors. A document is the
mean of its features' vectors; a softmax over a linear map of it gives the class. Training is numpy
stochastic gradient descent on a bounded sample. As the map is linear, scoring folds it into the
table: each feature then has one number, and a document's logit is their mean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumora.llm.sampling import drawn, labelled_texts
from lumora.llm.text import _INVERSE, Chunk, filter_docs, map_chunks, powers

BITS, WIDTH, NGRAMS = 18, 16, (2, 3, 4)
#: Labelled documents of each class in the training sample, at most.
PER_CLASS = 1200

_SHIFT = np.uint64(64 - BITS)
_KINDS = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
#: Bucket of a word that follows itself.
AGAIN = 0


def features(chunk: Chunk) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, places in the code points) of each kind of feature; case counts."""
    s, e, doc = chunk.words()
    sums = chunk.sums(folded=False)
    h = chunk.span(sums, s, e)
    out = [((h * _KINDS[0]) >> _SHIFT, s)]
    if len(h) > 1:
        pair = ((h[:-1] ^ (h[1:] * _KINDS[4])) * _KINDS[1]) >> _SHIFT
        pair[h[:-1] == h[1:]] = AGAIN
        near = doc[1:] == doc[:-1]
        out.append((pair[near], s[:-1][near]))
    inside = np.zeros(len(chunk.cp) + 1, np.int8)
    inside[s] += 1
    inside[e] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    run, inv = inside, powers(_INVERSE, len(chunk.cp) + 1)
    for n in range(2, max(NGRAMS) + 1):
        run = run[:-1] & inside[n - 1 :]
        if n in NGRAMS:
            at = np.flatnonzero(run)
            out.append((((sums[at + n] - sums[at]) * inv[at] * _KINDS[n % 3 + 2] + np.uint64(n)) * _KINDS[0] >> _SHIFT, at))
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray  # 2^BITS x WIDTH
    map: np.ndarray  # 2 x WIDTH
    bias: np.ndarray  # 2

    def folded(self) -> tuple[np.ndarray, float]:
        """A number for each bucket and the intercept of the logit of class 1."""
        return (self.vectors @ (self.map[1] - self.map[0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def train(rows: list[tuple[str, int]], shares: tuple[float, float] = (0.5, 0.5), epochs: int = 5, rate: float = 0.5, seed: int = 7) -> QualityModel:
    """Softmax over mean vectors by stochastic gradient descent, one document a step. shares: of the classes in the corpus; the bias is moved from the sample's to these."""
    rng = np.random.default_rng(seed)
    model = QualityModel(rng.normal(0, 0.1, (1 << BITS, WIDTH)).astype(np.float32), rng.normal(0, 0.3, (2, WIDTH)).astype(np.float32), np.zeros(2, np.float32))
    docs = []
    for text, y in rows:
        b, c = np.unique(np.concatenate([x for x, _ in features(Chunk([text]))] or [np.zeros(0, np.uint64)]), return_counts=True)
        docs.append((b.astype(np.int64), (c / max(c.sum(), 1)).astype(np.float32), y))
    steps, total = 0, epochs * max(len(docs), 1)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            b, c, y = docs[i]
            lr = rate * (1 - steps / total)
            steps += 1
            v = model.vectors[b]
            mean = c @ v
            z = model.map @ mean + model.bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y] -= 1
            back = model.map.T @ g
            model.map -= lr * np.outer(g, mean)
            model.bias -= lr * g
            # features of a mean get tiny gradients each; their steps are scaled by the number of features, within bounds
            model.vectors[b] = v - (lr * min(len(b), 200)) * np.outer(c, back)
    if len(rows):
        have = np.bincount([y for _, y in rows], minlength=2) + 1.0
        model.bias += (np.log(np.maximum(shares, 1e-3)) - np.log(have / have.sum())).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    """Trains on at most per_class documents of each label (0, 1), those with the least hash of doc_id; without labels every text scores the prior."""
    labels = labels.where(f"{label} in (0, 1)").select("doc_id", label)
    have = {r[0]: r[1] for r in labels.groupBy(label).count().collect()}
    total = max(sum(have.values()), 1)
    return train(labelled_texts(docs, drawn(labels, label, per_class), label, per_class, ["doc_id"]), (have.get(0, 0) / total, have.get(1, 0) / total) if have else (0.5, 0.5))


def logits(chunk: Chunk, table: np.ndarray, bias: float) -> np.ndarray:
    total, n = np.zeros(chunk.docs), np.zeros(chunk.docs)
    for bucket, at in features(chunk):
        ends = np.searchsorted(at, chunk.starts)
        run = np.concatenate(([0.0], np.cumsum(table[bucket.astype(np.int64)])))
        total += run[ends[1:]] - run[ends[:-1]]
        n += np.diff(ends)
    return total / np.maximum(n, 1) + bias


def quality_scores(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, score (probability of class 1), predicted (1 if score >= threshold).

    Null and empty texts have no features: their score is the prior. Texts are scored whole. Rows are
    scored alone: repeated rows and null ids come back as they are; an empty table gives no rows; further
    columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.folded())

    def score(keys, chunk):
        p = 1 / (1 + np.exp(-np.clip(logits(chunk, *sent.value), -500, 500)))
        return {"doc_id": pa.array(keys, pa.int64()), "score": p, "predicted": (p >= threshold).astype(np.int32)}

    return map_chunks(docs, score, "doc_id long, score double, predicted int")


def good_enough(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least threshold.

    Null and empty texts score the prior, and stay or go with it. Rows are judged alone: repeated rows and
    null ids stay or go each; an empty table gives no rows; further columns, whatever their names, are kept.
    """
    sent, limit = docs.sparkSession.sparkContext.broadcast(model.folded()), float(np.log(threshold / (1 - threshold)))
    return filter_docs(docs, lambda keys, chunk: logits(chunk, *sent.value) >= limit)

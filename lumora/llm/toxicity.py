"""9. Toxicity: cumulative-link ordinal regression over sparse text features.

A text's features are its words (runs of letters, A to Z lower-cased) and their first 4 and 5 letters,
hashed; a feature's value is log(1 + how often it occurs). All thresholds share one weight vector:
P(grade <= k) = sigmoid(t_k - w x). Weights are fitted by proximal gradient steps with an L1 penalty, so
that most are exactly zero; none is negative, as long clean passages don't undo an insult.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumora.llm.sampling import drawn, labelled_texts
from lumora.llm.text import _INVERSE, Chunk, map_chunks, powers

BITS, PREFIXES = 20, (4, 5)
#: Weight of grade 0 in the fit; the other grades share the rest.
CLEAN_SHARE = 0.7
#: Features that the fit starts with, those most correlated with the grade; all others that the penalty lets in follow.
FIRST_FEATURES = 4096
#: Labelled documents of each class in the training sample, at most.
PER_CLASS = 1500

_SHIFT = np.uint64(64 - BITS)
_KINDS = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def features(chunk: Chunk) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, documents) of words and of their beginnings."""
    cp = chunk.cp
    letter = ((cp | np.uint32(32)) - np.uint32(97) <= 25) | (cp >= 0xC0)
    edge = np.diff(np.concatenate(([False], letter)).view(np.int8))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(chunk.starts, s, side="right") - 1
    sums, inv = chunk.sums(folded=True), powers(_INVERSE, len(cp) + 1)
    out = [((chunk.span(sums, s, e) * _KINDS[0]) >> _SHIFT, doc)]
    for i, n in enumerate(PREFIXES, 1):
        longer = e - s > n
        at = s[longer]
        out.append((((sums[at + n] - sums[at]) * inv[at] * _KINDS[i] + np.uint64(n)) * _KINDS[0] >> _SHIFT, doc[longer]))
    return out


def values(chunk: Chunk, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, buckets, log(1 + count)), of buckets with a true entry in active only."""
    found = features(chunk)
    b, d = np.concatenate([x for x, _ in found]).astype(np.int64), np.concatenate([x for _, x in found])
    if active is not None:
        on = active[b]
        b, d = b[on], d[on]
    key, n = np.unique((d << BITS) | b, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), np.log1p(n)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # 2^BITS
    cuts: np.ndarray  # ascending, one fewer than grades
    threshold: float = 0.5  # of P(grade > 0), from which a text counts as toxic

    def grades(self, eta: np.ndarray) -> np.ndarray:
        """Probability of each grade."""
        below = 1 / (1 + np.exp(-np.clip(self.cuts[None, :] - eta[:, None], -500, 500)))
        edge = np.concatenate((np.zeros((len(eta), 1)), below, np.ones((len(eta), 1))), axis=1)
        return np.maximum(np.diff(edge, axis=1), 0)


def train(rows: list[tuple[str, int]], n_grades: int, steps: int = 400, penalty: float = 3e-2, least_docs: int = 3) -> ToxicityModel:
    """Accelerated proximal gradient on the mean negative log-likelihood, grades weighted by CLEAN_SHARE.

    Features of fewer than least_docs texts are left out. Of the others the fit takes in all whose slope at
    the solution exceeds the penalty, in as many turns as that needs: the L1 penalty alone selects.
    """
    y = np.array([g for _, g in rows], np.int64)
    doc, bucket, x = values(Chunk([t for t, _ in rows]))
    used, col = np.unique(bucket, return_inverse=True)
    seen = np.bincount(col) >= least_docs
    keep = seen[col]
    doc, col, x = doc[keep], (np.cumsum(seen) - 1)[col[keep]], x[keep]
    used = used[seen]
    share = np.where(np.arange(n_grades) == 0, CLEAN_SHARE, (1 - CLEAN_SHARE) / (n_grades - 1))
    weigh = (share / np.maximum(np.bincount(y, minlength=n_grades), 1))[y]
    weigh /= weigh.sum()
    # scaled to unit spread
    mean, square, cross = (np.bincount(col, weights=weigh[doc] * v, minlength=len(used)) for v in (x, x * x, x * y[doc]))
    spread = np.sqrt(np.maximum(square - mean**2, 0))
    varies = spread > 1e-6  # what all texts have alike says nothing
    keep, used, cross, mean = varies[col], used[varies], cross[varies], mean[varies]
    doc, col, x, spread = doc[keep], (np.cumsum(varies) - 1)[col[keep]], x[keep], spread[varies]
    x = x / spread[col]
    active = np.zeros(len(used), bool)
    active[np.argsort(-np.abs(cross - mean * (weigh @ y)) / spread, kind="stable")[:FIRST_FEATURES]] = True
    w, cuts = np.zeros(len(used)), np.linspace(0, n_grades - 2, n_grades - 1)
    while True:
        on = active[col]
        w[active], cuts = _fit((np.cumsum(active) - 1)[col[on]], doc[on], x[on], y, weigh, w[active], cuts, steps, penalty)
        d_hi, d_lo = _slopes(np.bincount(doc, weights=w[col] * x, minlength=len(y)), cuts, y, weigh)
        more = ~active & (-np.bincount(col, weights=(d_hi - d_lo)[doc] * x, minlength=len(used)) > penalty * 1.001)
        if not more.any():
            break
        active |= more
    full = np.zeros(1 << BITS)
    full[used] = w / spread
    model = ToxicityModel(full, cuts)
    d, b, v = values(Chunk([t for t, _ in rows]), full != 0)
    model.threshold = best_threshold(1 - model.grades(np.bincount(d, weights=full[b] * v, minlength=len(y)))[:, 0], y > 0)
    return model


def _slopes(eta: np.ndarray, cuts: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How each text's likelihood changes with the threshold above and the one below its grade."""
    edge = np.concatenate(([-np.inf], cuts, [np.inf]))
    hi, lo = (1 / (1 + np.exp(-np.clip(edge[y + i] - eta, -500, 500))) for i in (1, 0))
    p = np.maximum(hi - lo, 1e-9)
    return hi * (1 - hi) / p * weigh, lo * (1 - lo) / p * weigh


def _fit(col: np.ndarray, doc: np.ndarray, x: np.ndarray, y: np.ndarray, weigh: np.ndarray, w: np.ndarray, cuts: np.ndarray, steps: int, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the columns and thresholds, from w and cuts on."""
    v = np.ones(len(w) + 1)  # the largest curvature, by power iteration; thresholds count as a column of ones
    for _ in range(30):
        v /= max(np.linalg.norm(v), 1e-12)
        r = weigh * (np.bincount(doc, weights=v[col] * x, minlength=len(y)) + v[-1])
        v = np.concatenate((np.bincount(col, weights=r[doc] * x, minlength=len(w)), [r.sum()]))
    step = 1 / max(0.5 * np.linalg.norm(v), 1e-12)
    look, cuts_look, momentum = w, cuts, 1.0
    for _ in range(steps):
        d_hi, d_lo = _slopes(np.bincount(doc, weights=look[col] * x, minlength=len(y)), cuts_look, y, weigh)
        g = np.bincount(col, weights=(d_hi - d_lo)[doc] * x, minlength=len(w))
        g_cuts = np.array([d_lo[y == k + 1].sum() - d_hi[y == k].sum() for k in range(len(cuts))])
        new = np.maximum(look - step * (g + penalty), 0)  # no word makes a text less toxic
        new_cuts = np.maximum.accumulate(cuts_look - step * g_cuts)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        push = (momentum - 1) / after
        look, cuts_look = new + push * (new - w), np.maximum.accumulate(new_cuts + push * (new_cuts - cuts) + 1e-6 * np.arange(len(cuts)))
        w, cuts, momentum = new, new_cuts, after
    return w, cuts


def best_threshold(score: np.ndarray, positive: np.ndarray) -> float:
    """In the first gap between scores at which hits' share less false alarms' share is largest; nearer to its upper end, as unseen clean texts are many."""
    o = np.argsort(-score, kind="stable")
    s, p = score[o], positive[o]
    gain = np.cumsum(p) / max(p.sum(), 1) - np.cumsum(~p) / max((~p).sum(), 1)
    gain[:-1][s[:-1] == s[1:]] = -1
    at = int(np.argmax(gain))
    return float(0.75 * s[at] + 0.25 * s[at + 1]) if at + 1 < len(s) else float(s[at])


def graded(rows: list[tuple[str, int]], levels: int = 3) -> list[tuple[str, int]]:
    """Grades for texts that are only labelled toxic or not: 0, or 1 to levels by how many marker words a toxic text has.

    Markers are words of at least three toxic and no clean texts of the sample; the limits are the
    quantiles of their count among its toxic texts.
    """
    y = np.array([t for _, t in rows], np.int64)
    chunk = Chunk([t for t, _ in rows])
    b, d = (x.astype(np.int64) for x in features(chunk)[0])
    key = np.unique((d << BITS) | b)
    d1, b1 = key >> BITS, key & ((1 << BITS) - 1)
    toxic = np.bincount(b1, weights=y[d1] > 0, minlength=1 << BITS)
    marker = (toxic >= 3) & (np.bincount(b1, minlength=1 << BITS) == toxic)
    hits = np.bincount(d[marker[b]], minlength=len(y))
    limits = np.quantile(hits[y > 0], np.arange(1, levels) / levels) if (y > 0).any() else np.zeros(levels - 1)
    grade = np.where(y > 0, 1 + np.searchsorted(limits, hits, side="left"), 0)
    return [(t, int(g)) for (t, _), g in zip(rows, grade, strict=True)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, levels: int = 3) -> ToxicityModel:
    """From labels 0 and 1, on at most per_class documents of each, those with the least hash of doc_id. Without any toxic label every text has grade 0."""
    labels = labels.where(f"{label} in (0, 1)").select("doc_id", label)
    rows = labelled_texts(docs, drawn(labels, label, per_class), label, per_class, ["doc_id"])
    if not any(y for _, y in rows):
        return ToxicityModel(np.zeros(1 << BITS), np.linspace(10, 12, levels))
    return train(graded(rows, levels), levels + 1)


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Per row: doc_id, score (probability of any grade above 0), severity (expected grade), grade (likeliest, the lower of equally likely ones), toxic (1 if score >= the model's threshold).

    Null and empty texts have no features and score what the thresholds alone give. Texts are scored
    whole. Rows are scored alone: repeated rows and null ids come back as they are; an empty table gives
    no rows; further columns are not read.
    """
    on = np.flatnonzero(model.weights)
    sent = docs.sparkSession.sparkContext.broadcast((on, model.weights[on], model.cuts, model.threshold))
    cache: dict[str, tuple] = {}

    def score(keys, chunk):
        if "m" not in cache:
            w = np.zeros(1 << BITS)
            w[sent.value[0]] = sent.value[1]
            cache["m"] = ToxicityModel(w, *sent.value[2:]), w != 0
        m, active = cache["m"]
        d, b, x = values(chunk, active)
        p = m.grades(np.bincount(d, weights=m.weights[b] * x, minlength=chunk.docs))
        any_grade = 1 - p[:, 0]
        return {"doc_id": pa.array(keys, pa.int64()), "score": any_grade, "severity": p @ np.arange(p.shape[1]), "grade": np.argmax(p, axis=1).astype(np.int32), "toxic": (any_grade >= m.threshold).astype(np.int32)}

    return map_chunks(docs, score, "doc_id long, score double, severity double, grade int, toxic int")

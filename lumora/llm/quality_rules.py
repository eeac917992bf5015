"""2. Quality rules: counts of a text, hard limits, then a cascade of rules ordered by rejection per cost.

A rule looks at one document. On a sample of those that pass the hard limits each rule runs over every document; its cost is the
time that took. The rule with the most rejection per cost comes first; each next one is chosen by what it rejects of
the documents that those before it leave. In the cascade, a document that one rule rejects is not shown to the next. The order changes the work only,
never a verdict: a text is kept when no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.text import Chunk, map_chunks, ngram_hashes, pieces

SYMBOLS = "#*$%&|<>"
#: Documents in the sample on which costs and selectivities are estimated (about).
SAMPLE = 2000

_SYMBOL = np.zeros(128, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_DOC = np.uint64(0x9E3779B97F4A7C15)


def counts(chunk: Chunk) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of each document."""
    s, e, doc = chunk.words()
    d = chunk.docs
    sums = chunk.sums(folded=False)
    out = {"n_words": np.bincount(doc, minlength=d), "word_chars": np.bincount(doc, weights=e - s, minlength=d).astype(np.int64)}
    symbol = _SYMBOL[np.minimum(chunk.cp, 127)]
    out["n_symbols"] = np.add.reduceat(symbol.astype(np.int64), chunk.starts[:-1]) if d else np.zeros(0, np.int64)

    ends = np.flatnonzero(chunk.cp == 10)
    begins = np.concatenate(([0], ends[:-1] + 1))
    worded = np.searchsorted(s, ends) > np.searchsorted(s, begins)
    begins, ends = begins[worded], ends[worded]
    of = np.searchsorted(chunk.starts, begins, side="right") - 1
    lines = chunk.span(sums, begins, ends) + of.astype(np.uint64) * _DOC
    first = np.unique(lines, return_index=True)[1]
    out["n_lines"] = np.bincount(of, minlength=d)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(of[first], minlength=d)

    again = np.zeros(len(s), bool)
    if len(s) >= 3:
        g = ngram_hashes(chunk.span(sums, s, e), 3)
        at = np.flatnonzero(doc[2:] == doc[:-2])
        _, inverse, times = np.unique(g[at] + doc[at].astype(np.uint64) * _DOC, return_inverse=True, return_counts=True)
        at = at[times[inverse] > 1]
        for i in range(3):
            again[at + i] = True
    out["n_repeat_words"] = np.bincount(doc[again], minlength=d)
    return out


def _share(cp: np.ndarray, low: str, high: str) -> int:
    return int(np.count_nonzero((cp - np.uint32(ord(low))) <= ord(high) - ord(low)))


#: name: rejects(code points, counts of the document). Shares are compared in whole numbers.
RULES: dict[str, Callable[[np.ndarray, dict], bool]] = {
    "symbols": lambda cp, c: 10 * c["n_symbols"] > c["n_words"],
    "word_length": lambda cp, c: not 2 * c["n_words"] <= c["word_chars"] <= 15 * c["n_words"],
    "same_lines": lambda cp, c: 10 * c["n_dup_lines"] > 3 * c["n_lines"],
    "capitals": lambda cp, c: _share(cp, "A", "Z") > _share(cp, "a", "z"),
    "exclamations": lambda cp, c: 5 * int(np.count_nonzero((cp == 33) | (cp == 63))) > c["n_words"],
    "digits": lambda cp, c: 5 * _share(cp, "0", "9") > c["word_chars"],
    "few_letters": lambda cp, c: 2 * int(np.count_nonzero(((cp | np.uint32(32)) - np.uint32(97) <= 25) | (cp >= 128))) < c["word_chars"],
}


def hard_limits(c: dict[str, np.ndarray], min_words: int, max_repeat_percent: int) -> np.ndarray:
    """Which documents fail them."""
    return (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_percent * c["n_words"])


def estimates(docs: DataFrame, rules=RULES, sample: int = SAMPLE, min_words: int = 50, max_repeat_percent: int = 50) -> tuple[dict[str, float], dict[int, int]]:
    """Seconds a document of each rule, and how many documents each set of rules (bit i: the i-th) rejects: of about sample documents, drawn by a hash of doc_id, those within the hard limits."""
    every = max(1, docs.count() // sample)
    columns = ["rule", "seconds", "rejects", "n"]

    def run(batches):
        seconds, sets, n = np.zeros(len(rules)), {}, 0
        for _, chunk in pieces(batches):
            c = counts(chunk)
            alive = np.flatnonzero(~hard_limits(c, min_words, max_repeat_percent))
            rejects = np.zeros(len(alive), np.int64)
            n += len(alive)
            for k, f in enumerate(rules.values()):
                t = time.perf_counter()
                hits = [bool(f(*_one(chunk, c, i))) for i in alive]
                seconds[k] += time.perf_counter() - t
                rejects |= np.array(hits, np.int64).reshape(-1) << k
            for r, m in zip(*np.unique(rejects, return_counts=True), strict=True):
                sets[int(r)] = sets.get(int(r), 0) + int(m)
        yield pa.RecordBatch.from_arrays([pa.array(list(rules)), pa.array(seconds), pa.nulls(len(rules), pa.int64()), pa.array([n] * len(rules), pa.int64())], columns)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(sets), pa.string()), pa.nulls(len(sets), pa.float64()), pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.int64())], columns)

    drawn = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    rows = drawn.mapInArrow(run, "rule string, seconds double, rejects long, n long").groupBy("rule", "rejects").agg(F.sum("seconds").alias("s"), F.sum("n").alias("n")).collect()
    return {r.rule: r.s / max(r.n, 1) for r in rows if r.rule is not None}, {r.rejects: r.n for r in rows if r.rule is None}


def order(found: dict[str, tuple[float, float]], rules=RULES) -> list[str]:
    """Rules by rejection per cost, of (cost, share rejected); by name where equal."""
    return sorted(rules, key=lambda r: (-found.get(r, (1.0, 0.0))[1] / max(found.get(r, (1.0, 0.0))[0], 1e-9), r))


def cascade_order(seconds: dict[str, float], sets: dict[int, int], rules=RULES) -> list[str]:
    """Rule by rule, the one with the most rejection per cost among the documents that are left."""
    place, left, out = {r: k for k, r in enumerate(rules)}, dict(sets), []
    while len(out) < len(place):
        n = max(1, sum(left.values()))
        found = {r: (seconds.get(r, 1.0), sum(m for s, m in left.items() if s >> place[r] & 1) / n) for r in place if r not in out}
        out.append(order(found, list(found))[0])
        left = {s: m for s, m in left.items() if not s >> place[out[-1]] & 1}
    return out


def _one(chunk: Chunk, c: dict[str, np.ndarray], i: int) -> tuple[np.ndarray, dict]:
    return chunk.cp[chunk.starts[i] : chunk.starts[i + 1] - 1], {k: int(v[i]) for k, v in c.items()}


def quality_rules(docs: DataFrame, rules=RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    Texts that fail a hard limit (fewer than min_words words, or too many words in repeated 3-word
    windows) skip the cascade. rejected_by names the rule that came first in this run's order, else null.
    Null and empty texts have no words, so they fail. Rows are judged alone: repeated rows and null ids
    come back as they are; an empty table gives no rows; further columns are not read.
    """
    names = cascade_order(*estimates(docs, rules, SAMPLE, min_words, max_repeat_percent), rules)

    def judge(keys, chunk):
        c = counts(chunk)
        failed = hard_limits(c, min_words, max_repeat_percent)
        by: list[str | None] = [None] * chunk.docs
        alive = [(i, *_one(chunk, c, i)) for i in np.flatnonzero(~failed)]
        for name in names:
            rest = []
            for x in alive:
                if rules[name](x[1], x[2]):
                    by[x[0]] = name
                else:
                    rest.append(x)
            alive = rest
        kept = np.zeros(chunk.docs, bool)
        kept[[x[0] for x in alive]] = True
        return {"doc_id": pa.array(keys, pa.int64()), "base_failed": failed, "kept": kept, "rejected_by": pa.array(by, pa.string())} | {k: c[k].astype(np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}

    return map_chunks(docs, judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")

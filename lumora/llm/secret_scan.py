"""8. Secret scans: fixed patterns, and a character convolutional network over every further candidate.

The patterns (assignments, access keys, long hex) always count. A candidate is any run of `least` or more of
the characters that keys are made of, with a digit in it or not, and any of `least_digit` or more with one. The network reads the candidate with its
context, a long one in overlapping windows of which the highest probability counts: learned character vectors, one layer of convolutions, the maximum over positions, a logistic
output. It is trained in numpy on labelled findings: what the patterns find, and made keys of kinds that they don't know, put
into the surroundings of other candidates, against other candidates of a bounded sample. Its output is calibrated by a logistic fit on one part kept apart, and
the threshold is the highest one that keeps the recall asked for on another such part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.sampling import least_of_each
from lumora.llm.text import Chunk, pieces

KINDS = ("assign", "access", "hex")
MODEL_KIND = "model"
BEFORE, INSIDE, AFTER = 24, 40, 16
VECTOR, REACH, FILTERS = 8, 5, 16
#: Documents in which other candidates for training are looked for, about (findings are looked for in all), and candidates of each label, at most.
SAMPLE_DOCS, PER_LABEL = 20_000, 1500
#: Default lengths of a candidate without, and with a digit; shorter ones are words and numbers of every text.
LEAST, LEAST_DIGIT = 16, 10


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
_KEYLIKE = np.zeros(129, bool)
_KEYLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "+/_=-")]] = True
_HEX = np.zeros(129, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True


def _runs(on: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([False], on, [False])).view(np.int8))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = e - s >= least
    return s[long], e[long]


def base_findings(chunk: Chunk) -> list[tuple[int, int, int]]:
    """(kind, start, end) in the chunk of what the patterns find."""
    cp = np.minimum(chunk.cp, 128)
    out = [(2, a, b) for a, b in zip(*(x.tolist() for x in _runs(_HEX[cp], 24)), strict=True)]
    if "AKIA" in chunk.text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(chunk.text) if m.end() - m.start() >= 20]
    signs = np.flatnonzero((cp == 58) | (cp == 61))
    for d in np.unique(np.searchsorted(chunk.starts, signs, side="right") - 1).tolist():
        at = int(chunk.starts[d])
        out += [(0, at + m.start(), at + m.end()) for m in ASSIGN.finditer(chunk.texts[d]) if m.end(2) - m.start(2) >= 6]
    return out


def candidates(chunk: Chunk, least: int = LEAST, least_digit: int = LEAST_DIGIT) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the runs the network looks at."""
    s, e = _runs(_KEYLIKE[np.minimum(chunk.cp, 128)], min(least, least_digit))
    digits = np.concatenate(([0], np.cumsum((chunk.cp - np.uint32(48)) <= 9)))
    some = (e - s >= least) | ((e - s >= least_digit) & (digits[e] > digits[s]))
    return s[some], e[some]


_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def made_key(rng: np.random.Generator) -> str:
    """A key of a kind that the patterns don't know."""
    some = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    mixed, hexes = _LETTERS + _LETTERS.upper() + _DIGITS, _DIGITS + "abcdef"
    n = int(rng.integers(20, 44))
    kinds = (
        lambda: some(mixed, n), lambda: some(mixed + "+/", n) + "=" * int(rng.integers(1, 3)), lambda: "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12)),
        lambda: "sk_live_" + some(mixed, 24), lambda: "ghp_" + some(mixed, 36), lambda: "AIza" + some(mixed + "-_", 35), lambda: some(_LETTERS.upper() + _DIGITS, n),
        lambda: some(mixed, int(rng.integers(12, 18))), lambda: some(_DIGITS, 3) + "-" + some(mixed, 12) + "_" + some(mixed, 8),
    )
    return kinds[int(rng.integers(len(kinds)))]()


def injected(others: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """Windows of n made keys in the surroundings of other candidates (windows; without any, between blanks)."""
    rng = np.random.default_rng(seed)
    plain = lambda codes: "".join(chr(c) if 32 <= c < 127 else " " for c in codes)
    texts, at = [], []
    for i in range(n):
        x = others[i % len(others)] if len(others) else np.full(BEFORE + INSIDE + AFTER, 32)
        before, key = plain(x[:BEFORE]), made_key(rng)
        texts.append(before + key + plain(x[-AFTER:]))
        at.append((len(before), len(key)))
    chunk = Chunk(texts)
    s = chunk.starts[:-1] + np.array([a for a, _ in at], np.int64)
    return windows(chunk, s, s + np.array([k for _, k in at], np.int64))


def windows(chunk: Chunk, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Codes (0 to 129) of the context before, the candidate's first and last characters, and the context after, within its document."""
    cp = np.concatenate((np.minimum(chunk.cp, 128), [129])).astype(np.int16)
    doc = np.searchsorted(chunk.starts, s, side="right") - 1
    low, high = chunk.starts[doc][:, None], (chunk.starts[doc + 1] - 1)[:, None]
    half = INSIDE // 2
    pick = lambda at, lo, hi: cp[np.where((at >= lo) & (at < hi), at, len(cp) - 1)]
    return np.concatenate((pick(s[:, None] + np.arange(-BEFORE, 0), low, high), pick(s[:, None] + np.arange(half), s[:, None], e[:, None]), pick(e[:, None] + np.arange(-half, 0), s[:, None], e[:, None]), pick(e[:, None] + np.arange(AFTER), low, high)), axis=1)


def slid(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that the network reads and the candidate each is of: the candidates, and for those longer than INSIDE all their parts of INSIDE characters, half overlapping."""
    step = INSIDE // 2
    n = np.where(e - s > INSIDE, -(-(e - s - INSIDE) // step) + 1, 0)
    of = np.repeat(np.arange(len(s)), n)
    turn = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    low = np.minimum(s[of] + turn * step, e[of] - INSIDE)
    return np.concatenate((s, low)), np.concatenate((e, low + INSIDE)), np.concatenate((np.arange(len(s)), of))


@dataclass
class CharCnn:
    vectors: np.ndarray  # 130 x VECTOR
    filters: np.ndarray  # REACH * VECTOR x FILTERS
    shift: np.ndarray
    out: np.ndarray
    bias: float = 0.0
    scale: float = 1.0  # calibration of the logit
    offset: float = 0.0
    threshold: float = 2.0  # of the calibrated probability; over 1: nothing passes
    least: int = LEAST  # lengths of the candidates that it reads
    least_digit: int = LEAST_DIGIT

    def forward(self, x: np.ndarray) -> tuple:
        v = self.vectors[x]
        w = np.lib.stride_tricks.sliding_window_view(v, REACH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, REACH * VECTOR)
        h = w @ self.filters + self.shift
        at = h.argmax(axis=1)
        top = np.take_along_axis(h, at[:, None, :], axis=1)[:, 0]
        pooled = np.maximum(top, 0)
        return w, at, pooled, pooled @ self.out + self.bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.forward(x[i : i + 512])[3] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.offset, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, recall: float = 0.98, epochs: int = 12, seed: int = 3) -> CharCnn:
    """Adam on the logistic loss, classes weighing alike. Of every five findings three train, one sets the threshold, one calibrates. Fewer than ten findings of either label: a network that adds nothing."""
    rng = np.random.default_rng(seed)
    net = CharCnn(rng.normal(0, 0.3, (130, VECTOR)), rng.normal(0, 0.2, (REACH * VECTOR, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, FILTERS))
    if min((y == 1).sum(), (y == 0).sum()) < 10:
        return net
    place = np.zeros(len(y), np.int64)
    for label in (0, 1):
        place[y == label] = np.arange((y == label).sum())
    apart, limits = place % 5 == 4, place % 5 == 3
    xt, yt = x[~apart & ~limits], y[~apart & ~limits]
    weigh = np.where(yt == 1, 0.5 / (yt == 1).mean(), 0.5 / (yt == 0).mean())
    names = ("vectors", "filters", "shift", "out", "bias")
    m1, m2, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
    for _ in range(epochs):
        turn = rng.permutation(len(xt))
        for i in range(0, len(turn), 128):
            b = turn[i : i + 128]
            w, at, pooled, z = net.forward(xt[b])
            g = (1 / (1 + np.exp(-z)) - yt[b]) * weigh[b] / len(b)
            g_pool = g[:, None] * net.out * (pooled > 0)
            chosen = np.take_along_axis(w, at[:, :, None], axis=1)  # rows x FILTERS x REACH * VECTOR
            back = (g_pool[:, :, None] * net.filters.T[None]).reshape(len(b), FILTERS, REACH, VECTOR)
            codes = xt[b][np.arange(len(b))[:, None, None], at[:, :, None] + np.arange(REACH)]
            g_vec = np.zeros_like(net.vectors)
            np.add.at(g_vec, codes.ravel(), back.reshape(-1, VECTOR))
            grads = {"vectors": g_vec, "filters": np.einsum("bf,bfk->kf", g_pool, chosen), "shift": g_pool.sum(axis=0), "out": g @ pooled, "bias": g.sum()}
            step += 1
            for n in names:
                m1[n], m2[n] = 0.9 * m1[n] + 0.1 * grads[n], 0.999 * m2[n] + 0.001 * grads[n] ** 2
                setattr(net, n, getattr(net, n) - 0.01 * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.999**step)) + 1e-8))
    z = net.forward(x[apart])[3]
    a, c = 1.0, 0.0
    for _ in range(500):  # logistic calibration, slightly drawn to a slope of 1
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -500, 500)))
        a -= 0.05 * (((p - y[apart]) * z).mean() + 0.01 * (a - 1))
        c -= 0.05 * (p - y[apart]).mean()
    net.scale, net.offset = float(a), float(c)
    found = np.sort(net.probability(x[limits & (y == 1)]))
    net.threshold = float(found[int((1 - recall) * len(found))])
    return net


def labelled_candidates(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, per_label: int = PER_LABEL, least: int = LEAST, least_digit: int = LEAST_DIGIT) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels for training: 1 for candidates that meet the patterns' findings, from all documents; 0 for those that meet none, from about sample_docs documents drawn by a hash of doc_id."""
    every = max(1, docs.count() // sample_docs)

    def run(batches):
        for b in batches:
            drawn, at = np.array(b.column("drawn").to_pylist(), bool), 0
            for keys, chunk in pieces(iter([b])):
                hit = np.zeros(len(chunk.cp) + 1, np.int32)
                for _, low, high in base_findings(chunk):
                    hit[low] += 1
                    hit[high] -= 1
                hit = np.concatenate(([0], np.cumsum(np.cumsum(hit[:-1]) > 0)))
                s, e = candidates(chunk, least, least_digit)
                found = hit[e] > hit[s]
                some = found | drawn[at : at + len(keys)][np.searchsorted(chunk.starts, s, side="right") - 1]
                at += len(keys)
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(found[some].astype(np.int32)), pa.array([r.tobytes() for r in windows(chunk, s[some], e[some])], pa.binary())], ["label", "x"])

    rows = docs.select("doc_id", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).alias("drawn")).mapInArrow(run, "label int, x binary")
    rows = least_of_each(rows.distinct().withColumn("h", F.xxhash64("x")), "label", "h", per_label).collect()
    rows.sort(key=lambda r: (-r.label, r.h, r.x))
    width = BEFORE + INSIDE + AFTER
    return np.array([np.frombuffer(r.x, np.int16) for r in rows], np.int16).reshape(-1, width), np.array([r.label for r in rows], np.int64)


def fit(docs: DataFrame, least: int = LEAST, least_digit: int = LEAST_DIGIT, made: int = PER_LABEL // 2) -> CharCnn:
    """A network for documents: it learns from what the patterns find in all of them, from made keys, and from other candidates of a bounded sample.

    A corpus without findings, or with few other candidates, trains one all the same: on made keys alone, against repeated
    candidates, or against long words where there is none.
    """
    x, y = labelled_candidates(docs, least=least, least_digit=least_digit)
    others = x[y == 0]
    if len(others) < 10:
        words = Chunk([f"{_LETTERS[i % 20 : i % 20 + 6] * 3} {_LETTERS[i % 11 : i % 11 + 9] * 2} and" for i in range(10)])
        others = np.resize(others, (10, x.shape[1])) if len(others) else windows(words, *candidates(words, 16, 16))
    x = np.concatenate((x[y == 1], injected(others, made), others))
    net = train(x, (np.arange(len(x)) < len(x) - len(others)).astype(np.int64))
    net.least, net.least_digit = least, least_digit
    return net


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def find_secrets(docs: DataFrame, model: CharCnn, *keep: str, out: str = "spans") -> DataFrame:
    """Per row: doc_id, keep's columns, and out: the spans (kind, start, end in code points, score), by start, then kind as listed.

    The patterns' spans have score 1; those the network adds overlap none of them. Of two spans with one
    start the kind listed first comes first. A null or empty text has no spans. Texts are scanned whole. Rows are scanned alone: repeated rows and null ids come back as
    they are; an empty table gives no rows; columns that keep doesn't name are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            at = 0
            for keys, chunk in pieces(iter([b])):
                found = [(*f, 1.0) for f in base_findings(chunk)]
                taken = np.zeros(len(chunk.cp) + 1, np.int32)
                for _, x, y, _ in found:
                    taken[x] += 1
                    taken[y] -= 1
                taken = np.concatenate(([0], np.cumsum(np.cumsum(taken[:-1]) > 0)))
                s, e = candidates(chunk, sent.value.least, sent.value.least_digit)
                free = taken[e] == taken[s]
                s, e = s[free], e[free]
                p = np.zeros(len(s))
                low, high, of = slid(s, e)
                for i in range(0, len(low), 4096):
                    part_p = sent.value.probability(windows(chunk, low[i : i + 4096], high[i : i + 4096]))
                    np.maximum.at(p, of[i : i + 4096], part_p)
                good = p >= sent.value.threshold
                found += [(len(KINDS), int(x), int(y), float(z)) for x, y, z in zip(s[good], e[good], p[good], strict=True)]
                spans: list[list] = [[] for _ in keys]
                for k, x, y, z in sorted(found, key=lambda f: (f[1], f[0])):
                    d = int(np.searchsorted(chunk.starts, x, side="right")) - 1
                    low = int(chunk.starts[d])
                    spans[d].append({"kind": (*KINDS, MODEL_KIND)[k], "start": x - low, "end": y - low, "score": z})
                part = b.slice(at, len(keys))
                at += len(keys)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", *keep)] + [pa.array(spans, kind)], ["doc_id", *keep, out])

    kinds = dict(docs.dtypes)
    columns = list(dict.fromkeys(["doc_id", "text", *keep]))
    return docs.select(*columns).mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}", *(f"`{c}` {kinds[c]}" for c in keep), f"`{out}` {SPANS}"]))


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, model: CharCnn, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span of text replaced by mark; all rows and other columns stay, n_chars (if there) follows the text.

    Overlapping spans become one mark. Null and empty texts stay as they are. Rows are changed alone:
    repeated rows and null ids come back each; an empty table gives no rows; columns may have any names.
    """
    spans = "found"
    while spans in docs.columns:
        spans += "_"
    out = find_secrets(docs, model, *(c for c in docs.columns if c != "doc_id"), out=spans)
    cut = lambda start, length: F.substring(F.col("text"), (start + 1).cast("int"), length)
    piece = F.aggregate(
        spans,
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["done"], cut(a["at"], (s["start"] - a["at"]).cast("int")), F.lit(mark))).otherwise(a["done"]).alias("done"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
        lambda a: F.concat(a["done"], cut(a["at"], F.lit(2**31 - 1))),
    )
    out = out.withColumn("text", F.when(F.size(spans) > 0, piece).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)

"""Whole-text tokenising and hashing over Arrow batches, shared by the text operators.

A chunk is a run of documents joined into one array of code points. Words are runs of characters other
than space and U+0009 to U+000D. Hashes of words and of character n-grams come from one running
polynomial sum, so a batch costs a handful of numpy passes and no Python loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumora.sources.shared import delete, drop, kept, shared_dir  # noqa: F401  for the operators

#: Characters that a chunk aims at: the working arrays of a chunk then stay near the CPU's caches.
CHUNK_CHARS = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240607).integers(0, 1 << 63, 1 << 16, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _CODES.copy()
_FOLDED[65:91] = _CODES[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, CHUNK_CHARS * 2), base, np.uint64)
        x[0] = 1
        have = _powers[base] = np.multiply.accumulate(x)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Chunk:
    """Documents as one array of code points; starts[i]:starts[i + 1] - 1 are document i's (a line feed follows each)."""

    def __init__(self, texts: list[str | None]):
        self.texts = [t or "" for t in texts]
        self.text = "\n".join(self.texts) + "\n"
        self.cp = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in self.texts]))).astype(np.int64)
        self.docs = len(texts)
        self._words = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each word."""
        if self._words is None:
            gap = (self.cp == 32) | ((self.cp - np.uint32(9)) <= 4)
            edge = np.diff(np.concatenate(([True], gap)).view(np.int8))
            s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            at = np.searchsorted(s, self.starts)
            self._words = s, e, np.repeat(np.arange(self.docs), np.diff(at))
            self.word_at = at
        return self._words

    def word_hashes(self, folded: bool) -> np.ndarray:
        s, e, _ = self.words()
        return self.span(self.sums(folded), s, e)

    def sums(self, folded: bool) -> np.ndarray:
        """Running sums; span() makes hashes of them. folded: A to Z count as a to z."""
        cp = self.cp
        codes = _FOLDED if folded else _CODES
        v = codes[np.minimum(cp, 65535)]
        if len(cp) and int(cp.max()) > 65535:
            high = cp > 65535
            v[high] = mix(cp[high].astype(np.uint64) + np.uint64(1 << 40)) | np.uint64(1)
        v *= powers(_BASE, len(cp))
        out = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum(v, out=out[1:])
        return out

    def span(self, sums: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """64-bit hashes of the spans s:e."""
        h = sums[e] - sums[s]
        h *= powers(_INVERSE, len(self.cp) + 1)[s]
        h += (e - s).astype(np.uint64)
        return mix(h)


_PLACES = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x9FB21C651E98DF25], np.uint64)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (n up to 5)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    x = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        x += (words[i : len(words) - n + 1 + i] ^ _PLACES[i]) * (_PLACES[(i + n) % 5] | np.uint64(1))
        x = x ^ (x >> np.uint64(29))
    return mix(x + np.uint64(n))


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """The distinct n-word shingles of one document, sorted; of fewer words the whole sequence as one; of none an empty array."""
    if 0 < len(words) < n:
        return ngram_hashes(words, len(words))
    return np.unique(ngram_hashes(words, n))


#: Rows of a batch that become Python strings at a time.
SLICE = 64


def pieces(batches: Iterator[pa.RecordBatch], key: str = "doc_id", text: str = "text", chars: int = CHUNK_CHARS) -> Iterator[tuple[list, Chunk]]:
    """Keys and chunks of about chars characters, whole documents each."""
    for batch in batches:
        k, t = batch.column(key), batch.column(text)
        keys, texts, size = [], [], 0
        for i in range(0, batch.num_rows, SLICE):
            for one, value in zip(k.slice(i, SLICE).to_pylist(), t.slice(i, SLICE).to_pylist(), strict=True):
                keys.append(one)
                texts.append(value)
                size += len(value) if value else 0
                if size >= chars:
                    yield keys, Chunk(texts)
                    keys, texts, size = [], [], 0
        if keys:
            yield keys, Chunk(texts)
        del batch, k, t, keys, texts
        release()


def release() -> None:
    """Gives freed memory back to the system, where the C library can: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_chunks(docs: DataFrame, f: Callable[[list, Chunk], dict], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """f makes columns (lists or arrays) of each chunk of the two columns that are read."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        for keys, chunk in pieces(batches, key, text):
            out = f(keys, chunk)
            if out is not None and len(out[names[0]]):
                yield pa.RecordBatch.from_arrays([pa.array(out[n]) for n in names], names)

    return docs.select(key, text).mapInArrow(run, schema)


def filter_docs(docs: DataFrame, f: Callable[[list, Chunk], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, for which f says true."""

    def run(batches):
        for b in batches:
            keep = [f(keys, chunk) for keys, chunk in pieces(iter([b]), key, text)]
            if keep and (mask := np.concatenate(keep)).any():
                yield b.filter(pa.array(mask.astype(bool)))

    return docs.mapInArrow(run, docs.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

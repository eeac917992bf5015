"""10. Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are partitioned by the number of their shingles, each class at most half as large again as
its smallest. For a class, every document is covered by windows of one and a half times the class's
largest size (three adjacent half blocks), so that a copied item lies wholly within one window whatever
the document's length; a whole document's signature would drown it. An item is a candidate for a document
when one of HASHES minima agrees in some window. A window that holds three quarters of an item misses it
with a chance under 2e-5. Candidates are verified by the exact containment of the item's shingles in
the whole document.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.text import Chunk, filter_docs, kept, mix, ngram_hashes, pieces

HASHES = 32
#: Characters of test items in one pass over the documents; more items take more passes.
ITEM_CHARS = 8_000_000

_SALTS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _permuted(h: np.ndarray, i: int) -> np.ndarray:
    x = h * _SALTS[i]
    return x ^ (x >> np.uint64(32))


def _item_sets(chunk: Chunk, n: int) -> list[tuple[int, np.ndarray]]:
    """(words of a shingle, distinct shingles) of each text: n, or all its words if it has fewer."""
    s, e, _ = chunk.words()
    h, at = chunk.span(chunk.sums(folded=True), s, e), chunk.word_at
    out = []
    for i in range(chunk.docs):
        w = h[at[i] : at[i + 1]]
        k = min(n, len(w))
        out.append((k, np.unique(ngram_hashes(w, k)) if k else np.zeros(0, np.uint64)))
    return out


class ItemIndex:
    """Items of one pass by shingle length and size class, with their minima."""

    def __init__(self, block: list, n: int):
        sets = _item_sets(Chunk([t for _, t in block]), n)
        self.items = [(i, k, x) for (i, _), (k, x) in zip(block, sets, strict=True) if len(x)]
        self.classes: dict[tuple[int, int], list] = {}
        groups: dict[tuple[int, int], list[int]] = {}
        for at, (_, k, x) in enumerate(self.items):
            low = 1
            while len(x) > low * 3 // 2 + 1:
                low = low * 3 // 2 + 1
            groups.setdefault((k, low * 3 // 2 + 1), []).append(at)
        for key, members in groups.items():
            tables = []
            for f in range(HASHES):
                m = np.array([_permuted(self.items[i][2], f).min() for i in members], np.uint64)
                o = np.argsort(m, kind="stable")
                tables.append((m[o], np.array(members)[o]))
            self.classes[key] = tables

    def contained(self, chunk: Chunk, percent: int) -> list[tuple]:
        """(document's place, item_id, shingles shared, shingles of the item) of each item that a document holds."""
        s, e, doc = chunk.words()
        h = chunk.span(chunk.sums(folded=True), s, e)
        grams = {}
        for k in sorted({k for _, k, _ in self.items}):
            inside = np.flatnonzero(doc[k - 1 :] == doc[: len(doc) - k + 1]) if len(doc) >= k else np.zeros(0, np.int64)
            grams[k] = (ngram_hashes(h, k)[inside], doc[inside]) if len(inside) else (np.zeros(0, np.uint64), inside)
        rows = []
        for d, j in sorted(self.candidates(grams, chunk.docs)):
            item, k, x = self.items[j]
            g, of = grams[k]
            shared = int(np.isin(x, g[np.searchsorted(of, d) : np.searchsorted(of, d, side="right")]).sum())
            if 100 * shared >= percent * len(x):
                rows.append((d, item, shared, len(x)))
        return rows

    def candidates(self, grams: dict[int, tuple[np.ndarray, np.ndarray]], docs: int) -> set[tuple[int, int]]:
        """(document, place of item) pairs. grams: hashes and their documents, by shingle length."""
        found: set[tuple[int, int]] = set()
        for k, (h, doc) in grams.items():
            classes = [(size, t) for (kk, size), t in self.classes.items() if kk == k]
            if not len(h) or not classes:
                continue
            starts = np.searchsorted(doc, np.arange(docs))
            within = np.arange(len(h)) - starts[doc]
            laid = []
            for size, tables in classes:
                half = -(-size // 2)
                cut = np.flatnonzero(within % half == 0)
                of = doc[cut]
                laid.append((cut, of, of[1:] == of[:-1], tables))
            for f in range(HASHES):
                x = _permuted(h, f)
                for cut, of, same, tables in laid:
                    low = np.minimum.reduceat(x, cut)
                    two = low.copy()
                    two[:-1] = np.where(same, np.minimum(low[:-1], low[1:]), low[:-1])
                    three = two.copy()
                    three[:-1] = np.where(same, np.minimum(low[:-1], two[1:]), low[:-1])
                    table, members = tables[f]
                    at = np.searchsorted(table, three)
                    for w in np.flatnonzero(table[np.minimum(at, len(table) - 1)] == three):
                        j = at[w]
                        while j < len(table) and table[j] == three[w]:
                            found.add((int(of[w]), int(members[j])))
                            j += 1
        return found


def contained(docs: DataFrame, items: DataFrame, percent: int = 75, words: int = 5) -> DataFrame:
    """doc_id, item_id, n_shared, n_item for each item of which a document holds percent of the shingles or more.

    Words are lower-cased in A to Z. An item of fewer than words words is one shingle, its whole
    sequence; an item or document without words (null, empty, blank) is in no row. Rows that repeat give
    repeated rows; null ids are carried. Further columns of either table are not read. Items go to all
    executors in blocks of about ITEM_CHARS characters, each different text once, one pass over the documents for each block; the driver
    holds one block at a time.
    """
    texts = _numbered(items)
    out = None
    for i, n in _passes(texts):
        part = _one_pass(docs, _block(texts, i, n), percent, words)
        if n > 1:  # written, so that only one pass's items are alive
            part = kept(part, "contained")
        out = part if out is None else out.union(part)
    return out.join(items.select("item_id", "text").join(texts, "text").select("k", "item_id"), "k").select("doc_id", "item_id", "n_shared", "n_item")


def without_items(docs: DataFrame, items: DataFrame, percent: int = 75, words: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, that hold none of the items in the sense of contained().

    Texts without words (null, empty, blank) hold nothing and stay; so do all rows where there are no items.
    Rows are judged alone: repeated rows and null ids stay or go each; an empty table gives no rows;
    further columns, whatever their names, are kept.
    """
    texts = _numbered(items)
    for i, n in _passes(texts):
        sent, token = docs.sparkSession.sparkContext.broadcast(_block(texts, i, n)), uuid.uuid4().hex

        def clean(keys, chunk, sent=sent, token=token):
            keep = np.ones(chunk.docs, bool)
            keep[[d for d, *_ in _index(token, sent, words).contained(chunk, percent)]] = False
            return keep

        docs = filter_docs(docs, clean)
        if n > 1:
            docs = kept(docs, "clean")
    return docs


_indexes: dict[str, ItemIndex] = {}


def _index(token: str, sent, words: int) -> ItemIndex:
    """A worker's index of the block sent under this name, kept for its next tasks."""
    if token not in _indexes:
        _indexes.clear()
        _indexes[token] = ItemIndex(sent.value, words)
    return _indexes[token]


def _numbered(items: DataFrame) -> DataFrame:
    """text, k: each different text with a number."""
    return kept(items.where("text is not null").select("text").distinct().withColumn("k", F.monotonically_increasing_id()), "items")


def _passes(texts: DataFrame) -> list[tuple[int, int]]:
    """(number, how many) of each pass: texts are dealt to passes by a hash, about ITEM_CHARS characters each."""
    n = max(1, -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // ITEM_CHARS))
    return [(i, n) for i in range(n)]


def _block(texts: DataFrame, i: int, n: int) -> list[tuple]:
    return [(r.k, r.text) for r in texts.where(F.pmod(F.xxhash64("k"), F.lit(n)) == i).select("k", "text").collect()]


def _one_pass(docs: DataFrame, block: list, percent: int, n: int) -> DataFrame:
    sent, token = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches):
        index = _index(token, sent, n)
        for keys, chunk in pieces(batches):
            rows = [(keys[d], k, shared, size) for d, k, shared, size in index.contained(chunk, percent)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "k", "n_shared", "n_item"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, k long, n_shared long, n_item long")

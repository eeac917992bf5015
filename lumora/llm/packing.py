"""5. Packing: tokens into sequences of fixed size by the online sum-of-squares rule.

Each task packs the documents of its partition as they come. A level array counts the open sequences at
each fill level; a document goes to the level (or a new sequence) that leaves the smallest sum of squared
counts, ties to the fullest. Documents longer than a sequence first fill whole ones. What is still open
at a task's end is joined and cut anew into full sequences, and the last tokens into sequences whose
lengths are powers of two, which need no padding.

The ids are those that the tokenizer gives for the whole text. Where its vocabulary drops white space, no
token crosses a space, nor the border between a Latin letter and ASCII punctuation other than an
apostrophe: such parts are encoded once each by the tokenizer, and a worker keeps their ids. The
vocabulary's own added tokens, where they stand in a text, are parts of their own.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lumora.llm.text import Chunk, pieces

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
_NAMES = [x.split(" ")[0] for x in SCHEMA.split(", ")]


#: Distinct parts whose ids a worker keeps; beyond that it starts anew.
CACHED_PARTS = 600_000

_LETTER = np.zeros(0x251, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC0, 0x250)]] = True
_LETTER[[0xD7, 0xF7, 0x130]] = False  # two signs, and the letter whose lower case ends in a combining mark
_MARK = np.zeros(0x251, bool)
_MARK[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def parts(chunk: Chunk, added: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of the parts of each word that the tokenizer treats alone; what added finds is a part."""
    s, e, _ = chunk.words()
    cp = np.minimum(chunk.cp, 0x250)
    letter, mark = _LETTER[cp], _MARK[cp]
    cut = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1
    found = np.array([m.span() for m in added.finditer(chunk.text)], np.int64) if added else np.zeros((0, 2), np.int64)
    if len(found):
        before = np.searchsorted(found[:, 0], cut) - 1
        cut = cut[(before < 0) | (cut >= found[before, 1])]
        edges = np.concatenate((np.setdiff1d(found[:, 0], s), np.setdiff1d(found[:, 1], e)))
        cut = np.unique(np.concatenate((cut, edges)))
    if len(cut):
        s, e = np.sort(np.concatenate((s, cut))), np.sort(np.concatenate((e, cut)))
    return s, e, np.searchsorted(chunk.starts, s, side="right") - 1


class PartIds:
    """Ids of parts by their hash, kept from chunk to chunk."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        added = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.clear()

    def clear(self) -> None:
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        sizes, ids = [], []
        for i in range(0, len(texts), 2000):
            some = texts[i : i + 2000]
            found = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, np.uint32))
            sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(some)))
        size = np.concatenate(sizes).astype(np.int32)
        at = (len(self.ids) + np.cumsum(size) - size).astype(np.int32)
        self.ids = np.concatenate((self.ids, *ids))
        all_h = np.concatenate((self.hashes, hashes))
        o = np.argsort(all_h, kind="stable")
        self.hashes, self.at, self.size = all_h[o], np.concatenate((self.at, at))[o], np.concatenate((self.size, size))[o]

    def encode(self, chunk: Chunk, lower: bool) -> list[np.ndarray]:
        """The ids of each document."""
        s, e, doc = parts(chunk, self.added)
        if not len(s):
            return [np.zeros(0, np.uint32)] * chunk.docs
        if len(self.hashes) > CACHED_PARTS:
            self.clear()
        h, first, which = np.unique(chunk.span(chunk.sums(folded=lower), s, e), return_index=True, return_inverse=True)
        near = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        new = np.flatnonzero(self.hashes[near] != h) if len(self.hashes) else np.arange(len(h))
        if len(new):
            self._learn(h[new], [chunk.text[a:b] for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist(), strict=True)])
        place = np.searchsorted(self.hashes, h)[which]
        size = self.size[place].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.at[place] - (ends - size), size) + np.arange(ends[-1])]
        to = np.concatenate(([0], ends))[np.searchsorted(doc, np.arange(chunk.docs + 1))]
        return [ids[a:b] for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]


_cached: dict[tuple[str, bool], PartIds] = {}


def part_ids(tokenizer_file: str, lower: bool) -> PartIds:
    """This worker's, kept over its tasks."""
    if (tokenizer_file, lower) not in _cached:
        from tokenizers import Tokenizer

        _cached[tokenizer_file, lower] = PartIds(Tokenizer.from_file(tokenizer_file))
    return _cached[tokenizer_file, lower]


class Packer:
    """Sum-of-squares packing of pieces (doc_id, start, ids, tokens of the document)."""

    def __init__(self, size: int, first_id: int = 0, ids: bool = False):
        self.size, self.next, self.with_ids = size, first_id, ids
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.rows: list[tuple] = []
        self.ids: list[np.ndarray] = []

    def close(self, parts: list) -> None:
        offset, total = 0, sum(len(p[2]) for p in parts)
        for doc, start, ids, tokens in parts:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, self.next, offset, total))
            offset += len(ids)
            if self.with_ids:
                self.ids.append(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.size * self.size
        for start in range(0, whole, self.size):
            self.close([(doc, start, ids[start : start + self.size], len(ids))])
        if whole < len(ids):
            self.place((doc, whole, ids[whole:], len(ids)))

    def place(self, piece: tuple) -> None:
        s, n = len(piece[2]), self.count
        levels = self.size - s + 1  # 0 (a new sequence) to the level that the piece fills up
        change = 2 * (n[s:] - n[:levels]) + 2  # in the sum of squares; one place of two is none at either end
        change[0] -= 1
        change[-1] -= 1
        change[1:][n[1:levels] == 0] = np.iinfo(np.int64).max
        h = levels - 1 - int(np.argmin(change[::-1]))
        parts = self.open[h].pop() if h else []
        n[h] -= h > 0
        parts.append(piece)
        if h + s == self.size:
            self.close(parts)
        else:
            n[h + s] += 1
            self.open[h + s].append(parts)

    def finish(self) -> None:
        """Cuts what is open into full sequences and powers of two."""
        left = [p for level in reversed(self.open) for parts in level for p in parts]
        total = sum(len(p[2]) for p in left)
        sizes = [self.size] * (total // self.size) + [1 << b for b in reversed(range(total % self.size + 1)) if (total % self.size) >> b & 1]
        parts, room = [], sizes.pop(0) if sizes else 0
        for doc, start, ids, tokens in left:
            while len(ids):
                k = min(room, len(ids))
                parts.append((doc, start, ids[:k], tokens))
                start, ids, room = start + k, ids[k:], room - k
                if not room:
                    self.close(parts)
                    parts, room = [], sizes.pop(0) if sizes else 0
        self.count[:] = 0
        self.open = [[] for _ in range(self.size + 1)]

    def taken(self) -> pa.RecordBatch | None:
        rows, ids, self.rows, self.ids = self.rows, self.ids, [], []
        if not rows:
            return None
        columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        if not self.with_ids:
            return pa.RecordBatch.from_arrays(columns, _NAMES)
        at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids).astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, [*_NAMES, "ids"])


def pack(docs: DataFrame, tokenizer_file: str, size: int = 4096, end_id: int = 2, lower: bool = False, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length; with ids, the piece's ids too.

    tokenizer_file: a vocabulary that drops white space and splits letters from punctuation; lower: it
    also lower-cases. A null or empty text has just the end id. Rows that repeat are packed each; null ids
    are carried; an empty table gives no rows; further columns are not read. sequence_id is the
    partition's number times 2^32 plus the sequence's number in it. Nothing of a text is dropped: the
    pieces of a document join to its ids. What stays in memory are the ids of the open sequences, a chunk
    of texts and CACHED_PARTS parts.
    """

    def run(batches):
        packer = Packer(size, TaskContext.get().partitionId() << 32, ids)
        encoder = part_ids(tokenizer_file, lower)
        for keys, chunk in pieces(batches, chars=1 << 20):
            for key, found in zip(keys, encoder.encode(chunk, lower), strict=True):
                packer.add(key, np.append(found, np.uint32(end_id)).astype("<u4", copy=False))
            if (out := packer.taken()) is not None:
                yield out
        packer.finish()
        if (out := packer.taken()) is not None:
            yield out

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if ids else ""))

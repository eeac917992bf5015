"""The captions' inverted index as segments: an import writes one of its own size, removed captions are marked, segments are merged from time to time.

A segment holds the postings of some captions in buckets of their terms, sorted by term, and a row for each caption in bucket -1. It is
made with one shuffle, in which a common term's postings are split among tasks. A commit lists the segments that count with
what was removed from them, and the totals that ranking needs; readers stay on the commit that they began with.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.sources.commits import Commits
from lumora.sources.shared import small_batches

#: Folders that terms are dealt to by hash: a query reads its terms' ones.
BUCKETS = 32
#: Segments beyond which an update merges them.
SEGMENTS = 8

#: Tokens of captions that a task works on together; a longer caption comes alone.
TOKENS = 250_000

_POSTINGS = "doc long, part long, term string, tf long, positions array<int>, length long"


@dataclass(frozen=True)
class Index:
    """An inverted index: terms (doc, part, term, tf, positions, length; part tells a document's captions apart), and whole: one row total, mean of the captions that have a token."""

    terms: DataFrame
    whole: DataFrame


def bucket(term: Column) -> Column:
    return F.when(term.isNull(), -1).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS))).cast("int")


def buckets_of(spark: SparkSession, terms: list[str]) -> list[int]:
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select(bucket(F.col("t"))).distinct().collect() if terms else []
    return [r[0] for r in rows]


def _parts(batch: pa.RecordBatch, most: int):
    """A batch's rows in order, cut so that no part of several rows has more than most tokens."""
    end, start = np.cumsum(batch.column("t").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while start < batch.num_rows:
        before = end[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(end, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def postings(captions: DataFrame, tokens: Column, key: str, text: str) -> DataFrame:
    """doc, part, term, tf, positions, length: a row for each term of each caption that has one, and one without term for the caption itself. A task counts a caption's terms where it reads it, those of at most TOKENS tokens together."""

    names = ["doc", "part", "term", "tf", "positions", "length"]

    def run(batches):
        for b in (part for whole in batches for part in _parts(whole, TOKENS)):
            size = b.column("t").value_lengths().to_numpy().astype(np.int64)
            words = b.column("t").flatten().dictionary_encode()
            of = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            word = words.indices.to_numpy().astype(np.int64)
            order = np.argsort(of * len(words.dictionary) + word, kind="stable")
            of, word, pos = of[order], word[order], pos[order].astype(np.int32)
            first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (word[1:] != word[:-1]))))
            cut = np.concatenate((first, [len(of)])).astype(np.int32)
            which = pa.array(of[first])
            yield pa.RecordBatch.from_arrays([b.column("doc").take(which), b.column("part").take(which), words.dictionary.take(pa.array(word[first])), pa.array(np.diff(cut).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut), pa.array(pos)), pa.array(size[of[first]])], names)
            none = pa.ListArray.from_arrays(pa.array(np.zeros(len(size) + 1, np.int32)), pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("part"), pa.nulls(len(size), pa.string()), pa.array(np.zeros(len(size), np.int64)), none, pa.array(size)], names)

    rows = captions.select(F.col(key).cast("long").alias("doc"), F.xxhash64(text).alias("part"), tokens.alias("t")).where("doc is not null and size(t) > 0")
    return rows.mapInArrow(run, _POSTINGS)


class CaptionIndex:
    """A stored index at path. tokens: a text column's tokens as an array, which the same captions must always give alike.

    Captions are told apart by document and text: repeated ones are one. Null documents and captions without a token are left out.
    """

    def __init__(self, spark: SparkSession, path: str, tokens, key: str = "image_id", text: str = "caption"):
        self.spark, self.commits, self.tokens, self.key, self.text = spark, Commits(spark, path), tokens, key, text

    def segments(self) -> list[dict]:
        return (self.commits.last()[1] or {"segments": []})["segments"]

    def _read(self, segments: list[dict]) -> DataFrame:
        """The segments' live rows; a caption removed from a segment may come again in a later one."""
        out = None
        for s in segments:
            rows = self.spark.read.schema(f"{_POSTINGS}, bucket int").parquet(f"{self.commits.path}/{s['folder']}")
            for gone in s["gone"]:
                rows = rows.join(self.spark.read.schema("doc long, part long").parquet(f"{self.commits.path}/{gone}"), ["doc", "part"], "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], f"{_POSTINGS}, bucket int") if out is None else out

    def index(self) -> Index:
        """The index of the last commit."""
        now = self.segments()
        total, length = (sum(s[k] for s in now) for k in ("total", "length"))
        whole = self.spark.createDataFrame([(total, length / total if total else None)], "total long, mean double")
        return Index(self._read(now).where("bucket >= 0"), whole)

    def _captions(self, segments: list[dict]) -> DataFrame:
        return self._read(segments).where("bucket = -1").select("doc", "part", "length")

    def _written(self, rows: DataFrame) -> list[dict]:
        """rows as a segment (none, if there are no rows)."""
        folder = f"s-{uuid.uuid4().hex}"
        path = f"{self.commits.path}/{folder}"
        rows = rows.withColumn("bucket", bucket(F.col("term"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc", "part")
        with small_batches(self.spark, 4 << 20):  # by bytes, not by thousands of captions
            rows.write.partitionBy("bucket").parquet(path)
        n = self.spark.read.schema(f"{_POSTINGS}, bucket int").parquet(path).where("bucket = -1").agg(F.count("*").alias("n"), F.sum("length").alias("l")).first()
        return [{"folder": folder, "total": n.n, "length": n.l, "gone": []}] if n.n else []

    def add(self, captions: DataFrame) -> int:
        """Indexes the captions that aren't there yet, in a segment of their own. Returns how many."""
        number, value = self.commits.last()
        now = (value or {"segments": []})["segments"]
        fresh = self._fresh(captions, now)
        new = self._written(postings(fresh, self.tokens(F.col(self.text)), self.key, self.text))
        self.commits.add({"segments": now + new}, number)
        self._merge_if_many()
        return sum(s["total"] for s in new)

    def _fresh(self, captions: DataFrame, now: list[dict]) -> DataFrame:
        rows = captions.select(self.key, self.text)
        cores = self.spark.sparkContext.defaultParallelism
        if captions.rdd.getNumPartitions() < cores:  # few files: all tasks shall have some
            rows = rows.repartition(cores)
        if not now:
            return rows
        rows = rows.withColumn("part", F.xxhash64(self.text))
        have = self._captions(now).select(F.col("doc").alias(self.key), "part")
        return rows.join(have, [self.key, "part"], "left_anti").drop("part")

    def sync(self, captions: DataFrame) -> tuple[int, int]:
        """(added, removed): makes the index that of captions: a segment of what is new, marks on what isn't there any more."""
        number, value = self.commits.last()
        now = (value or {"segments": []})["segments"]
        there = captions.select(F.col(self.key).cast("long").alias("doc"), F.xxhash64(self.text).alias("part"))
        kept, removed = [], 0
        for s in now:
            gone = self._captions([s]).join(there, ["doc", "part"], "left_anti")
            folder = f"g-{uuid.uuid4().hex}"
            gone.write.parquet(f"{self.commits.path}/{folder}")
            n = self.spark.read.schema("doc long, part long, length long").parquet(f"{self.commits.path}/{folder}").agg(F.count("*").alias("n"), F.sum("length").alias("l")).first()
            if n.n:
                s, removed = s | {"total": s["total"] - n.n, "length": s["length"] - n.l, "gone": [*s["gone"], folder]}, removed + n.n
            else:
                self.commits.delete(folder)
            kept.append(s)
        new = self._written(postings(self._fresh(captions, kept), self.tokens(F.col(self.text)), self.key, self.text))
        self.commits.add({"segments": [s for s in kept if s["total"]] + new}, number)
        self._merge_if_many()
        return sum(s["total"] for s in new), removed

    def _merge_if_many(self) -> None:
        if len(self.segments()) > SEGMENTS:
            self.merge()

    def merge(self) -> None:
        """All live rows as one segment. The old ones stay for readers until vacuum()."""
        number, value = self.commits.last()
        self.commits.add({"segments": self._written(self._read(value["segments"]).drop("bucket"))}, number)

    def vacuum(self) -> None:
        """Removes what the last commit doesn't need; no reader of an older one, and no writer, may be at work."""
        live = {f for s in self.segments() for f in (s["folder"], *s["gone"])}
        for n in self.commits.numbers()[:-1]:
            self.commits.forget(n)
        for folder in self.commits.folders() - live:
            self.commits.delete(folder)

"""Bounded samples of labelled rows for training, and the folds that queries fix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.llm.text import kept

#: Characters of a text beyond which it is not drawn for training, and of all texts drawn for one class, at most.
LONGEST, CLASS_CHARS = 1 << 20, 1 << 25
#: Drawn rows up to so many are sent to all executors.
BROADCAST_IDS = 200_000
#: Parts of a class among which its rows are chosen before they meet.
SALTS = 32


def fold(folds: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo folds; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds, F.lit(-1))


def least_of_each(rows: DataFrame, by: str, rank: str, most: int) -> DataFrame:
    """rows of which at most most stay for each by: those with the least rank (a long).

    A task keeps the best of each by that it meets, so that only these are shuffled: first to SALTS tasks for each
    by, which again keep the best, so that the last one gets no more rows from many tasks than from few.
    """

    def run(batches):
        held: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(by).dictionary_encode()
            code, order = key.indices.to_numpy(zero_copy_only=False), b.column(rank).to_numpy()
            for i, k in enumerate(key.dictionary.to_pylist()):
                at = np.flatnonzero(code == i)
                if k in held:
                    at = at[order[at] <= held[k][1]] if held[k][0].num_rows >= most else at
                if not len(at):
                    continue
                at = at[np.argsort(order[at], kind="stable")[:most]]
                t = pa.Table.from_batches([b.take(pa.array(at))])
                if k in held:
                    t = pa.concat_tables([held[k][0], t]).combine_chunks()
                    o = np.argsort(t.column(rank).to_numpy(), kind="stable")[:most]
                    t = t.take(pa.array(o))
                held[k] = t, int(t.column(rank)[t.num_rows - 1].as_py())
        for t, _ in held.values():
            yield from t.to_batches()

    some = rows.where(F.col(by).isNotNull()).mapInArrow(run, rows.schema)
    some = some.withColumn("_s", F.pmod(rank, F.lit(SALTS)))
    for keys in ([by, "_s"], [by]):
        w = Window.partitionBy(*keys).orderBy(rank, *sorted(c for c in rows.columns if c != rank))
        some = some.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
    return some.drop("_s")


def drawn(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most per_class rows (doc_id, label) of each class, those with the least hash of doc_id, in one pass over all classes."""
    rows = labels.where("doc_id is not null").select("doc_id", label, F.xxhash64("doc_id").alias("_h"))
    return least_of_each(rows, label, "_h", per_class).select("doc_id", label)


def labelled_texts(docs: DataFrame, some: DataFrame, label: str, per_class: int, on: list[str]) -> list[tuple]:
    """(text, label) of docs joined with the drawn rows, in a fixed order.

    Where a doc_id repeats the join gives more rows than were drawn: per_class bounds them again, and
    texts over LONGEST or beyond CLASS_CHARS of their class are left out.
    """
    some = kept(some, "drawn")
    some = F.broadcast(some) if some.count() <= BROADCAST_IDS else some  # few classes have few rows; many languages need a shuffle
    rows = docs.select(*dict.fromkeys(["doc_id", "text", *on])).where(f"length(text) <= {LONGEST}").join(some, on)
    rows = least_of_each(rows.select("doc_id", "text", label, F.xxhash64("doc_id").alias("_h")), label, "_h", per_class)
    chars = F.sum(F.length("text")).over(Window.partitionBy(label).orderBy("_h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("_c", chars).where(F.col("_c") <= CLASS_CHARS).select("doc_id", "text", label).collect()
    return [(r.text, r[label]) for r in sorted(found, key=lambda r: (r.doc_id, r[label], r.text))]

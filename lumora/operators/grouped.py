"""Many small groups in one pass: rows are dealt by key and sorted, and the groups of a batch are handed to a numpy function together.

A call for each group costs most of the time where groups are small; so a function takes all groups that a batch completes, with
the places where they begin. A batch's rows and its last group's, and only those, are in memory together.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def many_groups(rows: DataFrame, keys: list[str], order: list[str], f: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """f takes the columns of several groups, sorted by keys and order, and the first row of each; it returns columns named as in schema."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for k in keys:
            x = t.column(k).to_numpy()
            new |= x[1:] != x[:-1]
        return np.concatenate(([0], np.flatnonzero(new) + 1))

    def call(t: pa.Table) -> pa.RecordBatch:
        out = f({c: t.column(c).to_numpy() for c in t.column_names}, starts(t))
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(out[n])) for n in names], names)

    def run(batches):
        held = []  # the pieces of the group that the last batch ended with
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            last = int(starts(t)[-1])
            if held and not last and len(starts(pa.concat_tables([held[-1].slice(0, 1), t.slice(0, 1)]))) == 1:
                held.append(t)
                continue
            done = pa.concat_tables([*held, t.slice(0, last)]).combine_chunks()
            held = [t.slice(last)]
            if done.num_rows:
                yield call(done)
        if held:
            yield call(pa.concat_tables(held).combine_chunks())

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

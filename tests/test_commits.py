"""Stores and runs that are stopped between any two steps."""

import os

import pandas as pd
import pytest

from lumora.operators import backends
from lumora.sources.commits import CommitLog, Commits, CommitTaken, VersionedStore, resumed


class Stop(Exception):
    pass


@pytest.mark.parametrize("where", ["write", "gate", "before the rename", "after the rename", "vacuum"])
def test_a_store_is_whole_wherever_a_writer_stops(spark, tmp_path, monkeypatch, where):
    store = VersionedStore(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.publish(spark.range(3))
    pinned = store.read()
    good = lambda rows: rows.count() == 5

    def stop(*_):
        raise Stop

    if where == "write":
        rows = spark.range(5).selectExpr("if(id = 4, raise_error('stop'), id) AS id")
        with pytest.raises(Exception, match="stop"):
            store.publish(rows)
    elif where == "gate":
        with pytest.raises(Stop):
            store.publish(spark.range(5), stop)
    elif where == "before the rename":
        monkeypatch.setattr(Commits, "add", stop)
        with pytest.raises(Stop):
            store.publish(spark.range(5), good)
        monkeypatch.undo()
    elif where == "after the rename":
        store.publish(spark.range(5), good)
    else:
        store.publish(spark.range(5), good)
        monkeypatch.setattr(Commits, "delete", stop)
        with pytest.raises(Stop):
            store.vacuum()
        monkeypatch.undo()
    want = 5 if where in ("after the rename", "vacuum") else 3
    assert VersionedStore(spark, str(tmp_path / "s")).read().count() == want and pinned.count() == 3
    assert not store.publish(spark.range(9), good) and store.read().count() == want
    assert store.publish(spark.range(5), good)
    store.vacuum()
    assert store.read().count() == 5 and len(store.commits.folders()) == 1 and len(store.commits.numbers()) == 1


def test_of_two_writers_one_loses(spark, tmp_path):
    a, b = (Commits(spark, str(tmp_path / "c")) for _ in range(2))
    assert a.add({"x": 1}, 0) == 1
    with pytest.raises(CommitTaken):
        b.add({"x": 2}, 0)
    assert b.last() == (1, {"x": 1}) and b.add({"x": 2}, 1) == 2
    assert not [f for f in os.listdir(tmp_path / "c" / "_commits") if f.startswith(".") and not f.endswith(".crc")]


def test_a_killed_run_goes_on(spark, tmp_path):
    """The writer dies within its second batch: what that wrote doesn't count, what is committed isn't done again."""
    todo = spark.createDataFrame([(i, float(i)) for i in range(40)] + [(3, 3.0), (None, 1.0)], "id long, x double")
    log, seen = CommitLog(spark, str(tmp_path / "log")), []

    def step(batch):
        rows = sorted(r.id for r in batch.collect())
        seen.append(rows)
        return batch.selectExpr("id", "raise_error('killed') AS y") if len(seen) == 2 else batch.selectExpr("id", "x * 2 AS y")

    with pytest.raises(Exception, match="killed"):
        resumed(todo, step, log, batch_rows=12)
    assert len(log.parts()) == 1
    resumed(todo, step, log, batch_rows=12)
    got = sorted((r.id, r.y) for r in log.read("id long, y double").collect())
    assert got == sorted([(i, 2.0 * i) for i in range(40)] + [(3, 6.0)])
    again = set(seen[0]) & {i for rows in seen[2:] for i in rows}
    assert not again and resumed(todo, step, log, batch_rows=12) == 0


@pytest.mark.parametrize("most", [1, 2, 3, 7, 50])
def test_halved_batches_keep_rows_and_order(most):
    calls = []

    def step(batch):
        calls.append(len(batch))
        if len(batch) > most:
            raise MemoryError
        return batch

    batches = [pd.DataFrame({"id": range(i, i + n)}) for i, n in ((0, 20), (20, 1), (21, 13))]
    out = list(backends.halving(step)(iter(batches)))
    assert [i for p in out for i in p["id"]] == list(range(34))


def test_other_errors_and_single_rows_are_raised():
    def broken(batch):
        raise RuntimeError("no such model")

    def full(batch):
        raise RuntimeError("MPS backend out of memory")

    for step, text in ((broken, "no such model"), (full, "out of memory")):
        with pytest.raises(RuntimeError, match=text):
            list(backends.halving(step)(iter([pd.DataFrame({"id": [1, 2]})])))


def test_one_call_for_each_scene_and_four_tables(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def step(batch):
        calls.add(len(batch))
        return {"tag": pd.DataFrame({"id": batch["id"], "value": "a"}), "face": pd.DataFrame({"id": batch["id"][:0], "n": batch["id"][:0]}), "text": pd.DataFrame({"id": batch["id"] * 2, "t": ["é"] * len(batch)})}

    store = VersionedStore(spark, str(tmp_path / "s"))
    schemas = {"tag": "id long, value string", "text": "id long, t string"}
    for n in (10, 6):
        calls.value = 0
        store.publish(backends.all_kinds(lambda b: {k: v for k, v in step(b).items() if k in schemas}, spark.range(n), schemas), by="kind")
        assert calls.value == n
        assert sorted(r.id for r in store.read(kind="text").collect()) == [2 * i for i in range(n)] and store.read(kind="tag").count() == n

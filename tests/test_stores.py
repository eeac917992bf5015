"""The vector store against exact search, and matrix files."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lumora.operators import vector_store
from lumora.operators.vector_store import VectorStore
from lumora.plans import registry
from lumora.sources.matrices import npy_matrix

LARGER = "/root/testdata/sf0.1"


def given(folder):
    t = pq.read_table(f"{folder}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    x = np.array(t["embedding"], np.float64)
    return np.array(t["vec_id"]), x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_of_the_vector_store(spark):
    ids, x = given(LARGER)
    got = registry.queries()["vector_store_search"](spark, LARGER).toPandas()
    hits = []
    for q in np.flatnonzero(ids % 50 == 0):
        want = set(ids[np.lexsort((ids, -np.round(x @ x[q], 6)))[:10]])
        mine = got[got["query"] == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and mine.id.iloc[0] == ids[q]
        np.testing.assert_allclose(mine.similarity, [x[ids == i][0] @ x[q] for i in mine.id], atol=2e-6)
        hits.append(len(want & set(mine.id)) / 10)
    assert np.mean(hits) >= 0.9


def test_all_lists_give_the_exact_result_and_few_read_their_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[0].tolist()), (900, [0.0] * 8), (901, None), (None, x[1].tolist())]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    store = VectorStore(spark, str(tmp_path / "s"))
    store.train(vectors, lists=12)
    store.add(vectors.where("id < 100 and id != 5"))
    store.add(vectors.where("id != 5"))
    store.add(spark.createDataFrame([(5, x[5].tolist())], "id long, v array<double>"))
    store.add(vectors)  # all there
    assert store.codes.read("id long, code binary, list int").count() == 300
    assert {r.id: r.there for r in store.contains(spark.createDataFrame([(7,), (900,), (1234,)], "id long")).collect()} == {7: True, 900: False, 1234: False}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = store.search(vectors.where("id < 20 and id != 5"), 5, probes=12, rerank=60).toPandas()
    for q in (i for i in range(20) if i != 5):
        assert got[got["query"] == q].sort_values("rank").id.tolist() == np.lexsort((np.arange(300), -np.round(u @ u[q], 6)))[:5].tolist()
    plan = store.search(vectors.where("id = 7"), 5, probes=2)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line and ("code:binary" in line or "v:array<float>" in line)]
    wrong = [line[line.index("PartitionFilters") :] for line in scans if not re.search(r"PartitionFilters: \[.*list#\d+ IN \(", line)]
    assert scans and not wrong


def test_a_task_of_a_search_holds_strips_not_all_scores_of_a_batch():
    """600 queries meet a batch of 10,000 rows: 48 MB of scores alone, and places and ids as much each."""
    rng = np.random.default_rng(4)
    q, c = (vector_store._unit(rng.normal(size=(n, 8))) for n in (600, 3))
    code, lists, ids = rng.integers(-127, 128, (10_000, 8)).astype(np.int8), rng.integers(0, 3, 10_000), rng.permutation(10_000)
    code[5000:] = code[:5000]  # equal scores: the smaller ids stay
    lists[5000:] = lists[:5000]
    by = {n: np.arange(n, 600, 1 + n % 2) for n in range(2)}  # nobody goes to the third list
    batch = pa.RecordBatch.from_pydict({"id": ids, "code": [r.tobytes() for r in code], "list": pa.array(lists, pa.int32())})
    tracemalloc.start()
    of, got, _ = vector_store._of_codes(iter([batch.slice(0, 6000), batch.slice(6000)]), q, c, by, 0.01, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    for n in (0, 1, 599):
        to = np.isin(lists, [k for k, who in by.items() if n in who])
        s = np.round(np.where(to, c[lists] @ q[n] + 0.01 * (code @ q[n]), -np.inf), 9)
        assert sorted(got[of == n]) == sorted(ids[np.lexsort((ids, -s))[:20]])


def test_matrix_of_a_given_table_in_ranges(spark, tmp_path):
    ids, x = given("/root/testdata/sf0.001")
    np.save(tmp_path / "m.npy", x.astype(np.float32))
    np.save(tmp_path / "ids.npy", ids)
    rows = npy_matrix(spark, str(tmp_path / "m.npy"), f"file://{tmp_path}/ids.npy", 64, rows=60)
    assert rows.rdd.getNumPartitions() == -(-len(ids) // 60)
    got = {r.id: r.v for r in rows.collect()}
    assert set(got) == set(ids.tolist()) and all(np.array_equal(np.float32(got[i]), v.astype(np.float32)) for i, v in zip(ids.tolist(), x))


@pytest.mark.parametrize(("matrix", "ids", "error"), [
    (np.zeros((5, 3), "f4"), np.arange(4), "not 5 whole numbers"), (np.zeros((5, 4), "f4"), np.arange(5), r"not numbers \(n, 3\)"),
    (np.zeros((5, 3), "i4"), np.arange(5), "not numbers"), (np.zeros((5, 3), "f4"), np.zeros(5), "whole numbers"), (np.asfortranarray(np.ones((5, 3), "f4")), np.arange(5), "by columns"),
])
def test_wrong_matrices_fail(spark, tmp_path, matrix, ids, error):
    np.save(tmp_path / "m.npy", matrix)
    np.save(tmp_path / "ids.npy", ids)
    with pytest.raises(Exception, match=error):
        npy_matrix(spark, str(tmp_path / "m.npy"), str(tmp_path / "ids.npy"), 3).count()


def test_matrices_of_other_types_and_none(spark, tmp_path):
    for kind in ("f2", "f8"):
        np.save(tmp_path / "m.npy", np.ones((3, 2), kind))
        np.save(tmp_path / "ids.npy", np.array([4, 4, 9], "u4"))
        assert sorted(r.id for r in npy_matrix(spark, str(tmp_path / "m.npy"), str(tmp_path / "ids.npy"), 2).collect()) == [4, 4, 9]
    np.save(tmp_path / "m.npy", np.ones((0, 2), "f4"))
    np.save(tmp_path / "ids.npy", np.zeros(0, "i8"))
    assert npy_matrix(spark, str(tmp_path / "m.npy"), str(tmp_path / "ids.npy"), 2).count() == 0

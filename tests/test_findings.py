"""Whole jobs: what a query must not leave out, and what must not grow beside the input."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumora.operators import caption_index, cluster, grouped, parity, writes
from lumora.plans import registry
from lumora.sources import catalog
from lumora.sources.catalog import Catalog
from lumora.sources.shared import input_bytes
from lumora.streaming import live

FOLDER = "/root/testdata/sf0.001"


def test_applied_tags_carry_their_scores(spark):
    rows = registry.queries()["centroid_apply"](spark, FOLDER).collect()
    assert rows and all(r.confidence is not None and r.confidence > 0.05 for r in rows)
    assert "score AS confidence" in registry.oracle_sql()["centroid_apply"]


def _vectors(spark, n, dim=8, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return spark.createDataFrame([(i, i % 2, r.tolist()) for i, r in enumerate(x)], "id long, embedder long, v array<double>")


def test_vectors_of_a_linkage_meet_once_not_in_every_round(spark, monkeypatch):
    met, pairs = [], cluster._pairs_of_blocks
    monkeypatch.setattr(cluster, "_pairs_of_blocks", lambda *a: met.append(1) or pairs(*a))
    found = cluster.complete_linkage(_vectors(spark, 120), 0.7, 2, part=5)
    # for the connected parts, and for the pairs within cut
    assert len(met) == 2 and found.count() == 120


def test_people_of_a_linkage_in_rounds(spark, monkeypatch):
    met, pairs = [], cluster._pairs_of_blocks
    monkeypatch.setattr(cluster, "_pairs_of_blocks", lambda *a: met.append(1) or pairs(*a))
    vectors = _vectors(spark, 120)
    one, many = ({(r.person, r.n, r.cover) for r in cluster.people(cluster.complete_linkage(vectors, 0.7, 2, part=p)).collect()} for p in (1000, 5))
    # once in one task's linkage, twice in rounds
    assert one == many and one and len(met) == 3


def test_blocks_widen_with_the_vectors(spark, monkeypatch):
    """What is shuffled is a block for each one that it meets: their number is bounded until they are as wide as may be."""
    monkeypatch.setattr(cluster, "BLOCK", 4)
    blocks = cluster._blocks(_vectors(spark, 800).withColumn("embedder", F.lit(0)), "embedder")
    # each of up to 32 pivots' last block isn't full
    assert blocks.count() <= cluster.PARTS + 2 * cluster.PIVOTS


def test_pairs_of_blocks_leave_arrow_one_by_one():
    batch = pa.RecordBatch.from_pydict({"p": [1, 2, 3]})
    assert [r["p"] for r in cluster._rows(iter([batch]))] == [1, 2, 3]
    row = {"a_ids": range(3), "b_ids": range(2), "a_m": np.eye(3).tobytes(), "b_m": np.eye(3)[:2].tobytes()}
    assert [(a, b) for i, j, _ in cluster._near(row, 0.5) for a, b in zip(i, j, strict=True)] == [(0, 0), (1, 1)]


def test_captions_are_counted_in_parts_of_bounded_size():
    t = [["a"] * n for n in (3, 4, 20, 1, 1, 0, 9)]
    batch = pa.RecordBatch.from_pydict({"doc": list(range(7)), "t": pa.array(t, pa.list_(pa.string()))})
    parts = [p.column("doc").to_pylist() for p in caption_index._parts(batch, 8)]
    assert parts == [[0, 1], [2], [3, 4, 5], [6]]


def test_postings_are_the_same_in_small_parts(spark, monkeypatch):
    captions = spark.createDataFrame([(i, " ".join(f"w{j % (i + 2)}" for j in range(i * 3))) for i in range(30)], "image_id long, caption string")
    key = lambda: sorted((r.doc, r.term or "", r.tf, r.length, tuple(r.positions)) for r in caption_index.postings(captions, F.split("caption", " "), "image_id", "caption").collect())
    want = key()
    monkeypatch.setattr(caption_index, "TOKENS", 7)
    assert key() == want and len(want) > 100


def _plan(spark, name):
    df = registry.queries()[name](spark, FOLDER)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_common_tag_of_a_rule_does_not_meet_in_a_task(spark):
    assert "hashpartitioning(category" not in _plan(spark, "filter_exclusion_anti")


@pytest.mark.parametrize("name", ["filter_owner_scope", "tags_keyed", "rule_mining", "import_scored_tags", "facet_tags_filtered", "facets_ordered"])
def test_tags_are_dealt_by_image_as_lines(spark, name, monkeypatch):
    """Partitions follow the lines' files, not a fixed number, and no shuffle takes the four tags of each line instead of it."""
    monkeypatch.setattr(catalog, "LINES_AT_ONCE", 4096)
    n = -(-input_bytes(Catalog(spark, FOLDER).raw("lineitem")) // 4096)
    plan = _plan(spark, name)
    assert n > 20 and re.search(rf"hashpartitioning\(l_orderkey#\d+L?, {n}\), REPARTITION_BY_NUM", plan)
    if name != "import_scored_tags":  # its new rows aren't of lines
        assert not re.search(r"hashpartitioning\(image_id#\d+L?, category", plan)


def _taken_one_by_one(group, boxes, side):
    free, px = side.copy(), np.full(len(group), np.nan)
    for r in np.flatnonzero(~side):
        of = np.flatnonzero(free & (group == group[r]))
        if len(of):
            d = np.abs(boxes[of] - boxes[r]).max(axis=1)
            free[of[d.argmin()]], px[r] = False, d.min()
    return px


def test_boxes_of_many_images_are_paired_together():
    rng = np.random.default_rng(6)
    for n, groups in ((1, 1), (40, 1), (300, 60), (300, 3)):
        group = np.unique(np.sort(rng.integers(0, groups, n)), return_inverse=True)[1]
        boxes, side = rng.integers(0, 5, (n, 4)).astype(float), rng.random(n) < 0.5
        taken, px = parity.closest_free(group, boxes, side)
        np.testing.assert_array_equal(px, _taken_one_by_one(group, boxes, side))
        np.testing.assert_array_equal(taken, ~np.isnan(px))


def test_groups_of_a_batch_come_in_one_call(spark):
    """Small groups cost no call each, and one that goes over batches is whole."""
    sizes = [3, 1, 25_000, 1, 0, 4] + [2] * 3000
    rows = spark.createDataFrame([(i, j) for i, n in enumerate(sizes) for j in range(n)], "id long, x long").coalesce(1)
    f = lambda g, start: {"id": g["id"][start], "n": np.diff(np.append(start, len(g["id"]))), "groups": np.full(len(start), len(start)), "sorted": np.add.reduceat(np.append(0, np.diff(g["x"]) == 1), start)}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = grouped.many_groups(rows, ["id"], ["x"], f, "id long, n long, groups long, sorted long").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert {r.id: r.n for r in got} == {i: n for i, n in enumerate(sizes) if n}
    assert max(r.groups for r in got) > 2000 and all(r.sorted >= r.n - 1 for r in got)


def test_assets_of_a_bucket_are_one_state(spark, tmp_path):
    """What is open is held for a bucket, not an asset, and comes out by the rules of each asset."""
    out, mark, source = (str(tmp_path / x) for x in ("out", "mark", "in"))
    schema = "id string, tier string, ok boolean, ts timestamp"
    run = lambda: live.to_folder(live.finalised_assets(spark.readStream.schema(schema).parquet(source), ("a", "b"), 3600, "2 hours", buckets=4), out, mark)
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    put = lambda rows: spark.createDataFrame([(i, t, ok, at(m)) for i, t, ok, m in rows], "id string, tier string, ok boolean, ts string").selectExpr("id", "tier", "ok", "cast(ts AS timestamp) AS ts").write.mode("append").parquet(source)
    got = lambda: {(r.id, r.outcome, r.missing) for r in spark.read.parquet(out).collect()}
    put([(f"x{i}", "a", True, 600) for i in range(50)] + [("early", "b", True, 60), ("both", "a", True, 600), ("both", "b", True, 601), ("bad", "a", None, 600), ("bad", "b", True, 600), ("bad", "c", True, 600), (None, "a", True, 600)])
    run()
    # the watermark is at 481
    assert got() == {("both", "done", ""), ("bad", "failed", ""), ("early", "incomplete", "a")}
    assert spark.read.format("statestore").load(mark).count() <= 4
    put([(f"x{i}", "b", i % 3 > 0, 610) for i in range(40)] + [("x45", "b", True, 400), ("both", "b", True, 900)])
    run()
    want = {(f"x{i}", "done" if i % 3 else "failed", "") for i in range(40)} | {(f"x{i}", "incomplete", "b") for i in range(40, 50)}
    assert got() == want | {("both", "done", ""), ("bad", "failed", ""), ("early", "incomplete", "a")}  # both is open anew


def test_what_is_shipped_for_a_pass_grows_as_the_vectors(spark, monkeypatch):
    """Blocks go over pivots, so their number is bounded by PARTS, not by the pivots; pivots still rule out strips within them."""
    monkeypatch.setattr(cluster, "BLOCK", 4)
    for n in (400, 1600):
        vectors = _vectors(spark, n).withColumn("embedder", F.lit(0))
        pivots = cluster.Pivots(vectors, "embedder")
        blocks = cluster._blocks(vectors, "embedder", pivots).collect()
        assert len(blocks) <= cluster.PARTS + 1 and sum(len(b.ids) for b in blocks) == n
        assert max(len(b.parts) for b in blocks) > 1
    monkeypatch.setattr(cluster, "BLOCK", 1024)
    row = {"a_ids": range(8), "b_ids": range(8)} | {f"{s}_m": blocks[0].m[: 8 * 64] for s in "ab"}
    part = lambda *places: [{"pivot": i, "start": p, "lo": 0.0, "hi": 0.1} for i, p in places]
    apart = np.array([[0.0, 2.0], [2.0, 0.0]])
    met = [(i.tolist(), j.tolist()) for i, j, _ in cluster._near(row | {"a_parts": part((0, 0), (1, 3)), "b_parts": part((1, 0))}, 2.0, apart)]
    assert len(met) == 2  # all angles are within
    near = [set(i.tolist()) for i, _, _ in cluster._near(row | {"a_parts": part((0, 0), (1, 3)), "b_parts": part((1, 0))}, 0.5, apart)]
    assert near and all(i <= set(range(3, 8)) for i in near)


def test_vectors_become_rows_without_python_numbers():
    x = np.arange(12.0).reshape(4, 3)
    v = pa.chunked_array([pa.array(list(x[:1]), pa.list_(pa.float32())), pa.array(list(x), pa.list_(pa.float32())).slice(1)])
    np.testing.assert_array_equal(cluster._matrix(v), x)
    for bad in ([[1.0], [1.0, 2.0]], [[1.0], None]):
        with pytest.raises(ValueError, match="one length"):
            cluster._matrix(pa.array(bad))


def test_levels_bound_the_pairs_of_a_linkage(spark, monkeypatch):
    """Pairs within the whole cut are quadratic in the vectors; a level has some for each cluster, and levels and rounds give what one task's linkage gives."""
    x = np.random.default_rng(5).normal(size=(200, 8))
    x[100:110] = x[100] + np.random.default_rng(6).normal(size=(10, 8)) * 1e-3
    vectors = spark.createDataFrame([(i, 0, r.tolist()) for i, r in enumerate(x)], "id long, embedder long, v array<double>").localCheckpoint()
    want = {tuple(r) for r in cluster.complete_linkage(vectors, 0.7, 2).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    within = int((np.triu(1 - u @ u.T, 1)[np.triu_indices(200, 1)] <= 0.7).sum())
    pairs, rounds = [], cluster._rounds
    monkeypatch.setattr(cluster, "_rounds", lambda edges: pairs.append(edges.count()) or rounds(edges))
    monkeypatch.setattr(cluster, "FEW", 400)
    monkeypatch.setattr(cluster, "DEGREE", 2)
    # clusters of more than 4 vectors are dealt out, their pairs summed up
    monkeypatch.setattr(cluster, "BLOCK", 4)
    assert {tuple(r) for r in cluster.complete_linkage(vectors, 0.7, 2, part=5).collect()} == want
    assert len(pairs) > 1 and max(pairs) < within / 2


def test_strips_cut_no_cluster_that_fits(monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 4)
    names = np.array([1, 1, 1, 2, 2, 3, 3, 3, 3, 3, 3, 4])
    assert [(s, e) for s, e, _ in cluster._strips(None, 12, names)] == [(0, 3), (3, 5), (5, 9), (9, 12)]


def test_wide_rows_leave_arrow_one_by_one(spark):
    from lumora.sources.shared import small_batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    rows = spark.range(0, 4, 1, 1).selectExpr("repeat('x', 2000000) AS t").mapInArrow(sizes, "n long")
    with small_batches(spark):
        assert [r.n for r in rows.collect()] == [1, 1, 1, 1]
    assert [r.n for r in rows.collect()] == [4]


def test_captions_reach_python_in_batches_of_bounded_bytes(spark, monkeypatch, tmp_path):
    from lumora.operators import retrieval
    from lumora.sources import shared

    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    monkeypatch.setattr(caption_index, "small_batches", lambda s, size: seen.append(size) or shared.small_batches(s, size))
    index = retrieval.caption_index(spark, str(tmp_path / "index"))
    captions = spark.createDataFrame([(i, f"of the thing {i}") for i in range(30)], "image_id long, caption string")
    was = spark.conf.get(key)
    assert index.add(captions) == 30 and index.index().terms.where("term = 'thing'").count() == 30
    # far below Spark's own bound, which holds again after it
    assert seen and max(seen) <= 4 << 20 and spark.conf.get(key) == was


@pytest.mark.parametrize("name", ["import_scored_tags", "import_tags", "insert_ignore"])
def test_new_rows_meet_old_ones_in_partitions_by_the_input(spark, name, monkeypatch):
    """Neither the manifest's join nor that with old rows has a fixed number of partitions, which would grow with the input."""
    monkeypatch.setattr(catalog, "LINES_AT_ONCE", 4096)
    n = Catalog(spark, FOLDER).line_parts
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = registry.queries()[name](spark, FOLDER)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = {int(p) for p in re.findall(r"hashpartitioning\((?:image_id|id)#[^)]*, (\d+)\)", plan)}
    assert n > 20 and dealt == {n}


def test_rows_with_null_keys_come_in_beside_dealt_ones(spark):
    old = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.4), (None, "d", 0.1)], "image_id long, value string, confidence double")
    new = spark.createDataFrame([(1, "a", 0.9), (3, "c", 0.2), (3, "c", 0.3), (None, "d", 0.4), (None, "d", 0.4)], old.schema)
    one, dealt = (sorted(map(str, writes.insert_or_ignore(old, new, ["image_id", "value"], [F.desc("confidence")], parts).collect())) for parts in (None, 5))
    assert one == dealt and len(one) == 6 and sum("0.3" in r for r in one) == 1


def test_pairs_join_parts_without_python_numbers():
    """Where all vectors of two strips are near, their million pairs are arrays only; edges span what they connect and no more."""
    n = 512
    x, y = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(n, 2 * n)))
    parent = np.arange(2 * n)
    tracemalloc.start()
    edges = cluster._joined(parent, x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not parent.any() and sum(len(a) for a, _ in edges) == 2 * n - 1
    assert peak < 64 * n * n  # eight numbers a pair
    rng = np.random.default_rng(7)
    for pairs in (5, 60, 400):
        parent, want = np.arange(100), np.arange(100)
        x, y = rng.integers(0, 100, (2, pairs))
        edges = [e for part in (slice(0, pairs // 2), slice(pairs // 2, None)) for e in cluster._joined(parent, x[part], y[part])]
        for _ in range(100):
            np.minimum.at(want, x, want[y])
            np.minimum.at(want, y, want[x])
        np.testing.assert_array_equal(parent, want)
        again = np.arange(100)
        a, b = (np.concatenate(c) for c in zip(*edges, strict=True))
        cluster._joined(again, a, b)
        np.testing.assert_array_equal(again, want)
        assert len(a) == 100 - len(set(want))

"""The segmented caption index against one that is built anew."""

import pytest

from lumora.operators import retrieval

WORDS = ["the", "red", "car", "of", "école", "thing", "with", "x"]


def captions(spark, ids, shift=0):
    rows = [(i, " ".join(WORDS[(i * 7 + j * (1 + (i + shift) % 3)) % 8] for j in range(1 + (i + shift) % 9))) for i in ids]
    return spark.createDataFrame(rows + [(900, " "), (901, None)], "image_id long, caption string")


def same(spark, index, rows):
    want = retrieval.made(rows.dropDuplicates())
    for got, made in ((index.index(), want),):
        assert sorted(map(str, got.terms.select("doc", "part", "term", "tf", "positions", "length").collect())) == sorted(map(str, made.terms.select("doc", "part", "term", "tf", "positions", "length").collect()))
        assert [tuple(r) for r in got.whole.collect()] == [tuple(r) for r in made.whole.collect()]
        for f, q in ((retrieval.all_terms, "the Car"), (retrieval.phrase, "red car"), (retrieval.all_terms, "ecole"), (retrieval.phrase, "no such")):
            assert sorted(map(tuple, f(got, q).collect())) == sorted(map(tuple, f(made, q).collect()))


def test_an_import_writes_a_segment_of_its_size(spark, tmp_path):
    index = retrieval.caption_index(spark, str(tmp_path / "i"))
    assert index.add(captions(spark, range(100))) == 100
    assert index.add(captions(spark, range(90, 105))) == 5 and index.segments()[1]["total"] == 5
    same(spark, index, captions(spark, range(105)))
    assert index.add(captions(spark, range(50))) == 0 and len(index.segments()) == 2


def test_changes_removals_and_merges(spark, tmp_path):
    index = retrieval.caption_index(spark, str(tmp_path / "i"))
    index.add(captions(spark, range(60)))
    reader = index.index()
    now = captions(spark, range(10, 60)).unionByName(captions(spark, range(60, 70), 1))
    assert index.sync(now) == (10, 10)
    same(spark, index, now)
    assert index.sync(now) == (0, 0)
    back = captions(spark, range(60))  # what was removed comes back, what came goes
    assert index.sync(back) == (10, 10)
    same(spark, index, back)
    index.merge()
    assert len(index.segments()) == 1
    same(spark, index, back)
    assert reader.terms.select("doc").distinct().count() == 60  # pinned
    index.vacuum()
    same(spark, index, back)


def test_many_imports_are_merged(spark, tmp_path, monkeypatch):
    from lumora.operators import caption_index

    monkeypatch.setattr(caption_index, "SEGMENTS", 2)
    index = retrieval.caption_index(spark, str(tmp_path / "i"))
    for i in range(4):
        index.add(captions(spark, range(i * 5, i * 5 + 5)))
    assert len(index.segments()) <= 2
    same(spark, index, captions(spark, range(20)))


def test_a_stopped_import_leaves_the_index(spark, tmp_path, monkeypatch):
    index = retrieval.caption_index(spark, str(tmp_path / "i"))
    index.add(captions(spark, range(10)))
    monkeypatch.setattr(index.commits, "add", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        index.add(captions(spark, range(30)))
    same(spark, retrieval.caption_index(spark, str(tmp_path / "i")), captions(spark, range(10)))


def test_several_captions_of_one_asset_rank_each(spark):
    rows = spark.createDataFrame([(1, "red car"), (1, "the red red car"), (2, "car")], "image_id long, caption string")
    assert [r.doc for r in retrieval.all_terms(retrieval.made(rows), "red").collect()] == [1, 1]


def test_a_query_reads_its_terms_buckets(spark, tmp_path):
    index = retrieval.caption_index(spark, str(tmp_path / "i"))
    index.add(captions(spark, range(40)))
    plan = retrieval.of_terms(index.index(), ["car"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:120]

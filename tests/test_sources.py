"""Sources and sinks on small files."""

import json

import numpy as np
import pytest

from lumora.sources import files


def test_folder_scan_and_new_files(spark, tmp_path):
    (tmp_path / "Ana").mkdir()
    (tmp_path / "Ana" / "a.JPG").write_bytes(b"one")
    (tmp_path / "Ana" / "b.mp4").write_bytes(b"two")
    (tmp_path / "Ana" / "c.jpg").write_bytes(b"one")
    got = files.scan_folder(spark, str(tmp_path))
    assert sorted((r.kind, r.person, r.extension) for r in got.collect()) == [("image", "Ana", "jpg"), ("image", "Ana", "jpg"), ("video", "Ana", "mp4")]
    known = got.where("kind = 'video'").select("file_hash")
    assert [r.path.rsplit("/", 1)[1] for r in files.new_files(got, known).collect()] == ["a.JPG"]


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id": 1, "v": "a"}\n\n{"id": 2, "v": "b"}\n{"id": 1, "v": "c"}\n')
    assert files.jsonl(spark, str(p), "id long, v string").count() == 3
    assert {r.id: r.v for r in files.jsonl_last(spark, str(p), "id long, v string", "id").collect()} == {1: "c", 2: "b"}
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"7": {"path": "p"}, "x": {"path": "q"}}))
    assert [tuple(r) for r in files.json_manifest(spark, str(m), "path:string").collect()] == [(7, "p")]


def test_resumed_append(spark, tmp_path):
    out = str(tmp_path / "out")
    for n in (3, 5):
        files.append_json(spark.range(n), out, "id")
    assert spark.read.schema("id long").json(out).count() == 5


def test_npy(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.ones((5, 4), np.float32))
    assert files.npy_vectors(spark, str(tmp_path), 4).count() == 5
    with pytest.raises(Exception, match="not"):
        files.npy_vectors(spark, str(tmp_path), 3).count()


def test_later_lines_win_in_split_files_whatever_the_columns_are_called(spark, tmp_path):
    for name, first in (("a.json", 0), ("b.json", 500)):
        (tmp_path / name).write_text("".join(json.dumps({"file": i % 7, "n": first + i}) + "\n" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {r.file: r.n for r in files.jsonl_last(spark, str(tmp_path), "file long, n long", "file").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i % 7: 500 + i for i in range(500)}


def test_whole_numbers_as_names(spark):
    rows = spark.createDataFrame([("x/12.jpg",), ("x/7.tar.gz",), ("x/007.png",), ("x/a1.jpg",), ("3",)], "path string")
    assert [(r.id, r.path) for r in files.integer_stems(rows).collect()] == [(3, "3"), (7, "x/007.png"), (12, "x/12.jpg")]

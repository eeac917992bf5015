"""Sources and sinks of catalog files."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumora.functions.media import extension, file_kind, parent_folder, probed, slug, sprite_count, sprite_cues, vtt_time
from lumora.operators.writes import first_of


def scan_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, modified_at, extension, kind, person, file_hash of all files below path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    p = F.col("path")
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), extension(p).alias("extension"), file_kind(p).alias("kind"), parent_folder(p).alias("person"), F.sha2("content", 256).alias("file_hash"))


def new_files(scanned: DataFrame, known: DataFrame, either: tuple[str, ...] = ("file_hash",)) -> DataFrame:
    """Files that the catalog doesn't have under any of the given columns; one anti-join for each."""
    for c in either:
        scanned = scanned.join(known.select(c).where(F.col(c).isNotNull()), c, "left_anti")
    return first_of(scanned, ["file_hash"], [F.col("path")])


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a declared schema; blank and malformed lines are dropped."""
    names = [f.name for f in schema] if isinstance(schema, StructType) else None
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.dropna("all", subset=names)


def jsonl_last(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines by key where a later line replaces an earlier one. The files' order is their names', then their lines', however a file is split."""
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select(at.alias("_at"), F.from_json("value", schema).alias("r"))
    rows = lines.where(F.col(f"r.{key}").isNotNull()).select("_at", "r.*")
    return first_of(rows, [key], [F.desc("_at")]).drop("_at")


def json_manifest(spark: SparkSession, path: str, value: str) -> DataFrame:
    """{"id": {...}} files as rows: id, and the fields of value (a struct's DDL)."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,struct<{value}>>")).alias("id", "m"))
    return rows.select(F.col("id").try_cast("long").alias("id"), "m.*").where("id is not null")


def vocabulary_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def manifest_against_disk(manifest: DataFrame, scanned: DataFrame) -> DataFrame:
    """present, missing, size_mismatch of a manifest (path, size)."""
    j = manifest.select("path", F.col("size").alias("want")).join(scanned.select("path", "size"), "path", "left")
    return j.agg(F.count_if(F.col("size").isNotNull()).alias("present"), F.count_if(F.col("size").isNull()).alias("missing"), F.count_if(F.col("size") != F.col("want")).alias("size_mismatch"))


def npy_vectors(spark: SparkSession, path: str, dimension: int, rows_at_once: int = 4096) -> DataFrame:
    """file, row, v of .npy matrices below path; a file of another width fails the job."""

    def run(batches):
        for b in batches:
            for file, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                x = np.load(io.BytesIO(raw), allow_pickle=False)
                if x.ndim != 2 or x.shape[1] != dimension:
                    raise ValueError(f"{file} is {x.shape}, not (n, {dimension})")
                for i in range(0, len(x), rows_at_once):
                    part = x[i : i + rows_at_once].astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(range(i, i + len(part)), pa.int64()), pa.array(list(part), pa.list_(pa.float32()))], ["file", "row", "v"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content").mapInArrow(run, "file string, row long, v array<float>")


def webvtt(scenes: DataFrame) -> DataFrame:
    """video, vtt: one cue file for each video from rows (video, scene, lo, hi, text)."""
    cue = F.concat(vtt_time(F.col("lo")), F.lit(" --> "), vtt_time(F.col("hi")), F.lit("\n"), F.coalesce("text", F.lit("")))
    g = scenes.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("scene", cue.alias("cue")))).alias("cues"))
    return g.select("video", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("cues", lambda c: c["cue"]), "\n\n")).alias("vtt"))


def append_json(rows: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the folder doesn't have yet: a run that stopped goes on where it was."""
    spark = rows.sparkSession
    try:
        done = spark.read.schema(rows.schema).json(path).select(key)
        rows = rows.join(done, key, "left_anti")
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").json(path)


def scan_counts(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """person, n, n_new: files of each child folder, and those whose content the catalog lacks."""
    k = known.select("file_hash").distinct().withColumn("_k", F.lit(True))
    return scanned.join(k, "file_hash", "left").groupBy("person").agg(F.count("*").alias("n"), F.count_if(F.col("_k").isNull()).alias("n_new"))


def report(rows: DataFrame, path: str) -> None:
    """One JSON file of a report's rows (a few)."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def sprite_webvtt(videos: DataFrame, interval: float, cols: int, width: int, height: int) -> DataFrame:
    """id, n, vtt: the cue text of each video's sprite sheet (id, duration, url)."""
    n = sprite_count(F.col("duration"), interval)
    return videos.select("id", n.alias("n"), sprite_cues(F.col("url"), n, interval, cols, width, height).alias("vtt"))


def new_videos(probes: DataFrame, known: DataFrame) -> DataFrame:
    """probes (path, file_hash, probe: JSON) that known lacks by hash and by path, with their media columns and processed: 0, or -1 (quarantined) where the JSON doesn't parse.

    Of new files with one content the first by path comes in, as do files without a hash; a path comes once.
    """
    rows = probes
    for c in ("file_hash", "path"):
        rows = rows.join(known.select(c).where(F.col(c).isNotNull()), c, "left_anti")
    rows = first_of(rows, ["path"], [F.col("file_hash"), F.col("probe")])
    rows = first_of(rows.where("file_hash is not null"), ["file_hash"], [F.col("path")]).unionByName(rows.where("file_hash is null"))
    m = rows.withColumn("m", probed(F.col("probe")))
    return m.select("path", "file_hash", "m.*", F.when(F.col("m").isNull(), -1).otherwise(0).alias("processed"))


def integer_stems(scanned: DataFrame) -> DataFrame:
    """id, path of files whose name without extension is a whole number, by id."""
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    return scanned.select(F.when(stem.rlike(r"^\d+$"), stem.try_cast("long")).alias("id"), "path").where("id is not null").orderBy("id")


def relocation_plan(scanned: DataFrame, root: str, generic: tuple[str, ...] = (), skip: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """path, kind, extension, bucket, person_slug of the files (path) below root: the bucket is the top folder, _unsorted for generic ones and stray files.

    Junk and other files have no slug, stray ones of other kinds no row, nor do skipped folders and the names kept at the root.
    """
    parts = F.split(F.expr(f"substring(path, instr(path, '{root}') + {len(root)})"), "/")
    rows = scanned.withColumns({"_p": F.filter(parts, lambda x: x != ""), "kind": file_kind(F.col("path")), "extension": extension(F.col("path"))})
    top, stray = F.col("_p")[0], F.size("_p") == 1
    loose = stray | top.isin(*generic)
    rows = rows.where(F.when(stray, ~top.isin(*keep) & (F.col("kind") != "other")).otherwise(~top.isin(*skip)))
    moved = F.col("kind").isin("image", "video")
    return rows.select("path", "kind", "extension", F.when(loose, "_unsorted").otherwise(top).alias("bucket"), F.when(moved, F.when(loose, "_unsorted").otherwise(slug(top))).alias("person_slug"))

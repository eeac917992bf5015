"""Scenes and transcripts of videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scene_index(rows: DataFrame) -> DataFrame:
    """rows with scene: 0 to n - 1 for each video by start."""
    return rows.withColumn("scene", (F.row_number().over(Window.partitionBy("video").orderBy("start")) - 1).cast("long"))


def cues_in_scenes(cues: DataFrame, scenes: DataFrame) -> DataFrame:
    """Each cue with the scene whose [lo, hi) holds its midpoint; scenes of a video don't overlap, so that is one. The equi-join on the video keeps the range condition local."""
    mid = (F.col("start") + F.col("end")) / 2
    j = cues.join(scenes, "video").where((mid >= F.col("lo")) & (mid < F.col("hi")))
    order = Window.partitionBy("video", "scene").orderBy("start", "turn")
    return j.withColumn("segment", (F.row_number().over(order) - 1).cast("long"))


def transcripts(placed: DataFrame) -> DataFrame:
    """video, scene, n_cues, transcript: texts in order."""
    g = placed.groupBy("video", "scene").agg(F.count("*").alias("n_cues"), F.array_sort(F.collect_list(F.struct("segment", "text"))).alias("cues"))
    return g.select("video", "scene", "n_cues", F.array_join(F.transform("cues", lambda c: c["text"]), " ").alias("transcript"))


def without_scenes(videos: DataFrame, scenes: DataFrame) -> DataFrame:
    """Videos still to be cut."""
    return videos.join(scenes.select(F.col("video").alias("id")), "id", "left_anti")


def enriched(scenes: DataFrame, tags: DataFrame, captions: DataFrame, transcripts: DataFrame, faces: DataFrame) -> DataFrame:
    """scenes (video, scene, ...) in order with tagged, captioned, transcribed and face_count, from their children (video, scene)."""
    key = ["video", "scene"]
    for name, rows in (("tags", tags), ("captions", captions), ("transcripts", transcripts), ("faces", faces)):
        scenes = scenes.join(rows.groupBy(*key).agg(F.count("*").alias(f"_{name}")), key, "left")
    n = lambda name: F.coalesce(f"_{name}", F.lit(0))
    out = scenes.withColumns({"tagged": n("tags") > 0, "captioned": n("captions") > 0, "transcribed": n("transcripts") > 0, "face_count": n("faces").cast("long")})
    return out.drop("_tags", "_captions", "_transcripts", "_faces").orderBy(*key)

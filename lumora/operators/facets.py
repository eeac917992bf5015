"""Facet counts. A disjunctive facet drops its own category's filter; all categories come from one scan of the tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions.media import duration_bucket, orientation


def disjunctive(assets: DataFrame, pairs: DataFrame, active: dict[str, list[str]], name: str = "category", dealt: bool = False) -> DataFrame:
    """name, value, n: distinct assets with each value, under every active filter but the one of the value's own category.

    pairs: id, name, value; assets: those that meet all other filters. An asset counts towards a category
    if it misses no filter, or only that category's. Pairs are dealt by asset once, unless they come so (dealt), for the distinct, the misses and the join;
    an asset's misses are maxima over its own rows.
    """
    rows = pairs.select("id", name, "value")
    rows = (rows if dealt else rows.repartition("id")).distinct().join(assets.select("id"), "id", "left_semi")
    if active:
        own = Window.partitionBy("id")
        hits = [F.max(F.coalesce((F.col(name) == c) & F.col("value").isin(v), F.lit(False)).cast("int")).over(own) for c, v in active.items()]
        rows = rows.select("*", *(h.alias(f"h{i}") for i, h in enumerate(hits)))
        n = sum((1 - F.col(f"h{i}") for i in range(len(hits))), F.lit(0))
        missed = F.coalesce(*(F.when(F.col(f"h{i}") == 0, F.lit(c)) for i, c in enumerate(active)), F.lit(None).cast("string"))
        rows = rows.where((n == 0) | ((n == 1) & (missed == F.col(name))))
    return rows.groupBy(name, "value").agg(F.count("*").alias("n"))


def tag_facets(assets: DataFrame, tags: DataFrame, active: dict[str, list[str]], dealt: bool = False) -> DataFrame:
    return disjunctive(assets, tags.select(F.col("image_id").alias("id"), "category", "value"), active, dealt=dealt)


def label_facets(assets: DataFrame, labels: DataFrame, active: dict[str, list[str]]) -> DataFrame:
    return disjunctive(assets, labels.select(F.col("asset_id").alias("id"), "set_name", "value"), active, "set_name")


def people_facet(assets: DataFrame) -> DataFrame:
    """person, n over assets under all filters but person's own."""
    return assets.where("person is not null").groupBy("person").agg(F.countDistinct("id").alias("n"))


def row_facets(tags: DataFrame) -> DataFrame:
    """The older facets: tag rows, so several sources of one value count each."""
    return tags.groupBy("category", "value").agg(F.count("*").alias("n"))


def video_facets(videos: DataFrame) -> DataFrame:
    """facet, value, n for bucket, orientation, audio, person and rating, in one pass; missing values are left out."""
    rows = videos.select(
        duration_bucket(F.col("duration")).alias("bucket"),
        orientation(F.col("width"), F.col("height")).alias("orientation"),
        F.when(F.col("has_audio"), "yes").otherwise("no").alias("audio"),
        "person",
        "rating",
    )
    long = rows.selectExpr("stack(5, 'bucket', bucket, 'orientation', orientation, 'audio', audio, 'person', person, 'rating', rating) AS (facet, value)")
    return long.where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def ordered(counts: DataFrame) -> DataFrame:
    """category, value, n, place: facet counts with their place in the category, largest first, then by value."""
    w = Window.partitionBy("category").orderBy(F.desc("n"), "value")
    return counts.select("category", "value", "n", F.row_number().over(w).cast("long").alias("place"))

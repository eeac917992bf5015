"""Results made elsewhere coming into the catalog: ids checked, rows put in once, provenance kept; and scores applied as tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.functions.media import RATING_MAP, first_rating, mapped
from lumora.operators.writes import exploded_tags, insert_or_ignore


def known_only(rows: DataFrame, manifest: DataFrame, key: str = "image_id", parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of known ids, one row n_unknown). Rows meet the ids in parts partitions, where given, and none is broadcast."""
    ids = manifest.select(F.col("id").alias(key))
    if parts is not None:  # rows follow the ids; dealt themselves, the join would go below that
        ids = ids.repartition(parts, key).hint("merge")
    return rows.join(ids, key, "left_semi"), rows.join(ids, key, "left_anti").agg(F.count("*").alias("n_unknown"))


def tags(old: DataFrame, rows: DataFrame, manifest: DataFrame, source: str, parts: int | None = None) -> DataFrame:
    """old (image_id, category, value, tag_source, confidence) with the tags of rows (image_id, tags: a map of category to values) of known ids; rows that are there stay as they are. parts: as for scored_tags."""
    new = exploded_tags(known_only(rows, manifest, parts=parts)[0]).withColumns({"tag_source": F.lit(source), "confidence": F.lit(None).cast("double")})
    return insert_or_ignore(old, new.select(*old.columns), ["image_id", "category", "value", "tag_source"], [F.col("confidence")], parts)


def scored_tags(old: DataFrame, rows: DataFrame, manifest: DataFrame, run_id: Column | None = None, parts: int | None = None) -> DataFrame:
    """old with the scored tags of rows (image_id, rows: an array of category, value, confidence, tag_source) of known ids.

    Each new tag keeps its own confidence and source; a key (image, category, value, source) that is there stays
    as it is, and of equal new ones the first in its array comes in. run_id, if old has that column, is provenance only.
    parts: the partitions in which rows meet the manifest and old, by the input's size, so that none grows with it; the session's number by default.
    """
    new = known_only(rows, manifest, parts=parts)[0].select("image_id", F.posexplode("rows").alias("at", "r")).select("image_id", "at", "r.*")
    if "run_id" in old.columns:
        new = new.withColumn("run_id", F.lit(None).cast(dict(old.dtypes)["run_id"]) if run_id is None else run_id)
    return insert_or_ignore(old, new.withColumn("value", F.col("value").cast("string")), ["image_id", "category", "value", "tag_source"], [F.col("at")], parts)


def finalised(images: DataFrame, labels: DataFrame, rows: DataFrame, rating_set: str = "Rating") -> tuple[DataFrame, DataFrame]:
    """(images, labels) after an import of rows (as for scored_tags, of known ids): images with tags are processed and take the rating that their first rating tag stands for.

    labels: asset_id, set_name, value. An unrated image loses its label of the set, one without a rating tag keeps it.
    """
    some = rows.where(F.size("rows") > 0).select(F.col("image_id").alias("id"), first_rating(F.col("rows")).alias("_rating"), F.lit(True).alias("_new"))
    out = images.join(some.select("id", "_new"), "id", "left").withColumn("processed", F.coalesce("_new", "processed")).select(*images.columns)
    rated = some.where("_rating is not null").select(F.col("id").alias("asset_id"), F.lit(rating_set).alias("set_name"), mapped(F.col("_rating"), RATING_MAP).alias("value"))
    kept = labels.join(rated.select("asset_id", "set_name"), ["asset_id", "set_name"], "left_anti").select(*labels.columns)
    return out, kept.unionByName(rated.where("value != 'unrated'").select(*labels.columns))


def captions(old: DataFrame, rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """old (image_id, model, caption) with captions of known ids that aren't blank; one for an image and model, the first by text where several come."""
    new = known_only(rows, manifest)[0].where("trim(caption) != ''").select(*old.columns)
    return insert_or_ignore(old, new, ["image_id", "model"], [F.col("caption")])


def regions(images: DataFrame, rows: DataFrame, score: int = 4) -> DataFrame:
    """images with region_json and checked: regions of rows (image_id, regions: an array of structs) as JSON. An image that rows doesn't have keeps what it had (null, false where the columns are new)."""
    have = images
    if "region_json" not in images.columns:
        have = images.withColumns({"region_json": F.lit(None).cast("string"), "checked": F.lit(False)})
    r = rows.select(F.col("image_id").alias("id"), F.to_json("regions").alias("_json"))
    out = have.join(r, "id", "left")
    return out.withColumns({"region_json": F.coalesce("_json", "region_json"), "checked": F.col("checked") | F.col("_json").isNotNull()}).drop("_json")


def finished(status: DataFrame, tiers: tuple[str, ...]) -> DataFrame:
    """id of those for which every tier of status (id, tier, ok) has succeeded; a tier that failed later counts as failed."""
    return status.where(F.col("tier").isin(*tiers)).groupBy("id", "tier").agg(F.bool_and("ok").alias("ok")).where("ok").groupBy("id").count().where(F.col("count") == len(tiers)).select("id")


def applied(old: DataFrame, scores: DataFrame, category: str, value: str, source: str, threshold: float, strict: bool = True, confidence: Column | None = None) -> DataFrame:
    """The tag rows that scores (id, score) above the threshold (or at it too) would add to old: a dry run. Union them to apply. Their confidence is the given one, null by default."""
    over = F.col("score") > threshold if strict else F.col("score") >= threshold
    new = scores.where(over).select(F.col("id").alias("image_id"), F.lit(category).alias("category"), F.lit(value).alias("value"), F.lit(source).alias("tag_source"), (F.lit(None) if confidence is None else confidence).cast("double").alias("confidence"))
    return new.join(old.select("image_id", "category", "value", "tag_source"), ["image_id", "category", "value", "tag_source"], "left_anti").select(*old.columns)


def gated(rows: DataFrame, covered: Column, state: DataFrame) -> DataFrame:
    """rows if the condition on state's single row holds, else none."""
    return rows.crossJoin(F.broadcast(state.where(covered).select(F.lit(True).alias("_g")).limit(1))).drop("_g")


def tags_rebuilt(old: DataFrame) -> DataFrame:
    """Tag rows under the key with tag_source, vlm where there was none; the most confident of equal keys stays."""
    rows = old.withColumn("tag_source", F.coalesce("tag_source", F.lit("vlm")))
    return rows.groupBy("image_id", "category", "value", "tag_source").agg(F.max("confidence").alias("confidence"))


def both_taggers(one: DataFrame, two: DataFrame, names: tuple[str, str]) -> DataFrame:
    """The rows of two taggers under their names."""
    return one.withColumn("tag_source", F.lit(names[0])).unionByName(two.withColumn("tag_source", F.lit(names[1])))

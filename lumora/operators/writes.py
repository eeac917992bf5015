"""Mutations as DataFrame rewrites: the old table in, the new table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the given order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """Existing rows win and stay as they are; of new rows with one key the first goes in. Null keys never clash.

    Where both grow, narrow rows of both are dealt to parts partitions by key, and old ones are read once; else new ones are joined with the keys of the old.
    """
    keyed = new.where(" and ".join(f"{k} is not null" for k in key))
    null = new.where(" or ".join(f"{k} is null" for k in key)).select(*old.columns)
    if parts is None:
        return old.unionByName(first_of(keyed, key, order).join(old.select(*key), key, "left_anti").select(*old.columns)).unionByName(null)
    both = old.withColumn("_new", F.lit(False)).unionByName(keyed.withColumn("_new", F.lit(True)), allowMissingColumns=True).repartition(parts, *key)
    at = F.row_number().over(Window.partitionBy(*key).orderBy("_new", *order))
    return both.withColumn("_r", at).where("not _new or _r = 1").select(*old.columns).unionByName(null)


def upsert_non_null(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New values replace old ones where they are not null."""
    others = [c for c in old.columns if c not in key]
    n = new.select(*key, *(F.col(c).alias(f"_{c}") for c in others))
    return old.join(n, key, "full").select(*key, *(F.coalesce(f"_{c}", c).alias(c) for c in others)).select(*old.columns)


def replace_by_key(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All old rows of a key that new has go; new's come in."""
    return old.join(new.select(*key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def newest(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """ON CONFLICT DO UPDATE over a union: the latest row of each key."""
    return first_of(rows, key, [F.col(at).desc_nulls_last(), *(F.col(c) for c in sorted(rows.columns) if c not in (*key, at))])


def assign_labels(labels: DataFrame, sets: DataFrame, new: DataFrame) -> DataFrame:
    """labels and new: asset_id, set_name, value; sets: set_name, single_select. A single-select set keeps the new value only, the largest if there are several; others add."""
    kind = new.join(sets, "set_name")
    single = first_of(kind.where("single_select"), ["asset_id", "set_name"], [F.desc("value")]).select(*labels.columns)
    multi = kind.where("not single_select").select(*labels.columns).distinct()
    kept = labels.join(single.select("asset_id", "set_name"), ["asset_id", "set_name"], "left_anti").select(*labels.columns)
    return kept.unionByName(single).unionByName(multi.join(kept, ["asset_id", "set_name", "value"], "left_anti"))


def clear_source(tags: DataFrame, source: str) -> DataFrame:
    return tags.where(~F.coalesce(F.col("tag_source") == source, F.lit(False)))


def batch_flag(assets: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id, action) with ok: whether the asset exists."""
    known = assets.select("id", F.lit(True).alias("known"))
    return wanted.join(known, "id", "left").select("id", "action", F.coalesce("known", F.lit(False)).alias("ok"))


def flagged(assets: DataFrame, wanted: DataFrame) -> DataFrame:
    w = wanted.select("id", F.col("action").alias("_a"))
    return assets.join(w, "id", "left").withColumn("flag_action", F.coalesce("_a", "flag_action")).select(*assets.columns)


def exploded_tags(rows: DataFrame, column: str = "tags") -> DataFrame:
    """A map of category to values as tag rows."""
    return rows.select("image_id", F.explode(column).alias("category", "vs")).select("image_id", "category", F.explode("vs").alias("value"))


def next_order(items: DataFrame, new: DataFrame) -> DataFrame:
    """new (collection_id, image_id) with sort_order after the collection's largest."""
    top = items.groupBy("collection_id").agg(F.max("sort_order").alias("top"))
    r = F.row_number().over(Window.partitionBy("collection_id").orderBy("image_id"))
    return new.join(top, "collection_id", "left").select("collection_id", "image_id", (F.coalesce("top", F.lit(-1)) + r).cast("long").alias("sort_order"))


def unknown_ids(rows: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(known.select(key), key, "left_anti")


def add_missing_columns(rows: DataFrame, schema) -> DataFrame:
    """Schema evolution: columns that schema has and rows lacks come as nulls; columns it lacks go; runs twice to the same end."""
    have = set(rows.columns)
    return rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def labels_adopted(labels: DataFrame, sets: DataFrame, new: DataFrame) -> DataFrame:
    """assign_labels where a row without a set (asset_id, category in its place, value) is taken into the set of that name when the same value is assigned.

    labels: asset_id, set_name, category, value.
    """
    legacy = labels.where("set_name is null").join(new.select("asset_id", F.col("set_name").alias("category"), "value"), ["asset_id", "category", "value"], "left_semi")
    rest = labels.where("set_name is not null").select("asset_id", "set_name", "value")
    now = assign_labels(rest, sets, new).withColumn("category", F.col("set_name"))
    free = labels.where("set_name is null").join(legacy, ["asset_id", "category", "value"], "left_anti")
    return now.select("asset_id", "set_name", "category", "value").unionByName(free.select("asset_id", "set_name", "category", "value"))


def labels_cleared(labels: DataFrame, assets: DataFrame, set_name: str) -> DataFrame:
    """labels without those of a set on assets (asset_id)."""
    gone = assets.select("asset_id", F.lit(set_name).alias("set_name"))
    return labels.join(gone, ["asset_id", "set_name"], "left_anti").select(*labels.columns)


def set_deleted(sets: DataFrame, labels: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(sets, labels) without a set; its labels go with it."""
    return sets.where(F.col("set_name") != name), labels.where(~F.coalesce(F.col("set_name") == name, F.lit(False)))


def patched(rows: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """rows with the fields of changes that are not null; changes of unknown keys are dropped."""
    return upsert_non_null(rows, changes.join(rows.select(*key), key, "left_semi"), key)


def notes_written(notes: DataFrame, new: DataFrame) -> DataFrame:
    """notes (id, asset_id, content) where the first note of an asset takes the content of new (asset_id, content); an asset without one gets a row, whose id the store gives (null here)."""
    first = notes.groupBy("asset_id").agg(F.min("id").alias("id"))
    hit = first.join(new.select("asset_id", F.col("content").alias("_c"), F.lit(True).alias("_w")), "asset_id")
    changed = notes.join(hit.select("id", "_c", "_w"), "id", "left").select("id", "asset_id", F.when(F.col("_w"), F.col("_c")).otherwise(F.col("content")).alias("content"))
    return changed.unionByName(new.join(first, "asset_id", "left_anti").select(F.lit(None).cast("long").alias("id"), "asset_id", "content"))


def scene_faces_replaced(old: DataFrame, found: DataFrame) -> DataFrame:
    """old (video, scene, face_index, box, score, embedded) with the faces of found (video, scene, faces: structs of box and score) in their scenes' place, in order and not yet embedded; a scene found without faces is left with none."""
    rest = old.join(found.select("video", "scene"), ["video", "scene"], "left_anti").select(*old.columns)
    new = found.select("video", "scene", F.posexplode("faces").alias("i", "f"))
    new = new.select("video", "scene", F.col("i").cast("long").alias("face_index"), F.col("f.box").alias("box"), F.coalesce("f.score", F.lit(0.0)).alias("score"), F.lit(0).alias("embedded"))
    return rest.unionByName(new.select(*old.columns))


def rejected(assets: DataFrame, wanted: DataFrame, folder: str = "_rejected") -> tuple[DataFrame, DataFrame]:
    """(assets, moves): assets (id, path, file_hash, flag_action) after wanted (id, action), and from, to of the files to move.

    A rejected asset's path becomes folder/<name>. Where a file of that name is there, or an earlier one (by id) of the batch takes it, the first eight characters
    of its hash (or else of its name) come before the extension. An asset that lies in the folder stays where it is.
    """
    w = wanted.select("id", F.col("action").alias("_a"))
    rows = assets.join(w, "id", "left")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    stem, suffix = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^.+?(\.[^.]*)?$", 1)
    go = (F.col("_a") == "reject") & ~F.col("path").startswith(f"{folder}/")
    taken = assets.where(F.col("path").startswith(f"{folder}/")).select(F.col("path").alias("_to"), F.lit(True).alias("_taken")).distinct()
    moved = rows.where(go).select("id", F.col("path").alias("from"), F.concat(F.lit(f"{folder}/"), name).alias("_to"), F.concat(F.lit(f"{folder}/"), stem, F.lit("_"), F.coalesce(F.nullif(F.substring("file_hash", 1, 8), F.lit("")), F.substring(stem, 1, 8)), suffix).alias("_other"))
    moved = moved.join(taken, "_to", "left").withColumn("_r", F.row_number().over(Window.partitionBy("_to").orderBy("id")))
    moves = moved.select("id", "from", F.when(F.col("_taken") | (F.col("_r") > 1), F.col("_other")).otherwise(F.col("_to")).alias("to"))
    out = rows.join(moves.select("id", "to"), "id", "left").withColumns({"path": F.coalesce("to", "path"), "flag_action": F.coalesce("_a", "flag_action")})
    return out.select(*assets.columns), moves


def upsert_given(old: DataFrame, new: DataFrame, key: list[str], given: list[str]) -> DataFrame:
    """Rows of old take new's given columns, nulls too, where the keys (not null) are equal; new keys come in, with nulls in the columns that new lacks. One new row a key: the first by its values."""
    one = first_of(new.where(" and ".join(f"{k} is not null" for k in key)), key, [F.col(c) for c in given])
    n = one.select(*key, *(F.col(c).alias(f"_{c}") for c in given), F.lit(True).alias("_new"))
    there = old.join(n, key, "left").select(*(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in old.columns))
    kinds = dict(old.dtypes)
    fresh = one.join(old.select(*key), key, "left_anti").select(*(F.col(c).cast(kinds[c]) if c in (*key, *given) else F.lit(None).cast(kinds[c]).alias(c) for c in old.columns))
    return there.unionByName(fresh)


def values_added(values: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(values, answer): values (id, set_name, value) with the new ones (set_name, value), and each asked pair with its id, created or there already.

    New ids follow the largest one by set and value; they are numbered by one window over the new pairs, which a user types.
    """
    asked = new.select("set_name", "value").distinct()
    fresh = asked.join(values.select("set_name", "value"), ["set_name", "value"], "left_anti")
    last = values.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    made = fresh.crossJoin(F.broadcast(last)).select((F.col("last") + F.row_number().over(Window.orderBy("set_name", "value"))).alias("id"), "set_name", "value")
    out = values.select("id", "set_name", "value").unionByName(made)
    answer = asked.join(out, ["set_name", "value"]).join(made.select("id", F.lit(True).alias("_c")), "id", "left").select("set_name", "value", "id", F.coalesce("_c", F.lit(False)).alias("created"))
    return out, answer

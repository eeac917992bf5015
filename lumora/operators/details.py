"""Rows for display and ingest bookkeeping: cards, details, thresholds, plans over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cards(assets: DataFrame, tags: DataFrame) -> DataFrame:
    """assets with tags: their (category, value) structs in order; one aggregate of the tags, joined once."""
    t = tags.groupBy(F.col("image_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("category", "value"))).alias("tags"))
    return assets.join(t, "id", "left")


def details(assets: DataFrame, tags: DataFrame, captions: DataFrame, labels: DataFrame, rating_set: str, rating_tag: str) -> DataFrame:
    """id, n_tags, n_captions, rating (label, else machine tag, else unrated): each child is counted before its join, so children don't multiply."""
    t = tags.groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("n_tags"), F.min(F.when(F.col("category") == rating_tag, F.col("value"))).alias("machine"))
    c = captions.groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("n_captions"))
    r = labels.where(F.col("set_name") == rating_set).groupBy(F.col("asset_id").alias("id")).agg(F.min("value").alias("label"))
    out = assets.select("id").join(t, "id", "left").join(c, "id", "left").join(r, "id", "left")
    zero = F.lit(0).cast("long")
    return out.select("id", F.coalesce("n_tags", zero).alias("n_tags"), F.coalesce("n_captions", zero).alias("n_captions"), F.coalesce("label", "machine", F.lit("unrated")).alias("rating"))


def label_sets(labels: DataFrame) -> DataFrame:
    """set_name, n_assets, choices: the values in order, comma-joined."""
    return labels.groupBy("set_name").agg(F.countDistinct("asset_id").alias("n_assets"), F.array_join(F.array_sort(F.collect_set("value")), ",").alias("choices"))


def threshold_tags(tags: DataFrame, thresholds: dict[str, float], best_of: str) -> DataFrame:
    """Tags at or over their category's threshold; of the category best_of only each asset's most confident (by name where equal)."""
    limit = F.lit(None).cast("double")
    for category, least in thresholds.items():
        limit = F.when(F.col("category") == category, F.lit(least)).otherwise(limit)
    over = tags.where((F.col("category") != best_of) & (F.col("confidence") >= limit)).select("image_id", "category", "value", "confidence")
    best = tags.where(F.col("category") == best_of).groupBy("image_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "value")).alias("b"))
    return over.unionByName(best.select("image_id", F.lit(best_of).alias("category"), F.col("b.value").alias("value"), (-F.col("b.c")).alias("confidence")))


def leftovers(rest: DataFrame, index: DataFrame) -> DataFrame:
    """total, duplicate, unique: which files (hash) the index has already."""
    known = index.select("hash").distinct().withColumn("known", F.lit(True))
    return rest.join(known, "hash", "left").agg(F.count("*").alias("total"), F.count_if("known").alias("duplicate"), F.count_if(F.col("known").isNull()).alias("unique"))


def transform_plan(files: DataFrame, keep_if_not_smaller: bool = True) -> DataFrame:
    """files (size, new_size, done) with action: skip what is done, keep what wouldn't shrink, convert the rest."""
    grows = (F.col("new_size") >= F.col("size")) if keep_if_not_smaller else F.lit(False)
    return files.withColumn("action", F.when(F.col("done"), "skip").when(grows, "keep").otherwise("convert"))


def transform_summary(plan: DataFrame) -> DataFrame:
    """action, extension, n, saved, saved_pct."""
    saved = F.when(F.col("action") == "convert", F.col("size") - F.col("new_size")).otherwise(0.0)
    g = plan.groupBy("action", "extension").agg(F.count("*").alias("n"), F.round(F.sum(saved), 2).alias("saved"), F.round(F.coalesce(F.try_divide(F.sum(saved) * 100, F.sum("size")), F.lit(0.0)), 2).alias("saved_pct"))
    return g


def event_members(members: DataFrame, owners: dict[str, DataFrame]) -> DataFrame:
    """members (event, owner_type, owner_id) with the owner's name: one join for each kind of owner (id, name)."""
    out = None
    for kind, table in owners.items():
        j = members.where(F.col("owner_type") == kind).join(table.select(F.col("id").alias("owner_id"), "name"), "owner_id").select("event", "owner_type", "owner_id", "name")
        out = j if out is None else out.unionByName(j)
    return out


def ordered_items(items: DataFrame) -> DataFrame:
    """collection_id, n, ids: a collection's items by sort_order, comma-joined."""
    return items.groupBy("collection_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "image_id"))), lambda s: s["image_id"].cast("string")), ",").alias("ids"))


def blended(scores: DataFrame, by: str, weight: float) -> DataFrame:
    """by, id, score: a min-max scaled composite blended with a model's score within each by."""
    w = Window.partitionBy(by)
    low, high = F.min("composite").over(w), F.max("composite").over(w)
    scaled = F.coalesce(F.try_divide(F.col("composite") - low, high - low), F.lit(0.0))
    return scores.select(by, "id", F.round((1 - weight) * scaled + weight * F.coalesce("model", F.lit(0.0)), 6).alias("score"))


def best_of_each(scores: DataFrame, by: str) -> DataFrame:
    """The highest score of each by, the smallest id where equal."""
    return scores.groupBy(by).agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b")).select(by, F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"))


def results(assets: DataFrame, tags: DataFrame, labels: DataFrame, rating_set: str, rating_tag: str) -> DataFrame:
    """assets with tags (structs of category, value, confidence, in order) and rating: the label's, else the machine tag's first, else null."""
    t = tags.groupBy(F.col("image_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("category", "value", "confidence"))).alias("tags"))
    r = labels.where(F.col("set_name") == rating_set).groupBy(F.col("asset_id").alias("id")).agg(F.min("value").alias("label"))
    out = assets.join(t, "id", "left").join(r, "id", "left")
    machine = F.try_element_at(F.filter("tags", lambda x: x["category"] == rating_tag), F.lit(1))["value"]
    return out.withColumn("rating", F.coalesce("label", machine)).drop("label")


def full(assets: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """assets (id) with each child table's rows (id and any columns) as an ordered array of structs, empty where there are none; each child is gathered before its join."""
    for name, rows in children.items():
        columns = [c for c in rows.columns if c != "id"]
        g = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        assets = assets.join(g, "id", "left").withColumn(name, F.coalesce(name, F.filter(F.array(F.struct(*(F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c != "id"))), lambda x: F.lit(False))))
    return assets


def in_rank_order(ranked: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (id) of the ranked ids (id, rank), by rank; ids without a row are skipped."""
    return ranked.select("id", "rank").join(rows, "id").orderBy("rank")


def ordered_scenes(videos: DataFrame, scenes: DataFrame) -> DataFrame:
    """videos (id) with their scenes (video, scene, lo, hi) in order."""
    return full(videos, {"scenes": scenes.withColumnRenamed("video", "id").select("id", "scene", "lo", "hi")})


def unprocessed(assets: DataFrame, person: str | None, most: int) -> DataFrame:
    """The first most assets by id that are not processed, of a person if one is given."""
    rows = assets.where("not processed")
    return (rows if person is None else rows.where(F.col("person") == person)).orderBy("id").limit(most)


def grid_record(ids: DataFrame, name: str) -> DataFrame:
    """name, n, image_ids: a grid's ids (id, rank) as a JSON list in order."""
    g = ids.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("x"))
    return g.select(F.lit(name).alias("name"), "n", F.to_json(F.transform("x", lambda s: s["id"])).alias("image_ids"))


def examples(vectors: DataFrame, positive: DataFrame, negative: DataFrame) -> DataFrame:
    """id, v, side: pos, neg or unlabelled for each stored vector; an id in both lists is pos."""
    p, n = positive.select("id", F.lit(True).alias("_p")), negative.select("id", F.lit(True).alias("_n"))
    j = vectors.join(p.distinct(), "id", "left").join(n.distinct(), "id", "left")
    return j.select("id", "v", F.when(F.col("_p"), "pos").when(F.col("_n"), "neg").otherwise("unlabelled").alias("side"))


def outcomes(videos: DataFrame, done: DataFrame) -> DataFrame:
    """quarantined, skipped, processed, failed: what a backfill over videos (id, processed) did, given done (id, ok) for those it tried."""
    d = done.groupBy("id").agg(F.bool_or("ok").alias("ok"))
    j = videos.join(d, "id", "left")
    open_ = F.col("processed") == 0
    return j.agg(F.count_if(F.col("processed") == -1).alias("quarantined"), F.count_if(F.col("processed") == 1).alias("skipped"), F.count_if(open_ & F.col("ok")).alias("processed"), F.count_if(open_ & ~F.coalesce("ok", F.lit(False))).alias("failed"))


def free_labels(labels: DataFrame) -> DataFrame:
    """Labels (id, asset_id, set_name, category, value) that belong to no set, newest first."""
    return labels.where("set_name is null").select("id", "asset_id", "category", "value").orderBy(F.desc("id"))


def label_map(labels: DataFrame) -> DataFrame:
    """asset_id, sets: each asset's labels (id, set_name, value) as a map of set to a map of value to id; the least id where a value repeats."""
    one = labels.where("set_name is not null").groupBy("asset_id", "set_name", "value").agg(F.min("id").alias("id"))
    s = one.groupBy("asset_id", "set_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "id")))).alias("m"))
    return s.groupBy("asset_id").agg(F.map_from_entries(F.collect_list(F.struct("set_name", "m"))).alias("sets"))


def selection(assets: DataFrame, labels: DataFrame, rating_set: str, person: str | None = None, rating: str | None = None, most: int | None = None) -> DataFrame:
    """id, person, rating of the assets to send out, by id: the rating is the label's or null, and may be asked for."""
    r = labels.where(F.col("set_name") == rating_set).select(F.col("asset_id").alias("id"), F.col("value").alias("rating"))
    rows = assets if person is None else assets.where(F.col("person") == person)
    rows = rows.join(r, "id", "left").select("id", "person", "rating")
    rows = (rows if rating is None else rows.where(F.col("rating") == rating)).orderBy("id")
    return rows if most is None else rows.limit(most)


def pending_posters(videos: DataFrame, most: int | None = None) -> DataFrame:
    """Processed videos with a path whose poster is not locked, by id."""
    rows = videos.where("not poster_locked and path is not null and processed = 1").select("id", "path", "duration").orderBy("id")
    return rows if most is None else rows.limit(most)


def labels_over(rows: DataFrame, names: list[str], least: float = 0.40) -> DataFrame:
    """id, value, score: labels of an array of logits (in the order of names) whose sigmoid reaches least."""
    p = rows.select("id", F.posexplode("logits").alias("i", "z")).select("id", "i", (1 / (1 + F.exp(-F.col("z").cast("double")))).alias("score"))
    value = F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1)
    return p.where(F.col("score") >= least).select("id", value.alias("value"), "score")


def by_ids(assets: DataFrame, ids: list[int]) -> DataFrame:
    """The assets (id) of a list, in its order; unknown ids are skipped, repeated ones come once, where they come first."""
    first = {i: n for n, i in reversed(list(enumerate(ids)))}
    order = assets.sparkSession.createDataFrame(sorted(first.items()), "id long, rank int")
    return in_rank_order(order, assets)


def feed(ranked: DataFrame, rows: DataFrame, state: DataFrame, ready: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """(items, status): rows of the ranked ids in order if the condition on state's single row holds, none otherwise; status is state with degraded, and the reason for it."""
    ok = state.select(ready.alias("_ok")).where("_ok")
    items = in_rank_order(ranked, rows.join(F.broadcast(ok), how="cross").drop("_ok"))
    return items, state.withColumn("degraded", ~ready).withColumn("reason", F.when(~ready, reason))


def labelled_counts(examples: DataFrame) -> DataFrame:
    """n_pos, n_neg, n_unlabelled of examples() and whether a probe can be fit to them."""
    n = lambda side: F.count_if(F.col("side") == side)
    rows = examples.agg(n("pos").alias("n_pos"), n("neg").alias("n_neg"), n("unlabelled").alias("n_unlabelled"))
    return rows.withColumn("fits", (F.col("n_pos") > 0) & (F.col("n_neg") > 0))

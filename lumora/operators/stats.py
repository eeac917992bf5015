"""Operational aggregates over the catalog: counts, coverage, throughput, rule mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)


def catalog_stats(assets: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: total, processed, processed_pct, flagged, people (null counts as one), categories."""
    a = assets.agg(
        F.count("*").alias("total"),
        F.count_if("processed").alias("processed"),
        F.count_if(F.col("flag_action").isNotNull()).alias("flagged"),
        (F.countDistinct("person") + F.max(F.col("person").isNull().cast("int"))).alias("people"),
    )
    c = tags.agg(F.countDistinct("category").alias("categories"))
    return a.crossJoin(c).select("total", "processed", percent(F.col("processed"), F.col("total")).alias("processed_pct"), "flagged", F.col("people").cast("long").alias("people"), "categories")


def group_stats(assets: DataFrame, by: str, ratings: DataFrame | None = None, names: tuple[str, ...] = ()) -> DataFrame:
    """Per group: n, n_processed, n_flagged, and a count for each rating (id, value), unrated where an asset has none."""
    aggs = [F.count("*").alias("n"), F.count_if("processed").alias("n_processed"), F.count_if(F.col("flag_action").isNotNull()).alias("n_flagged")]
    rows = assets
    if ratings is not None:
        rows = assets.join(ratings.select("id", F.col("value").alias("rating")), "id", "left").withColumn("rating", F.coalesce("rating", F.lit("unrated")))
        aggs += [F.count_if(F.col("rating") == r).alias(f"n_{r}") for r in (*names, "unrated")]
    return rows.groupBy(by).agg(*aggs)


def coverage(assets: DataFrame, tiers: dict[str, DataFrame], key: str = "image_id") -> DataFrame:
    """tier, done (distinct assets), total, pct."""
    total = assets.agg(F.count("*").alias("total"))
    rows = None
    for name, t in tiers.items():
        one = t.agg(F.countDistinct(key).alias("done")).select(F.lit(name).alias("tier"), "done")
        rows = one if rows is None else rows.unionByName(one)
    return rows.crossJoin(F.broadcast(total)).withColumn("pct", percent(F.col("done"), F.col("total")))


def throughput(rows: DataFrame, at: str, until: str, minutes: int) -> DataFrame:
    """n, per_minute and latest over the minutes before until (a timestamp literal); zeros when nothing is there."""
    end = F.lit(until).cast("timestamp_ntz")
    some = rows.where((F.col(at) > end - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col(at) <= end))
    return some.agg(F.count("*").alias("n"), F.round(F.count("*") / F.lit(float(minutes)), 4).alias("per_minute"), F.max(at).alias("latest"))


def mine_rules(assets: DataFrame, tags: DataFrame, rules: DataFrame, least: int, top: int, samples: int = 4, skip: tuple[str, ...] = ("rating",)) -> DataFrame:
    """category, value, n (rejected assets), samples: tags of at least that many rejected assets that no rule names yet.

    Rules count even when disabled. The samples are the smallest ids; a partition sends no more than those of a tag.
    """
    rejected = assets.where("flag_action = 'reject'").select(F.col("id").alias("image_id"))
    pairs = tags.where(F.col("category").isNotNull() & ~F.col("category").isin(*skip)).select("image_id", "category", "value").join(rejected, "image_id", "left_semi").distinct()
    found = pairs.groupBy("category", "value").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    first = pairs.withColumn("r", F.row_number().over(Window.partitionBy("category", "value").orderBy("image_id"))).where(F.col("r") <= samples)
    first = first.groupBy("category", "value").agg(F.array_join(F.array_sort(F.collect_list("image_id")), ",").alias("samples"))
    return found.join(first, ["category", "value"]).join(rules.select("category", "value"), ["category", "value"], "left_anti").orderBy(F.desc("n"), "category", "value").limit(top)


def flag_counts(assets: DataFrame) -> DataFrame:
    return assets.where("flag_action is not null").groupBy("flag_action").agg(F.count("*").alias("n"))


def top_values(tags: DataFrame, k: int = 5) -> DataFrame:
    """category, value, n, rank, n_values: the k most frequent values of each category."""
    n = tags.groupBy("category", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("category")
    return n.select("*", F.count("*").over(w).alias("n_values"), F.row_number().over(w.orderBy(F.desc("n"), "value")).cast("long").alias("rank")).where(F.col("rank") <= k)


def rule_matches(tags: DataFrame, rules: DataFrame) -> DataFrame:
    """category, value, enabled, match_count (tag rows)."""
    n = tags.join(F.broadcast(rules.select("category", "value")), ["category", "value"], "left_semi").groupBy("category", "value").agg(F.count("*").alias("match_count"))
    return rules.join(n, ["category", "value"], "left").withColumn("match_count", F.coalesce("match_count", F.lit(0).cast("long")))


def rules_by_category(rules: DataFrame) -> DataFrame:
    """category, n, rule_values (ordered, comma-joined)."""
    return rules.groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("value")), ",").alias("rule_values"))


def vocabulary(tags: DataFrame) -> DataFrame:
    return tags.groupBy("category").agg(F.countDistinct("value").alias("n_values"), F.array_join(F.array_sort(F.collect_set("value")), ",").alias("all_values"))


def hash_prefix_plan(rows: DataFrame, length: int = 12) -> DataFrame:
    """prefix, n, n_hashes, action: files sharing a hash prefix are duplicates if they share the whole hash, else a collision."""
    return rows.groupBy(F.substr("hash", F.lit(1), F.lit(length)).alias("prefix")).agg(F.count("*").alias("n"), F.countDistinct("hash").alias("n_hashes")).where("n > 1").withColumn("action", F.when(F.col("n_hashes") == 1, "dedup").otherwise("full_hash"))


def scene_counts(scenes: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """scenes with the number of rows in each child table (video, scene); children are counted before they are joined."""
    for name, child in children.items():
        n = child.groupBy("video", "scene").agg(F.count("*").alias(name))
        scenes = scenes.join(n, ["video", "scene"], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return scenes


def left_counts(parents: DataFrame, children: DataFrame, key: str, name: str = "n") -> DataFrame:
    """parents with the number of their children, 0 included."""
    n = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def readiness(flags: DataFrame, vectors: DataFrame, assets: DataFrame, least: int = 100, share: float = 0.9) -> DataFrame:
    """keep, reject, maybe, n_vectors, coverage_ok, ready: whether preferences can be learned."""
    f = flags.agg(*(F.coalesce(F.sum(F.when(F.col("flag_action") == a, F.col("n"))), F.lit(0)).cast("long").alias(a) for a in ("keep", "reject", "maybe")))
    v = vectors.agg(F.countDistinct("id").alias("n_vectors"))
    n = assets.agg(F.count("*").alias("total"))
    return f.crossJoin(v).crossJoin(n).select("keep", "reject", "maybe", "n_vectors", (F.col("n_vectors") >= F.floor(F.col("total") * share)).alias("coverage_ok"), ((F.col("keep") + F.col("reject") >= least) & (F.col("keep") > 0) & (F.col("reject") > 0) & (F.col("n_vectors") > 0)).alias("ready"))


def reasons(labels: DataFrame, category: str = "reject_reason", top: int = 12) -> DataFrame:
    """value, n: the most frequent labels of a category, by value where equal."""
    return labels.where(F.col("category") == category).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)


def accuracy(scores: DataFrame, threshold: float) -> DataFrame:
    """n, accuracy of margins (score, y): y 1 should be above the threshold."""
    return scores.agg(F.count("*").alias("n"), F.round(F.avg(((F.col("score") > threshold) == (F.col("y") == 1)).cast("double")), 6).alias("accuracy"))


def run_summary(seconds: DataFrame, backlog: DataFrame) -> DataFrame:
    """done, mean_seconds, left, hours_left: how long the rows of backlog take at the mean of seconds (column seconds)."""
    s = seconds.agg(F.count("*").alias("done"), F.round(F.avg("seconds"), 4).alias("mean_seconds"))
    return s.crossJoin(backlog.agg(F.count("*").alias("left"))).withColumn("hours_left", F.round(F.col("left") * F.col("mean_seconds") / 3600, 2))


def gate(results: DataFrame) -> DataFrame:
    """n, passed: whether there are results (ok) and all are good."""
    return results.agg(F.count("*").alias("n"), (F.coalesce(F.bool_and("ok"), F.lit(False))).alias("passed"))


def readiness_of(vectors: Column, corpus: Column, present: Column, probes: Column, share: float = 0.9) -> Column:
    """ready where all probes have vectors and enough of the corpus has; else insufficient, as for an empty corpus or no probes."""
    return F.when((corpus > 0) & (probes > 0) & (present >= probes) & (vectors >= F.floor(corpus * share)), "ready").otherwise("insufficient")


def duplicate_files(rows: DataFrame, length: int = 12) -> DataFrame:
    """id, action, kept: the files (id, hash) that share a hash prefix with others; of a group with one content the least id is kept, of a collision every file is, under its full hash."""
    plan = hash_prefix_plan(rows, length).select("prefix", "action")
    first = rows.groupBy("hash").agg(F.min("id").alias("first"))
    j = rows.withColumn("prefix", F.substr("hash", F.lit(1), F.lit(length))).join(plan, "prefix").join(first, "hash")
    return j.select("id", "action", ((F.col("action") == "full_hash") | (F.col("id") == F.col("first"))).alias("kept"))


def present(probes: DataFrame, vectors: DataFrame) -> DataFrame:
    """n_probes, n_present: how many of the probe ids have a vector."""
    n = probes.agg(F.count("*").alias("n_probes"))
    return n.crossJoin(probes.join(vectors.select("id"), "id", "left_semi").agg(F.count("*").alias("n_present")))

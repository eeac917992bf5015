"""Queries on cards, details, thresholds and file plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.operators import details, filters, vectors
from lumora.plans.registry import register
from lumora.plans.vectors import _mean
from lumora.sources.catalog import Catalog, cte


@register("asset_cards", cte("images", "tags") + "SELECT i.id, i.person, (SELECT array_to_string(list_sort(list(DISTINCT category || '=' || value)), ';') FROM tags WHERE image_id = i.id) AS tags FROM (SELECT * FROM images ORDER BY filesize DESC, id DESC LIMIT 200) i")
def asset_cards(spark, d):
    c = Catalog(spark, d)
    top = filters.page(filters.sorted_by(c.images, "size"), 1, 200)
    some = c.tags.join(F.broadcast(top.select(F.col("id").alias("image_id"))), "image_id", "left_semi")
    return details.cards(top, some).select("id", "person", F.array_join(F.array_sort(F.transform("tags", lambda t: F.concat_ws("=", t["category"], t["value"]))), ";").alias("tags"))


@register("asset_details", cte("images", "tags", "captions", "labelled") + "SELECT id, coalesce(n_tags, 0) AS n_tags, coalesce(n_captions, 0) AS n_captions, coalesce(l.value, t.machine, 'unrated') AS rating FROM images LEFT JOIN (SELECT image_id, count(*) AS n_tags, min(value) FILTER (category = 'type') AS machine FROM tags GROUP BY 1) t ON t.image_id = id LEFT JOIN (SELECT image_id, count(*) AS n_captions FROM captions GROUP BY 1) c ON c.image_id = id LEFT JOIN (SELECT asset_id, value FROM labelled WHERE set_name = 'Quality') l ON l.asset_id = id")
def asset_details(spark, d):
    c = Catalog(spark, d)
    return details.details(c.images, c.tags, c.captions, c.labels, "Quality", "type")


@register("label_sets", cte("labelled") + "SELECT set_name, count(DISTINCT asset_id) AS n_assets, array_to_string(list_sort(list(DISTINCT value)), ',') AS choices FROM labelled GROUP BY set_name")
def label_sets(spark, d):
    return details.label_sets(Catalog(spark, d).labels)


@register("threshold_tags", cte("tags") + "SELECT image_id, category, value, confidence FROM tags WHERE (category = 'type' AND confidence >= 0.05) OR (category = 'brand' AND confidence >= 0.08) UNION ALL SELECT image_id, category, value, confidence FROM tags WHERE category = 'returnflag' QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, value) = 1")
def threshold_tags(spark, d):
    return details.threshold_tags(Catalog(spark, d).tags, {"type": 0.05, "brand": 0.08}, "returnflag")


@register("leftover_check", "SELECT count(*) AS total, count(*) FILTER (text IN (SELECT text FROM documents WHERE source <> 'src0')) AS duplicate, count(*) FILTER (text NOT IN (SELECT text FROM documents WHERE source <> 'src0')) AS \"unique\" FROM documents WHERE source = 'src0'")
def leftover_check(spark, d):
    h = Catalog(spark, d).captions.select("model", F.sha2("caption", 256).alias("hash"))
    return details.leftovers(h.where("model = 'src0'"), h.where("model <> 'src0'"))


@register("transform_summary", cte("videos", more="p AS (SELECT rating AS extension, filesize AS size, round(width * 40.0, 2) AS new_size, processed = 1 AND has_audio AS done FROM videos), a AS (SELECT *, CASE WHEN done THEN 'skip' WHEN new_size >= size THEN 'keep' ELSE 'convert' END AS action FROM p)") + "SELECT action, extension, count(*) AS n, round(sum(CASE WHEN action = 'convert' THEN size - new_size ELSE 0 END), 2) AS saved, round(sum(CASE WHEN action = 'convert' THEN size - new_size ELSE 0 END) * 100 / sum(size), 2) AS saved_pct FROM a GROUP BY action, extension")
def transform_summary(spark, d):
    files = Catalog(spark, d).videos.select(F.col("rating").alias("extension"), F.col("filesize").alias("size"), F.round(F.col("width") * 40.0, 2).alias("new_size"), ((F.col("processed") == 1) & F.col("has_audio")).alias("done"))
    return details.transform_summary(details.transform_plan(files))


@register("event_members", cte("images", "videos") + "SELECT id % 100 AS event, 'image' AS owner_type, id AS owner_id, person AS name FROM images WHERE id % 7 = 0 UNION ALL SELECT id % 100, 'video', id, filename FROM videos WHERE id % 3 = 0")
def event_members(spark, d):
    c = Catalog(spark, d)
    member = lambda t, kind, n: t.where(F.col("id") % n == 0).select((F.col("id") % 100).alias("event"), F.lit(kind).alias("owner_type"), F.col("id").alias("owner_id"))
    return details.event_members(member(c.images, "image", 7).unionByName(member(c.videos, "video", 3)), {"image": c.images.select("id", F.col("person").alias("name")), "video": c.videos.select("id", F.col("filename").alias("name"))})


@register("collection_items", "SELECT n_regionkey AS collection_id, count(*) AS n, string_agg(n_nationkey, ',' ORDER BY n_name) AS ids FROM nation GROUP BY n_regionkey")
def collection_items(spark, d):
    return details.ordered_items(Catalog(spark, d).raw("nation").select(F.col("n_regionkey").alias("collection_id"), F.col("n_name").alias("sort_order"), F.col("n_nationkey").alias("image_id")))


@register("best_frame", cte("segments", more="s AS (SELECT video, turn AS id, length(text)::DOUBLE AS composite, (end_s - start_s) / 20.0::DOUBLE AS model FROM segments), b AS (SELECT video, id, round(0.6 * coalesce((composite - min(composite) OVER w) / nullif(max(composite) OVER w - min(composite) OVER w, 0), 0) + 0.4 * model, 6) AS score FROM s WINDOW w AS (PARTITION BY video))") + "SELECT video, id, score FROM b QUALIFY row_number() OVER (PARTITION BY video ORDER BY score DESC, id) = 1")
def best_frame(spark, d):
    s = Catalog(spark, d).segments.select("video", F.col("turn").alias("id"), F.length("text").cast("double").alias("composite"), ((F.col("end") - F.col("start")) / 20.0).alias("model"))
    return details.best_of_each(details.blended(s, "video", 0.4), "video")


@register("cold_start", cte("vectors", more=f"{_mean('label = 0', 'pos')}, posv AS (SELECT list(x ORDER BY i) AS w FROM pos)") + "SELECT id, round(list_inner_product(v, w) / sqrt(list_inner_product(v, v)), 6) AS score FROM vectors, posv WHERE label > 1 ORDER BY score DESC, id LIMIT 25")
def cold_start(spark, d):
    v = Catalog(spark, d).vectors
    return vectors.scored(v.where("label > 1"), vectors.centroid(v.where("label = 0"))).orderBy(F.desc("score"), "id").limit(25)

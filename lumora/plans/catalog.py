"""Queries on filters, facets, statistics and media columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.functions import media
from lumora.operators import facets, filters, scenes, stats
from lumora.plans.registry import register
from lumora.sources.catalog import Catalog, cte

SPEC = {"returnflag": ["R"], "type": ["LARGE", "PROMO"]}
_MATCH = {c: f"SELECT image_id FROM tags WHERE category = '{c}' AND value IN ({', '.join(repr(x) for x in v)})" for c, v in SPEC.items()}


@register("filter_and_or", cte("images", "tags") + f"SELECT id, person, filesize FROM images WHERE person = '1-URGENT' AND processed AND id IN ({_MATCH['returnflag']}) AND id IN ({_MATCH['type']})")
def filter_and_or(spark, d):
    c = Catalog(spark, d)
    spec = filters.FilterSpec(tags=filters.parse_specs_strict([f"{k}:{v}" for k, vs in SPEC.items() for v in vs]), person="1-URGENT", processed=True)
    return filters.candidates(c.images, c.tag_rows, c.labels, spec).select("id", "person", "filesize")


@register("filter_list_all_and", cte("images", "tags") + "SELECT id, person FROM images WHERE id IN (SELECT image_id FROM tags WHERE category = 'returnflag' AND value = 'R') AND id IN (SELECT image_id FROM tags WHERE category = 'returnflag' AND value = 'A')")
def filter_list_all_and(spark, d):
    c = Catalog(spark, d)
    return filters.list_filter(c.images, c.tag_rows, [("returnflag", "R"), ("returnflag", "A")]).select("id", "person")


@register("filter_owner_scope", cte("images", "tags") + "SELECT i.person, count(*) AS n, CAST(sum(t.n) AS BIGINT) AS n_tags FROM images i JOIN (SELECT image_id, count(*) AS n FROM tags GROUP BY image_id) t ON t.image_id = i.id WHERE owner_id = 7 OR owner_id IS NULL GROUP BY i.person")
def filter_owner_scope(spark, d):
    c = Catalog(spark, d)
    tags = filters.owned_children(c.tags, c.images, 7).groupBy(F.col("image_id").alias("id")).agg(F.count("*").alias("t"))
    return filters.owned(c.images, 7).join(tags, "id").groupBy("person").agg(F.count("*").alias("n"), F.sum("t").alias("n_tags"))


@register("filter_substring", cte("images", "tags") + "SELECT id FROM images i WHERE EXISTS (SELECT 1 FROM tags t WHERE t.image_id = i.id AND (t.value ILIKE '%brand#1%' OR i.person ILIKE '%brand#1%'))")
def filter_substring(spark, d):
    c = Catalog(spark, d)
    return filters.substring(c.images, c.tag_rows, "brand#1").select("id")


@register("filter_exclusion_anti", cte("images", "tags", "rules") + "SELECT id, flag_action FROM images i WHERE NOT EXISTS (SELECT 1 FROM tags t JOIN rules r ON t.category = r.category AND t.value = r.value WHERE r.enabled AND t.image_id = i.id)")
def filter_exclusion_anti(spark, d):
    c = Catalog(spark, d)
    return filters.not_excluded(c.images, c.tag_rows, c.rules).select("id", "flag_action")


@register("filter_labels", cte("labelled", "captions") + "SELECT image_id AS id, model FROM captions WHERE image_id IN (SELECT asset_id FROM labelled WHERE set_name = 'Quality' AND value = 'good') AND image_id IN (SELECT asset_id FROM labelled WHERE set_name = 'Toxic' AND value = 'no')")
def filter_labels(spark, d):
    c = Catalog(spark, d)
    docs = c.captions.select(F.col("image_id").alias("id"), "model")
    for name, value in (("Quality", "good"), ("Toxic", "no")):
        docs = filters.with_label(docs, c.labels, name, [value])
    return docs


@register("filter_rating", cte("images", "tags") + "SELECT id FROM images WHERE id IN (SELECT image_id FROM tags WHERE category = 'type' AND value = 'PROMO' UNION SELECT id FROM images WHERE flag_action = 'keep' AND person = '5-LOW')")
def filter_rating(spark, d):
    c = Catalog(spark, d)
    labels = c.images.where("flag_action = 'keep' and person = '5-LOW'").select(F.col("id").alias("asset_id"), F.lit("Rating").alias("set_name"), F.lit("PROMO").alias("value"))
    tags = c.tag_rows.withColumn("category", F.when(F.col("category") == "type", "rating").otherwise(F.col("category")))
    return filters.with_rating(c.images, tags, labels, "PROMO").select("id")


@register("uncaptioned_anti", cte("images", "captions") + "SELECT id, person FROM images WHERE id NOT IN (SELECT image_id FROM captions WHERE model = 'src3')")
def uncaptioned_anti(spark, d):
    c = Catalog(spark, d)
    return filters.without_child(c.images, c.captions, where=F.col("model") == "src3").select("id", "person")


def _page(name: str, key: str, order: str, columns: str):
    @register(name, cte("images") + f"SELECT {columns} FROM images ORDER BY {order} LIMIT 40 OFFSET 80")
    def run(spark, d):
        return filters.page(filters.sorted_by(Catalog(spark, d).images, key), 3, 40).select(*columns.split(", "))

    return run


_page("page_sorted_recent", "recent", "id DESC", "id, person")
_page("page_sorted_imported", "imported", "imported_at DESC, id DESC", "id, imported_at")
_page("page_sorted_size", "size", "filesize DESC, id DESC", "id, filesize")
_page("page_sorted_person", "person", "person, id", "id, person")


@register("page_sorted_name", cte("videos") + "SELECT id, filename FROM videos ORDER BY filename, id LIMIT 25")
def page_sorted_name(spark, d):
    return filters.page(filters.sorted_by(Catalog(spark, d).videos, "filename", strict=True), 1, 25).select("id", "filename")


@register("priority_sort", cte("images") + "SELECT id, person FROM images ORDER BY CASE person WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, id LIMIT 60")
def priority_sort(spark, d):
    return Catalog(spark, d).images.orderBy(filters.priority(F.col("person"), ("1-URGENT", "2-HIGH", "3-MEDIUM")), "id").limit(60).select("id", "person")


def _naive_facets(active: dict[str, list[str]], rows: str, name: str, assets: str) -> str:
    """The facets category by category, each with its own filter dropped."""
    hit = {c: f"id IN (SELECT id FROM {rows} WHERE {name} = '{c}' AND value IN ({', '.join(repr(x) for x in v)}))" for c, v in active.items()}
    parts = [f"({name} = '{c}' AND " + (" AND ".join(h for k, h in hit.items() if k != c) or "true") + ")" for c in active]
    rest = f"({name} NOT IN ({', '.join(repr(c) for c in active)}) AND {' AND '.join(hit.values())})" if active else "true"
    return f"SELECT {name}, value, count(DISTINCT id) AS n FROM {rows} WHERE id IN (SELECT id FROM {assets}) AND ({' OR '.join([*parts, rest])}) GROUP BY {name}, value"


@register("facet_tags_filtered", cte("images", "tags", more="p AS (SELECT image_id AS id, category, value FROM tags), a AS (SELECT id FROM images WHERE processed)") + _naive_facets(SPEC, "p", "category", "a"))
def facet_tags_filtered(spark, d):
    c = Catalog(spark, d)
    return facets.tag_facets(c.images.where("processed"), c.dealt_tag_rows, SPEC, dealt=True)


@register("facet_tags_unfiltered", cte("images", "tags", more="p AS (SELECT image_id AS id, category, value FROM tags)") + _naive_facets({}, "p", "category", "images"))
def facet_tags_unfiltered(spark, d):
    c = Catalog(spark, d)
    return facets.tag_facets(c.images, c.dealt_tag_rows, {}, dealt=True)


@register("facet_people", cte("images", "tags") + f"SELECT person, count(DISTINCT id) AS n FROM images WHERE id IN ({_MATCH['returnflag']}) AND id IN ({_MATCH['type']}) GROUP BY person")
def facet_people(spark, d):
    c = Catalog(spark, d)
    return facets.people_facet(filters.candidates(c.images, c.tag_rows, c.labels, filters.FilterSpec(tags=SPEC)))


_LABELS = {"Quality": ["good"]}


@register("facet_labels", cte("labelled", "captions", more="p AS (SELECT asset_id AS id, set_name, value FROM labelled), a AS (SELECT image_id AS id FROM captions WHERE lang = 'en')") + _naive_facets(_LABELS, "p", "set_name", "a"))
def facet_labels(spark, d):
    c = Catalog(spark, d)
    return facets.label_facets(c.captions.where("lang = 'en'").select(F.col("image_id").alias("id")), c.labels, _LABELS)


@register("facet_legacy", cte("tags") + "SELECT category, value, count(*) AS n FROM tags GROUP BY category, value")
def facet_legacy(spark, d):
    return facets.row_facets(Catalog(spark, d).tags)


_BUCKET = "CASE WHEN duration < 30 THEN '<30s' WHEN duration < 120 THEN '30s-2m' WHEN duration < 600 THEN '2m-10m' WHEN duration >= 600 THEN '10m+' END"
_SHAPE = "CASE WHEN width > 0 AND height > 0 THEN CASE WHEN width > height THEN 'landscape' WHEN height > width THEN 'portrait' ELSE 'square' END END"


@register("video_facets", cte("videos") + f"SELECT facet, value, count(*) AS n FROM (SELECT unnest(['bucket', 'orientation', 'audio', 'person', 'rating']) AS facet, unnest([{_BUCKET}, {_SHAPE}, CASE WHEN has_audio THEN 'yes' ELSE 'no' END, person, rating]) AS value FROM videos) WHERE value IS NOT NULL GROUP BY facet, value")
def video_facets(spark, d):
    return facets.video_facets(Catalog(spark, d).videos)


@register("video_filter", cte("videos") + "SELECT id, duration, width, height FROM videos WHERE processed <> -1 AND has_audio AND duration >= 120 AND duration < 600 AND height > width")
def video_filter(spark, d):
    return filters.videos(Catalog(spark, d).videos, audio=True, bucket=(120, 600), shape="portrait").select("id", "duration", "width", "height")


@register("video_label_facets", cte("labelled", "videos") + "SELECT set_name, value, count(DISTINCT asset_id) AS n FROM labelled WHERE asset_id IN (SELECT id FROM videos) GROUP BY set_name, value")
def video_label_facets(spark, d):
    c = Catalog(spark, d)
    return facets.label_facets(c.videos.select("id"), c.labels, {})


@register("duration_orientation", cte("videos") + f"SELECT id, {_BUCKET} AS bucket, {_SHAPE} AS orientation, coalesce({_SHAPE}, 'landscape') AS ingest_orientation FROM videos")
def duration_orientation(spark, d):
    w, h = F.col("width"), F.col("height")
    return Catalog(spark, d).videos.select("id", media.duration_bucket(F.col("duration")).alias("bucket"), media.orientation(w, h).alias("orientation"), media.ingest_orientation(w, h).alias("ingest_orientation"))


@register("stats", cte("images", "tags") + "SELECT count(*) AS total, count(*) FILTER (processed) AS processed, round(count(*) FILTER (processed) * 100.0 / count(*), 1) AS processed_pct, count(flag_action) AS flagged, CAST(count(DISTINCT person) + max(CAST(person IS NULL AS INT)) AS BIGINT) AS people, (SELECT count(DISTINCT category) FROM tags) AS categories FROM images")
def catalog_stats(spark, d):
    c = Catalog(spark, d)
    return stats.catalog_stats(c.images, c.tag_rows)


@register("stats_directories", cte("images", "labelled") + "SELECT person, count(*) AS n, count(*) FILTER (processed) AS n_processed, count(flag_action) AS n_flagged, count(*) FILTER (value = 'good') AS n_good, count(*) FILTER (value = 'poor') AS n_poor, count(*) FILTER (value IS NULL) AS n_unrated FROM images LEFT JOIN (SELECT asset_id, value FROM labelled WHERE set_name = 'Quality') l ON l.asset_id = images.id GROUP BY person")
def stats_directories(spark, d):
    c = Catalog(spark, d)
    return stats.group_stats(c.images, "person", c.labels.where("set_name = 'Quality'").select(F.col("asset_id").alias("id"), "value"), ("good", "poor"))


@register("coverage", cte("images", "tags", "captions") + "SELECT tier, done, total, round(done * 100.0 / total, 1) AS pct FROM (SELECT 'tags' AS tier, count(DISTINCT image_id) AS done FROM tags UNION ALL SELECT 'captions', count(DISTINCT image_id) FROM captions), (SELECT count(*) AS total FROM images)")
def coverage(spark, d):
    c = Catalog(spark, d)
    return stats.coverage(c.images, {"tags": c.tag_rows, "captions": c.captions})


_END = "2024-01-15 00:00:00"


@register("throughput", f"SELECT count(*) AS n, round(count(*) / 10080.0, 4) AS per_minute, max(ts) AS latest FROM events WHERE ts > TIMESTAMP '{_END}' - INTERVAL 10080 MINUTE AND ts <= TIMESTAMP '{_END}'")
def throughput(spark, d):
    return stats.throughput(Catalog(spark, d).items, "ts", _END, 10_080)


@register("throughput_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1")
def throughput_windows(spark, d):
    from lumora.streaming import live

    return live.throughput(Catalog(spark, d).items, "1 day")


@register("rating_left_join", cte("labelled", "captions") + "SELECT image_id AS id, coalesce(value, 'unrated') AS rating FROM captions LEFT JOIN (SELECT asset_id, value FROM labelled WHERE set_name = 'Quality') l ON l.asset_id = image_id")
def rating_left_join(spark, d):
    c = Catalog(spark, d)
    quality = c.labels.where("set_name = 'Quality'").select(F.col("asset_id").alias("id"), "value")
    return c.captions.select(F.col("image_id").alias("id")).join(quality, "id", "left").select("id", F.coalesce("value", F.lit("unrated")).alias("rating"))


@register("rule_mining", cte("images", "tags", "rules") + "SELECT p.category, p.value, count(*) AS n, array_to_string(list_sort(list(image_id) FILTER (r <= 4)), ',') AS samples FROM (SELECT *, row_number() OVER (PARTITION BY category, value ORDER BY image_id) AS r FROM (SELECT DISTINCT image_id, category, value FROM tags WHERE category <> 'linestatus' AND image_id IN (SELECT id FROM images WHERE flag_action = 'reject'))) p WHERE NOT EXISTS (SELECT 1 FROM rules WHERE rules.category = p.category AND rules.value = p.value) GROUP BY p.category, p.value HAVING count(*) >= 20 ORDER BY n DESC, p.category, p.value LIMIT 20")
def rule_mining(spark, d):
    c = Catalog(spark, d)
    return stats.mine_rules(c.images, c.dealt_tag_rows, c.rules, least=20, top=20, skip=("linestatus",))


@register("flag_counts", cte("images") + "SELECT flag_action, count(*) AS n FROM images WHERE flag_action IS NOT NULL GROUP BY flag_action")
def flag_counts(spark, d):
    return stats.flag_counts(Catalog(spark, d).images)


@register("readiness", cte("images", "vectors") + "SELECT keep, reject, maybe, n_vectors, n_vectors >= floor(total * 0.9) AS coverage_ok, keep + reject >= 100 AND keep > 0 AND reject > 0 AND n_vectors > 0 AS ready FROM (SELECT count(*) FILTER (flag_action = 'keep') AS keep, count(*) FILTER (flag_action = 'reject') AS reject, count(*) FILTER (flag_action = 'maybe') AS maybe, count(*) AS total FROM images), (SELECT count(DISTINCT id) AS n_vectors FROM vectors)")
def readiness(spark, d):
    c = Catalog(spark, d)
    return stats.readiness(stats.flag_counts(c.images), c.vectors, c.images)


@register("top_values", cte("tags") + "SELECT category, value, n, n_values, rank FROM (SELECT category, value, n, count(*) OVER (PARTITION BY category) AS n_values, row_number() OVER (PARTITION BY category ORDER BY n DESC, value) AS rank FROM (SELECT category, value, count(*) AS n FROM tags GROUP BY category, value)) WHERE rank <= 5")
def top_values(spark, d):
    return stats.top_values(Catalog(spark, d).tags)


@register("rule_matches", cte("tags", "rules") + "SELECT category, value, enabled, (SELECT count(*) FROM tags t WHERE t.category = r.category AND t.value = r.value) AS match_count FROM rules r")
def rule_matches(spark, d):
    c = Catalog(spark, d)
    return stats.rule_matches(c.tags, c.rules)


@register("vocabulary", cte("tags") + "SELECT category, count(DISTINCT value) AS n_values, array_to_string(list_sort(list(DISTINCT value)), ',') AS all_values FROM tags GROUP BY category")
def vocabulary(spark, d):
    return stats.vocabulary(Catalog(spark, d).tag_rows)


@register("dedup_prefix", "SELECT substr(h, 1, 2) AS prefix, count(*) AS n, count(DISTINCT h) AS n_hashes, CASE WHEN count(DISTINCT h) = 1 THEN 'dedup' ELSE 'full_hash' END AS action FROM (SELECT sha256(text) AS h FROM documents) GROUP BY 1 HAVING count(*) > 1")
def dedup_prefix(spark, d):
    return stats.hash_prefix_plan(Catalog(spark, d).captions.select(F.sha2("caption", 256).alias("hash")), 2)


@register("collection_counts", cte("images") + "SELECT n_name AS collection, count(id) AS n FROM nation LEFT JOIN images ON images.id % 40 = n_nationkey GROUP BY n_name")
def collection_counts(spark, d):
    c = Catalog(spark, d)
    items = c.images.select((F.col("id") % 40).alias("n_nationkey"))
    return stats.left_counts(c.raw("nation").select("n_nationkey", F.col("n_name").alias("collection")), items, "n_nationkey").select("collection", "n")


_PLACED = "placed AS (SELECT s.video, n.scene, s.turn, s.start_s, s.text FROM segments s JOIN scenes n ON n.video = s.video AND (s.start_s + s.end_s) / 2.0 >= n.lo AND (s.start_s + s.end_s) / 2.0 < n.hi)"


@register("transcript_range_join", cte("segments", "scenes", more=_PLACED) + "SELECT video, scene, count(*) AS n_cues, string_agg(text, ' ' ORDER BY start_s, turn) AS transcript FROM placed GROUP BY video, scene")
def transcript_range_join(spark, d):
    c = Catalog(spark, d)
    return scenes.transcripts(scenes.cues_in_scenes(c.segments, c.scenes))


@register("scene_counts", cte("segments", "scenes", more=_PLACED) + "SELECT n.video, n.scene, count(p.video) AS n_cues, count(p.video) FILTER (length(p.text) > 100) AS n_long FROM scenes n LEFT JOIN placed p ON p.video = n.video AND p.scene = n.scene GROUP BY n.video, n.scene")
def scene_counts(spark, d):
    c = Catalog(spark, d)
    placed = scenes.cues_in_scenes(c.segments, c.scenes).select("video", "scene", "text")
    return stats.scene_counts(c.scenes.select("video", "scene"), {"n_cues": placed, "n_long": placed.where(F.length("text") > 100)})


@register("path_parts", cte("paths") + r"SELECT id, split_part(path, '/', 3) AS host, split_part(path, '/', -2) AS person, regexp_extract(path, '\.([A-Za-z0-9]+)$', 1) AS extension, 'other' AS kind, regexp_replace(path, '[^a-zA-Z0-9_\-]', '', 'g') AS slug FROM paths")
def path_parts(spark, d):
    p = F.col("path")
    return Catalog(spark, d).paths.select("id", F.split(p, "/")[2].alias("host"), media.parent_folder(p).alias("person"), media.extension(p).alias("extension"), media.file_kind(p).alias("kind"), media.slug(p).alias("slug"))


@register("enum_correct", cte("videos") + "SELECT id, CASE lower(rating) WHEN 'large' THEN 'large' WHEN 'promo' THEN 'promo' WHEN 'economy' THEN 'promo' ELSE 'large' END AS rating, lower(rating) NOT IN ('large', 'promo') AS corrected FROM videos")
def enum_correct(spark, d):
    r = F.col("rating")
    allowed = ["large", "promo"]
    return Catalog(spark, d).videos.select("id", media.corrected(r, allowed, {"economy": "promo"}).alias("rating"), (~F.lower(r).isin(allowed)).alias("corrected"))


@register("webvtt", cte("segments", "scenes", more=_PLACED) + "SELECT video, 'WEBVTT' || chr(10) || chr(10) || string_agg(printf('%02d:%02d:%02d.000', lo // 3600, (lo // 60) % 60, lo % 60) || ' --> ' || printf('%02d:%02d:%02d.000', hi // 3600, (hi // 60) % 60, hi % 60) || chr(10) || coalesce(t, ''), chr(10) || chr(10) ORDER BY scene) AS vtt FROM (SELECT n.video, n.scene, n.lo, n.hi, (SELECT string_agg(p.text, ' ' ORDER BY p.start_s, p.turn) FROM placed p WHERE p.video = n.video AND p.scene = n.scene) AS t FROM scenes n) GROUP BY video")
def webvtt(spark, d):
    from lumora.sources.files import webvtt as sink

    c = Catalog(spark, d)
    text = scenes.transcripts(scenes.cues_in_scenes(c.segments, c.scenes)).select("video", "scene", F.col("transcript").alias("text"))
    return sink(c.scenes.join(text, ["video", "scene"], "left"))

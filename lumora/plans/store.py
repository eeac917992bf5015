"""Queries on people, imports, labels, probes of files, places' backfill, gates and nested rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.functions import media
from lumora.operators import details, facets, filters, geo, imports, people, stats, vectors, writes
from lumora.plans.catalog import SPEC, _naive_facets
from lumora.plans.registry import register
from lumora.plans.vectors import _mean
from lumora.sources import files
from lumora.sources.catalog import Catalog, cte

_FACES = "faces AS (SELECT vec_id AS id, vec_id * 3 % 1000 AS image_id, CASE WHEN label % 3 <> 0 THEN CAST(label AS BIGINT) END AS person, CAST(label % 2 AS BIGINT) AS embedder FROM embeddings), persons AS (SELECT CAST(n_nationkey AS BIGINT) AS person, n_name AS name FROM nation)"


def _faces(c):
    label = F.col("label").cast("long")
    return c.raw("embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") * 3 % 1000).alias("image_id"), F.when(label % 3 != 0, label).alias("person"), (label % 2).alias("embedder"))


def _persons(c):
    return c.raw("nation").select(F.col("n_nationkey").cast("long").alias("person"), F.col("n_name").alias("name"))


def _files(c):
    return c.images.select("id", F.col("person").alias("filename"))


@register("people_chain", cte("images", more=_FACES) + "SELECT p.person, p.name, f.id AS face, f.image_id, i.person AS filename FROM persons p LEFT JOIN faces f ON f.person = p.person LEFT JOIN images i ON i.id = f.image_id")
def people_chain(spark, d):
    c = Catalog(spark, d)
    return people.chain(_persons(c), _faces(c), _files(c))


@register("faces_with_images", cte("images", more=_FACES) + "SELECT f.*, i.person AS filename FROM faces f LEFT JOIN images i ON i.id = f.image_id")
def faces_with_images(spark, d):
    c = Catalog(spark, d)
    return people.faces_with_images(_faces(c), _files(c))


_MOVED = "w AS (SELECT id, CAST(id % 5 AS BIGINT) AS p FROM faces WHERE id % 11 = 0), moved AS (SELECT f.id, coalesce(w.p, f.person) AS person FROM faces f LEFT JOIN w USING (id)), touched AS (SELECT p AS person FROM w UNION SELECT person FROM faces JOIN w USING (id) WHERE person IS NOT NULL)"


@register("face_assign", cte(more=f"{_FACES}, {_MOVED}") + "SELECT t.person, count(m.id) AS n, min(m.id) AS cover FROM touched t LEFT JOIN moved m ON m.person = t.person GROUP BY t.person")
def face_assign(spark, d):
    f = _faces(Catalog(spark, d))
    return people.assigned(f, f.where("id % 11 = 0").select("id", (F.col("id") % 5).alias("person")))[1]


@register("face_split", cte(more=_FACES) + "SELECT id, image_id, CASE WHEN id % 13 = 0 THEN (SELECT max(person) + 1 FROM faces) ELSE person END AS person, embedder FROM faces")
def face_split(spark, d):
    f = _faces(Catalog(spark, d))
    return people.split(f, f.where("id % 13 = 0"))[0]


@register("faces_pending", cte(more=_FACES) + "SELECT * FROM faces WHERE person IS NULL AND embedder = 1")
def faces_pending(spark, d):
    return people.pending(_faces(Catalog(spark, d)), 1)


@register("face_erasure", cte(more=_FACES) + "SELECT * FROM faces WHERE person IS NULL OR person NOT IN (SELECT person FROM persons WHERE name < 'D')")
def face_erasure(spark, d):
    c = Catalog(spark, d)
    return people.erased(_faces(c), _persons(c).where("name < 'D'"))


@register("people_listed", cte(more=_FACES) + "SELECT person, count(*) AS n, min(id) AS cover FROM faces WHERE person IS NOT NULL GROUP BY person ORDER BY n DESC, person")
def people_listed(spark, d):
    return people.listed(_faces(Catalog(spark, d)))


@register("import_tags", cte("tags", "images", more="old AS (SELECT * FROM tags WHERE category = 'returnflag'), fresh AS (SELECT DISTINCT o_orderkey AS image_id, 'returnflag' AS category, unnest(['R', o_orderstatus]) AS value FROM orders WHERE o_orderkey % 3 = 0)") + "SELECT image_id, category, value, tag_source, confidence FROM old UNION ALL SELECT image_id, category, value, 's1', NULL FROM fresh f WHERE image_id IN (SELECT id FROM images WHERE processed) AND NOT EXISTS (SELECT 1 FROM old o WHERE o.image_id = f.image_id AND o.value = f.value AND o.tag_source = 's1')")
def import_tags(spark, d):
    c = Catalog(spark, d)
    rows = c.raw("orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("image_id"), F.create_map(F.lit("returnflag"), F.array(F.lit("R"), "o_orderstatus")).alias("tags"))
    return imports.tags(c.tags.where("category = 'returnflag'"), rows, c.images.where("processed"), "s1", c.line_parts)


_SCORED = "old AS (SELECT * FROM tags WHERE category = 'returnflag'), fresh AS (SELECT o_orderkey AS image_id, unnest([0, 1, 2]) AS nth, unnest(['returnflag', 'rating', 'returnflag']) AS category, unnest(['R', CASE WHEN o_custkey % 4 = 0 THEN 'general' ELSE 'explicit' END, 'R']) AS value, unnest([o_custkey % 7 / 10.0::DOUBLE, 0.9::DOUBLE, 0.1::DOUBLE]) AS confidence, unnest(['s1', 'wd', 's1']) AS tag_source FROM orders WHERE o_orderkey % 3 = 0)"


@register("import_scored_tags", cte("tags", "images", more=_SCORED) + "SELECT image_id, category, value, tag_source, confidence FROM old UNION ALL SELECT image_id, category, value, tag_source, confidence FROM fresh f WHERE nth < 2 AND image_id IN (SELECT id FROM images WHERE processed) AND NOT EXISTS (SELECT 1 FROM old o WHERE o.image_id = f.image_id AND o.category = f.category AND o.value = f.value AND o.tag_source = f.tag_source)")
def import_scored_tags(spark, d):
    """Tags that come with their own confidences and sources; a repeated key keeps its first."""
    c = Catalog(spark, d)
    return imports.scored_tags(c.tags.where("category = 'returnflag'"), _scored_rows(c), c.images.where("processed"), parts=c.line_parts)


def _scored_rows(c):
    tag = lambda k, v, p, s: F.struct(F.lit(k).alias("category"), v.alias("value"), p.alias("confidence"), F.lit(s).alias("tag_source"))
    rating = F.when(F.col("o_custkey") % 4 == 0, "general").otherwise("explicit")
    rows = F.array(tag("returnflag", F.lit("R"), F.col("o_custkey") % 7 / 10.0, "s1"), tag("rating", rating, F.lit(0.9), "wd"), tag("returnflag", F.lit("R"), F.lit(0.1), "s1"))
    return c.raw("orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("image_id"), rows.alias("rows"))


@register("import_finalised", "SELECT o_orderkey AS id, o_orderstatus <> 'P' OR o_orderkey % 3 = 0 AS processed, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_custkey % 4 = 0 THEN 'sfw' ELSE 'nsfw' END WHEN o_orderkey % 2 = 0 THEN 'suggestive' END AS rating FROM orders")
def import_finalised(spark, d):
    """What an import leaves of its images: processed, with the rating of their tags in place of an older one."""
    c = Catalog(spark, d)
    labels = c.images.where("id % 2 = 0").select(F.col("id").alias("asset_id"), F.lit("Rating").alias("set_name"), F.lit("suggestive").alias("value"))
    images, labels = imports.finalised(c.images.select("id", "processed"), labels, _scored_rows(c))
    return images.join(labels.select(F.col("asset_id").alias("id"), F.col("value").alias("rating")), "id", "left")


@register("import_unknown", "SELECT count(*) AS n_unknown FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def import_unknown(spark, d):
    c = Catalog(spark, d)
    return imports.known_only(c.captions, c.vectors)[1]


@register("import_captions", "WITH old AS (SELECT doc_id AS image_id, source AS model, lang AS caption FROM documents WHERE doc_id % 2 = 0), fresh AS (SELECT doc_id AS image_id, source AS model, CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE 'new ' || lang END AS caption FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) SELECT * FROM old UNION ALL SELECT * FROM fresh WHERE trim(caption) <> '' AND image_id % 2 <> 0")
def import_captions(spark, d):
    c = Catalog(spark, d)
    t = c.captions
    old = t.where("image_id % 2 = 0").select("image_id", "model", F.col("lang").alias("caption"))
    new = t.select("image_id", "model", F.when(F.col("image_id") % 5 == 0, "  ").otherwise(F.concat(F.lit("new "), "lang")).alias("caption"))
    return imports.captions(old, new, c.vectors)


@register("import_regions", cte("images", more="r AS (SELECT l_orderkey AS id, '[' || string_agg('{\"label\":\"' || l_returnflag || '\",\"x\":' || l_linenumber || '}', ',' ORDER BY l_linenumber, l_returnflag) || ']' AS j FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY l_orderkey)") + "SELECT images.id, r.j AS region_json, r.j IS NOT NULL AS checked FROM images LEFT JOIN r USING (id)")
def import_regions(spark, d):
    c = Catalog(spark, d)
    r = c.raw("lineitem").where("l_orderkey % 4 = 0").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda s: F.struct(s["l_returnflag"].alias("label"), s["l_linenumber"].alias("x"))).alias("regions"))
    return imports.regions(c.images.select("id"), r)


@register("tiers_finished", "SELECT id FROM (SELECT l_orderkey AS id, l_returnflag AS tier, bool_and(l_linestatus = 'F') AS ok FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2) WHERE ok GROUP BY id HAVING count(*) = 2")
def tiers_finished(spark, d):
    t = Catalog(spark, d).raw("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("tier"), (F.col("l_linestatus") == "F").alias("ok"))
    return imports.finished(t, ("A", "R"))


_POS = f"{_mean('label = 0', 'pos')}, posv AS (SELECT list(x ORDER BY i) AS w FROM pos), s AS (SELECT id, round(list_inner_product(v, w) / sqrt(list_inner_product(v, v)), 6) AS score FROM vectors, posv)"


def _scores(c):
    return vectors.scored(c.vectors, vectors.centroid(c.vectors.where("label = 0")))


@register("centroid_apply", cte("vectors", "tags", more=_POS) + "SELECT id AS image_id, 'brand' AS category, 'Brand#1' AS value, 's1' AS tag_source, score AS confidence FROM s WHERE score > 0.05 AND id NOT IN (SELECT image_id FROM tags WHERE category = 'brand' AND value = 'Brand#1' AND tag_source = 's1')")
def centroid_apply(spark, d):
    c = Catalog(spark, d)
    return imports.applied(c.tags, _scores(c), "brand", "Brand#1", "s1", 0.05, confidence=F.col("score"))


@register("preference_preview", cte("vectors", more=_POS) + "SELECT id, score FROM s WHERE score >= 0.1 AND (SELECT count(*) FROM embeddings) >= 400 ORDER BY score DESC, id LIMIT 20")
def preference_preview(spark, d):
    c = Catalog(spark, d)
    state = c.vectors.agg(F.count("*").alias("n"))
    return imports.gated(_scores(c).where("score >= 0.1"), F.col("n") >= 400, state).orderBy(F.desc("score"), "id").limit(20)


@register("tags_rebuilt", cte("tags") + "SELECT image_id, category, value, CASE WHEN tag_source = 's1' THEN 'vlm' ELSE tag_source END AS tag_source, max(confidence) AS confidence FROM tags WHERE category = 'type' GROUP BY ALL")
def tags_rebuilt(spark, d):
    t = Catalog(spark, d).tags.where("category = 'type'")
    return imports.tags_rebuilt(t.withColumn("tag_source", F.when(F.col("tag_source") != "s1", F.col("tag_source"))))


@register("both_taggers", cte("tags") + "SELECT tag_source, value, count(*) AS n FROM (SELECT value, 'wd' AS tag_source FROM tags WHERE category = 'type' UNION ALL SELECT value, 'joy' FROM tags WHERE category = 'brand') GROUP BY ALL")
def both_taggers(spark, d):
    t = Catalog(spark, d).tags.drop("tag_source")
    return imports.both_taggers(t.where("category = 'type'"), t.where("category = 'brand'"), ("wd", "joy")).groupBy("tag_source", "value").agg(F.count("*").alias("n"))


_LEGACY = "l AS (SELECT asset_id, CASE WHEN asset_id % 3 <> 0 THEN set_name END AS set_name, set_name AS category, value FROM labelled), n AS (SELECT asset_id, set_name, value FROM labelled WHERE set_name = 'Toxic' AND asset_id % 2 = 0)"


@register("labels_adopted", cte("labelled", more=_LEGACY) + "SELECT asset_id, CASE WHEN category = 'Toxic' AND asset_id % 2 = 0 THEN 'Toxic' ELSE set_name END AS set_name, category, value FROM l")
def labels_adopted(spark, d):
    c = Catalog(spark, d)
    sets = spark.createDataFrame([("Quality", True), ("Toxic", False)], "set_name string, single_select boolean")
    old = c.labels.withColumn("category", F.col("set_name")).withColumn("set_name", F.when(F.col("asset_id") % 3 != 0, F.col("set_name")))
    return writes.labels_adopted(old, sets, c.labels.where("set_name = 'Toxic' and asset_id % 2 = 0"))


@register("labels_cleared", cte("labelled") + "SELECT * FROM labelled WHERE NOT (set_name = 'Quality' AND asset_id IN (SELECT asset_id FROM labelled WHERE set_name = 'Toxic' AND value = 'yes'))")
def labels_cleared(spark, d):
    labels = Catalog(spark, d).labels
    return writes.labels_cleared(labels, labels.where("set_name = 'Toxic' and value = 'yes'"), "Quality")


@register("label_set_deleted", cte("labelled") + "SELECT * FROM labelled WHERE set_name <> 'Toxic'")
def label_set_deleted(spark, d):
    labels = Catalog(spark, d).labels
    return writes.set_deleted(labels.select("set_name").distinct(), labels, "Toxic")[1]


@register("label_set_patched", "SELECT n_name AS set_name, CASE WHEN n_nationkey % 2 = 0 THEN 'red' ELSE 'grey' END AS color, n_regionkey AS sort_order FROM nation")
def label_set_patched(spark, d):
    n = Catalog(spark, d).raw("nation")
    old = n.select(F.col("n_name").alias("set_name"), F.lit("grey").alias("color"), F.col("n_regionkey").alias("sort_order"))
    new = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("set_name"), F.lit("red").alias("color"), F.lit(None).cast("int").alias("sort_order"))
    return writes.patched(old, new.union(spark.sql("SELECT 'NOWHERE', 'red', 1")), ["set_name"])


@register("result_rows", cte("images", "tags", "labelled") + "SELECT i.id, (SELECT string_agg(category || '=' || value || '@' || printf('%.2f', confidence), ';' ORDER BY category, value, confidence) FROM (SELECT DISTINCT category, value, confidence FROM tags WHERE image_id = i.id)) AS tags, coalesce((SELECT min(value) FROM labelled WHERE set_name = 'Quality' AND asset_id = i.id), (SELECT min(value) FROM tags WHERE category = 'type' AND image_id = i.id)) AS rating FROM (SELECT * FROM images ORDER BY id DESC LIMIT 150) i")
def result_rows(spark, d):
    c = Catalog(spark, d)
    top = filters.page(filters.sorted_by(c.images, "recent"), 1, 150)
    some = c.tags.join(F.broadcast(top.select(F.col("id").alias("image_id"))), "image_id", "left_semi")
    one = lambda t: F.concat(t["category"], F.lit("="), t["value"], F.lit("@"), F.format_string("%.2f", t["confidence"]))
    return details.results(top, some, c.labels, "Quality", "type").select("id", F.array_join(F.transform("tags", one), ";").alias("tags"), "rating")


@register("asset_full", "SELECT d.doc_id AS id, (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id) AS n_notes, coalesce((SELECT string_agg(turn || ':' || length(text), ',' ORDER BY turn) FROM conversations c WHERE c.conv_id = d.doc_id), '') AS captions FROM documents d")
def asset_full(spark, d):
    c = Catalog(spark, d)
    notes = c.raw("labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    lines = c.raw("conversations").select(F.col("conv_id").alias("id"), "turn", F.length("text").alias("n"))
    rows = details.full(c.captions.select(F.col("image_id").alias("id")), {"notes": notes, "captions": lines})
    return rows.select("id", F.size("notes").cast("long").alias("n_notes"), F.array_join(F.transform("captions", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["n"].cast("string"))), ",").alias("captions"))


@register("feed", cte("vectors", "images", more=_POS) + "SELECT r AS rank, id, person FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM s ORDER BY r LIMIT 60) JOIN images USING (id) ORDER BY r")
def feed(spark, d):
    from lumora.operators.retrieval import with_rank

    c = Catalog(spark, d)
    return details.in_rank_order(with_rank(_scores(c), "score", 60), c.images).select("rank", "id", "person")


@register("video_scenes", cte("videos", "scenes") + "SELECT v.id, v.filename, coalesce((SELECT string_agg(scene || ':' || lo || '-' || hi, ',' ORDER BY scene) FROM scenes s WHERE s.video = v.id), '') AS scenes FROM videos v")
def video_scenes(spark, d):
    c = Catalog(spark, d)
    rows = details.ordered_scenes(c.videos.select("id", "filename"), c.scenes)
    return rows.select("id", "filename", F.array_join(F.transform("scenes", lambda s: F.concat(s["scene"].cast("string"), F.lit(":"), s["lo"].cast("string"), F.lit("-"), s["hi"].cast("string"))), ",").alias("scenes"))


@register("unprocessed", cte("images") + "SELECT id, person FROM images WHERE NOT processed AND person = '3-MEDIUM' ORDER BY id LIMIT 50")
def unprocessed(spark, d):
    return details.unprocessed(Catalog(spark, d).images, "3-MEDIUM", 50).select("id", "person")


@register("grid_record", cte("images") + "SELECT 'largest' AS name, count(*) AS n, '[' || string_agg(id, ',' ORDER BY filesize DESC, id) || ']' AS image_ids FROM (SELECT * FROM images ORDER BY filesize DESC, id LIMIT 30)")
def grid_record(spark, d):
    from lumora.operators.retrieval import with_rank

    return details.grid_record(with_rank(Catalog(spark, d).images, "filesize", 30), "largest")


@register("example_sides", cte("vectors", "images") + "SELECT v.id, CASE WHEN v.id IN (SELECT id FROM images WHERE flag_action = 'keep') THEN 'pos' WHEN v.id IN (SELECT id FROM images WHERE flag_action = 'reject') THEN 'neg' ELSE 'unlabelled' END AS side FROM vectors v")
def example_sides(spark, d):
    c = Catalog(spark, d)
    return details.examples(c.vectors, c.images.where("flag_action = 'keep'"), c.images.where("flag_action = 'reject'")).select("id", "side")


@register("backfill_outcomes", cte("videos") + "SELECT count(*) FILTER (processed = -1) AS quarantined, count(*) FILTER (processed = 1) AS skipped, count(*) FILTER (processed = 0 AND id % 3 = 0) AS processed, count(*) FILTER (processed = 0 AND id % 3 <> 0) AS failed FROM videos")
def backfill_outcomes(spark, d):
    v = Catalog(spark, d).videos
    return details.outcomes(v, v.where("id % 3 != 2").select("id", (F.col("id") % 3 == 0).alias("ok")))


@register("facets_ordered", cte("images", "tags", more="p AS (SELECT image_id AS id, category, value FROM tags), a AS (SELECT id FROM images WHERE processed), f AS (" + _naive_facets(SPEC, "p", "category", "a") + ")") + "SELECT category, value, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, value) AS place FROM f")
def facets_ordered(spark, d):
    c = Catalog(spark, d)
    return facets.ordered(facets.tag_facets(c.images.where("processed"), c.dealt_tag_rows, SPEC, dealt=True))


@register("video_probes", "SELECT 'v' || p_partkey AS path, p_size * 1.5::DOUBLE AS duration, CASE WHEN p_partkey % 2 = 0 THEN p_size + 1 ELSE p_size END AS width, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size + 1 END AS height, 25.0::DOUBLE AS fps, p_brand AS codec, CAST(p_partkey AS INT) AS bitrate, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS has_audio, 0 AS processed FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 10 = 0, CASE WHEN p_partkey % 11 = 0 THEN 'same' ELSE p_name || p_partkey END ORDER BY 'v' || p_partkey) = 1) WHERE p_partkey % 7 <> 0 AND p_partkey % 10 <> 0 UNION ALL SELECT 'v' || p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, -1 FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 10 = 0, CASE WHEN p_partkey % 11 = 0 THEN 'same' ELSE p_name || p_partkey END ORDER BY 'v' || p_partkey) = 1) WHERE p_partkey % 7 = 0 AND p_partkey % 10 <> 0")
def video_probes(spark, d):
    """Probes of the parts as videos: even ones turned by 90 degrees, every seventh unreadable; every tenth is known by its path or its hash, every eleventh other one has the same content."""
    t = Catalog(spark, d).raw("part")
    json = F.format_string('{"format": {"bit_rate": "%d"}, "streams": [{"codec_type": "audio%s"}, {"codec_type": "video", "codec_name": "%s", "duration": "%s", "width": %d, "height": %d, "r_frame_rate": "0/0", "avg_frame_rate": "50/2", "side_data_list": [{"rotation": %d}]}]}', "p_partkey", F.when(F.col("p_partkey") % 3 == 0, "").otherwise("?"), "p_brand", F.col("p_size") * 1.5, "p_size", F.col("p_size") + 1, F.when(F.col("p_partkey") % 2 == 0, -90).otherwise(180))
    rows = t.select(F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("path"), F.sha2("p_name", 256).alias("h"), F.when(F.col("p_partkey") % 7 == 0, "no json").otherwise(json).alias("probe"), "p_partkey")
    rows = rows.withColumn("file_hash", F.when((F.col("p_partkey") % 11 == 0) & (F.col("p_partkey") % 10 != 0), "same").otherwise(F.concat("h", F.col("p_partkey").cast("string"))))
    known = rows.where("p_partkey % 10 = 0").selectExpr("if(p_partkey % 20 = 0, path, null) AS path", "if(p_partkey % 20 = 0, null, file_hash) AS file_hash")
    return files.new_videos(rows, known).drop("file_hash")


_CUE_TIME = "printf('%02d:%02d:%02d.000', ({t}) // 3600, ({t}) // 60 % 60, ({t}) % 60)"


@register("sprite_webvtt", cte("videos", more="c AS (SELECT id, filename, CAST(floor(duration / 60 + 0.5) AS BIGINT) AS n FROM videos), u AS (SELECT id, filename, n, unnest(range(0, n)) AS i FROM c)") + "SELECT c.id, c.n, 'WEBVTT' || chr(10) || coalesce((SELECT chr(10) || string_agg(" + _CUE_TIME.format(t="i * 60") + " || ' --> ' || " + _CUE_TIME.format(t="(i + 1) * 60") + " || chr(10) || u.filename || '#xywh=' || (i % 5 * 160) || ',' || (i // 5 * 90) || ',160,90' || chr(10), chr(10) ORDER BY i) FROM u WHERE u.id = c.id), '') AS vtt FROM c")
def sprite_webvtt(spark, d):
    v = Catalog(spark, d).videos.select("id", "duration", F.col("filename").alias("url"))
    return files.sprite_webvtt(v, 60.0, 5, 160, 90)


@register("sample_times", cte("videos", "scenes", more="m AS (SELECT video, list((lo + hi) / 2.0::DOUBLE ORDER BY scene) AS t FROM scenes GROUP BY video)") + "SELECT id, round(CASE WHEN m.t IS NOT NULL THEN list_sum(CASE WHEN len(m.t) >= 4 THEN m.t[2:-2] ELSE m.t END) ELSE duration * 6 END, 4) AS total FROM videos LEFT JOIN m ON m.video = id")
def sample_times(spark, d):
    c = Catalog(spark, d)
    v = details.ordered_scenes(c.videos.select("id", "duration"), c.scenes)
    s = F.transform("scenes", lambda x: F.struct(x["lo"].alias("start"), x["hi"].alias("end")))
    times = media.sample_times(F.col("duration"), s)
    return v.select("id", F.round(F.aggregate(times, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@register("gps_tags", cte("items") + "SELECT id, CASE WHEN id % 3 = 2 THEN NULL WHEN id % 3 = 1 THEN lat ELSE -abs(lat) END AS lat, CASE WHEN id % 3 = 2 THEN NULL ELSE lon END AS lon FROM items")
def gps_tags(spark, d):
    """Every third item with a raw tag and a southern reference, every third with a video's coordinates, the others without."""
    t = Catalog(spark, d).items
    raw = F.create_map(F.lit("EXIF:GPSLatitude"), F.col("lat").cast("string"), F.lit("EXIF:GPSLatitudeRef"), F.lit("South"), F.lit("GPSLongitude"), F.col("lon").cast("string"))
    video = F.create_map(F.lit("QuickTime:GPSCoordinates"), F.format_string("%+.4f%+.4f/", "lat", "lon"))
    meta = F.when(t.id % 3 == 0, raw).when(t.id % 3 == 1, video).otherwise(F.create_map(F.lit("GPSLatitude"), F.lit("")))
    return t.select("id", geo.gps_of(meta).alias("p")).select("id", "p.lat", "p.lon")


@register("gps_backfill", cte("items") + "SELECT id, CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN NULL WHEN id % 2 = 0 THEN 1.5 ELSE lat END AS lat, CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN NULL WHEN id % 2 = 0 THEN 2.5 ELSE lon END AS lon FROM items")
def gps_backfill(spark, d):
    t = Catalog(spark, d).items
    some = t.select("id", *(F.when(F.col("id") % 2 != 0, F.col(c)).alias(c) for c in ("lat", "lon")))
    return geo.filled_coordinates(some, t.where("id % 3 != 0").select("id", F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon")))


_KEY = "printf('%.3f', lat) || ',' || printf('%.3f', lon)"


@register("place_links", cte("items", more=f"k AS (SELECT *, {_KEY} AS place_key FROM items WHERE lat IS NOT NULL AND lon IS NOT NULL)") + "SELECT place_key, count(*) AS n, min(id) AS first_id FROM k GROUP BY place_key")
def place_links(spark, d):
    t = Catalog(spark, d).items
    table, links = geo.counted_places(t, geo.places(t.where("id % 4 = 0")))
    return links.groupBy("place_key").agg(F.min("id").alias("first_id")).join(table.select("place_key", "n"), "place_key")


@register("iso_times", "SELECT event_id AS id, round(epoch_us(ts) / 1e6, 6) AS t, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM events WHERE epoch_us(ts) % 1000000 = 0 UNION ALL SELECT event_id, round(epoch_us(ts) / 1e6, 6), strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' FROM events WHERE epoch_us(ts) % 1000000 <> 0")
def iso_times(spark, d):
    t = Catalog(spark, d).items
    text = geo.iso_of(F.col("t"))
    return t.select("id", F.round(geo.epoch_of(text), 6).alias("t"), text.alias("iso"))


@register("file_plan", "SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN '_unsorted/_unsorted/' ELSE 'library/' || p_brand || '/' END || CASE WHEN p_partkey % 2 = 0 THEN 'videos' ELSE '_unsorted' END || '/' || p_name AS path, md5(p_name || '@' || p_size) AS cache_key, round(0.0125 * p_size, 4) AS cost FROM part")
def file_plan(spark, d):
    c = F.col
    slug = F.when(c("p_partkey") % 9 == 0, "_unsorted").otherwise(c("p_brand"))
    return Catalog(spark, d).raw("part").select(c("p_partkey").alias("id"), media.relative_path(slug, c("p_name"), F.when(c("p_partkey") % 2 == 0, "video").otherwise("image")).alias("path"), F.md5(F.concat_ws("@", "p_name", c("p_size").cast("string"))).alias("cache_key"), F.round(0.0125 * c("p_size"), 4).alias("cost"))


@register("run_keys", "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'run' || doc_id WHEN doc_id % 4 = 1 THEN source || '|' || lang WHEN doc_id % 4 = 2 THEN lang ELSE 'auto:' || substr(sha256('{\"a\":\"' || lang || '\",\"b\":\"' || source || '\"}'), 1, 16) END AS run_key FROM documents")
def run_keys(spark, d):
    c = Catalog(spark, d).captions
    n = F.col("image_id") % 4
    parts = [F.when(n == 1, F.col("model")), F.when(n.isin(1, 2), F.col("lang"))]
    return c.select(F.col("image_id").alias("id"), media.run_key(F.when(n == 0, F.concat(F.lit("run"), F.col("image_id").cast("string"))), parts, F.create_map(F.lit("b"), "model", F.lit("a"), "lang")).alias("run_key"))


@register("validated_tags", cte("tags") + "SELECT image_id, category, CASE WHEN category = 'returnflag' THEN CASE WHEN value = 'N' THEN 'r' ELSE lower(value) END WHEN category = 'linestatus' THEN 'f' ELSE value END AS value, CASE WHEN category = 'returnflag' AND value = 'N' THEN 'REMAP returnflag: ''N'' → ''r''' WHEN category = 'linestatus' AND value <> 'F' THEN 'CLAMP linestatus: ''' || value || ''' → ''f'' (default)' END AS note FROM tags")
def validated_tags(spark, d):
    v = media.validated(F.col("category"), F.col("value"), {"returnflag": ["a", "r"], "linestatus": ["f"]}, {"returnflag": {"n": "r"}})
    return Catalog(spark, d).tags.select("image_id", "category", v.alias("v")).select("image_id", "category", "v.*")


@register("region_boxes", "SELECT l_orderkey AS id, l_linenumber AS line, ['surface', 'FACE', 'face_F', 'face_x', 'Face_m'][l_partkey % 5 + 1] AS label, round(l_discount / 3, 4) AS score, l_quantity + 10.0 AS x2, CASE WHEN l_partkey % 5 IN (1, 2, 4) AND l_linenumber > 1 THEN 1 ELSE 0 END AS faces FROM lineitem")
def region_boxes(spark, d):
    t = Catalog(spark, d).raw("lineitem")
    box = F.array(F.col("l_quantity"), F.lit(0.0), F.lit(10.0), F.col("l_linenumber") - F.lit(1.0))
    r = media.regions(F.array(F.struct(F.element_at(F.array(*map(F.lit, ("surface", "FACE", "face_F", "face_x", "Face_m"))), (F.col("l_partkey") % 5 + 1).cast("int")).alias("class"), (F.col("l_discount") / 3).alias("score"), box.alias("box"))))
    rows = t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), r.alias("r"))
    return rows.select("id", "line", F.col("r")[0]["label"].alias("label"), F.col("r")[0]["score"].alias("score"), F.col("r")[0]["box"][2].alias("x2"), F.size(media.face_regions(F.col("r"))).alias("faces"))


@register("reject_reasons", cte("tags") + "SELECT value, count(*) AS n FROM tags WHERE category = 'type' GROUP BY value ORDER BY n DESC, value LIMIT 12")
def reject_reasons(spark, d):
    return stats.reasons(Catalog(spark, d).tags, "type")


@register("fit_accuracy", cte("vectors", more=_POS) + "SELECT count(*) AS n, round(avg(CASE WHEN (score > 0.05) = (label = 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM s JOIN vectors USING (id)")
def fit_accuracy(spark, d):
    c = Catalog(spark, d)
    y = c.vectors.select("id", (F.col("label") == 0).cast("int").alias("y"))
    return stats.accuracy(_scores(c).join(y, "id"), 0.05)


@register("run_summary", "SELECT (SELECT count(*) FROM events) AS done, (SELECT round(avg(value), 4) FROM events) AS mean_seconds, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS \"left\", round((SELECT count(*) FROM orders WHERE o_orderstatus = 'P') * (SELECT round(avg(value), 4) FROM events) / 3600, 2) AS hours_left")
def run_summary(spark, d):
    c = Catalog(spark, d)
    return stats.run_summary(c.items.select(F.col("size").alias("seconds")), c.images.where("not processed"))


@register("store_gate", "SELECT count(*) AS n, bool_and(label >= 0) AS passed, CASE WHEN (SELECT count(*) FROM embeddings) >= floor(0.9 * (SELECT count(*) FROM documents)) THEN 'ready' ELSE 'insufficient' END AS readiness FROM embeddings")
def store_gate(spark, d):
    c = Catalog(spark, d)
    n = c.captions.agg(F.count("*").alias("corpus"))
    g = stats.gate(c.vectors.select((F.col("label") >= 0).alias("ok")))
    return g.crossJoin(n).select("n", "passed", stats.readiness_of(F.col("n"), F.col("corpus"), F.lit(5), F.lit(5)).alias("readiness"))


@register("vector_pack", "SELECT vec_id AS id, 4 * len(embedding) AS n_bytes, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def vector_pack(spark, d):
    v = Catalog(spark, d).raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    p = vectors.packed(v)
    total = F.aggregate(F.transform("v", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return p.select("id", F.length("raw").cast("long").alias("n_bytes")).join(vectors.unpacked(p, 64).select("id", F.round(total, 5).alias("total")), "id")

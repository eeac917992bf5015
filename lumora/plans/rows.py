"""Queries on scalar functions, rows of labels, notes and scenes, files written and read back, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumora.functions import media
from lumora.operators import details, filters, geo, scenes, stats, writes
from lumora.plans.registry import register
from lumora.sources import files
from lumora.sources.catalog import Catalog, cte
from lumora.sources.shared import shared_dir
from lumora.streaming import live


def _one_of(n, *values):
    """The value whose place is n modulo their number."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (n % len(values) + 1).cast("int"))


def _fresh(spark, name):
    return f"{shared_dir(spark)}/lumora-{name}-{uuid.uuid4().hex}"


@register("video_scalars", cte("videos") + "SELECT id, CASE WHEN id % 4 = 0 THEN width::DOUBLE WHEN id % 3 <> 0 THEN round(width * 1000 / (id % 3), 6) END AS fps, abs(id * 30 - 400) % 360 AS turn, CASE WHEN id % 7 = 0 OR width > height THEN 'landscape' WHEN height > width THEN 'portrait' ELSE 'square' END AS shape, CAST(floor(duration / 7 + 0.5) AS BIGINT) AS tiles, CAST(ceil(floor(duration / 7 + 0.5) / 5) AS BIGINT) AS sheet_rows, CASE WHEN width % 9 > id % 9 THEN (width % 9 + id % 9) / 2 ELSE id % 9 END::DOUBLE AS mid FROM videos")
def video_scalars(spark, d):
    c = F.col
    rate = F.when(c("id") % 4 == 0, c("width").cast("string")).otherwise(F.format_string("%d/%d", c("width") * 1000, c("id") % 3))
    tiles = media.sprite_count(c("duration"), 7.0)
    return Catalog(spark, d).videos.select(
        "id", F.round(media.frame_rate(rate), 6).alias("fps"), media.rotation(c("id") * 30 - 400).alias("turn"),
        media.ingest_orientation(F.when(c("id") % 7 != 0, c("width")), c("height")).alias("shape"), tiles.alias("tiles"), media.sprite_rows(tiles, 5).alias("sheet_rows"),
        media.midpoint((c("id") % 9).cast("double"), (c("width") % 9).cast("double")).alias("mid"))


_PATHS = "p AS (SELECT id, person, ['sfw', 'nsfw', 'bogus'][id % 3 + 1] AS bucket, CASE id % 5 WHEN 0 THEN 'library/' || person || '/' || ['sfw', 'nsfw', 'bogus'][id % 3 + 1] || '/f' WHEN 1 THEN '_unsorted/' || ['sfw', 'nsfw', 'bogus'][id % 3 + 1] || '/x' WHEN 2 THEN '_inbound_videos/' || person || '/x' WHEN 3 THEN '/abs/library/' || filename ELSE '__macosx/x' END || '.' || ['jpg', 'MP4', 'txt', 'webp', 'mov', 'xyz'][id % 6 + 1] AS path FROM videos)"


@register("path_scalars", cte("videos", more=_PATHS) + "SELECT id, CASE WHEN id % 5 IN (0, 2) THEN person END AS person, CASE WHEN id % 5 < 2 AND bucket <> 'bogus' THEN bucket ELSE 'unrated' END AS rating, CASE WHEN id % 5 = 3 THEN path ELSE '/root/c/' || path END AS resolved, CASE WHEN id % 5 = 3 THEN substr(path, 6) ELSE path END AS relative, CASE WHEN id % 5 = 4 THEN 'junk' ELSE ['image', 'video', 'junk', 'image', 'video', 'other'][id % 6 + 1] END AS kind FROM p")
def path_scalars(spark, d):
    i, bucket = F.col("id"), _one_of(F.col("id"), "sfw", "nsfw", "bogus")
    folder = F.when(i % 5 == 0, F.concat(F.lit("library/"), "person", F.lit("/"), bucket, F.lit("/f"))).when(i % 5 == 1, F.concat(F.lit("_unsorted/"), bucket, F.lit("/x"))).when(i % 5 == 2, F.concat(F.lit("_inbound_videos/"), "person", F.lit("/x"))).when(i % 5 == 3, F.concat(F.lit("/abs/library/"), "filename")).otherwise("__macosx/x")
    rows = Catalog(spark, d).videos.select("id", F.concat(folder, F.lit("."), _one_of(i, "jpg", "MP4", "txt", "webp", "mov", "xyz")).alias("path"))
    p = F.col("path")
    return rows.select("id", media.person_from_path(p).alias("person"), media.rating_from_path(p).alias("rating"), media.resolved(p, "/root/c/").alias("resolved"), media.relative(p, "/abs").alias("relative"), media.file_kind(p).alias("kind"))


@register("rating_maps", cte("videos") + "SELECT id, ['sfw', 'suggestive', 'suggestive', 'nsfw', 'unrated'][id % 5 + 1] AS head, CASE WHEN width / 50 >= height / 50 AND width / 50 >= 0.5 THEN 'sfw' WHEN height / 50 >= 0.5 THEN 'suggestive' ELSE 'nsfw' END AS top, CASE WHEN id % 2 = 0 THEN filename ELSE person END AS tagged FROM videos")
def rating_maps(spark, d):
    c = F.col
    tag = lambda k, v: F.struct(F.lit(k).alias("category"), v.alias("value"))
    tags = F.array(tag("type", c("rating")), F.when(c("id") % 2 == 0, tag("rating", c("filename"))).otherwise(tag("brand", c("filename"))), tag("rating", c("person")))
    top = media.argmax_label(F.create_map(F.lit("safe"), c("width") / 50, F.lit("sexy"), c("height") / 50, F.lit("porn"), F.lit(0.5)))
    return Catalog(spark, d).videos.select("id", media.mapped(_one_of(c("id"), " General ", "sensitive", "QUESTIONABLE", "explicit", "other"), media.RATING_MAP).alias("head"), top.alias("top"), media.first_rating(tags).alias("tagged"))


@register("model_answers", cte("videos") + "SELECT id AS image_id, unnest(['mood', 'mood', 'place']) AS category, unnest([rating, 'calm', person]) AS value FROM videos WHERE id % 3 <> 0")
def model_answers(spark, d):
    """Every third answer has no object, or one that doesn't end."""
    c = F.col
    some = F.format_string('Here: {"mood": ["%s", "calm"], "place": ["%s"]} as asked.', "rating", "person")
    text = F.when(c("id") % 3 != 0, some).when(c("id") % 2 == 0, "nothing } found").otherwise('{"mood": ["x"')
    return writes.exploded_tags(Catalog(spark, d).videos.select(c("id").alias("image_id"), media.answered_tags(text).alias("tags")))


_BOX = "b AS (SELECT id, width * 20 AS w, height * 20 AS h, (id % 7)::DOUBLE / 10 AS bx, (id % 5)::DOUBLE / 10 AS by_, (id % 3 + 1)::DOUBLE / 10 AS bw FROM videos), s AS (SELECT *, least(greatest(1.0::DOUBLE, bw * w) * 2.2, w) AS cw, least(greatest(1.0::DOUBLE, 0.2::DOUBLE * h) * 2.2, h) AS ch FROM b), t AS (SELECT *, least(greatest(0.0::DOUBLE, (bx + bw / 2) * w - cw / 2), w - cw) AS x, least(greatest(0.0::DOUBLE, (by_ + 0.2::DOUBLE / 2) * h - ch / 2), h - ch) AS y FROM s)"


@register("crop_boxes", cte("videos", more=_BOX) + "SELECT id, round_even(x, 0) AS x1, round_even(y, 0) AS y1, least(w, greatest(round_even(x, 0) + 1, round_even(x + cw, 0))) AS x2, least(h, greatest(round_even(y, 0) + 1, round_even(y + ch, 0))) AS y2 FROM t")
def crop_boxes(spark, d):
    i = F.col("id")
    box = F.array(*((x.cast("double") / 10) for x in (i % 7, i % 5, i % 3 + 1)), F.lit(0.2))
    r = media.crop_rectangle(box, F.col("width") * 20, F.col("height") * 20)
    return Catalog(spark, d).videos.select("id", r.alias("r")).select("id", *(F.col("r")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))))


@register("dms_coordinates", cte("items", more="v AS (SELECT id, id % 3 AS r, CASE WHEN id % 11 <> 0 THEN person % 200 + (id % 60) / 60 + (id % 600) / 36000 END AS x FROM items)") + "SELECT id, round(CASE WHEN abs(x) <= 180 THEN CASE WHEN r = 0 THEN x ELSE -x END END, 9) AS decimal FROM v")
def dms_coordinates(spark, d):
    i = F.col("id")
    v = geo.dms_to_decimal((F.col("person") % 200).cast("string"), F.when(i % 11 != 0, (i % 60).cast("string")).otherwise("x"), ((i % 600) / 10).cast("string"), _one_of(i, "N", "s", " West"))
    return Catalog(spark, d).items.select("id", F.round(v, 9).alias("decimal"))


@register("place_rows", "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS name, event_type AS cc, CASE WHEN event_id % 3 <> 0 THEN value END AS lat FROM events")
def place_rows(spark, d):
    i, none = F.col("id"), F.lit(None).cast("string")
    p = media.place(F.when(i % 2 == 0, F.col("kind")), none, none, F.col("kind"), F.when(i % 3 != 0, F.col("size").cast("string")).otherwise("x"), none)
    return Catalog(spark, d).items.select("id", p.alias("p")).select("id", "p.name", "p.cc", "p.lat")


@register("proxy_scores", cte("videos") + "SELECT id, round(0.35::DOUBLE * least(filesize / 1000, 1) + 0.2::DOUBLE * least(duration / 80, 1) + 0.25::DOUBLE * (height / 50) + 0.2::DOUBLE * (1 - abs(width * 5 - 128) / 128), 9) AS score FROM videos")
def proxy_scores(spark, d):
    c = F.col
    return Catalog(spark, d).videos.select("id", F.round(media.proxy_score(c("filesize"), c("duration"), c("height") / 50, c("width") * 5), 9).alias("score"))


@register("page_counts", cte("images") + "SELECT person, count(*) AS n, CAST(greatest(1, ceil(count(*) / 40)) AS BIGINT) AS pages FROM images GROUP BY person")
def page_counts(spark, d):
    return Catalog(spark, d).images.groupBy("person").agg(F.count("*").alias("n")).select("person", "n", filters.total_pages(F.col("n"), 40).alias("pages"))


@register("logit_labels", "SELECT vec_id AS id, 'l' || i AS value, round(1 / (1 + exp(-x)), 6) AS score FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings) WHERE 1 / (1 + exp(-x)) >= 0.55")
def logit_labels(spark, d):
    v = Catalog(spark, d).vectors.select("id", F.col("v").alias("logits"))
    return details.labels_over(v, [f"l{i}" for i in range(64)], 0.55).withColumn("score", F.round("score", 6))


_SETS = "l AS (SELECT asset_id * 2 + CASE WHEN set_name = 'Toxic' THEN 1 ELSE 0 END AS id, asset_id, CASE WHEN asset_id % 3 <> 0 THEN set_name END AS set_name, set_name AS category, value FROM labelled)"


def _set_labels(c):
    a = F.col("asset_id")
    return c.labels.select((a * 2 + (F.col("set_name") == "Toxic").cast("int")).alias("id"), "asset_id", F.when(a % 3 != 0, F.col("set_name")).alias("set_name"), F.col("set_name").alias("category"), "value")


@register("free_labels", cte("labelled", more=_SETS) + "SELECT id, asset_id, category, value FROM l WHERE set_name IS NULL ORDER BY id DESC")
def free_labels(spark, d):
    return details.free_labels(_set_labels(Catalog(spark, d)))


@register("label_map", cte("labelled", more=_SETS) + "SELECT asset_id, max(id) FILTER (set_name = 'Quality' AND value = 'good') AS good, max(id) FILTER (set_name = 'Toxic' AND value = 'yes') AS toxic, count(DISTINCT set_name) AS n FROM l WHERE set_name IS NOT NULL GROUP BY asset_id")
def label_map(spark, d):
    m = details.label_map(_set_labels(Catalog(spark, d)))
    at = lambda s, v: F.try_element_at(F.try_element_at("sets", F.lit(s)), F.lit(v))
    return m.select("asset_id", at("Quality", "good").alias("good"), at("Toxic", "yes").alias("toxic"), F.size("sets").cast("long").alias("n"))


@register("notes_written", "WITH n AS (SELECT conv_id * 1000 + turn AS id, conv_id AS asset_id, text AS content FROM conversations) SELECT id, asset_id, CASE WHEN asset_id % 2 = 0 AND id = min(id) OVER (PARTITION BY asset_id) THEN 'new' ELSE content END AS content FROM n UNION ALL SELECT DISTINCT NULL::BIGINT, -asset_id, 'new' FROM n WHERE asset_id % 2 = 0 AND asset_id > 0")
def notes_written(spark, d):
    c = F.col
    notes = Catalog(spark, d).raw("conversations").select((c("conv_id") * 1000 + c("turn")).alias("id"), c("conv_id").alias("asset_id"), c("text").alias("content"))
    even = notes.where("asset_id % 2 = 0").select("asset_id").distinct()
    return writes.notes_written(notes, even.union(even.where("asset_id > 0").select(-c("asset_id"))).withColumn("content", F.lit("new")))


@register("scene_faces", cte("scenes") + "SELECT video, scene, 0::BIGINT AS face_index, 0.5::DOUBLE AS score, 1 AS embedded FROM scenes WHERE scene % 2 = 1 UNION ALL SELECT video, scene, i, (lo + i) / 100, 0 FROM (SELECT *, unnest([0::BIGINT, 1::BIGINT]) AS i FROM scenes WHERE scene % 2 = 0 AND video % 3 <> 0)")
def scene_faces(spark, d):
    s = Catalog(spark, d).scenes
    old = s.select("video", "scene", F.lit(0).cast("long").alias("face_index"), F.array(F.lit(0.0)).alias("box"), F.lit(0.5).alias("score"), F.lit(1).alias("embedded"))
    face = lambda i: F.struct(F.array(F.lit(float(i))).alias("box"), ((F.col("lo") + i) / 100).alias("score"))
    two = F.array(face(0), face(1))
    found = s.where("scene % 2 = 0").select("video", "scene", F.when(F.col("video") % 3 != 0, two).otherwise(F.filter(two, lambda x: F.lit(False))).alias("faces"))
    return writes.scene_faces_replaced(old, found).drop("box")


@register("export_selection", cte("images", "labelled") + "SELECT i.id, i.person, l.value AS rating FROM images i LEFT JOIN (SELECT * FROM labelled WHERE set_name = 'Quality') l ON l.asset_id = i.id WHERE i.person = '5-LOW' AND l.value = 'good' ORDER BY i.id LIMIT 100")
def export_selection(spark, d):
    c = Catalog(spark, d)
    return details.selection(c.images, c.labels, "Quality", "5-LOW", "good", 100)


@register("export_all", cte("images", "labelled") + "SELECT i.id, i.person, l.value AS rating FROM images i LEFT JOIN (SELECT * FROM labelled WHERE set_name = 'Quality') l ON l.asset_id = i.id")
def export_all(spark, d):
    c = Catalog(spark, d)
    return details.selection(c.images, c.labels, "Quality")


@register("pending_posters", cte("videos") + "SELECT id, filename AS path, duration FROM videos WHERE processed = 1 AND id % 4 <> 0 AND id % 6 <> 1 ORDER BY id LIMIT 50")
def pending_posters(spark, d):
    i = F.col("id")
    v = Catalog(spark, d).videos.withColumns({"poster_locked": i % 4 == 0, "path": F.when(i % 6 != 1, F.col("filename"))})
    return details.pending_posters(v, 50)


@register("vectors_in_order", cte("images", "vectors", more="r AS (SELECT id, row_number() OVER (ORDER BY filesize DESC, id) AS rank FROM images ORDER BY rank LIMIT 400)") + "SELECT rank, id, label, round(v[1], 6) AS first FROM r JOIN vectors USING (id) ORDER BY rank")
def vectors_in_order(spark, d):
    from lumora.operators.retrieval import with_rank

    c = Catalog(spark, d)
    return details.in_rank_order(with_rank(c.images, "filesize", 400), c.vectors).select("rank", "id", "label", F.round(F.col("v")[0], 6).alias("first"))


@register("probes_present", "SELECT count(*) AS n_probes, count(*) FILTER (doc_id IN (SELECT vec_id FROM embeddings)) AS n_present FROM documents")
def probes_present(spark, d):
    c = Catalog(spark, d)
    return stats.present(c.captions.select(F.col("image_id").alias("id")), c.vectors)


@register("collection_members", cte("images") + "SELECT id, owner_id FROM images WHERE (owner_id = 7 OR owner_id IS NULL) AND id IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)")
def collection_members(spark, d):
    c = Catalog(spark, d)
    items = c.raw("lineitem").select(F.col("l_linenumber").alias("collection_id"), F.col("l_orderkey").alias("image_id"))
    return filters.in_collection(filters.owned(c.images, filters.viewer_of({"id": 7, "role": "user"})), items, 3).select("id", "owner_id")


@register("rules_by_category", "SELECT p_type AS category, count(*) AS n, string_agg(p_brand, ',' ORDER BY p_brand) AS rule_values FROM (SELECT DISTINCT p_type, p_brand FROM part) GROUP BY p_type")
def rules_by_category(spark, d):
    return stats.rules_by_category(Catalog(spark, d).raw("part").select(F.col("p_type").alias("category"), F.col("p_brand").alias("value")).distinct())


@register("scene_index", cte("segments") + "SELECT video, start_s AS start, row_number() OVER (PARTITION BY video ORDER BY start_s) - 1 AS scene FROM segments")
def scene_index(spark, d):
    return scenes.scene_index(Catalog(spark, d).segments.select("video", "start"))


@register("videos_uncut", cte("videos", "scenes") + "SELECT id, filename FROM videos WHERE id NOT IN (SELECT video FROM scenes)")
def videos_uncut(spark, d):
    c = Catalog(spark, d)
    return scenes.without_scenes(c.videos, c.scenes).select("id", "filename")


@register("tags_cleared", cte("tags") + "SELECT tag_source, category, count(*) AS n FROM tags WHERE tag_source <> 's1' GROUP BY ALL")
def tags_cleared(spark, d):
    return writes.clear_source(Catalog(spark, d).tags, "s1").groupBy("tag_source", "category").agg(F.count("*").alias("n"))


@register("flags_written", cte("images") + "SELECT id, CASE WHEN id % 9 = 0 THEN 'keep' ELSE flag_action END AS flag_action FROM images")
def flags_written(spark, d):
    t = Catalog(spark, d).images
    wanted = t.where("id % 9 = 0").select("id", F.lit("keep").alias("action")).union(spark.range(1).selectExpr("-1L", "'keep'"))
    return writes.flagged(t, wanted).select("id", "flag_action")


@register("schema_evolved", cte("videos") + "SELECT id, duration, NULL::VARCHAR AS poster_path, 1 - 1 + processed::BIGINT AS processed FROM videos")
def schema_evolved(spark, d):
    from pyspark.sql.types import DoubleType, LongType, StringType, StructType

    to = StructType().add("id", LongType()).add("duration", DoubleType()).add("poster_path", StringType()).add("processed", LongType())
    return writes.add_missing_columns(writes.add_missing_columns(Catalog(spark, d).videos, to), to)


@register("unknown_ids", cte("images") + "SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (SELECT id FROM images WHERE flag_action = 'reject')")
def unknown_ids(spark, d):
    c = Catalog(spark, d)
    return writes.unknown_ids(c.vectors, c.images.where("flag_action = 'reject'")).select("id", "label")


@register("duplicate_files", "WITH h AS (SELECT doc_id AS id, sha256(text) AS hash FROM documents), p AS (SELECT substr(hash, 1, 3) AS prefix, count(DISTINCT hash) AS n FROM h GROUP BY 1 HAVING count(*) > 1) SELECT id, CASE WHEN n = 1 THEN 'dedup' ELSE 'full_hash' END AS action, n > 1 OR id = (SELECT min(g.id) FROM h g WHERE g.hash = h.hash) AS kept FROM h JOIN p ON p.prefix = substr(h.hash, 1, 3)")
def duplicate_files(spark, d):
    """Three characters stand for the twelve, so that different texts collide too."""
    return stats.duplicate_files(Catalog(spark, d).captions.select(F.col("image_id").alias("id"), F.sha2("caption", 256).alias("hash")), 3)


@register("events_listed", cte("items") + "SELECT person, min(t) AS start_time, count(*) AS n FROM items GROUP BY person ORDER BY start_time DESC, person")
def events_listed(spark, d):
    return geo.events_listed(Catalog(spark, d).items.groupBy("person").agg(F.min("t").alias("start_time"), F.count("*").alias("n")), "person")


_BRANDS = "f AS (SELECT 'person=' || p_brand AS person, string_agg(p_partkey, chr(10) ORDER BY p_partkey) || chr(10) AS content FROM part GROUP BY p_brand)"


def _brand_files(spark, d):
    """A text file for each brand's parts, in a folder of its own."""
    out = _fresh(spark, "files")
    rows = Catalog(spark, d).raw("part").select(F.col("p_brand").alias("person"), "p_partkey")
    rows.repartition("person").sortWithinPartitions("person", "p_partkey").select("person", F.col("p_partkey").cast("string").alias("value")).write.partitionBy("person").text(out)
    return files.scan_folder(spark, out, "*.txt").withColumn("person", F.regexp_replace("person", "%23", "#"))


@register("folder_scan", f"WITH {_BRANDS} SELECT person, length(content) AS size, 'txt' AS extension, 'junk' AS kind, sha256(content) AS file_hash FROM f")
def folder_scan(spark, d):
    return _brand_files(spark, d).select("person", "size", "extension", "kind", "file_hash")


@register("folder_counts", f"WITH {_BRANDS} SELECT person, 1::BIGINT AS n, CAST(person >= 'person=Brand#2' AS BIGINT) AS n_new FROM f")
def folder_counts(spark, d):
    s = _brand_files(spark, d)
    return files.scan_counts(s, s.where("person < 'person=Brand#2'").select("file_hash"))


@register("manifest_check", f"WITH {_BRANDS} SELECT count(*) FILTER (person >= 'person=Brand#2') AS present, count(*) FILTER (person < 'person=Brand#2') AS missing, count(*) FILTER (person LIKE '%5') AS size_mismatch FROM f WHERE person >= 'person=Brand#2' OR person NOT LIKE '%5'")
def manifest_check(spark, d):
    """A manifest of all files against a disk that lacks the brands that begin with 1; the sizes of other brands that end in 5 are off by one."""
    s = _brand_files(spark, d).withColumn("brand", F.regexp_extract("person", r"(\d+)$", 1))
    first = F.col("brand").startswith("1")
    wanted = s.where(~(first & F.col("brand").endswith("5"))).select("path", (F.col("size") + F.col("brand").endswith("5").cast("int")).alias("size"))
    return files.manifest_against_disk(wanted, s.where(~first))


@register("json_lines_last", "SELECT key, max(n) AS n FROM (SELECT doc_id % 97 AS key, doc_id AS n FROM documents) GROUP BY key")
def json_lines_last(spark, d):
    out = _fresh(spark, "jsonl")
    Catalog(spark, d).captions.select((F.col("image_id") % 97).alias("key"), F.col("image_id").alias("n")).orderBy("n").write.json(out)
    return files.jsonl_last(spark, out, "key long, n long", "key")


@register("json_lines_resumed", "SELECT doc_id AS id, source FROM documents")
def json_lines_resumed(spark, d):
    """Half of the rows are written; a second run of all appends the rest only."""
    out = _fresh(spark, "resume")
    rows = Catalog(spark, d).captions.select(F.col("image_id").alias("id"), F.col("model").alias("source"))
    files.append_json(rows.where("id % 2 = 0"), out, "id")
    files.append_json(rows, out, "id")
    return files.jsonl(spark, out, "id long, source string")


@register("json_manifest", "SELECT conv_id * 1000 + turn AS id, role FROM conversations")
def json_manifest(spark, d):
    """One manifest file for each tenth of the conversations."""
    out, c = _fresh(spark, "manifest"), F.col
    rows = Catalog(spark, d).raw("conversations").select((c("conv_id") * 1000 + c("turn")).alias("id"), "role")
    one = rows.groupBy((c("id") % 10).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct(c("id").cast("string"), F.struct("role")))).alias("m"))
    one.select("part", F.to_json("m").alias("value")).repartition("part").write.partitionBy("part").text(out)
    return files.json_manifest(spark, out, "role string")


@register("vocabulary_read", "SELECT p_partkey AS tag_id, p_name AS name, p_type AS category FROM part")
def vocabulary_read(spark, d):
    out = _fresh(spark, "vocabulary")
    Catalog(spark, d).raw("part").select(F.col("p_partkey").alias("tag_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category")).write.option("header", "true").csv(out)
    return files.vocabulary_csv(spark, out, "tag_id long, name string, category string")


def _event_stream(spark, d):
    t = Catalog(spark, d).raw("events")
    return spark.readStream.schema(t.schema).parquet(f"{d}/events.parque[t]")  # a pattern, as the source takes no single file


@register("stream_annotated", "SELECT event_id AS id, upper(event_type) AS tag FROM events WHERE value > 50")
def stream_annotated(spark, d):
    """What is new is annotated once: a second run over the same files finds nothing."""
    out, mark = _fresh(spark, "annotated"), _fresh(spark, "mark")
    for _ in range(2):
        live.annotate(_event_stream(spark, d), lambda b: b.where("value > 50").select(F.col("event_id").alias("id"), F.upper("event_type").alias("tag")), out, mark).awaitTermination()
    return spark.read.parquet(out).drop("batch")


@register("stream_throughput", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_throughput(spark, d):
    """Windows that the watermark, an hour behind the latest row, has closed."""
    out, mark = _fresh(spark, "windows"), _fresh(spark, "mark")
    q = live.throughput(_event_stream(spark, d)).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.col("latest").cast("timestamp_ntz").alias("latest"))


def _two_files(spark, d, name, late_hours, run):
    """Rows of even events, written by as many tasks as read them, then, with the query stopped in between, of odd ones, of which many are late: run(stream) on the same checkpoint each time."""
    t = Catalog(spark, d).raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    source, out, mark = (_fresh(spark, f"{name}-{x}") for x in ("in", "out", "mark"))
    for part in (0, 1):
        t.where(F.col("event_id") % 2 == part).write.mode("append").parquet(source)
        for _ in range(2):  # the second start finds nothing new
            live.to_folder(run(spark.readStream.schema(t.schema).parquet(source), f"{late_hours} hours"), out, mark)
    return spark.read.parquet(out)


_ACCEPTED = "e AS (SELECT *, epoch_us(ts) // 1000 AS ms, event_id % 2 AS part FROM events), mark AS (SELECT (SELECT max(ms) FROM e WHERE part = 0) - 72 * 3600000 AS w1, (SELECT max(ms) FROM e) - 72 * 3600000 AS w2), ok AS (SELECT * FROM e, mark WHERE part = 0 OR ms > w1)"


@register("stream_sessions", f"WITH {_ACCEPTED}, c AS (SELECT user_id, ms, w2, CASE WHEN ms - lag(ms) OVER o > 21600000 THEN 1 ELSE 0 END AS cut FROM ok WINDOW o AS (PARTITION BY user_id ORDER BY ms)), s AS (SELECT user_id, ms, w2, sum(cut) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS k FROM c) SELECT user_id AS person, make_timestamp(min(ms) * 1000) AS start, make_timestamp(max(ms) * 1000) AS \"end\", count(*) AS n FROM s GROUP BY user_id, k, w2 HAVING max(ms) + 21600000 < w2")
def stream_sessions(spark, d):
    """Sessions that the watermark, three days behind, has closed; late rows of the second file are dropped, others extend what the first one left open."""
    got = _two_files(spark, d, "sessions", 72, lambda s, late: live.kept_sessions(s.select(F.col("user_id").alias("person"), "ts"), 21_600, late))
    return got.select("person", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


_OUTCOME = "SELECT id, CASE WHEN n < 3 THEN 'incomplete' WHEN fine THEN 'done' ELSE 'failed' END AS outcome, array_to_string(list_filter(['click', 'view', 'purchase'], lambda t: NOT list_contains(got, t)), ',') AS missing FROM"
_TIERS = "r AS (SELECT event_id // 6 AS id, event_type AS tier, value > 20 AS fine, ms, part, w1, w2 FROM ok WHERE event_type IN ('click', 'view', 'purchase')), {one} AS (SELECT id, min(ms) AS since, count(DISTINCT tier) AS n, bool_and(fine) AS fine, list(DISTINCT tier) AS got, any_value(w1) AS w1, any_value(w2) AS w2 FROM r WHERE {which} GROUP BY id)"


_THREE = _ACCEPTED.replace("FROM events)", "FROM events WHERE event_type IN ('click', 'view', 'purchase'))", 1)  # the watermark sees these only


@register("stream_tiers", f"WITH {_THREE}, {_TIERS.format(one='a', which='part = 0')}, {_TIERS.split('{one}')[1].join(['b', '']).format(which='part = 1 OR id IN (SELECT id FROM a WHERE n < 3 AND since + 86400000 >= w1)')} {_OUTCOME} a WHERE n = 3 OR since + 86400000 < w1 UNION ALL {_OUTCOME} b WHERE n = 3 OR since + 86400000 < w2")
def stream_tiers(spark, d):
    """Assets whose three tiers have all reported, or that have waited for a day; what the first file leaves open, the second one completes."""
    kinds = ("click", "view", "purchase")
    of = lambda s, late: live.finalised_assets(s.select(F.expr("event_id div 6").alias("id"), F.col("event_type").alias("tier"), (F.col("value") > 20).alias("ok"), "ts"), kinds, 86_400, late)
    return _two_files(spark, d, "tiers", 72, of)

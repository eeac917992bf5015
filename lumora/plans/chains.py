"""Queries on runs that chain several operators, and on selections by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.operators import details, geo, parity, people, scenes, vectors, writes
from lumora.plans.registry import register
from lumora.plans.store import _FACES, _faces
from lumora.plans.vectors import _CLUSTERS, _SEG
from lumora.sources import files
from lumora.sources.catalog import Catalog, cte

_UNIT = "u AS (SELECT f.id, f.embedder, v.v, sqrt(list_inner_product(v.v, v.v)) AS n FROM faces f JOIN vectors v USING (id) WHERE f.person IS NULL AND f.embedder = 0)"
_RUN = (
    f"{_FACES}, {_UNIT}, nb AS (SELECT a.id AS a, b.id AS b FROM u a, u b WHERE 1 - list_inner_product(a.v, b.v) / (a.n * b.n) <= 0.75),"
    " core AS (SELECT a FROM nb GROUP BY a HAVING count(*) >= 3), links AS (SELECT a, b FROM nb WHERE a IN (FROM core) AND b IN (FROM core)),"
    " reach AS (SELECT a, a AS b FROM core UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b), lab AS (SELECT a, min(b) AS c FROM reach GROUP BY a),"
    " own AS (SELECT a AS id, c FROM lab UNION ALL SELECT nb.a, min(c) FROM nb JOIN lab ON lab.a = nb.b WHERE nb.a NOT IN (FROM core) GROUP BY nb.a) "
)


@register("faces_clustered", cte("vectors", more=_RUN, recursive=True) + "SELECT (SELECT count(*) FROM u) AS faces_considered, count(DISTINCT c) AS clusters_created, count(*) AS faces_assigned, (SELECT count(*) FROM u) - count(*) AS noise FROM own")
def faces_clustered(spark, d):
    """Pending faces of an embedder clustered into new people: what the run reports."""
    c = Catalog(spark, d)
    return people.clustered(_faces(c), c.vectors, 0, 0.75, 3, "dbscan")[2]


@register("faces_clustered_people", cte("vectors", more=_RUN, recursive=True) + "SELECT max(p.last) + 1 + c AS person, count(*) AS n, min(id) AS cover FROM own, (SELECT max(person) AS last FROM faces) p GROUP BY c")
def faces_clustered_people(spark, d):
    """The new people of such a run."""
    c = Catalog(spark, d)
    return people.clustered(_faces(c), c.vectors, 0, 0.75, 3, "dbscan")[1]


@register("faces_of_embedder", f"WITH {_FACES} SELECT * FROM faces WHERE embedder = 1")
def faces_of_embedder(spark, d):
    return people.of_embedder(_faces(Catalog(spark, d)), 1)


@register("faces_added", f"WITH {_FACES}, a AS (SELECT doc_id % 50 AS image_id, doc_id AS box, CASE WHEN doc_id % 2 = 0 THEN 1::BIGINT END AS person FROM documents), n AS (SELECT (SELECT max(id) FROM faces) + row_number() OVER (ORDER BY image_id, box) AS id, image_id, person FROM a) SELECT id, image_id, person FROM faces UNION ALL SELECT id, image_id, person FROM n")
def faces_added(spark, d):
    c = Catalog(spark, d)
    new = c.captions.select((F.col("image_id") % 50).alias("image_id"), F.col("image_id").alias("box"), F.when(F.col("image_id") % 2 == 0, F.lit(1)).cast("long").alias("person"), F.lit(0).cast("long").alias("embedder"))
    return people.added(_faces(c), new)[0].select("id", "image_id", "person")


_GRID = [7, 3, 999_999_999, 5, 3, 1, 2]


@register("grid_by_ids", cte("images") + f"SELECT id, person, filesize, nth FROM (SELECT i.*, row_number() OVER (ORDER BY list_position({_GRID}, id)) AS nth FROM images i WHERE id IN ({', '.join(map(str, _GRID))}))")
def grid_by_ids(spark, d):
    rows = details.by_ids(Catalog(spark, d).images, _GRID).select("id", "person", "filesize")
    return rows.select(F.struct("*").alias("r")).agg(F.collect_list("r").alias("x")).select(F.posexplode("x").alias("i", "r")).select("r.*", (F.col("i") + 1).cast("long").alias("nth"))


def _feed(c, enough):
    state = c.vectors.agg(F.count("*").alias("n_vectors"), F.count_if(F.col("label") == 0).alias("n_labelled"))
    ranked = c.vectors.where("id % 7 = 0").select("id", (F.col("id") * 31 % 1009).alias("rank"))
    return details.feed(ranked, c.images.select("id", "person"), state, F.col("n_labelled") >= enough, "too few labels")


@register("feed_ready", cte("vectors", "images") + "SELECT v.id, id * 31 % 1009 AS rank, i.person FROM vectors v JOIN images i USING (id) WHERE v.id % 7 = 0")
def feed_ready(spark, d):
    return _feed(Catalog(spark, d), 1)[0]


@register("feed_degraded", cte("vectors") + "SELECT count(*) AS n_vectors, count(*) FILTER (label = 0) AS n_labelled, true AS degraded, 'too few labels' AS reason, 0::BIGINT AS items FROM vectors")
def feed_degraded(spark, d):
    """Without enough labels the feed is empty, and says why."""
    items, status = _feed(Catalog(spark, d), 10**9)
    return status.crossJoin(items.agg(F.count("*").alias("items")))


@register("assets_rejected", "WITH a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN '_rejected/' ELSE 'library/' || o_orderpriority || '/' END || 'f' || o_custkey % 97 || '.webp' AS path, sha256(CAST(o_orderkey AS VARCHAR)) AS file_hash FROM orders), m AS (SELECT *, row_number() OVER (PARTITION BY id % 3 = 0 AND path NOT LIKE '\\_rejected/%' ESCAPE '\\', split_part(path, '/', -1) ORDER BY id) AS r, '_rejected/' || split_part(path, '/', -1) AS dst FROM a) SELECT id, CASE WHEN id % 3 = 0 AND NOT starts_with(path, '_rejected/') THEN CASE WHEN r > 1 OR dst IN (SELECT path FROM a) THEN replace(dst, '.webp', '_' || left(file_hash, 8) || '.webp') ELSE dst END ELSE path END AS path, CASE WHEN id % 3 = 0 THEN 'reject' WHEN id % 3 = 1 THEN 'keep' END AS flag_action FROM m")
def assets_rejected(spark, d):
    """Assets flagged in one batch: rejected files move, with their hash in the name where another file has it."""
    o = Catalog(spark, d).raw("orders")
    folder = F.when(F.col("o_orderkey") % 50 == 0, F.lit("_rejected/")).otherwise(F.concat(F.lit("library/"), "o_orderpriority", F.lit("/")))
    path = F.concat(folder, F.lit("f"), (F.col("o_custkey") % 97).cast("string"), F.lit(".webp"))
    assets = o.select(F.col("o_orderkey").alias("id"), path.alias("path"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("file_hash"), F.lit(None).cast("string").alias("flag_action"))
    wanted = assets.where("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, "reject").otherwise("keep").alias("action"))
    return writes.rejected(assets, wanted)[0].drop("file_hash")


@register("events_backfilled", cte("items", more=_SEG + ", " + _CLUSTERS, recursive=True) + "SELECT min(seg.id) AS event, min(t) AS start_t, max(t) AS end_t, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS member_count FROM seg LEFT JOIN own ON own.id = seg.id LEFT JOIN (SELECT * FROM cl WHERE place = 1) main ON main.person = seg.person AND main.segment = seg.segment GROUP BY seg.person, seg.segment, coalesce(own.cluster, main.cluster, 0)")
def events_backfilled(spark, d):
    """Events of time and place with their members, as they would be written."""
    events, members = geo.backfilled_events(Catalog(spark, d).items, gap=21_600, eps_km=500.0, least=2)
    n = members.groupBy("event").agg(F.count("*").alias("member_count"))
    return events.drop("member_count").withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)}).join(n.hint("merge"), "event")


@register("vector_page", cte("vectors") + "SELECT id, round(s, 6) AS similarity, row_number() OVER (ORDER BY round(s, 6) DESC, id) AS rank FROM (SELECT a.id, list_inner_product(a.v, q.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(q.v, q.v))) AS s FROM vectors a, (SELECT v FROM vectors WHERE id = 7) q) QUALIFY rank BETWEEN 21 AND 30")
def vector_page(spark, d):
    v = Catalog(spark, d).vectors
    return vectors.page(v, v.where("id = 7"), 3, 10)


@register("labelled_counts", cte("vectors") + "SELECT count(*) FILTER (id % 5 = 0) AS n_pos, count(*) FILTER (id % 5 <> 0 AND id % 3 = 0) AS n_neg, count(*) FILTER (id % 5 <> 0 AND id % 3 <> 0) AS n_unlabelled, true AS fits FROM vectors")
def labelled_counts(spark, d):
    v = Catalog(spark, d).vectors
    return details.labelled_counts(details.examples(v, v.where("id % 5 = 0"), v.where("id % 3 = 0")))


@register("images_upserted", cte("images") + "SELECT id, person, CASE WHEN id % 3 = 0 THEN NULL ELSE filesize END AS filesize FROM images WHERE id % 2 = 0 UNION ALL SELECT id, NULL, CASE WHEN id % 3 = 0 THEN NULL ELSE filesize END FROM images WHERE id % 2 = 1")
def images_upserted(spark, d):
    """Images by key: the given column is overwritten, with nulls too, the others stay; new ones come in."""
    i = Catalog(spark, d).images.select("id", "person", "filesize")
    new = i.select("id", F.when(F.col("id") % 3 != 0, F.col("filesize")).alias("filesize"))
    return writes.upsert_given(i.where("id % 2 = 0").withColumn("filesize", F.lit(-1.0).cast(dict(i.dtypes)["filesize"])), new, ["id"], ["filesize"])


@register("values_added", "WITH v AS (SELECT n_nationkey + 1 AS id, 'r' || n_regionkey AS set_name, n_name AS value FROM nation WHERE n_nationkey % 2 = 0), a AS (SELECT 'r' || n_regionkey AS set_name, n_name AS value FROM nation), f AS (SELECT * FROM a EXCEPT SELECT set_name, value FROM v) SELECT set_name, value, id, false AS created FROM v UNION ALL SELECT set_name, value, (SELECT max(id) FROM v) + row_number() OVER (ORDER BY set_name, value), true FROM f")
def values_added(spark, d):
    """A vocabulary's values asked for: those that are there answer with their id."""
    n = Catalog(spark, d).raw("nation").select((F.col("n_nationkey") + 1).cast("long").alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("set_name"), F.col("n_name").alias("value"))
    return writes.values_added(n.where("id % 2 = 1"), n)[1]


@register("scenes_enriched", cte("scenes", more="s AS (SELECT video, scene FROM scenes)") + "SELECT video, scene, lo, hi, scene % 2 = 0 AS tagged, video % 3 = 0 AS captioned, video % 5 <> 0 AS transcribed, CASE WHEN scene % 3 = 1 THEN video % 4 ELSE 0 END AS face_count FROM scenes")
def scenes_enriched(spark, d):
    s = Catalog(spark, d).scenes
    faces = s.where("scene % 3 = 1 and video % 4 > 0").select("video", "scene", F.explode(F.sequence(F.lit(1), F.col("video") % 4)).alias("face"))
    return scenes.enriched(s, s.where("scene % 2 = 0"), s.where("video % 3 = 0"), s.where("video % 5 != 0"), faces)


@register("tags_keyed", cte("tags") + "SELECT image_id, count(*) AS n, round(max(confidence) FILTER (category = 'returnflag' AND value = 'R' AND tag_source = 's1'), 6) AS r FROM tags GROUP BY image_id")
def tags_keyed(spark, d):
    """Each image's tags as a map, and one of its entries."""
    tags = parity.keyed(Catalog(spark, d).dealt_tag_rows)
    key = F.struct(F.lit("returnflag").alias("category"), F.lit("R").alias("value"), F.lit("s1").alias("tag_source"))
    return tags.select("image_id", F.size("tags").cast("long").alias("n"), F.round(F.try_element_at("tags", key), 6).alias("r"))


_TOPS = "p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'downloads/a' WHEN 1 THEN 'Jo Doe/x/y' WHEN 2 THEN 'cache/z' WHEN 3 THEN 'Jo Doe' END AS folder, ['jpg', 'MP4', 'txt', 'xyz'][page_id % 4 + 1] AS ext FROM pages)"


@register("relocation_plan", f"WITH {_TOPS}, k AS (SELECT page_id, folder, lower(ext) AS ext, CASE ext WHEN 'jpg' THEN 'image' WHEN 'MP4' THEN 'video' WHEN 'txt' THEN 'junk' ELSE 'other' END AS kind FROM p) SELECT page_id AS id, kind, CASE WHEN folder LIKE 'Jo%' THEN 'Jo Doe' ELSE '_unsorted' END AS bucket, CASE WHEN kind IN ('image', 'video') THEN CASE WHEN folder LIKE 'Jo%' THEN 'Jo_Doe' ELSE '_unsorted' END END AS person_slug FROM k WHERE folder IS NULL AND kind <> 'other' AND page_id % 100 <> 4 OR folder NOT LIKE 'cache%'")
def relocation_plan(spark, d):
    """Files below a root sorted by their top folder: generic ones and stray files are unsorted, skipped ones have no row."""
    i = F.col("page_id")
    folder = F.when(i % 6 == 0, "downloads/a/").when(i % 6 == 1, "Jo Doe/x/y/").when(i % 6 == 2, "cache/z/").when(i % 6 == 3, "Jo Doe/").otherwise("")
    name = F.when((i % 6 > 3) & (i % 100 == 4), "keep.jpg").otherwise(F.concat(F.lit("f"), i.cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, ("jpg", "MP4", "txt", "xyz"))), (i % 4 + 1).cast("int"))))
    rows = Catalog(spark, d).raw("pages").select(i.alias("id"), F.concat(F.lit("/m/content/"), folder, name).alias("path"))
    plan = files.relocation_plan(rows.select("path"), "/content/", generic=("downloads",), skip=("cache",), keep=("keep.jpg",))
    return rows.join(plan, "path").select("id", "kind", "bucket", "person_slug")

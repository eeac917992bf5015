"""Queries on table rewrites and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.operators import parity, writes
from lumora.plans.registry import register
from lumora.sources.catalog import Catalog, cte

_NEW = "fresh AS (SELECT image_id, category, value, 's9' AS tag_source, max(confidence) AS confidence FROM tags WHERE category = 'returnflag' GROUP BY image_id, category, value), old AS (SELECT image_id, category, value, CASE WHEN tag_source = 's1' THEN 's9' ELSE tag_source END AS tag_source, confidence FROM tags WHERE category = 'returnflag')"


def _old_new(c):
    t = c.tags.where("category = 'returnflag'")
    old = t.withColumn("tag_source", F.when(F.col("tag_source") == "s1", "s9").otherwise(F.col("tag_source")))
    new = t.groupBy("image_id", "category", "value").agg(F.max("confidence").alias("confidence")).withColumn("tag_source", F.lit("s9")).select(*old.columns)
    return old, new


_KEY = ["image_id", "category", "value", "tag_source"]


@register("insert_ignore", cte("tags", more=_NEW) + "SELECT * FROM old UNION ALL SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.image_id = f.image_id AND o.category = f.category AND o.value = f.value AND o.tag_source = f.tag_source)")
def insert_ignore(spark, d):
    c = Catalog(spark, d)
    old, new = _old_new(c)
    return writes.insert_or_ignore(old, new, _KEY, [F.desc("confidence")], c.line_parts)


@register("replace_by_key", cte("tags", more=_NEW) + "SELECT * FROM old WHERE image_id NOT IN (SELECT image_id FROM fresh WHERE image_id % 2 = 0) UNION ALL SELECT * FROM fresh WHERE image_id % 2 = 0")
def replace_by_key(spark, d):
    old, new = _old_new(Catalog(spark, d))
    return writes.replace_by_key(old, new.where("image_id % 2 = 0"), ["image_id"])


@register("upsert_nonnull", "WITH o AS (SELECT doc_id, quality, toxic FROM labels), n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - quality END AS quality, CASE WHEN doc_id % 2 = 0 THEN toxic + 1 END AS toxic FROM labels UNION ALL SELECT -1, 1, NULL) SELECT doc_id, coalesce(n.quality, o.quality) AS quality, coalesce(n.toxic, o.toxic) AS toxic FROM o FULL JOIN n USING (doc_id)")
def upsert_nonnull(spark, d):
    old = Catalog(spark, d).raw("labels").select("doc_id", "quality", "toxic")
    new = old.selectExpr("doc_id", "if(doc_id % 3 = 0, 1 - quality, null) AS quality", "if(doc_id % 2 = 0, toxic + 1, null) AS toxic")
    return writes.upsert_non_null(old, new.union(spark.sql("SELECT -1L, 1, cast(null AS int)")), ["doc_id"])


@register("single_select_assign", cte("labelled", more="n AS (SELECT asset_id, set_name, 'new' AS value FROM labelled WHERE asset_id % 4 = 0)") + "SELECT asset_id, set_name, value FROM labelled WHERE NOT (set_name = 'Quality' AND asset_id % 4 = 0) UNION ALL SELECT asset_id, set_name, value FROM n")
def single_select_assign(spark, d):
    c = Catalog(spark, d)
    sets = spark.createDataFrame([("Quality", True), ("Toxic", False)], "set_name string, single_select boolean")
    return writes.assign_labels(c.labels, sets, c.labels.where("asset_id % 4 = 0").withColumn("value", F.lit("new")))


@register("batch_flag", cte("images") + "SELECT w.id, action, images.id IS NOT NULL AS ok FROM (SELECT vec_id AS id, CASE WHEN label < 5 THEN 'keep' ELSE 'reject' END AS action FROM embeddings) w LEFT JOIN images ON images.id = w.id")
def batch_flag(spark, d):
    c = Catalog(spark, d)
    return writes.batch_flag(c.images, c.vectors.select("id", F.when(F.col("label") < 5, "keep").otherwise("reject").alias("action")))


@register("next_sort_order", "SELECT n_regionkey + 0 AS collection_id, c_custkey AS image_id, CAST(coalesce(top, -1) + row_number() OVER (PARTITION BY n_regionkey ORDER BY c_custkey) AS BIGINT) AS sort_order FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT n_regionkey AS k, max(n_nationkey) AS top FROM nation WHERE n_regionkey < 3 GROUP BY 1) t ON t.k = n_regionkey")
def next_sort_order(spark, d):
    c = Catalog(spark, d)
    nation = c.raw("nation")
    items = nation.where("n_regionkey < 3").select(F.col("n_regionkey").alias("collection_id"), F.col("n_nationkey").alias("sort_order"))
    new = c.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("collection_id"), F.col("c_custkey").alias("image_id"))
    return writes.next_order(items, new)


@register("newest_row", "SELECT user_id AS person, event_type AS kind, ts, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1")
def newest_row(spark, d):
    return writes.newest(Catalog(spark, d).items.select("person", "kind", "ts", "id"), ["person", "kind"], "ts")


@register("parity_full_outer", "WITH a AS (SELECT doc_id, quality FROM labels WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS q2 FROM labels WHERE doc_id % 3 <> 0) SELECT doc_id, CASE WHEN q2 IS NULL THEN 'only_left' WHEN quality IS NULL THEN 'only_right' WHEN quality = q2 THEN 'same' ELSE 'differs' END AS status FROM a FULL JOIN b USING (doc_id)")
def parity_full_outer(spark, d):
    t = Catalog(spark, d).raw("labels").select("doc_id", "quality")
    right = t.where("doc_id % 3 <> 0").withColumn("quality", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return parity.diff(t.where("doc_id % 5 <> 0"), right, ["doc_id"], "quality")


@register("vector_parity", cte("vectors", more="b AS (SELECT id, CASE WHEN id % 10 = 0 THEN list_transform(v, lambda x: x + 0.01) ELSE v END AS w FROM vectors WHERE id % 3 <> 0)") + "SELECT id, l2, cosine, l2 <= 1e-4 AND cosine >= 0.9999 AS ok FROM (SELECT id, round(list_distance(v, w), 6) AS l2, round(list_inner_product(v, w) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(w, w))), 6) AS cosine FROM vectors JOIN b USING (id))")
def vector_parity(spark, d):
    v = Catalog(spark, d).vectors.select("id", "v")
    other = v.where("id % 3 <> 0").withColumn("v", F.when(F.col("id") % 10 == 0, F.transform("v", lambda x: x + 0.01)).otherwise(F.col("v")))
    return parity.vector_diff(v, other)


@register("store_parity", "SELECT (SELECT count(*) FROM documents) AS n_left, (SELECT count(DISTINCT doc_id) FROM documents) AS ids_left, (SELECT count(*) FROM labels) AS n_right, (SELECT count(DISTINCT doc_id) FROM labels) AS ids_right, (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) AND (SELECT count(DISTINCT doc_id) FROM documents) = (SELECT count(DISTINCT doc_id) FROM labels) AS ok")
def store_parity(spark, d):
    c = Catalog(spark, d)
    return parity.store_parity(c.raw("documents"), c.raw("labels"), "doc_id")


@register("box_parity")
def box_parity(spark, d):
    """Boxes made from line items: label the return flag, corners from quantities; the other run is shifted by up to three pixels."""
    t = Catalog(spark, d).raw("lineitem")
    x, y = F.col("l_quantity"), F.col("l_linenumber") * 10.0
    box = lambda dx: t.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("label"), (x + dx).alias("x1"), y.alias("y1"), (x + dx + 20).alias("x2"), (y + 20).alias("y2"))
    return parity.paired_boxes(box(F.lit(0.0)), box((F.col("l_partkey") % 4).cast("double")))

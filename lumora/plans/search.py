"""Queries on caption search and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.operators import filters, retrieval, vectors
from lumora.operators.retrieval import B, FOLD_FROM, FOLD_TO, K1
from lumora.plans.registry import register
from lumora.sources.catalog import Catalog, cte

_T = f"t AS (SELECT image_id AS doc, list_filter(regexp_split_to_array(translate(lower(caption), '{FOLD_FROM}', '{FOLD_TO}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS a FROM captions), lens AS (SELECT doc, len(a) AS length FROM t WHERE len(a) > 0), whole AS (SELECT count(*) AS total, avg(length) AS mean FROM lens)"
_SCORE = f"round(sum(greatest(ln((total - n + 0.5) / (n + 0.5)), 1e-6) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * length / mean))), 6)"


def _and_sql(terms: list[str]) -> str:
    some = ", ".join(repr(t) for t in terms)
    return f"h AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(a) AS term FROM t) WHERE term IN ({some}) GROUP BY doc, term), ns AS (SELECT term, count(*) AS n FROM h GROUP BY term), ranked AS (SELECT doc, {_SCORE} AS score FROM h JOIN ns USING (term) JOIN lens USING (doc), whole GROUP BY doc HAVING count(*) = {len(terms)})"


@register("caption_and", cte("captions", more=f"{_T}, {_and_sql(['thing', 'with'])}") + "SELECT doc, score FROM ranked")
def caption_and(spark, d):
    return retrieval.all_terms(retrieval.stored(Catalog(spark, d).captions), "thing WITH")


@register("caption_phrase", cte("captions", more=f"{_T}, h AS (SELECT doc, len(list_filter(range(1, len(a)), lambda i: a[i] = 'of' AND a[i + 1] = 'the')) AS tf FROM t WHERE len(a) > 1), hits AS (SELECT * FROM h WHERE tf > 0), ns AS (SELECT count(*) AS n FROM hits)") + f"SELECT doc, CAST(tf AS BIGINT) AS n, {_SCORE.replace('sum(', '(')} AS score FROM hits JOIN lens USING (doc), ns, whole")
def caption_phrase(spark, d):
    return retrieval.phrase(retrieval.stored(Catalog(spark, d).captions), "of the")


@register("term_index", cte("captions", more=_T) + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(a) AS term FROM t) GROUP BY doc, term) GROUP BY term")
def term_index(spark, d):
    return retrieval.stored(Catalog(spark, d).captions).terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


_COS = "list_inner_product(a.v, q.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(q.v, q.v)))"
_FUSE = f"{_T}, {_and_sql(['thing', 'with'])}, near AS (SELECT a.id, round({_COS}, 6) AS score FROM vectors a, (SELECT v FROM vectors WHERE id = 7) q <W> ORDER BY {_COS} DESC, id LIMIT 100), r1 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM near), words AS (SELECT doc AS id, score FROM ranked <V> ORDER BY score DESC, id LIMIT 100), r2 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM words), fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 8) AS score FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY id)"


@register("rrf_fusion", cte("captions", "vectors", more=_FUSE.replace("<W>", "").replace("<V>", "")) + "SELECT id, score FROM fused")
def rrf_fusion(spark, d):
    c = Catalog(spark, d)
    near = vectors.nearest(c.vectors, c.vectors.where("id = 7"), 100).withColumnRenamed("similarity", "score")
    words = retrieval.all_terms(retrieval.stored(c.captions), "thing with").withColumnRenamed("doc", "id")
    return retrieval.fused(retrieval.with_rank(near, "score", 100), retrieval.with_rank(words, "score", 100))


_POOL = "SELECT id FROM images WHERE processed AND id IN (SELECT image_id FROM tags WHERE category = 'returnflag' AND value = 'R')"


@register("hybrid_search", cte("captions", "vectors", "images", "tags", more=f"pool AS ({_POOL}), " + _FUSE.replace("<W>", "WHERE a.id IN (SELECT id FROM pool)").replace("<V>", "WHERE doc IN (SELECT id FROM pool)")) + "SELECT id, score FROM fused ORDER BY score DESC, id LIMIT 100")
def hybrid_search(spark, d):
    c = Catalog(spark, d)
    spec = filters.FilterSpec(tags={"returnflag": ["R"]}, processed=True)
    return retrieval.search(c.images, c.tag_rows, c.labels, retrieval.stored(c.captions), c.vectors, spec, "hybrid", "thing with", c.vectors.where("id = 7"))[0]

"""Queries on vectors and on places and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.operators import geo, vectors
from lumora.plans.registry import register
from lumora.sources.catalog import Catalog, cte

_DOT = "list_inner_product({a}, {b})"
_COS = "list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"


def _near(where: str, seed: int) -> str:
    return cte("vectors") + f"SELECT a.id, round({_COS.format(a='a.v', b='q.v')}, 6) AS similarity FROM vectors a, (SELECT v FROM vectors WHERE id = {seed}) q WHERE {where} ORDER BY {_COS.format(a='a.v', b='q.v')} DESC, id LIMIT 20"


@register("knn", _near("true", 7))
def knn(spark, d):
    v = Catalog(spark, d).vectors
    return vectors.nearest(v, v.where("id = 7"), 20)


@register("knn_allowlist", _near("a.label IN (1, 2)", 7))
def knn_allowlist(spark, d):
    v = Catalog(spark, d).vectors
    return vectors.nearest(v, v.where("id = 7"), 20, v.where("label in (1, 2)"))


@register("similar_by_id", _near("a.id <> 11", 11))
def similar_by_id(spark, d):
    return vectors.similar_to(Catalog(spark, d).vectors, 11, 20)


def _mean(where: str, name: str) -> str:
    parts = f"SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors WHERE {where}) GROUP BY i"
    return f"{name}_p AS ({parts}), {name} AS (SELECT i, x / (SELECT sqrt(sum(x * x)) FROM {name}_p) AS x FROM {name}_p)"


@register("centroid", cte("vectors", more="p AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors) GROUP BY label, i)") + "SELECT label, CAST(i - 1 AS INT) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM p")
def centroid(spark, d):
    c = vectors.centroid(Catalog(spark, d).vectors, ["label"])
    return c.select("label", F.posexplode("v").alias("dim", "x")).withColumn("x", F.round("x", 6))


_CONTRAST = f"{_mean('label = 0', 'pos')}, {_mean('label = 1', 'neg')}, diff AS (SELECT pos.i, pos.x - neg.x AS x FROM pos JOIN neg USING (i)), dir AS (SELECT i, x / (SELECT sqrt(sum(x * x)) FROM diff) AS x FROM diff), dirv AS (SELECT list(x ORDER BY i) AS w FROM dir), scores AS (SELECT id, label, round(list_inner_product(v, w) / sqrt(list_inner_product(v, v)), 6) AS score FROM vectors, dirv)"


@register("centroid_contrast", cte("vectors", more=_CONTRAST) + "SELECT id, score FROM scores")
def centroid_contrast(spark, d):
    v = Catalog(spark, d).vectors
    return vectors.scored(v, vectors.contrast(v.where("label = 0"), v.where("label = 1")))


@register("centroid_preview", cte("vectors", more=_CONTRAST) + "SELECT id, score, (SELECT count(*) FROM scores WHERE score > 0.1) AS n_over FROM scores WHERE score > 0.1 ORDER BY score DESC, id LIMIT 15")
def centroid_preview(spark, d):
    v = Catalog(spark, d).vectors
    return vectors.preview(vectors.scored(v, vectors.contrast(v.where("label = 0"), v.where("label = 1"))), 0.1, 15)


_CENTRES = "p AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors) GROUP BY label, i), u AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM p), centres AS (SELECT label AS c, list(x ORDER BY i) AS w FROM u GROUP BY label), s AS (SELECT id, c, round(" + _COS.format(a="v", b="w") + ", 6) AS score, round(1 - " + _COS.format(a="v", b="w") + ", 6) AS distance FROM vectors, centres)"


@register("zero_shot_topk", cte("vectors", more=_CENTRES) + "SELECT id, label, score, rank FROM (SELECT id, 'label' || c AS label, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, 'label' || c) AS rank FROM s WHERE score > 0.05) WHERE rank <= 3")
def zero_shot_topk(spark, d):
    v = Catalog(spark, d).vectors
    labels = vectors.centroid(v, ["label"]).select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("label"), "v")
    return vectors.zero_shot(v.select("id", "v"), labels, 0.05, 3)


@register("nearest_centroid", cte("vectors", more=_CENTRES) + "SELECT id, CASE WHEN distance <= 0.8 THEN c END AS cluster, distance FROM (SELECT id, c, distance, row_number() OVER (PARTITION BY id ORDER BY distance, c) AS r FROM s) WHERE r = 1")
def nearest_centroid(spark, d):
    v = Catalog(spark, d).vectors
    return vectors.nearest_centroid(v.select("id", "v"), vectors.centroid(v, ["label"]).withColumnRenamed("label", "cluster"), 0.8)


_W = [round((-1) ** i * (i % 7) / 10, 1) for i in range(64)]


@register("probe_score", cte("vectors", more=f"w AS (SELECT {_W}::DOUBLE[] AS w), m AS (SELECT id, list_inner_product(v, w) / sqrt(list_inner_product(v, v)) + 0.25 AS z FROM vectors, w)") + "SELECT id, round(z, 6) AS margin, round(1 / (1 + exp(-z)), 6) AS p FROM m")
def probe_score(spark, d):
    z = vectors.linear_margin(vectors.normalised(F.col("v")), _W, 0.25)
    return Catalog(spark, d).vectors.select("id", F.round(z, 6).alias("margin"), F.round(vectors.sigmoid(z), 6).alias("p"))


@register("l2_normalise", cte("vectors") + "SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first FROM vectors")
def l2_normalise(spark, d):
    return Catalog(spark, d).vectors.select("id", F.round(vectors.norm(F.col("v")), 6).alias("norm"), F.round(vectors.normalised(F.col("v"))[0], 6).alias("first"))


@register("self_retrieval", cte("vectors") + f"SELECT id, top_id, similarity, top_id = id AND similarity > 0.99 AS ok FROM (SELECT q.id, a.id AS top_id, round({_COS.format(a='a.v', b='q.v')}, 6) AS similarity, row_number() OVER (PARTITION BY q.id ORDER BY {_COS.format(a='a.v', b='q.v')} DESC, a.id) AS r FROM vectors a, (SELECT * FROM vectors WHERE id % 50 = 0) q) WHERE r = 1")
def self_retrieval(spark, d):
    v = Catalog(spark, d).vectors
    return vectors.self_retrieval(v, v.where("id % 50 = 0"))


def _labelled(v):
    return v.where("label in (0, 1)").select("id", "v", (F.col("label") == 0).cast("int").alias("y"))


@register("ridge_ranked")
def ridge_ranked(spark, d):
    v = Catalog(spark, d).vectors
    w, b, _ = vectors.ridge(_labelled(v))
    return vectors.ranked(v.where("label > 1"), w, b, 25)


@register("ridge_edge_cases")
def ridge_edge_cases(spark, d):
    v = Catalog(spark, d).vectors
    w, b, t = vectors.ridge(_labelled(v))
    return vectors.least_certain(v.where("label > 1"), w, b, t, 25)


@register("logistic_preview")
def logistic_preview(spark, d):
    v = Catalog(spark, d).vectors
    w, b = vectors.logistic(_labelled(v))
    s = v.where("label > 1").select("id", F.round(vectors.sigmoid(vectors.linear_margin(F.col("v"), w, b)), 6).alias("score"))
    return vectors.preview(s, 0.5, 25)


@register("active_learning")
def active_learning(spark, d):
    v = Catalog(spark, d).vectors
    w, b = vectors.logistic(_labelled(v))
    return vectors.least_certain(v.where("label > 1"), w, b, 0.0, 25, unit=False)


_SEG = "cuts AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY person ORDER BY t NULLS LAST, id) > 21600 THEN 1 ELSE 0 END AS cut FROM items), seg AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY person ORDER BY t NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM cuts)"


@register("segments", cte("items", more=_SEG) + "SELECT id, person, segment FROM seg")
def segments(spark, d):
    return geo.segments(Catalog(spark, d).items, 21_600).select("id", "person", "segment")


@register("sessions", cte("items", more=_SEG) + "SELECT person, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS \"end\", count(*) AS n FROM seg GROUP BY person, segment")
def sessions(spark, d):
    from lumora.streaming import live

    return live.sessions(Catalog(spark, d).items, "6 hours")


@register("event_summary", cte("items", more=_SEG) + "SELECT person, segment, min(t) AS start_t, max(t) AS end_t, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS n FROM seg GROUP BY person, segment")
def event_summary(spark, d):
    return geo.summary(geo.segments(Catalog(spark, d).items, 21_600), ["person", "segment"])


_KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"
_CLUSTERS = (
    "pt AS (SELECT person, segment, lat, lon, row_number() OVER (PARTITION BY person, segment ORDER BY t NULLS LAST, id) AS o, id FROM seg WHERE lat IS NOT NULL AND lon IS NOT NULL),"
    " nb AS (SELECT person, segment, x.o AS a, y.o AS b FROM pt x JOIN pt y USING (person, segment) WHERE " + _KM.format(a="x.lat", b="x.lon", c="y.lat", d="y.lon") + " <= 500),"
    " core AS (SELECT person, segment, a FROM nb GROUP BY person, segment, a HAVING count(*) >= 2),"
    " links AS (SELECT person, segment, a, b FROM nb JOIN core USING (person, segment, a) WHERE (person, segment, b) IN (SELECT (person, segment, a) FROM core)),"
    " reach AS (SELECT person, segment, a, a AS b FROM core UNION SELECT r.person, r.segment, r.a, l.b FROM reach r JOIN links l ON l.person = r.person AND l.segment = r.segment AND l.a = r.b),"
    " lab AS (SELECT person, segment, a, min(b) AS first_core FROM reach GROUP BY person, segment, a),"
    " member AS (SELECT * FROM lab UNION ALL SELECT nb.person, nb.segment, nb.a, min(first_core) FROM nb JOIN lab ON lab.person = nb.person AND lab.segment = nb.segment AND lab.a = nb.b WHERE (nb.person, nb.segment, nb.a) NOT IN (SELECT (person, segment, a) FROM core) GROUP BY nb.person, nb.segment, nb.a),"
    " cl AS (SELECT person, segment, first_core, row_number() OVER (PARTITION BY person, segment ORDER BY first_core) - 1 AS cluster, row_number() OVER (PARTITION BY person, segment ORDER BY count(*) DESC, min(a)) AS place FROM member GROUP BY person, segment, first_core),"
    " own AS (SELECT pt.id, cl.cluster FROM member m JOIN cl USING (person, segment, first_core) JOIN pt ON pt.person = m.person AND pt.segment = m.segment AND pt.o = m.a) "
)


@register("event_clusters_gps", cte("items", more=_SEG + ", " + _CLUSTERS, recursive=True) + "SELECT seg.id, seg.person, seg.segment, coalesce(own.cluster, main.cluster, 0) AS cluster FROM seg LEFT JOIN own ON own.id = seg.id LEFT JOIN (SELECT * FROM cl WHERE place = 1) main ON main.person = seg.person AND main.segment = seg.segment")
def event_clusters_gps(spark, d):
    return geo.events(Catalog(spark, d).items, gap=21_600, eps_km=500.0, least=2)


@register("place_grid", cte("items") + "SELECT printf('%.3f', lat) || ',' || printf('%.3f', lon) AS place_key, min(lat) AS lat, min(lon) AS lon, count(*) AS n FROM items WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1")
def place_grid(spark, d):
    return geo.places(Catalog(spark, d).items)


@register("haversine_steps", cte("items", more="step AS (SELECT id, person, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM items WINDOW w AS (PARTITION BY person ORDER BY t, id))") + f"SELECT id, round({_KM.format(a='plat', b='plon', c='lat', d='lon')}, 3) AS km FROM step WHERE plat IS NOT NULL AND plon IS NOT NULL AND lat IS NOT NULL")
def haversine_steps(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("person").orderBy("t", "id")
    s = Catalog(spark, d).items.select("id", "lat", "lon", F.lag("lat").over(w).alias("plat"), F.lag("lon").over(w).alias("plon"))
    return s.where("plat is not null and plon is not null and lat is not null").select("id", F.round(geo.haversine_km(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")), 3).alias("km"))


_PLACES = "g AS (SELECT n_name AS name, -90.0 + n_nationkey * 7 + 0.5 AS lat, -180.0 + n_nationkey * 14 + 0.5 AS lon, CASE WHEN n_regionkey > 0 THEN 'r' || n_regionkey ELSE '' END AS admin1 FROM nation), k AS (SELECT i.id, g.name, g.admin1, round(" + _KM.format(a="i.lat", b="i.lon", c="g.lat", d="g.lon") + ", 6) AS km FROM items i, g WHERE i.lat IS NOT NULL AND i.lon IS NOT NULL)"


@register("nearest_place", cte("items", more=_PLACES) + "SELECT id, name, admin1, '' AS admin2, '' AS cc, km FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, name) AS r FROM k) WHERE r = 1")
def nearest_place(spark, d):
    """Each located item's place as a full row of the gazetteer."""
    c = Catalog(spark, d)
    k = F.col("n_nationkey")
    g = c.raw("nation").select(F.col("n_name").alias("name"), (F.lit(-90.0) + k * 7 + 0.5).alias("lat"), (F.lit(-180.0) + k * 14 + 0.5).alias("lon"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("admin1"))
    found = geo.nearest_place(c.items, g)
    return found.select("id", *geo.place_row({"name": F.col("name"), "admin1": F.col("admin1")}), "km")


@register("nearest_place_all", cte("items", more="g AS (SELECT n_name AS name, -90.0 + n_nationkey * 7 + 0.5 AS lat, -180.0 + n_nationkey * 14 + 0.5 AS lon FROM nation), k AS (SELECT i.id, g.name, round(" + _KM.format(a="i.lat", b="i.lon", c="g.lat", d="g.lon") + ", 6) AS km FROM items i, g WHERE i.lat IS NOT NULL AND i.lon IS NOT NULL)") + "SELECT id, name, km FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, name) AS r FROM k) WHERE r = 1")
def nearest_place_all(spark, d):
    c = Catalog(spark, d)
    k = F.col("n_nationkey")
    return geo.nearest_place(c.items, c.raw("nation").select(F.col("n_name").alias("name"), (F.lit(-90.0) + k * 7 + 0.5).alias("lat"), (F.lit(-180.0) + k * 14 + 0.5).alias("lon"))).select("id", "name", "km")

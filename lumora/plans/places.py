"""Queries on places: backfill from a gazetteer, listings, sprite tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.functions import media
from lumora.operators import geo
from lumora.plans.registry import register
from lumora.plans.vectors import _KM
from lumora.sources.catalog import Catalog, cte


def _gazetteer(c):
    """Nations as places; every fifth shares its name with another one."""
    k = F.col("n_nationkey")
    name = F.when(k % 5 == 0, "twin").otherwise(F.col("n_name"))
    return c.raw("nation").select(name.alias("name"), (F.lit(-90.0) + k * 7 + 0.5).alias("lat"), (F.lit(-180.0) + k * 14 + 0.5).alias("lon"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("admin1"), F.col("n_name").alias("cc"))


_G = "g AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'twin' ELSE n_name END AS name, -90.0::DOUBLE + n_nationkey * 7 + 0.5 AS lat, -180.0::DOUBLE + n_nationkey * 14 + 0.5 AS lon, 'r' || n_regionkey AS admin1, n_name AS cc FROM nation)"
_CELL = "printf('%.3f', lat) || ',' || printf('%.3f', lon)"
_BACKFILL = (
    f"{_G}, i AS (SELECT id, lat, lon, {_CELL} AS place_key FROM items WHERE lat IS NOT NULL AND lon IS NOT NULL),"
    " todo AS (SELECT * FROM i WHERE id % 3 <> 0), old AS (SELECT DISTINCT place_key, 'old' AS name, '' AS admin1, '' AS admin2, '' AS cc, 1.0::DOUBLE AS lat, 2.0::DOUBLE AS lon FROM i WHERE id % 3 = 0),"
    " f AS (SELECT place_key, arg_min(lat, id) AS lat, arg_min(lon, id) AS lon FROM todo WHERE place_key NOT IN (SELECT place_key FROM old) GROUP BY place_key),"
    " k AS (SELECT f.place_key, g.*, round(" + _KM.format(a="f.lat", b="f.lon", c="g.lat", d="g.lon") + ", 6) AS km FROM f, g),"
    " new AS (SELECT place_key, name, admin1, '' AS admin2, cc, lat, lon FROM k QUALIFY row_number() OVER (PARTITION BY place_key ORDER BY km, name) = 1),"
    " places AS (SELECT * FROM old UNION ALL SELECT * FROM new) "
)


def _backfilled(c):
    """Every third item has its place; the others get theirs."""
    key = geo.place_key(F.col("lat"), F.col("lon"))
    items = c.items.select("id", "lat", "lon", F.when(F.col("id") % 3 == 0, key).alias("place_key"))
    text = lambda v, n: F.lit(v).alias(n)
    known = items.where("place_key is not null").select("place_key", text("old", "name"), text("", "admin1"), text("", "admin2"), text("", "cc"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon")).distinct()
    table, links = geo.linked_places(items, known, _gazetteer(c))
    return table, links, items


@register("places_backfilled", cte("items", more=_BACKFILL) + "SELECT p.*, (SELECT count(*) FROM todo WHERE todo.place_key = p.place_key) AS linked FROM places p")
def places_backfilled(spark, d):
    table, links, _ = _backfilled(Catalog(spark, d))
    n = links.groupBy("place_key").agg(F.count("*").alias("linked"))
    return table.join(n, "place_key", "left").withColumn("linked", F.coalesce("linked", F.lit(0)))


@register("places_listed", cte("items", more=_BACKFILL) + "SELECT p.place_key, p.name, count(i.id) AS n, row_number() OVER (ORDER BY count(i.id) DESC, p.name, p.place_key) AS nth FROM places p LEFT JOIN i USING (place_key) GROUP BY p.place_key, p.name ORDER BY n DESC, p.name, p.place_key LIMIT 25")
def places_listed(spark, d):
    """A page of the places with most items."""
    table, links, items = _backfilled(Catalog(spark, d))
    linked = items.where("place_key is not null").select("id", "place_key").unionByName(links)
    page = geo.places_listed(table, linked).limit(25)
    return page.select(F.collect_list(F.struct("place_key", "name", "n")).alias("x")).select(F.posexplode("x").alias("i", "p")).select("p.*", (F.col("i") + 1).cast("long").alias("nth"))


@register("sprite_tiles", cte("videos") + "SELECT id, CASE WHEN id % 4 = 0 THEN 1 ELSE CAST(floor(duration / 7 + 0.5) AS BIGINT) END AS n, CAST(round_even(160 * h / w, 0) AS BIGINT) + CAST(round_even(160 * h / w, 0) AS BIGINT) % 2 AS tile_h FROM (SELECT id, duration, CASE WHEN id % 5 = 0 THEN 9.0::DOUBLE ELSE height END AS h, CASE WHEN id % 5 = 0 THEN 16.0::DOUBLE ELSE width END AS w FROM videos)")
def sprite_tiles(spark, d):
    """Sheets of videos of which some have no duration and some no size."""
    v = Catalog(spark, d).videos
    size = [F.when(F.col("id") % 5 != 0, F.col(c)) for c in ("width", "height")]
    return v.select("id", media.sprite_count(F.when(F.col("id") % 4 != 0, F.col("duration")), 7.0).alias("n"), media.tile_height(160, *size).alias("tile_h"))

"""Distances, coordinates, time-gap segments and events."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.operators.grid import gps_dbscan
from lumora.operators.kdtree import KdTree, on_sphere
from lumora.sources.shared import kept

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def place_key(lat: Column, lon: Column) -> Column:
    """Coordinates at three decimals."""
    return F.concat_ws(",", F.format_string("%.3f", F.round(lat, 3)), F.format_string("%.3f", F.round(lon, 3)))


def dms_to_decimal(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds; the sign changes for S and W; null where one isn't a number or the result is out of range."""
    v = d.try_cast("double") + m.try_cast("double") / 60 + s.try_cast("double") / 3600
    v = F.when(F.upper(F.substr(F.trim(ref), F.lit(1), F.lit(1))).isin("S", "W"), -v).otherwise(v)
    return F.when(F.abs(v) <= 180, v)


def iso6709(text: Column) -> Column:
    """+lat-lon[+alt]/ as struct<lat, lon>; null where it doesn't parse or is out of range."""
    p = F.regexp_extract_all(text, F.lit(r"([+-]\d+(?:\.\d+)?)"), F.lit(1))
    lat, lon = F.try_element_at(p, F.lit(1)).try_cast("double"), F.try_element_at(p, F.lit(2)).try_cast("double")
    return F.when((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.struct(lat.alias("lat"), lon.alias("lon")))


#: Names of the tags, in order of preference.
LAT_TAGS = ("Composite:GPSLatitude", "EXIF:GPSLatitude", "GPSLatitude")
LON_TAGS = ("Composite:GPSLongitude", "EXIF:GPSLongitude", "GPSLongitude")
LAT_REF_TAGS = ("EXIF:GPSLatitudeRef", "GPSLatitudeRef")
LON_REF_TAGS = ("EXIF:GPSLongitudeRef", "GPSLongitudeRef")
VIDEO_TAGS = ("Composite:GPSCoordinates", "QuickTime:GPSCoordinates", "GPSCoordinates")


def gps_of(meta: Column) -> Column:
    """From a map of tags: decimals, negative where the reference is S or W, else the ISO 6709 text of a video."""

    def get(*keys):
        return F.coalesce(*(F.nullif(F.try_element_at(meta, F.lit(k)), F.lit("")) for k in keys))

    def signed(v, ref):
        x = v.try_cast("double")
        return F.when(F.upper(F.substr(F.trim(ref), F.lit(1), F.lit(1))).isin("S", "W"), -F.abs(x)).otherwise(x)

    lat, lon = signed(get(*LAT_TAGS), get(*LAT_REF_TAGS)), signed(get(*LON_TAGS), get(*LON_REF_TAGS))
    return F.coalesce(F.when((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.struct(lat.alias("lat"), lon.alias("lon"))), iso6709(get(*VIDEO_TAGS)))


def segments(items: DataFrame, gap: float, by: str | None = "person") -> DataFrame:
    """items with segment (from 0 for each by): a new one starts where the gap is above gap; rows without a time come last and never cut."""
    w = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    o = w.orderBy(F.col("t").asc_nulls_last(), "id")
    cut = F.coalesce((F.col("t") - F.lag("t").over(o) > gap).cast("int"), F.lit(0))
    return items.withColumn("cut", cut).withColumn("segment", F.sum("cut").over(o.rowsBetween(Window.unboundedPreceding, 0))).drop("cut")


def summary(items: DataFrame, by: list[str]) -> DataFrame:
    """start, end, centre of the items with coordinates, and number of members, for each group."""
    return items.groupBy(*by).agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.count("*").alias("n"))


def places(items: DataFrame) -> DataFrame:
    """place_key, lat, lon, n: one row for each cell of three decimals."""
    k = items.where("lat is not null and lon is not null").withColumn("place_key", place_key(F.col("lat"), F.col("lon")))
    return k.groupBy("place_key").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"), F.count("*").alias("n"))


def events(items: DataFrame, gap: float = 21_600, eps_km: float = 2.0, least: int = 2, by: str | None = "person") -> DataFrame:
    """id, by, segment, cluster: time-gap segments, cut by DBSCAN on coordinates; noise and items without coordinates join the segment's largest cluster.

    Clusters are numbered by their first core item (by time, then id); of equally large ones the one with the first member counts, and
    a border item goes to the first cluster that has a core item near it. A segment without clusters is one event, 0.
    Cells of the grid meet in a task, never a segment (see grid.gps_dbscan).
    """
    by = by or "all"
    rows = items if by in items.columns else items.withColumn(by, F.lit(0))
    seg = segments(rows, gap, by).select("id", by, "segment", "t", "lat", "lon")
    order = F.struct(F.coalesce("t", F.lit(float("inf"))).alias("t"), F.col("id").cast("long").alias("id"))
    spots = seg.where("lat is not null and lon is not null").groupBy(by, "segment", "lat", "lon").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    found = kept(gps_dbscan(spots, [by, "segment"], eps_km, least), "spots")
    # numbers of clusters: by their first core spot; the main one has most members, the first member decides between equals
    clusters = found.where("start is not null").groupBy(by, "segment", "start").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    w = Window.partitionBy(by, "segment")
    clusters = clusters.withColumn("cluster", (F.row_number().over(w.orderBy("start")) - 1).cast("long")).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "first")))
    mains = clusters.where("r = 1").select(by, "segment", F.col("cluster").alias("main"))
    named = found.join(clusters.select(by, "segment", "start", "cluster").hint("merge"), [by, "segment", "start"]).select(by, "segment", "lat", "lon", "cluster")
    out = seg.join(named.hint("merge"), [by, "segment", "lat", "lon"], "left").join(mains.hint("merge"), [by, "segment"], "left")
    return out.select("id", by, "segment", F.coalesce("cluster", "main", F.lit(0).cast("long")).alias("cluster"))


#: Gazetteer places sent to the tasks at once (names, coordinates and numbers: some 20 MB), items searched together.
PLACES_AT_ONCE, ITEMS_AT_ONCE = 200_000, 8192
_trees: dict[str, tuple] = {}


def _tree(token: str, sent) -> tuple:
    """A worker's k-d tree of the places sent under this name, kept for its next tasks."""
    if token not in _trees:
        _trees.clear()
        _trees[token] = KdTree(on_sphere(sent[2], sent[3])), *sent
    return _trees[token]


def nearest_place(items: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """The nearest gazetteer place of each item (a row for each id) with coordinates, however far: id, km (6 decimals), and the place's whole row.

    gazetteer: name, lat, lon and whatever more; its lat and lon come as place_lat and place_lon, an id of its own as place_id. Of equally near places
    the smallest name counts, of those with equal names any one; two places of one name are two. Items without coordinates have no row,
    places without are never found; with no places there are no rows.

    The gazetteer goes to the tasks in passes of bounded size, each as a k-d tree built once a worker; the smallest distance
    over the passes counts. The tree stops where no unseen place can be nearer.
    """
    names = {"lat": "place_lat", "lon": "place_lon", "id": "place_id"}
    table = gazetteer.select(*(F.col(c).alias(names.get(c, c)) for c in gazetteer.columns)).where("place_lat is not null and place_lon is not null")
    table = kept(table.withColumn("_place", F.monotonically_increasing_id()), "places")
    passes = max(1, -(-table.count() // PLACES_AT_ONCE))
    rows = items.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where("lat is not null and lon is not null")
    out = None
    for i in range(passes):
        some = table.where(F.pmod(F.xxhash64("_place"), F.lit(passes)) == i).select("_place", "name", F.col("place_lat").cast("double"), F.col("place_lon").cast("double")).collect()
        some.sort(key=lambda r: (r[1] is None, r[1] or "", r[0]))
        sent = items.sparkSession.sparkContext.broadcast((np.array([r[0] for r in some], np.int64), [r[1] for r in some], np.array([r[2] for r in some], float), np.array([r[3] for r in some], float)))

        def run(batches, sent=sent, token=uuid.uuid4().hex):
            tree, numbers, names, glat, glon = _tree(token, sent.value)
            if not names:
                return
            for b in batches:
                for j in range(0, b.num_rows, ITEMS_AT_ONCE):
                    part = b.slice(j, ITEMS_AT_ONCE)
                    lat, lon = (part.column(c).to_numpy(zero_copy_only=False) for c in ("lat", "lon"))
                    row, col = tree.nearest(on_sphere(lat, lon))
                    la, lo, ga, go = np.radians(lat[row]), np.radians(lon[row]), np.radians(glat[col]), np.radians(glon[col])
                    a = np.sin((ga - la) / 2) ** 2 + np.cos(la) * np.cos(ga) * np.sin((go - lo) / 2) ** 2
                    km = np.round(2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, a))), 6)
                    order = np.lexsort((col, km, row))
                    first = order[np.concatenate(([True], np.diff(row[order]) > 0))] if len(order) else order
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row[first])), pa.array([names[c] for c in col[first]], pa.string()), pa.array(km[first]), pa.array(numbers[col[first]])], ["id", "_name", "km", "_place"])

        part = rows.mapInArrow(run, f"id {dict(items.dtypes)['id']}, _name string, km double, _place long")
        out = part if out is None else out.union(part)
    if passes > 1:
        best = out.groupBy("id").agg(F.min(F.struct("km", F.col("_name").isNull().alias("no"), "_name", "_place")).alias("b"))
        out = best.select("id", F.col("b.km").alias("km"), F.col("b._place").alias("_place"))
    return out.drop("_name").join(table, "_place").drop("_place")


def place_row(row: dict[str, Column]) -> list[Column]:
    """name, admin1, admin2, cc of a gazetteer row: what is missing is empty."""
    return [F.coalesce(row.get(c, F.lit(None).cast("string")), F.lit("")).alias(c) for c in ("name", "admin1", "admin2", "cc")]


def epoch_of(text: Column) -> Column:
    """A number, or an ISO time, as seconds since 1970; null where it is neither."""
    return F.coalesce(text.try_cast("double"), F.unix_micros(F.try_to_timestamp(text)) / 1e6)


def iso_of(seconds: Column) -> Column:
    """Seconds since 1970 as ISO time in UTC (whole seconds, or six decimals where there are any); null stays null."""
    us = F.round(seconds * 1_000_000).cast("long")
    at = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_micros(us).cast("timestamp_ntz"))
    return F.when(us.isNotNull(), F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.pmod(us, F.lit(1_000_000)) == 0, "").otherwise(F.date_format(at, ".SSSSSS")), F.lit("+00:00")))


def filled_coordinates(items: DataFrame, found: DataFrame) -> DataFrame:
    """items (id, lat, lon, ...) with coordinates of found (id, lat, lon) where they have none; both or neither are filled."""
    f = found.select("id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).where("_lat is not null and _lon is not null")
    none = F.col("lat").isNull() | F.col("lon").isNull()
    use = none & F.col("_lat").isNotNull()
    return items.join(f, "id", "left").withColumn("_use", use).withColumns({"lat": F.when(F.col("_use"), F.col("_lat")).otherwise(F.col("lat")), "lon": F.when(F.col("_use"), F.col("_lon")).otherwise(F.col("lon"))}).select(*items.columns)


def linked_places(items: DataFrame, known: DataFrame, gazetteer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, links): known places (place_key, name, admin1, admin2, cc, lat, lon) with the cells of items that have coordinates but no place (place_key null), and the (id, place_key) of those items.

    A known place stays as it is; a new one is the gazetteer's place nearest to the cell's first item (by id), with that place's names and coordinates.
    """
    todo = items.where("lat is not null and lon is not null and place_key is null").select("id", "lat", "lon", place_key(F.col("lat"), F.col("lon")).alias("place_key"))
    first = todo.groupBy("place_key").agg(F.min(F.struct("id", "lat", "lon")).alias("f")).join(known.select("place_key"), "place_key", "left_anti")
    cells = first.select(F.col("place_key").alias("id"), F.col("f.lat").alias("lat"), F.col("f.lon").alias("lon"))
    found = nearest_place(cells, gazetteer)
    texts = place_row({c: F.col(c) for c in ("name", "admin1", "admin2", "cc") if c in found.columns})
    new = found.select(F.col("id").alias("place_key"), *texts, F.col("place_lat").alias("lat"), F.col("place_lon").alias("lon"))
    return known.select(*new.columns).unionByName(new), todo.select("id", "place_key")


def counted_places(items: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, links) by cell alone: known places (place_key, lat, lon, n) with the items' new cells and counts put in, and each item's (id, place_key).

    A place that is known keeps its coordinates and takes the new count.
    """
    now = places(items)
    both = known.select("place_key", F.col("lat").alias("_a"), F.col("lon").alias("_b"), F.col("n").alias("_n")).join(now, "place_key", "full")
    table = both.select("place_key", F.coalesce("_a", "lat").alias("lat"), F.coalesce("_b", "lon").alias("lon"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    links = items.where("lat is not null and lon is not null").select("id", place_key(F.col("lat"), F.col("lon")).alias("place_key"))
    return table, links


def places_listed(places: DataFrame, items: DataFrame) -> DataFrame:
    """Places (place_key, name) with the number of items (place_key) linked to them, most first, then by name and key."""
    n = items.where("place_key is not null").groupBy("place_key").agg(F.count("*").alias("n"))
    return places.join(n, "place_key", "left").select("place_key", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy(F.desc("n"), "name", "place_key")


def events_listed(events: DataFrame, key: str = "event") -> DataFrame:
    """Events with the latest start first, then by key."""
    return events.orderBy(F.desc("start_time"), key)


def backfilled_events(items: DataFrame, gap: float = 21_600, eps_km: float = 2.0, least: int = 2, by: str | None = "person") -> tuple[DataFrame, DataFrame]:
    """(events, members): an event for each cluster of events(), named by its smallest member (event, start_t, end_t, lat, lon, member_count), and its members (event, id)."""
    by = by or "all"
    rows = items if by in items.columns else items.withColumn(by, F.lit(0))
    found = kept(events(rows, gap, eps_km, least, by).join(rows.select("id", "t", "lat", "lon").hint("merge"), "id"), "events")
    named = found.groupBy(by, "segment", "cluster").agg(F.min("id").alias("event"), F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("member_count"))
    members = found.join(named.select(by, "segment", "cluster", "event").hint("merge"), [by, "segment", "cluster"]).select("event", "id")
    return named.select("event", "start_t", "end_t", "lat", "lon", "member_count"), members

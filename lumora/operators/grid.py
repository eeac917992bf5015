"""DBSCAN of coordinates on a grid: what meets in a task are cells and their neighbours, however large a group is.

A cell is so small that any two of its spots are within eps. A cell with at least `least` items is therefore all core,
without a comparison; spots of other cells (fewer than `least` of them each) are compared with the spots of the cells around. All core
spots of a cell are connected, so clusters are connected cells: two cells touch if some pair of their core spots
is within eps. Cells with many spots are compared chunk by chunk, and chunks whose boxes are too far apart aren't.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.operators.graph import components
from lumora.sources.shared import kept

EARTH_KM = 6371.0088
#: Core spots of a cell that are compared as one matrix.
CHUNK = 1024


def _haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


class Grid:
    """Bands of latitude, each cut into equal columns that are no wider than a band is high."""

    def __init__(self, eps_km: float):
        self.eps = math.degrees(eps_km / EARTH_KM)
        #: The diagonal of a cell stays below eps, with some room for the sphere; of very large cells the way along both sides does.
        self.side = self.eps / (math.sqrt(2) if eps_km <= 3000 else 2) * 0.98

    def band(self, lat: Column) -> Column:
        return F.floor((lat + 90) / self.side).cast("long")

    def columns(self, band: Column) -> Column:
        """Columns of a band: its widest circle is the one nearest to the equator."""
        low, high = band * self.side - 90, (band + 1) * self.side - 90
        flat = F.when((low <= 0) & (high >= 0), 0.0).otherwise(F.least(F.abs(low), F.abs(high)))
        return F.greatest(F.lit(1), F.ceil(F.cos(F.radians(F.least(flat, F.lit(90.0)))) * 360 / self.side)).cast("long")

    def column(self, lon: Column, band: Column) -> Column:
        n = self.columns(band)
        return F.pmod(F.floor((F.pmod(lon + 180, F.lit(360.0))) / 360 * n).cast("long"), n)

    def around(self, low: Column, high: Column, west: Column, east: Column) -> Column:
        """Cells (structs b, c) that may hold a spot within eps of a box of at most a cell's size."""
        e = self.eps * (1 + 1e-9) + 1e-12
        bands = F.sequence(F.greatest(F.lit(0), self.band(low - e)).cast("long"), self.band(F.least(high + e, F.lit(90.0))).cast("long"))
        top = F.greatest(F.abs(low), F.abs(high))
        sine = math.sin(math.radians(min(e, 90)))
        wide = F.when((top + e >= 90) | (sine >= F.cos(F.radians(top))), 360.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), sine / F.cos(F.radians(top))))) * (1 + 1e-9) + 1e-9)

        def cells(b):
            n = self.columns(b)
            a = F.floor((west - wide + 180) / 360 * n).cast("long")
            z = F.floor((east + wide + 180) / 360 * n).cast("long")
            return F.transform(F.array_distinct(F.transform(F.sequence(a, F.least(z, a + n - 1)), lambda c: F.pmod(c, n))), lambda c: F.struct(b.alias("b"), c.alias("c")))

        return F.flatten(F.transform(bands, cells))


def _touching(pairs: DataFrame, eps_km: float) -> DataFrame:
    """a, b of those pairs of chunks of which two spots are within eps."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for r in batch.to_pylist():
                if r["a"] in a[-1:] and r["b"] in b[-1:]:
                    continue
                la, lo, ka, ko = (np.radians(np.array(r[c])) for c in ("lat_a", "lon_a", "lat_b", "lon_b"))
                h = np.sin((la[:, None] - ka) / 2) ** 2 + np.cos(la)[:, None] * np.cos(ka) * np.sin((lo[:, None] - ko) / 2) ** 2
                if 2 * EARTH_KM * np.arcsin(np.sqrt(min(1.0, h.min()))) <= eps_km:
                    a.append(r["a"])
                    b.append(r["b"])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


def gps_dbscan(spots: DataFrame, by: list[str], eps_km: float, least: int) -> DataFrame:
    """spots (by, lat, lon, n: items there, first: their scan order) with start: the scan order of the first core spot of their cluster, null for noise.

    Neighbours count as items, a spot's own included. A border spot goes to the first cluster that has a core spot within eps.
    Latitudes are within 90 degrees, longitudes any. No group, and no cell with many spots, meets in one task.
    All tables here grow with the spots, so none goes whole through the driver: their joins are merges, however small a file looks.
    """
    grid = Grid(eps_km)
    band = grid.band(F.col("lat"))
    rows = spots.withColumns({"b": band, "c": grid.column(F.col("lon"), band)})
    cell = [*by, "b", "c"]
    counts = rows.groupBy(*cell).agg(F.sum("n").alias("cell_n"), F.count("*").alias("cell_spots"))
    counts = kept(counts.withColumn("cell", F.monotonically_increasing_id()), "cells")
    rows = rows.join(counts.hint("merge"), cell)
    near = _haversine(F.col("lat"), F.col("lon"), F.col("q_lat"), F.col("q_lon")) <= eps_km
    around = F.explode(grid.around(F.col("q_lat"), F.col("q_lat"), F.col("q_lon"), F.col("q_lon"))).alias("at")
    sparse = rows.where(F.col("cell_n") < least)

    def beside(few: DataFrame, others: DataFrame) -> DataFrame:
        """Pairs within eps of spots of sparse cells (q_...) and others."""
        q = few.select(*by, F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon")).select("*", around).select(*by, "q_lat", "q_lon", F.col("at.b").alias("b"), F.col("at.c").alias("c"))
        return others.join(q.hint("merge"), cell).where(near)

    spot = [*by, F.col("q_lat").alias("lat"), F.col("q_lon").alias("lon")]
    enough = beside(sparse, rows).groupBy(*by, "q_lat", "q_lon").agg(F.sum("n").alias("near_n")).where(F.col("near_n") >= least).select(*spot, F.lit(True).alias("core"))
    rows = kept(rows.join(enough.hint("merge"), [*by, "lat", "lon"], "left").withColumn("core", (F.col("cell_n") >= least) | F.coalesce("core", F.lit(False))), "cores")
    core = rows.where("core")
    chunk = F.pmod(F.xxhash64("lat", "lon"), F.ceil(F.col("cell_spots") / CHUNK).cast("long"))
    chunks = core.select(*cell, "cell", "lat", "lon", chunk.alias("k")).groupBy(*cell, "cell", "k").agg(F.collect_list("lat").alias("lats"), F.collect_list("lon").alias("lons"))
    chunks = kept(chunks, "chunks")
    box = grid.around(F.array_min("lats"), F.array_max("lats"), F.array_min("lons"), F.array_max("lons"))
    left = chunks.select(*by, F.col("cell").alias("a"), F.col("lats").alias("lat_a"), F.col("lons").alias("lon_a"), F.explode(box).alias("at")).select("*", "at.b", "at.c").drop("at")
    right = chunks.select(*cell, F.col("cell").alias("b_"), F.col("lats").alias("lat_b"), F.col("lons").alias("lon_b"))
    pairs = left.join(right.hint("merge"), cell).where("a < b_").select("a", F.col("b_").alias("b"), "lat_a", "lon_a", "lat_b", "lon_b")
    nodes = chunks.select(F.col("cell").alias("id")).distinct()
    named = components(nodes, _touching(pairs, eps_km))
    parts = core.join(named.select(F.col("id").alias("cell"), F.col("component").alias("part")).hint("merge"), "cell")
    starts = parts.groupBy("part").agg(F.min("first").alias("start"))
    parts = parts.join(starts.hint("merge"), "part").select(*cell, "lat", "lon", "start")
    border = beside(rows.where("not core"), parts).groupBy(*by, "q_lat", "q_lon").agg(F.min("start").alias("start")).select(*spot, "start")
    named = parts.select(*by, "lat", "lon", "start").unionByName(border)
    return rows.select(*spots.columns).join(named.hint("merge"), [*by, "lat", "lon"], "left")


"""Exact search for the largest inner products with an M-tree whose pages are rows of tables.

Largest inner products are nearest neighbours on a sphere: every vector v gets one more coordinate that brings
its length to that of the longest one, L, a query gets a zero there. Angles on the sphere are the tree's metric, and
cos(angle) * |query| * L is the inner product itself.

The tree. Equal vectors are one object. A region with more than REGION objects is divided among FANOUT of them, drawn
by hash, each taking what is nearest to it; Spark repeats that with all regions of a level at once, so that
no task holds a region that is still to be divided. An undivided region is cut into pages of some PAGE objects. Regions
and pages have a routing object and a covering radius; an object of a page keeps its distance to the page's
routing object.

The search, best first. A query goes down to the region that promises most and finds its best objects there. With the
last of them as the score to beat, it goes to those regions only that may hold as good a one. In a region, a
query visits the pages in the order of what they promise, until none can improve its result; of a page, the objects
that |d(query, routing object) - d(object, routing object)| rules out are not computed. All queries whose next page is
the same one share a matrix product. How many products were computed comes with the result (n_products).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumora.llm.text import drop, kept

#: Objects of a region and of a page, regions that one is divided into, and queries that meet a region in one task.
REGION, PAGE, FANOUT, QUERIES = 16_384, 128, 64, 1024
#: Levels of regions: deeper ones (very uneven data) are dealt by hash instead, with the same routing object.
DEEPEST = 9
#: Below every score.
LOWEST = -(2**63 - 1)
#: Slack for angles in double precision.
SLACK = 1e-7


def whole(vector: Column, factor: int = 64) -> Column:
    """floor(factor * x) of each component; null if the vector or a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fit = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    return F.when(fit, F.transform(x, lambda v: F.floor(v * factor).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows; shorter ones end in zeros."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(at) and (at == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(at), width), np.int64)
    out[np.repeat(np.arange(len(at)), at), np.arange(len(flat)) - np.repeat(np.cumsum(at) - at, at)] = flat
    return out


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().astype(np.int64)))


class Sphere:
    """The metric: vectors of width components with squared length up to most."""

    def __init__(self, width: int, most: int):
        self.width, self.most = width, most
        self.length = math.sqrt(max(most, 1))
        self.exact = most < 2**53  # then every sum of products is an integer that a double holds

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors of the tree as points of the unit sphere."""
        x = x.astype(np.float64)
        last = np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))
        return np.concatenate((x, last[:, None]), axis=1) / self.length

    def turned(self, q: np.ndarray) -> np.ndarray:
        """Queries as points of it; the zero vector stays zero and is as far from everything."""
        q = q.astype(np.float64)
        n = np.sqrt((q * q).sum(axis=1))
        return np.concatenate((q, np.zeros((len(q), 1))), axis=1) / np.maximum(n, 1e-300)[:, None]

    def scale(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(np.float64)
        return np.sqrt((q * q).sum(axis=1)) * self.length

    def products(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Exact inner products as longs."""
        if self.exact:
            return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
        out = q.astype(object) @ x.astype(object).T
        if out.size and (out.max() >= 2**63 or out.min() < -(2**63)):
            raise ValueError("an inner product does not fit a long")
        return out.astype(np.int64)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _promise(angle: np.ndarray, radius: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The largest score that a ball may hold for each query (rows)."""
    return np.floor(np.cos(np.maximum(angle - radius - SLACK, 0)) * scale[:, None] + SLACK * (scale[:, None] + 1))


def _beside(big: DataFrame, small: DataFrame, per: int) -> DataFrame:
    """Rows of small (own = 0) in front of those of big (own = 1) with the same region, for runs of about per rows of big.

    Rows of a region are dealt by the hash of key to as many tasks as it has runs; each gets the region's rows of small.
    """
    n = big.groupBy("region").agg(F.ceil(F.count("*") / per).cast("int").alias("runs"))
    big = big.join(n, "region").withColumn("run", F.pmod(F.xxhash64("key", F.lit(11)), F.col("runs")).cast("int")).withColumn("own", F.lit(1))
    small = small.join(n, "region").withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).withColumn("own", F.lit(0))
    both = small.drop("runs").unionByName(big.drop("runs"), allowMissingColumns=True)
    order = [c for c in ("page", "key") if c in both.columns]
    return both.repartition("region", "run").sortWithinPartitions("region", "run", "own", *order)


def _runs(batches, keys: tuple[str, ...] = ("region", "run", "own")):
    """(keys' values, batch) for pieces of batches with equal keys."""
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.concatenate(([0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1, [b.num_rows]))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield tuple(c[i] for c in cols), b.slice(i, j - i)


def _divided(objects: DataFrame, seeds: DataFrame, sphere: Sphere) -> DataFrame:
    """objects with the region of the nearest of their region's seeds (region, page: the seed's number, v)."""
    names = ["region", "key", "least", "v"]

    def run(batches):
        have, at, lifted = None, None, None
        for (region, part, own), b in _runs(batches):
            if not own:
                lifted = sphere.lifted(_matrix(b.column("v"), sphere.width)) if have != (region, part) else np.concatenate((lifted, sphere.lifted(_matrix(b.column("v"), sphere.width))))
                at = b.column("page").to_numpy() if have != (region, part) else np.concatenate((at, b.column("page").to_numpy()))
                have = region, part
                continue
            nearest = at[(sphere.lifted(_matrix(b.column("v"), sphere.width)) @ lifted.T).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(region * (FANOUT + 1) + 1 + nearest), b.column("key"), b.column("least"), b.column("v")], names)

    return _beside(objects, seeds, 1 << 16).mapInArrow(run, "region long, key binary, least long, v array<long>")


def _regions(objects: DataFrame, sphere: Sphere, size: int) -> DataFrame:
    """objects (key, least, v) with the region that each belongs to; a region is named by the way down to it."""
    now = kept(objects.withColumn("region", F.lit(0).cast("long")), "level")
    done = None
    for level in range(DEEPEST + 1):
        n = now.groupBy("region").count()
        large = n.where(f"count > {size}").withColumn("k", F.least(F.lit(FANOUT), F.ceil(2 * F.col("count") / size)))
        ready = now.join(n.where(f"count <= {size}"), "region", "left_semi")
        if large.isEmpty():
            return now if done is None else done.unionByName(now)
        rest = now.join(large.drop("count"), "region")
        if level == DEEPEST:
            rest = rest.withColumn("region", F.col("region") * (FANOUT + 1) + 1 + F.pmod(F.xxhash64("key"), F.col("k"))).drop("k")
            return ready.unionByName(rest) if done is None else done.unionByName(ready).unionByName(rest)
        w = Window.partitionBy("region").orderBy(F.xxhash64("key"), "key")
        seeds = rest.withColumn("page", F.row_number().over(w) - 1).where(f"page < {FANOUT}").where("page < k").select("region", F.col("page").cast("long").alias("page"), "v")
        done = ready if done is None else done.unionByName(ready)
        now = kept(_divided(rest.drop("k"), kept(seeds, "seeds"), sphere), "level")
    raise AssertionError


_PAGES = "region long, page int, pivot array<long>, radius double, least long, keys array<binary>, ids array<long>, v array<long>, apart array<double>"


def _pages(objects: DataFrame, sphere: Sphere, page: int) -> DataFrame:
    """The pages of each region; page -1 is the region's own routing object (the object nearest to its mean) with its covering radius."""

    def cut(region: int, keys: list, ids: np.ndarray, x: np.ndarray):
        p = sphere.lifted(x)
        mid = p.mean(axis=0)
        centre = int((p @ mid).argmax())
        rows = [(region, -1, x[centre], float(_angles(p, p[[centre]]).max()), int(ids.min()), np.zeros(0, np.int64), None)]
        seeds = np.linspace(0, len(x) - 1, max(1, -(-len(x) // page))).astype(np.int64)  # objects come by hash
        to = (p @ p[seeds].T).argmax(axis=1)
        order = np.argsort(to, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
            for at in np.array_split(at, -(-len(at) // (4 * page))):
                mid = int((p[at] @ p[at].mean(axis=0)).argmax())
                apart = _angles(p[at], p[at[[mid]]])[:, 0]
                near = np.argsort(apart, kind="stable")
                rows.append((region, len(rows) - 1, x[at[mid]], float(apart.max()), int(ids[at].min()), at[near], apart[near]))
        for r, n, pivot, radius, least, at, apart in rows:
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([n], pa.int32()), pa.array([pivot.tolist()], pa.list_(pa.int64())), pa.array([radius]), pa.array([least], pa.int64()), pa.array([[keys[i] for i in at]], pa.list_(pa.binary())), pa.array([ids[at].tolist()], pa.list_(pa.int64())), pa.array([x[at].ravel().tolist()], pa.list_(pa.int64())), pa.array([[] if apart is None else apart.tolist()], pa.list_(pa.float64()))], [c.split(" ")[0] for c in _PAGES.split(", ")])

    def run(batches):
        have, held = None, []
        for (region,), b in _runs(batches, ("region",)):
            if held and region != have:
                yield from cut(have, *_together(held))
                held = []
            have = region
            held.append(b)
        if held:
            yield from cut(have, *_together(held))

    def _together(held):
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return t.column("key").to_pylist(), t.column("least").to_numpy(), _matrix(t.column("v"), sphere.width)

    return objects.select("region", "key", "least", "v").repartition("region").sortWithinPartitions("region", F.xxhash64("key")).mapInArrow(run, _PAGES)


class Best:
    """Each query's best objects so far: the k with the largest scores, equal ones by the least id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score = np.full((queries, k), LOWEST)
        self.least = np.full((queries, k), np.iinfo(np.int64).max)
        self.at = np.full((queries, k), -1)

    def to_beat(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def add(self, rows: np.ndarray, score: np.ndarray, least: np.ndarray, at: np.ndarray) -> None:
        """score: rows by objects; objects that can't enter are masked by the least long."""
        some = (score >= self.to_beat(rows)[:, None]).any(axis=0)
        if not some.any():
            return
        score, least, at = score[:, some], least[some], at[some]
        s = np.concatenate((self.score[rows], score), axis=1)
        i = np.concatenate((self.least[rows], np.broadcast_to(least, score.shape)), axis=1)
        a = np.concatenate((self.at[rows], np.broadcast_to(at, score.shape)), axis=1)
        best = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.least[rows], self.at[rows] = (np.take_along_axis(x, best, axis=1) for x in (s, i, a))


class Region:
    """A region's pages in a task, and the search in them."""

    def __init__(self, sphere: Sphere, pages: list[tuple]):
        self.sphere = sphere
        self.pivots = sphere.lifted(np.array([p[0] for p in pages]).reshape(len(pages), sphere.width))
        self.radius = np.array([p[1] for p in pages])
        self.least = np.array([p[2] for p in pages])
        self.keys = [k for p in pages for k in p[3]]
        self.ids = [np.array(p[4]) for p in pages]
        self.x = [np.array(p[5]).reshape(-1, sphere.width) for p in pages]
        self.doubles = [x.astype(np.float64) if sphere.exact else x for x in self.x]
        self.apart = [np.array(p[6]) for p in pages]
        self.first = np.cumsum([0, *(len(i) for i in self.ids)])

    def search(self, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[Best, np.ndarray]:
        """The k best objects of each query that reach floor, and how many inner products each query took."""
        sphere, best, taken = self.sphere, Best(len(q), k, floor), np.zeros(len(q), np.int64)
        turned, scale = sphere.turned(q), sphere.scale(q)
        angle = _angles(turned, self.pivots)
        promise = _promise(angle, self.radius, scale)
        order = np.argsort(-promise, axis=1, kind="stable")
        going = np.arange(len(q))
        work = q.astype(np.float64) if sphere.exact else q
        for step in range(len(self.radius)):
            page = order[going, step]
            beat = best.to_beat(going)
            p = promise[going, page]
            going, page, p, beat = (x[p >= beat] for x in (going, page, p, beat))
            if not len(going):
                break
            on = (p > beat) | (self.least[page] < best.least[going, -1])  # a tie can only help with a smaller id
            rows, page = going[on], page[on]
            by = np.argsort(page, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(page[by])) + 1) if len(by) else []:
                r, n = rows[group], int(page[group[0]])
                beat = best.to_beat(r)
                # what the stored distances leave: an object can't be nearer than the difference of both
                least_angle = np.abs(angle[r, n][:, None] - self.apart[n][None])
                may = np.cos(np.maximum(least_angle - SLACK, 0)) * scale[r][:, None] + SLACK * (scale[r][:, None] + 1) >= beat[:, None]
                some = may.any(axis=0)
                taken[r] += int(some.sum())
                if not some.any():
                    continue
                if sphere.exact:
                    score = (work[r] @ self.doubles[n][some].T).astype(np.int64)
                else:
                    score = sphere.products(work[r], self.x[n][some])
                best.add(r, score, self.ids[n][some], np.flatnonzero(some) + self.first[n])
        return best, taken


def _searched(pages: DataFrame, frontier: DataFrame, sphere: Sphere, k: int) -> DataFrame:
    """query (its key), object (key), least, score, n_products: the best objects of each query's regions (query key, v, floor, region)."""
    names = ["query", "object", "least", "score", "n_products"]

    def run(batches):
        have, held, region = None, [], None
        for (r, part, own), b in _runs(batches):
            if not own:
                if have != (r, part):
                    have, held, region = (r, part), [], None
                held += zip(*(b.column(c).to_pylist() for c in ("pivot", "radius", "least", "keys", "ids", "v", "apart")), strict=True)
                continue
            if region is None:
                region, held = Region(sphere, held), []
            for i in range(0, b.num_rows, QUERIES):
                some = b.slice(i, QUERIES)
                best, taken = region.search(_matrix(some.column("v"), sphere.width), k, some.column("floor").to_numpy())
                q, j = np.nonzero((best.at >= 0) & (best.score >= best.floor[:, None]))
                keys = some.column("key").take(pa.array(q))
                none = np.setdiff1d(np.arange(some.num_rows), q)
                yield pa.RecordBatch.from_arrays([keys, pa.array([region.keys[x] for x in best.at[q, j]], pa.binary()), pa.array(best.least[q, j]), pa.array(best.score[q, j]), pa.array(np.where(np.concatenate(([True], q[1:] != q[:-1]))[: len(q)], taken[q], 0))], names)
                if len(none):
                    yield pa.RecordBatch.from_arrays([some.column("key").take(pa.array(none)), pa.nulls(len(none), pa.binary()), pa.nulls(len(none), pa.int64()), pa.nulls(len(none), pa.int64()), pa.array(taken[none])], names)

    small = pages.where("page >= 0").select("region", "page", "pivot", "radius", "least", "keys", "ids", "v", "apart")
    # a region's pages go to a task for each REGION of its queries: neither side is sent much more often than the other
    return _beside(frontier.select("region", "key", "v", "floor"), small, REGION).mapInArrow(run, "query binary, object binary, least long, score long, n_products long")


def _routed(queries: DataFrame, regions: DataFrame, sphere: Sphere, first: bool) -> DataFrame:
    """key, v, floor, region for the regions (key: all) that each query goes to: the one that promises most, or all others that may reach its floor."""
    names = ["key", "v", "floor", "region"]

    def run(batches):
        have, held = None, []
        for (r, part, own), b in _runs(batches):
            if not own:
                if have != (r, part):
                    have, held = (r, part), []
                held.append(b)
                continue
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            name, radius = t.column("name").to_numpy(), t.column("radius").to_numpy()
            pivots = sphere.lifted(_matrix(t.column("pivot"), sphere.width))
            for i in range(0, b.num_rows, QUERIES):
                some = b.slice(i, QUERIES)
                q = _matrix(some.column("v"), sphere.width)
                promise = _promise(_angles(sphere.turned(q), pivots), radius, sphere.scale(q))
                if first:
                    at, to = np.arange(len(q)), promise.argmax(axis=1)
                else:
                    promise[name[None] == some.column("seen").to_numpy()[:, None]] = -np.inf
                    at, to = np.nonzero(promise >= some.column("floor").to_numpy()[:, None])
                take = some.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([take.column("key"), take.column("v"), take.column("floor"), pa.array(name[to])], names)

    rows = queries.withColumn("region", F.lit(0).cast("long"))
    per = max(QUERIES, regions.count())  # as for the search: all routing objects go to a task for each so many queries
    return _beside(rows, regions.withColumn("region", F.lit(0).cast("long")), per).mapInArrow(run, "key binary, v array<long>, floor long, region long")


def top_products(vectors: DataFrame, asked: Column, k: int = 20, region: int = REGION, page: int = PAGE) -> DataFrame:
    """query_id, rank, vec_id, score, n_products: for each row with asked, the k other rows with the largest inner product, equal ones by vec_id.

    vectors: vec_id and v, an array of longs (see whole()). Rows without vec_id or v take no part, as query or candidate;
    shorter vectors end in zeros. Repeated rows are rows each: only the query's own one is left out. Fewer than k rows
    are all returned; an empty table gives none; further columns aren't read. A product beyond a long is an error.
    n_products: inner products that the query's vector took (a sum over its equal rows).

    Memory: a task holds one region's pages, or a region's seeds, and the batch of queries or objects that it looks at. The routing
    objects of all regions (one for some 8,000 vectors) are held by the tasks that route.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).select("vec_id", "v", F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = rows.withColumn("key", F.unhex(F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256))).withColumn("row", F.monotonically_increasing_id())
    rows = kept(rows, "vectors")
    square = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x.cast("decimal(19,0)") * x).cast("decimal(38,0)"))
    width, most = rows.agg(F.max(F.size("v")), F.max(square)).first()
    sphere = Sphere(width or 0, int(most or 0))
    objects = rows.groupBy("key").agg(F.min("vec_id").alias("least"), F.first("v").alias("v"))
    tree = kept(_pages(_regions(objects, sphere, region), sphere, page), "pages")
    regions = tree.where("page = -1").select(F.col("region").alias("name"), F.lit(0).alias("page"), "pivot", "radius")
    queries = kept(rows.where("asked").groupBy("key").agg(F.first("v").alias("v")).withColumn("floor", F.lit(LOWEST).cast("long")), "queries")
    near = kept(_routed(queries, regions, sphere, first=True), "near")
    found = kept(_searched(tree, near, sphere, k + 1), "found")
    # the last of k + 1 objects of the first region is the score to beat elsewhere; a query with fewer has none
    beat = found.groupBy(F.col("query").alias("key")).agg(F.when(F.count("object") > k, F.min("score")).otherwise(LOWEST).cast("long").alias("floor"))
    again = near.select("key", "v", F.col("region").alias("seen")).join(beat, "key")
    more = _searched(tree, _routed(again, regions, sphere, first=False), sphere, k + 1)
    both = kept(found.unionByName(more), "candidates")
    n = both.groupBy("query").agg(F.sum("n_products").alias("n_products"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least", "object")
    objects = both.where("object is not null").withColumn("r", F.row_number().over(best)).where(f"r <= {k + 1}")
    # of equal vectors only the k + 1 least ids can be among the best
    copies = Window.partitionBy("key").orderBy("vec_id", "row")
    members = rows.withColumn("c", F.row_number().over(copies)).where(f"c <= {k + 1}").select(F.col("key").alias("object"), "vec_id", "row")
    lists = objects.join(members, "object").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))).where(f"r <= {k + 1}")
    lists = lists.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "row", "score"))).alias("best")).join(n, "query")
    drop(queries)
    asks = rows.where("asked").select(F.col("key").alias("query"), F.col("vec_id").alias("query_id"), F.col("row").alias("self"))
    out = asks.join(lists, "query").select("query_id", "n_products", F.slice(F.filter("best", lambda x: x["row"] != F.col("self")), 1, k).alias("best"))
    return out.select("query_id", "n_products", F.posexplode("best").alias("i", "b")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"), "n_products")

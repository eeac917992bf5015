"""Clustering of unit vectors by cosine distance: DBSCAN on the neighbour graph, complete linkage, people."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.operators.graph import components
from lumora.sources.shared import drop, kept, small_batches

#: Vectors of a strip: two strips' distances are one matrix product. A block has as many at least and WIDE bytes at most, and is about a PARTS-th of its
#: by's vectors: what is shuffled is a block for each one that it meets, so wide blocks ship less, and the smallest still keep all tasks busy.
BLOCK, WIDE, PARTS = 1024, 16 << 20, 16
#: Vectors of a connected part that one task links alone; its distances take 8 bytes a pair.
PART = 2048
#: Pivots for each by, the vectors that they are chosen from, and those of all by: beyond that blocks have no pivots, and all of one by are compared.
PIVOTS, DRAWN, ALL_DRAWN = 32, 512, 16_384
#: Bins of the angle to a pivot, by which its vectors are dealt to blocks.
BINS = 256
#: Pairs of clusters for each one that a level of a linkage aims at, and those that no level is made for and one task merges; the clusters, and vectors of each, that levels are chosen from.
DEGREE, FEW, SAMPLED, MEMBERS = 8, 1 << 16, 2048, 8
#: Slack of angles in double precision.
SLACK = 1e-7


class Pivots:
    """Some vectors of each by, far from one another: vectors lie in blocks around their nearest one, so that far blocks need not meet."""

    def __init__(self, vectors: DataFrame, by: str):
        w = Window.partitionBy(by).orderBy(F.xxhash64("id"), "id")
        some = vectors.select(by, "v", F.row_number().over(w).alias("r")).where(f"r <= {DRAWN}").limit(ALL_DRAWN + 1).collect()
        self.by, self.kind, self.of = by, dict(vectors.dtypes)[by], {}
        if len(some) <= ALL_DRAWN:
            for value in {r[0] for r in some}:
                x = _unit(np.array([r[1] for r in sorted(some, key=lambda r: r.r) if r[0] == value], float))
                self.of[value] = _far_apart(x[(x != 0).any(axis=1)])
        self.dim = max((len(r[1]) for r in some if r[1] is not None), default=1)
        rows, self.apart = [], {}
        for value, x in self.of.items():
            angle = self.apart[value] = np.arccos(np.clip(x @ x.T, -1, 1)) if len(x) else np.zeros((0, 0))
            rows += [(value, i, j, float(angle[i, j])) for i in range(len(x)) for j in range(len(x))]
            rows += [(value, i, -1, 0.0) for i in range(len(x))] + [(value, -1, i, 0.0) for i in range(len(x))]
            rows.append((value, -1, -1, 0.0))
        self.pairs = vectors.sparkSession.createDataFrame(rows, f"{by} {self.kind}, pivot int, pivot_b int, apart double")

    def placed(self, vectors: DataFrame) -> DataFrame:
        """id, by, v (unit), pivot (-1: none, as for vectors without direction), angle."""
        by, of = self.by, self.of

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                x = _unit(_matrix(b.column("v")))
                pivot, angle = np.full(len(x), -1, np.int32), np.zeros(len(x))
                values = b.column(by).to_pylist()
                for value in set(values):
                    on = np.array([u == value for u in values]) & (x != 0).any(axis=1)
                    if len(of.get(value, ())) and on.any():
                        near = x[on] @ of[value].T
                        pivot[on], angle[on] = near.argmax(axis=1), np.arccos(np.clip(near.max(axis=1), -1, 1))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column(by), pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel()), pa.array(pivot), pa.array(angle)], ["id", by, "v", "pivot", "angle"])

        return vectors.select("id", by, "v").mapInArrow(run, f"id long, {by} {self.kind}, v array<double>, pivot int, angle double")


def _far_apart(x: np.ndarray) -> np.ndarray:
    """Up to PIVOTS rows of x, each the farthest from those before it."""
    chosen, near = [], np.full(len(x), -1.0)
    while len(chosen) < min(PIVOTS, len(x)):
        chosen.append(int(near.argmin()) if chosen else 0)
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def _matrix(v: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, without a Python object for each number."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    if v.null_count or len(set(v.value_lengths().to_pylist())) != 1:
        raise ValueError("vectors must have one length")
    return v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _blocks(vectors: DataFrame, by: str, pivots: Pivots | None = None, block: int | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """by, block, ids, m: the unit vectors of each block as one matrix; parts: where each pivot's vectors start in it, with the least and largest angle to it (lo, hi).

    Vectors are dealt to blocks in the order of their pivots and their angles to them, by the counts of BINS bins; a bin of more than a block is dealt by hash. A
    block's size is the given one, else by the number of vectors. With clusters (id, cluster, size; a cluster is named by one of its ids) all vectors of a cluster lie side
    by side where its namesake is, those of one of more than BLOCK are dealt out; ids are then the clusters', and sizes tells how many vectors each has.
    """
    pivots = pivots or Pivots(vectors, by)
    placed = kept(pivots.placed(vectors), "placed")
    rows = placed.withColumn("bin", F.floor(F.col("angle") / math.pi * BINS).cast("int"))
    whole = F.col("id")
    if clusters is not None:
        of = rows.join(clusters, "id")
        heads = of.where("id = cluster").select("cluster", "pivot", "bin")
        rows, whole = of.drop("pivot", "bin").join(heads, "cluster"), F.when(F.col("size") <= BLOCK, F.col("cluster")).otherwise(F.col("id"))
    bins = rows.groupBy(by, "pivot", "bin").agg(F.count("*").alias("n"))
    share = F.ceil(F.sum("n").over(Window.partitionBy(by)) / PARTS)
    bins = bins.withColumn("size", F.lit(block) if block else F.greatest(F.lit(BLOCK), F.least(F.lit(WIDE // (8 * pivots.dim)), share)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("pivot", "bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select(by, "pivot", "bin", F.floor(before / F.col("size")).alias("place"), F.ceil(F.col("n") / F.col("size")).alias("salts"))
    rows = rows.join(bins, [by, "pivot", "bin"]).withColumn("salt", F.pmod(F.xxhash64(whole), F.col("salts")))
    near, joint = pivots.of, clusters is not None
    kind = f"{by} {dict(vectors.dtypes)[by]}"

    def packed(t: pa.Table) -> pa.Table:
        pivot, angle, m, names = t.column("pivot").to_numpy(), t.column("angle").to_numpy(), _matrix(t.column("v")), t.column("id" if not joint else "cluster").to_numpy()
        if joint and len(near.get(t.column(by)[0].as_py(), ())):  # the angle to the pivot of the cluster's namesake
            angle = np.where(pivot >= 0, np.arccos(np.clip(np.einsum("ij,ij->i", m, near[t.column(by)[0].as_py()][pivot]), -1, 1)), angle)
        order = np.lexsort((angle if not joint else names, pivot))
        pivot, angle = pivot[order], angle[order]
        start = np.flatnonzero(np.concatenate(([True], pivot[1:] != pivot[:-1])))
        stop = np.append(start[1:], len(pivot))
        parts = [{"pivot": int(pivot[a]), "start": int(a), "lo": float(angle[a:z].min()) if pivot[a] >= 0 else 0.0, "hi": float(angle[a:z].max()) if pivot[a] >= 0 else math.pi} for a, z in zip(start, stop, strict=True)]
        listed = lambda x: pa.ListArray.from_arrays(np.array([0, len(order)], np.int32), x[order])
        kinds = pa.list_(pa.struct([("pivot", pa.int32()), ("start", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64())]))
        out = {by: t.column(by)[:1], "ids": listed(names), "m": pa.array([m[order].tobytes()], pa.binary()), "parts": pa.array([parts], kinds)}
        return pa.table(out if not joint else out | {"sizes": listed(t.column("size").to_numpy())})

    made = rows.groupBy(by, "place", "salt").applyInArrow(packed, f"{kind}, ids array<long>, m binary, parts array<struct<pivot: int, start: int, lo: double, hi: double>>" + (", sizes array<long>" if joint else ""))
    return made.withColumn("block", F.monotonically_increasing_id())


def _least_angle(apart, lo, hi, lo_b, hi_b, largest):
    """No two vectors with these angles to their pivots are nearer: the triangle inequality, with both pivots' angle."""
    return largest(apart - hi - hi_b, lo - apart - hi_b, lo_b - apart - hi)


def _widest(eps: float) -> float:
    return math.acos(max(-1.0, 1 - eps)) + SLACK


def _meeting_parts(blocks: DataFrame, by: str, pivots: Pivots, eps: float, others: DataFrame | None = None) -> DataFrame:
    """by, p, q, i, j: the parts of two blocks (p <= q, or each block with others) that may hold vectors within eps."""
    part = lambda df, end, name, at: df.select(by, F.col("block").alias(name), F.posexplode("parts").alias(at, "part")).select(by, name, at, *(F.col(f"part.{c}").alias(c + end) for c in ("pivot", "lo", "hi")))
    a, b = part(blocks, "", "p", "i"), part(blocks if others is None else others, "_b", "q", "j")
    least = _least_angle(*(F.col(c) for c in ("apart", "lo", "hi", "lo_b", "hi_b")), F.greatest)
    pairs = a.join(pivots.pairs, [by, "pivot"]).join(b, [by, "pivot_b"]).where(least <= _widest(eps))
    return (pairs.where("p <= q") if others is None else pairs).select(by, "p", "q", "i", "j")


def _pairs_of_blocks(blocks: DataFrame, by: str, pivots: Pivots, eps: float, others: DataFrame | None = None) -> DataFrame:
    """Pairs of blocks that may hold vectors within eps, each with both matrices: dealt to all tasks."""
    b = blocks if others is None else others
    side = [c for c in ("ids", "m", "parts", "sizes") if c in blocks.columns]
    left = blocks.select(by, F.col("block").alias("p"), *(F.col(c).alias(f"a_{c}") for c in side))
    extra = [c for c in b.columns if c not in (by, "block", *side)]
    right = b.select(by, F.col("block").alias("q"), *(F.col(c).alias(f"b_{c}") for c in side), *extra)
    meeting = _meeting_parts(blocks, by, pivots, eps, others).select(by, "p", "q").distinct()
    return meeting.join(left, [by, "p"]).join(right, [by, "q"])


def compared_share(vectors: DataFrame, by: str, eps: float, block: int = BLOCK) -> float:
    """The share of the pairs of blocks' parts of one by that are compared at eps."""
    pivots = Pivots(vectors, by)
    blocks = kept(_blocks(vectors, by, pivots, block), "blocks")
    n = blocks.groupBy(by).agg(F.sum(F.size("parts")).alias("n")).agg(F.sum(F.col("n") * (F.col("n") + 1) / 2)).first()[0] or 1
    share = _meeting_parts(blocks, by, pivots, eps).where("p < q or i <= j").count() / n
    drop(blocks)
    return share


def _rows(batches):
    """Pairs of blocks one by one, so that one pair's matrices are in memory beside the batch."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _strips(parts: list[dict] | None, n: int, clusters: np.ndarray | None = None):
    """start, stop, part of strips of up to BLOCK vectors, each of one part. Of clusters none is cut that has no more."""
    parts = parts or [{"start": 0}]
    for part, stop in zip(parts, [*(p["start"] for p in parts[1:]), n], strict=True):
        s = part["start"]
        while s < stop:
            end = min(s + BLOCK, stop)
            if clusters is not None and end < stop and clusters[end] == clusters[end - 1]:
                first = s + int(np.searchsorted(clusters[s:end], clusters[end]))
                end = first if first > s else end
            yield s, end, part
            s = end


def _near(row: dict, eps: float, apart: np.ndarray | None = None):
    """Strip by strip: the places in both blocks of the vectors within eps, and their distances. apart: the angles of the pivots, which rule out strips."""
    x, y = (np.frombuffer(row[f"{s}_m"]).reshape(len(row[f"{s}_ids"]), -1) for s in "ab")
    clusters = [np.array(row[f"{s}_ids"]) if f"{s}_sizes" in row else None for s in "ab"]
    for s, s_end, a in _strips(row.get("a_parts"), len(x), clusters[0]):
        for t, t_end, b in _strips(row.get("b_parts"), len(y), clusters[1]):
            if apart is not None and a["pivot"] >= 0 and b["pivot"] >= 0 and _least_angle(apart[a["pivot"], b["pivot"]], a["lo"], a["hi"], b["lo"], b["hi"], max) > _widest(eps):
                continue
            d = 1 - x[s:s_end] @ y[t:t_end].T
            i, j = np.nonzero(d <= eps + 1e-12)
            yield i + s, j + t, d[i, j]


def neighbour_counts(blocks: DataFrame, by: str, pivots: Pivots, eps: float) -> DataFrame:
    """id, n: vectors within eps, itself too. Each pair of blocks gives one count for each of its ids."""

    apart = pivots.apart

    def run(batches):
        for row in _rows(batches):
            a, b = np.array(row["a_ids"]), np.array(row["b_ids"])
            n, m = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
            for i, j, _ in _near(row, eps, apart.get(row[by])):
                n += np.bincount(i, minlength=len(a))
                m += np.bincount(j, minlength=len(b))
            ids, n = ([a], [n]) if row["p"] == row["q"] else ([a, b], [n, m])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(n))], ["id", "n"])

    return _pairs_of_blocks(blocks, by, pivots, eps).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _joined(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Those of the pairs (x, y) that join trees of parent, which they then do: in rounds, as arrays, each root that has a smaller one beside it goes below that."""
    out = []
    while True:
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]
        new = parent[x] != parent[y]
        if not new.any():
            return out
        x, y = x[new], y[new]
        root, first = np.unique(np.maximum(parent[x], parent[y]), return_index=True)
        parent[root] = np.minimum(parent[x[first]], parent[y[first]])
        out.append((x[first], y[first]))


def spanning_edges(blocks: DataFrame, by: str, pivots: Pivots, eps: float) -> DataFrame:
    """a, b: edges within eps that connect what is connected, at most as many for a pair of blocks as it has ids."""

    apart = pivots.apart

    def run(batches):
        for row in _rows(batches):
            a, b = np.array(row["a_ids"]), np.array(row["b_ids"])
            ids, place = np.unique(np.concatenate((a, b)), return_inverse=True)
            at, parent, out = (place[: len(a)], place[len(a) :]), np.arange(len(ids)), []
            for i, j, _ in _near(row, eps, apart.get(row[by])):
                out += _joined(parent, at[0][i], at[1][j])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(ids[np.concatenate(c)]) for c in zip(*out, strict=True)], ["a", "b"])

    return _pairs_of_blocks(blocks, by, pivots, eps).mapInArrow(run, "a long, b long")


def dbscan(vectors: DataFrame, eps: float, least: int, by: str = "embedder") -> DataFrame:
    """id, by, cluster: cosine DBSCAN within each by; noise is -1, clusters are named by their smallest core id.

    A border vector goes to the smallest-named cluster among its core neighbours. Blocks of vectors around pivots are
    compared as matrix products spread over the tasks, those whose angles allow it; what leaves a task is linear in its blocks.
    """
    pivots = Pivots(vectors, by)
    blocks = kept(_blocks(vectors, by, pivots), "blocks")
    counts = neighbour_counts(blocks, by, pivots, eps)
    with small_batches(vectors.sparkSession):
        near = kept(counts.where(F.col("n") >= least).select("id"), "near")
    core = kept(vectors.join(near, "id", "left_semi").select("id", by, "v"), "core")
    core_blocks = kept(_blocks(core, by, pivots), "blocks")
    with small_batches(vectors.sparkSession):
        groups = components(core.select("id"), spanning_edges(core_blocks, by, pivots, eps))
    rest = vectors.select("id", by, "v").join(core.select("id"), "id", "left_anti")
    rest_blocks = kept(_blocks(rest, by, pivots), "blocks")
    named = kept(groups, "groups")
    apart = pivots.apart

    def touch(batches):
        for row in _rows(batches):
            a, c = np.array(row["a_ids"]), np.array(row["clusters"])
            best = np.full(len(a), np.iinfo(np.int64).max)
            for i, j, _ in _near(row, eps, apart.get(row[by])):
                np.minimum.at(best, i, c[j])
            on = best < np.iinfo(np.int64).max
            yield pa.RecordBatch.from_arrays([pa.array(a[on]), pa.array(best[on])], ["id", "cluster"])

    with_names = core_blocks.select(by, F.col("block").alias("q"), F.posexplode("ids").alias("pos", "id")).join(named, "id").groupBy(by, "q").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "component"))), lambda s: s["component"]).alias("clusters"))
    b = core_blocks.join(with_names.withColumnRenamed("q", "block"), [by, "block"])
    border = _pairs_of_blocks(rest_blocks, by, pivots, eps, b).mapInArrow(touch, "id long, cluster long").groupBy("id").agg(F.min("cluster").alias("cluster"))
    with small_batches(vectors.sparkSession):
        border = kept(border, "border")
    found = named.select("id", F.col("component").alias("cluster")).union(border)
    return vectors.select("id", by).join(found, "id", "left").select("id", by, F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def _complete(x: np.ndarray, cut: float) -> np.ndarray:
    """Complete linkage by nearest-neighbour chains; labels of the flat clusters at distance <= cut."""
    n = len(x)
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    alive, parent, merges, chain = np.ones(n, bool), np.arange(n), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            i = chain[-1]
            row = np.where(alive, d[i], np.inf)
            j = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        merges.append((d[i, j], i, j))
        new = np.maximum(d[i], d[j])
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        alive[j] = False
    for h, i, j in merges:
        if h <= cut + 1e-12:
            parent[j] = i
    out = np.arange(n)
    for v in range(n):
        r = v
        while parent[r] != r:
            r = parent[r]
        out[v] = r
    return out


def _linkage_edges(blocks: DataFrame, by: str, pivots: Pivots, cut: float) -> DataFrame:
    """a, b (a < b), d: the pairs of vectors within cut."""

    apart = pivots.apart

    def run(batches):
        for row in _rows(batches):
            ids, others = np.array(row["a_ids"]), np.array(row["b_ids"])
            for i, j, d in _near(row, cut, apart.get(row[by])):
                x, y = ids[i], others[j]
                keep = x < y if row["p"] == row["q"] else np.ones(len(x), bool)
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[keep]), pa.array(np.maximum(x, y)[keep]), pa.array(d[keep])], ["a", "b", "d"])

    return _pairs_of_blocks(blocks, by, pivots, cut).mapInArrow(run, "a long, b long, d double")


def _cluster_edges(blocks: DataFrame, by: str, pivots: Pivots, cut: float) -> DataFrame:
    """a, b (a < b), d, n, want: the pairs of clusters whose vectors are all within cut (n = want), and parts of the pairs of a cluster of more than BLOCK."""

    apart = pivots.apart

    def run(batches):
        for row in _rows(batches):
            ids, others, size, size_b = (np.array(row[c]) for c in ("a_ids", "b_ids", "a_sizes", "b_sizes"))
            for i, j, d in _near(row, cut, apart.get(row[by])):
                keep = ids[i] < others[j] if row["p"] == row["q"] else ids[i] != others[j]
                i, j, d = i[keep], j[keep], d[keep]
                order = np.lexsort((others[j], ids[i]))
                i, j, d = i[order], j[order], d[order]
                x, y = ids[i], others[j]
                first = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(x) else np.zeros(0, int)
                if not len(first):
                    continue
                n, far = np.diff(np.append(first, len(x))), np.maximum.reduceat(d, first)
                i, j, x, y = i[first], j[first], x[first], y[first]
                want = size[i] * size_b[j]
                on = (n == want) | (np.maximum(size[i], size_b[j]) > BLOCK)
                if on.any():
                    yield pa.RecordBatch.from_arrays([pa.array(c[on]) for c in (np.minimum(x, y), np.maximum(x, y), far, n, want)], ["a", "b", "d", "n", "want"])

    return _pairs_of_blocks(blocks, by, pivots, cut).mapInArrow(run, "a long, b long, d double, n long, want long")


def _level(vectors: DataFrame, by: str, clusters: DataFrame | None, low: float, cut: float) -> float:
    """A cut above low, at most the given one, within which there are some DEGREE pairs for each cluster: by the distances in a sample of clusters. It decides on the work only, never on a result."""
    rows = vectors.withColumn("cluster", F.col("id")) if clusters is None else vectors.join(clusters, "id")
    total = rows.where("id = cluster").count()
    share = min(1.0, SAMPLED / max(1, total))
    some = rows.where(F.pmod(F.xxhash64("cluster", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("id"))).where(f"r <= {MEMBERS}").select(by, "cluster", "v").limit(2 * SAMPLED * MEMBERS).collect()
    found = []
    for value in {r[0] for r in some}:
        mine = sorted((r for r in some if r[0] == value), key=lambda r: r.cluster)
        x, names = _unit(np.array([r.v for r in mine], float)), np.array([r.cluster for r in mine])
        first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        for k, (s, e) in enumerate(zip(first, np.append(first[1:], len(x)), strict=True)):
            d = np.maximum.reduceat((1 - x[s:e] @ x.T).max(axis=0), first)[k + 1 :]
            found.append(d[(d <= cut) & (d > low)])
    d = np.sort(np.concatenate(found)) if found else np.zeros(0)
    most = int(max(FEW, DEGREE * total) * share**2)
    return cut if len(d) <= most else float(d[most])


def _linkage_in_rounds(vectors: DataFrame, cut: float, by: str, pivots: Pivots) -> DataFrame:
    """id, cluster: complete linkage of large parts. vectors: id, by, v (no two equal).

    The linkage goes up in levels of the cut, so that each has a bounded number of pairs for each cluster, not all pairs of vectors within
    the whole cut: the clusters at a lower cut are those that a higher one goes on with. At each level the vectors meet once, for the pairs of clusters
    that are wholly within it; rounds go on with those alone.
    """
    ids, links, clusters, low = kept(vectors.select("id"), "ids"), [], None, -1.0
    while True:
        top = _level(vectors, by, clusters, low, cut)
        blocks = kept(_blocks(vectors, by, pivots, None, clusters), "blocks")
        with small_batches(vectors.sparkSession):
            edges = kept((_linkage_edges if clusters is None else _cluster_edges)(blocks, by, pivots, top), "linkage_edges")
        if clusters is not None:
            parts = edges.where("n < want")
            if not parts.isEmpty():
                summed = parts.groupBy("a", "b", "want").agg(F.max("d").alias("d"), F.sum("n").alias("n")).where("n = want")
                old, edges = edges, kept(edges.where("n = want").select("a", "b", "d").union(summed.select("a", "b", "d")), "linkage_edges")
                drop(old)
        drop(blocks)
        links += _rounds(edges)
        if not links:
            found = ids.select("id", F.col("id").alias("cluster"))
        else:
            found = components(ids, reduce(DataFrame.union, links)).select("id", F.col("component").alias("cluster"))
        if top >= cut:
            return found
        clusters = kept(found.join(found.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").select("id", "cluster", "size"), "clusters")
        links, low = [kept(clusters.where("id != cluster").select(F.col("cluster").alias("a"), F.col("id").alias("b")), "links")], top


def _merged(batches):
    """a, b: what is merged among few pairs, nearest first."""
    t = pa.Table.from_batches([*batches], pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.float64())]))
    near, out = defaultdict(dict), []
    heap = list(zip(*(t.column(c).to_pylist() for c in ("d", "a", "b")), strict=True))
    for d, a, b in heap:
        near[a][b] = near[b][a] = d
    heapq.heapify(heap)
    while heap:
        d, a, b = heapq.heappop(heap)
        if near[a].get(b) != d:  # merged, or farther since
            continue
        out.append((a, b))
        mine, others = near.pop(a), near.pop(b)
        for c in (mine.keys() | others.keys()) - {a, b}:
            near[c].pop(a, None)
            near[c].pop(b, None)
            if c in mine and c in others:
                near[a][c] = near[c][a] = max(mine[c], others[c])
                heapq.heappush(heap, (near[a][c], min(a, c), max(a, c)))
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def _rounds(edges: DataFrame) -> list[DataFrame]:
    """a, b: what is merged, by rounds, until no pair of edges (a, b, d; written by kept(), deleted at the end) is left.

    Every round merges each pair of clusters that are one another's nearest, which gives the clusters of one merge at a time, as a merge
    brings no cluster nearer to a third. Clusters are a pair no longer once any two of their vectors are beyond the cut: two that merged keep a neighbour only
    if both had it. So pairs get fewer by the round, and those that no merge touches aren't shuffled. The last FEW are merged by one task.
    """
    merges, written = [], edges
    edges = edges.select("a", "b", "d")
    while True:
        if edges.count() <= FEW:
            merges.append(kept(edges.coalesce(1).mapInArrow(_merged, "a long, b long"), "merges"))
            drop(written)
            return merges
        pair = F.struct("d", F.xxhash64("a", "b").alias("tie"), "a", "b").alias("pair")
        nearest = edges.select(F.explode(F.array("a", "b")).alias("cluster"), pair).groupBy("cluster").agg(F.min("pair").alias("pair"))
        merge = kept(nearest.groupBy("pair").agg(F.count("*").alias("n")).where("n = 2").select(F.col("pair.a").alias("into"), F.col("pair.b").alias("gone")), "merges")
        if merge.isEmpty():
            drop(merge, written)
            return merges
        merges.append(merge.select(F.col("into").alias("a"), F.col("gone").alias("b")))
        # both clusters of a merge, with the name that they go on under
        half = merge.select(F.explode(F.array("into", "gone")).alias("cluster"), "into")
        left, right = (half.select(F.col("cluster").alias(c), F.col("into").alias(f"{c}_into")) for c in "ab")
        named = edges.join(left, "a", "left").join(right, "b", "left")
        same = named.where("a_into is null and b_into is null").select("a", "b", "d")
        moved = named.where("a_into is not null or b_into is not null").select(
            F.coalesce("a_into", "a").alias("x"), F.coalesce("b_into", "b").alias("y"), "d", (F.when(F.col("a_into").isNull(), 1).otherwise(2) * F.when(F.col("b_into").isNull(), 1).otherwise(2)).alias("want")
        ).where("x != y")
        moved = moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "want").agg(F.max("d").alias("d"), F.count("*").alias("n")).where("n = want").select("a", "b", "d")
        old, written = written, kept(same.unionByName(moved), "linkage_edges")
        drop(old)
        edges = written


def complete_linkage(vectors: DataFrame, cut: float, least: int, by: str = "embedder", part: int = PART) -> DataFrame:
    """id, by, cluster: complete-linkage clusters whose distances are all <= cut, named by their smallest id; smaller ones are -1.

    Such a cluster lies within a connected part of the graph of pairs within cut, so each part is clustered
    alone: parts of up to `part` vectors in one task each, larger ones in rounds over their pairs within cut. Equal vectors of
    a larger part count once. Among merges at the same distance either may go first, so only ties can differ.
    """
    pivots = Pivots(vectors, by)
    blocks = kept(_blocks(vectors, by, pivots), "blocks")
    with small_batches(vectors.sparkSession):
        parts = kept(components(vectors.select("id"), spanning_edges(blocks, by, pivots, cut)), "parts")
    large = kept(parts.groupBy("component").count().where(F.col("count") > part).select("component"), "large")
    rows = vectors.select("id", by, "v").join(parts, "id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        x = np.array(pdf["v"].tolist(), float)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        root = _complete(np.divide(x, n, out=np.zeros_like(x), where=n > 0), cut)
        return pdf[["id", by]].assign(cluster=pdf["id"].groupby(root).transform("min"))

    kind = f"{by} {dict(vectors.dtypes)[by]}"
    named = rows.join(large, "component", "left_anti").groupBy(by, "component").applyInPandas(run, f"id long, {kind}, cluster long")
    if not large.isEmpty():
        size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
        unit = F.when(size > 0, F.transform("v", lambda e: e / size)).otherwise(F.transform("v", lambda e: e.cast("double")))
        # a vector without direction is far from all, its copies too
        own = F.when(size == 0, F.col("id"))
        big = kept(rows.join(large, "component", "left_semi").select("id", by, "component", unit.alias("v"), own.alias("own")), "big")
        single = kept(big.groupBy("component", "v", "own").agg(F.min("id").alias("first")), "single")
        apart = single.join(vectors.select(F.col("id").alias("first"), by), "first").select(F.col("first").alias("id"), by, "v")
        linked = _linkage_in_rounds(apart, cut, by, pivots)
        same = (big.component == single.component) & (big.v == single.v) & big.own.eqNullSafe(single.own)
        members = big.join(single, same).select(big.id, big[by], "first").join(linked.withColumnRenamed("id", "first"), "first")
        named = named.union(members.select("id", by, "cluster"))
    named = kept(named, "named")
    sizes = named.groupBy("cluster").agg(F.count("*").alias("n"), F.min("id").alias("name"))
    return named.join(sizes, "cluster").select("id", by, F.when(F.col("n") >= least, F.col("name")).otherwise(F.lit(-1)).alias("cluster"))


def people(faces: DataFrame) -> DataFrame:
    """person, n, cover (smallest id) of assigned faces."""
    return faces.where("cluster >= 0").groupBy(F.col("cluster").alias("person")).agg(F.count("*").alias("n"), F.min("id").alias("cover"))

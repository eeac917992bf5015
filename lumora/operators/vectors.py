"""Vector analytics on array columns: cosine search, centroids, linear probes, zero-shot labels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def nearest(vectors: DataFrame, query: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """Exact cosine search: id, similarity of the k nearest to query's single row (v). Top k is taken in each partition first.

    allowed: ids to search; an empty one finds nothing.
    """
    rows = vectors if allowed is None else vectors.join(allowed.select("id"), "id", "left_semi")
    q = query.select(F.col("v").alias("q")).limit(1)
    return rows.crossJoin(F.broadcast(q)).select("id", cosine(F.col("v"), F.col("q")).alias("s")).orderBy(F.desc("s"), "id").limit(k).select("id", F.round("s", 6).alias("similarity"))


def similar_to(vectors: DataFrame, seed: int, k: int) -> DataFrame:
    """The k nearest to a stored vector, itself left out."""
    return nearest(vectors.where(F.col("id") != seed), vectors.where(F.col("id") == seed), k)


def centroid(vectors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of the vectors, then unit length: v (and by). Partial sums are made before the shuffle."""
    by = by or []
    p = vectors.select(*by, F.posexplode("v").alias("i", "x")).groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = p.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return mean.select(*by, normalised(F.col("v")).alias("v"))


def contrast(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Unit vector from the negatives' centroid to the positives'."""
    p, n = centroid(positive), centroid(negative).select(F.col("v").alias("w"))
    return p.crossJoin(F.broadcast(n)).select(normalised(F.zip_with("v", "w", lambda x, y: x - y)).alias("v"))


def scored(vectors: DataFrame, direction: DataFrame) -> DataFrame:
    """id, score: dot product of each unit vector with the direction's single row."""
    d = direction.select(F.col("v").alias("d")).limit(1)
    return vectors.crossJoin(F.broadcast(d)).select("id", F.round(dot(normalised(F.col("v")), F.col("d")), 6).alias("score"))


def preview(scores: DataFrame, threshold: float, sample: int, strict: bool = True) -> DataFrame:
    """n_over (all above the threshold, or at it too) beside each of the first sample ids."""
    hit = F.col("score") > threshold if strict else F.col("score") >= threshold
    over = scores.where(hit)
    n = over.agg(F.count("*").alias("n_over"))
    return over.orderBy(F.desc("score"), "id").limit(sample).crossJoin(F.broadcast(n))


#: Targets (labels, centroids, probes) that go to all tasks in one pass over the vectors; more take more passes.
PROBES_AT_ONCE = 10_000


def _matches(vectors: DataFrame, targets: DataFrame, name: str, k: int, least: float = -2.0) -> DataFrame:
    """id, name, score, rank: each vector's k best targets (name, v) by cosine above least, by name where equal.

    A batch is one matrix product with the pass's targets, so k rows a vector leave the tasks, not one for each target.
    """
    passes = max(1, -(-targets.count() // PROBES_AT_ONCE))
    schema = f"id long, {name} {dict(targets.dtypes)[name]}, score double"
    kind = to_arrow_type(targets.schema[name].dataType)
    out = None
    for i in range(passes):
        some = sorted(targets.where(F.pmod(F.xxhash64(name), F.lit(passes)) == i).select(name, "v").collect(), key=lambda r: r[0])
        if not some:
            continue
        sent = vectors.sparkSession.sparkContext.broadcast(([r[0] for r in some], np.array([r[1] for r in some], float)))

        def run(batches, sent=sent, kind=kind):
            names, q = sent.value
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for b in batches:
                for j in range(0, b.num_rows, 1024):
                    part = b.slice(j, 1024)
                    x = np.array(part.column("v").to_pylist(), float)
                    s = np.round((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ q.T, 6)
                    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    score = np.take_along_axis(s, top, axis=1)
                    row, col = np.nonzero(score > least)
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), pa.array([names[t] for t in top[row, col]], kind), pa.array(score[row, col])], ["id", name, "score"])

        part = vectors.select("id", "v").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], schema)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), name)).cast("long")).where(F.col("rank") <= k)


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, within: float) -> DataFrame:
    """id, cluster, distance: the nearest centroid (cluster, v) at cosine distance <= within; others have none."""
    distance = F.round(1 - F.col("score"), 6)
    return _matches(vectors, centroids, "cluster", 1).select("id", F.when(distance <= within, F.col("cluster")).alias("cluster"), distance.alias("distance"))


def zero_shot(vectors: DataFrame, labels: DataFrame, threshold: float, k: int) -> DataFrame:
    """id, label, score, rank: up to k labels (label, v) of each vector with score above the threshold."""
    return _matches(vectors, labels, "label", k, threshold)


def linear_margin(v: Column, weights, bias: float) -> Column:
    return dot(v, literal(weights)) + F.lit(float(bias))


def sigmoid(z: Column) -> Column:
    """Stable for large |z|."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def ridge(labelled: DataFrame, penalty: float = 1.0) -> tuple[np.ndarray, float, float]:
    """(weights, bias, threshold) of a ridge fit to +1 / -1 on unit vectors (id, v, y).

    Each task adds up its part of the normal equations; only these sums (a matrix of the dimension) are
    gathered. The threshold is midway between the classes' mean margins.
    """

    def sums(batches):
        total = None
        for b in batches:
            x = np.array(b.column("v").to_pylist(), float).reshape(b.num_rows, -1)
            if not len(x):
                continue
            n = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.hstack((np.divide(x, n, out=np.zeros_like(x), where=n > 0), np.ones((len(x), 1))))
            y = np.where(np.array(b.column("y").to_pylist()) > 0, 1.0, -1.0)
            part = np.vstack((x.T @ x, y @ x, np.where(y > 0, 1.0, 0.0) @ x))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size)), pa.array(total.ravel())], ["k", "x"])

    flat = labelled.select("v", "y").mapInArrow(sums, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()
    d = round(np.sqrt(1 + len(flat)) - 1)  # d * (d + 2) sums
    m = np.array([r.x for r in flat]).reshape(d + 2, d)
    gram, cross, positive = m[:d], m[d], m[d + 1]
    w = np.linalg.solve(gram + penalty * np.diag([1.0] * (d - 1) + [0.0]) + 1e-12 * np.eye(d), cross)
    n, n_pos = gram[-1, -1], positive[-1]
    up = positive @ w / max(n_pos, 1)
    down = (gram[-1] - positive) @ w / max(n - n_pos, 1)
    return w[:-1], float(w[-1]), float((up + down) / 2)


def logistic(labelled: DataFrame, penalty: float = 1e-2, rate: float = 0.5, steps: int = 400, most: int = 20_000) -> tuple[np.ndarray, float]:
    """(weights, bias) by full-batch gradient steps on labelled vectors (id, v, y), taken as stored; an error unless both classes are there.

    The labelled set is bounded: at most most rows, those with the least hash of id.
    """
    rows = labelled.orderBy(F.xxhash64("id"), "id").limit(most).select("v", "y").collect()
    x, y = np.array([r.v for r in rows], float), np.array([r.y for r in rows], float)
    if not (y > 0).any() or not (y <= 0).any():
        raise ValueError("a probe needs vectors of both classes")
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        z = x @ w + b
        p = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
        g = (p - y) / len(y)
        w, b = w - rate * (x.T @ g + penalty * w), b - rate * g.sum()
    return w.astype(np.float32).astype(float), float(b)


def ranked(vectors: DataFrame, weights, bias: float, k: int) -> DataFrame:
    """The k largest margins: id, score."""
    top = vectors.select("id", linear_margin(normalised(F.col("v")), weights, bias).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return top.select("id", F.round("score", 6).alias("score"))


def least_certain(vectors: DataFrame, weights, bias: float, threshold: float, k: int, unit: bool = True) -> DataFrame:
    """The k margins nearest to the threshold: id, score; of unit vectors, or of the vectors as stored."""
    s = vectors.select("id", linear_margin(normalised(F.col("v")) if unit else F.col("v"), weights, bias).alias("score"))
    return s.orderBy(F.abs(F.col("score") - F.lit(threshold)), "id").limit(k).select("id", F.round("score", 6).alias("score"))


def _best_of_tasks(vectors: DataFrame, probes: list) -> DataFrame:
    """probe, top_id, s: for each task the best of its vectors for each probe, by one matrix product a batch."""
    sent = vectors.sparkSession.sparkContext.broadcast((np.array([r.id for r in probes], np.int64), np.array([r.v for r in probes], float)))

    def run(batches):
        ids, q = sent.value
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        best, top = np.full(len(ids), -np.inf), np.full(len(ids), np.iinfo(np.int64).max)
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                x, mine = np.array(part.column("v").to_pylist(), float), part.column("id").to_numpy()
                o = np.argsort(mine, kind="stable")
                x, mine = x[o], mine[o]
                s = np.round(q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T, 12)
                at = s.argmax(axis=1)  # the smallest id where equal
                value, who = s[np.arange(len(ids)), at], mine[at]
                better = (value > best) | ((value == best) & (who < top))
                best, top = np.where(better, value, best), np.where(better, who, top)
        seen = best > -np.inf
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[seen]), pa.array(top[seen]), pa.array(best[seen])], ["probe", "top_id", "s"])

    return vectors.select("id", "v").mapInArrow(run, "probe long, top_id long, s double")


def self_retrieval(vectors: DataFrame, probes: DataFrame, least: float = 0.99) -> DataFrame:
    """id, top_id, similarity, ok: each probe's nearest stored vector must be itself, at a cosine above least.

    All probes are held against all vectors, in passes of about PROBES_AT_ONCE probes; a task gives one row a probe.
    """
    passes = max(1, -(-probes.count() // PROBES_AT_ONCE))
    rows = None
    for i in range(passes):
        some = probes.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i).select("id", "v").collect()
        if some:
            part = _best_of_tasks(vectors, some)
            rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        rows = vectors.sparkSession.createDataFrame([], "probe long, top_id long, s double")
    best = rows.groupBy("probe").agg(F.max_by("top_id", F.struct("s", -F.col("top_id"))).alias("top_id"), F.round(F.max("s"), 6).alias("similarity"))
    return best.select(F.col("probe").alias("id"), "top_id", "similarity", ((F.col("top_id") == F.col("probe")) & (F.col("similarity") > least)).alias("ok"))


def packed(vectors: DataFrame) -> DataFrame:
    """id, raw: each vector (id, v) as little-endian 32-bit floats."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([np.array(v, "<f4").tobytes() for v in b.column("v").to_pylist()], pa.binary())], ["id", "raw"])

    return vectors.select("id", "v").mapInArrow(run, "id long, raw binary")


def unpacked(rows: DataFrame, dimension: int) -> DataFrame:
    """id, v of packed rows; one of another dimension fails the job."""

    def run(batches):
        for b in batches:
            x = [np.frombuffer(r, "<f4") for r in b.column("raw").to_pylist()]
            if any(len(v) != dimension for v in x):
                raise ValueError(f"a vector has not {dimension} numbers")
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(x, pa.list_(pa.float32()))], ["id", "v"])

    return rows.select("id", "raw").mapInArrow(run, "id long, v array<float>")


def page(vectors: DataFrame, query: DataFrame, number: int, size: int, allowed: DataFrame | None = None) -> DataFrame:
    """A page (from 1) of the vectors nearest to the query: the best number * size are found, the last size of them returned, with their rank."""
    near = nearest(vectors, query, number * size, allowed)
    rank = F.row_number().over(Window.orderBy(F.desc("similarity"), "id"))
    return near.withColumn("rank", rank).where((F.col("rank") > (number - 1) * size) & (F.col("rank") <= number * size)).orderBy("rank")

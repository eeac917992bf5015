"""An approximate vector store: an inverted file of byte codes, made and searched by Spark, appended to without training.

Coarse centroids come from a bounded sample. A vector lies in the list of its nearest centroid (a partition of the table's files) as
a byte for each dimension of what it differs from the centroid by, and whole in a second table for re-ranking. A search reads the lists
next to its queries only, scores the codes, and ranks the best ones again by their exact cosines.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.sources.commits import CommitLog
from lumora.sources.shared import kept

#: Vectors that centroids are trained on, at most; centroids at most; rounds; queries searched together.
SAMPLE, LISTS, ROUNDS, QUERIES = 50_000, 1024, 12, 1000
#: Candidates that are ranked exactly, for each one asked for.
RERANK = 8
#: Scores that a task has at once, beside the best ones that it keeps; vectors that are coded at once.
SCORES, CODED = 250_000, 1000

_CODES = "id long, code binary, list int"
_WHOLE = "id long, v array<float>, list int"


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def centroids(x: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors by k-means on their cosines; a list that gets none takes the vector farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ c.T
        to, best = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, to, x)
        for k in np.flatnonzero(np.bincount(to, minlength=len(c)) == 0):
            far = int(best.argmin())
            sums[k], best[far] = x[far], 2
        c = _unit(sums)
    return c


def _strips(rows: np.ndarray, most: int):
    """rows in pieces of at most `most`, of one at least."""
    most = max(1, most)
    return (rows[i : i + most] for i in range(0, len(rows), most))


def _best(of: np.ndarray, ids: np.ndarray, s: np.ndarray, most: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `most` best of each query (of), of equal scores the smaller ids; least takes the last one's score of each query that has so many."""
    order = np.lexsort((ids, -s, of))
    of, ids, s = of[order], ids[order], s[order]
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, int)
    rank = np.arange(len(of)) - np.repeat(first, np.diff(np.concatenate((first, [len(of)]))))
    on = rank == most - 1
    least[of[on]] = s[on]
    return of[rank < most], ids[rank < most], s[rank < most]


def _of_codes(batches, q: np.ndarray, c: np.ndarray, by: dict[int, np.ndarray], step: float, most: int):
    """The `most` best rows (id, code, list) of each query over a task's batches: rows of q, ids, scores. by: the queries that go to a list.

    Queries meet a list's rows in strips of about SCORES scores, and of a strip only what may be among the best is kept.
    """
    least = np.full(len(q), -np.inf)
    held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for b in batches:
        ids, in_list = b.column("id").to_numpy(), b.column("list").to_numpy(zero_copy_only=False)
        code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(b.num_rows, -1)
        for n in np.unique(in_list):
            who = by.get(int(n), np.zeros(0, int))
            if not len(who):
                continue
            near = (q[who] @ c[n])[:, None]
            for rows in _strips(np.flatnonzero(in_list == n), SCORES // len(who)):
                # the cosine to centroid + step * code, as the sum of both parts
                s = near + step * (q[who] @ code[rows].T.astype(np.float64))
                i, j = np.nonzero(~(s < least[who][:, None]))
                held = tuple(np.concatenate(x) for x in zip(held, (who[i], ids[rows[j]], s[i, j]), strict=True))
                if len(held[0]) > 2 * most * len(q):
                    held = _best(*held, most, least)
    return _best(*held, most, least)


class VectorStore:
    """The store at path. Vectors are compared by cosine; those without direction, and null ones, are left out."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.codes, self.whole = CommitLog(spark, f"{path}/codes"), CommitLog(spark, f"{path}/whole")
        self.model = CommitLog(spark, f"{path}/model")

    def train(self, vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> None:
        """Fixes centroids and the codes' scale, from at most sample vectors (id, v) chosen by hash."""
        rows = vectors.where("v is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
        x = _unit(np.array([r.v for r in rows], np.float64))
        c = centroids(x, lists or min(LISTS, max(1, int(np.sqrt(len(x))))))
        step = float(np.abs(x - c[(x @ c.T).argmax(axis=1)]).max() / 127 or 1e-6)
        self.model.append(self.spark.createDataFrame([(json.dumps({"centroids": c.tolist(), "step": step}),)], "model string"))

    def _model(self) -> tuple[np.ndarray, float]:
        m = json.loads(self.model.read("model string").first().model)
        return np.array(m["centroids"]), m["step"]

    def contains(self, ids: DataFrame) -> DataFrame:
        """ids (id) with there: whether the store has them."""
        have = self.codes.read(_CODES).select("id", F.lit(True).alias("there")).distinct()
        return ids.select("id").join(have, "id", "left").select("id", F.coalesce("there", F.lit(False)).alias("there"))

    def add(self, vectors: DataFrame) -> None:
        """Appends the vectors (id, v) whose id isn't there: the first one comes first, of equal new ids the least vector. Nothing is trained or rewritten."""
        c, step = self._model()
        new = vectors.where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v")).join(self.codes.read(_CODES).select("id"), "id", "left_anti")

        def coded(batches):
            for b in (whole.slice(i, CODED) for whole in batches for i in range(0, whole.num_rows, CODED)):
                x = _unit(np.array(b.column("v").to_pylist(), np.float64))
                on = (x != 0).any(axis=1)
                x, to = x[on], (x[on] @ c.T).argmax(axis=1)
                code = np.clip(np.rint((x - c[to]) / step), -127, 127).astype(np.int8)
                keep = pa.array(np.flatnonzero(on))
                yield pa.RecordBatch.from_arrays([b.column("id").take(keep), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(to.astype(np.int32)), b.column("v").take(keep).cast(pa.list_(pa.float32()))], ["id", "code", "list", "v"])

        rows = kept(new.select("id", "v").mapInArrow(coded, "id long, code binary, list int, v array<float>").hint("rebalance", "list").sortWithinPartitions("list", "id"), "coded")
        if rows.isEmpty():
            return
        self.whole.append(rows.select("id", "v", "list"), by="list")
        self.codes.append(rows.select("id", "code", "list"), by="list")

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, rerank: int = RERANK) -> DataFrame:
        """query, rank, id, similarity (6 decimals): about the k nearest of each query (id, v) among the vectors of the probes lists next to it.

        Queries are searched in passes of QUERIES. A pass reads its lists' files of codes, and of whole vectors those of its candidates' lists; a task
        keeps the best of each query that it has met. With probes at the number of lists and rerank high enough the result is exact.
        """
        c, step = self._model()
        asked = kept(queries.where("id is not null and v is not null").select("id", "v"), "queries")
        passes = max(1, -(-asked.count() // QUERIES))
        out = None
        for i in range(passes):
            some = asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i).collect()
            one = self._search(np.array([r.id for r in some], np.int64), _unit(np.array([r.v for r in some], np.float64).reshape(len(some), c.shape[1])), c, step, k, probes, rerank)
            out = one if out is None else out.unionByName(one)
        return out

    def _search(self, ids: np.ndarray, q: np.ndarray, c: np.ndarray, step: float, k: int, probes: int, rerank: int) -> DataFrame:
        near = np.argsort(-(q @ c.T), axis=1)[:, :probes]
        lists = sorted(int(x) for x in np.unique(near))
        by_list = {n: np.flatnonzero((near == n).any(axis=1)) for n in lists}
        sent = self.spark.sparkContext.broadcast((ids, q, c, by_list))

        def by_code(batches):
            names, q, c, by = sent.value
            of, ids, score = _of_codes(batches, q, c, by, step, k * rerank)
            if len(of):
                yield pa.RecordBatch.from_arrays([pa.array(names[of]), pa.array(ids), pa.array(score)], ["query", "id", "score"])

        codes = self.codes.read(_CODES).where(F.col("list").isin(lists)).mapInArrow(by_code, "query long, id long, score double")
        w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        chosen = codes.withColumn("r", F.row_number().over(w)).where(f"r <= {k * rerank}").select("query", "id")
        place = self.spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, q, strict=True)], "query long, q array<double>")
        whole = self.whole.read(_WHOLE).where(F.col("list").isin(lists)).select("id", "v")
        dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)
        size = F.sqrt(F.aggregate("v", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x))
        exact = whole.join(chosen, "id").join(F.broadcast(place), "query").select("query", "id", F.round(dot / size, 6).alias("similarity"))
        top = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
        return exact.withColumn("rank", F.row_number().over(top)).where(f"rank <= {k}").select("query", "rank", "id", "similarity")

"""Queries on stores and runs: replaced versions, resumable embedding, one pass into several tables, batches that are halved."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lumora.operators import backends, retrieval, vectors
from lumora.operators.vector_store import VectorStore
from lumora.plans.registry import register
from lumora.plans.rows import _fresh
from lumora.plans.search import _T
from lumora.sources.catalog import Catalog, cte
from lumora.sources.commits import CommitLog, VersionedStore, resumed


@register("store_versions", cte("vectors") + "SELECT 'pinned' AS reader, count(*) AS n, min(id) AS first FROM vectors WHERE id % 2 = 0 UNION ALL SELECT 'current', count(*), min(id) FROM vectors WHERE id % 2 = 1")
def store_versions(spark, d):
    """A reader that began before a swap, and one after it; a version that fails the gate is never seen."""
    v = Catalog(spark, d).vectors
    store = VersionedStore(spark, _fresh(spark, "versions"))
    store.publish(v.where("id % 2 = 0"))
    pinned = store.read()
    store.publish(v.where("id < 0"), good=lambda rows: not rows.isEmpty())
    store.publish(v.where("id % 2 = 1"), good=lambda rows: not rows.isEmpty())
    of = lambda rows, name: rows.agg(F.lit(name).alias("reader"), F.count("*").alias("n"), F.min("id").alias("first"))
    return of(pinned, "pinned").unionByName(of(store.read(), "current"))


@register("embedding_resumed", cte("vectors") + "SELECT id, round(sqrt(list_inner_product(v, v)) / nullif(sqrt(list_inner_product(v, v)), 0), 6) AS length FROM vectors")
def embedding_resumed(spark, d):
    """A run that stops after its first batch, and one that goes on: each vector once, normalised."""
    v = Catalog(spark, d).vectors
    log = CommitLog(spark, _fresh(spark, "embedded"))

    class Stopped(Exception):
        pass

    def stop(batch):
        raise Stopped

    rows = max(1, v.count() // 4)
    step = lambda batch: batch.select("id", vectors.normalised(F.col("v")).alias("v"))
    try:
        resumed(v, step, log, batch_rows=rows, after_batch=stop)
    except Stopped:
        pass
    resumed(v, step, log, batch_rows=rows)
    return log.read("id long, v array<double>").select("id", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("length"))


_KINDS = {"embed": "scene_id string, length double", "tag": "scene_id string, category string, value string", "caption": "scene_id string, caption string", "detect": "scene_id string, face_index long, label string"}


def _annotate(batch: pd.DataFrame) -> dict[str, pd.DataFrame]:
    """What a chain of models would say of scenes: four kinds of rows out of one look at each."""
    ids = batch["scene_id"]
    faces = batch.loc[batch.index.repeat(batch["scene"] % 3)]
    return {
        "embed": pd.DataFrame({"scene_id": ids, "length": (batch["hi"] - batch["lo"]).astype(float)}),
        "tag": pd.DataFrame({"scene_id": ids, "category": "part", "value": (batch["scene"] % 2).map({0: "even", 1: "odd"})}),
        "caption": pd.DataFrame({"scene_id": ids, "caption": "scene " + batch["scene"].astype(str)})[batch["video"] % 5 != 0],
        "detect": pd.DataFrame({"scene_id": faces["scene_id"], "face_index": faces.groupby("scene_id").cumcount(), "label": "face"}),
    }


@register("scene_outputs", cte("scenes") + "SELECT 'embed' AS kind, count(*) AS n, count(DISTINCT (video, scene)) AS scenes FROM scenes UNION ALL SELECT 'tag', count(*), count(DISTINCT (video, scene)) FROM scenes UNION ALL SELECT 'caption', count(*), count(DISTINCT (video, scene)) FROM scenes WHERE video % 5 <> 0 UNION ALL SELECT 'detect', CAST(sum(scene % 3) AS BIGINT), count(DISTINCT (video, scene)) FILTER (WHERE scene % 3 > 0) FROM scenes")
def scene_outputs(spark, d):
    """Four tables of scenes made in one pass and published twice: the second run takes the first one's place."""
    s = Catalog(spark, d).scenes.withColumn("scene_id", F.format_string("%d/%d", "video", "scene"))
    store = VersionedStore(spark, _fresh(spark, "scenes"))
    for _ in range(2):
        store.publish(backends.all_kinds(_annotate, s, _KINDS), by="kind")
    store.vacuum()
    kinds = [store.read(kind=k).agg(F.lit(k).alias("kind"), F.count("*").alias("n"), F.countDistinct("scene_id").alias("scenes")) for k in _KINDS]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3])


@register("batches_halved", cte("videos") + "SELECT id, 'part' AS category, filename AS value, 0.5::DOUBLE AS confidence, 'small' AS tag_source FROM videos")
def batches_halved(spark, d):
    """A tagger that can't hold more than 100 rows tags them all."""

    def step(batch: pd.DataFrame) -> pd.DataFrame:
        if len(batch) > 100:
            raise RuntimeError("device out of memory")
        return pd.DataFrame({"id": batch["id"], "category": "part", "value": batch["filename"], "confidence": 0.5, "tag_source": "small"})

    registry = backends.Registry()
    registry.add(backends.Backend("small", {"tag": backends.halving(step)}))
    return registry.dispatch("small", "tag", Catalog(spark, d).videos.select("id", "filename"))


@register("term_index_updated", cte("captions", more=_T.replace("FROM captions)", "FROM captions WHERE image_id % 5 <> 0)")) + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(a) AS term FROM t) GROUP BY doc, term) GROUP BY term")
def term_index_updated(spark, d):
    """An index of every second caption, brought to those that the catalog has now: what is new in a segment, what is gone marked."""
    captions = Catalog(spark, d).captions
    index = retrieval.caption_index(spark, _fresh(spark, "captions"))
    index.add(captions.where("image_id % 2 = 0"))
    index.sync(captions.where("image_id % 5 != 0"))
    return index.index().terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _store(spark, v):
    """Trained on all vectors, filled in two appends."""
    store = VectorStore(spark, _fresh(spark, "vectors"))
    store.train(v)
    store.add(v.where("id % 3 != 0"))
    store.add(v)
    return store


@register("vector_store_search")
def vector_store_search(spark, d):
    """The 10 nearest vectors of every fiftieth one, from two thirds of the store's lists: the given vectors hardly cluster, and half of them would miss one in nine."""
    v = Catalog(spark, d).vectors.select("id", "v")
    store = _store(spark, v)
    return store.search(v.where("id % 50 = 0"), 10, probes=max(1, len(store._model()[0]) * 2 // 3))


@register("vector_store_contains", cte("vectors") + "SELECT id, id IN (SELECT id FROM vectors WHERE id % 3 <> 0) AS there FROM vectors")
def vector_store_contains(spark, d):
    v = Catalog(spark, d).vectors.select("id", "v")
    store = VectorStore(spark, _fresh(spark, "vectors"))
    store.train(v)
    store.add(v.where("id % 3 != 0"))
    return store.contains(v)

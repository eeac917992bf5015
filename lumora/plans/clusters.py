"""Queries on clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.operators import cluster
from lumora.plans.registry import register
from lumora.sources.catalog import Catalog


def _faces(c):
    return c.vectors.select("id", "v", (F.col("label") % 2).cast("long").alias("embedder"))


@register("face_clusters_dbscan")
def face_clusters_dbscan(spark, d):
    return cluster.dbscan(_faces(Catalog(spark, d)), eps=0.6, least=3)


@register("face_clusters_complete")
def face_clusters_complete(spark, d):
    return cluster.complete_linkage(_faces(Catalog(spark, d)), cut=0.7, least=2)


@register("people_summary")
def people_summary(spark, d):
    return cluster.people(cluster.complete_linkage(_faces(Catalog(spark, d)), cut=0.7, least=2))

"""The face store: faces (id, image_id, person, embedder, ...) and the people they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.operators.cluster import complete_linkage, dbscan, people
from lumora.sources.shared import kept


def chain(persons: DataFrame, faces: DataFrame, images: DataFrame) -> DataFrame:
    """person, name, face, image_id, filename: people with their faces and those faces' images; people without faces and faces without an image stay."""
    f = faces.select("person", F.col("id").alias("face"), "image_id")
    return persons.join(f, "person", "left").join(images.select(F.col("id").alias("image_id"), "filename"), "image_id", "left").select("person", "name", "face", "image_id", "filename")


def faces_with_images(faces: DataFrame, images: DataFrame) -> DataFrame:
    """faces with the filename of their image, null where it is gone."""
    return faces.join(images.select(F.col("id").alias("image_id"), "filename"), "image_id", "left").select(*faces.columns, "filename")


def assigned(faces: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, people): faces moved to the persons of wanted (id, person), and the new n and cover of every person touched on either side, 0 and null for one left empty."""
    w = wanted.select("id", F.col("person").alias("_to"))
    moved = faces.join(w, "id", "left").withColumn("person", F.coalesce("_to", "person")).select(*faces.columns)
    touched = faces.join(w, "id", "left_semi").select("person").union(w.select("_to")).where("person is not null").distinct()
    now = moved.join(touched, "person", "left_semi").groupBy("person").agg(F.count("*").alias("n"), F.min("id").alias("cover"))
    return moved, touched.join(now, "person", "left").select("person", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "cover")


def split(faces: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """assigned() of the given faces (id) to one new person, numbered after the largest."""
    new = faces.agg((F.coalesce(F.max("person"), F.lit(-1)) + 1).alias("person"))
    return assigned(faces, ids.select("id").crossJoin(F.broadcast(new)))


def erased(faces: DataFrame, persons: DataFrame | None) -> DataFrame:
    """faces without those of persons (person); without all where None is given."""
    return faces.limit(0) if persons is None else faces.join(persons.select("person"), "person", "left_anti").select(*faces.columns)


def pending(faces: DataFrame, embedder: int | None) -> DataFrame:
    """Faces of an embedder (of all with None) that no person has."""
    rows = faces.where("person is null")
    return rows if embedder is None else rows.where(F.col("embedder") == embedder)


def listed(faces: DataFrame) -> DataFrame:
    """person, n, cover, largest first, then by person."""
    return people(faces.where("person is not null").select("id", F.col("person").alias("cluster"))).orderBy(F.desc("n"), "person")


def of_embedder(faces: DataFrame, embedder: int) -> DataFrame:
    """All faces of an embedder, assigned or not."""
    return faces.where(F.col("embedder") == embedder)


def added(faces: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, people): faces with the new ones (without id) numbered after the largest id in the order of image and box, and n and cover of every person that got one."""
    last = faces.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("last"))
    # numbers by the counts of the images before: no window over all rows but the images' counts
    w = Window.partitionBy("image_id").orderBy("box")
    rows = new.withColumn("at", F.row_number().over(w))
    n = rows.groupBy("image_id").agg(F.count("*").alias("n"))
    before = n.select("image_id", F.coalesce(F.sum("n").over(Window.orderBy("image_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = rows.join(before, "image_id").crossJoin(F.broadcast(last)).withColumn("id", F.col("last") + F.col("before") + F.col("at"))
    out = faces.unionByName(rows.select(*faces.columns))
    got = new.where("person is not null").select("person").distinct()
    return out, out.join(got, "person", "left_semi").groupBy("person").agg(F.count("*").alias("n"), F.min("id").alias("cover"))


def clustered(faces: DataFrame, vectors: DataFrame, embedder: int, eps: float, least: int, algorithm: str = "agglomerative") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(faces, people, result) of a clustering run over an embedder's pending faces, whose vectors are (id, v).

    Each cluster is a new person (person, n, cover): the largest person there is, and one more than the cluster's smallest face. Noise stays
    pending. result: faces_considered, clusters_created, faces_assigned, noise. Algorithms: agglomerative (complete linkage) or dbscan.
    """
    todo = pending(faces, embedder).select("id", "embedder").join(vectors.select("id", "v"), "id")
    run = {"agglomerative": complete_linkage, "dbscan": dbscan}[algorithm]
    found = kept(run(todo, eps, least).select("id", "cluster"), "clustered")
    last = faces.agg(F.coalesce(F.max("person"), F.lit(-1)).alias("last"))
    wanted = found.where("cluster >= 0").crossJoin(F.broadcast(last)).select("id", (F.col("last") + 1 + F.col("cluster")).alias("person"))
    moved, people_now = assigned(faces, wanted)
    of = F.when(F.col("cluster") >= 0, F.col("cluster"))
    result = found.agg(F.count("*").alias("faces_considered"), F.count_distinct(of).alias("clusters_created"), F.count(of).alias("faces_assigned"), F.count_if(of.isNull()).alias("noise"))
    return moved, people_now, result

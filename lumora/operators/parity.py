"""Comparisons of two runs: keys, values, vectors, boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.operators.grouped import many_groups
from lumora.operators.vectors import cosine


def diff(left: DataFrame, right: DataFrame, key: list[str], value: str, tolerance: float | None = None) -> DataFrame:
    """key, status: only_left, only_right, differs or same."""
    a, b = left.select(*key, F.col(value).alias("x"), F.lit(1).alias("in_a")), right.select(*key, F.col(value).alias("y"), F.lit(1).alias("in_b"))
    same = F.col("x").eqNullSafe(F.col("y")) if tolerance is None else F.coalesce(F.abs(F.col("x") - F.col("y")) <= tolerance, F.col("x").isNull() & F.col("y").isNull())
    return a.join(b, key, "full").select(*key, F.when(F.col("in_b").isNull(), "only_left").when(F.col("in_a").isNull(), "only_right").when(same, "same").otherwise("differs").alias("status"))


def vector_diff(left: DataFrame, right: DataFrame, most_l2: float = 1e-4, least_cosine: float = 0.9999) -> DataFrame:
    """id, l2, cosine, ok for ids that both have."""
    j = left.select("id", F.col("v").alias("a")).join(right.select("id", F.col("v").alias("b")), "id")
    l2 = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    return j.select("id", F.round(l2, 6).alias("l2"), F.round(cosine(F.col("a"), F.col("b")), 6).alias("cosine")).withColumn("ok", (F.col("l2") <= most_l2) & (F.col("cosine") >= least_cosine))


def store_parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """n_left, n_right, ids_left, ids_right, ok."""
    a = left.agg(F.count("*").alias("n_left"), F.countDistinct(key).alias("ids_left"))
    b = right.agg(F.count("*").alias("n_right"), F.countDistinct(key).alias("ids_right"))
    return a.crossJoin(b).withColumn("ok", (F.col("n_left") == F.col("n_right")) & (F.col("ids_left") == F.col("ids_right")) & (F.col("n_left") > 0))


def closest_free(group: np.ndarray, boxes: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row whether it is a left box (side false) that takes a right one, and the largest difference of a corner, else NaN.

    group: numbers from 0 in ascending order. A group's left boxes take in turn, each the first of the closest right ones
    that are free; all groups go on in step, so that a step is a few array operations over their right boxes.
    """
    left, right = np.flatnonzero(~side), np.flatnonzero(side)
    n_left, n_right = (np.bincount(group[x], minlength=group[-1] + 1) for x in (left, right))
    first_left, first_right = np.cumsum(n_left) - n_left, np.cumsum(n_right) - n_right
    free, taken, px = np.ones(len(right), bool), np.zeros(len(group), bool), np.full(len(group), np.nan)
    k, active = 0, np.flatnonzero((n_left > 0) & (n_right > 0))
    while len(active):
        size = n_right[active]
        start, of = np.cumsum(size) - size, np.repeat(np.arange(len(active)), size)
        at = np.arange(len(of)) + (first_right[active] - start)[of]
        who = left[first_left[active] + k]
        far = np.abs(boxes[right[at]] - boxes[who][of]).max(axis=1)
        # an unknown difference comes first, an endless one last
        key = np.where(free[at], np.where(np.isnan(far), -np.inf, np.minimum(far, np.finfo(float).max)), np.inf)
        hit = np.flatnonzero(key == np.minimum.reduceat(key, start)[of])
        hit = hit[np.concatenate(([True], of[hit][1:] != of[hit][:-1]))]
        free[at[hit]], taken[who], px[who] = False, True, far[hit]
        k += 1
        active = active[(n_left[active] > k) & (n_right[active] > k)]
    return taken, px


def paired_boxes(left: DataFrame, right: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """id, n_left, n_right, n_paired, n_far, n_alone, max_px: boxes (id, label, x1, y1, x2, y2) of two runs over one image.

    Each left box, by label and corners, takes the closest free right box of its label, however far (the
    largest difference of a corner counts): within tolerance they are paired, beyond it far. n_alone are
    the boxes of either side that find none. max_px is the largest difference of those taken, null without
    any. The boxes of many images are compared together, those of one image are in one task.
    """
    names = ("n_left", "n_right", "n_paired", "n_far", "n_alone")

    def run(g, start):
        n_rows, side = len(g["id"]), g["side"] == 1
        image = np.repeat(np.arange(len(start)), np.diff(np.append(start, n_rows)))
        label = pd.factorize(g["label"])[0]
        new = (image[1:] != image[:-1]) | (label[1:] != label[:-1])
        taken, px = closest_free(np.concatenate(([0], np.cumsum(new))), np.stack([g[c].astype(float) for c in ("x1", "y1", "x2", "y2")], axis=1), side)
        count = lambda on: np.bincount(image[on], minlength=len(start))
        paired = count(taken & (px <= tolerance))
        n = [count(~side), count(side), paired, count(taken) - paired, count(side) + count(~side) - 2 * count(taken)]
        return {"id": g["id"][start]} | dict(zip(names, n, strict=True)) | {"max_px": np.fmax.reduceat(px, start)}

    columns = ("id", "label", "x1", "y1", "x2", "y2")
    both = left.select(*columns, F.lit(0).alias("side")).unionByName(right.select(*columns, F.lit(1).alias("side")))
    out = many_groups(both, ["id"], ["label", "x1", "y1", "x2", "y2", "side"], run, "id long, n_left long, n_right long, n_paired long, n_far long, n_alone long, max_px double")
    return out.withColumn("max_px", F.nanvl("max_px", F.lit(None).cast("double")))


def keyed(rows: DataFrame) -> DataFrame:
    """image_id, tags: a map of category, value and source (a struct) to confidence; of rows with one key the largest confidence."""
    one = rows.groupBy("image_id", F.struct("category", "value", "tag_source").alias("k")).agg(F.max("confidence").alias("c"))
    return one.groupBy("image_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "c")))).alias("tags"))

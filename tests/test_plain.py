"""Queries that SQL can't express, against plain loops and matrices over the smallest tables."""

import numpy as np
import pyarrow.parquet as pq

from lumora.plans import registry

FOLDER = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{FOLDER}/{name}.parquet").to_pandas()


def vectors():
    t = table("embeddings")
    return t.vec_id.to_numpy(), np.array(t.embedding.tolist(), float), t.label.to_numpy()


def rows(spark, name):
    return registry.queries()[name](spark, FOLDER).collect()


def test_box_parity(spark):
    t = table("lineitem")
    box = lambda r, dx: (r.l_quantity + dx, r.l_linenumber * 10.0, r.l_quantity + dx + 20, r.l_linenumber * 10.0 + 20)
    want = {}
    for i, g in t.groupby("l_orderkey"):
        left = sorted((r.l_returnflag, box(r, 0)) for r in g.itertuples())
        free, taken = sorted((r.l_returnflag, box(r, r.l_partkey % 4)) for r in g.itertuples()), []
        for label, b in left:
            of = [x for x in free if x[0] == label]
            if of:
                best = min(of, key=lambda x: max(abs(p - q) for p, q in zip(b, x[1], strict=True)))
                taken.append(max(abs(p - q) for p, q in zip(b, best[1], strict=True)))
                free.remove(best)
        near = sum(x <= 2 for x in taken)
        want[i] = (len(left), len(left), near, len(taken) - near, 2 * (len(left) - len(taken)), max(taken, default=None))
    assert {r.id: tuple(r)[1:] for r in rows(spark, "box_parity")} == want


def test_probes(spark):
    ids, x, label = vectors()
    on = np.isin(label, (0, 1))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, y = np.hstack((u[on], np.ones((on.sum(), 1)))), np.where(label[on] == 0, 1.0, -1.0)
    w = np.linalg.solve(a.T @ a + np.diag([1.0] * 64 + [0.0]), a.T @ y)
    margin = u @ w[:-1] + w[-1]
    middle = (margin[on][y > 0].mean() + margin[on][y < 0].mean()) / 2
    rest = label > 1
    first = lambda key: [int(i) for i in ids[rest][np.lexsort((ids[rest], key[rest]))][:25]]
    assert [r.id for r in rows(spark, "ridge_ranked")] == first(-margin)
    assert [r.id for r in rows(spark, "ridge_edge_cases")] == first(np.abs(margin - middle))

    w, b, y = np.zeros(64), 0.0, (label[on] == 0).astype(float)
    for _ in range(400):
        p = 1 / (1 + np.exp(-(x[on] @ w + b)))
        w, b = w - 0.5 * (x[on].T @ (p - y) / len(y) + 1e-2 * w), b - 0.5 * (p - y).mean()
    z = x @ w.astype(np.float32).astype(float) + b
    assert [r.id for r in rows(spark, "active_learning")] == first(np.abs(z))
    p = 1 / (1 + np.exp(-z))
    got = rows(spark, "logistic_preview")
    assert len(got) == min(25, (p[rest] > 0.5).sum()) and all(abs(r.score - p[ids == r.id][0]) < 2e-6 and r.n_over == (np.round(p[rest], 6) > 0.5).sum() for r in got)


def test_face_clusters(spark):
    ids, x, label = vectors()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r.id: r.cluster for r in rows(spark, "face_clusters_dbscan")}
    for e in (0, 1):
        at = np.flatnonzero(label % 2 == e)
        near = 1 - u[at] @ u[at].T <= 0.6 + 1e-12
        core = near.sum(axis=1) >= 3
        name = np.where(core, ids[at], np.iinfo(np.int64).max)
        while True:
            low = np.where(core, np.where(near & core[None], name[None], np.iinfo(np.int64).max).min(axis=1), name)
            if (low == name).all():
                break
            name = low
        border = np.where(near & core[None], name[None], np.iinfo(np.int64).max).min(axis=1)
        for i, v, b in zip(ids[at].tolist(), core, border.tolist(), strict=True):
            assert got[i] == (b if v or b < np.iinfo(np.int64).max else -1)


def test_probe_needs_both_classes(spark):
    import pytest

    from lumora.operators import vectors as ops

    with pytest.raises(ValueError):
        ops.logistic(spark.createDataFrame([(1, [1.0, 0.0], 1)], "id long, v array<double>, y int"))


def test_keys_ties_and_references(spark):
    from pyspark.sql import functions as F

    from lumora.functions import media
    from lumora.operators import geo

    key = lambda m: media.run_key(F.lit(None).cast("string"), [F.lit(None).cast("string")], m)
    m = lambda *kv: F.create_map(*map(F.lit, kv))
    r = spark.range(1).select(
        key(m("a", "1", "b", "2")).alias("x"), key(m("b", "2", "a", "1")).alias("y"),
        media.run_key(F.lit(""), [F.lit("t"), F.lit(None).cast("string"), F.lit("s")], m("a", "1")).alias("joined"),
        media.argmax_label(m("porn", 0.5, "sexy", 0.5)).alias("tie"),
        geo.gps_of(m("Composite:GPSLatitude", "-3.5", "EXIF:GPSLongitude", "7", "EXIF:GPSLongitudeRef", "West")).alias("p"),
        geo.gps_of(m("Composite:GPSCoordinates", "+1.5-2.5/", "location", "+8+8/")).alias("v"),
        geo.dms_to_decimal(F.lit("10"), F.lit(None).cast("string"), F.lit("0"), F.lit("N")).alias("none"),
    ).first()
    assert r.x == r.y and r.x.startswith("auto:") and r.joined == "t|s" and r.tie == "nsfw" and tuple(r.p) == (-3.5, -7.0) and tuple(r.v) == (1.5, -2.5) and r.none is None


def plain_complete(x, cut):
    """Complete linkage by merging the two nearest clusters again and again; clusters as sets of rows."""
    far = 1 - x @ x.T
    np.fill_diagonal(far, np.inf)
    members = {i: {i} for i in range(len(x))}
    while len(members) > 1:
        i, j = np.unravel_index(far.argmin(), far.shape)
        if far[i, j] > cut:
            break
        members[i] |= members.pop(j)
        far[i] = far[:, i] = np.maximum(far[i], far[j])
        far[j] = far[:, j] = np.inf
        far[i, i] = np.inf
    return members.values()


def test_complete_linkage_of_faces_by_plain_merges(spark):
    t = pq.read_table(f"{FOLDER}/embeddings.parquet").to_pydict()
    ids, label, v = np.array(t["vec_id"]), np.array(t["label"]) % 2, np.array(t["embedding"], float)
    got = {r.id: r.cluster for r in rows(spark, "face_clusters_complete")}
    want = {}
    for e in (0, 1):
        x, own = v[label == e] / np.linalg.norm(v[label == e], axis=1, keepdims=True), ids[label == e]
        for c in plain_complete(x, 0.7):
            want |= {int(own[i]): int(min(own[i] for i in c)) if len(c) >= 2 else -1 for i in c}
    assert got == want
    people = rows(spark, "people_summary")
    named = {c for c in want.values() if c >= 0}
    assert {(r.person, r.n, r.cover) for r in people} == {(c, sum(x == c for x in want.values()), c) for c in named}


def test_blocks_that_are_far_apart_are_not_compared(spark):
    """Of clusters in many directions most pairs of blocks are ruled out, and DBSCAN and linkage in rounds still find what all pairs give."""
    from lumora.operators import cluster as ops

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(25, 16))
    x = centres[rng.integers(0, 25, 900)] + rng.normal(size=(900, 16)) * 0.25
    vectors = spark.createDataFrame([(i, a.tolist(), 0) for i, a in enumerate(x)] + [(5000, [0.0] * 16, 0)], "id long, v array<double>, embedder long")
    assert ops.compared_share(vectors, "embedder", 0.1, block=32) < 0.35
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = 1 - u @ u.T <= 0.1
    core = near.sum(axis=1) >= 4
    got = {r.id: r.cluster for r in ops.dbscan(vectors, 0.1, 4).collect()}
    name = np.where(core, np.arange(900), 10**9)
    while True:
        new = np.where(core, np.where(near & core[None], name[None], 10**9).min(axis=1), 10**9)
        if (new == name).all():
            break
        name = new
    border = np.where(near & core[None], name[None], 10**9).min(axis=1)
    assert got == {i: int(name[i]) if core[i] else int(border[i]) if border[i] < 10**9 else -1 for i in range(900)} | {5000: -1}
    parts = {r.id: r.cluster for r in ops.complete_linkage(vectors, 0.2, 2, part=5).collect()}
    want = {i: min(c) if len(c) > 1 else -1 for c in plain_complete(u, 0.2) for i in c} | {5000: -1}
    assert parts == want

"""Small fixtures with hand-computed results."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumora.functions import media
from lumora.operators import backends, cluster, facets, filters, geo, parity, retrieval, scenes, stats, vectors, writes


@pytest.fixture(scope="module")
def search(spark):
    images = spark.createDataFrame([(1, "Ana", True), (2, "Ana", True), (3, "Bob", False)], "id long, person string, processed boolean")
    tags = spark.createDataFrame([(1, "clothing", "dress"), (1, "setting", "beach"), (2, "clothing", "dress"), (2, "setting", "studio"), (3, "clothing", "suit"), (3, "setting", "beach")], "image_id long, category string, value string")
    labels = spark.createDataFrame([(1, "Rating", "sfw"), (2, "Rating", "suggestive"), (3, "Rating", "sfw")], "asset_id long, set_name string, value string")
    return images, tags, labels


def ids(df):
    return {r.id for r in df.select("id").collect()}


@pytest.mark.parametrize(
    "spec, want",
    [
        ({"tags": {"clothing": ["dress"]}}, {1, 2}),
        ({"tags": {"clothing": ["dress", "suit"]}}, {1, 2, 3}),
        ({"tags": {"clothing": ["dress"], "setting": ["beach"]}}, {1}),
        ({"person": "Ana"}, {1, 2}),
        ({"rating": "sfw"}, {1, 3}),
        ({"tags": {"clothing": ["dress"]}, "rating": "sfw", "person": "Ana"}, {1}),
        ({"processed": False}, {3}),
        ({"labels": {"Rating": ["sfw"]}}, {1, 3}),
    ],
)
def test_candidates(search, spec, want):
    assert ids(filters.candidates(*search, filters.FilterSpec(**spec))) == want


def test_pages_are_disjoint(search):
    rows = filters.sorted_by(search[0], "recent")
    assert [r.id for r in filters.page(rows, 1, 2).collect()] == [3, 2]
    assert [r.id for r in filters.page(rows, 2, 2).collect()] == [1]


@pytest.mark.parametrize("active", [{}, {"clothing": ["dress"]}, {"clothing": ["dress"], "setting": ["beach"]}])
def test_facets_drop_their_own_filter(search, active):
    images, tags, _ = search
    got = {(r.category, r.value): r.n for r in facets.tag_facets(images, tags, active).collect()}
    want = {}
    rows = [tuple(r) for r in tags.collect()]
    has = lambda i, c: any(x == i and k == c and v in active[c] for x, k, v in rows)
    for i, c, v in rows:
        if all(has(i, k) for k in active if k != c):
            want.setdefault((c, v), set()).add(i)
    assert got == {k: len(v) for k, v in want.items()}


def test_specs():
    assert filters.parse_specs(["a: b", "a:c:d", "x", ":y", "z:"]) == {"a": ["b", "c:d"]}
    with pytest.raises(ValueError):
        filters.parse_specs_strict(["nocolon"])


def test_owner_scope(spark):
    a = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "id long, owner_id long")
    assert ids(filters.owned(a, 5)) == {1, 2}
    assert ids(filters.owned(a, filters.viewer_of({"id": 1, "role": "admin"}))) == {1, 2, 3}


def test_captions(spark):
    c = spark.createDataFrame([(1, "a woman with long hair"), (2, "a man on a beach"), (3, "a woman by a window"), (4, "  "), (5, None)], "image_id long, caption string")
    doc = lambda df: {r.doc for r in df.collect()}
    c = retrieval.made(c)
    assert doc(retrieval.phrase(c, "Woman")) == {1, 3}
    assert doc(retrieval.all_terms(c, "beach man!")) == {2}
    assert doc(retrieval.phrase(c, "a man on")) == {2}
    assert doc(retrieval.phrase(c, "man a on")) == set() == doc(retrieval.phrase(c, " ?! "))
    assert retrieval.mode("caption", " ", True, False) == ("tags", "caption")
    again = spark.createDataFrame([(1, "x x x")], "image_id long, caption string")
    assert retrieval.phrase(retrieval.made(again), "x x").first().n == 2
    assert retrieval.query_terms("Ṡő Č") == ["so", "c"]


def items(spark, rows):
    return spark.createDataFrame([(i, 0, float(t) if t is not None else None, la, lo) for i, t, la, lo in rows], "id long, person int, t double, lat double, lon double")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.segment, r.cluster), []).append(r.id)
    return sorted(sorted(v) for v in out.values())


DAY = 86_400


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(1, 0, None, None), (2, 60, None, None), (3, 3 * DAY, None, None), (4, 3 * DAY + 60, None, None)], [[1, 2], [3, 4]]),
        ([(1, 0, 37.7749, -122.4194), (2, 60, 37.775, -122.4195), (3, 120, 40.7128, -74.006), (4, 180, 40.7129, -74.0061)], [[1, 2], [3, 4]]),
        ([(1, 0, 37.7749, -122.4194), (2, 60, 37.775, -122.4195), (3, 120, 51.5, -0.12)], [[1, 2, 3]]),
        ([(1, 0, 10.0, 20.0), (2, 60, 12.0, 22.0)], [[1, 2]]),
        ([(1, 0, None, None), (2, 21_600, None, None), (3, None, None, None)], [[1, 2, 3]]),
    ],
)
def test_events(spark, rows, want):
    assert groups(geo.events(items(spark, rows))) == want


def test_events_of_nothing(spark):
    assert geo.events(items(spark, [(1, 0, None, None)]).limit(0)).count() == 0


def test_distances_and_coordinates(spark):
    r = spark.range(1).select(geo.haversine_km(F.lit(37.7749), F.lit(-122.4194), F.lit(40.7128), F.lit(-74.006)).alias("km"), geo.iso6709(F.lit("+37.7749-122.4194+010/")).alias("p"), geo.dms_to_decimal(F.lit("10"), F.lit("30"), F.lit("0"), F.lit("S")).alias("d")).first()
    assert abs(r.km - 4130) < 80 and r.p.lat == 37.7749 and r.p.lon == -122.4194 and r.d == -10.5


def blobs(spark, seed=0):
    rng = np.random.default_rng(seed)
    centres = np.eye(16)[:3]
    x = np.concatenate([c + rng.normal(0, 0.02, (15, 16)) for c in centres])
    return spark.createDataFrame([(i, 0, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedder int, v array<double>")


def test_clusters_of_blobs(spark):
    for got in (cluster.dbscan(blobs(spark), 0.1, 3), cluster.complete_linkage(blobs(spark), 0.3, 3)):
        rows = {r.id: r.cluster for r in got.collect()}
        assert rows == {i: i // 15 * 15 for i in range(45)}


def test_dbscan_against_plain_loops(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, 0, [float(a) for a in r]) for i, r in enumerate(x)], "id long, embedder int, v array<double>")
    near = 1 - x @ x.T <= 0.05
    core = near.sum(axis=1) >= 3
    label = np.where(core, np.arange(30), 99)
    for _ in range(30):
        for i in range(30):
            for j in range(30):
                if near[i, j] and core[i] and core[j]:
                    label[i] = label[j] = min(label[i], label[j])
    want = [int(label[i]) if core[i] else int(min([label[j] for j in range(30) if near[i, j] and core[j]], default=-1)) for i in range(30)]
    got = {r.id: r.cluster for r in cluster.dbscan(v, 0.05, 3).collect()}
    assert [got[i] for i in range(30)] == want


def linked_one_by_one(x, cut):
    """Merges the two clusters with the smallest largest distance, as long as that is within the cut."""
    parts = [{i} for i in range(len(x))]
    d = 1 - x @ x.T
    while True:
        best = min(((max(d[i, j] for i in a for j in b), n, m) for n, a in enumerate(parts) for m, b in enumerate(parts) if n < m), default=(9, 0, 0))
        if best[0] > cut:
            return {frozenset(p) for p in parts}
        parts[best[1]] |= parts.pop(best[2])


def as_vectors(spark, x):
    return spark.createDataFrame([(i, 0, [float(a) for a in r]) for i, r in enumerate(x)], "id long, embedder int, v array<double>")


def test_complete_linkage_keeps_within_the_cut(spark):
    x = np.random.default_rng(5).normal(size=(40, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {r.id: r.cluster for r in cluster.complete_linkage(as_vectors(spark, x), 0.3, 1).collect()}
    assert {frozenset(i for i in got if got[i] == c) for c in set(got.values())} == linked_one_by_one(x, 0.3)


def test_complete_linkage_of_large_parts_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 4)  # clusters outgrow a block and are spread
    x = np.random.default_rng(6).normal(size=(36, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.concatenate([x, np.repeat(x[:1], 9, axis=0), np.zeros((2, 3))])
    rows = cluster.complete_linkage(as_vectors(spark, x), 0.9, 2, part=5).collect()
    assert sorted(r.id for r in rows) == list(range(len(x)))
    got = {r.id: r.cluster for r in rows}
    want = linked_one_by_one(x, 0.9)
    assert max(map(len, want)) > 8
    assert got == {i: min(p) if len(p) > 1 else -1 for p in want for i in p}


def test_probes_separate(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(1, 0.1, (110, 16)), rng.normal(-1, 0.1, (110, 16))))
    rows = spark.createDataFrame([(i, [float(a) for a in r], int(i < 110)) for i, r in enumerate(x)], "id long, v array<double>, y int")
    w, b, t = vectors.ridge(rows)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert ((u @ w + b > t) == (np.arange(220) < 110)).all()
    a = np.hstack((u, np.ones((220, 1))))
    y = np.where(np.arange(220) < 110, 1.0, -1.0)
    want = np.linalg.solve(a.T @ a + np.diag([1.0] * 16 + [0.0]), a.T @ y)
    np.testing.assert_allclose(np.append(w, b), want, atol=1e-6)
    w, b = vectors.logistic(rows)
    assert ((u @ w + b > 0) == (np.arange(220) < 110)).all()


def test_zero_vector_is_left_alone(spark):
    r = spark.createDataFrame([(1, [0.0, 0.0])], "id long, v array<double>").select(vectors.normalised(F.col("v")).alias("n"), vectors.cosine(F.col("v"), F.col("v")).alias("c")).first()
    assert r.n == [0.0, 0.0] and r.c == 0


def test_rules(spark):
    assets = spark.createDataFrame([(i, "reject") for i in range(1, 5)] + [(5, "keep")], "id long, flag_action string")
    tags = spark.createDataFrame([(i, "content_type", "watermark") for i in range(1, 6)] + [(i, "clothing", "lingerie") for i in (1, 2, 3)] + [(i, "rating", "nsfw") for i in range(1, 5)], "image_id long, category string, value string")
    none = spark.createDataFrame([], "category string, value string, enabled boolean")
    found = lambda n, rules=none: [(r.value, r.n) for r in stats.mine_rules(assets, tags, rules, n, 10).collect()]
    assert found(3) == [("watermark", 4), ("lingerie", 3)]
    assert found(4) == [("watermark", 4)]
    assert found(3, spark.createDataFrame([("content_type", "watermark", False)], none.schema)) == [("lingerie", 3)]


def test_ratings_and_media(spark):
    r = spark.createDataFrame([("general",), ("Sensitive ",), ("questionable",), ("explicit",), ("x",), (None,)], "v string").select(media.mapped(F.col("v"), media.RATING_MAP).alias("r")).collect()
    assert [x.r for x in r] == ["sfw", "suggestive", "suggestive", "nsfw", "unrated", "unrated"]
    one = spark.range(1).select(media.frame_rate(F.lit("30000/1001")).alias("a"), media.frame_rate(F.lit("1/0")).alias("b"), media.vtt_time(F.lit(3661.5)).alias("t"), media.orientation(F.lit(0), F.lit(0)).alias("o"), media.ingest_orientation(F.lit(0), F.lit(0)).alias("i"), media.json_object_in(F.lit('x {"a": 1} y')).alias("j")).first()
    assert math.isclose(one.a, 29.97002997) and one.b is None and one.t == "01:01:01.500" and one.o is None and one.i == "landscape" and one.j == '{"a": 1}'


def test_paths_and_crops(spark):
    rows = [("library/Jane_Doe/sfw/a.jpg", "Jane_Doe", "sfw", "image"), ("_inbound_videos/Bo/x.mp4", "Bo", "unrated", "video"), ("_unsorted/nsfw/y.png", None, "nsfw", "image"), ("__macosx/._z.png", None, "unrated", "junk"), ("library", None, "unrated", "other")]
    p = F.col("p")
    got = spark.createDataFrame([(r[0],) for r in rows], "p string").select(p, media.person_from_path(p).alias("who"), media.rating_from_path(p).alias("rating"), media.file_kind(p).alias("kind")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))
    one = spark.range(1).select(media.slug(F.lit(" Jané Doe! ")).alias("a"), media.slug(F.lit("!!")).alias("b"), media.crop_rectangle(F.array(*map(F.lit, (0.4, 0.4, 0.1, 0.2))), F.lit(1000), F.lit(500)).alias("c"), media.sprite_count(F.lit(4.5), 2.0).alias("n"), media.argmax_label(F.create_map(F.lit("porn"), F.lit(0.2), F.lit("sexy"), F.lit(0.7))).alias("r")).first()
    assert (one.a, one.b, one.n, one.r) == ("Jané_Doe", "unknown", 2, "suggestive") and one.c == [340, 140, 560, 360]


def test_cue_lands_in_one_scene(spark):
    cues = spark.createDataFrame([(1, 0, 0, 10, "a"), (1, 1, 12, 20, "b"), (1, 2, 20, 40, "c")], "video long, turn int, start int, end int, text string")
    s = spark.createDataFrame([(1, 0, 0, 15), (1, 1, 15, 30), (1, 2, 30, 45)], "video long, scene long, lo int, hi int")
    assert sorted((r.text, r.scene) for r in scenes.cues_in_scenes(cues, s).collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.1)], "image_id long, value string, confidence double")
    new = spark.createDataFrame([(1, "a", 0.9), (3, "c", 0.2), (3, "c", 0.3), (None, "d", 0.4)], old.schema)
    got = sorted(map(str, (tuple(r) for r in writes.insert_or_ignore(old, new, ["image_id", "value"], [F.desc("confidence")]).collect())))
    assert got == sorted(map(str, [(1, "a", 0.5), (2, "b", 0.1), (3, "c", 0.3), (None, "d", 0.4)]))
    up = {r.image_id: (r.value, r.confidence) for r in writes.upsert_non_null(old, spark.createDataFrame([(1, None, 0.7)], old.schema), ["image_id"]).collect()}
    assert up == {1: ("a", 0.7), 2: ("b", 0.1)}


def test_boxes_pair_once(spark):
    s = "id long, label string, x1 double, y1 double, x2 double, y2 double"
    a = spark.createDataFrame([(1, "f", 0.0, 0.0, 5.0, 5.0), (1, "f", 1.0, 1.0, 6.0, 6.0)], s)
    b = spark.createDataFrame([(1, "f", 1.0, 0.0, 5.0, 5.0), (2, "f", 0.0, 0.0, 1.0, 1.0)], s)
    assert sorted(tuple(r) for r in parity.paired_boxes(a, b).collect()) == [(1, 2, 1, 1, 0, 1, 1.0), (2, 0, 1, 0, 0, 1, None)]
    near = spark.createDataFrame([(1, "f", 1.5, 0.0, 5.0, 5.0), (1, "f", 0.2, 0.0, 5.0, 5.0), (1, "g", 0.0, 0.0, 5.0, 5.0)], s)
    far = spark.createDataFrame([(1, "f", 50.0, 0.0, 5.0, 5.0)], s)
    assert tuple(parity.paired_boxes(a.limit(1), near).first()) == (1, 1, 3, 1, 0, 2, 0.2)
    assert tuple(parity.paired_boxes(a.limit(1), far).first()) == (1, 1, 1, 0, 1, 0, 50.0)


def test_back_ends(spark):
    import pandas as pd

    def tag(batches):
        for p in batches:
            yield pd.DataFrame({"id": p["id"], "category": "c", "value": "v", "confidence": 1.0, "tag_source": "t"})

    r = backends.Registry()
    r.add(backends.Backend("mine", {"tag": tag}, "trusted"))
    assert r.dispatch("mine", "tag", spark.range(3), "trusted").count() == 3
    with pytest.raises(PermissionError):
        r.dispatch("mine", "tag", spark.range(3))
    with pytest.raises(ValueError):
        r.dispatch("mine", "embed", spark.range(3), "public")
    with pytest.raises(ValueError):
        r.add(backends.Backend("mine", {}))


def test_streams(spark, tmp_path):
    from lumora.streaming import live

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.sql("SELECT id, timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id AS int)) AS ts, 1 AS person FROM range(10)").write.parquet(src)
    stream = spark.readStream.schema("id long, ts timestamp, person int").parquet(src)
    live.annotate(stream, lambda b: b.withColumn("tag", F.lit("x")), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 10
    assert live.sessions(spark.read.parquet(src)).first().n == 10


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 6), st.sampled_from("abc"), st.sampled_from("xyz")), max_size=20), st.dictionaries(st.sampled_from("abc"), st.lists(st.sampled_from("xyz"), min_size=1, max_size=2), max_size=2))
def test_facets_equal_a_recount(spark, rows, active):
    images = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    tags = spark.createDataFrame(rows, "image_id long, category string, value string")
    got = {(r.category, r.value): r.n for r in facets.tag_facets(images, tags, active).collect()}
    want = {}
    for i, c, v in rows:
        if all(any(x == i and k == a and w in active[a] for x, k, w in rows) for a in active if a != c):
            want.setdefault((c, v), set()).add(i)
    assert got == {k: len(v) for k, v in want.items()}


@pytest.mark.parametrize("at_once", [20_000, 1])
def test_every_item_has_its_nearest_place(spark, monkeypatch, at_once):
    """However far, across 180 degrees and at the poles."""
    monkeypatch.setattr(geo, "PLACES_AT_ONCE", at_once)
    gazetteer = spark.createDataFrame([("west", 0.0, -179.5), ("mid", 10.0, 100.0), ("north", 89.0, 10.0)], "name string, lat double, lon double")
    items = spark.createDataFrame([(1, 0.0, 179.0), (2, -60.0, 95.0), (3, 88.5, -170.0), (4, None, 3.0)], "id long, lat double, lon double")
    assert {r.id: r.name for r in geo.nearest_place(items, gazetteer).collect()} == {1: "west", 2: "mid", 3: "north"}

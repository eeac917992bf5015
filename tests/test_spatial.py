"""The k-d tree and the grid against all pairs."""

import numpy as np
import pytest

from lumora.operators import geo, grid
from lumora.operators.kdtree import KdTree, on_sphere


def places(n, seed=1):
    rng = np.random.default_rng(seed)
    towns = rng.uniform(-80, 80, (60, 2)) * [1, 2]
    spread = rng.normal(size=(n - n // 3, 2)) * rng.choice([0.02, 0.5, 3], (n - n // 3, 1)) + towns[rng.integers(0, 60, n - n // 3)]
    return np.concatenate((spread, rng.uniform(-90, 90, (n // 3, 2)) * [1, 2]))


def test_tree_finds_the_nearest_of_100_000_places_with_few_distances():
    x, q = places(100_000), places(6_000, 2)
    tree, items = KdTree(on_sphere(*x.T)), on_sphere(*q.T)
    i, j = tree.nearest(items)
    assert tree.evaluations / len(q) < 300
    want = np.concatenate([(items[a : a + 500] @ on_sphere(*x.T).T).max(axis=1) for a in range(0, len(q), 500)])
    got = np.full(len(q), -2.0)
    np.maximum.at(got, i, (items[i] * on_sphere(*x[j].T)).sum(axis=1))
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_equal_places_are_all_found():
    x = np.array([[1.0, 2.0]] * 50 + [[5.0, 5.0]] * 50)
    i, j = KdTree(on_sphere(*x.T)).nearest(on_sphere(np.array([1.0]), np.array([2.1])))
    assert set(i) == {0} and sorted(j) == list(range(50))


@pytest.mark.parametrize("at_once", [200_000, 700])
def test_whole_rows_of_nearest_places(spark, monkeypatch, at_once):
    """In one pass or several; of two places with one name the nearer one's row comes back."""
    monkeypatch.setattr(geo, "PLACES_AT_ONCE", at_once)
    x, q = places(3_000), places(400, 3)
    table = spark.createDataFrame([(f"n{k % 50}", float(a), float(b), k) for k, (a, b) in enumerate(x)], "name string, lat double, lon double, population long")
    items = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(q)], "id long, lat double, lon double")
    got = {r.id: r.population for r in geo.nearest_place(items, table).collect()}
    dot = on_sphere(*q.T) @ on_sphere(*x.T).T
    assert len(got) == 400 and all(dot[i, k] >= dot[i].max() - 1e-12 for i, k in got.items())


def test_no_places_give_no_rows(spark):
    items = spark.createDataFrame([(1, 1.0, 2.0)], "id long, lat double, lon double")
    assert geo.nearest_place(items, spark.createDataFrame([], "name string, lat double, lon double")).count() == 0


def plain_clusters(lat, lon, eps_km, least):
    """(start, start of the border) in scan order 0, 1, ... by breadth-first search over all pairs; -1 is noise."""
    x = on_sphere(lat, lon)
    reach = np.cos(eps_km / grid.EARTH_KM)
    near = [np.flatnonzero(x @ p >= reach) for p in x]
    core = np.array([len(n) >= least for n in near])
    label = np.full(len(x), -1)
    for p in range(len(x)):
        if core[p] and label[p] < 0:
            todo = [p]
            label[p] = p
            while todo:
                for r in near[todo.pop()]:
                    if label[r] < 0:
                        label[r] = p
                        if core[r]:
                            todo.append(r)
    return label


@pytest.mark.parametrize(("n", "eps", "least", "seed"), [(20_000, 2.0, 4, 1), (1500, 300.0, 3, 2), (800, 900.0, 6, 3), (60, 2.0, 1, 4), (60, 4000.0, 12, 5)])
def test_grid_clusters_equal_all_pairs(spark, n, eps, least, seed):
    """A segment of many spots in dense towns, along the date line and at the poles; border spots go to the first cluster."""
    rng = np.random.default_rng(seed)
    towns = np.concatenate((rng.uniform(-70, 70, (25, 2)) * [1, 2.5], [[89.9, 10], [89.9, -170], [0, 179.99], [0, -179.99], [-90, 0]]))
    deg = eps / 111
    lat, lon = (towns[rng.integers(0, len(towns), n)] + rng.normal(size=(n, 2)) * deg * rng.choice([0.3, 3, 25], (n, 1), p=[0.3, 0.4, 0.3])).T
    lat, lon = np.clip(lat, -90, 90), (lon + 180) % 360 - 180
    rows = [(1, float(a), float(b), 1, i) for i, (a, b) in enumerate(zip(lat, lon))]
    spots = spark.createDataFrame(rows, "g int, lat double, lon double, n int, first long").repartition(6)
    got = {r.first: -1 if r.start is None else r.start for r in grid.gps_dbscan(spots, ["g"], eps, least).select("first", "start").collect()}
    want = plain_clusters(lat, lon, eps, least)
    wrong = [i for i in range(n) if got[i] != want[i]]
    assert len(got) == n and not wrong and (len(set(want)) > 3 or eps > 3000)


def test_equally_large_clusters_by_their_first_member(spark):
    """Noise joins the largest cluster; of equal ones that whose first member (here a border item) comes first, though its core item comes later."""
    rows = [(1, 1.0, 0.0, 0.0), (2, 2.0, 0.0, 5.0), (3, 3.0, 0.0, 5.01), (4, 4.0, 0.0, 5.02), (5, 5.0, 0.0, 0.009), (6, 6.0, 0.0, 0.018), (7, 7.0, 50.0, 50.0), (8, 8.0, None, None)]
    items = spark.createDataFrame([(i, t, a, b, "p") for i, t, a, b in rows], "id long, t double, lat double, lon double, person string")
    got = {r.id: r.cluster for r in geo.events(items, gap=100, eps_km=1.2, least=3).collect()}
    assert got[1] == got[5] == got[6] and got[2] == got[3] == got[4] and got[1] != got[2]
    assert got[2] == 0 and got[7] == got[8] == got[1] == 1


def test_events_are_merged_not_broadcast(spark):
    """Spots, cells and events grow with the items: none goes whole through the driver, however small its file."""
    items = spark.createDataFrame([(i, i % 3, float(i * 900), 48.0 + i % 5 * 2, 11.0) for i in range(60)], "id long, person int, t double, lat double, lon double")
    some = geo.events(items, 21_600, 500.0, 2)
    events, members = geo.backfilled_events(items, 21_600, 500.0, 2)
    for df in (some, members):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert some.count() == members.count() == 60 and events.count() >= 3

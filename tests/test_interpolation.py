"""Linear interpolation and polygons of relations against brute force and closed forms."""

import itertools

import numpy as np
import pytest

from rainfold.operators import interpolation, polygonize


def brute(points, at):
    """Height at a place from the triangle whose circle holds no other point, or None outside the hull."""
    for some in itertools.combinations(range(len(points)), 3):
        a, b, c = points[list(some), :2]
        whole = 2 * ((b - a)[0] * (c - a)[1] - (b - a)[1] * (c - a)[0])
        bb, cc = ((b - a) ** 2).sum(), ((c - a) ** 2).sum()
        centre = a + np.array([(c - a)[1] * bb - (b - a)[1] * cc, (b - a)[0] * cc - (c - a)[0] * bb]) / whole
        others = np.delete(points[:, :2], some, axis=0)
        if ((others - centre) ** 2).sum(axis=1).min() < ((a - centre) ** 2).sum():
            continue
        w = interpolation.weights(points[None, some, :2], at[None])[0]
        if (w >= 0).all():
            return float(w @ points[list(some), 2])
    return None


@pytest.fixture(scope="module")
def scattered():
    rng = np.random.default_rng(3)
    return {s: np.column_stack([rng.random((24, 2)) * size, rng.random(24) * 9]) for s, size in (("a", 90.0), ("b", 300.0))}


@pytest.mark.parametrize("side", [15.0, 1000.0])
def test_linear_surface(spark, scattered, side):
    points = spark.createDataFrame([(s, *map(float, r)) for s, rows in scattered.items() for r in rows] + [("a", None, 1.0, 1.0), ("a", float("nan"), 1.0, 1.0), ("c", 1.0, 1.0, 1.0)], "survey string, x double, y double, z double")
    places = [(s, r, c, c * 13.0 + 0.5, r * 13.0 + 0.25) for s in ("a", "b", "c", "d") for r in range(7) for c in range(7)]
    got = interpolation.linear_surface(spark.createDataFrame(places, "survey string, row int, col int, x double, y double"), points, side).collect()
    assert len(got) == len(places)
    for r in got:
        want = brute(scattered[r["survey"]], np.array([r["x"], r["y"]])) if r["survey"] in scattered else None
        assert r["z"] == (None if want is None else pytest.approx(want, abs=1e-6))


def test_a_plane_is_kept_over_cocircular_points(spark):
    points = spark.createDataFrame([(1, float(x), float(y), 2.0 * x - y) for x in range(8) for y in range(8)], "survey int, x double, y double, z double")
    cells = spark.createDataFrame([(1, r, c, c * 0.5, r * 0.5) for r in range(15) for c in range(15)], "survey int, row int, col int, x double, y double")
    for r in interpolation.linear_surface(cells, points, 2.0).collect():
        assert r["z"] == pytest.approx(2 * r["x"] - r["y"], abs=1e-6)


def way(role, *at):
    return (role, [(float(x), float(y)) for x, y in at])


def test_relation_areas(spark):
    square = [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)]
    rows = [
        (1, [way("outer", *square[:3]), way("", *square[4:1:-1]), way("inner", (2, 2), (4, 2), (4, 4)), way("inner", (4, 4), (2, 2)), way("label", (0, 0), (1, 1))]),
        (2, [way("outer", *square[:4])]),
        (3, [way("outer", *square), way("outer", (9, 9), (12, 12))]),
        (4, [way(None, *square), way("outer", (9, 9), (12, 9), (12, 12), (9, 9)), way("outer", (0, 0), (9, 0))]),
        (5, [way("outer", *square), way("inner", (2, 2), (4, 2))]),
        (6, []),
        (7, [way("inner", *square)]),
        (8, [way("outer", *square), way("outer", (20, 0), (22, 0), (22, 2), (20, 0))]),
    ]
    df = spark.createDataFrame(rows, "relation_id bigint, members array<struct<role:string,geometry:array<struct<lon:double,lat:double>>>>")
    got = {r["relation_id"]: r for r in polygonize.relation_areas(df).collect()}

    def area(ring):
        return sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in itertools.pairwise(ring)) / 2

    assert {k: r["error"] for k, r in got.items()} == {1: None, 2: "incomplete_outer", 3: "incomplete_outer", 4: None, 5: "incomplete_inner", 6: "incomplete_outer", 7: "incomplete_outer", 8: None}
    assert {k: sorted(map(area, r["shells"])) for k, r in got.items() if r["error"] is None} == {1: [81.0], 4: [4.5, 81.0], 8: [2.0, 81.0]}
    assert [area(h) for h in got[1]["holes"]] == [2.0]
    assert all(ring[0] == ring[-1] for r in got.values() for ring in r["shells"])


@pytest.mark.parametrize("greedy", [200, 0])
def test_triangles_of_degenerate_points_end(greedy):
    """A cocircular grid, a sliver along the hull and a circle: every triangle's circle is empty, whichever pivots lead to it."""
    rng = np.random.default_rng(5)
    square = np.array([(i, j) for i in range(12) for j in range(12)], float)
    sliver = np.vstack([np.stack([np.linspace(0, 1000, 60), 1e-3 * np.sin(np.arange(60))], axis=1), [[500.0, 3.0]]])
    angle = np.linspace(0, 2 * np.pi, 41)[:-1]
    circle = np.vstack([np.stack([np.cos(angle), np.sin(angle)], axis=1), [[0.1, 0.05]]])
    for points in (square, sliver, circle):
        at = points.min(axis=0) + rng.random((200, 2)) * np.ptp(points, axis=0)
        found = interpolation.triangles(points, at, greedy)
        fine = found[:, 0] >= 0
        assert fine.any() and (found[fine] < len(points)).all()
        inside = interpolation.weights(points[found[fine]], at[fine])
        assert (inside > -1e-6).all()
        a, b, c = (points[found[fine]][:, k] for k in range(3))
        whole = 2 * ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0])
        bb, cc = ((b - a) ** 2).sum(axis=1), ((c - a) ** 2).sum(axis=1)
        centre = a + np.stack([(c - a)[:, 1] * bb - (b - a)[:, 1] * cc, (b - a)[:, 0] * cc - (c - a)[:, 0] * bb], axis=1) / whole[:, None]
        radius = np.hypot(*(a - centre).T)
        away = np.hypot(points[None, :, 0] - centre[:, None, 0], points[None, :, 1] - centre[:, None, 1])
        assert (away >= radius[:, None] * (1 - 1e-6)).all()

"""Lines that cross, touch or lie on each other are split where they meet; areas of map ways that cross without a vertex."""

from fractions import Fraction

import numpy as np
import pytest

from rainfold.operators import noding, polygonize

EDGES = "k string, x0 double, y0 double, x1 double, y1 double"


def pieces(spark, *edges, digits=9):
    rows = spark.createDataFrame([("a", *map(float, e)) for e in edges], EDGES)
    return sorted((r["x0"], r["y0"], r["x1"], r["y1"]) for r in noding.noded(rows, ["k"], digits).collect())


@pytest.mark.parametrize("shift", [0, -1000])
def test_ways_to_meet(spark, shift):
    def moved(*rows):
        return [tuple(v + shift for v in r) for r in rows]

    assert pieces(spark, *moved((0, 0, 4, 4), (4, 0, 0, 4))) == moved((0, 0, 2, 2), (0, 4, 2, 2), (2, 2, 4, 0), (2, 2, 4, 4))
    assert pieces(spark, *moved((0, 0, 4, 0), (1, 0, 1, 5))) == moved((0, 0, 1, 0), (1, 0, 1, 5), (1, 0, 4, 0))
    assert pieces(spark, *moved((0, 0, 4, 0), (6, 0, 2, 0))) == moved((0, 0, 2, 0), (2, 0, 4, 0), (4, 0, 6, 0))
    assert pieces(spark, *moved((0, 0, 900, 0), (3, 0, 5, 0))) == moved((0, 0, 3, 0), (3, 0, 5, 0), (5, 0, 900, 0))  # of unlike lengths
    assert pieces(spark, *moved((0, 0, 1, 0), (1, 0, 0, 0), (2, 2, 2, 2), (0, 3, 1, 3))) == moved((0, 0, 1, 0), (0, 3, 1, 3))


def test_odd_rows(spark):
    rows = spark.createDataFrame([("a", 0.0, 0.0, 2.0, 2.0), ("b", 0.0, 2.0, 2.0, 0.0), (None, 0.0, 0.0, 2.0, 2.0), (None, 0.0, 2.0, 2.0, 0.0), ("a", None, 0.0, 1.0, 1.0), ("a", float("nan"), 0.0, 1.0, 1.0), ("a", float("inf"), 0.0, 1.0, 1.0)], EDGES)
    got = noding.noded(rows, ["k"]).collect()
    assert sorted((r["k"] or "", r["x0"], r["y0"]) for r in got) == [("", 0.0, 0.0), ("", 0.0, 2.0), ("", 1.0, 1.0), ("", 1.0, 1.0), ("a", 0.0, 0.0), ("b", 0.0, 2.0)]
    assert noding.noded(rows.limit(0), ["k"]).count() == 0


def test_random_lines_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    short = [(x, y, x + dx, y + dy) for x, y, dx, dy in rng.integers(-8, 9, (60, 4)).tolist()]
    edges = [e for e in short + [tuple(e) for e in rng.integers(-300, 300, (15, 4)).tolist()] if e[:2] != e[2:]]
    exact = [tuple(map(Fraction, sorted((e[:2], e[2:]))[0] + sorted((e[:2], e[2:]))[1])) for e in set(edges)]

    def turn(e, x, y):
        return (e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0])

    want = set()
    for a in exact:
        at = {a[:2], a[2:]}
        for b in exact:
            at |= {p for p in (b[:2], b[2:]) if turn(a, *p) == 0 and a[0] <= p[0] <= a[2] and min(a[1], a[3]) <= p[1] <= max(a[1], a[3])}
            if turn(a, *b[:2]) * turn(a, *b[2:]) < 0 and turn(b, *a[:2]) * turn(b, *a[2:]) < 0:
                t = turn(b, *a[:2]) / (turn(b, *a[:2]) - turn(b, *a[2:]))
                at.add((a[0] + t * (a[2] - a[0]), a[1] + t * (a[3] - a[1])))
        stops = sorted(at)
        want |= {(*p, *q) for p, q in zip(stops, stops[1:])}
    got = pieces(spark, *edges)
    near = [sorted(tuple(round(float(v), 6) + 0.0 for v in e) for e in some) for some in (got, want)]
    assert len(near[0]) == len(near[1])
    np.testing.assert_allclose(*near, atol=2e-6)


def test_ways_of_a_relation_that_cross(spark):
    """Two outer squares that overlap without a common vertex cover their union; a hole is cut by its own crossing ways."""
    kind = "relation_id bigint, members array<struct<role:string,geometry:array<struct<lon:double,lat:double>>>>"

    def square(x, y, side):
        return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]

    rows = [(1, [("outer", square(0.0, 0.0, 4.0)), ("outer", square(2.0, 2.0, 4.0))]), (2, [("outer", square(0.0, 0.0, 4.0)), ("outer", [(1.0, 1.0), (9.0, 1.0)])]), (3, [("outer", [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)])])]
    got = {r["relation_id"]: r for r in polygonize.relation_areas(spark.createDataFrame(rows, kind)).collect()}

    def area(ring):
        return sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(ring, ring[1:])) / 2

    assert got[1]["error"] is None and sorted(map(area, got[1]["shells"])) == [4.0, 12.0, 12.0]
    assert got[2]["error"] == "incomplete_outer" and not got[2]["shells"]  # a way that ends in the open
    assert got[3]["error"] is None and sorted(map(area, got[3]["shells"])) == [4.0, 4.0]

"""Labels, rings and spatial joins that work by blocks give the same whatever the blocks are."""

import random

import numpy as np
import pytest

from rainfold.operators import graph, overlay, surfaces


def parts(cells, moves):
    left, out = set(cells), {}
    for start in sorted(cells):
        if start in left:
            left.discard(start)
            todo = [start]
            while todo:
                r, c = todo.pop()
                out[r, c] = start
                for dr, dc in moves:
                    if (r + dr, c + dc) in left:
                        left.discard((r + dr, c + dc))
                        todo.append((r + dr, c + dc))
    return out


SIDES = [(0, 1), (1, 0), (0, -1), (-1, 0)]


@pytest.mark.parametrize("side", [4, 512])
@pytest.mark.parametrize("diagonal", [False, True])
def test_grid_components(spark, side, diagonal):
    rng = random.Random(side)
    grids = {s: sorted({(rng.randrange(-6, 14), rng.randrange(-6, 14)) for _ in range(180)}) for s in ("a", "b")}
    df = spark.createDataFrame([(s, r, c) for s, cells in grids.items() for r, c in cells], "survey string, row int, col int")
    moves = SIDES + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    want = {(s, *cell): least for s, cells in grids.items() for cell, least in parts(cells, moves).items()}
    assert {(r["survey"], r["row"], r["col"]): (r["crow"], r["ccol"]) for r in graph.grid_components(df, diagonal, side).collect()} == want
    assert graph.grid_components(df.limit(0), diagonal, side).count() == 0


def test_rings_over_blocks(spark, monkeypatch):
    rng = random.Random(2)
    cells = [("a", r, c, rng.random() < 0.6) for r in range(12) for c in range(12)]
    df = spark.createDataFrame(cells, "survey string, row int, col int, high boolean")
    one = {str(r.asDict(True)) for r in surfaces.outline_polygons(df, "high").collect()}
    monkeypatch.setattr(graph, "RING_STEPS", 3)  # many blocks: rings come as paths that are joined
    many = {str(r.asDict(True)) for r in surfaces.outline_polygons(df, "high").collect()}
    assert one == many and len(one) > 1


def test_areas_and_crossings_of_edges():
    rng = np.random.default_rng(4)
    for _ in range(30):
        angle = np.sort(rng.random(9)) * 2 * np.pi
        xy = np.stack([np.cos(angle), np.sin(angle)], axis=1) * rng.uniform(1, 6, (9, 1)) + rng.uniform(-2, 2, 2)
        edges = np.hstack([xy, np.roll(xy, -1, axis=0)])
        left, low = (g.ravel() for g in np.meshgrid(np.arange(-9.0, 9.0), np.arange(-9.0, 9.0)))
        held = overlay.area_in(edges, left, low, left + 1, low + 1)
        whole = abs((edges[:, 0] * edges[:, 3] - edges[:, 2] * edges[:, 1]).sum()) / 2
        assert abs(held.sum() - whole) < 1e-9
        quiet = ~overlay.crosses(edges, left, low, left + 1, low + 1)
        assert np.allclose(held[quiet], overlay.covers(edges, left + 0.5, low + 0.5)[quiet])


@pytest.mark.parametrize("side", [3.0, 1000.0])
def test_pieces_keep_what_matters(side):
    """Distance, parity and area from a square's piece are those of the whole feature."""
    rng = np.random.default_rng(8)
    angle = np.sort(rng.random(40)) * 2 * np.pi
    xy = np.stack([np.cos(angle), np.sin(angle)], axis=1) * rng.uniform(4, 12, (40, 1))
    ring = np.vstack([xy, xy[:1]])
    hole = np.array([[-1, -1], [1, -1], [1, 1], [-1, 1], [-1, -1]], float)
    wholes = [overlay.edges_of([{"x": a, "y": b} for a, b in r]) for r in (ring, hole)]
    squares = {(bx, by): ([np.array(e).reshape(-1, 4) for e in near], [np.array(e).reshape(-1, 4) for e in band]) for bx, by, near, band in overlay._squares(wholes, 0.7, True, side)}
    at = rng.uniform(-13, 13, (600, 2))
    for x, y in at:
        want = bool(overlay.covers(wholes[0], np.array([x]), np.array([y]))[0] and not overlay.covers(wholes[1], np.array([x]), np.array([y]))[0])
        far = min(overlay.distance(e, np.array([x]), np.array([y]))[0] for e in wholes)
        piece = squares.get((int(np.floor(x / side)), int(np.floor(y / side))))
        if piece is None:
            assert not want and far > 0.7
        else:
            assert bool(overlay.inside(*piece, np.array([x]), np.array([y]))[0]) == want
            near = min(overlay.distance(e, np.array([x]), np.array([y]))[0] for e in piece[0])
            assert (near <= 0.7) == (far <= 0.7)


def test_sizes_of_sites(spark):
    from rainfold.operators import storage

    sites = spark.createDataFrame([(1, 60.0, 40.0, 1000.0), (2, 30.0, 20.0, 1000.0), (3, 29.0, 40.0, 1.0), (4, None, 40.0, 1.0), (5, 45.0, 30.0, None), (6, 60.0, 40.0, 3682.67)], "site int, max_length_m double, max_width_m double, target_m3 double")
    sizes = storage.site_sizes(sites)
    assert {r["site"]: r["count"] for r in sizes.groupBy("site").count().collect()} == {1: 18, 2: 2, 5: 8, 6: 18}
    got = {r["site"]: (r["meets_target"], r["capacity_m3"], r["next_capacity_m3"]) for r in storage.sizes_for_targets(sizes).collect()}
    assert got.keys() == {1, 2, 6} and got[1][0] and got[1][1] >= 1000 and got[1][2] > got[1][1]
    assert not got[2][0] and got[2][2] is None and got[6] == (True, 3682.67, None)
    tiers = {(r["site"], r["label"]): r["candidate"] for r in storage.site_tiers(sizes).collect()}
    assert [tiers[1, x] for x in ("small", "intermediate", "large")] == [0, 6, 12] and tiers[2, "small"] == 0

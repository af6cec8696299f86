"""Filling by a spill graph: equal to a flood of the whole, whatever the blocks, with a fixed number of tables of cells."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainfold.operators import hydrology, spill


def brute(z, valid, sink):
    """A flood of the whole grid from its rim, invalid cells and kept sinks."""
    level, heap = np.full(z.shape, np.inf), []
    rim = np.ones(z.shape, bool)
    rim[1:-1, 1:-1] = False
    for r, c in np.argwhere(rim | sink | ~valid):
        level[r, c] = z[r, c] if valid[r, c] else -np.inf
        heapq.heappush(heap, (level[r, c], r, c))
    while heap:
        v, r, c = heapq.heappop(heap)
        for a in range(max(r - 1, 0), min(r + 2, z.shape[0])):
            for b in range(max(c - 1, 0), min(c + 2, z.shape[1])):
                if level[a, b] == np.inf:
                    level[a, b] = max(z[a, b], v)
                    heapq.heappush(heap, (level[a, b], a, b))
    return level


def cells_of(spark, grids):
    rows = [(s, int(r), int(c), float(z[r, c]), bool(valid[r, c]), bool(sink[r, c])) for s, (z, valid, sink) in grids.items() for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "survey string, row int, col int, z double, valid boolean, sink boolean")


def filled(df, side):
    return {(r["survey"], r["row"], r["col"]): r["z_filled"] for r in hydrology.fill_depressions(df, side).collect()}


@pytest.mark.parametrize("side,most", [(4, 500_000), (4, 0), (1, 500_000)])
def test_blocks_give_the_whole_flood(spark, monkeypatch, side, most):
    monkeypatch.setattr(spill, "TASK_SPILLS", most)
    rng = np.random.default_rng(side + most)
    grids = {}
    for s, shape in (("a", (15, 18)), ("b", (9, 26)), (None, (8, 8)), ("line", (1, 9))):
        grids[s] = (np.floor(rng.random(shape) * 12), rng.random(shape) > 0.02, rng.random(shape) > 0.99)
    got = filled(cells_of(spark, grids), side)
    want = {(s, r, c): (v if valid[r, c] else None) for s, (z, valid, sink) in grids.items() for (r, c), v in np.ndenumerate(brute(z, valid, sink))}
    assert got == want


def test_a_channel_through_a_hundred_blocks_writes_the_cells_twice(spark, monkeypatch):
    n = 40
    z = np.full((n, n), 50.0)
    z[1:-1:2, 1:-1] = 1
    for k, r in enumerate(range(2, n - 2, 2)):
        z[r, -2 if k % 2 == 0 else 1] = 1
    z[0, 1] = 2
    whole = (z, np.ones(z.shape, bool), np.zeros(z.shape, bool))
    tables = []
    for module in (spill, hydrology):
        monkeypatch.setattr(module, "cut", lambda df, rows=None, old=module.cut: tables.append(old(df, rows)) or tables[-1])
    got = filled(cells_of(spark, {"g": whole}), 4)
    assert got == {("g", r, c): v for (r, c), v in np.ndenumerate(brute(*whole))}
    assert sum(t.count() >= n * n for t in tables) == 2


def test_bottlenecks_by_rounds_and_by_a_task(spark):
    """Ties, chains and parts without an outlet; both ways give the highest spill on the best way."""
    rng = np.random.default_rng(3)
    spills = {}
    for _ in range(150):
        x, y = sorted(rng.integers(0, 60, 2).tolist())
        if x != y:
            spills[x, y] = float(rng.integers(0, 9))
    spills |= {(7, None): 4.0, (31, None): 0.0, (100, 101): 1.0}
    best = {k: np.inf for pair in spills for k in pair if k is not None}
    for _ in best:
        for (x, y), h in spills.items():
            for a, b in ((x, y), (y, x)):
                if a is not None:
                    best[a] = min(best[a], max(h, -np.inf if b is None else best[b]))
    rows = [("s", x, 0, y, None if y is None else 0, h) for (x, y), h in spills.items()]
    df = spark.createDataFrame(rows, "survey string, xr bigint, xc bigint, yr bigint, yc bigint, h double")
    for most in (0, 10**6):
        assert {r["row"]: r["least"] for r in spill.label_levels(df, most).collect()} == best


def test_no_cells(spark):
    empty = spark.createDataFrame([], "survey string, row int, col int, z double, valid boolean, sink boolean")
    assert hydrology.fill_depressions(empty).where(F.lit(True)).count() == 0

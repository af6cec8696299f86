"""Accumulation and catchments over blocks are those of a walk along every path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainfold.operators import forest, graph, hydrology, sites
from rainfold.operators.raster import DIRECTIONS


def drained(spark, surveys=("a", None)):
    """Random grids whose cells drain to the lowest cell about them, with their receivers."""
    rng = np.random.default_rng(11)
    rows, down = [], {}
    for s, (high, wide) in zip(surveys, ((14, 17), (9, 9))):
        z = rng.random((high, wide)) + np.add.outer(np.arange(high), np.arange(wide)) * 0.2
        for r in range(high):
            for c in range(wide):
                around = [(z[r + dr, c + dc], code, r + dr, c + dc) for code, dr, dc in DIRECTIONS if 0 <= r + dr < high and 0 <= c + dc < wide]
                low = min(around)
                drains = low[0] < z[r, c]
                rows.append((s, r, c, int(low[1]) if drains else 0, bool(rng.random() < 0.9), {"note": s or "none"}))
                down[s, r, c] = (s, low[2], low[3]) if drains else None
    return spark.createDataFrame(rows, "survey string, row int, col int, fdir int, valid boolean, extra map<string,string>"), down


def path(down, at):
    while at is not None:
        yield at
        at = down[at]


@pytest.mark.parametrize("side,heavy", [(512, 1000), (4, 1000), (3, 2), (1, 1000)])
def test_sums_and_catchments(spark, monkeypatch, side, heavy):
    monkeypatch.setattr(graph, "HEAVY_ROWS", heavy)
    cells, down = drained(spark)
    valid = {(r["survey"], r["row"], r["col"]): r["valid"] for r in cells.collect()}
    want = dict.fromkeys(down, 0)
    for at in down:
        for low in path(down, at):
            want[low] += valid[at]
    flow = hydrology.flow_accumulation(cells, side)
    got = flow.collect()
    assert {(r["survey"], r["row"], r["col"]): r["acc"] for r in got} == want and len(got) == len(want)
    assert all(r["extra"] == {"note": r["survey"] or "none"} for r in got)

    node = {(r["survey"], r["row"], r["col"]): r["node"] for r in got}
    order = sorted(down, key=lambda at: (-want[at], str(at)))
    sites = {order[0]: [1, 2], order[1]: [3], order[7]: [4], order[40]: [2]}
    targets = [(s, node[s, r, c], k) for (s, r, c), ks in sites.items() for k in ks] * 2 + [("nowhere", 5, 9)]
    traced = hydrology.trace_catchments(flow, spark.createDataFrame(targets, "survey string, node bigint, site bigint"), side)
    met = [(at[0], node[at], k) for at in down for k in {k for low in path(down, at) for k in sites.get(low, [])}]
    assert sorted(map(tuple, traced.collect()), key=str) == sorted(met, key=str)


def test_a_cycle_across_blocks_is_an_error(spark):
    two = spark.createDataFrame([("g", 0, 0, 1, True), ("g", 0, 1, 16, True)], "survey string, row int, col int, fdir int, valid boolean")
    for side in (1, 2):
        with pytest.raises(ValueError, match="cycle"):
            hydrology.flow_accumulation(two, side)


def test_no_cells_and_no_targets(spark):
    cells, _ = drained(spark)
    none = spark.createDataFrame([], "survey string, node bigint, site bigint")
    assert hydrology.flow_accumulation(cells.limit(0)).count() == 0
    assert hydrology.trace_catchments(cells, none).count() == 0
    assert hydrology.trace_catchments(cells.limit(0), none.union(spark.range(1).select(F.lit("a"), F.lit(0), F.lit(1)))).count() == 0


@pytest.mark.parametrize("side,heavy", [(512, 1000), (4, 2), (1, 1000)])
def test_catchments_are_intervals(spark, monkeypatch, side, heavy):
    """Numbers of the walk tell what drains where; overlaps from them are those of sets of cells, also of sites of many cells."""
    monkeypatch.setattr(graph, "HEAVY_ROWS", heavy)
    cells, down = drained(spark)
    flow = hydrology.with_receiver(cells)
    node = {(r["survey"], r["row"], r["col"]): r["node"] for r in flow.collect()}
    toured = forest.tour(flow, side)
    number = {(r["survey"], r["node"]): (r["root"], r["first"], r["size"]) for r in toured.collect()}
    assert len(number) == len(down)
    inside = {at: {up for up in down if at in set(path(down, up))} for at in down}
    for at in down:
        root, first, size = number[at[0], node[at]]
        by_numbers = {x for x in down if x[0] == at[0] and number[x[0], node[x]][0] == root and first <= number[x[0], node[x]][1] < first + size}
        assert by_numbers == inside[at] and size == len(inside[at])

    rng = np.random.default_rng(5)
    known = sorted((at for at in down if at[0]), key=str)
    chosen = {k: [known[i] for i in rng.integers(0, len(known), 1 + k % 4)] for k in range(30)}
    chosen[30] = [at for at in known if down[at] is None]  # everything
    starts = spark.createDataFrame([(at[0], node[at], k) for k, some in chosen.items() for at in some], "survey string, node bigint, site bigint")
    sets = {k: set().union(*(inside[at] for at in some)) for k, some in chosen.items()}
    spanned = sites.spans(toured, starts)
    assert {(r["site"], r["n"]) for r in sites.span_sizes(spanned).collect()} == {(k, len(s)) for k, s in sets.items()}
    got = {(r["site_a"], r["site_b"]): r["iou"] for r in sites.overlaps(spanned).collect()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert got == pytest.approx(want)

    ranked = spark.createDataFrame([("a", k, *known[k][1:], len(sets[k]), float(k % 7)) for k in sets], "survey string, site bigint, row int, col int, area_cells bigint, score double")
    conflicts = sites.site_conflicts(ranked, sites.overlaps(spanned), 10.0, 25.0, 0.5)
    by_pairs = {(r["site"], r["rank"]) for r in sites.select_sites(ranked, conflicts, 4).collect()}
    assert by_pairs == {(r["site"], r["rank"]) for r in sites.select_apart(ranked, spanned, 10.0, 25.0, 0.5, 4).collect()} and by_pairs
    assert sites.select_apart(ranked.limit(0), spanned, 10.0).count() == 0


def test_no_walk_over_cycles_or_nothing(spark):
    two = spark.createDataFrame([("g", 0, 0, 1, True), ("g", 0, 1, 16, True)], "survey string, row int, col int, fdir int, valid boolean")
    with pytest.raises(ValueError, match="cycle"):
        forest.tour(hydrology.with_receiver(two), 1)
    assert forest.tour(hydrology.with_receiver(two.limit(0))).count() == 0

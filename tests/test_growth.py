"""What made queries grow faster than their tables: broadcasts of cells, a call for each small block, lines searched again for each cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainfold.functions import geodesy
from rainfold.operators import blocks, feasibility, forest, graph, hydrology, overlay, raster, sites, surfaces


def grid(spark, surveys, n=4):
    rows = [(s, r, c, float((s * 7 + r * 5 + c * 3) % 11), True) for s in range(surveys) for r in range(n) for c in range(n)]
    return spark.createDataFrame(rows, "survey long, row int, col int, z double, valid boolean")


def test_cells_are_not_broadcast(spark):
    """Written cells are small files, but much as a broadcast."""
    plan = hydrology.fill_depressions(grid(spark, 3))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftOuter, BuildRight" not in plan


def test_small_blocks_share_a_call(spark):
    calls = spark.sparkContext.accumulator(0)

    def kernel(cells, number):
        calls.add(1)
        assert len(set(zip(cells.column("survey").to_pylist(), number.tolist()))) == len(set(number.tolist()))
        return cells.select(["survey", "row", "col"])

    made = blocks.apply(grid(spark, 300), ["survey"], 4800, kernel, "survey long, row int, col int")
    assert made.distinct().count() == 4800 and calls.value < 10


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_no_arrays(spark):
    """Each cell of a line kept as an array took the whole line again."""
    cells = grid(spark, 2)
    assert "collect_list" not in plan_of(raster.smoothed(cells, 1.0))
    short = {(r["row"], r["col"]): r["z"] for r in raster.smoothed(cells.where("survey = 0 AND row < 1"), 1.0).collect()}
    assert len(short) == 4  # mirrored more than once, as the line is shorter than the weights


def test_no_frame_up_to_a_lines_end(spark):
    """Such a frame is summed up anew for each cell."""
    assert "unboundedfollowing" not in plan_of(raster.with_edge_distance(grid(spark, 2), 10.0)).lower()


def test_far_cells_meet_chunks_of_points(spark):
    points = spark.createDataFrame([("a", i, float(i * 37 % 61), float(i * 53 % 67), float(i)) for i in range(6000)], "survey string, id long, x double, y double, z double")
    cells = spark.createDataFrame([("a", r, 0, 30.0, float(r * 500), None) for r in range(9)], "survey string, row int, col int, x double, y double, z double")
    known = points.select("survey", F.col("id").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.lit(0).alias("bx"), F.lit(0).alias("by"))
    assert raster._chunks(known, 4000.0).count() > 10
    got = {r["row"]: r["z"] for r in raster.nearest_fill(cells, points, 20.0).collect()}
    for r in range(9):
        assert got[r] == min(range(6000), key=lambda i: ((30.0 - i * 37 % 61) ** 2 + (r * 500 - i * 53 % 67) ** 2, i))


def test_equal_boxes_meet_once(spark):
    records = spark.createDataFrame([(i, 0.0, 0.0, 1.0, 1.0, float(i)) for i in range(50)], "record_id long, south double, west double, north double, east double, at double")
    asked = spark.createDataFrame([(7, 0.25, 0.25, 0.5, 0.5, 100.0), (8, 0.25, 0.25, 0.5, 0.5, 60.0), (9, 0.25, 0.25, 0.5, 0.5, 10.0)], "query_id long, south double, west double, north double, east double, at double")
    made = surfaces.covering_cache(records, asked, 20.0)
    assert {r["query_id"]: r["record_id"] for r in made.collect()} == {8: 49, 9: 49}
    assert plan_of(made).split("Join")[-1].count("Aggregate") >= 2


def test_utm_works_values_out_once(spark):
    x, y = geodesy.to_utm(F.col("lon"), F.col("lat"), F.lit(31), F.lit(False))
    lon, lat = geodesy.from_utm(x, y, F.lit(31), F.lit(False))
    df = spark.createDataFrame([(3.25, 48.5)], "lon double, lat double").select(lon.alias("lon"), lat.alias("lat"))
    assert plan_of(df).lower().count("sinh") < 500
    got = df.first()
    assert abs(got["lon"] - 3.25) < 1e-9 and abs(got["lat"] - 48.5) < 1e-9


def test_small_surveys_are_followed_by_tasks(spark, monkeypatch):
    """What crosses blocks took some rounds of joins over all surveys' rows, however small each one is."""
    rows = [(s, r, c, 4 if c == 5 and r < 5 else 0 if r == 5 else 1, True) for s in (1, None) for r in range(-2, 6) for c in range(-3, 6)]
    cells = spark.createDataFrame(rows, "survey long, row int, col int, fdir int, valid boolean").where("survey = 1 OR row < 4")
    flow = hydrology.with_receiver(cells.withColumns({"row": F.col("row") + 2, "col": F.col("col") + 3}))
    low = F.lit(500)  # numbers of nodes may be below zero
    flow = flow.withColumns({"node": F.col("node") - low, "receiver": F.col("receiver") - low}).localCheckpoint()
    targets = flow.where("row = 5 AND col IN (2, 8) OR row = 0 AND col = 8").select("survey", "node", F.col("col").cast("long").alias("site"))

    def found():
        made = [forest.accumulation(flow, "valid", "acc", 3).select("survey", "node", "acc"), forest.marks_below(flow, targets, "site", 3), forest.tour(flow, 3)]
        return [sorted(map(tuple, m.collect()), key=str) for m in made]

    with monkeypatch.context() as m:
        m.setattr(forest, "TASK_CROSSINGS", 45)  # one survey is larger
        mixed = found()
    for name in ("subtree_sums", "marks_ahead", "path_sums"):
        monkeypatch.setattr(graph, name, lambda *_: pytest.fail("rounds over rows"))
    assert found() == mixed and all(mixed)


def test_tasks_of_neighbours_go_by_cells(spark, monkeypatch):
    """Files of cells that compress well made few tasks, whose memory grew with the table."""
    monkeypatch.setattr(raster, "TASK_CELLS", 100)
    near = raster.with_neighbours(grid(spark, 60), "z")
    assert plan_of(near).count("Exchange hashpartitioning") == 2 and near.rdd.getNumPartitions() == 10
    first = near.where("survey = 2 AND row = 1 AND col = 0").first()["near"]
    assert [n and n["z"] for n in first] == [float((14 + r * 5 + c * 3) % 11) if c >= 0 else None for r, c in ((1, 1), (2, 1), (2, 0), (2, -1), (1, -1), (0, -1), (0, 0), (0, 1))]


def test_tasks_of_levels_go_by_cells(spark, monkeypatch):
    monkeypatch.setattr(hydrology, "TASK_CELLS", 100)
    assert hydrology.fill_depressions(grid(spark, 60)).rdd.getNumPartitions() == 10


def watched(monkeypatch):
    """What `blocks.joined` gets and makes from now on."""
    seen, old = [], blocks.joined
    monkeypatch.setattr(blocks, "TASK_CELLS", 100)
    monkeypatch.setattr(blocks, "joined", lambda cells, *more: seen.append((cells, old(cells, *more))) or seen[-1][1])
    return seen


def test_spills_are_asked_only_beyond_a_block(spark, monkeypatch):
    """Cells of small blocks asked their neighbours in the same block too, in tasks by the session's partitions."""
    seen = watched(monkeypatch)
    hydrology.fill_depressions(grid(spark, 60), 2)
    (asked, met), (_, raised) = seen
    assert asked.where("col BETWEEN 0 AND 3 AND row BETWEEN 0 AND 3").count() == met.count() == 60 * (4 + 4 + 2 * 5)
    assert met.rdd.getNumPartitions() == raised.rdd.getNumPartitions() == 10


def caught(spark):
    """Cells of 60 surveys, one of them without a name, and a catchment of each."""
    cells = grid(spark, 60).withColumns({"node": (F.col("row") * 4 + F.col("col")).cast("long"), "boundary": F.col("col") == 0, "z_filled": F.col("z") + 1, "water": F.col("row") == 1})
    cells = cells.withColumn("survey", F.when(F.col("survey") != 7, F.col("survey"))).localCheckpoint()
    return cells, cells.where("col < 2").select("survey", "node", F.lit(1).cast("long").alias("site"))


def test_tasks_of_catchments_go_by_cells(spark, monkeypatch):
    """Cells of catchments met their cells in tasks by the session's partitions, whose memory grew with the table."""
    seen, (cells, traced) = watched(monkeypatch), caught(spark)
    assert {(r["cells"], r["boundary_truncated"]) for r in hydrology.catchment_areas(traced, cells, 10.0).collect()} == {(8, True)}
    assert seen[0][1].rdd.getNumPartitions() == 10


def test_tasks_of_assessments_go_by_cells(spark, monkeypatch):
    """Two catchments were joined with each other and then with the cells, which dealt them anew by the session's partitions."""
    monkeypatch.setattr(blocks, "TASK_CELLS", 100)
    cells, traced = caught(spark)
    other = cells.where("col IN (1, 2)").select("survey", "node", F.lit(1).cast("long").alias("site"))
    plan = sites.assessment(traced, other, cells, 960)
    assert plan_of(plan).count("REPARTITION_BY_NUM, [") == 2 and plan_of(plan).count("Exchange hashpartitioning") == 3
    assert {(r["survey"] is None, r["filled_cells"], r["additional_area_fraction"], r["routing_sensitivity_fraction"], r["upstream_water_fraction"]) for r in plan.collect()} == {(n, 8, 0.5, 1.0, 0.25) for n in (False, True)}


def test_outlines_are_not_broadcast(spark, monkeypatch):
    """Edges and cells compress to few bytes, so the planner broadcast millions of them."""
    seen = []
    for module in (surfaces, graph):
        monkeypatch.setattr(module, "cut", lambda df, *more, old=module.cut: seen.append(plan_of(df)) or old(df, *more))
    monkeypatch.setattr(graph, "FEW_ROWS", 0)
    monkeypatch.setattr(graph, "RING_STEPS", 3)
    cells = grid(spark, 3, 5).withColumn("survey", F.when(F.col("survey") != 1, F.col("survey"))).where("row NOT IN (1, 3) OR col IN (0, 4)")
    made = surfaces.outline_polygons(cells.where("survey IS NULL OR survey = 2 AND row < 3"), "valid")
    assert {r["survey"]: (r["area"], len(r["holes"])) for r in made.collect()} == {None: (19.0, 2), 2: (12.0, 1)}
    assert len(seen) > 8 and not any("BroadcastExchange" in p for p in [*seen, plan_of(made)])


def test_outlines_of_repeated_cells(spark):
    cells = grid(spark, 1, 3).where("row <> 1 OR col <> 1")
    assert sorted(r["area"] for r in surfaces.outline_rings(surfaces.outline_edges(cells.union(cells), "valid")).collect()) == [-1.0, 9.0]


def test_ponds_meet_many_waters_at_once(spark, monkeypatch):
    """Each group of ponds met each water of its square in a row of its own, also those that the first had settled."""
    rng = np.random.default_rng(8)
    box = [{"x": x, "y": y} for x, y in ((-900.0, -900.0), (900.0, -900.0), (900.0, 900.0), (-900.0, 900.0), (-900.0, -900.0))]
    lands = spark.createDataFrame([("a", 1, box)], "survey string, land_id long, ring array<struct<x:double,y:double>>")
    made = [(f"p{i}", float(x), float(y), float(b)) for i, (x, y, b) in enumerate(zip(rng.uniform(2, 250, 120), rng.uniform(2, 120, 120), rng.uniform(0, 360, 120)))]
    ponds = spark.createDataFrame(made, "design_id string, x double, y double, bearing double").withColumns({"survey": F.lit("a"), "land_id": F.lit(1).cast("long"), "length_m": F.lit(12.0), "width_m": F.lit(9.0), "depth_m": F.lit(1.0), "side_slope": F.lit(2.0), "freeboard_m": F.lit(0.3), "margin_m": F.lit(1.0), "water_known": F.lit(True)})
    lines = [(np.array([(x, y), (x + 4, y + 3), (x + 2, y + 7)]), bool(i % 2)) for i, (x, y) in enumerate(rng.uniform(0, 60, (40, 2)))]
    features = [("a", [{"x": float(x), "y": float(y)} for x, y in [*line, *line[: int(area)]]], area, "6" if area else None) for line, area in lines]
    water = spark.createDataFrame(features, "survey string, line array<struct<x:double,y:double>>, area boolean, width string")
    seen, old = [], overlay.settled
    monkeypatch.setattr(overlay, "settled", lambda joined, *more: seen.append(joined.count()) or old(joined, *more))

    def dry():
        return {r["design_id"] for r in feasibility.pond_feasibility(ponds, lands, water, 5.0, 64.0).where("avoids_mapped_water").collect()}

    ids, x, y, bearing = zip(*made)
    wet = np.zeros(len(ids), bool)
    for f in features:
        edges = overlay.edges_of(f[1])
        wet |= feasibility.box_distance(feasibility.turned(edges, np.array(x), np.array(y), np.array(bearing)), np.full(len(ids), 5.5), np.full(len(ids), 7.0)) <= 5.0
        wet |= overlay.covers(edges, np.array(x), np.array(y)) & f[2]
    want = {i for i, w in zip(ids, wet) if not w}
    assert dry() == want and 20 < len(want) < 110 and seen[0] <= 8  # a row for each square
    monkeypatch.setattr(overlay, "CROWD_ROWS", 7)
    monkeypatch.setattr(overlay, "CHUNK_EDGES", 10)
    assert dry() == want and seen[1] > 50

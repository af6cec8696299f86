"""Lands, ponds, public terrain, mapped water and raster steps on small cases, among them the declared work size of 500 x 500 cells."""

import heapq
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_invariants import array, grid

from rainfold.functions import geodesy, geometry
from rainfold.operators import feasibility, graph, hydrology, raster, sites, storage, surfaces, terrain
from rainfold.plans import analysis
from rainfold.sources import readers
from rainfold.streaming import rain

RING = "array<struct<x:double,y:double>>"
SQUARE = [(0.0, 0.0), (400.0, 0.0), (400.0, 400.0), (0.0, 400.0), (0.0, 0.0)]


def flooded(z):
    """Brute-force priority flood."""
    level, heap = np.full(z.shape, np.inf), []
    for r in range(z.shape[0]):
        for c in range(z.shape[1]):
            if r in (0, z.shape[0] - 1) or c in (0, z.shape[1] - 1):
                level[r, c] = z[r, c]
                heapq.heappush(heap, (z[r, c], r, c))
    while heap:
        v, r, c = heapq.heappop(heap)
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                a, b = r + dr, c + dc
                if 0 <= a < z.shape[0] and 0 <= b < z.shape[1] and level[a, b] == np.inf:
                    level[a, b] = max(z[a, b], v)
                    heapq.heappush(heap, (level[a, b], a, b))
    return level


def test_a_serpentine_of_the_declared_size(spark):
    n = 500
    z = np.full((n, n), 50.0)
    z[1:-1:2, 1:-1] = 1
    for k, r in enumerate(range(2, n - 2, 2)):
        z[r, -2 if k % 2 == 0 else 1] = 1
    z[0, 1] = 2
    z[5::20, 7::13] -= 0.5
    cells = spark.range(n * n).select(F.lit("g").alias("survey"), F.floor(F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"), F.lit(True).alias("valid"))
    heights = spark.createDataFrame([(r, [float(x) for x in z[r]]) for r in range(n)], "row int, zs array<double>")
    made = cells.join(heights, "row").withColumn("z", F.col("zs")[F.col("col")]).drop("zs")
    assert (array(hydrology.fill_depressions(made), "z_filled", (n, n)) == flooded(z)).all()


def test_flats_drain_the_shortest_way(spark):
    z = np.full((9, 150), 5.0)
    z[4, 149] = 4.0
    flow = hydrology.flow_direction(grid(spark, z), 10.0, flats=True)
    assert (array(flow, "fdir", z.shape) > 0).sum() == z.size - 1  # all drain to the one way down
    steps = hydrology.flow_accumulation(flow)
    assert array(steps, "acc", z.shape)[4, 149] == z.size
    small = hydrology._resolve_flats  # blocks of any size give the same slopes
    base = hydrology._prepared(grid(spark, np.floor(np.random.default_rng(3).random((17, 19)) * 3))).withColumn("s", F.col("z"))
    sloped = raster.with_neighbours(base, "s", "valid").withColumn("slopes", hydrology._slopes(10.0))
    whole = {(r["row"], r["col"]): r["slopes"] for r in small(sloped, 10.0).collect()}
    assert whole == {(r["row"], r["col"]): r["slopes"] for r in small(sloped, 10.0, side=5).collect()}


def test_distance_lines():
    rng = np.random.default_rng(2)
    for _ in range(200):
        g = rng.integers(0, 30, int(rng.integers(1, 40))).astype(float)
        if rng.random() < 0.3:
            g[rng.random(len(g)) < 0.6] = 1e9
        i = np.arange(len(g))
        want = ((i[:, None] - i[None, :]) ** 2 + g[None, :] ** 2).min(axis=1)
        assert np.allclose(raster.nearest_squared(g), want)


def test_edge_distance_without_padding(spark):
    valid = np.ones((4, 6), bool)
    valid[1, 2] = False
    got = array(raster.with_edge_distance(grid(spark, np.zeros((4, 6)), valid), 10.0, padded=False), "edge_distance_m", (4, 6))
    want = [[math.hypot(r - 1, c - 2) * 10 for c in range(6)] for r in range(4)]
    assert np.allclose(got, want)
    assert np.isinf(array(raster.with_edge_distance(grid(spark, np.zeros((2, 2))), 10.0, padded=False), "edge_distance_m", (2, 2))).all()


def test_many_designs_in_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(storage, "GROUP_ROWS", 300)
    days = spark.createDataFrame([(f"2024-01-{d:02d}", float(d % 7 * 10)) for d in range(1, 31)], "day string, rain_mm double").withColumn("day", F.to_date("day"))
    one = storage.candidate_grid(spark).where("candidate = 3").withColumns({"side_slope": F.lit(2.0), "runoff_area_m2": F.lit(4000.0), "runoff_coefficient": F.lit(0.3), "evaporation_mm_day": F.lit(4.0), "seepage_mm_day": F.lit(1.0), "demand_m3_day": F.lit(5.0), "initial_storage_fraction": F.lit(0.5)})
    many = one.withColumn("design_id", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("design_id", F.col("design_id").cast("long"))
    got = storage.daily_balance(many, days)
    assert got.count() == 3000 and got.groupBy("day").agg(F.countDistinct("end_storage_m3").alias("n")).where("n > 1").isEmpty()
    left = storage.totals(storage.monthly(got)).agg(F.max(F.abs("residual_m3")).alias("m")).first()["m"]
    assert left < 1e-7


def designs(spark, *rows):
    names = "survey string, design_id int, land_id int, x double, y double, length_m double, width_m double, depth_m double, bearing double, side_slope double, freeboard_m double, margin_m double, water_known boolean"
    return spark.createDataFrame([("g", i, *r) for i, r in enumerate(rows)], names)


def test_pond_feasibility(spark):
    usual = (40.0, 30.0, 2.0)
    rows = [
        (1, 200.0, 200.0, *usual, 0.0, 2.0, 0.5, 5.0, True),  # fits
        (1, 20.0, 200.0, *usual, 0.0, 2.0, 0.5, 5.0, True),  # margin ends on the land's edge
        (1, 19.9, 200.0, *usual, 0.0, 2.0, 0.5, 5.0, True),  # margin beyond it
        (1, 20.0, 200.0, *usual, 90.0, 2.0, 0.5, 5.0, True),  # turned, so beyond it
        (1, 200.0, 200.0, *usual, 0.0, 2.0, 0.5, 5.0, False),  # water not known
        (1, 300.0, 300.0, *usual, 30.0, 2.0, 0.5, 5.0, True),  # about the hole
        (1, 200.0, 85.0, *usual, 0.0, 2.0, 0.5, 5.0, True),  # within the river's reach
        (1, 100.0, 300.0, *usual, 0.0, 2.0, 0.5, 5.0, True),  # inside the lake
        (2, 200.0, 200.0, *usual, 0.0, 2.0, 0.5, 5.0, True),  # no such land
        (1, 200.0, 200.0, 40.0, 30.0, 0.6, 0.0, 2.0, 0.6, 5.0, True),
        (1, 200.0, 200.0, 40.0, 8.0, 2.0, 0.0, 2.0, 0.5, 5.0, True),
        (1, 200.0, 200.0, 4.0, 30.0, 2.0, 0.0, 2.0, 0.5, 5.0, True),
        (1, 110.0, 310.0, 6.0, 5.0, 1.0, 0.0, 1.0, 0.5, 1.0, True),  # on the lake's island, off its shores
    ]
    hole = [(299.0, 299.0), (301.0, 299.0), (300.0, 301.0), (299.0, 299.0)]
    lands = spark.createDataFrame([("g", 1, SQUARE, [hole])], f"survey string, land_id int, ring {RING}, holes array<{RING}>")
    lake = [(60.0, 260.0), (160.0, 260.0), (160.0, 360.0), (60.0, 360.0), (60.0, 260.0)]
    island = [(85.0, 285.0), (135.0, 285.0), (135.0, 335.0), (85.0, 335.0), (85.0, 285.0)]
    water = spark.createDataFrame([("g", 1, [(0.0, 50.0), (400.0, 50.0)], [], False, "8 m"), ("g", 2, lake, [island], True, None)], f"survey string, feature_id int, line {RING}, holes array<{RING}>, area boolean, width string")
    got = {r["design_id"]: r for r in feasibility.pond_feasibility(designs(spark, *rows), lands, water, 12.0).collect()}
    status = [got[i]["screening_status"] for i in range(len(rows))]
    assert status[:5] == ["passes_checks", "passes_checks", "does_not_fit", "does_not_fit", "unverified"]
    assert status[5:9] == ["does_not_fit"] * 4 and status[9:12] == ["invalid"] * 3 and status[12] == "passes_checks"
    assert got[4]["avoids_mapped_water"] is None and got[4]["within_selected_land"] and got[6]["avoids_mapped_water"] is False
    assert got[5]["avoids_mapped_water"] is None and [got[i]["error"] for i in (9, 10, 11)] == ["freeboard_too_large", "no_bottom", "length_m"]


def test_runoff_area_counts_what_lies_inside(spark):
    cells = spark.createDataFrame([("g", i, float(i % 10 * 10 + 5), float(i // 10 * 10 + 5)) for i in range(100)], "survey string, node long, x double, y double")
    caught = cells.where("x < 50").select("survey", "node", F.lit(1).cast("long").alias("site"))
    ponds = spark.createDataFrame([("g", 1, 1, 25.0, 50.0, 20.0, 10.0, 0.0), ("g", 1, 2, 50.0, 50.0, 20.0, 10.0, 0.0), ("g", 1, 3, 90.0, 50.0, 20.0, 10.0, 0.0), ("g", 1, 4, 25.0, 25.0, 20.0, 10.0, 37.0)], "survey string, site long, design_id long, x double, y double, length_m double, width_m double, bearing double")
    got = {r["design_id"]: r["runoff_area_m2"] for r in feasibility.runoff_area(caught, cells, ponds, 10.0).collect()}
    assert [got[i] for i in (1, 2, 3)] == [4800.0, 4900.0, 5000.0] and got[4] == pytest.approx(4800.0)


def test_windows_and_tiles(spark):
    lands = spark.createDataFrame([(1, 10.0, 20.0, 100.0, 95.0, 6750.0), (2, 0.0, 0.0, 15001.0, 10.0, 1.0), (3, 0.0, 0.0, 6000.0, 6000.0, 26e6), (4, 0.0, float("nan"), 1.0, 1.0, 1.0)], "land_id int, min_x double, min_y double, max_x double, max_y double, area_m2 double")
    got = {r["land_id"]: r for r in terrain.window_grid(lands, 2000.0).collect()}
    assert (got[1]["left"], got[1]["bottom"], got[1]["right"], got[1]["top"], got[1]["width"], got[1]["height"]) == (-1990 // 30 * 30, -1980, 2100, 2100, 137, 136) and got[1]["error"] is None
    assert [got[i]["error"] for i in (2, 3, 4)] == ["too_large", "too_large", "not_finite"] and got[2]["left"] is None
    with pytest.raises(ValueError):
        terrain.window_grid(lands, -1.0)
    box = spark.createDataFrame([(1, 17.9995, 80.5, 18.5, 81.0004)], "id int, south double, west double, north double, east double")
    assert {(r["tile_lat"], r["tile_lon"]) for r in terrain.tiles_of(box).collect()} == {(17, 80), (18, 80), (17, 81), (18, 81)}
    with pytest.raises(Exception, match="too many terrain tiles"):
        terrain.tiles_of(box.withColumn("east", F.lit(90.0))).collect()


def test_bilinear_heights_over_a_seam(spark):
    samples = spark.createDataFrame([("g", 0, 0, 10.0), ("g", 0, 1, 20.0), ("g", 1, 0, 30.0), ("g", 1, 1, 40.0), ("g", 0, 2, None), ("g", 1, 2, float("nan"))], "survey string, row int, col int, z double")
    asked = spark.createDataFrame([("g", 1, 0.5, 0.5), ("g", 2, 0.0, 1.0), ("g", 3, 0.5, 1.5), ("g", 4, 5.0, 5.0), ("g", 5, 0.25, 0.75)], "survey string, point int, r double, c double")
    got = {r["point"]: r["z"] for r in terrain.bilinear(samples, asked).collect()}
    assert got == {1: 25.0, 2: 20.0, 3: 30.0, 4: None, 5: 22.5}


def test_expansion(spark):
    def sites_of(truncated):
        return spark.createDataFrame([(1, truncated)], "site int, boundary_truncated boolean")

    assert analysis.expanded_sites(lambda b: sites_of(False))[1:] == (2000.0, "not_needed")
    assert analysis.expanded_sites(lambda b: sites_of(b < 3000))[1:] == (4000.0, "expanded")
    assert analysis.expanded_sites(lambda b: sites_of(True))[1:] == (4000.0, "limit_reached")

    def fails_wide(b):
        if b > 3000:
            raise ValueError("no terrain")
        return sites_of(True)

    found, buffer_m, status = analysis.expanded_sites(fails_wide)
    assert (found.count(), buffer_m, status) == (1, 2000.0, "unavailable")
    with pytest.raises(ValueError, match="none at all"):
        analysis.expanded_sites(lambda b: (_ for _ in ()).throw(ValueError("none at all")))


@pytest.mark.parametrize("value", [True, "x", None, math.nan, math.inf, 4.9, 501, [1]])
def test_numbers_out_of_limits(value):
    with pytest.raises(ValueError, match="length_m must be a number"):
        analysis.number({"length_m": value}, "length_m", None, 5, 500)
    assert analysis.number({"length_m": "40"}, "length_m", None, 5, 500) == 40 and analysis.number({}, "length_m", 6, 5, 500) == 6


LAKE_XML = """<osm>{nodes}
<way id="1"><nd ref="1"/><nd ref="2"/><nd ref="3"/></way><way id="2"><nd ref="3"/><nd ref="4"/><nd ref="1"/></way>
<way id="3"><nd ref="5"/><nd ref="6"/><nd ref="7"/><nd ref="8"/><nd ref="5"/></way>
<way id="4"><nd ref="1"/><nd ref="99"/><tag k="waterway" v="river"/></way>
<relation id="7"><member type="way" ref="1" role="outer"/><member type="way" ref="2" role="outer"/><member type="way" ref="3" role="inner"/><member type="node" ref="1" role=""/><tag k="natural" v="water"/></relation>
<relation id="8"><member type="way" ref="1" role="outer"/><tag k="natural" v="water"/></relation></osm>"""


def test_a_lake_with_an_island_from_map_xml(spark, tmp_path):
    epsg, x0, y0 = 32644, 500000.0, 2000000.0
    at = {1: (20, 20), 2: (180, 20), 3: (180, 180), 4: (20, 180), 5: (60, 60), 6: (140, 60), 7: (140, 140), 8: (60, 140)}
    lon, lat = geodesy.from_utm(F.col("x") + x0, F.col("y") + y0, F.lit(44), F.lit(False))
    places = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in at.items()], "id int, x double, y double").select("id", lon.alias("lon"), lat.alias("lat")).collect()
    nodes = "".join(f'<node id="{r["id"]}" lon="{r["lon"]!r}" lat="{r["lat"]!r}"/>' for r in places)
    (tmp_path / "map.osm").write_text(LAKE_XML.format(nodes=nodes))
    read = {k: readers.osm_objects(spark, str(tmp_path), k) for k in ("node", "way", "relation")}
    ways = surfaces.assemble_ways(read["node"], read["way"])
    found = surfaces.water_features(ways, surfaces.assemble_relations(read["relation"], ways))
    errors = {r["feature_id"]: r["error"] for r in found.collect()}
    assert errors == {"relation/7": None, "relation/8": "incomplete_outer", "way/4": "missing_geometry"}
    metres = surfaces.in_metres(found.where("error IS NULL"), epsg).withColumn("survey", F.lit("g"))
    cells = spark.range(20 * 20).select(F.lit("g").alias("survey"), F.floor(F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col")).withColumns({"x": x0 + F.col("col") * 10 + 5, "y": y0 + F.col("row") * 10 + 5})
    wet = {(r["row"], r["col"]) for r in surfaces.water_mask(cells, metres, 0.0, 1.0).collect()}
    lake = {(r, c) for r in range(2, 18) for c in range(2, 18)}
    assert wet == lake - {(r, c) for r in range(6, 14) for c in range(6, 14)}
    # the same from a JSON answer that carries its geometry
    line = {r["id"]: {"lon": r["lon"], "lat": r["lat"]} for r in places}
    member = [{"type": "way", "ref": i, "role": role, "geometry": [line[k] for k in ks]} for i, role, ks in ((1, "outer", (1, 2, 3)), (2, "outer", (3, 4, 1)), (3, "inner", (5, 6, 7, 8, 5)))]
    answer = {"elements": [{"type": "relation", "id": 7, "tags": {"natural": "water"}, "members": member}, {"type": "way", "id": 4, "tags": {"waterway": "river"}, "geometry": [line[1], {"lon": None, "lat": 1.0}]}]}
    again = surfaces.water_features(*readers.elements_of_json(spark.createDataFrame([(json.dumps(answer),)], "value string")))
    assert {r["feature_id"]: r["error"] for r in again.collect()} == {"relation/7": None, "way/4": "missing_geometry"}
    back = surfaces.in_metres(again.where("error IS NULL"), epsg).withColumn("survey", F.lit("g"))
    assert {(r["row"], r["col"]) for r in surfaces.water_mask(cells, back, 0.0, 1.0).collect()} == wet
    with pytest.raises(Exception, match="incomplete"):
        readers.elements_of_json(spark.createDataFrame([('{"remark": "timed out", "elements": []}',)], "value string"))[0].collect()


def test_outline_polygons_in_degrees(spark):
    high = np.zeros((9, 12), bool)
    high[0:5, 0:5] = True
    high[2, 2] = False
    high[7:9, 9:11] = True
    high[5, 5] = True  # touches the first part at a corner only
    made = surfaces.outline_polygons(grid(spark, np.zeros((9, 12)), high), "valid")
    rows = {(r["component"]["row"], r["component"]["col"]): r for r in made.collect()}
    assert {k: (r["area"], len(r["holes"])) for k, r in rows.items()} == {(0, 0): (24.0, 1), (5, 5): (1.0, 0), (7, 9): (4.0, 0)}
    assert len(rows[0, 0]["shell"]) == 21 and rows[0, 0]["shell"][0] == rows[0, 0]["shell"][-1] and len(rows[0, 0]["holes"][0]) == 5
    degrees = surfaces.in_degrees(made, 32644, 500000.0, 2000000.0, 10.0)
    big = surfaces.largest_outline(degrees).first()["shell"]
    x, y = geodesy.to_utm(F.col("p.x"), F.col("p.y"), F.lit(44), F.lit(False))
    back = spark.createDataFrame([(p["x"], p["y"]) for p in big], "x double, y double").select(F.struct("x", "y").alias("p")).select(x.alias("x"), y.alias("y")).collect()
    assert {(round((r["x"] - 499995) / 10, 4), round((r["y"] - 1999995) / 10, 4)) for r in back} <= {(float(a), float(b)) for a in range(6) for b in range(6)}
    ring = surfaces.terrain_outline(spark.createDataFrame([(500000.0, 2000000.0, 500100.0, 2000050.0)], "min_x double, min_y double, max_x double, max_y double"), 32644, 10.0).first()["ring"]
    assert len(ring) == 5 and ring[0] == ring[-1] and ring[0]["x"] < ring[1]["x"] and ring[1]["y"] < ring[2]["y"]


def test_centroid_and_ring_order(spark):
    ell = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0), (0.0, 0.0)]
    x, y = geometry.centroid(F.col("ring"))
    got = spark.createDataFrame([(ell,), ([(1.0, 1.0), (2.0, 2.0), (1.0, 1.0)],)], f"ring {RING}").select(x.alias("x"), y.alias("y")).collect()
    assert (got[0]["x"], got[0]["y"]) == (pytest.approx(9 / 6), pytest.approx(1.0)) and got[1]["x"] is None
    order = [5, 3, 9, 1, 7]
    step = spark.createDataFrame([("a", order[i], order[(i + 1) % 5]) for i in range(5)] + [("b", 2, 2)], "ring string, x int, y int")
    assert {(r["ring"], r["node"]): r["place"] for r in graph.ring_order(step, ["ring"], "x", "y").collect()} == {("a", 1): 0, ("a", 7): 1, ("a", 5): 2, ("a", 3): 3, ("a", 9): 4, ("b", 2): 0}


def test_selection_takes_the_best_first(spark):
    rows = [("g", i, i, 0, 10, float(score)) for i, score in enumerate([3, 1, 2, 1, 5, 4])] + [("h", 0, 0, 0, 5, 1.0)]
    ranked = spark.createDataFrame(rows, "survey string, site bigint, row int, col int, area_cells bigint, score double")
    against = spark.createDataFrame([("g", 1, 3), ("g", 3, 1), ("g", 2, 0), ("g", 0, 2)], "survey string, site bigint, other bigint")
    got = [(r["survey"], r["site"], r["rank"]) for r in sites.select_sites(ranked, against, 3).orderBy("survey", "rank").collect()]
    assert got == [("g", 1, 1), ("g", 2, 2), ("g", 5, 3), ("h", 0, 1)]
    assert sites.select_sites(ranked.limit(0), against, 3).count() == 0


def test_catchments_of_pour_points(spark):
    z = np.add.outer(np.arange(6.0), np.zeros(7)) + 0.1 * np.abs(np.arange(7) - 3)
    flow = hydrology.flow_accumulation(hydrology.flow_direction(grid(spark, z), 10.0))
    points = spark.createDataFrame([("g", 1, 0, 3), ("g", 2, 3, 3)], "survey string, site long, row int, col int")
    traced = hydrology.trace_catchments(flow, hydrology.pour_points(flow, points))
    made = {r["site"]: r for r in hydrology.catchment_polygons(traced, flow).collect()}
    cells = {r["site"]: r["cells"] for r in hydrology.catchment_areas(traced, raster.with_boundary(flow), 10.0).collect()}
    assert {k: r["area"] for k, r in made.items()} == cells and not made[2]["holes"]
    for row, col in ((9, 9), (0, 0)):
        where = spark.createDataFrame([("g", 7, row, col)], "survey string, site long, row int, col int")
        with pytest.raises(Exception, match="site 7 has no valid cell"):
            hydrology.pour_points(flow.withColumn("valid", F.col("row") > 0), where).collect()


def test_stored_rasters_are_checked(spark, tmp_path):
    cells = grid(spark, np.arange(6.0).reshape(2, 3)).withColumn("z", F.when(F.col("col") < 2, F.col("z")))
    readers.write_raster(cells, f"{tmp_path}/r")
    assert readers.read_raster(spark, f"{tmp_path}/r", shape=(2, 3)).count() == 6
    with pytest.raises(Exception, match="another shape"):
        readers.read_raster(spark, f"{tmp_path}/r", shape=(3, 2)).collect()
    with pytest.raises(Exception, match="no height"):
        readers.read_raster(spark, f"{tmp_path}/r", need_finite=True).collect()
    assert readers.raster_key("a", "b,c") != readers.raster_key("a,b", "c") and len(readers.raster_key("a")) == 64


def test_holes_of_lands(spark):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    inside, beyond, open_ = [(0.2, 0.2), (0.4, 0.2), (0.4, 0.4), (0.2, 0.2)], [(0.8, 0.8), (1.2, 0.8), (1.2, 1.2), (0.8, 0.8)], [(0.2, 0.2), (0.4, 0.2), (0.4, 0.4), (0.3, 0.4)]
    rows = [(1, ring, []), (2, ring, [inside]), (3, ring, [inside, beyond]), (4, ring, [open_]), (5, ring, None)]
    got = surfaces.land_errors(spark.createDataFrame(rows, f"land_id int, ring {RING}, holes array<{RING}>")).collect()
    assert {r["land_id"]: r["error"] for r in got} == {1: None, 2: None, 3: "bad_hole", 4: "bad_hole", 5: None}


def test_storage_as_stream_state(spark, tmp_path):
    rows = [(s, f"2024-05-{d:02d}", float(mm)) for s, start in ((1, 0), (2, 3)) for d, mm in enumerate([5, 40, 0, 60, 10], start + 1)]
    days = spark.createDataFrame(rows, "station long, day string, rain_mm double").withColumn("day", F.to_date("day"))
    for k, part in enumerate((days.where("day < '2024-05-04'"), days.where("day >= '2024-05-04'"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(days.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = rain.running_storage(stream, 20.0, 1000.0).writeStream.format("memory").queryName("levels").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = {(r["station"], r["day"].isoformat()): (r["overflow_m3"], r["storage_m3"]) for r in spark.table("levels").collect()}
    for station in (1, 2):
        level = 0.0
        for s, day, mm in sorted(rows):
            if s == station:
                have = level + mm / 1000 * 1000 * 0.3
                level = min(20.0, have)
                assert got[s, day] == (pytest.approx(max(0.0, have - 20.0)), pytest.approx(level))


def test_rain_files(spark, tmp_path):
    (tmp_path / "rain.json").write_text('{"20240101": 1.5, "20240102": "x", "20240103": -999}')
    assert {(r["day"].day, r["rain_mm"]) for r in readers.read_rain(spark, str(tmp_path)).collect()} == {(1, 1.5), (2, None), (3, -999.0)}

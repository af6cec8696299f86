"""Closed forms and invariants of the terrain, flow and storage operators on small analytic cases."""

import datetime
import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainfold import catalog
from rainfold.functions import geometry, parsing
from rainfold.operators import contours, graph, hydrology, rainfall, raster, sites, storage, surfaces
from rainfold.plans import analysis
from rainfold.sources import contour_files, readers
from rainfold.streaming import rain


def grid(spark, z, valid=None, sink=None):
    rows = [("g", int(r), int(c), float(z[r, c]), bool(valid is None or valid[r, c]), bool(sink is not None and sink[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "survey string, row int, col int, z double, valid boolean, sink boolean")


def array(df, value, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", F.col(value).cast("double").alias("v")).collect():
        out[r["row"], r["col"]] = np.nan if r["v"] is None else r["v"]
    return out


def test_directions_of_ramps(spark):
    r, c = np.mgrid[0:6, 0:7]
    assert (array(hydrology.flow_direction(grid(spark, 270.0 + 2 * c), 5.0), "fdir", (6, 7))[1:-1, 1:-1] == 16).all()
    assert (array(hydrology.flow_direction(grid(spark, 270.0 + 2 * (5 - r)), 5.0), "fdir", (6, 7))[1:-1, 1:-1] == 4).all()
    assert (array(hydrology.flow_direction(grid(spark, np.full((10, 10), 270.0)), 5.0), "fdir", (10, 10)) == 0).all()


def test_slope_of_a_ramp(spark):
    c = np.mgrid[0:5, 0:5][1]
    slope = array(raster.with_slope(grid(spark, 2.0 * c), 5.0), "slope_deg", (5, 5))
    assert np.allclose(slope, math.degrees(math.atan(0.4)))


def test_contour_interval_takes_all_orders(spark, tmp_path):
    orders = [(k, 1, 20000.0 * k) for k in range(14)] + [(20, 1, 20000.0 * 17)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.createDataFrame([(0, 1, 1, 1)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.queries()["contour_interval"](spark, str(tmp_path)).first()
    assert got["contour_interval_m"] == 5 and not got["contour_interval_uniform"]


def test_nearest_fill_reaches_every_cell(spark):
    places = [("g", r, c, 10.0 * c, 10.0 * r) for r in range(0, 3000, 150) for c in range(4)] + [("lone", 0, 0, 0.0, 0.0)]
    cells = spark.createDataFrame(places, "survey string, row int, col int, x double, y double").withColumn("z", F.lit(None).cast("double"))
    known = [("g", 3, 0.0, 21.0, 7.0), ("g", 5, 30.0, 0.0, 8.0), ("g", 1, 30.0, 0.0, 9.0), ("g", 7, 0.0, 15000.0, 4.0), ("g", 0, 25.0, float("nan"), 1.0)]
    points = spark.createDataFrame(known, "survey string, id int, x double, y double, z double")
    got = {(r["survey"], r["row"], r["col"]): r["z"] for r in raster.nearest_fill(cells, points, 20.0).collect()}
    assert len(got) == len(places)
    for survey, r, c, x, y in places:
        best = min((((x - px) ** 2 + (y - py) ** 2, i, z) for _, i, px, py, z in known if py == py), default=None)
        assert got[survey, r, c] == (None if survey == "lone" else best[2])


def test_filling(spark):
    pit = np.full((5, 5), 10.0)
    pit[2, 2] = 2
    assert (array(hydrology.fill_depressions(grid(spark, pit)), "z_filled", (5, 5)) == 10).all()
    notch = np.full((7, 7), 10.0)
    notch[0, 3] = notch[1, 3] = 6
    notch[2:5, 2:5] = 3
    assert (array(hydrology.fill_depressions(grid(spark, notch)), "z_filled", (7, 7))[2:5, 2:5] == 6).all()
    kept = np.zeros((5, 5), bool)
    kept[2, 2] = True
    assert array(hydrology.fill_depressions(grid(spark, pit, sink=kept)), "z_filled", (5, 5))[2, 2] == 2


def test_filling_along_a_winding_path(spark):
    z = np.full((91, 91), 50.0)
    z[1:-1:2, 1:-1] = 1
    for k, r in enumerate(range(2, 89, 2)):
        z[r, -2 if k % 2 == 0 else 1] = 1
    z[0, 1] = 2
    for side in (128, 60):
        got = array(hydrology.fill_depressions(grid(spark, z), side=side), "z_filled", (91, 91))
        assert (got == np.where(z == 1, 2, z)).all()


def test_filling_in_blocks(spark):
    rng = np.random.default_rng(8)
    z, valid, sink = np.floor(rng.random((23, 29)) * 9), rng.random((23, 29)) > 0.02, rng.random((23, 29)) > 0.98
    want = np.where(valid, np.inf, -np.inf)
    fixed = np.zeros(z.shape, bool)
    fixed[[0, -1]] = fixed[:, [0, -1]] = True
    want = np.where(valid & (fixed | sink), z, want)
    while True:
        wide = np.pad(want, 1, constant_values=np.inf)
        low = np.min([wide[i : i + 23, j : j + 29] for i in range(3) for j in range(3)], axis=0)
        step = np.where(valid, np.maximum(z, low), -np.inf)
        if (step == want).all():
            break
        want = step
    for side in (128, 5, 1):
        got = array(hydrology.fill_depressions(grid(spark, z, valid, sink), side=side), "z_filled", z.shape)
        assert np.array_equal(got, np.where(valid, want, np.nan), equal_nan=True)


def test_flow_is_conserved_over_plateaus(spark):
    rng = np.random.default_rng(2)
    z = np.floor(rng.random((12, 14)) * 4)
    done = hydrology.run_hydrology(grid(spark, z), 10.0)
    acc, code = array(done, "acc", z.shape), array(done, "fdir", z.shape)
    inner = np.zeros_like(z, bool)
    inner[1:-1, 1:-1] = True
    assert not (inner & (code == 0)).any()
    assert acc[code == 0].sum() <= z.size and acc.min() == 1
    step = {k: (dr, dc) for k, dr, dc in raster.DIRECTIONS}
    leaves = sum(acc[r, c] for r in range(12) for c in range(14) if code[r, c] == 0 or not (0 <= r + step[int(code[r, c])][0] < 12 and 0 <= c + step[int(code[r, c])][1] < 14))
    assert leaves == z.size


def test_flats_drain_to_both_outlets(spark):
    z = np.full((9, 15), 10.0)
    z[:, 0] = z[:, -1] = 9
    code = array(hydrology.flow_direction(grid(spark, z), 10.0, flats=True), "fdir", z.shape)
    assert code[4, 2] == 16 and code[4, -3] == 1


def test_a_cycle_is_an_error(spark):
    two = spark.createDataFrame([("g", 0, 0, 1, True), ("g", 0, 1, 16, True)], "survey string, row int, col int, fdir int, valid boolean")
    with pytest.raises(ValueError, match="cycle"):
        hydrology.flow_accumulation(two)


def test_catchment_of_a_line(spark):
    line = spark.createDataFrame([("g", 0, c, 16 if c else 0, True) for c in range(4)], "survey string, row int, col int, fdir int, valid boolean")
    flow = hydrology.flow_accumulation(line).withColumn("boundary", F.lit(True))
    traced = hydrology.trace_catchments(flow, spark.createDataFrame([("g", 0, 1)], "survey string, node bigint, site bigint"))
    got = hydrology.catchment_areas(traced, flow, 10.0).first()
    assert (got["cells"], got["area_m2"], got["area_ha"]) == (4, 400.0, 0.04)


def test_distance_to_the_edge(spark):
    valid = np.ones((7, 9), bool)
    valid[3, 4] = False
    got = array(raster.with_edge_distance(grid(spark, np.zeros((7, 9)), valid), 10.0), "edge_distance_m", (7, 9))
    for r in range(7):
        for c in range(9):
            outside = [(a, b) for a in range(-1, 8) for b in range(-1, 10) if not (0 <= a < 7 and 0 <= b < 9) or (a, b) == (3, 4)]
            want = min(math.hypot(r - a, c - b) for a, b in outside) * 10 - 5 if valid[r, c] else 0
            assert got[r, c] == pytest.approx(want)


def test_gaussian_keeps_a_constant(spark):
    assert np.allclose(array(raster.smoothed(grid(spark, np.full((6, 6), 7.0)), 1.0), "z", (6, 6)), 7)


def test_sites_of_a_valley(spark):
    r, c = np.mgrid[0:31, 0:31]
    z = 100.0 + c + abs(r - 15)
    z[15, 15] -= 10
    got = analysis.rank_sites(grid(spark, z).drop("sink"), 30.0, max_slope=60.0).orderBy("rank").collect()
    assert 1 <= len(got) <= 5 and [x["rank"] for x in got] == list(range(1, len(got) + 1))
    higher = analysis.rank_sites(grid(spark, z + 50).drop("sink"), 30.0, max_slope=60.0).orderBy("rank").collect()
    assert [(x["row"], x["col"]) for x in got] == [(x["row"], x["col"]) for x in higher]


def test_default_pond(spark):
    f = {k: F.lit(float(v)) for k, v in {"l": 40, "w": 30, "d": 2, "s": 2, "b": 0.5}.items()}
    got = spark.range(1).select(*[v.alias(k) for k, v in storage.pond_geometry(f["l"], f["w"], f["d"], f["s"], f["b"]).items()], storage.clearance_area(f["l"], f["w"], F.lit(5.0)).alias("clear")).first()
    assert (got["capacity_m3"], got["water_depth_m"], got["footprint_area_m2"], got["clear"]) == (pytest.approx(1317), 1.5, 1200, 2000)
    turned = spark.range(1).select(storage.footprint_corners(F.lit(0.0), F.lit(0.0), f["l"], f["w"], F.lit(90.0), F.lit(0.0)).alias("p")).first()["p"]
    assert {(round(abs(p["x"])), round(abs(p["y"]))) for p in turned} == {(20, 15)}


def designs(spark, **values):
    base = {"design_id": 1, "capacity_m3": 1317.0, "water_depth_m": 1.5, "bottom_length_m": 32.0, "bottom_width_m": 22.0, "side_slope": 2.0, "footprint_area_m2": 1200.0, "runoff_area_m2": 38800.0, "runoff_coefficient": 0.3, "evaporation_mm_day": 4.0, "seepage_mm_day": 1.0, "demand_m3_day": 0.0, "initial_storage_fraction": 0.0} | values
    return spark.createDataFrame([tuple(base[c] for c in storage.DESIGN)], "design_id bigint, " + ", ".join(f"{c} double" for c in storage.DESIGN[1:]))


def days(spark, mm, first="2020-01-01", last="2021-12-31"):
    return spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}')) AS day").withColumn("rain_mm", F.lit(float(mm)))


def test_balance_closes(spark):
    out = analysis.simulate_pond(designs(spark, demand_m3_day=3.0, initial_storage_fraction=0.5), days(spark, 6.0))
    total = out["totals"].first()
    assert abs(total["residual_m3"]) < 1e-6 and total["direct_rain_m3"] == pytest.approx(731 * 6 * 1.2)
    assert out["annual"].count() == 2 and out["monthly"].count() == 24 and out["seasonal"].count() == 6
    assert sum(r["inflow_m3"] for r in out["seasonal"].collect()) == pytest.approx(total["inflow_m3"])
    assert out["summary"].first()["years_analysed"] == 2


def test_dry_pond_and_storm(spark):
    dry = storage.totals(storage.monthly(storage.daily_balance(designs(spark, demand_m3_day=4.0), days(spark, 0, last="2020-01-10")))).first()
    assert dry["unmet_demand_m3"] == 40 and dry["days_empty"] == 10
    wet = storage.daily_balance(designs(spark, runoff_area_m2=100000.0, evaporation_mm_day=0.0, seepage_mm_day=0.0), days(spark, 100, last="2020-01-01")).first()
    assert wet["overflow_m3"] == pytest.approx(100 * 0.3 * 100 + 120 - 1317)


def test_seasons_have_to_hold_every_month(spark):
    with pytest.raises(ValueError, match="each month"):
        storage.season_table(spark, {"a": [1, 2], "b": [2]})


def test_rain_series(spark):
    assert [(r["annual_mm"], r["complete"]) for r in rainfall.annual_totals(days(spark, 1)).orderBy("year").collect()] == [(366, True), (365, True)]
    assert rainfall.rain_summary(days(spark, 1), 2020, 2021).first()["mean_annual_mm"] == 365.5
    for bad in (-999.0, -1.0, float("nan"), float("inf"), None):
        broken = days(spark, 1).withColumn("rain_mm", F.when(F.col("day") == "2020-02-29", F.lit(bad).cast("double")).otherwise(F.col("rain_mm")))
        assert rainfall.rain_summary(broken, 2020, 2021).first()["status"] == "unavailable"
    assert rainfall.rain_summary(days(spark, 1).where("day <> '2020-02-29'"), 2020, 2021).first()["mean_annual_mm"] is None


def test_runoff_states(spark):
    rows = spark.createDataFrame([(1e6, False, 0.5), (1e6, True, 0.1), (1e6, False, 0.51)], "area_m2 double, boundary_truncated boolean, routing_sensitivity_fraction double")
    got = rainfall.runoff_volume(rows, F.lit(1000.0), F.lit(0.3)).collect()
    assert [r["annual_m3"] for r in got] == [pytest.approx(300000)] * 3 and [r["status"] for r in got] == ["estimated", "provisional", "provisional"]


def test_contour_intervals(spark):
    def levels(*z):
        rows = [(i, float(v), [(0.0, 0.0), (1.0, 1.0)]) for i, v in enumerate(z)]
        got = contours.interval(spark.createDataFrame(rows, "contour_id bigint, elevation double, coordinates array<struct<lon:double,lat:double>>")).first()
        return got["contour_interval_m"], got["contour_interval_uniform"]

    assert levels(270, 275, 280) == (5, True) and levels(270, 275, 283)[1] is False and levels(270, 275, 280, 285, 295) == (5, False)


KML = """<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2" xmlns:g="urn:g"><Document>
<Placemark><name>270.5 m</name><ExtendedData><SchemaData><SimpleData name="ID">12</SimpleData></SchemaData></ExtendedData><LineString><coordinates>81.1,21.2,0 81.2,21.3 bad 81.3,x</coordinates></LineString></Placemark>
<Placemark><name>no number</name><LineString><coordinates>1,2 3,4</coordinates></LineString></Placemark>
<Placemark><name>275</name><MultiGeometry><LineString><coordinates>1,2,9 3,4,9</coordinates></LineString></MultiGeometry></Placemark>
<Placemark><name>280</name><Point><coordinates>1,2</coordinates></Point></Placemark></Document></kml>"""


def test_kml_and_kmz(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("x.kml", "<kml/>")
        z.writestr("doc.kml", KML.replace("275", "-3"))
    (tmp_path / "b.kmz").write_bytes(box.getvalue())
    got = {(r["path"][-5:], r["idx"]): (r["contour_id"], r["elevation"], len(r["coordinates"])) for r in contour_files.read(spark, str(tmp_path)).collect()}
    assert got == {("a.kml", 0): (12, 270.5, 2), ("a.kml", 2): (2, 275.0, 2), ("b.kmz", 0): (12, 270.5, 2), ("b.kmz", 2): (2, -3.0, 2)}


def test_land(spark):
    ring = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0), (0.0, 0.0)]
    hole = [(40.0, 40.0), (60.0, 40.0), (60.0, 60.0), (40.0, 60.0), (40.0, 40.0)]
    lands = spark.createDataFrame([("g", 1, ring, [hole])], "survey string, land_id int, ring array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>")
    cells = spark.range(15 * 15).selectExpr("'g' AS survey", "CAST(id DIV 15 AS INT) AS row", "CAST(id % 15 AS INT) AS col").withColumns({"x": F.col("col") * 10.0 + 5, "y": F.col("row") * 10.0 + 5})
    inside = {(r["row"], r["col"]) for r in surfaces.land_mask(cells, lands, 10.0).collect()}
    assert inside == {(r, c) for r in range(10) for c in range(10)} - {(r, c) for r in (4, 5) for c in (4, 5)}
    part = surfaces.land_coverage(cells.where("col < 5"), lands, 10.0).first()
    assert part["terrain_coverage_fraction"] == pytest.approx(0.5) and part["partial_terrain_coverage"] and part["area_ha"] == pytest.approx(0.96)
    shape = "land_id int, ring array<struct<x:double,y:double>>"
    bow = [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    rows = [(1, ring), (2, ring[:-1]), (3, []), (4, bow), (5, [(0.0, 0.0), (200.0, 0.0), (1.0, 1.0), (0.0, 0.0)]), (6, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 0.0)])]
    degrees = [(i, [(x / 10, y / 10) for x, y in p] if i == 1 else p) for i, p in rows]
    got = {r["land_id"]: r["error"] for r in surfaces.land_errors(spark.createDataFrame(degrees, shape)).collect()}
    assert got[1] is None and got[2] == "not_closed" and got[3] == "missing" and got[4] in ("no_area", "self_intersecting") and got[5] == "out_of_range" and got[6] == "no_area"


def test_geojson(spark):
    rows = spark.createDataFrame([('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}',), ('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}}',), ('{"type":"Point","coordinates":[1,2]}',), ("no json",)], "geojson string")
    assert [None if r["rings"] is None else r["rings"][0][1]["x"] for r in readers.land_of_geojson(rows).collect()] == [1.0, 2.0, None, None]


def test_geometry(spark):
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))])
    got = spark.range(1).select(
        geometry.signed_area(square).alias("area"),
        geometry.covers_point(square, F.lit(0.0), F.lit(2.0)).alias("rim"),
        geometry.covers_point(square, F.lit(5.0), F.lit(2.0)).alias("out"),
        geometry.line_distance(square, F.lit(7.0), F.lit(8.0)).alias("far"),
        F.abs(geometry.signed_area(geometry.clip_ring(square, F.lit(2.0), F.lit(2.0), F.lit(9.0), F.lit(9.0)))).alias("clipped"),
        geometry.simple(square).alias("simple"),
    ).first()
    assert tuple(got) == (16.0, True, False, 5.0, 4.0, True)


def test_outlines_have_holes(spark):
    high = np.ones((5, 5), bool)
    high[2, 2] = False
    cells = grid(spark, np.zeros((5, 5)), high)
    areas = sorted(r["area"] for r in surfaces.outline_rings(surfaces.outline_edges(cells, "valid")).collect())
    assert areas == [-1.0, 25.0]


def test_components_and_water_tags(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "x bigint, y bigint")
    assert {(r["node"], r["component"]) for r in graph.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    tags = spark.createDataFrame([({"waterway": "river"},), ({"natural": "water"},), ({"landuse": "farm"},), ({},)], "t map<string,string>")
    assert [r[0] for r in tags.select(parsing.is_water(F.col("t"))).collect()] == [True, True, False, False]


def test_sites_skip_near_and_alike(spark):
    rows = [("g", i, 0, i * 3, 10, float(i)) for i in range(4)]
    ranked = spark.createDataFrame(rows, "survey string, site bigint, row int, col int, area_cells bigint, score double")
    alike = spark.createDataFrame([("g", 0, 3, 0.9)], "survey string, site_a bigint, site_b bigint, iou double")
    got = sites.select_sites(ranked, sites.site_conflicts(ranked, alike, 10.0, 40.0), 5)
    assert [r["site"] for r in got.orderBy("rank").collect()] == [0, 2]


def test_stream(spark, tmp_path):
    start = datetime.datetime(2024, 5, 1)
    rows = [(1, start + datetime.timedelta(hours=6 * i), 2.0) for i in range(24)]
    spark.createDataFrame(rows, "station bigint, ts timestamp, mm double").coalesce(1).write.parquet(str(tmp_path / "in"))
    daily = rain.daily_rain(rain.read_events(spark, str(tmp_path / "in")), "1 hour")
    query = daily.writeStream.format("memory").queryName("rain_days").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["day"].day: r["rain_mm"] for r in spark.table("rain_days").collect()}
    assert len(got) >= 5 and set(got.values()) == {8.0}

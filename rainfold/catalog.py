"""All queries of the engine by name, with SQL for those that SQL can express.

The tables at hand hold no terrain, so domain inputs are read out of them: a day's rain is its number of shipped lines, a raster
is the parts in 40 columns or each embedding as an 8-by-8 tile of whole heights, contours are orders with their lines as vertices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainfold import catalog_sql as sql
from rainfold.functions import geodesy, geometry, parsing
from rainfold.operators import contours, forest, hydrology, interpolation, polygonize, rainfall, raster, sites, storage, surfaces
from rainfold.plans.store import cut, new_path, table
from rainfold.sources import contour_files, readers

Query = Callable[[SparkSession, str], DataFrame]
RESOLUTION = 10.0


def daily_rain(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("rain_mm"))


def part_grid(s: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    return table(s, d, "part").select(F.lit("part").alias("survey"), F.floor(n / 40).cast("int").alias("row"), (n % 40).cast("int").alias("col"), F.col("p_retailprice").alias("z"), (F.col("p_size") > 3).alias("valid"))


def tile_grid(s: SparkSession, d: str) -> DataFrame:
    cells = table(s, d, "embeddings").select(F.col("vec_id").alias("survey"), F.posexplode("embedding").alias("i", "v"))
    return cells.select("survey", F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).cast("int").alias("col"), F.floor(F.col("v").cast("double") * 20).cast("double").alias("z"), F.lit(True).alias("valid"))


def order_contours(s: SparkSession, d: str) -> DataFrame:
    """Orders with lines: elevation in steps of 5, vertices in a fixed order; some latitudes are beyond the pole."""
    lon = F.col("l_partkey") % 360 - 180 + F.col("l_linenumber") / 8.0
    lat = F.col("l_suppkey") % 93 + F.col("l_linenumber") / 4.0
    vertex = F.struct("l_linenumber", "l_partkey", "l_suppkey", lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(vertex)).alias("v"))
    made = table(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return made.select(F.col("o_orderkey").alias("contour_id"), (F.floor(F.col("o_totalprice") / 20000) * 5).cast("double").alias("elevation"), F.transform("v", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("coordinates"), F.col("o_custkey"))


def sound_contours(s: SparkSession, d: str) -> DataFrame:
    c = order_contours(s, d)
    return c.join(contours.violations(c).select("contour_id"), "contour_id", "left_anti")


def points(s: SparkSession, d: str) -> DataFrame:
    """Customers as places all over the globe."""
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 37) % 360 - 180 + 0.25).cast("double").alias("lon"), ((F.col("c_custkey") * 11) % 164 - 80 + 0.5).cast("double").alias("lat"))


def ponds(s: SparkSession, d: str) -> DataFrame:
    """Parts as pond sizes of 20 to 119 by 15 to 64 by 1 to 3 metres."""
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("design_id"), (20 + F.col("p_partkey") % 100).cast("double").alias("length_m"), (15 + F.col("p_size")).cast("double").alias("width_m"), (1 + F.col("p_partkey") % 5 * 0.5).cast("double").alias("depth_m"), (F.col("p_partkey") * 7 % 360).cast("double").alias("bearing"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, so that sums in another order compare equal; minus zero is zero."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def balance(s: SparkSession, d: str, losses: bool = False) -> DataFrame:
    """Daily balance of the candidate sizes over the complete years."""
    grid = storage.candidate_grid(s)
    designs = grid.withColumns({"design_id": F.col("candidate").cast("long"), "side_slope": F.lit(storage.SIDE_SLOPE), "runoff_area_m2": 4000 - F.col("footprint_area_m2"), "runoff_coefficient": F.lit(0.3), "evaporation_mm_day": F.lit(4.0 if losses else 0.0), "seepage_mm_day": F.lit(1.0 if losses else 0.0), "demand_m3_day": F.lit(20.0), "initial_storage_fraction": F.lit(0.25)})
    return storage.daily_balance(designs, daily_rain(s, d).where(F.year("day").between(1996, 2000)))


def filled_tiles(s: SparkSession, d: str) -> DataFrame:
    return cut(hydrology.fill_depressions(tile_grid(s, d)))


def flow_tiles(s: SparkSession, d: str) -> DataFrame:
    """Tiles with directions on the raw surface and accumulation."""
    return hydrology.flow_accumulation(hydrology.flow_direction(tile_grid(s, d), RESOLUTION))


def tile_sites(s: SparkSession, d: str) -> DataFrame:
    """The five cells of each tile that most cells drain through, as sites."""
    flow = cut(flow_tiles(s, d))
    order = Window.partitionBy("survey").orderBy(F.col("acc").desc(), "node")
    return cut(flow.withColumn("site", F.row_number().over(order).cast("long")).withColumn("site", F.when(F.col("site") <= 5, F.col("site"))))


def traced_sites(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    flow = tile_sites(s, d)
    return flow, cut(hydrology.trace_catchments(flow, flow.where(F.col("site").isNotNull()).select("survey", "node", "site")))


def runoff_sites(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "supplier").select(F.col("s_suppkey").alias("site_id"), F.abs(F.col("s_acctbal")).alias("area_m2"), (F.col("s_nationkey") % 4 == 0).alias("boundary_truncated"), ((F.col("s_suppkey") % 9) / 8.0).cast("double").alias("routing_sensitivity_fraction"))
    mean = rainfall.rain_summary(daily_rain(s, d), 1996, 2000).first()["mean_annual_mm"]  # one number
    joined = p.withColumn("mean_annual_mm", F.lit(mean).cast("double"))
    return rainfall.runoff_volume(joined, F.col("mean_annual_mm"), F.lit(0.3)).withColumn("reasons", F.array_join("reasons", ","))


def kml_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Contours of each customer written as KML and read again."""
    back = readers.contours(readers.kml_text(sound_contours(s, d), "o_custkey"))
    return back.select("o_custkey", "contour_id", "elevation", F.size("coordinates").cast("long").alias("points"), F.round(F.aggregate("coordinates", F.lit(0.0), lambda t, p: t + p["lon"] * 2 + p["lat"]), 6).alias("digest"))


def contour_folder(s: SparkSession, d: str) -> DataFrame:
    """Contours written as files for a hundred customers each, every other one an archive, and read by the data source."""
    some = sound_contours(s, d).withColumn("file", F.floor(F.col("o_custkey") / 100).cast("long"))
    folder = new_path(s, "contours")
    contour_files.write(readers.kml_text(some, "file").withColumn("packed", F.col("file") % 2 == 1), folder, "file")
    back = contour_files.read(s, folder)
    file = F.regexp_extract("path", r"(\d+)\.km[lz]$", 1).cast("long")
    return back.select(file.alias("file"), "entry", "contour_id", "elevation", F.size("coordinates").cast("long").alias("points"), F.round(F.aggregate("coordinates", F.lit(0.0), lambda t, p: t + p["lon"] * 2 + p["lat"]), 6).alias("digest"))


def part_lands(s: SparkSession, d: str) -> DataFrame:
    """Nations as triangles over the raster of parts, some with a hole."""
    x, y = F.col("n_nationkey") * 12.0, F.col("n_nationkey") * 15.0

    def ring(*at: tuple) -> Column:
        return F.array(*[F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y")) for a, b in at])

    empty = F.array().cast("array<array<struct<x:double,y:double>>>")
    return table(s, d, "nation").select(F.lit("part").alias("survey"), F.col("n_nationkey").alias("land_id"), ring((-13, -7), (151, 23), (41, 137), (-13, -7)).alias("ring"), F.when(F.col("n_regionkey") % 2 == 0, F.array(ring((41, 31), (77, 33), (52, 66), (41, 31)))).otherwise(empty).alias("holes"))


def placed(cells: DataFrame) -> DataFrame:
    return cells.withColumns({"x": F.col("col") * RESOLUTION, "y": F.col("row") * RESOLUTION})


def part_water(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as lines of two segments, every third a water area."""
    k = F.col("s_suppkey")
    at = [(k * 37 % 400, k * 91 % 500), (k * 37 % 400 + 35, k * 91 % 500 + 12), (k * 37 % 400 + 20, k * 91 % 500 + 48)]
    line = [F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in at]
    area = k % 3 == 0
    return table(s, d, "supplier").select(F.lit("part").alias("survey"), k.alias("feature_id"), F.when(area, F.array(*line, line[0])).otherwise(F.array(*line)).alias("line"), area.alias("area"), F.when(k % 5 == 0, "14 m").when(k % 5 == 1, "wide").when(k % 5 == 2, "6").alias("width"))


def osm_ways(s: SparkSession, d: str) -> DataFrame:
    """Orders as ways over customers as nodes, every seventh node missing."""
    nodes = points(s, d).where("id % 7 <> 3").withColumnRenamed("id", "node_id")
    refs = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("way_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 150).alias("ref")))).alias("r"))
    ways = refs.select("way_id", F.transform("r", lambda x: x["ref"]).alias("refs"), F.create_map(F.lit("waterway"), F.lit("stream")).alias("tags"))
    made = surfaces.assemble_ways(nodes, ways)
    return made.select("way_id", "missing", F.size("geometry").cast("long").alias("points"), F.round(F.aggregate("geometry", F.lit(0.0), lambda t, p: t * 0.5 + p["lon"]), 6).alias("digest"))


def cache_hits(s: SparkSession, d: str) -> DataFrame:
    o, c = table(s, d, "orders"), points(s, d)
    boxes = o.select(F.col("o_orderkey").alias("record_id"), ((F.col("o_custkey") * 37) % 360 - 180.0).alias("west"), ((F.col("o_custkey") * 11) % 164 - 80.0).alias("south"), (F.col("o_orderkey") % 3 + 1.0).alias("w"), (F.col("o_orderkey") % 86400).cast("double").alias("at"))
    records = boxes.select("record_id", "at", "west", "south", (F.col("west") + F.col("w")).alias("east"), (F.col("south") + F.col("w")).alias("north"))
    asked = c.select(F.col("id").alias("query_id"), F.col("lat").alias("south"), F.col("lon").alias("west"), (F.col("lat") + 0.5).alias("north"), (F.col("lon") + 0.5).alias("east"), F.lit(86400.0).alias("at"))
    return surfaces.covering_cache(records, asked, 85000.0)


def _monthly(s: SparkSession, d: str) -> DataFrame:
    return storage.monthly(balance(s, d))


def _summary(s: SparkSession, d: str) -> DataFrame:
    months = _monthly(s, d)
    capacity = storage.candidate_grid(s).select(F.col("candidate").cast("long").alias("design_id"), "capacity_m3")
    return storage.seasonal_summary(storage.seasonal(months, storage.season_table(s)), capacity)


def _regular(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("survey"), F.lit(0.5).alias("min_x"), (F.col("n_nationkey") * 3.25 + 1).cast("double").alias("max_x"), F.lit(-2.0).alias("min_y"), (F.col("n_regionkey") * 2.5 + 2).cast("double").alias("max_y"))
    return raster.regular_grid(n, F.lit(2.0))


def _nearest(s: SparkSession, d: str) -> DataFrame:
    grid = placed(part_grid(s, d)).withColumn("z", F.when(F.col("valid"), F.col("z"))).select("survey", "row", "col", "x", "y", "z")
    known = table(s, d, "supplier").select(F.lit("part").alias("survey"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 53 % 397).cast("double").alias("x"), (F.col("s_suppkey") * 71 % 499).cast("double").alias("y"), F.col("s_acctbal").alias("z"))
    return raster.nearest_fill(grid, known, 200.0).select("row", "col", "z")


def _linear(s: SparkSession, d: str) -> DataFrame:
    """Heights of suppliers, scattered in general position, over a coarse grid."""
    k = F.col("s_suppkey")
    known = table(s, d, "supplier").select(F.lit("all").alias("survey"), ((k * k * 31 + k * 53) % 397 + k % 7 * 0.131).cast("double").alias("x"), ((k * k * 17 + k * 71) % 499 + k % 11 * 0.077).cast("double").alias("y"), F.col("s_acctbal").cast("double").alias("z"))
    places = table(s, d, "nation").select(F.lit("all").alias("survey"), F.col("n_nationkey").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("col")).withColumns({"x": F.col("col") * 20.0 + 1.7, "y": F.col("row") * 20.0 + 2.3})
    return rounded(interpolation.linear_surface(places, known, 60.0).where(F.col("z").isNotNull()).select("row", "col", "z"), 3)


def supplier_relations(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as water areas: a rectangle of two ways, some with a triangle taken out, some not closed."""
    k = F.col("s_suppkey")
    left, low, wide, tall = k % 50 * 10.0, k % 31 * 10.0, k % 5 + 4.0, k % 7 + 5.0

    def line(role: str, *at: tuple) -> Column:
        return F.struct(F.lit(role).alias("role"), F.array(*[F.struct((left + x).cast("double").alias("lon"), (low + y).cast("double").alias("lat")) for x, y in at]).alias("geometry"))

    lower = line("outer", (0, 0), (wide, 0), (wide, tall))
    upper = F.when(k % 7 == 0, line("outer", (0, 0), (0, tall))).otherwise(line("outer", (0, 0), (0, tall), (wide, tall)))
    inner = F.when(k % 11 == 0, F.array(line("inner", (1, 1), (3, 1), (3, 4)))).when(k % 3 == 0, F.array(line("inner", (1, 1), (3, 1), (3, 4)), line("inner", (1, 1), (3, 4)))).otherwise(F.array().cast("array<struct<role:string,geometry:array<struct<lon:double,lat:double>>>>"))
    return table(s, d, "supplier").select(k.alias("relation_id"), F.concat(F.array(lower, upper), inner).alias("members"))


def _relations(s: SparkSession, d: str) -> DataFrame:
    def areas(rings: str) -> Column:
        return F.aggregate(rings, F.lit(0.0), lambda t, r: t + F.abs(geometry.signed_area(r)))

    made = polygonize.relation_areas(supplier_relations(s, d))
    return made.select("relation_id", F.size("shells").cast("long").alias("shells"), F.size("holes").cast("long").alias("holes"), F.round(areas("shells") - areas("holes"), 6).alias("area"), "error")


def _tile_channels(s: SparkSession, d: str) -> DataFrame:
    return hydrology.hydrology_statistics(hydrology.channels(flow_tiles(s, d), 0.9))


def _hydrology(s: SparkSession, d: str) -> DataFrame:
    """Fill, directions over flats, accumulation and channels of every tile."""
    return hydrology.run_hydrology(tile_grid(s, d), RESOLUTION).select("survey", "row", "col", "z_filled", "fdir", "acc", "is_channel")


def _depressions(s: SparkSession, d: str) -> DataFrame:
    return hydrology.depressions(filled_tiles(s, d)).select("survey", "row", "col", "component")


def _catchments(s: SparkSession, d: str) -> DataFrame:
    flow, traced = traced_sites(s, d)
    return hydrology.catchment_areas(traced, raster.with_boundary(flow), RESOLUTION, flow.count())


def _catchments_over_blocks(s: SparkSession, d: str) -> DataFrame:
    flow = tile_sites(s, d)
    traced = hydrology.trace_catchments(flow, flow.where(F.col("site").isNotNull()).select("survey", "node", "site"), side=3)
    return hydrology.catchment_areas(traced, raster.with_boundary(flow), RESOLUTION, flow.count())


def spanned_sites(s: SparkSession, d: str, side: int = 512) -> tuple[DataFrame, DataFrame]:
    """Sites of the tiles and their catchments as intervals."""
    flow = tile_sites(s, d)
    return flow, cut(sites.spans(forest.tour(flow, side), flow.where(F.col("site").isNotNull()).select("survey", "node", "site")))


def _iou(s: SparkSession, d: str) -> DataFrame:
    return rounded(sites.overlaps(spanned_sites(s, d)[1]))


def _iou_over_blocks(s: SparkSession, d: str) -> DataFrame:
    return rounded(sites.overlaps(spanned_sites(s, d, side=3)[1]))


def _scores(s: SparkSession, d: str) -> DataFrame:
    some = raster.with_slope(flow_tiles(s, d), RESOLUTION).where("acc >= 3").withColumnsRenamed({"acc": "area_cells", "slope_deg": "local_slope_deg"})
    return rounded(sites.scored(some, 100.0).select("survey", "row", "col", "area_cells", "drainage_score", "slope_score", "score"))


def _selected(s: SparkSession, d: str) -> DataFrame:
    """Of each tile's five sites the best three that do not conflict."""
    flow, spanned = spanned_sites(s, d)
    ranked = flow.where(F.col("site").isNotNull()).select("survey", "site", "row", "col", F.col("acc").alias("area_cells"), (-F.col("acc")).cast("double").alias("score"))
    return sites.select_apart(ranked, spanned, RESOLUTION, 25.0, k=3).select("survey", "site", "rank")


def _outlets(s: SparkSession, d: str) -> DataFrame:
    flow = flow_tiles(s, d).withColumns({"allowed": (F.col("row") + F.col("col")) % 5 != 0, "wet": F.lit(False)})
    return sites.outlet_nodes(flow, share=0.85).select("survey", "row", "col", "acc")


def _outline(s: SparkSession, d: str) -> DataFrame:
    """Rings about the cells of a tile that are above zero."""
    edges = surfaces.outline_edges(tile_grid(s, d).withColumn("high", F.col("z") >= 0), "high")
    rings = surfaces.outline_rings(edges)
    return rings.groupBy("survey").agg(F.sum("area").alias("area"), F.sum(F.size("points")).cast("long").alias("edges"))


def part_sites(s: SparkSession, d: str) -> DataFrame:
    """Parts as sites with room for a pond of limited length and width, and the volume that is asked for."""
    k = F.col("p_partkey")
    return table(s, d, "part").select(k.alias("site"), (30 + F.col("p_size") % 40).cast("double").alias("max_length_m"), (19 + k % 25).cast("double").alias("max_width_m"), F.round(F.col("p_retailprice").cast("double"), 2).alias("target_m3"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    # rain and runoff
    "rain_annual_totals": (lambda s, d: rainfall.annual_totals(daily_rain(s, d)), sql.RAIN_TOTALS),
    "rain_calendar_gaps": (lambda s, d: rainfall.calendar_gaps(daily_rain(s, d), 1995, 2001), sql.RAIN_GAPS),
    "rain_summary": (lambda s, d: rainfall.rain_summary(daily_rain(s, d), 1996, 2000).select("status", "mean_annual_mm"), sql.RAIN_SUMMARY),
    "rain_json": (lambda s, d: rounded(readers.rain_of_json(table(s, d, "events").groupBy("event_type").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.date_format("ts", "yyyyMMdd").alias("k"), F.dayofmonth("ts").cast("double").alias("v")))))).alias("value")))), sql.RAIN_JSON),
    "runoff_volume": (lambda s, d: rounded(runoff_sites(s, d)), sql.RUNOFF),
    # storage design and sizing
    "pond_geometry": (lambda s, d: rounded(ponds(s, d).withColumns(storage.pond_geometry(F.col("length_m"), F.col("width_m"), F.col("depth_m"), F.lit(2.0), F.lit(0.5)) | {"clearance_m2": storage.clearance_area(F.col("length_m"), F.col("width_m"), F.lit(5.0))})), sql.POND_GEOMETRY),
    "pond_corners": (lambda s, d: rounded(ponds(s, d).select("design_id", F.posexplode(storage.footprint_corners(F.lit(100.0), F.lit(200.0), F.col("length_m"), F.col("width_m"), F.col("bearing"), F.lit(5.0))).alias("corner", "p")).select("design_id", "corner", "p.x", "p.y"), 4), sql.POND_CORNERS),
    "capacity_grid": (lambda s, d: rounded(storage.site_sizes(part_sites(s, d)).select("site", "candidate", "length_m", "width_m", "depth_m", "capacity_m3")), sql.CAPACITY_GRID),
    "size_target": (lambda s, d: storage.sizes_for_targets(storage.site_sizes(part_sites(s, d))), sql.SIZE_TARGET),
    "size_target_too_large": (lambda s, d: storage.sizes_for_targets(storage.site_sizes(part_sites(s, d).withColumn("target_m3", F.col("target_m3") * 100))).where("NOT meets_target").select("site", "candidate", "capacity_m3"), sql.SIZE_TOO_LARGE),
    "size_tiers": (lambda s, d: storage.site_tiers(storage.site_sizes(part_sites(s, d))).select("site", "candidate", "label", "capacity_m3"), sql.SIZE_TIERS),
    "balance_daily": (lambda s, d: rounded(balance(s, d).select("design_id", "day", "overflow_m3", "supplied_m3", "end_storage_m3", "full", "empty"), 6), sql.BALANCE_DAILY),
    "balance_monthly": (lambda s, d: rounded(_monthly(s, d).select("design_id", "month", "rainfall_mm", "inflow_m3", "overflow_m3", "supplied_m3", "start_storage_m3", "end_storage_m3", "days_full", "days_empty"), 5), sql.BALANCE_MONTHLY),
    "balance_annual": (lambda s, d: rounded(storage.annual(_monthly(s, d)).select("design_id", "year", "inflow_m3", "overflow_m3", "supplied_m3", "end_storage_m3", "days_full"), 5), sql.BALANCE_ANNUAL),
    "balance_seasonal": (lambda s, d: rounded(storage.seasonal(_monthly(s, d), storage.season_table(s)).select("design_id", "year", "season", "inflow_m3", "overflow_m3", "start_storage_m3", "end_storage_m3", "days_full"), 5), sql.BALANCE_SEASONAL),
    "balance_totals": (lambda s, d: rounded(storage.totals(_monthly(s, d)).select("design_id", "inflow_m3", "overflow_m3", "supplied_m3", "residual_m3"), 5), sql.BALANCE_TOTALS),
    "balance_summary": (lambda s, d: rounded(_summary(s, d), 5), sql.BALANCE_SUMMARY),
    "balance_losses": (lambda s, d: rounded(storage.totals(storage.monthly(balance(s, d, True))).select("design_id", "evaporation_m3", "seepage_m3", "overflow_m3", "residual_m3"), 5), sql.BALANCE_LOSSES),
    "size_recommendation": (lambda s, d: rounded(storage.recommend(storage.evaluate_sizes(storage.candidate_grid(s), daily_rain(s, d).where(F.year("day").between(1996, 2000)), 4000.0)), 3), sql.SIZE_RECOMMENDATION),
    # contours, projection, parsing
    "contour_statistics": (lambda s, d: contours.statistics(sound_contours(s, d)), sql.CONTOUR_STATS),
    "contour_interval": (lambda s, d: contours.interval(order_contours(s, d)), sql.CONTOUR_INTERVAL),
    "contour_gaps": (lambda s, d: contours.elevation_gaps(order_contours(s, d)), sql.CONTOUR_GAPS),
    "contour_violations": (lambda s, d: contours.violations(order_contours(s, d)), sql.CONTOUR_VIOLATIONS),
    "contour_vertices": (lambda s, d: contours.vertices(sound_contours(s, d)), sql.CONTOUR_VERTICES),
    "contour_centre": (lambda s, d: rounded(contours.centre(sound_contours(s, d)), 6), sql.CONTOUR_CENTRE),
    "kml_round_trip": (kml_round_trip, sql.KML),
    "contour_folder": (contour_folder, sql.CONTOUR_FOLDER),
    "utm_zone": (lambda s, d: points(s, d).select("id", geodesy.utm_zone(F.col("lon"), F.col("lat")).alias("zone"), geodesy.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg")), sql.UTM_ZONE),
    "utm_project": (lambda s, d: rounded(contours.project(points(s, d).withColumn("zone", geodesy.utm_zone(F.col("lon"), F.col("lat"))), F.col("zone"), F.col("lat") < 0).select("id", "x", "y"), 3), sql.utm_project()),
    "utm_round_trip": (lambda s, d: _utm_back(s, d), sql.UTM_BACK),
    "tile_names": (lambda s, d: points(s, d).select("id", geodesy.tile_name(F.col("lat"), F.col("lon")).alias("tile"), geodesy.outward(F.col("lat") / 3, False).alias("south"), geodesy.outward(F.col("lat") / 3, True).alias("north")), sql.TILE_NAMES),
    "elevation_names": (lambda s, d: table(s, d, "part").select("p_partkey", parsing.elevation_of(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.format_string("  %d.5 m", F.col("p_size"))).otherwise(F.format_string("-%d", F.col("p_size")))).alias("elevation")), sql.ELEVATION_NAMES),
    "water_widths": (lambda s, d: part_water(s, d).select("feature_id", parsing.width_metres(F.col("width")).alias("width_m")), sql.WATER_WIDTHS),
    "water_tags": (lambda s, d: table(s, d, "nation").where(parsing.is_water(F.create_map(F.when(F.col("n_regionkey") == 0, "waterway").when(F.col("n_regionkey") == 1, "natural").otherwise("landuse"), F.when(F.col("n_nationkey") % 4 == 0, "river").when(F.col("n_nationkey") % 4 == 1, "water").otherwise("reservoir")))).select("n_nationkey"), sql.WATER_TAGS),
    "place_queries": (lambda s, d: table(s, d, "documents").select("doc_id", parsing.place_query(F.col("text")).alias("q")).where(F.col("q").isNotNull()), sql.PLACES),
    # rasters
    "regular_grid": (_regular, sql.REGULAR_GRID),
    "auto_resolution": (lambda s, d: table(s, d, "part").select("p_partkey", raster.auto_resolution(F.col("p_retailprice") * 20, (F.col("p_size") % 7).cast("double")).alias("resolution")), sql.AUTO_RESOLUTION),
    "grid_statistics": (lambda s, d: rounded(raster.grid_statistics(part_grid(s, d).withColumn("z", F.when(F.col("valid"), F.col("z"))))), sql.GRID_STATS),
    "slope": (lambda s, d: rounded(raster.with_slope(part_grid(s, d), RESOLUTION).select("row", "col", "slope_deg")), sql.SLOPE),
    "hillshade": (lambda s, d: rounded(raster.with_hillshade(part_grid(s, d)).select("row", "col", "shade")), sql.HILLSHADE),
    "local_slope": (lambda s, d: rounded(raster.with_local_slope(raster.with_slope(part_grid(s, d), RESOLUTION), RESOLUTION).select("row", "col", "local_slope_deg")), sql.LOCAL_SLOPE),
    "gaussian_smooth": (lambda s, d: rounded(raster.smoothed(part_grid(s, d), 1.0).select("row", "col", "z"), 5), sql.gaussian(raster.gaussian_weights(1.0))),
    "boundary_cells": (lambda s, d: raster.with_boundary(part_grid(s, d)).select("row", "col", "boundary"), sql.BOUNDARY),
    "edge_distance": (lambda s, d: rounded(raster.with_edge_distance(part_grid(s, d), RESOLUTION).select("row", "col", "edge_distance_m")), sql.EDGE_DISTANCE),
    "linear_surface": (_linear, sql.LINEAR),
    "nearest_fill": (_nearest, sql.NEAREST),
    "mask_runs": (lambda s, d: surfaces.mask_runs(part_grid(s, d), "valid").drop("survey"), sql.MASK_RUNS),
    "outline_rings": (_outline, sql.OUTLINE),
    "land_mask": (lambda s, d: surfaces.land_mask(placed(part_grid(s, d)), part_lands(s, d), RESOLUTION).select("land_id", "row", "col"), sql.LAND_MASK),
    "land_coverage": (lambda s, d: rounded(surfaces.land_coverage(placed(part_grid(s, d)), part_lands(s, d), RESOLUTION)), sql.LAND_COVERAGE),
    "water_mask": (lambda s, d: surfaces.water_mask(placed(part_grid(s, d)), part_water(s, d), 10.0, RESOLUTION).select("row", "col"), sql.WATER_MASK),
    # flow
    "d8_direction": (lambda s, d: hydrology.flow_direction(tile_grid(s, d), RESOLUTION).select("survey", "row", "col", "fdir"), sql.D8),
    "d8_histogram": (lambda s, d: hydrology.flow_direction(part_grid(s, d), RESOLUTION).groupBy("fdir").agg(F.count(F.lit(1)).alias("cells")), sql.D8_PART),
    "fill_depressions": (lambda s, d: hydrology.fill_depressions(tile_grid(s, d)).select("survey", "row", "col", "z_filled"), sql.FILL),
    "fill_over_blocks": (lambda s, d: hydrology.fill_depressions(tile_grid(s, d), side=3).select("survey", "row", "col", "z_filled"), sql.FILL),
    "flow_accumulation": (lambda s, d: flow_tiles(s, d).select("survey", "row", "col", "acc"), sql.ACCUMULATION),
    "accumulation_over_blocks": (lambda s, d: hydrology.flow_accumulation(hydrology.flow_direction(tile_grid(s, d), RESOLUTION), side=3).select("survey", "row", "col", "acc"), sql.ACCUMULATION),
    "channel_statistics": (lambda s, d: rounded(_tile_channels(s, d)), sql.CHANNELS),
    "hydrology": (_hydrology, sql.HYDROLOGY),
    "depressions": (_depressions, sql.DEPRESSIONS),
    # sites
    "catchment_areas": (_catchments, sql.CATCHMENTS),
    "catchments_over_blocks": (_catchments_over_blocks, sql.CATCHMENTS),
    "catchment_overlap": (_iou, sql.IOU),
    "overlap_over_blocks": (_iou_over_blocks, sql.IOU),
    "site_scores": (_scores, sql.SCORES),
    "site_selection": (_selected, sql.SELECTION),
    "outlet_nodes": (_outlets, sql.OUTLETS),
    # maps
    "osm_ways": (osm_ways, sql.OSM_WAYS),
    "relation_areas": (_relations, sql.RELATIONS),
    "latest_objects": (lambda s, d: surfaces.latest(table(s, d, "events").select((F.col("user_id")).alias("object_id"), "event_id", "event_type"), "object_id", "event_id"), sql.LATEST),
    "cache_lookup": (cache_hits, sql.CACHE),
    "quadrants": (lambda s, d: surfaces.quadrants(points(s, d).select("id", F.col("lat").alias("south"), F.col("lon").alias("west"), (F.col("lat") + F.col("id") % 9 * 0.25).cast("double").alias("north"), (F.col("lon") + F.col("id") % 5 * 0.25).cast("double").alias("east"))), sql.QUADRANTS),
}


def _utm_back(s: SparkSession, d: str) -> DataFrame:
    """Points to metres and back to degrees."""
    zoned = points(s, d).withColumns({"zone": geodesy.utm_zone(F.col("lon"), F.col("lat")), "south": F.col("lat") < 0})
    metres = contours.project(zoned, F.col("zone"), F.col("south"))
    lon, lat = geodesy.from_utm(F.col("x"), F.col("y"), F.col("zone"), F.col("south"))
    return rounded(metres.select("id", lon.alias("lon"), lat.alias("lat")), 7)


def _all() -> dict[str, tuple[Query, str | None]]:
    from rainfold import catalog_land  # it uses this module's tables

    return QUERIES | catalog_land.QUERIES


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _all().items() if text}

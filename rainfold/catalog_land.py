"""Queries on lands, ponds, public terrain and mapped water, with SQL; a part of the catalog. See `catalog` for how tables are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainfold import catalog as c
from rainfold import catalog_land_sql as sql
from rainfold.functions import geometry, parsing
from rainfold.operators import feasibility, hydrology, rainfall, raster, sites, surfaces, terrain
from rainfold.plans.store import cut, new_path, table
from rainfold.sources import readers


def ring(x: Column, y: Column, *at: tuple) -> Column:
    return F.array(*[F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y")) for a, b in at])


def pond_lands(s: SparkSession, d: str) -> DataFrame:
    """Nations as large triangles, some with a hole."""
    x, y = F.col("n_nationkey") * 9.0, F.col("n_nationkey") * 11.0
    none = F.array().cast(surfaces.HOLES)
    hole = F.array(ring(x, y, (150, 60), (170, 62), (160, 80), (150, 60)))
    return table(s, d, "nation").select(F.lit("part").alias("survey"), F.col("n_nationkey").alias("land_id"), ring(x, y, (-20, -10), (240, 40), (70, 220), (-20, -10)).alias("ring"), F.when(F.col("n_regionkey") % 2 == 0, hole).otherwise(none).alias("holes"))


def placed_ponds(s: SparkSession, d: str) -> DataFrame:
    """Parts as ponds somewhere in a nation's land; some are out of the limits, of some no water is known, some have no land."""
    k = F.col("p_partkey")
    return table(s, d, "part").select(
        F.lit("part").alias("survey"), k.alias("design_id"), (k % 27).alias("land_id"), (k % 27 * 9.0 + 60 + k % 13 * 7).cast("double").alias("x"), (k % 27 * 11.0 + 50 + k % 11 * 6).cast("double").alias("y"),
        (3 + k % 40).cast("double").alias("length_m"), (5 + F.col("p_size") % 30).cast("double").alias("width_m"), (1 + k % 4 * 0.5).cast("double").alias("depth_m"), (k * 7 % 360).cast("double").alias("bearing"),
        F.lit(2.0).alias("side_slope"), (0.25 + k % 3 * 0.375).cast("double").alias("freeboard_m"), (1 + k % 5).cast("double").alias("margin_m"), (k % 6 != 0).alias("water_known"),
    )


def _feasible(s: SparkSession, d: str) -> DataFrame:
    return feasibility.pond_feasibility(placed_ponds(s, d), pond_lands(s, d), c.part_water(s, d), 12.0).drop("survey")


def _runoff_area(s: SparkSession, d: str) -> DataFrame:
    """Catchments of each tile's five sites, less a pond on each that lies along or across the grid."""
    flow, traced = c.traced_sites(s, d)
    placed = c.placed(flow)
    at = placed.where(F.col("site").isNotNull())
    designs = at.select("survey", "site", (F.col("site") * 10).alias("design_id"), (F.col("x") + 2.5).alias("x"), (F.col("y") - 1.25).alias("y"), (20 + F.col("site") * 6).cast("double").alias("length_m"), F.lit(14.0).alias("width_m"), F.when(F.col("site") % 2 == 0, 90.0).otherwise(0.0).alias("bearing"))
    return c.rounded(feasibility.runoff_area(traced, placed, designs, c.RESOLUTION), 4)


def _windows(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    lands = table(s, d, "customer").select(k.alias("land_id"), (k * 37.25).alias("min_x"), (k * 11.5 - 900).alias("min_y"), (k * 37.25 + 40 + k % 17 * 1000).alias("max_x"), (k * 11.5 - 900 + 60 + k % 5 * 700).alias("max_y"))
    lands = lands.select("land_id", *[F.col(n).cast("double").alias(n) for n in ("min_x", "min_y", "max_x", "max_y")])
    return terrain.window_grid(lands.withColumn("area_m2", (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))), 2000.0)


def _tiles(s: SparkSession, d: str) -> DataFrame:
    p = c.points(s, d)
    return terrain.tiles_of(p.select("id", (F.col("lat") - 0.25).alias("south"), (F.col("lon") - 0.5).alias("west"), (F.col("lat") + F.col("id") % 3 * 0.25).cast("double").alias("north"), (F.col("lon") + F.col("id") % 4 * 0.25).cast("double").alias("east")))


def _bilinear(s: SparkSession, d: str) -> DataFrame:
    samples = c.part_grid(s, d).withColumn("z", F.when(F.col("valid"), F.col("z")))
    k = F.col("s_suppkey")
    asked = table(s, d, "supplier").select(F.lit("part").alias("survey"), k.alias("point"), (k * 13 % 40 / 8.0 + k % 7 * 0.125).cast("double").alias("r"), (k * 29 % 300 / 8.0).cast("double").alias("c"))
    return c.rounded(terrain.bilinear(samples, asked).drop("survey"))


def lakes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(ways, relations): suppliers as lakes of two ways in metres, every third with an island, every seventh not closed."""
    rel = c.supplier_relations(s, d)

    def wide(geo: Column) -> Column:
        return F.transform(geo, lambda p: F.struct((p["lon"] * 16).alias("lon"), (p["lat"] * 16).alias("lat")))

    k = F.col("relation_id")
    tags = F.create_map(F.lit("natural"), F.lit("water"))
    relations = rel.select(k, tags.alias("tags"), F.transform("members", lambda m: F.struct(m["role"].alias("role"), wide(m["geometry"]).alias("geometry"))).alias("members"), F.lit(0).alias("missing"))
    streams = rel.where(k % 4 == 0).select(k.alias("way_id"), F.create_map(F.lit("waterway"), F.lit("stream"), F.lit("width"), F.lit("6 m")).alias("tags"), wide(F.col("members")[0]["geometry"]).alias("geometry"), F.lit(0).alias("missing"))
    return streams, relations


def _map_water(s: SparkSession, d: str) -> DataFrame:
    """Cells that mapped lakes and streams reach, islands left dry."""
    found = surfaces.water_features(*lakes(s, d)).where("error IS NULL").withColumn("survey", F.lit("part"))
    return surfaces.water_mask(c.placed(c.part_grid(s, d)), found, 4.0, c.RESOLUTION).select("row", "col")


def _map_errors(s: SparkSession, d: str) -> DataFrame:
    return surfaces.water_features(*lakes(s, d)).groupBy(F.coalesce("error", F.lit("none")).alias("error"), "area").agg(F.count(F.lit(1)).alias("features"))


def _polygons(s: SparkSession, d: str) -> DataFrame:
    """Parts of each tile above zero, as a shell with its holes."""
    made = surfaces.outline_polygons(c.tile_grid(s, d).withColumn("high", F.col("z") >= 0), "high")
    return made.select("survey", "component.row", "component.col", F.size("holes").cast("long").alias("holes"), "area", F.abs(geometry.signed_area(F.col("shell"))).alias("shell_area"))


def _allowed(s: SparkSession, d: str) -> DataFrame:
    cells = c.part_grid(s, d).withColumns({"land": F.col("row") % 7 != 0, "water": F.col("col") % 11 == 0, "edge_distance_m": (F.col("row") % 5 * 10).cast("double"), "slope_deg": F.when(F.col("col") % 13 == 0, F.lit(float("nan"))).otherwise((F.col("col") % 10).cast("double"))})
    return sites.allowed_cells(cells, 10.0, 8.0, 1).select("row", "col")


def _pools(s: SparkSession, d: str) -> DataFrame:
    wet = hydrology.depressions(c.filled_tiles(s, d)).withColumns({"land": (F.col("survey") + F.col("row")) % 9 != 0, "water": (F.col("survey") * 3 + F.col("col")) % 8 == 0, "clearance": (F.col("row") * F.col("col") % 5).cast("double")})
    allowed = wet.where((F.col("row") + F.col("col")) % 3 != 0)
    return sites.depression_targets(cut(wet), allowed).select("survey", "component", "node", "cells", "bottom")


def _limits(s: SparkSession, d: str) -> DataFrame:
    some = raster.with_slope(c.flow_tiles(s, d), c.RESOLUTION).withColumnsRenamed({"acc": "area_cells", "slope_deg": "local_slope_deg"})
    return some.select("survey", "row", "col", "area_cells", "local_slope_deg").transform(lambda df: c.rounded(sites.scored(df, 100.0, min_ha=0.03, max_ha=0.2).select("survey", "row", "col", "area_cells", "score")))


def _assessed(s: SparkSession, d: str) -> DataFrame:
    """Each tile's five sites: the catchment on the raw surface taken as the filled one, and as the other the same without some cells."""
    flow, traced = c.traced_sites(s, d)
    fewer = traced.where((F.col("node") + F.col("site")) % 4 != 0)
    cells = raster.with_boundary(flow).withColumns({"z_filled": F.col("z") + F.when(F.col("node") % 5 == 0, 1.5).otherwise(0.0), "water": F.col("node") % 17 == 0})
    return c.rounded(sites.assessment(traced, fewer, cells, flow.count()))


def _land_errors(s: SparkSession, d: str) -> DataFrame:
    """Customers' plots: squares, some open, crossed, too wide, flat or empty."""
    k, lon, lat = F.col("id"), F.col("lon"), F.col("lat")
    square = ring(lon, lat, (0, 0), (0.125, 0), (0.125, 0.125), (0, 0.125), (0, 0))
    bow = ring(lon, lat, (0, 0), (0.125, 0.25), (0.125, 0), (0, 0.125), (0, 0))
    shapes = F.when(k % 8 == 0, F.slice(square, 1, 4)).when(k % 8 == 1, bow).when(k % 8 == 2, ring(F.lit(0.0), lat, (-120, 0), (120, 0), (0, 1), (-120, 0))).when(k % 8 == 3, ring(lon, lat, (0, 0), (0.125, 0.125), (0.25, 0.25), (0, 0))).when(k % 8 == 4, F.slice(square, 1, 0)).when(k % 8 == 5, ring(lon, F.lit(90.0), (0, 0), (0.125, 0), (0, 0.5), (0, 0))).otherwise(square)
    return surfaces.land_errors(c.points(s, d).select(k.alias("land_id"), shapes.alias("ring"))).select("land_id", "error")


def _members(s: SparkSession, d: str) -> DataFrame:
    """Orders as relations of customers' ways, every seventh way missing."""
    ways = c.points(s, d).where("id % 7 <> 3").select(F.col("id").alias("way_id"), F.array(F.struct("lon", "lat")).alias("geometry"))
    member = F.struct("l_linenumber", F.when(F.col("l_partkey") % 5 == 0, "node").otherwise("way").alias("type"), (F.col("l_partkey") % 150).alias("ref"), F.when(F.col("l_suppkey") % 2 == 0, "outer").otherwise("inner").alias("role"))
    listed = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("relation_id")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    made = surfaces.assemble_relations(listed.withColumn("tags", F.create_map(F.lit("natural"), F.lit("water"))), ways)
    return made.select("relation_id", "missing", F.size("members").cast("long").alias("members"), F.round(F.aggregate("members", F.lit(0.0), lambda t, m: t * 0.5 + m["geometry"][0]["lon"]), 6).alias("digest"))


def _rain_use(s: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("s_suppkey") % 6 == 0, F.lit(-999.0)).when(F.col("s_suppkey") % 6 == 1, F.lit(float("nan"))).when(F.col("s_suppkey") % 6 == 2, F.lit(float("inf"))).when(F.col("s_suppkey") % 6 == 3, F.lit(None).cast("double")).otherwise(F.col("s_acctbal"))
    return table(s, d, "supplier").select("s_suppkey", parsing.usable_rain(value).alias("usable"))


def _centroids(s: SparkSession, d: str) -> DataFrame:
    x, y = geometry.centroid(F.col("ring"))
    return c.rounded(c.part_lands(s, d).select("land_id", x.alias("x"), y.alias("y")))


def _raster_files(s: SparkSession, d: str) -> DataFrame:
    """Tiles written by survey, two of them read again."""
    path = new_path(s, "raster")
    readers.write_raster(c.tile_grid(s, d).withColumn("survey", F.col("survey") % 4), path)
    return readers.read_raster(s, path, True).where(F.col("survey").isin(1, 2)).groupBy(F.col("survey").cast("long").alias("survey")).agg(F.count(F.lit(1)).alias("cells"), F.sum("z").alias("z"))


def _responses(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "response")
    readers.write_response(c.part_grid(s, d).select("row", "col", "survey", "z"), path)
    back = s.read.json(path)
    return back.select(F.array_join(F.array(*map(F.lit, sorted(back.columns))), ",").alias("columns"), "z").groupBy("columns").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(F.col("z").cast("decimal(20,2)")), 2).cast("double").alias("z"))


def _slope_statistics(s: SparkSession, d: str) -> DataFrame:
    return c.rounded(raster.slope_statistics(raster.with_slope(c.part_grid(s, d), c.RESOLUTION)))


QUERIES: dict[str, tuple[c.Query, str | None]] = {
    "pond_feasibility": (_feasible, sql.FEASIBLE),
    "runoff_area": (_runoff_area, sql.RUNOFF_AREA),
    "terrain_windows": (_windows, sql.WINDOWS),
    "terrain_tiles": (_tiles, sql.TILES),
    "bilinear_heights": (_bilinear, sql.BILINEAR),
    "map_water_mask": (_map_water, sql.MAP_WATER),
    "map_water_errors": (_map_errors, sql.MAP_ERRORS),
    "outline_polygons": (_polygons, sql.POLYGONS),
    "slope_statistics": (_slope_statistics, sql.SLOPE_STATISTICS),
    "allowed_cells": (_allowed, sql.ALLOWED),
    "depression_targets": (_pools, sql.POOLS),
    "site_limits": (_limits, sql.LIMITS),
    "site_assessment": (_assessed, sql.ASSESSED),
    "site_centre": (lambda s, d: c.rounded(sites.centre(c.points(s, d))), sql.SITE_CENTRE),
    "land_errors": (_land_errors, sql.LAND_ERRORS),
    "land_centroids": (_centroids, sql.CENTROIDS),
    "local_lands": (lambda s, d: c.points(s, d).select("id", feasibility.is_local(F.col("lon"), F.col("lat"), F.col("lon") - F.col("id") % 5, F.col("lat") - 1, F.col("lon") + 1, F.col("lat") + F.col("id") % 4).alias("local")), sql.LOCAL),
    "osm_relations": (_members, sql.OSM_RELATIONS),
    "usable_rain": (_rain_use, sql.USABLE_RAIN),
    "year_windows": (lambda s, d: table(s, d, "orders").select("o_orderkey", *[y.alias(n) for n, y in zip(("first_year", "last_year"), rainfall.year_window(F.to_date("o_orderdate")), strict=True)]), sql.YEAR_WINDOWS),
    "raster_files": (_raster_files, sql.RASTER_FILES),
    "response_files": (_responses, sql.RESPONSE_FILES),
}

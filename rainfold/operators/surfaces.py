"""Masks and outlines: land, mapped water, runs of cells, polygons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainfold.functions import geometry, parsing
from rainfold.operators import blocks, overlay
from rainfold.plans.store import cut

HOLES = "array<array<struct<x:double,y:double>>>"


def mask_runs(cells: DataFrame, flag: str) -> DataFrame:
    """(survey, row, first_col, last_col, cells): unbroken runs of marked cells in a row (gaps and islands)."""
    some = cells.where(flag)
    place = F.col("col") - F.row_number().over(Window.partitionBy("survey", "row").orderBy("col"))
    return (
        some.withColumn("island__", place)
        .groupBy("survey", "row", "island__")
        .agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"), F.count(F.lit(1)).alias("cells"))
        .drop("island__")
    )


def outline_edges(cells: DataFrame, flag: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(survey, keep..., x0, y0, x1, y1): unit edges between marked cells and the rest, the marked cell on the left; grid units."""
    some = cells.where(flag).select("survey", "row", "col", *keep)
    tasks = -(-some.count() // blocks.TASK_CELLS) or 1
    for line, along in (("row", "col"), ("col", "row")):  # rows of as many tasks as cells need: a join with all four neighbours would be four times as many
        order = Window.partitionBy("survey", line).orderBy(along)
        near = {f"{along}{step}": F.count(F.lit(1)).over(order.rangeBetween(step, step)) > 0 for step in (-1, 1)}
        some = some.repartition(tasks, "survey", line).withColumns(near)
    sides = [("row-1", (0, 0, 1, 0)), ("col1", (1, 0, 1, 1)), ("row1", (1, 1, 0, 1)), ("col-1", (0, 1, 0, 0))]

    def edge(a: int, b: int, c: int, d: int) -> Column:
        return F.struct(*[(F.col(base) + k).cast("int").alias(name) for base, k, name in (("col", a, "x0"), ("row", b, "y0"), ("col", c, "x1"), ("row", d, "y1"))])

    rim = F.array_compact(F.array(*[F.when(~F.col(f"`{side}`"), edge(*at)) for side, at in sides]))
    return some.select("survey", *keep, F.explode(rim).alias("e__")).select("survey", *keep, "e__.*")


def outline_rings(edges: DataFrame, keys: tuple[str, ...] = ("survey",)) -> DataFrame:
    """keys + (ring, points, area): closed rings of outline edges, shells with positive area, holes with negative.

    Each edge points to the one that goes on from its end, turning right where four edges meet, so cells that touch at a corner stay
    apart. See `graph.rings`.
    """
    from rainfold.operators import graph

    ends = ("x0", "y0", "x1", "y1")
    whole = F.struct(*ends)
    none = F.lit(None).cast(edges.select(whole).schema[0].dataType)
    # a corner has two edges that come and two that go at most, so they meet by grouping, without a join of all edges with themselves
    at = F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), whole.alias("comes"), none.alias("goes")), F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), none.alias("comes"), whole.alias("goes"))))
    corners = edges.select(*keys, at.alias("at__")).groupBy(*keys, "at__.x", "at__.y").agg(F.collect_set("at__.comes").alias("comes__"), F.collect_set("at__.goes").alias("goes__"))

    def turn(n: Column) -> Column:
        dx, dy = (F.col(f"e__.{c}1") - F.col(f"e__.{c}0") for c in "xy")
        return dx * (n["y1"] - n["y0"]) - dy * (n["x1"] - n["x0"])

    follow = corners.select(*keys, F.explode("comes__").alias("e__"), "goes__").withColumn("n__", F.array_max(F.transform("goes__", lambda n: F.struct(turn(n).alias("turn"), n.alias("e"))))["e"]).where("n__ IS NOT NULL")
    step = cut(follow.select(F.struct(*keys, *[F.col(f"e__.{x}").alias(x) for x in ends]).alias("x"), F.struct(*keys, *[F.col(f"n__.{x}").alias(x) for x in ends]).alias("y")))
    made = graph.rings(step, list(keys), "x0", "y0").withColumn("ring", F.get("nodes", F.lit(0)))
    area = F.aggregate("nodes", F.lit(0).cast("long"), lambda t, n: t + n["x0"].cast("long") * n["y1"] - n["x1"].cast("long") * n["y0"]) / 2
    points = F.transform("nodes", lambda p: F.struct(p["x0"].alias("x"), p["y0"].alias("y")))
    return made.select(*[F.col(f"ring.{k}").alias(k) for k in keys], "ring", points.alias("points"), area.alias("area"))


def outline_polygons(cells: DataFrame, flag: str) -> DataFrame:
    """(survey, component, shell, holes, area): the marked cells' connected parts (by their sides) as closed rings in grid units.

    A part is named by its least cell; `area` is in cells. Holes come with the shell they lie in, as both bound the same part.
    """
    from rainfold.operators import graph

    some = cut(cells.where(flag).select("survey", "row", "col"))
    types = dict(some.dtypes)
    found = graph.grid_components(some, diagonal=False)
    row, col = (F.col(f"c{c}").cast(types[c]).alias(c) for c in ("row", "col"))
    parts = cut(found.select("survey", *[F.col(c).cast(types[c]).alias(c) for c in ("row", "col")], F.struct("survey", row, col).alias("component")))
    named = outline_edges(parts.withColumn("marked", F.lit(True)), "marked", ("component",))
    rings = outline_rings(named, ("survey", "component"))
    closed = F.transform(F.concat("points", F.slice("points", 1, 1)), lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    made = rings.withColumn("closed", closed).groupBy("survey", "component").agg(F.max(F.when(F.col("area") > 0, F.col("closed"))).alias("shell"), F.sort_array(F.collect_list(F.when(F.col("area") < 0, F.col("closed")))).alias("holes"), F.sum("area").cast("double").alias("area"))
    return made.select("survey", F.struct(F.col("component.row").alias("row"), F.col("component.col").alias("col")).alias("component"), "shell", "holes", "area")


def in_degrees(polygons: DataFrame, epsg: int, west: float, south: float, resolution: float) -> DataFrame:
    """polygons (shell, holes in grid units) in degrees of WGS84: (west, south) is the centre of the cell at row and column 0 in the UTM zone's metres."""
    from rainfold.functions import geodesy

    zone, below = F.lit(epsg % 100), F.lit(epsg >= 32700)

    def moved(ring: Column) -> Column:
        def point(p: Column) -> Column:
            lon, lat = geodesy.from_utm(west + (p["x"] - 0.5) * resolution, south + (p["y"] - 0.5) * resolution, zone, below)
            return F.struct(lon.alias("x"), lat.alias("y"))

        return F.transform(ring, point)

    return polygons.withColumns({"shell": moved(F.col("shell")), "holes": F.transform("holes", moved)})


def largest_outline(polygons: DataFrame) -> DataFrame:
    """(survey, shell): the shell of each survey's largest polygon, ties to the least component."""
    best = F.max_by("shell", F.struct("area", -F.col("component.row"), -F.col("component.col")))
    return polygons.groupBy("survey").agg(best.alias("shell"))


def terrain_outline(bounds: DataFrame, epsg: int, resolution: float) -> DataFrame:
    """bounds (min_x, min_y, max_x, max_y of cell centres) + ring in degrees: the outer cell edges of a raster, closed."""
    from rainfold.functions import geodesy

    half = resolution / 2
    sides = {"x": (F.col("min_x") - half, F.col("max_x") + half), "y": (F.col("min_y") - half, F.col("max_y") + half)}
    corners = [(sides["x"][i], sides["y"][j]) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
    made = [geodesy.from_utm(x, y, F.lit(epsg % 100), F.lit(epsg >= 32700)) for x, y in corners]
    return bounds.withColumn("ring", F.array(*[F.struct(lon.alias("x"), lat.alias("y")) for lon, lat in made]))


def ring_of(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(p["lon"].cast("double").alias("x"), p["lat"].cast("double").alias("y")))


def land_errors(areas: DataFrame) -> DataFrame:
    """areas (land_id, ring ARRAY<STRUCT<x, y>> in degrees, perhaps holes) + error: the first check a selected land fails, else null.

    Holes have to be closed, simple and covered by the ring, and count among the vertices.
    """
    ring = F.col("ring")
    holes = F.coalesce("holes", F.array().cast(HOLES)) if "holes" in areas.columns else F.array().cast(HOLES)
    vertices = F.size(ring) + F.aggregate(holes, F.lit(0), lambda t, h: t + F.size(h))
    bad_hole = F.exists(holes, lambda h: ~F.coalesce(geometry.is_closed(h), F.lit(False)) | (geometry.signed_area(h) == 0) | ~geometry.simple(h) | F.exists(h, lambda p: ~geometry.covers_point(ring, p["x"], p["y"])))
    finite = F.forall(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) <= 180) & (F.abs(p["y"]) <= 90))
    wide = F.array_max(F.transform(ring, lambda p: p["x"])) - F.array_min(F.transform(ring, lambda p: p["x"]))
    return areas.withColumn(
        "error",
        F.when(ring.isNull() | (F.size(ring) == 0), "missing")
        .when(vertices > 10_000, "too_many_vertices")
        .when(~F.coalesce(geometry.is_closed(ring), F.lit(False)), "not_closed")
        .when(~F.coalesce(finite, F.lit(False)), "out_of_range")
        .when(wide > 180, "too_wide")
        .when(geometry.signed_area(ring) == 0, "no_area")
        .when(~geometry.simple(ring), "self_intersecting")
        .when(F.coalesce(bad_hole, F.lit(True)), "bad_hole"),
    )


def with_holes(features: DataFrame) -> DataFrame:
    """features with a column `holes` that is never null."""
    none = F.array().cast(HOLES)
    return features.withColumn("holes", F.coalesce("holes", none) if "holes" in features.columns else none)


def land_mask(cells: DataFrame, lands: DataFrame, resolution: float) -> DataFrame:
    """(survey, land_id, row, col): cells whose whole square lies in a land's ring and in none of its holes.

    Lands carry ring and holes in the cells' metres; cells and lands meet in squares, see `overlay`.
    """
    half, side = resolution / 2, 16 * resolution
    of = overlay.pieces(with_holes(lands), ["survey", "land_id"], side, "ring", half)

    def test(v: dict, _: float, near: overlay.Parts, band: overlay.Parts) -> dict | None:
        x, y = np.array(v["xs"]), np.array(v["ys"])
        fine = overlay.inside(near, band, x, y)
        for edges in near:
            if len(edges) and fine.any():
                fine &= ~overlay.crosses(edges, x - half, y - half, x + half, y + half)
        return {"row": np.array(v["rows"])[fine], "col": np.array(v["cols"])[fine]} if fine.any() else None

    met = overlay.met(overlay.cell_squares(cells, ["survey"], side), of, ["survey", "bx", "by"])
    return overlay.refined(met, ["survey", "land_id"], ["rows", "cols", "xs", "ys"], test, "row int, col int")


def land_coverage(cells: DataFrame, lands: DataFrame, resolution: float) -> DataFrame:
    """(survey, land_id, area_ha, terrain_coverage_fraction, partial_terrain_coverage): how much of a land, its holes taken out, the
    raster's cells hold; 0 for a land that no cell meets. Squares wholly inside count their cells, only others look at edges."""
    half, side = resolution / 2, 16 * resolution
    whole_lands = with_holes(lands).select("survey", "land_id", "ring", "holes")
    of = overlay.pieces(whole_lands, ["survey", "land_id"], side, "ring", half)

    def test(v: dict, _: float, near: overlay.Parts, band: overlay.Parts) -> dict:
        return {"part": np.array([held_area(v["xs"], v["ys"], half, near, band)])}

    met = overlay.met(overlay.cell_squares(cells, ["survey"], side), of, ["survey", "bx", "by"])
    parts = overlay.refined(met, ["survey", "land_id"], ["xs", "ys"], test, "part double").groupBy("survey", "land_id").agg(F.sum("part").alias("part"))
    whole = F.abs(geometry.signed_area(F.col("ring"))) - F.aggregate("holes", F.lit(0.0), lambda t, h: t + F.abs(geometry.signed_area(h)))
    made = whole_lands.select("survey", "land_id", whole.alias("whole")).join(parts, ["survey", "land_id"], "left")
    share = F.least(F.lit(1.0), F.coalesce("part", F.lit(0.0)) / F.col("whole"))
    return made.select("survey", "land_id", (F.col("whole") / 1e4).alias("area_ha"), share.alias("terrain_coverage_fraction"), (share < 1 - 1e-6).alias("partial_terrain_coverage"))


def held_area(xs: list[float], ys: list[float], half: float, near: overlay.Parts, band: overlay.Parts) -> float:
    """The area that cells have in common with a piece's ring, its holes taken out."""
    x, y = np.array(xs), np.array(ys)
    if not any(map(len, near)):
        return len(x) * (2 * half) ** 2
    ring, *holes = (overlay.area_in(edges, x - half, y - half, x + half, y + half).sum() for edges in band)
    return float(ring - sum(holes))


def water_mask(cells: DataFrame, features: DataFrame, buffer_m: float, resolution: float) -> DataFrame:
    """(survey, row, col) of cells whose centre is within a feature's reach or inside a water area.

    Features are (survey, feature_id, line ARRAY<STRUCT<x, y>>, area BOOLEAN, width STRING) and may have `holes`, islands of an area
    that stay dry but for the reach of their shores. Cells and features meet in squares, see `overlay`.
    """
    reach = F.lit(buffer_m + resolution / 2**0.5) + F.when(F.col("area"), 0.0).otherwise(parsing.width_metres(F.col("width")) / 2)
    side = 16 * resolution
    of = overlay.pieces(with_holes(features), ["survey"], side, "line", reach, F.col("area"))

    def test(v: dict, far: float, near: overlay.Parts, band: overlay.Parts) -> dict | None:
        x, y = np.array(v["xs"]), np.array(v["ys"])
        wet = overlay.inside(near, band, x, y)
        for edges in near:
            wet |= overlay.distance(edges, x, y) <= far
        return {"row": np.array(v["rows"])[wet], "col": np.array(v["cols"])[wet]} if wet.any() else None

    met = overlay.met(overlay.cell_squares(cells, ["survey"], side), of, ["survey", "bx", "by"])
    return overlay.refined(met, ["survey"], ["rows", "cols", "xs", "ys"], test, "row int, col int").distinct()


def water_features(ways: DataFrame, relations: DataFrame) -> DataFrame:
    """(feature_id, line, holes, area, width, error) of mapped water, in degrees, from assembled ways and relations.

    Ways come from `assemble_ways`, relations from `assemble_relations`. Water areas of ways are closed lines; relations that are areas
    give a row for each shell with the relation's holes, others one for each way. Where geometry lacks or does not close, `error`
    says so and no line is given, so such water is never taken for dry land.
    """
    from rainfold.operators import polygonize

    area = F.coalesce(F.col("tags")["natural"] == "water", F.lit(False)) | F.coalesce(F.col("tags")["waterway"] == "riverbank", F.lit(False)) | F.coalesce(F.col("tags")["landuse"] == "reservoir", F.lit(False))
    none = F.array().cast(HOLES)
    line = ring_of(F.col("geometry"))
    wet_ways = ways.where(parsing.is_water(F.col("tags"))).select(F.concat(F.lit("way/"), "way_id").alias("feature_id"), line.alias("line"), area.alias("area"), F.col("tags")["width"].alias("width"), "missing")
    way_error = F.when((F.col("missing") > 0) | (F.size("line") < 2), "missing_geometry").when(F.col("area") & ~F.coalesce(geometry.is_closed(F.col("line")), F.lit(False)), "not_closed")
    of_ways = wet_ways.withColumn("error", way_error).select("feature_id", F.when(F.col("error").isNull(), F.col("line")).alias("line"), none.alias("holes"), "area", "width", "error")
    wet = relations.where(parsing.is_water(F.col("tags"))).withColumn("area", area)
    name = F.concat(F.lit("relation/"), "relation_id").alias("feature_id")
    width = F.col("tags")["width"].alias("width")
    closed = polygonize.relation_areas(wet.where("area").select("relation_id", "members")).join(wet.select("relation_id", "tags", "missing"), "relation_id")
    bad = F.when(F.col("missing") > 0, "missing_geometry").otherwise(F.col("error"))
    shells = closed.withColumn("bad", bad).select(name, F.explode_outer(F.when(F.col("bad").isNull(), F.col("shells"))).alias("line"), F.when(F.col("bad").isNull(), F.col("holes")).otherwise(none).alias("holes"), F.lit(True).alias("area"), width, F.col("bad").alias("error"))
    open_lines = wet.where(~F.col("area")).withColumn("bad", F.when((F.col("missing") > 0) | (F.size("members") == 0) | F.exists("members", lambda m: F.size(m["geometry"]) < 2), "missing_geometry"))
    lines = open_lines.select(name, F.explode_outer(F.when(F.col("bad").isNull(), F.transform("members", lambda m: ring_of(m["geometry"])))).alias("line"), none.alias("holes"), F.lit(False).alias("area"), width, F.col("bad").alias("error"))
    return of_ways.unionByName(shells).unionByName(lines)


def in_metres(features: DataFrame, epsg: int) -> DataFrame:
    """features with line and holes in a UTM zone's metres."""
    from rainfold.functions import geodesy

    zone, south = F.lit(epsg % 100), F.lit(epsg >= 32700)

    def moved(ring: Column) -> Column:
        def point(p: Column) -> Column:
            x, y = geodesy.to_utm(p["x"], p["y"], zone, south)
            return F.struct(x.alias("x"), y.alias("y"))

        return F.transform(ring, point)

    return features.withColumns({"line": moved(F.col("line")), "holes": F.transform("holes", moved)})


def assemble_ways(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(way_id, tags, geometry, missing): node coordinates in the order of a way's references; `missing` counts those without one."""
    refs = ways.select("way_id", "tags", F.posexplode("refs").alias("at", "node_id"))
    placed = refs.join(nodes.select("node_id", "lon", "lat"), "node_id", "left")
    made = placed.groupBy("way_id").agg(
        F.first("tags").alias("tags"),
        F.sort_array(F.collect_list(F.when(F.col("lon").isNotNull(), F.struct("at", F.struct("lon", "lat").alias("p"))))).alias("points"),
        F.count_if(F.col("lon").isNull()).alias("missing"),
    )
    return made.select("way_id", "tags", F.col("points.p").alias("geometry"), "missing")


def assemble_relations(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """(relation_id, tags, members, missing): geometries of a relation's ways by position; node members are left out, a
    relation as a member raises an error, a way that is not there is counted."""
    members = relations.select("relation_id", "tags", F.posexplode("members").alias("at", "m"))
    nested = F.when(F.col("m.type") == "relation", F.raise_error(F.format_string("relation %d holds a relation", F.col("relation_id"))).cast("boolean")).otherwise(F.col("m.type") == "way")
    placed = members.where(nested).join(ways.select(F.col("way_id").alias("ref"), "geometry"), F.col("m.ref") == F.col("ref"), "left")
    made = placed.groupBy("relation_id").agg(
        F.first("tags").alias("tags"),
        F.sort_array(F.collect_list(F.when(F.col("ref").isNotNull(), F.struct("at", F.col("m.role").alias("role"), "geometry")))).alias("found"),
        F.count_if(F.col("ref").isNull()).alias("missing"),
    )
    return made.select("relation_id", "tags", F.transform("found", lambda x: F.struct(x["role"].alias("role"), x["geometry"].alias("geometry"))).alias("members"), "missing")


def latest(objects: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last loaded one."""
    rest = F.struct(*objects.columns)
    return objects.groupBy(F.col(key).alias("key__")).agg(F.max_by(rest, order).alias("row")).select("row.*")


def covering_cache(records: DataFrame, asked: DataFrame, ttl_s: float) -> DataFrame:
    """asked + the newest fresh record whose box holds the asked one: a containment join and the first by age."""
    box = ["south", "west", "north", "east"]
    holds = (F.col("c.south") <= F.col("a.south")) & (F.col("c.west") <= F.col("a.west")) & (F.col("c.north") >= F.col("a.north")) & (F.col("c.east") >= F.col("a.east"))
    # age only bounds a record from below, so the newest one counts alone, of equal boxes as of all that hold the asked one
    newest = records.where("at IS NOT NULL AND NOT isnan(at)").groupBy(*box).agg(F.max(F.struct("at", "record_id")).alias("last"))
    # boxes meet by the one-degree tiles of the asked box's corner, so the join has an equal key
    tiled = newest.withColumn("ty", F.explode(F.sequence(F.floor("south").cast("long"), F.floor("north").cast("long")))).withColumn("tx", F.explode(F.sequence(F.floor("west").cast("long"), F.floor("east").cast("long")))).alias("c")
    where = asked.select(*box).distinct().withColumns({"qy": F.floor("south").cast("long"), "qx": F.floor("west").cast("long")}).alias("a")
    got = where.join(tiled, (F.col("a.qy") == F.col("c.ty")) & (F.col("a.qx") == F.col("c.tx")) & holds)
    found = got.groupBy(*[F.col(f"a.{c}").alias(c) for c in box]).agg(F.max("c.last").alias("last"))
    fresh = asked.join(found, box).where(F.col("at") - F.col("last.at") <= ttl_s)
    return fresh.groupBy("query_id").agg(F.max(F.struct("last.at", "last.record_id")).alias("last")).select("query_id", F.col("last.record_id").alias("record_id"))


def quadrants(boxes: DataFrame, levels: int = 3, largest: float = 0.25) -> DataFrame:
    """Boxes split in four, up to `levels` times, until none is larger than `largest` square degrees."""
    now = boxes
    for _ in range(levels):
        big = (F.col("north") - F.col("south")) * (F.col("east") - F.col("west")) > largest
        y, x = (F.col("south") + F.col("north")) / 2, (F.col("west") + F.col("east")) / 2
        four = F.array(*[F.struct(s.alias("south"), w.alias("west"), n.alias("north"), e.alias("east")) for s, n in ((F.col("south"), y), (y, F.col("north"))) for w, e in ((F.col("west"), x), (x, F.col("east")))])
        one = F.array(F.struct("south", "west", "north", "east"))
        rest = [c for c in now.columns if c not in ("south", "west", "north", "east")]
        now = now.select(*rest, F.explode(F.when(big, four).otherwise(one)).alias("b")).select(*rest, "b.*")
    return now

"""Whether a pond fits its land and keeps clear of mapped water, and how much of a catchment it leaves to run off.

A pond's rectangle is looked at in its own frame, where it is a box about the origin: edges of rings and lines are turned instead, and
the tests on boxes of `overlay` serve for any bearing. Ponds meet land and water in squares.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainfold.functions import parsing
from rainfold.operators import blocks, overlay
from rainfold.operators.surfaces import held_area, with_holes
from rainfold.plans.store import apart, cut

#: Limits of a design's inputs: column, least and most value (fixed values of the planning tool).
LIMITS = [("length_m", 5.0, 500.0), ("width_m", 5.0, 500.0), ("depth_m", 0.5, 3.0), ("bearing", 0.0, 360.0), ("side_slope", 1.0, 4.0), ("freeboard_m", 0.1, 1.0), ("margin_m", 1.0, 30.0)]


def design_error(columns: list[str]) -> Column:
    """The first check that a design fails: a number out of its limits, no room above the water, no bottom; null if none."""
    out = F.lit(None).cast("string")
    late = [("freeboard_too_large", F.col("freeboard_m") >= F.col("depth_m")), ("no_bottom", F.least("length_m", "width_m") - 2 * F.col("side_slope") * F.col("depth_m") <= 0)]
    for code, bad in late[::-1]:
        out = F.when(bad, code).otherwise(out)
    for name, low, high in LIMITS[::-1]:
        if name in columns:
            out = F.when(~F.coalesce(F.col(name).between(low, high), F.lit(False)), name).otherwise(out)
    return out


def is_local(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether a land's bounds lie between 80 degrees south and 84 north and none further than three degrees from a site."""
    far = F.greatest(F.abs(west - lon), F.abs(east - lon), F.abs(south - lat), F.abs(north - lat))
    return F.coalesce((south >= -80) & (north <= 84) & (far <= 3), F.lit(False))


def turned(edges: np.ndarray, x: np.ndarray, y: np.ndarray, bearing: np.ndarray) -> np.ndarray:
    """(n, m, 4): m edges in the frames of n rectangles about (x, y): x across, y along their length."""
    c, s = (f(np.radians(bearing))[:, None, None] for f in (np.cos, np.sin))
    u, v = edges[None, :, 0::2] - x[:, None, None], edges[None, :, 1::2] - y[:, None, None]
    return np.stack([u * c - v * s, u * s + v * c], axis=3).reshape(len(x), len(edges), 4)


def crosses_box(edges: np.ndarray, half_w: np.ndarray, half_l: np.ndarray) -> np.ndarray:
    return overlay.crosses(edges, -half_w, -half_l, half_w, half_l)


def box_distance(edges: np.ndarray, half_w: np.ndarray, half_l: np.ndarray) -> np.ndarray:
    """Distances of n boxes about the origin from their (n, m, 4) edges, 0 where they meet."""
    beyond = [np.maximum(np.abs(edges[:, :, k::2]) - half[:, None, None], 0.0) for k, half in ((0, half_w), (1, half_l))]
    out = np.hypot(*beyond).min(axis=(1, 2), initial=np.inf)
    for a in (-1, 1):
        for b in (-1, 1):
            out = np.minimum(out, overlay.distance(edges, a * half_w, b * half_l))
    return np.where(crosses_box(edges, half_w, half_l), 0.0, out)


def around(designs: DataFrame, side: float) -> DataFrame:
    """designs + (bx, by): a row for each square that the circle about a design's rectangle overlaps."""
    far = F.hypot("half_w", "half_l")
    for axis, name in (("x", "bx"), ("y", "by")):
        designs = designs.withColumn(name, F.explode(F.sequence(F.floor((F.col(axis) - far) / side).cast("long"), F.floor((F.col(axis) + far) / side).cast("long"))))
    return designs


def pond_feasibility(designs: DataFrame, lands: DataFrame, water: DataFrame, buffer_m: float = 30.0, side: float = 64.0) -> DataFrame:
    """(survey, design_id, error, within_selected_land, avoids_mapped_water, screening_status) of every design.

    Designs are (survey, design_id, land_id, x, y, length_m, width_m, depth_m, bearing, side_slope, freeboard_m, margin_m, water_known),
    in metres; the rectangle grown by its margin has to lie in the land and off its holes, and further than the buffer (and half
    a line's width) from water. Without knowledge of the water a design that fits stays `unverified`, it never passes; one that
    does not fit the land, or has no land, is not asked about water. A design with an error has nulls and the status `invalid`.
    """
    half_w, half_l = F.col("width_m") / 2 + F.col("margin_m"), F.col("length_m") / 2 + F.col("margin_m")
    frame = ["x", "y", "bearing", "half_w", "half_l"]
    sized = designs.withColumns({"half_w": half_w, "half_l": half_l, "error": design_error(designs.columns)})

    names, ids = ["design_id", *frame], dict(designs.dtypes)["design_id"]
    ask = [*names, "bx", "by"]

    def home(v: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the square is the one that a design's middle lies in."""
        return (np.floor(x / side) == v["bx"]) & (np.floor(y / side) == v["by"])

    def decided(v: dict, near: overlay.Parts, far: float, exact: Callable[..., np.ndarray]) -> np.ndarray:
        """Where edges come within `far` of a rectangle: by the circles in and about it, exactly only between these."""
        x, y, bearing, half_w, half_l = (np.array(v[c]) for c in frame)
        apart = np.min([overlay.distance(e, x, y) for e in near], axis=0) - far
        out = apart < np.minimum(half_w, half_l) * (1 - 1e-9)
        at = np.flatnonzero(~out & (apart <= np.hypot(half_w, half_l) * (1 + 1e-9)))
        for edges in near if len(at) else ():
            out[at] |= exact(turned(edges, x[at], y[at], bearing[at]), half_w[at], half_l[at])
        return out

    def on_land(v: dict, _: float, near: overlay.Parts, band: overlay.Parts) -> dict:
        x, y = np.array(v["x"]), np.array(v["y"])
        crossed = decided(v, near, 0.0, crosses_box)
        return {"design_id": np.array(v["design_id"]), "crossed": crossed, "covered": home(v, x, y) & overlay.inside(near, band, x, y)}

    fine = around(sized.where("error IS NULL").select("survey", "land_id", *names), side)
    land = overlay.pieces(with_holes(lands), ["survey", "land_id"], side, "ring")
    met = overlay.met(overlay.grouped(fine, ["survey", "land_id", "bx", "by"], names), land, ["survey", "land_id", "bx", "by"])
    found = overlay.refined(met, ["survey"], ask, on_land, f"design_id {ids}, crossed boolean, covered boolean")
    within = found.groupBy("survey", "design_id").agg((F.bool_or("covered") & ~F.bool_or("crossed")).alias("within__"))
    fitted = cut(sized.join(apart(within), ["survey", "design_id"], "left").withColumn("within_selected_land", F.when(F.col("error").isNull(), F.coalesce("within__", F.lit(False)))).drop("within__"))

    def in_water(v: dict, pieces: list[tuple[float, overlay.Parts, overlay.Parts]]) -> np.ndarray:
        """Which designs some water meets; each is asked only until the first does."""
        x, y = v["x"], v["y"]
        own, round_ = home(v, x, y), np.hypot(v["half_w"], v["half_l"]) * (1 + 1e-6) + 1e-6
        wet = np.zeros(len(x), bool)
        for far, near, band in pieces:
            left = np.flatnonzero(~wet)
            if not len(left):
                break
            at = left[own[left]]
            wet[at] |= overlay.inside(near, band, x[at], y[at])
            ends = np.concatenate(near).reshape(-1, 2)
            if len(ends):  # only designs whose circle comes within reach of the box about the edges
                low, high = ends.min(axis=0) - far, ends.max(axis=0) + far
                u, w, r = x[left], y[left], round_[left]
                at = left[(u >= low[0] - r) & (u <= high[0] + r) & (w >= low[1] - r) & (w <= high[1] + r) & ~wet[left]]
                wet[at] |= decided({c: v[c][at] for c in frame}, near, far, lambda edges, w, l, far=far: box_distance(edges, w, l) <= far)
        return wet

    asked = around(fitted.where(F.col("within_selected_land") & F.col("water_known")).select("survey", *names), side)
    reach = F.lit(buffer_m) + F.when(F.col("area"), 0.0).otherwise(parsing.width_metres(F.col("width")) / 2)
    features = with_holes(water).select("survey", "line", "holes", "area", reach.alias("reach")).distinct()  # the same water mapped again changes nothing
    of = overlay.pieces(features, ["survey"], side, "line", F.col("reach"), F.col("area"))
    met = overlay.crowds(asked, of, ["survey", "bx", "by"], names)
    wet = overlay.settled(met, ["survey"], "design_id", frame, in_water).distinct().withColumn("wet", F.lit(True))
    known = fitted.join(apart(wet), ["survey", "design_id"], "left")
    avoids = F.when(F.col("within_selected_land") & F.col("water_known"), F.col("wet").isNull())
    status = (
        F.when(F.col("error").isNotNull(), "invalid")
        .when(~F.col("within_selected_land"), "does_not_fit")
        .when(avoids.isNull(), "unverified")
        .when(avoids, "passes_checks")
        .otherwise("does_not_fit")
    )
    return known.select("survey", "design_id", "error", "within_selected_land", avoids.alias("avoids_mapped_water"), status.alias("screening_status"))


def runoff_area(catchments: DataFrame, cells: DataFrame, designs: DataFrame, resolution: float, side: float = 256.0) -> DataFrame:
    """(survey, site, design_id, catchment_m2, covered_m2, runoff_area_m2): catchments less what of a pond's rectangle lies in them.

    Catchments are (survey, node, site), cells (survey, node, x, y), designs (survey, site, design_id, x, y, length_m, width_m, bearing).
    """
    from rainfold.operators.storage import footprint_corners

    half = resolution / 2
    corners = footprint_corners(F.col("x"), F.col("y"), F.col("length_m"), F.col("width_m"), F.col("bearing"), F.lit(0.0))
    rings = designs.withColumn("c__", corners).select("survey", "site", "design_id", F.concat("c__", F.slice("c__", 1, 1)).alias("ring"))
    placed = blocks.joined(catchments.select("survey", "node", "site"), cells.select("survey", "node", "x", "y"), ("survey", "node"), cells.count())
    of = overlay.pieces(rings, ["survey", "site", "design_id"], side, "ring", half)
    squares = placed.select("survey", "site", F.floor(F.col("x") / side).cast("long").alias("bx"), F.floor(F.col("y") / side).cast("long").alias("by"), "x", "y")
    met = overlay.met(overlay.grouped(squares, ["survey", "site", "bx", "by"], ["x", "y"]), of, ["survey", "site", "bx", "by"])
    part = overlay.refined(met, ["survey", "site", "design_id"], ["x", "y"], lambda v, _, near, band: {"part": np.array([held_area(v["x"], v["y"], half, near, band)])}, "part double")
    covered = part.groupBy("survey", "site", "design_id").agg(F.sum("part").alias("covered_m2"))
    whole = catchments.groupBy("survey", "site").agg((F.count(F.lit(1)) * (resolution * resolution)).alias("catchment_m2"))
    made = designs.select("survey", "site", "design_id").join(whole, ["survey", "site"]).join(covered, ["survey", "site", "design_id"], "left").withColumn("covered_m2", F.coalesce("covered_m2", F.lit(0.0)))
    return made.withColumn("runoff_area_m2", F.col("catchment_m2") - F.col("covered_m2"))

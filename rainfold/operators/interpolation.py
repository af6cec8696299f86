"""Linear interpolation over the Delaunay triangulation of scattered points, tile by tile."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainfold.functions import geometry
from rainfold.plans.store import cut

#: Entries of the matrix of cells by points that a step holds at once.
BLOCK = 2_000_000


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions of the corners of the convex hull, counter-clockwise (monotone chain)."""
    order = np.lexsort((y, x))

    def chain(places: np.ndarray) -> list[int]:
        out: list[int] = []
        for p in places:
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[p] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[p] - x[out[-2]]) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = chain(order), chain(order[::-1])
    return np.array(lower[:-1] + upper[:-1] if len(order) > 1 else lower, int)


def hull_rings(points: DataFrame, side: float) -> DataFrame:
    """(survey, ring, min_x, min_y, max_x, max_y): the closed hull of each survey, from the hulls of its tiles.

    Surveys of fewer than three corners have none.
    """
    def corners(part: pd.DataFrame) -> pd.DataFrame:
        return part.iloc[hull(part["x"].to_numpy(), part["y"].to_numpy())][["survey", "x", "y"]]

    def ring(part: pd.DataFrame) -> pd.DataFrame:
        at = hull(part["x"].to_numpy(), part["y"].to_numpy())
        x, y = part["x"].to_numpy()[at], part["y"].to_numpy()[at]
        points = [{"x": float(a), "y": float(b)} for a, b in zip([*x, x[0]], [*y, y[0]], strict=True)]
        return pd.DataFrame({"survey": [part["survey"].iloc[0]], "ring": [points], "min_x": x.min(), "min_y": y.min(), "max_x": x.max(), "max_y": y.max()})

    kind = points.schema["survey"].dataType.simpleString()
    tiled = points.select("survey", "x", "y", F.floor(F.col("x") / side).alias("bx"), F.floor(F.col("y") / side).alias("by"))
    some = tiled.groupBy("survey", "bx", "by").applyInPandas(corners, f"survey {kind}, x double, y double")
    made = some.groupBy("survey").applyInPandas(ring, f"survey {kind}, ring array<struct<x:double,y:double>>, min_x double, min_y double, max_x double, max_y double")
    return made.where(F.size("ring") > 3)


def weights(corners: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Barycentric weights (n, 3) of places (n, 2) in triangles (n, 3, 2)."""
    a, b, c = corners[:, 0], corners[:, 1], corners[:, 2]
    whole = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    second = ((at[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (at[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) / whole
    third = ((b[:, 0] - a[:, 0]) * (at[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (at[:, 0] - a[:, 0])) / whole
    return np.stack([1 - second - third, second, third], axis=1)


def triangles(points: np.ndarray, at: np.ndarray, greedy: int = 200) -> np.ndarray:
    """Positions (n, 3) of the Delaunay triangle of `points` about each place of `at`; -1 where there is none.

    Lifted to the paraboloid, the triangle about a place is the facet of the lower hull over it: the optimum of a linear
    program in three unknowns. All places take dual simplex steps together: the point furthest below the facet comes in,
    the corner that leaves keeps the place inside. Three far corners, lifted out of the way, start it. Places are moved by
    a billionth towards the middle, so none lies on an edge; which of the triangulations of cocircular points is
    taken is open. Steps go on until no place moves. After `greedy` of them the first point below the facet comes in and of
    corners that may leave the first does (Bland's rule), which cannot go round in circles, however degenerate the points are.
    """
    middle, scale = points.mean(axis=0), max(np.ptp(points, axis=0).max(), np.ptp(at, axis=0).max(), np.abs(at - points.mean(axis=0)).max(), 1e-12)
    p, q = (points - middle) / scale, (at - middle) / scale
    q = q * (1 - 1e-9) + 1e-11 * np.array([0.618, -0.414])
    n = len(p)
    p = np.vstack([p, [[-40.0, -30.0], [40.0, -30.0], [0.0, 60.0]]])
    lift = (p * p).sum(axis=1)
    lift[n:] = 1e7
    found = np.tile(np.arange(n, n + 3), (len(q), 1))
    open_, step = np.arange(len(q)), max(1, BLOCK // (n + 3))
    rounds = 0
    while len(open_):
        rounds += 1
        still = []
        for some in np.array_split(open_, max(1, -(-len(open_) // step))):
            corners, high = p[found[some]], lift[found[some]]
            e, f = corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]
            g, h = high[:, 1] - high[:, 0], high[:, 2] - high[:, 0]
            whole = e[:, 0] * f[:, 1] - e[:, 1] * f[:, 0]
            sx, sy = (g * f[:, 1] - h * e[:, 1]) / whole, (h * e[:, 0] - g * f[:, 0]) / whole
            base = high[:, 0] - sx * corners[:, 0, 0] - sy * corners[:, 0, 1]
            gap = lift[None, :n] - sx[:, None] * p[None, :n, 0] - sy[:, None] * p[None, :n, 1] - base[:, None]
            gap[np.arange(len(some))[:, None], np.minimum(found[some], n - 1)] = np.where(found[some] < n, 0.0, gap[np.arange(len(some))[:, None], np.minimum(found[some], n - 1)])
            below = gap < -1e-12 * np.maximum(1.0, np.abs(base))[:, None]
            least = gap.argmin(axis=1) if rounds <= greedy else below.argmax(axis=1)
            moves = below[np.arange(len(some)), least]
            some, least, corners = some[moves], least[moves], corners[moves]
            if len(some):
                come, here = weights(corners, p[least]), weights(corners, q[some])
                ratio = np.where(come > 1e-14, here / np.where(come > 1e-14, come, 1.0), np.inf)
                tied = ratio <= ratio.min(axis=1, keepdims=True)
                leaves = ratio.argmin(axis=1) if rounds <= greedy else np.where(tied, found[some], np.iinfo(np.int64).max).argmin(axis=1)
                found[some, leaves] = least
                still.append(some)
        open_ = np.concatenate(still) if still else np.empty(0, int)
    found[(found >= n).any(axis=1)] = -1
    return found


def settle(cells: pd.DataFrame, points: pd.DataFrame, side: float) -> pd.DataFrame:
    """Heights of a tile's cells from the points of the tile and of those about it; `known` where more points change nothing.

    That is so where the part of the triangle's circle that lies in the survey's extent lies in the tiles at hand.
    """
    out = cells[["survey", "row", "col"]].assign(z=np.nan, known=False)
    if len(cells) == 0 or len(points) < 3:
        return out
    points = points.sort_values(["x", "y"])
    xy, at = points[["x", "y"]].to_numpy(float), cells[["x", "y"]].to_numpy(float)
    found = triangles(xy, at)
    real = found[:, 0] >= 0
    corners = xy[found[real]]
    out.loc[real, "z"] = (weights(corners, at[real]) * points["z"].to_numpy(float)[found[real]]).sum(axis=1)
    a, b, c = corners[:, 0], corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]
    whole = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    bb, cc = (b * b).sum(axis=1), (c * c).sum(axis=1)
    centre = np.stack([(c[:, 1] * bb - b[:, 1] * cc) / whole, (b[:, 0] * cc - c[:, 0] * bb) / whole], axis=1)
    radius, centre = np.sqrt((centre * centre).sum(axis=1)) * (1 + 1e-9), centre + a
    inside = np.ones(len(corners), bool)
    for axis, tile in (("x", "bx"), ("y", "by")):
        k = 0 if axis == "x" else 1
        low, high = (cells[tile].iloc[0] - 1) * side, (cells[tile].iloc[0] + 2) * side
        inside &= (np.maximum(centre[:, k] - radius, cells[f"min_{axis}"].iloc[0]) >= low) & (np.minimum(centre[:, k] + radius, cells[f"max_{axis}"].iloc[0]) < high)
    out.loc[real, "known"] = inside
    return out


def with_side(side: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    return lambda cells, points: settle(cells, points, side)


def linear_surface(cells: DataFrame, points: DataFrame, side: float) -> DataFrame:
    """(survey, row, col, x, y, z) of cells (survey, row, col, x, y) from points (survey, x, y, z); z is null outside their hull.

    Cells meet the points of their tile of `side` metres and of the eight about it. Cells whose triangle more points could
    change come again with tiles four times as wide, until the tiles cover the survey: few, in wide gaps and along the hull.
    `side` is to hold some hundred points. Of points at one place the lowest counts; points with a null or a value that is
    not finite are left out.
    """
    fine = points.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('infinity')" for c in ("x", "y", "z")))
    known = cut(fine.groupBy("survey", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min(F.col("z").cast("double")).alias("z")))
    rings = cut(hull_rings(known, side))
    extent = [f"{m}_{a}" for m in ("min", "max") for a in ("x", "y")]
    left = cut(cells.select("survey", "row", "col", "x", "y").join(rings, "survey").where(geometry.covers_point(F.col("ring"), F.col("x"), F.col("y"))).drop("ring"))
    reach = rings.agg(F.max(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")))).first()[0] or 0.0
    kind = cells.schema["survey"].dataType.simpleString()
    types = dict(cells.dtypes)
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    done = None
    while True:
        bx, by = F.floor(F.col("x") / side).alias("bx"), F.floor(F.col("y") / side).alias("by")
        asked = left.select("survey", "row", "col", "x", "y", *extent, bx, by)
        spread = known.select("survey", "x", "y", "z", bx, by, around.alias("o")).select("survey", "x", "y", "z", (F.col("bx") + F.col("o.i")).alias("bx"), (F.col("by") + F.col("o.j")).alias("by"))
        near = spread.join(asked.select("survey", "bx", "by").distinct(), ["survey", "bx", "by"], "left_semi")

        keys = ["survey", "bx", "by"]
        got = cut(asked.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInPandas(with_side(side), f"survey {kind}, row {types['row']}, col {types['col']}, z double, known boolean"))
        sure = got.where("known").drop("known")
        done = sure if done is None else done.unionByName(sure)
        left = left.join(got.where("NOT known").select("survey", "row", "col"), ["survey", "row", "col"], "left_semi")
        if side > reach or left.isEmpty():
            break
        left, side = cut(left), side * 4
    return cells.select("survey", "row", "col", "x", "y").join(done.withColumn("z", F.nanvl("z", F.lit(None))), ["survey", "row", "col"], "left")

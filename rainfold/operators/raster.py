"""Rasters in long form: one row a cell (survey, row, col, z, valid), every cell of the rectangle present.

Rows increase with y. Neighbours come from windows over a grid line, not from joins: a lag and a lead along the row, then along the
column, so a step costs two sorts and no exploded rows, and a survey of any size is spread by its lines. What concerns a survey as a
whole, as its bounds, is aggregated and joined, so no task gets all cells of one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rainfold.operators import overlay
from rainfold.operators.blocks import TASK_CELLS
from rainfold.plans.store import apart, cut

#: Eight directions in tie-break order: code, row step, column step (fixed values of the D8 scheme).
DIRECTIONS = [(1, 0, 1), (2, 1, 1), (4, 1, 0), (8, 1, -1), (16, 0, -1), (32, -1, -1), (64, -1, 0), (128, -1, 1)]


def along_row() -> WindowSpec:
    return Window.partitionBy("survey", "row").orderBy("col")


def along_col() -> WindowSpec:
    return Window.partitionBy("survey", "col").orderBy("row")


def with_bounds(cells: DataFrame) -> DataFrame:
    """cells + (first_r__, last_r__, first_c__, last_c__) of their survey."""
    of = cells.groupBy(F.col("survey").alias("of__")).agg(*[f(c).alias(f"{n}_{c[0]}__") for c in ("row", "col") for n, f in (("first", F.min), ("last", F.max))])
    return cells.join(of, F.col("survey").eqNullSafe(F.col("of__"))).drop("of__")


BOUNDS = ("first_r__", "last_r__", "first_c__", "last_c__")


def with_neighbours(cells: DataFrame, *columns: str, name: str = "near", count: int | None = None) -> DataFrame:
    """cells + an array of eight structs of `columns` in the order of DIRECTIONS, null beyond the edge.

    Lines are dealt to tasks by the number of cells, `count`, as rows with neighbours are long though they compress well.
    """
    me, tasks = F.struct(*columns), -(-(cells.count() if count is None else count) // TASK_CELLS) or 1
    line = cells.repartition(tasks, "survey", "row").withColumns({"w__": F.lag(me).over(along_row()), "e__": F.lead(me).over(along_row())})
    three = F.struct(F.col("w__").alias("w"), me.alias("m"), F.col("e__").alias("e"))
    wide = line.repartition(tasks, "survey", "col").withColumns({"s__": F.lag(three).over(along_col()), "n__": F.lead(three).over(along_col())})
    order = ["e__", "n__.e", "n__.m", "n__.w", "w__", "s__.w", "s__.m", "s__.e"]
    return wide.withColumn(name, F.array(*map(F.col, order))).drop("w__", "e__", "s__", "n__")


def gradient(value: Column, along: WindowSpec, step: float) -> Column:
    """Central difference, one-sided at the ends of a line."""
    before, after = F.lag(value).over(along), F.lead(value).over(along)
    return F.when(before.isNull(), (after - value) / step).when(after.isNull(), (value - before) / step).otherwise((after - before) / (2 * step))


def with_slope(cells: DataFrame, resolution: float) -> DataFrame:
    """cells + slope in degrees of all cells, extrapolated ones included."""
    dx, dy = gradient(F.col("z"), along_row(), resolution), gradient(F.col("z"), along_col(), resolution)
    return cells.withColumn("dx__", dx).withColumn("dy__", dy).withColumn("slope_deg", F.degrees(F.atan(F.sqrt(F.col("dx__") * F.col("dx__") + F.col("dy__") * F.col("dy__"))))).drop("dx__", "dy__")


def with_hillshade(cells: DataFrame, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """cells + light of 0 to 1 from a direction, with unit spacing."""
    dx, dy = gradient(F.col("z"), along_row(), 1.0), gradient(F.col("z"), along_col(), 1.0)
    made = cells.withColumn("dx__", dx).withColumn("dy__", dy)
    steep = math.pi / 2 - F.atan(F.hypot("dx__", "dy__"))
    facing = F.atan2(-F.col("dy__"), F.col("dx__"))
    high, turn = math.radians(altitude), math.radians(360.0 - azimuth)
    light = math.sin(high) * F.sin(steep) + math.cos(high) * F.cos(steep) * F.cos(turn - facing)
    return made.withColumn("shade", F.greatest(F.lit(0.0), F.least(F.lit(1.0), light))).drop("dx__", "dy__")


def grid_statistics(cells: DataFrame, value: str = "z") -> DataFrame:
    """One row a survey: extremes, mean and share of missing cells."""
    there = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    return cells.groupBy("survey").agg(F.min(there).alias("lowest"), F.max(there).alias("highest"), F.avg(there).alias("mean"), F.avg(there.isNull().cast("int")).alias("missing_fraction"), F.count(F.lit(1)).alias("cells"))


def slope_statistics(cells: DataFrame) -> DataFrame:
    """One row a survey: extremes and mean of slope_deg over all cells, extrapolated ones included, and the share of those."""
    there = F.when(~F.isnan("slope_deg"), F.col("slope_deg"))
    return cells.groupBy("survey").agg(F.min(there).alias("slope_min"), F.max(there).alias("slope_max"), F.avg(there).alias("slope_mean"), F.avg((~F.col("valid")).cast("int")).alias("extrapolated_fraction"))


def reflected(position: Column, n: Column) -> Column:
    """Index beyond the edge mirrored at it, the edge cell doubled (d c b a | a b c d | d c b a)."""
    at = F.pmod(position, 2 * n)
    return F.when(at < n, at).otherwise(2 * n - 1 - at)


def _weighed_line(cells: DataFrame, values: list[str], axis: str, weights: list[float]) -> DataFrame:
    """Values replaced by weighted sums along an axis with mirrored edges.

    A line is lengthened by mirrored copies of the cells at its ends, then each sum is a window's, so a line costs its length.
    """
    line, half = Window.partitionBy("survey", "col" if axis == "row" else "row"), len(weights) // 2
    placed = cells.withColumns({"at__": F.row_number().over(line.orderBy(axis)) - 1, "n__": F.count(F.lit(1)).over(line).cast("int")})
    at, n, own = F.col("at__"), F.col("n__"), F.array("at__")
    if half:
        beyond = F.concat(F.sequence(F.lit(-half), F.lit(-1)), F.sequence(n, n + (half - 1)))
        copies = F.filter(beyond, lambda p: reflected(p, n) == at)
        own = F.when((at < half) | (at >= n - half), F.concat(own, copies)).otherwise(own)
    longer, order = placed.withColumn("p__", F.explode(own)), line.orderBy("p__")

    def smooth(name: str) -> Column:
        got = [w * F.lead(name, k - half).over(order) for k, w in enumerate(weights)]
        return sum(got[1:], got[0])

    return longer.withColumns({v: smooth(v) for v in values}).where("p__ = at__").select(*cells.columns)


def gaussian_weights(sigma: float) -> list[float]:
    radius = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def smoothed(cells: DataFrame, sigma: float) -> DataFrame:
    """z under a Gaussian of sigma cells, row and column wise; sigma of 0 or less leaves it."""
    if sigma <= 0:
        return cells
    weights = gaussian_weights(sigma)
    return _weighed_line(_weighed_line(cells, ["z"], "row", weights), ["z"], "col", weights).select(*cells.columns)


def local_window(resolution: float) -> int:
    """An odd number of cells about 30 m across, 3 at least."""
    return max(3, round(30 / resolution) | 1)


def with_local_slope(cells: DataFrame, resolution: float) -> DataFrame:
    """cells (with slope_deg, valid) + mean slope of the valid cells in a window of about 30 m, edges mirrored."""
    n = local_window(resolution)
    ones = [1.0] * n
    made = cells.withColumns({"a__": F.when(F.col("valid"), F.col("slope_deg")).otherwise(0.0), "b__": F.col("valid").cast("double")})
    summed = _weighed_line(_weighed_line(made, ["a__", "b__"], "row", ones), ["a__", "b__"], "col", ones)
    return summed.withColumn("local_slope_deg", F.col("a__") / F.greatest("b__", F.lit(1e-12))).select(*cells.columns, "local_slope_deg")


def with_boundary(cells: DataFrame) -> DataFrame:
    """cells + whether a cell is at the grid's edge or beside an invalid one."""
    near = with_neighbours(cells, "valid")
    inside = F.forall("near", lambda n: F.coalesce(n["valid"], F.lit(False)))
    return near.withColumn("boundary", ~inside).drop("near")


def nearest_squared(height: np.ndarray) -> np.ndarray:
    """min over j of (i - j)**2 + height[j]**2 for each i, in time linear in the line: the lower envelope of parabolas."""
    n = len(height)
    low, at, start = height.astype(float) ** 2, [0], [-np.inf]
    for j in range(1, n):
        while True:
            i = at[-1]
            meet = ((low[j] + j * j) - (low[i] + i * i)) / (2 * (j - i))
            if meet > start[-1]:
                break
            at.pop()
            start.pop()
        at.append(j)
        start.append(meet)
    own = np.arange(n)
    best = np.array(at)[np.searchsorted(start, own, side="right") - 1]
    return (own - best) ** 2 + low[best]


def with_edge_distance(cells: DataFrame, resolution: float, padded: bool = True) -> DataFrame:
    """cells + metres from the centre of a valid cell to the outer edge of the valid area (Euclidean), 0 for invalid ones.

    Cells beyond the grid are invalid. Down the columns a window finds the nearest invalid cell; along each row a task takes the
    least of squared column distance plus squared row distance, in time linear in the row. With padded=False cells beyond
    the grid do not count and the distance is that to the nearest invalid cell's centre; infinity without one.
    """
    # both run from their line's start, as a frame up to its end is summed up anew for each cell
    up, down = (Window.partitionBy("survey", "col").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("row"), F.desc("row")))
    bad = F.when(~F.col("valid"), F.col("row"))
    sized = with_bounds(cells.select("survey", "row", "col", "valid"))
    far = F.lit(1e9)
    above = F.coalesce(F.col("row") - F.max(bad).over(up), F.col("row") - F.col("first_r__") + 1 if padded else far)
    below = F.coalesce(F.min(bad).over(down) - F.col("row"), F.col("last_r__") + 1 - F.col("row") if padded else far)
    tall = sized.withColumn("g__", F.least(above, below).cast("double"))
    lines = tall.groupBy("survey", "row").agg(F.sort_array(F.collect_list(F.struct("col", "g__"))).alias("line")).select("survey", "row", F.col("line.col").alias("cols"), F.col("line.g__").alias("g"))

    def envelope(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for g in b.column("g").to_pylist():
                d2, n = nearest_squared(np.array(g)), len(g)
                if padded:
                    edge = np.minimum(np.arange(n) + 1, n - np.arange(n))
                    d2 = np.minimum(d2, edge * edge)
                done.append(d2)
            yield b.drop_columns(["g"]).append_column("d2", pa.array(done, pa.list_(pa.float64())))

    kind = dict(cells.dtypes)
    squared = lines.mapInArrow(envelope, f"survey {kind['survey']}, row {kind['row']}, cols array<{kind['col']}>, d2 array<double>")
    squared = squared.select(F.col("survey").alias("s__"), F.col("row").alias("r__"), F.explode(F.arrays_zip("cols", "d2")).alias("p")).select("s__", "r__", F.col("p.cols").alias("c__"), F.col("p.d2").alias("d2__"))
    met = cells.join(apart(squared), F.col("survey").eqNullSafe(F.col("s__")) & (F.col("row") == F.col("r__")) & (F.col("col") == F.col("c__"))).drop("s__", "r__", "c__")
    root = F.when(F.col("d2__") >= 1e17, F.lit(float("inf"))).otherwise(F.sqrt("d2__"))
    return met.withColumn("edge_distance_m", F.when(F.col("valid"), root * resolution - (resolution / 2 if padded else 0.0)).otherwise(0.0)).drop("d2__")


def regular_grid(bounds: DataFrame, resolution: Column) -> DataFrame:
    """(survey, row, col, x, y) of a grid over (survey, min_x, max_x, min_y, max_y); the last node may lie past the end."""
    n_col = F.ceil((F.col("max_x") + resolution - F.col("min_x")) / resolution).cast("int")
    n_row = F.ceil((F.col("max_y") + resolution - F.col("min_y")) / resolution).cast("int")
    rows = bounds.withColumn("row", F.explode(F.sequence(F.lit(0), n_row - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), n_col - 1)))
    return rows.select("survey", "row", "col", (F.col("min_x") + F.col("col") * resolution).alias("x"), (F.col("min_y") + F.col("row") * resolution).alias("y"))


def auto_resolution(extent: Column, interval: Column) -> Column:
    """A 500th of the longest axis within 1 to 50 m, snapped up to the contour interval where that is finer."""
    plain = F.when(extent <= 0, 1.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(50.0), extent / 500)))
    snapped = F.greatest(F.lit(1.0), F.bround(plain / F.nullif(interval, F.lit(0.0)))) * interval
    return F.bround(F.when((interval > 0) & (interval < plain), snapped).otherwise(plain), 2)


def nearest_fill(cells: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """z of cells without one from the nearest point (survey, id, x, y, z), ties to the smaller id.

    Points and cells meet in buckets of `reach` metres, each cell looking into the nine about it, so what is found within `reach`
    is the nearest. Of a bucket's points only those chunks are compared whose bounds may hold a cell's nearest one, and of points at one
    place the smallest id. Cells without such a point come again with buckets four times as wide, until the buckets cover the survey;
    cells stay empty only in a survey without points. Points with a null or a value that is not finite are left out.
    """
    fine = points.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('infinity')" for c in ("x", "y", "z")))
    first = fine.groupBy("survey", (F.col("x").cast("double") + 0.0).alias("px"), (F.col("y").cast("double") + 0.0).alias("py")).agg(F.min(F.struct("id", "z")).alias("p"))
    known = cut(first.select("survey", F.col("p.id").alias("pid"), "px", "py", F.col("p.z").alias("pz")))
    spread = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    placed = " AND ".join(f"NOT isnan({c}) AND abs({c}) < double('infinity')" for c in ("x", "y"))
    empty = cells.where(F.col("z").isNull()).where(placed).select("survey", "row", "col", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    left = cut(empty.join(known.select("survey").distinct(), "survey", "left_semi"))
    side, done = reach, None
    while done is None or not left.isEmpty():
        def bucket(c: str, side: float = side) -> Column:
            return F.floor(F.col(c) / side).cast("long")

        chunks = _chunks(known.withColumns({"bx": bucket("px"), "by": bucket("py")}), side)
        asked = left.withColumn("o", spread).select("survey", "row", "col", "x", "y", (bucket("x") + F.col("o.i")).alias("bx"), (bucket("y") + F.col("o.j")).alias("by"))
        near = asked.join(chunks.drop("points"), ["survey", "bx", "by"])
        least, most = (F.lit(0.0) + sum(v * v for v in (f(c) for c in ("x", "y"))) for f in (
            lambda c: F.greatest(F.col(f"low_{c}") - F.col(c), F.col(c) - F.col(f"high_{c}"), F.lit(0.0)),
            lambda c: F.greatest(F.abs(F.col(f"low_{c}") - F.col(c)), F.abs(F.col(c) - F.col(f"high_{c}"))),
        ))
        bound = F.min("most__").over(Window.partitionBy("survey", "row", "col"))
        may = near.withColumns({"least__": least, "most__": most}).withColumn("bound__", bound).where(F.col("least__") <= F.least("bound__", F.lit(side * side)) * (1 + 1e-9))
        best = _nearest_of(cut(may.select("survey", "row", "col", "x", "y", *CHUNK)), chunks)
        sure = cut(best.where(F.col("d2__") <= side * side * (1 - 1e-9)).drop("d2__"))
        done = sure if done is None else done.unionByName(sure)
        left, side = cut(left.join(apart(sure), ["survey", "row", "col"], "left_anti")), side * 4
    return cells.join(apart(done), ["survey", "row", "col"], "left").withColumn("z", F.coalesce("z", "z__")).drop("z__")


CHUNK = ("bx", "by", "sx", "sy", "tx", "ty")
#: Points of a chunk, about, and chunks' squares along a bucket's side.
CHUNK_POINTS, CHUNK_SQUARES = 256, 16


def _chunks(known: DataFrame, side: float) -> DataFrame:
    """survey + CHUNK + bounds and points (pid, px, py, pz), by pid, of each chunk: the points of a part of a bucket, crowded squares in smaller ones."""
    square = ["survey", "bx", "by", "sx", "sy"]
    parts = known.withColumns({s: F.floor(F.col(p) / (side / CHUNK_SQUARES)).cast("long") for s, p in (("sx", "px"), ("sy", "py"))})
    of = parts.groupBy(*square).agg(F.ceil(F.sqrt(F.count(F.lit(1)) / F.lit(CHUNK_POINTS))).alias("k__"), *[f(p).alias(f"{n}_{p}") for p in ("px", "py") for n, f in (("l", F.min), ("h", F.max))])
    within = lambda p: F.floor((F.col(p) - F.col(f"l_{p}")) / F.greatest(F.col(f"h_{p}") - F.col(f"l_{p}"), F.lit(1e-9)) * F.col("k__") * 0.999999).cast("long")
    dealt = parts.join(of, square).withColumns({"tx": within("px"), "ty": within("py")})
    bounds = [f(p).alias(f"{n}_{p[1]}") for p in ("px", "py") for n, f in (("low", F.min), ("high", F.max))]
    return cut(dealt.groupBy("survey", *CHUNK).agg(*bounds, F.sort_array(F.collect_list(F.struct("pid", "px", "py", "pz"))).alias("points")))


def _nearest_of(may: DataFrame, chunks: DataFrame) -> DataFrame:
    """(survey, row, col, d2__, z__) of cells with the chunks that may hold their nearest point."""
    kind = dict(may.dtypes)
    point = dict(chunks.select("points.pid", "points.pz").dtypes)
    point = {c: k.removeprefix("array<").removesuffix(">") for c, k in point.items()}
    joined = overlay.grouped(may, ["survey", *CHUNK], ["row", "col", "x", "y"]).join(apart(chunks), ["survey", *CHUNK])
    given = joined.select("survey", "row", "col", "x", "y", *[F.col(f"points.{c}").alias(c) for c in ("pid", "px", "py", "pz")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x, y, px, py = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("x", "y", "px", "py"))
                best, low = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
                for s in range(0, len(px), 4096):
                    d2 = (x[:, None] - px[s : s + 4096]) * (x[:, None] - px[s : s + 4096]) + (y[:, None] - py[s : s + 4096]) * (y[:, None] - py[s : s + 4096])
                    at = d2.argmin(axis=1)  # of equals the first, the smallest id
                    here = d2[np.arange(len(x)), at]
                    best, low = np.where(here < low, at + s, best), np.minimum(low, here)
                to = pa.array(best)
                survey = b.column("survey").take(pa.array(np.full(len(x), i)))
                yield pa.RecordBatch.from_arrays([survey, b.column("row")[i].values, b.column("col")[i].values, pa.array(low), b.column("pid")[i].values.take(to), b.column("pz")[i].values.take(to)], ["survey", "row", "col", "d2__", "pid", "z__"])

    found = given.mapInArrow(compare, f"survey {kind['survey']}, row {kind['row']}, col {kind['col']}, d2__ double, pid {point['pid']}, z__ {point['pz']}")
    order = F.struct("d2__", "pid")
    return found.groupBy("survey", "row", "col").agg(F.min("d2__").alias("d2__"), F.min_by("z__", order).alias("z__"))

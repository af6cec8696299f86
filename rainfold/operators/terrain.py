"""Public terrain windows: the grid about a land, the tiles it needs, heights between samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainfold.functions import geodesy

#: Cell size in metres, and the most area, dimension, cells and tiles of a window (fixed values of the planning tool).
RESOLUTION_M, MOST_AREA_M2, MOST_SIDE_M, MOST_CELLS, MOST_TILES = 30.0, 25_000_000.0, 15_000.0, 1_000_000, 9
#: Degrees about a window in which tiles are asked for, as their samples lie at whole arc seconds.
PAD = 3 / 3600


def window_grid(lands: DataFrame, buffer_m: float = 2000.0) -> DataFrame:
    """lands (min_x, min_y, max_x, max_y, area_m2 in metres) + (left, bottom, right, top, width, height, error).

    Bounds with the buffer are snapped outwards to the cell size; a land over a limit has the limit's name as error and no window.
    """
    if not 0 <= buffer_m < float("inf"):
        raise ValueError("the terrain buffer has to be finite and not negative")

    def snap(value: Column, up: bool) -> Column:
        at = value / RESOLUTION_M
        return (F.ceil(at) if up else F.floor(at)) * RESOLUTION_M

    made = lands.withColumns({"left": snap(F.col("min_x") - buffer_m, False), "bottom": snap(F.col("min_y") - buffer_m, False), "right": snap(F.col("max_x") + buffer_m, True), "top": snap(F.col("max_y") + buffer_m, True)})
    made = made.withColumns({"width": F.round((F.col("right") - F.col("left")) / RESOLUTION_M).cast("long"), "height": F.round((F.col("top") - F.col("bottom")) / RESOLUTION_M).cast("long")})
    numbers = F.array("min_x", "min_y", "max_x", "max_y", "area_m2")
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    error = (
        F.when(~finite, "not_finite")
        .when((F.col("area_m2") > MOST_AREA_M2) | (F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) > MOST_SIDE_M), "too_large")
        .when(F.col("width") * F.col("height") > MOST_CELLS, "too_many_cells")
    )
    checked = made.withColumn("error", error)
    names = ("left", "bottom", "right", "top", "width", "height")
    return checked.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in names})


def tiles_of(windows: DataFrame) -> DataFrame:
    """windows' other columns + (tile_lat, tile_lon, tile) of each one-degree tile that a window (south, west, north, east) touches.

    A window that needs more than MOST_TILES tiles raises an error.
    """
    rest = [c for c in windows.columns if c not in ("south", "west", "north", "east")]

    def range_(low: str, high: str, least: int, most: int) -> Column:
        return F.sequence(F.greatest(F.lit(least), F.floor(F.col(low) - PAD).cast("int")), F.least(F.lit(most), F.floor(F.col(high) + PAD).cast("int")))

    spans = windows.withColumns({"lats": range_("south", "north", -90, 89), "lons": range_("west", "east", -180, 179)})
    many = F.size("lats") * F.size("lons") > MOST_TILES
    checked = spans.withColumn("lats", F.when(many, F.raise_error(F.lit("the window spans too many terrain tiles")).cast("array<int>")).otherwise(F.col("lats")))
    made = checked.select(*rest, F.explode("lats").alias("tile_lat"), "lons").select(*rest, "tile_lat", F.explode("lons").alias("tile_lon"))
    return made.withColumn("tile", geodesy.tile_name(F.col("tile_lat").cast("double"), F.col("tile_lon").cast("double")))


def bilinear(samples: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (survey, point, r, c: places in rows and columns of the samples) + z between the four samples about it.

    Samples without a height, or that a missing tile does not give, count for nothing and the weights of the others make up
    for them; z is null where none of the four has a height, never zero.
    """
    spread = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    row, col = F.floor("r").cast("int"), F.floor("c").cast("int")
    four = asked.withColumn("o", spread).select("survey", "point", (row + F.col("o.i")).alias("row"), (col + F.col("o.j")).alias("col"), F.abs(1 - F.col("o.i") - (F.col("r") - row)).alias("u"), F.abs(1 - F.col("o.j") - (F.col("c") - col)).alias("v"))
    known = samples.where(F.col("z").isNotNull() & ~F.isnan("z")).select("survey", "row", "col", F.col("z").cast("double").alias("z"))
    weight = F.col("u") * F.col("v")
    found = four.where(weight > 0).join(known, ["survey", "row", "col"]).groupBy("survey", "point").agg((F.sum(weight * F.col("z")) / F.sum(weight)).alias("z"))
    return asked.join(found, ["survey", "point"], "left")

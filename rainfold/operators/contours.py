"""Contour lines as rows: (contour_id, elevation, coordinates ARRAY<STRUCT<lon, lat>>)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainfold.functions import geodesy


def violations(contours: DataFrame, order: str = "contour_id") -> DataFrame:
    """(contour_id, violation, vertex): the first check that each contour fails; the vertex where a coordinate is out of range."""
    bad = F.transform("coordinates", lambda p: F.coalesce((F.abs(p["lon"]) > 180) | (F.abs(p["lat"]) > 90), F.lit(True)))
    first = F.array_position(bad, F.lit(True))
    code = (
        F.when(F.col("elevation").isNull(), "elevation_missing")
        .when(F.isnan("elevation"), "elevation_not_numeric")
        .when(F.col("coordinates").isNull() | (F.size("coordinates") == 0), "coordinates_missing")
        .when(F.size("coordinates") < 2, "too_few_points")
        .when(first > 0, "coordinate_out_of_range")
    )
    made = contours.select(F.col(order).alias("contour_id"), code.alias("violation"), F.when(code == "coordinate_out_of_range", first - 1).cast("int").alias("vertex"))
    return made.where(F.col("violation").isNotNull())


def statistics(contours: DataFrame) -> DataFrame:
    """One row: number, elevations, points, bounds."""
    bounds = contours.select("elevation", F.size("coordinates").alias("n"), *[F.array_min(f"coordinates.{c}").alias(f"min_{c}") for c in ("lon", "lat")], *[F.array_max(f"coordinates.{c}").alias(f"max_{c}") for c in ("lon", "lat")])
    return bounds.agg(
        F.count(F.lit(1)).alias("contour_count"),
        F.min("elevation").alias("min_elevation_m"),
        F.max("elevation").alias("max_elevation_m"),
        F.sum("n").cast("long").alias("total_points"),
        *[F.min(c).alias(c) for c in ("min_lon", "min_lat")],
        *[F.max(c).alias(c) for c in ("max_lon", "max_lat")],
    )


def elevation_gaps(contours: DataFrame) -> DataFrame:
    """(elevation, gap) between distinct elevations; there are few, as a survey has few levels."""
    levels = contours.select("elevation").distinct()
    return levels.withColumn("gap", F.lead("elevation").over(Window.orderBy("elevation")) - F.col("elevation")).where(F.col("gap").isNotNull())


def interval(contours: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: the commonest gap (of equals the lowest one's), whether all gaps agree, and the least gap."""
    gaps = elevation_gaps(contours).withColumn("rounded", F.bround("gap", 4))
    counted = gaps.groupBy("rounded").agg(F.count(F.lit(1)).alias("n"), F.min("elevation").alias("lowest"), F.min("gap").alias("least"), F.max("gap").alias("most"))
    return counted.agg(
        F.max_by("rounded", F.struct("n", -F.col("lowest"))).alias("contour_interval_m"),
        (F.max("most") - F.min("least") <= tolerance).alias("contour_interval_uniform"),
        F.bround(F.min("least"), 4).alias("least_gap_m"),
    )


def vertices(contours: DataFrame) -> DataFrame:
    """(contour_id, seq, lon, lat, elevation): one row a vertex."""
    return contours.select("contour_id", "elevation", F.posexplode("coordinates").alias("seq", "p")).select("contour_id", "seq", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"), "elevation")


def centre(contours: DataFrame) -> DataFrame:
    """Mean of all vertices and the UTM zone that it lies in."""
    made = vertices(contours).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    epsg = geodesy.utm_epsg(F.col("lon"), F.col("lat"))
    return made.withColumn("epsg", epsg).withColumn("crs", geodesy.crs_name(F.col("epsg"))).withColumn("unit", F.lit("metre"))


def project(points: DataFrame, zone: Column, south: Column) -> DataFrame:
    """points (lon, lat) + (x, y) in metres."""
    x, y = geodesy.to_utm(F.col("lon"), F.col("lat"), zone, south)
    return points.withColumns({"x": x, "y": y})

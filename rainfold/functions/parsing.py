"""Column expressions that read numbers and coordinates out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags of mapped water (fixed values of the map's tagging scheme).
WATERWAYS = ["river", "stream", "canal", "drain", "ditch", "riverbank"]


def elevation_of(name: Column) -> Column:
    """The number a placemark's name starts with, null without one: '270', ' 270.5 m', '-3'."""
    return F.nullif(F.regexp_extract(name, r"^\s*([-+]?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def coordinates_of(text: Column) -> Column:
    """ARRAY<STRUCT<lon, lat>> of 'lon,lat[,altitude] ...'; tokens that are no pair of numbers are left out."""

    def point(token: Column) -> Column:
        parts = F.split(token, ",")
        return F.struct(F.get(parts, F.lit(0)).try_cast("double").alias("lon"), F.get(parts, F.lit(1)).try_cast("double").alias("lat"))

    made = F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), point)
    return F.filter(made, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())


def is_water(tags: Column) -> Column:
    """Whether a map of tags names a waterway, a water surface or a reservoir."""
    return F.coalesce(F.element_at(tags, "waterway").isin(WATERWAYS), F.lit(False)) | F.coalesce(F.element_at(tags, "natural") == "water", F.lit(False)) | F.coalesce(F.element_at(tags, "landuse") == "reservoir", F.lit(False))


def width_metres(width: Column) -> Column:
    """A width tag with or without unit; 0 where it is no number."""
    got = F.regexp_replace(width, " m$", "").try_cast("double")
    return F.when(got.isNull() | F.isnan(got) | (got < 0), 0.0).otherwise(got)


def place_query(text: Column) -> Column:
    """White space made single; null unless 2 to 200 characters are left."""
    made = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(made).between(2, 200), made)


def usable_rain(value: Column, fill: float = -999.0) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf")) & (value != fill)

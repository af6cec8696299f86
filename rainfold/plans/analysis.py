"""Whole analyses put together from the operators: sites of a survey, one pond, the size of a pond."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainfold.operators import forest, hydrology, rainfall, raster, sites, storage
from rainfold.plans.store import cut


def rank_sites(cells: DataFrame, resolution: float, land: DataFrame | None = None, water: DataFrame | None = None, setback_m: float = 0.0, max_slope: float = 8.0, k: int = 5, min_distance_m: float = 100.0, border: int = 3) -> DataFrame:
    """The best k collection sites of every survey, from a raster and optional masks (survey, row, col).

    Targets are depressions and the ends and meetings of drainage lines. They are scored by contributing area and slope,
    and sites near a better one or with mostly the same catchment left out, with catchments as intervals of a walk over the flow
    forest. The routing sensitivity compares the chosen sites' catchments on the filled and on the raw surface.
    """
    flow = cut(hydrology.run_hydrology(cells, resolution))
    raw = cut(hydrology.run_hydrology(cells, resolution, fill=False))
    spot = ["survey", "row", "col"]
    marked = raster.with_edge_distance(raster.with_local_slope(raster.with_slope(flow, resolution), resolution), resolution)
    marked = marked.withColumn("land", F.lit(True)) if land is None else marked.join(land.select(*spot, F.lit(True).alias("land")).distinct(), spot, "left").withColumn("land", F.coalesce("land", F.lit(False)))
    marked = marked.withColumn("water", F.lit(False)) if water is None else marked.join(water.select(*spot, F.lit(True).alias("water")).distinct(), spot, "left").withColumn("water", F.coalesce("water", F.lit(False)))
    marked = cut(raster.with_boundary(marked).withColumn("wet", F.col("z_filled") - F.col("z") > 1e-6))
    allowed = cut(sites.allowed_cells(marked, setback_m, max_slope, border))

    pools = hydrology.depressions(marked)
    rim = raster.with_edge_distance(marked.withColumn("valid", F.col("wet")), 1.0, padded=False).select(*spot, F.col("edge_distance_m").alias("clearance"))
    hollows = sites.depression_targets(pools.join(rim, spot), allowed).select("survey", "node", "component", F.lit("depression").alias("kind"))
    ends = sites.outlet_nodes(marked.join(allowed.select(*spot, F.lit(True).alias("allowed")), spot, "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))).select("survey", "node", F.lit(None).cast("long").alias("component"), F.lit("outlet").alias("kind"))
    targets = hollows.unionByName(ends)
    named = cut(targets.withColumn("site", F.col("node") * 2 + (F.col("kind") == "outlet").cast("long")))
    inside = pools.select("survey", "component", F.col("node").alias("cell"))
    starts = named.join(inside, ["survey", "component"], "left").select("survey", F.coalesce("cell", "node").alias("node"), "site")
    spanned = cut(sites.spans(forest.tour(marked), starts))
    spots = marked.select("survey", "node", "row", "col", "z", "slope_deg", "local_slope_deg", "edge_distance_m")
    placed = named.join(spots, ["survey", "node"]).join(sites.span_sizes(spanned).withColumnRenamed("n", "area_cells"), ["survey", "site"])
    ranked = cut(sites.scored(placed, resolution * resolution, max_slope))
    chosen = cut(sites.select_apart(ranked, spanned, resolution, min_distance_m, k=k))
    few = starts.join(chosen.select("survey", "site"), ["survey", "site"], "left_semi").select("survey", "node", "site")
    traced = cut(hydrology.trace_catchments(marked, few))  # cells are listed for the k sites of a survey only
    areas = hydrology.catchment_areas(traced, marked, resolution)
    on_raw = hydrology.trace_catchments(raw, few)
    judged = sites.assessment(traced.select("survey", "node", "site"), on_raw.select("survey", "node", "site"), marked)
    return chosen.join(areas, ["survey", "site"]).join(judged.drop("boundary_truncated"), ["survey", "site"])


def number(data: dict, key: str, default: float | None, least: float, most: float) -> float:
    """data[key] as a finite number within limits; booleans are no numbers."""
    value = data.get(key, default)
    try:
        if isinstance(value, bool) or not math.isfinite(got := float(value)) or not least <= got <= most:
            raise ValueError
    except (TypeError, ValueError, OverflowError) as bad:
        raise ValueError(f"{key} must be a number from {least} to {most}.") from bad
    return got


def expanded_sites(analyse: Callable[[float], DataFrame], buffers: tuple[float, ...] = (2000.0, 4000.0), failures: tuple[type[Exception], ...] = (ValueError,)) -> tuple[DataFrame, float, str]:
    """(sites, buffer, expansion_status): sites with boundary_truncated, from ever wider terrain until no catchment reaches its edge.

    `analyse` gives the sites for a buffer. If a wider extent fails in one of the ways of `failures`, the sites of the one before
    stay and the status is `unavailable`; if the first fails, so does the whole. Otherwise it is `not_needed`, `expanded`, or
    `limit_reached` where a catchment still reaches the edge.
    """
    last: tuple[DataFrame, float, str] | None = None
    for k, buffer_m in enumerate(buffers):
        try:
            found = cut(analyse(buffer_m))
        except failures:
            if last is None:
                raise
            return last[0], last[1], "unavailable"
        if found.where("boundary_truncated").isEmpty():
            return found, buffer_m, "not_needed" if k == 0 else "expanded"
        last = found, buffer_m, "limit_reached"
    if last is None:
        raise ValueError("no terrain buffer to try")
    return last


def simulate_pond(designs: DataFrame, daily: DataFrame) -> dict[str, DataFrame]:
    """Monthly, annual, seasonal and total balances and the summary of designs (see storage.DESIGN)."""
    months = cut(storage.monthly(storage.daily_balance(designs, daily)))
    seasons = storage.seasonal(months, storage.season_table(designs.sparkSession))
    return {"monthly": months, "annual": storage.annual(months), "seasonal": seasons, "totals": storage.totals(months), "summary": storage.seasonal_summary(seasons, designs.select("design_id", "capacity_m3"))}


def suggest_size(spark: SparkSession, daily: DataFrame, catchment_m2: float, target_m3: float | None = None, **rates: float) -> DataFrame:
    """The size that holds a target volume and the next one up, or three tiers with one recommended."""
    grid = storage.candidate_grid(spark)
    evaluated = storage.evaluate_sizes(grid, daily, catchment_m2, **rates)
    if target_m3 is None:
        return storage.recommend(evaluated)
    if not target_m3 > 0:
        raise ValueError("the target volume has to be over zero")
    best = storage.size_for_target(grid, target_m3)
    return best.join(evaluated.withColumnRenamed("design_id", "candidate").drop("capacity_m3"), "candidate")


def with_volumes(found: DataFrame, daily: DataFrame, first_year: int, last_year: int, coefficient: float = 0.3) -> DataFrame:
    """Sites with the water a mean year brings; null where the rain series is not complete."""
    if not 0 <= coefficient <= 1:
        raise ValueError("the runoff coefficient lies between 0 and 1")
    mean = rainfall.rain_summary(daily, first_year, last_year).first()["mean_annual_mm"]
    return rainfall.runoff_volume(found, F.lit(mean).cast("double"), F.lit(coefficient))

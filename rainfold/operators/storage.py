"""Excavated storage: geometry, the daily water balance, its roll-ups, and size recommendations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rainfold.plans.store import cut

SEASONS = {"monsoon": [6, 7, 8, 9], "post_monsoon": [10, 11], "dry": [12, 1, 2, 3, 4, 5]}
LENGTHS, WIDTHS, DEPTHS, SIDE_SLOPE, FREEBOARD = (30.0, 45.0, 60.0), (20.0, 30.0, 40.0), (1.5, 2.5), 2.0, 0.5
FLOWS = ("rainfall_mm", "runoff_m3", "direct_rain_m3", "inflow_m3", "overflow_m3", "evaporation_m3", "seepage_m3", "supplied_m3", "unmet_demand_m3")
BISECTIONS, TOLERANCE = 40, 1e-8


def pond_geometry(length: Column, width: Column, depth: Column, slope: Column, freeboard: Column) -> dict[str, Column]:
    """Dimensions at bottom and water line, and the prismatoid's capacity; null capacity where the sides meet first."""
    deep = depth - freeboard
    bottom_l, bottom_w = length - 2 * slope * depth, width - 2 * slope * depth
    water_l, water_w = length - 2 * slope * freeboard, width - 2 * slope * freeboard
    middle = (bottom_l + slope * deep) * (bottom_w + slope * deep)
    fits = (deep > 0) & (bottom_l > 0) & (bottom_w > 0)
    return {
        "water_depth_m": deep,
        "bottom_length_m": bottom_l,
        "bottom_width_m": bottom_w,
        "footprint_area_m2": length * width,
        "water_area_m2": water_l * water_w,
        "capacity_m3": F.when(fits, deep / 6 * (bottom_l * bottom_w + 4 * middle + water_l * water_w)),
    }


def clearance_area(length: Column, width: Column, margin: Column) -> Column:
    """A rectangle grown by a mitred margin."""
    return (length + 2 * margin) * (width + 2 * margin)


def footprint_corners(x: Column, y: Column, length: Column, width: Column, bearing: Column, margin: Column) -> Column:
    """ARRAY<STRUCT<x, y>>: corners of the length-by-width rectangle about (x, y), its length turned clockwise from north."""
    turn = F.radians(bearing)
    half_l, half_w = length / 2 + margin, width / 2 + margin

    def corner(across: Column, along: Column) -> Column:
        return F.struct((x + across * F.cos(turn) + along * F.sin(turn)).alias("x"), (y - across * F.sin(turn) + along * F.cos(turn)).alias("y"))

    return F.array(corner(-half_w, -half_l), corner(half_w, -half_l), corner(half_w, half_l), corner(-half_w, half_l))


def candidate_grid(spark: SparkSession) -> DataFrame:
    """The 18 sizes that are tried, smallest capacity first, with a number from 0."""
    made = spark.range(1).select(
        F.explode(F.array(*map(F.lit, LENGTHS))).alias("length_m")
    ).select("length_m", F.explode(F.array(*map(F.lit, WIDTHS))).alias("width_m")).select("length_m", "width_m", F.explode(F.array(*map(F.lit, DEPTHS))).alias("depth_m"))
    shape = pond_geometry(F.col("length_m"), F.col("width_m"), F.col("depth_m"), F.lit(SIDE_SLOPE), F.lit(FREEBOARD))
    sized = made.withColumns(shape).where(F.col("capacity_m3").isNotNull()).withColumn("capacity_m3", F.bround("capacity_m3", 2))
    order = Window.orderBy("capacity_m3", "length_m", "width_m", "depth_m")  # 18 rows
    return sized.withColumn("candidate", F.row_number().over(order) - 1)


def size_for_target(grid: DataFrame, target: float) -> DataFrame:
    """The least candidate that holds the target and the next one up; the largest, not recommended, if none does."""
    order = Window.orderBy("capacity_m3", "candidate")
    ranked = grid.withColumn("next_capacity_m3", F.lead("capacity_m3").over(order))
    best = F.min_by(F.struct("candidate", "capacity_m3", "next_capacity_m3"), F.when(F.col("capacity_m3") >= target, F.col("capacity_m3")))
    top = F.max_by(F.struct("candidate", "capacity_m3", F.lit(None).cast("double").alias("next_capacity_m3")), "capacity_m3")
    return ranked.agg(F.bool_or(F.col("capacity_m3") >= target).alias("meets_target"), F.when(F.bool_or(F.col("capacity_m3") >= target), best).otherwise(top).alias("s")).select("meets_target", "s.*")


def size_tiers(grid: DataFrame) -> DataFrame:
    """Small, intermediate and large: ordinals 0, n/3 and 2n/3 (rounded half to even) without repeats."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    at = F.col("candidate").cast("long")
    label = F.when(at == 0, "small").when(at == F.least(F.bround(n / 3), n - 1).cast("long"), "intermediate").when(at == F.least(F.bround(2 * n / 3), n - 1).cast("long"), "large")
    return grid.withColumn("label", label).where(F.col("label").isNotNull())


def site_sizes(sites: DataFrame) -> DataFrame:
    """sites (site, max_length_m, max_width_m, ...) + (length_m, width_m, depth_m, capacity_m3, candidate): the sizes that fit each
    site, smallest capacity first, numbered from 0. A site that is too small for all, or has no limits, has no row.

    The sizes are expressions of a site's row and the order is one within a site, so any number of sites are done at once.
    """
    each = sites
    for name, values in (("length_m", LENGTHS), ("width_m", WIDTHS), ("depth_m", DEPTHS)):
        each = each.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    fits = each.where((F.col("length_m") <= F.col("max_length_m")) & (F.col("width_m") <= F.col("max_width_m")))
    capacity = pond_geometry(F.col("length_m"), F.col("width_m"), F.col("depth_m"), F.lit(SIDE_SLOPE), F.lit(FREEBOARD))["capacity_m3"]
    sized = fits.withColumn("capacity_m3", F.bround(capacity, 2)).where("capacity_m3 IS NOT NULL")
    order = Window.partitionBy("site").orderBy("capacity_m3", "length_m", "width_m", "depth_m")
    return sized.withColumn("candidate", F.row_number().over(order) - 1)


def sizes_for_targets(sizes: DataFrame) -> DataFrame:
    """(site, target_m3, meets_target, candidate, capacity_m3, next_capacity_m3, reasoning) of site_sizes with a target_m3 each: the least
    size that holds the target and the next one up, or the largest, not recommended, where none does; a null target has no row."""
    up = F.lead("capacity_m3").over(Window.partitionBy("site").orderBy("capacity_m3", "candidate"))
    holds = F.col("capacity_m3") >= F.col("target_m3")
    of = F.struct("candidate", "capacity_m3", "next_capacity_m3")
    made = sizes.where("target_m3 IS NOT NULL").withColumn("next_capacity_m3", up).groupBy("site", "target_m3").agg(
        F.bool_or(holds).alias("meets_target"), F.min(F.when(holds, F.struct("capacity_m3", of.alias("s")))).alias("least"), F.max(F.struct("capacity_m3", of.alias("s"))).alias("most")
    )
    got = F.when(F.col("meets_target"), F.col("least.s")).otherwise(F.col("most.s"))
    named = made.select("site", "target_m3", "meets_target", got.alias("s")).select("site", "target_m3", "meets_target", "s.*")
    fine = F.format_string("%.2f m3 is the least size that holds %.2f m3", "capacity_m3", "target_m3")
    more = F.when(F.col("next_capacity_m3").isNotNull(), F.format_string("; the next one up has %.2f m3", "next_capacity_m3")).otherwise(F.lit("; there is none above it"))
    none = F.format_string("no size that fits holds %.2f m3; the largest has %.2f m3", "target_m3", "capacity_m3")
    return named.withColumn("reasoning", F.when(F.col("meets_target"), F.concat(fine, more)).otherwise(none))


def site_tiers(sizes: DataFrame) -> DataFrame:
    """site_sizes + label of those that are small, intermediate and large for their site: ordinals 0, n/3 and 2n/3, without repeats."""
    n = F.count(F.lit(1)).over(Window.partitionBy("site"))
    at = F.col("candidate").cast("long")
    label = F.when(at == 0, "small").when(at == F.least(F.bround(n / 3), n - 1).cast("long"), "intermediate").when(at == F.least(F.bround(2 * n / 3), n - 1).cast("long"), "large")
    return sizes.withColumn("label", label).where(F.col("label").isNotNull())


def _surface(storage: np.ndarray, deep: np.ndarray, length: np.ndarray, width: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Water surface at a storage: the depth by BISECTIONS halvings of its range, the area at the last one tried."""
    span, base = deep / 2, np.zeros_like(deep)  # the depth tried is base + span
    for k in range(BISECTIONS):
        tried = base + span
        holds = tried * (length * width + tried * (slope * (length + width) + tried * (4 * slope**2 / 3)))
        if k + 1 < BISECTIONS:
            base, span = np.where(holds < storage, tried, base), span / 2
    return np.where(storage > 0, (length + 2 * slope * tried) * (width + 2 * slope * tried), 0.0)


DESIGN = ["design_id", "capacity_m3", "water_depth_m", "bottom_length_m", "bottom_width_m", "side_slope", "footprint_area_m2", "runoff_area_m2", "runoff_coefficient", "evaporation_mm_day", "seepage_mm_day", "demand_m3_day", "initial_storage_fraction"]
DAILY = "design_id bigint, day date, " + ", ".join(f"{c} double" for c in FLOWS) + ", start_storage_m3 double, end_storage_m3 double, full int, empty int"


#: Rows that a group of ponds may give in all.
GROUP_ROWS = 250_000


def balance_step(level: np.ndarray, mm: float, p: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """One day of many ponds from their level: the values of DAILY after the day, of which the last but two is the new level."""
    runoff, direct = mm / 1000 * p["runoff_area_m2"] * p["runoff_coefficient"], mm / 1000 * p["footprint_area_m2"]
    inflow, cap = runoff + direct, p["capacity_m3"]
    held = np.minimum(cap, level + runoff + direct)
    spilled = np.maximum(0, level + runoff + direct - cap)
    if p["lossy"]:
        surface = _surface(held, p["water_depth_m"], p["bottom_length_m"], p["bottom_width_m"], p["side_slope"])
        evaporated = np.minimum(held, p["evaporation_mm_day"] / 1000 * surface)
        seeped = np.minimum(held - evaporated, p["seepage_mm_day"] / 1000 * surface)
    else:
        evaporated = seeped = np.zeros_like(held)
    supplied = np.minimum(held - evaporated - seeped, p["demand_m3_day"])
    after = held - evaporated - seeped - supplied
    return np.full(len(held), mm), runoff, direct, inflow, spilled, evaporated, seeped, supplied, p["demand_m3_day"] - supplied, level, after, (held >= cap - TOLERANCE).astype(int), (after <= TOLERANCE).astype(int)


def daily_balance(designs: DataFrame, daily: DataFrame) -> DataFrame:
    """One row a design and day. Designs are dealt into groups of about GROUP_ROWS rows of output, each of which steps through the days.

    The number of groups follows the numbers of designs and days, so a task's memory does not grow with either. The rain
    reaches the groups by a cogroup on their number.
    """
    n_designs, n_days = designs.count(), daily.count()
    groups = -(-n_designs // max(1, GROUP_ROWS // max(1, n_days))) or 1
    keyed = designs.select(*DESIGN).withColumn("group__", F.pmod(F.xxhash64("design_id"), F.lit(groups)).cast("int"))
    rain = daily.select("day", F.col("rain_mm").cast("double").alias("rain_mm")).withColumn("group__", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    columns = [*FLOWS, "start_storage_m3", "end_storage_m3", "full", "empty"]

    def simulate(key: tuple, ponds: pd.DataFrame, days: pd.DataFrame) -> pd.DataFrame:
        if ponds.empty or days.empty:
            return pd.DataFrame(columns=["design_id", "day", *columns])
        days = days.sort_values("day")
        p: dict = {c: ponds[c].to_numpy(float) for c in DESIGN[1:]}
        p["lossy"] = bool((p["evaporation_mm_day"] != 0).any() or (p["seepage_mm_day"] != 0).any())
        level, made = p["initial_storage_fraction"] * p["capacity_m3"], []
        for mm in days["rain_mm"]:
            made.append(balance_step(level, mm, p))
            level = made[-1][columns.index("end_storage_m3")]
        out = {"design_id": np.tile(ponds["design_id"].to_numpy(), len(days)), "day": np.repeat(days["day"].to_numpy(), len(ponds))}
        return pd.DataFrame(out | {c: np.concatenate([v[k] for v in made]) for k, c in enumerate(columns)})

    return keyed.groupBy("group__").cogroup(rain.groupBy("group__")).applyInPandas(simulate, DAILY)


def roll_up(rows: DataFrame, *by: str, order: str = "day") -> DataFrame:
    """Sums of the flows, storage at the start and the end, days full and empty, for any grouping of days or months."""
    days = {"days_full": "full", "days_empty": "empty"} if "full" in rows.columns else {"days_full": "days_full", "days_empty": "days_empty"}
    return rows.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in FLOWS],
        F.min_by("start_storage_m3", order).alias("start_storage_m3"),
        F.max_by("end_storage_m3", order).alias("end_storage_m3"),
        *[F.sum(v).cast("long").alias(k) for k, v in days.items()],
    )


def monthly(balance: DataFrame) -> DataFrame:
    return roll_up(balance.withColumn("month", F.date_format("day", "yyyy-MM")), "design_id", "month")


def annual(months: DataFrame) -> DataFrame:
    return roll_up(months.withColumn("year", F.substring("month", 1, 4).cast("int")), "design_id", "year", order="month")


def totals(months: DataFrame) -> DataFrame:
    """The whole period, and what the balance leaves unexplained."""
    left = F.col("start_storage_m3") + F.col("inflow_m3") - F.col("end_storage_m3") - (F.col("overflow_m3") + F.col("evaporation_m3") + F.col("seepage_m3") + F.col("supplied_m3"))
    return roll_up(months, "design_id", order="month").withColumn("residual_m3", left)


def season_table(spark: SparkSession, seasons: dict[str, list[int]] | None = None) -> DataFrame:
    """(month_no, season); the seasons have to hold each month once."""
    seasons = seasons or SEASONS
    if sorted(m for months in seasons.values() for m in months) != list(range(1, 13)):
        raise ValueError("seasons have to hold each month exactly once")
    return spark.createDataFrame([(m, s) for s, months in seasons.items() for m in months], "month_no int, season string")


def seasonal(months: DataFrame, seasons: DataFrame) -> DataFrame:
    """One row a design, calendar year and season; December belongs to its own year."""
    named = months.withColumns({"year": F.substring("month", 1, 4).cast("int"), "month_no": F.substring("month", 6, 2).cast("int")})
    return roll_up(named.join(F.broadcast(seasons), "month_no"), "design_id", "year", "season", order="month")


def seasonal_summary(by_season: DataFrame, capacity: DataFrame) -> DataFrame:
    """One row a design: years seen and filled, fill rate, mean overflow, storage at the end of the monsoon."""
    years = by_season.groupBy("design_id", "year").agg(
        F.bool_or(F.col("days_full") > 0).alias("filled"),
        F.sum("overflow_m3").alias("overflow_m3"),
        F.max(F.when(F.col("season") == "monsoon", F.col("end_storage_m3"))).alias("monsoon_end_m3"),
    )
    made = years.groupBy("design_id").agg(
        F.count(F.lit(1)).alias("years_analysed"),
        F.count_if("filled").alias("years_filled"),
        F.avg("overflow_m3").alias("mean_overflow_m3"),
        F.avg("monsoon_end_m3").alias("mean_monsoon_end_m3"),
    )
    share = 100 * F.col("mean_monsoon_end_m3") / F.col("capacity_m3")
    return made.join(capacity, "design_id").select("design_id", "years_analysed", "years_filled", (100 * F.col("years_filled") / F.col("years_analysed")).alias("fill_rate_percent"), "mean_overflow_m3", "mean_monsoon_end_m3", F.when(F.col("capacity_m3") > 0, share).alias("mean_monsoon_end_percent"))


def evaluate_sizes(grid: DataFrame, daily: DataFrame, catchment_m2: float, coefficient: float = 0.3, evaporation: float = 4.0, seepage: float = 1.0, demand: float = 0.0, initial: float = 0.0) -> DataFrame:
    """The candidates with what ten years of rain would have made of them."""
    designs = grid.withColumns(
        {
            "design_id": F.col("candidate").cast("long"),
            "side_slope": F.lit(SIDE_SLOPE),
            "runoff_area_m2": F.greatest(F.lit(0.0), F.lit(catchment_m2) - F.col("footprint_area_m2")),
            "runoff_coefficient": F.lit(coefficient),
            "evaporation_mm_day": F.lit(evaporation),
            "seepage_mm_day": F.lit(seepage),
            "demand_m3_day": F.lit(demand),
            "initial_storage_fraction": F.lit(initial),
        }
    )
    months = cut(monthly(daily_balance(designs, daily)))
    summary = seasonal_summary(seasonal(months, season_table(grid.sparkSession)), designs.select("design_id", "capacity_m3"))
    inflow = annual(months).groupBy("design_id").agg((F.sum("inflow_m3") / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("mean_annual_inflow_m3"))
    return designs.select("design_id", "length_m", "width_m", "depth_m", "capacity_m3", "runoff_area_m2").join(summary, "design_id").join(inflow, "design_id")


def recommend(evaluated: DataFrame) -> DataFrame:
    """The three tiers, the default marked: the intermediate one, or the small one where that never fills."""
    tiers = size_tiers(evaluated.withColumn("candidate", F.col("design_id")))
    never = F.max(F.when(F.col("label") == "intermediate", F.col("years_filled") == 0)).over(Window.partitionBy())
    chosen = F.when(never, "small").otherwise("intermediate")
    reason = F.format_string("%s: fills in %d of %d years", "label", "years_filled", "years_analysed")
    return tiers.withColumn("recommended", F.col("label") == chosen).withColumn("reasoning", reason).drop("candidate")

"""Daily rain: completeness of calendars, yearly totals, runoff volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def days_in_year(year: Column) -> Column:
    return F.datediff(F.make_date(year + 1, F.lit(1), F.lit(1)), F.make_date(year, F.lit(1), F.lit(1)))


def annual_totals(daily: DataFrame) -> DataFrame:
    """(year, days_expected, days_present, complete, annual_mm) from (day, rain_mm), one row a day."""
    return (
        daily.groupBy(F.year("day").alias("year"))
        .agg(F.count(F.lit(1)).alias("days_present"), F.sum("rain_mm").alias("annual_mm"))
        .select("year", days_in_year(F.col("year")).alias("days_expected"), "days_present", (F.col("days_present") == days_in_year(F.col("year"))).alias("complete"), "annual_mm")
    )


def calendar_gaps(daily: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Days of the years that have no row."""
    spark = daily.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.make_date(F.lit(last_year), F.lit(12), F.lit(31)))).alias("day"))
    return days.join(daily.select("day").distinct(), "day", "left_anti")


def rain_summary(daily: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """One row: status, mean and yearly totals; the whole series is unavailable if a day lacks or a value is no rain."""
    from rainfold.functions.parsing import usable_rain

    some = daily.where(F.year("day").between(first_year, last_year))
    years = annual_totals(some.withColumn("rain_mm", F.when(usable_rain(F.col("rain_mm")), F.col("rain_mm")))).join(
        some.groupBy(F.year("day").alias("year")).agg(F.count_if(usable_rain(F.col("rain_mm"))).alias("usable")), "year"
    )
    got = years.agg(
        (F.count_if(F.col("complete") & (F.col("usable") == F.col("days_expected"))) == last_year - first_year + 1).alias("fine"),
        F.avg("annual_mm").alias("mean_mm"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("year", "annual_mm")))).alias("totals"),
    )
    return got.select(
        F.when(F.col("fine"), "available").otherwise("unavailable").alias("status"),
        F.when(F.col("fine"), F.col("mean_mm")).alias("mean_annual_mm"),
        F.when(F.col("fine"), F.col("totals")).alias("annual_totals_mm"),
    )


def runoff_volume(sites: DataFrame, mean_mm: Column, coefficient: Column) -> DataFrame:
    """sites + (annual_m3, status, reasons): area times rain times coefficient, provisional where routing is unsure."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("boundary_truncated"), F.lit("catchment_truncated")),
            F.when(F.col("routing_sensitivity_fraction") > 0.5, F.lit("routing_sensitive")),
        )
    )
    return sites.withColumns(
        {
            "annual_m3": mean_mm / 1000 * F.col("area_m2") * coefficient,
            "reasons": reasons,
            "status": F.when(mean_mm.isNull(), "unavailable").when(F.size(reasons) > 0, "provisional").otherwise("estimated"),
        }
    )


def year_window(today: Column, years: int = 10) -> tuple[Column, Column]:
    """First and last of the latest complete calendar years."""
    return F.year(today) - years, F.year(today) - 1

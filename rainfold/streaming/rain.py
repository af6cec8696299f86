"""Rain as a stream: daily sums with a watermark, and storage carried from day to day as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of new Parquet files of (station, ts, mm) in a folder."""
    return spark.readStream.schema("station bigint, ts timestamp, mm double").parquet(folder)


def daily_rain(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(station, day, rain_mm): sums of days that no event can reach any more."""
    sums = events.withWatermark("ts", late).groupBy("station", F.window("ts", "1 day").alias("w")).agg(F.sum("mm").alias("rain_mm"))
    return sums.select("station", F.to_date("w.start").alias("day"), "rain_mm")


def running_storage(daily: DataFrame, capacity_m3: float, area_m2: float, coefficient: float = 0.3) -> DataFrame:
    """(station, day, overflow_m3, storage_m3): a tank without losses, its level held as state of the stream."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values("day")
        out = []
        for day, mm in zip(rows["day"], rows["rain_mm"], strict=True):
            have = level + mm / 1000 * area_m2 * coefficient
            level = min(capacity_m3, have)
            out.append((key[0], day, max(0.0, have - capacity_m3), level))
        state.update((level,))
        yield pd.DataFrame(out, columns=["station", "day", "overflow_m3", "storage_m3"])

    return daily.groupBy("station").applyInPandasWithState(step, "station bigint, day date, overflow_m3 double, storage_m3 double", "level double", "append", GroupStateTimeout.NoTimeout)

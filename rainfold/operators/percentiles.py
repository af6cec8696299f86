"""Exact percentiles of whole numbers by radix selection: no buffer holds the values of a group, however large it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainfold.operators import graph
from rainfold.operators.graph import salted_join
from rainfold.plans.store import TASK_ROWS, apart, cut

#: Bits that a pass settles; a group's histogram has up to 2**DIGIT rows a pass.
DIGIT = 11


def exact_percentile(rows: DataFrame, key: str, value: str, share: float, name: str) -> DataFrame:
    """(key, name): the percentile of each key's values, between two values by their distance, as SQL's `percentile` has it.

    Equal values are counted first. Then each pass takes one digit of the two values about the wanted rank, from the highest on: the
    values that share the digits found so far are counted by their next one, and running sums over this histogram tell the digit and
    the rank within it. Values are whole and not negative, else an error is raised; rows without a key or a value count for nothing.
    """
    refuse = F.raise_error(F.format_string("%d is negative", F.col(value).cast("long"))).cast("long")
    taken = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key), F.when(F.col(value) < 0, refuse).otherwise(F.col(value).cast("long")).alias("v__"))
    values = cut(taken.groupBy(key, "v__").agg(F.count(F.lit(1)).alias("n__")))
    groups = cut(values.groupBy(key).agg(F.sum("n__").alias("all__"), F.count(F.lit(1)).alias("distinct__")))
    counts = groups.select(key, F.col("distinct__").alias("n__"))
    place = (F.col("all__") - 1) * F.lit(float(share))
    ranks = F.array(F.struct(F.lit(False).alias("upper"), F.floor(place).alias("rank")), F.struct(F.lit(True).alias("upper"), F.ceil(place).alias("rank")))
    sought = groups.select(key, F.explode(ranks).alias("r__")).select(key, "r__.*", F.lit(0).cast("long").alias("prefix"))
    most = values.agg(F.max("v__")).first()[0] or 0  # one number
    largest, total = groups.agg(F.max("distinct__"), F.sum("distinct__")).first()
    tasks = -(-(total or 0) // TASK_ROWS) or 1  # by rows: they compress so well that by their bytes all would be one task's
    even = (largest or 0) <= max(graph.HEAVY_ROWS, (total or 0) // 100)
    for shift in range((max(most.bit_length(), 1) - 1) // DIGIT * DIGIT, -1, -DIGIT):
        before = F.shiftright("v__", shift + DIGIT) if shift + DIGIT < 63 else F.lit(0).cast("long")
        both = F.struct("upper", "rank", "prefix").alias("s__")
        wanted = sought.groupBy(key).agg(F.collect_list(both).alias("s__"))  # two a key
        met = values.repartition(tasks, key).join(apart(wanted.repartition(tasks, key)), key) if even else salted_join(values, wanted, key, counts)
        near = met.select(key, "v__", "n__", F.explode("s__").alias("s__")).where(before == F.col("s__.prefix"))
        digit = F.shiftright("v__", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        histogram = near.groupBy(key, "s__", digit.alias("digit")).agg(F.sum("n__").alias("n__"))
        upto = F.sum("n__").over(Window.partitionBy(key, "s__").orderBy("digit"))
        found = histogram.withColumn("upto", upto).where((F.col("upto") > F.col("s__.rank")) & (F.col("upto") - F.col("n__") <= F.col("s__.rank")))
        sought = cut(found.select(key, "s__.upper", (F.col("s__.rank") - F.col("upto") + F.col("n__")).alias("rank"), (F.col("s__.prefix") * (1 << DIGIT) + F.col("digit")).alias("prefix")))
    ends = sought.groupBy(key).agg(*[F.max(F.when(F.col("upper") == up, F.col("prefix"))).cast("double").alias(n) for n, up in (("low__", False), ("high__", True))])
    between = (F.ceil(place) - place) * F.col("low__") + (place - F.floor(place)) * F.col("high__")
    return groups.join(ends, key).select(key, F.when(F.col("low__") == F.col("high__"), F.col("low__")).otherwise(between).alias(name))

"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document gets an exponential key -ln(u)/weight, u from a digest of its id and weight from its quality. A source's
target of T words over S words of documents means floor(T/S) complete epochs; the fraction left is taken in the order of
the keys until the words still missing are reached, the document at the edge in part. Keys fall into equal-probability
buckets; the sums of buckets (one row a source and bucket) tell where a source's edge lies, so only the rows of the edge
bucket are sorted, however large a source is, and no source has to fit into one task.

Targets: sources have weights 1, 2, 3, repeating, by code point with null last; each has its share of all sizes but not
over `cap` times its own size, and the excess goes to the others by weight. That is target = min(cap * size, level *
weight) for one level, found from the sources sorted by size over weight.

Null texts have size 0 and are never taken. Repeated rows have equal keys and lie side by side. Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainfold.llm.common import WORD_PATTERN, cut, is_small

BUCKETS = 4096
#: Sources up to which their one row each is broadcast, if their names are short; beyond, the rows are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str = "mix") -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def quality_weight(chars: Column, words: Column) -> Column:
    """1 where a word has six characters on average with its space, less the further from it, 0.25 at least."""
    mean = chars / F.greatest(words, F.lit(1))
    return F.greatest(F.lit(0.25), F.lit(1.0) - F.abs(mean - 6.0) / 12.0)


def source_targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, source_size) -> + (target DOUBLE). One row a source goes through one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto = everything.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    weighed = sizes.withColumn("weight", (F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1).cast("double"))
    ranked = weighed.withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    # the level if all sources before this one are at their cap; the first source above it ends the capped ones
    left = F.sum("source_size").over(total) - F.coalesce(F.sum(cap * F.col("source_size")).over(upto), F.lit(0.0))
    weight_left = F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    levels = ranked.withColumn("level", left / weight_left)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(total)["level"]
    return levels.withColumn("target", F.round(F.least(cap * F.col("source_size"), F.coalesce(first, F.lit(float("inf"))) * F.col("weight")), 6)).drop("weight", "ratio", "level")


def mix(docs: DataFrame, size: str = "size", source: str = "source", key: str = "doc_id", weight: str = "weight", cap: float = 3.0) -> DataFrame:
    """docs (small columns) + (source_size BIGINT, target DOUBLE, taken BIGINT)."""
    u = uniform(F.col(key))
    keyed = cut(docs.withColumn("key__", -F.log(u) / F.col(weight)).withColumn("bucket__", F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("key__") * 0.75)) * BUCKETS)).cast("int")))
    sums = cut(keyed.groupBy(source, "bucket__").agg(F.sum(size).cast("long").alias("words__")))
    totals = sums.groupBy(F.col(source).alias("source")).agg(F.sum("words__").alias("source_size"))
    plan = source_targets(totals, cap).withColumn("epochs__", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("part__", F.round(F.col("target") - F.col("epochs__") * F.col("source_size")).cast("long"))
    plan = cut(plan.withColumnRenamed("source", "source__"))
    few = is_small(plan, BROADCAST_SOURCES)
    plan = F.broadcast(plan) if few else plan
    before = Window.partitionBy(source).orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    edges = sums.withColumn("before__", F.coalesce(F.sum("words__").over(before), F.lit(0)))
    edges = edges.join(plan, F.col(source).eqNullSafe(F.col("source__"))).where((F.col("before__") < F.col("part__")) & (F.col("part__") <= F.col("before__") + F.col("words__")))
    edges = edges.select(F.col("source__").alias("of__"), F.col("bucket__").alias("edge__"), "before__")
    full = plan.join(F.broadcast(edges) if few else edges, F.col("source__").eqNullSafe(F.col("of__")), "left").drop("of__")
    rows = keyed.join(F.broadcast(full) if few else full, F.col(source).eqNullSafe(F.col("source__"))).drop("source__")
    fraction = F.when(F.col("edge__").isNull() | (F.col("bucket__") > F.col("edge__")), F.lit(0)).otherwise(F.col(size)).cast("long")
    at_edge = F.col("edge__").isNotNull() & (F.col("bucket__") == F.col("edge__"))
    in_bucket = Window.partitionBy(source).orderBy("key__", key, size).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.where(at_edge).withColumn("fraction__", F.greatest(F.lit(0), F.least(F.col(size), F.col("part__") - F.col("before__") - F.coalesce(F.sum(size).over(in_bucket), F.lit(0)))).cast("long"))
    mixed = rows.where(~at_edge).withColumn("fraction__", fraction).unionByName(inner)
    return mixed.withColumn("taken", F.col("epochs__") * F.col(size) + F.col("fraction__")).drop("key__", "bucket__", "edge__", "before__", "part__", "epochs__", "fraction__")


def with_sizes(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """keep + (doc_id, source, size, weight): what a mix needs of each document."""
    sized = docs.select("doc_id", "source", *keep, word_count(F.col("text")).alias("size"), F.coalesce(F.char_length("text"), F.lit(0)).alias("chars__"))
    return sized.select("doc_id", "source", *keep, "size", quality_weight(F.col("chars__"), F.col("size")).alias("weight"))


def mix_report(docs: DataFrame) -> DataFrame:
    """The contract columns of op6, and the source."""
    return mix(with_sizes(docs)).select("doc_id", "source", "size", "source_size", "target", "taken")

"""Shards by a Feistel permutation with cycle walking over global row numbers, in DataFrame functions only.

Row numbers come without a sort of all rows: a mix of the key and of what orders its rows deals rows to buckets, bucket sizes are
summed up (one row a bucket), and a row's number is its bucket's offset plus its place in the bucket. There are as many buckets as
keep one at about `BUCKET_ROWS` rows, and very many rows of one key (or without one) fall into many buckets, as long as they
differ. A permutation of 0..side**2-1, the
least square that holds all rows, maps numbers to positions; positions past the end walk on. How long the longest walk
is is found beforehand from the few numbers past the end, so every row takes a fixed number of steps. Position p lies in
shard p mod n at slot p div n: counts differ by one at most, slots have no gap, and both can be computed from the number.

Rows with one key and equal contents may swap numbers, which no result shows. Null keys count as -1. An empty table
gives an empty result. All arithmetic is modulo 2**31-1, so other engines can follow it.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainfold.llm.common import cut

PRIME = (1 << 31) - 1
#: Buckets at least, rows that a bucket has about beyond that, and buckets up to which their offsets are broadcast.
BUCKETS, BUCKET_ROWS, BROADCAST_BUCKETS = 1024, 250_000, 1 << 16
ROUND_KEYS = (1_234_577, 87_178_291, 433_494_437, 1_073_676_287, 715_827_883, 370_248_451)


def mix(x: Column, key: int) -> Column:
    """A value of 0..PRIME-1 from a number: a cubic polynomial modulo PRIME, each product below 2**62."""
    p = F.lit(PRIME).cast("long")
    a = F.pmod(x.cast("long"), p)
    b = F.pmod(a * a + F.lit(key).cast("long"), p)
    return F.pmod(b * F.pmod(a + F.lit(2 * key + 1).cast("long"), p) + F.lit(key).cast("long"), p)


def permute(x: Column, side: Column) -> Column:
    """The Feistel network on pairs (x div side, x mod side)."""

    def one(pair: Column, key: Column) -> Column:
        left, right = pair["l"], pair["r"]
        p = F.lit(PRIME).cast("long")
        a = F.pmod(right, p)
        b = F.pmod(a * a + key, p)
        c = F.pmod(b * F.pmod(a + 2 * key + 1, p) + key, p)
        return F.struct(right.alias("l"), F.pmod(left + c, side).alias("r"))

    start = F.struct(F.floor(x / side).cast("long").alias("l"), F.pmod(x, side).alias("r"))
    keys = F.array(*[F.lit(k).cast("long") for k in ROUND_KEYS])
    return F.aggregate(keys, start, one, lambda pair: pair["l"] * side + pair["r"])


def walk(x: Column, n: Column, side: Column, steps: int) -> Column:
    """The position of number x: permuted once, and again while it lies past the end."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(-1).cast("long"), lambda v, i: F.when(i == 1, permute(x, side)).when(v >= n, permute(v, side)).otherwise(v))


def longest_walk(df: DataFrame, n: int, side: int) -> int:
    """Steps after which every number below n has come to a position below n; looks only at the numbers past the end."""
    left = df.sparkSession.range(n, side * side).select(F.col("id").alias("v"))
    steps = 1
    while left.limit(1).count():
        steps += 1
        left = left.select(permute(F.col("v"), F.lit(side).cast("long")).alias("v")).where(F.col("v") >= n)
        if steps > side * side - n + 1:
            break  # only cycles that no number below n enters
        if steps % 8 == 0:
            left = cut(left)
    return steps


def bucket_of(key: Column, ties: list[Column], buckets: int) -> Column:
    x = mix(F.coalesce(key, F.lit(-1)), ROUND_KEYS[0])
    for t in ties:
        x = mix(x + F.pmod(F.coalesce(t, F.lit(-1)).cast("long"), F.lit(PRIME).cast("long")), ROUND_KEYS[1])
    return F.pmod(x, F.lit(buckets)).cast("int")


def assign(df: DataFrame, key: str, shards: int = 8, ties: tuple[str, ...] = ()) -> DataFrame:
    """df + (row_number BIGINT, shard INT, slot BIGINT). `ties` names whole-number columns that order rows of one key."""
    n = df.count()
    buckets = max(BUCKETS, -(-n // BUCKET_ROWS))
    own = bucket_of(F.col(key), [F.col(t) for t in ties], buckets)
    counts = df.groupBy(own.alias("bucket__")).agg(F.count(F.lit(1)).alias("rows__"))
    before = Window.orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    offsets = counts.select("bucket__", F.coalesce(F.sum("rows__").over(before), F.lit(0)).cast("long").alias("offset__"))
    offsets = F.broadcast(offsets) if buckets <= BROADCAST_BUCKETS else offsets
    side = isqrt(max(n, 1) - 1) + 1
    steps = longest_walk(df, n, side) if n else 1
    place = F.row_number().over(Window.partitionBy("bucket__").orderBy(F.col(key).asc_nulls_first(), *ties)).cast("long")
    numbered = df.withColumn("bucket__", own).withColumn("place__", place).join(offsets, "bucket__").withColumn("row_number", F.col("offset__") + F.col("place__") - 1)
    placed = numbered.withColumn("position__", walk(F.col("row_number"), F.lit(n).cast("long"), F.lit(side).cast("long"), steps))
    return placed.withColumns({"shard": F.pmod("position__", F.lit(shards)).cast("int"), "slot": F.floor(F.col("position__") / shards).cast("long")}).drop("bucket__", "position__", "offset__", "place__")


def shard_report(docs: DataFrame) -> DataFrame:
    """All documents in eight shards of row counts at most one apart: the contract columns of op4."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    sized = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    put = assign(sized, "doc_id", 8, ("size", "text_crc32"))
    return put.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")

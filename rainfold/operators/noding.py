"""Noding of line work: stretches that cross or touch are split there, so that lines meet at vertices only.

Stretches meet in squares as long as the longer one, rounded up to a power of two: each lies in four squares of its own size at most, and
asks once for each larger size that its line work has. Neither long stretches among short ones nor dense places give all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainfold.plans.store import cut

ENDS = ("x0", "y0", "x1", "y1")

POINTS = "array<struct<x:double,y:double>>"


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _squares(level: str) -> Column:
    """The squares of a level that the box of a stretch meets."""
    side = F.pow(F.lit(2.0), F.col(level))
    spans = [F.sequence(F.floor(F.least(f"{c}0", f"{c}1") / side), F.floor(F.greatest(f"{c}0", f"{c}1") / side)) for c in ("x", "y")]
    return F.flatten(F.transform(spans[0], lambda i: F.transform(spans[1], lambda j: F.struct(i.alias("i"), j.alias("j")))))


def _side_of(a: str, x: Column, y: Column) -> Column:
    """The sign of the turn from stretch a to a point; 0 on its line."""
    return F.signum((F.col(f"{a}.x1") - F.col(f"{a}.x0")) * (y - F.col(f"{a}.y0")) - (F.col(f"{a}.y1") - F.col(f"{a}.y0")) * (x - F.col(f"{a}.x0")))


def _touches(a: str, b: str) -> Column:
    """The ends of stretch b that lie on stretch a."""

    def end(n: str) -> Column:
        x, y = F.col(f"{b}.x{n}"), F.col(f"{b}.y{n}")
        boxed = [v.between(F.least(f"{a}.{c}0", f"{a}.{c}1"), F.greatest(f"{a}.{c}0", f"{a}.{c}1")) for v, c in ((x, "x"), (y, "y"))]
        return F.when((_side_of(a, x, y) == 0) & boxed[0] & boxed[1], _point(x, y))

    return F.array_compact(F.array(end("0"), end("1")))


def _crossing(digits: int) -> Column:
    """Where stretches a and b cross between their ends, as an array of at most one point."""
    ax, ay, bx, by = (F.col(f"{s}.{c}1") - F.col(f"{s}.{c}0") for s in "ab" for c in "xy")
    apart = [_side_of(s, F.col(f"{o}.x0"), F.col(f"{o}.y0")) * _side_of(s, F.col(f"{o}.x1"), F.col(f"{o}.y1")) < 0 for s, o in ("ab", "ba")]
    t = ((F.col("b.x0") - F.col("a.x0")) * by - (F.col("b.y0") - F.col("a.y0")) * bx) / F.nullif(ax * by - ay * bx, F.lit(0.0))
    point = _point(F.round(F.col("a.x0") + t * ax, digits) + 0.0, F.round(F.col("a.y0") + t * ay, digits) + 0.0)
    return F.when(apart[0] & apart[1] & t.isNotNull(), F.array(point)).otherwise(F.array().cast(POINTS))


def noded(edges: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """keys + (x0, y0, x1, y1): the stretches of each line work split where they meet, each once, from the lesser end to the greater.

    Crossings are computed once for both stretches and rounded to `digits` decimals, so that lines through one point have it in common;
    ends that lie on another stretch by the sign of doubles split it, and stretches that lie on each other become one. Null or
    non-finite ends are left out, stretches of no length too.
    """
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ENDS]
    given = edges.where(finite[0] & finite[1] & finite[2] & finite[3] & F.expr("x0 <> x1 OR y0 <> y1")).select(F.struct(*keys).alias("k"), F.struct(F.least(_point(F.col("x0"), F.col("y0")), _point(F.col("x1"), F.col("y1"))).alias("p"), F.greatest(_point(F.col("x0"), F.col("y0")), _point(F.col("x1"), F.col("y1"))).alias("q")).alias("e"))
    segs = cut(given.select("k", F.col("e.p.x").alias("x0"), F.col("e.p.y").alias("y0"), F.col("e.q.x").alias("x1"), F.col("e.q.y").alias("y1")).distinct())
    level = F.ceil(F.log2(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))))).cast("int")
    leveled, one = segs.withColumn("level", level), F.struct(*ENDS)
    held = leveled.select("k", "level", F.explode(_squares("level")).alias("square"), one.alias("b"))
    sizes = leveled.select("k", F.col("level").alias("large")).distinct()
    asks = leveled.join(sizes, "k").where("large >= level").select("k", F.col("large").alias("level"), F.explode(_squares("large")).alias("square"), one.alias("a"), F.col("level").alias("own"))
    meet = asks.join(held, ["k", "level", "square"]).where((F.col("own") < F.col("level")) | (F.col("a") < F.col("b")))
    for c in ("x", "y"):
        meet = meet.where((F.least(f"a.{c}0", f"a.{c}1") <= F.greatest(f"b.{c}0", f"b.{c}1")) & (F.least(f"b.{c}0", f"b.{c}1") <= F.greatest(f"a.{c}0", f"a.{c}1")))
    met = meet.select("k", "a", "b", _crossing(digits).alias("both"), _touches("a", "b").alias("on_a"), _touches("b", "a").alias("on_b"))
    parts = F.array(F.struct(F.col("a").alias("s"), F.concat("both", "on_a").alias("at")), F.struct(F.col("b").alias("s"), F.concat("both", "on_b").alias("at")))
    cuts = met.select("k", F.explode(parts).alias("part")).select("k", "part.s", F.explode("part.at").alias("at"))
    inner = cuts.where(((F.col("at.x") != F.col("s.x0")) | (F.col("at.y") != F.col("s.y0"))) & ((F.col("at.x") != F.col("s.x1")) | (F.col("at.y") != F.col("s.y1"))))
    along = (F.col("at.x") - F.col("s.x0")) * (F.col("s.x1") - F.col("s.x0")) + (F.col("at.y") - F.col("s.y0")) * (F.col("s.y1") - F.col("s.y0"))
    split = inner.groupBy("k", "s").agg(F.sort_array(F.collect_set(F.struct(along.alias("t"), "at"))).alias("stops"))
    whole = segs.select("k", one.alias("s")).join(split, ["k", "s"], "left")
    stops = F.concat(F.array(_point(F.col("s.x0"), F.col("s.y0"))), F.coalesce(F.transform("stops", lambda p: p["at"]), F.array().cast(POINTS)), F.array(_point(F.col("s.x1"), F.col("s.y1"))))
    pieces = whole.withColumn("stops", stops).select("k", F.explode(F.zip_with(F.slice("stops", 1, F.size("stops") - 1), F.slice("stops", 2, F.size("stops") - 1), lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")))).alias("e"))
    made = pieces.where("e.p <> e.q").select(*[F.col(f"k.{c}").alias(c) for c in keys], F.col("e.p.x").alias("x0"), F.col("e.p.y").alias("y0"), F.col("e.q.x").alias("x1"), F.col("e.q.y").alias("y1"))
    return made.distinct()

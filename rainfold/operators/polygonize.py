"""Polygons from line work: the rings of map relations stitched from their ways."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainfold.operators import graph
from rainfold.operators.noding import ENDS, noded
from rainfold.plans.store import apart, cut


def half_edges(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (x0, y0, x1, y1): each stretch between two vertices of `line` ARRAY<STRUCT<x, y>> once in either direction, split where lines meet."""
    last = F.size("line") - 1
    pair = F.zip_with(F.slice("line", 1, F.greatest(last, F.lit(0))), F.slice("line", 2, F.greatest(last, F.lit(0))), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))
    one = noded(lines.select(*keys, F.explode(pair).alias("e")).select(*keys, "e.*"), keys)
    back = one.select(*keys, F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    return one.unionByName(back)


def faces(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (face, points, area, loose): what line work bounds, each face once, closed, the face on the left.

    Bounded faces have positive area, the outside of each connected part a negative one. From the end of a half-edge a
    face goes on by the first way clockwise from where it came; see `graph.rings`.
    `loose` counts half-edges with the same face on either side: dead ends and bridges. Lines that cross are split there; see `noding`.
    """
    edges = cut(half_edges(lines, keys))
    onward = edges.select(*[F.col(k).alias(f"n_{k}") for k in keys], *[F.col(c).alias(f"n{c}") for c in ENDS])
    same = [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in keys]
    meet = edges.join(apart(onward), [*same, F.col("x1") == F.col("nx0"), F.col("y1") == F.col("ny0")])
    come = F.atan2(F.col("y0") - F.col("y1"), F.col("x0") - F.col("x1"))
    turn = come - F.atan2(F.col("ny1") - F.col("ny0"), F.col("nx1") - F.col("nx0"))
    returns = (F.col("nx1") == F.col("x0")) & (F.col("ny1") == F.col("y0"))
    clockwise = F.when(returns, 2 * math.pi).when(turn < 0, turn + 2 * math.pi).otherwise(turn)
    step = cut(meet.groupBy(*keys, *ENDS).agg(F.min_by(F.struct(*[F.col(f"n{c}").alias(c) for c in ENDS]), clockwise).alias("n")))

    def whole(ends: list[Column]) -> Column:
        return F.struct(*[F.col(k) for k in keys], *[e.alias(c) for e, c in zip(ends, ENDS, strict=True)])

    pairs = cut(step.select(whole([F.col(c) for c in ENDS]).alias("x"), whole([F.col(f"n.{c}") for c in ENDS]).alias("y")))
    made = graph.rings(pairs, keys, "x0", "y0")
    placed = made.select(F.get("nodes", F.lit(0)).alias("face"), F.posexplode("nodes").alias("place", "node"))
    of_face = placed.select("node", "face")
    twin = F.struct(*[F.col(f"node.{k}").alias(k) for k in keys], *[F.col(f"node.{o}").alias(c) for c, o in zip(ENDS, ("x1", "y1", "x0", "y0"), strict=True)])
    beyond = of_face.select(F.col("node").alias("twin"), F.col("face").alias("beyond"))
    made = placed.withColumn("twin", twin).join(apart(beyond), "twin").groupBy("face").agg(
        (F.sum(F.col("node.x0") * F.col("node.y1") - F.col("node.x1") * F.col("node.y0")) / 2).alias("area"),
        F.count_if(F.col("face") == F.col("beyond")).alias("loose"),
        F.sort_array(F.collect_list(F.struct("place", F.col("node.x0").alias("x"), F.col("node.y0").alias("y")))).alias("at"),
    )
    points = F.transform("at", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    closed = F.concat(points, F.slice(points, 1, 1))
    return made.select(*[F.col(f"face.{k}").alias(k) for k in keys], F.struct(*[F.col(f"face.{c}").alias(c) for c in ENDS]).alias("face"), closed.alias("points"), "area", "loose")


def relation_areas(relations: DataFrame) -> DataFrame:
    """(relation_id, shells, holes, error) from (relation_id, members ARRAY<STRUCT<role, geometry>>), see `surfaces.assemble_relations`.

    Members with the role `outer` or none bound the area, `inner` ones are taken out of it, others are left out. A place lies in
    the area if a shell covers it and no hole does. `error` is incomplete_outer or incomplete_inner where rings do not close:
    such a relation has no shells and is never taken for dry land.
    """
    role = F.when(F.coalesce("m.role", F.lit("")).isin("outer", ""), "outer").when(F.col("m.role") == "inner", "inner")
    lines = relations.select("relation_id", F.explode("members").alias("m")).select("relation_id", role.alias("part"), F.transform("m.geometry", lambda p: F.struct(p["lon"].cast("double").alias("x"), p["lat"].cast("double").alias("y"))).alias("line")).where("part IS NOT NULL")
    rings = faces(lines, ["relation_id", "part"])
    parts = rings.groupBy("relation_id", "part").agg(F.sort_array(F.collect_list(F.when(F.col("area") > 0, F.col("points")))).alias("rings"), F.sum("loose").alias("loose"))
    asked = lines.select("relation_id", "part").distinct().join(parts, ["relation_id", "part"], "left")
    fine = (F.coalesce("loose", F.lit(1)) == 0) & (F.size(F.coalesce("rings", F.array().cast(rings.select(F.array("points")).schema[0].dataType))) > 0)
    made = asked.groupBy("relation_id").agg(
        F.max(F.when((F.col("part") == "outer") & fine, F.col("rings"))).alias("shells"),
        F.max(F.when((F.col("part") == "inner") & fine, F.col("rings"))).alias("holes"),
        F.count_if((F.col("part") == "inner") & ~fine).alias("open_inner"),
    )
    all_ = relations.select("relation_id").join(made, "relation_id", "left")
    error = F.when(F.col("shells").isNull(), "incomplete_outer").when(F.col("open_inner") > 0, "incomplete_inner")
    none = F.array().cast(made.schema["shells"].dataType)
    ok = error.isNull()
    return all_.select("relation_id", F.when(ok, F.col("shells")).otherwise(none).alias("shells"), F.when(ok, F.coalesce("holes", none)).otherwise(none).alias("holes"), error.alias("error"))

"""Planar geometry on rings, ARRAY<STRUCT<x, y>> with the first point repeated at the end, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(ring: Column) -> Column:
    """ARRAY<STRUCT<a, b>> of neighbouring points."""
    n = F.size(ring)
    return F.when(n < 2, F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>")).otherwise(F.zip_with(F.slice(ring, 1, F.greatest(n - 1, F.lit(1))), F.slice(ring, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def signed_area(ring: Column) -> Column:
    """Shoelace formula: positive counter-clockwise."""
    return F.aggregate(segments(ring), F.lit(0.0), lambda t, s: t + (s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]) / 2)


def centroid(ring: Column) -> tuple[Column, Column]:
    """(x, y) of a ring's centre of area; null for a ring without area."""
    first = F.get(ring, F.lit(0))  # sums are taken about a point of the ring, as coordinates may be large
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(t: Column, s: Column) -> Column:
        ax, ay = s["a"]["x"] - first["x"], s["a"]["y"] - first["y"]
        bx, by = s["b"]["x"] - first["x"], s["b"]["y"] - first["y"]
        cross = ax * by - bx * ay
        return F.struct((t["a"] + cross).alias("a"), (t["x"] + (ax + bx) * cross).alias("x"), (t["y"] + (ay + by) * cross).alias("y"))

    got = F.aggregate(segments(ring), zero, add)
    whole = F.nullif(3 * got["a"], F.lit(0.0))
    return first["x"] + got["x"] / whole, first["y"] + got["y"] / whole


def is_closed(ring: Column) -> Column:
    first, last = F.get(ring, F.lit(0)), F.element_at(ring, -1)
    return (F.size(ring) >= 4) & (first["x"] == last["x"]) & (first["y"] == last["y"])


def on_segment(px: Column, py: Column, s: Column) -> Column:
    cross = (s["b"]["x"] - s["a"]["x"]) * (py - s["a"]["y"]) - (s["b"]["y"] - s["a"]["y"]) * (px - s["a"]["x"])
    return (cross == 0) & (px >= F.least(s["a"]["x"], s["b"]["x"])) & (px <= F.greatest(s["a"]["x"], s["b"]["x"])) & (py >= F.least(s["a"]["y"], s["b"]["y"])) & (py <= F.greatest(s["a"]["y"], s["b"]["y"]))


def covers_point(ring: Column, px: Column, py: Column) -> Column:
    """Whether a point lies in a ring or on it, by the parity of crossings to its right."""

    def crosses(s: Column) -> Column:
        spans = (s["a"]["y"] > py) != (s["b"]["y"] > py)
        at = s["a"]["x"] + (py - s["a"]["y"]) / F.nullif(s["b"]["y"] - s["a"]["y"], F.lit(0.0)) * (s["b"]["x"] - s["a"]["x"])
        return F.when(spans & (px < at), 1).otherwise(0)

    parts = segments(ring)
    inside = F.aggregate(parts, F.lit(0), lambda t, s: t + crosses(s)) % 2 == 1
    return inside | F.exists(parts, lambda s: on_segment(px, py, s))


def crosses_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether an edge passes through the inside of a box (touching its rim is no crossing)."""

    def enters(s: Column) -> Column:
        # Liang-Barsky: the part of the edge strictly between the box's sides
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        tx0, tx1 = (x0 - s["a"]["x"]) / F.nullif(dx, F.lit(0.0)), (x1 - s["a"]["x"]) / F.nullif(dx, F.lit(0.0))
        ty0, ty1 = (y0 - s["a"]["y"]) / F.nullif(dy, F.lit(0.0)), (y1 - s["a"]["y"]) / F.nullif(dy, F.lit(0.0))
        in_x, in_y = (s["a"]["x"] > x0) & (s["a"]["x"] < x1), (s["a"]["y"] > y0) & (s["a"]["y"] < y1)
        low = F.greatest(F.lit(0.0), F.when(dx == 0, 0.0).otherwise(F.least(tx0, tx1)), F.when(dy == 0, 0.0).otherwise(F.least(ty0, ty1)))
        high = F.least(F.lit(1.0), F.when(dx == 0, 1.0).otherwise(F.greatest(tx0, tx1)), F.when(dy == 0, 1.0).otherwise(F.greatest(ty0, ty1)))
        return ((dx != 0) | in_x) & ((dy != 0) | in_y) & (low < high)

    return F.exists(segments(ring), enters)


def covers_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a box lies wholly in a ring."""
    return covers_point(ring, (x0 + x1) / 2, (y0 + y1) / 2) & ~crosses_box(ring, x0, y0, x1, y1)


def segment_distance(px: Column, py: Column, s: Column) -> Column:
    """Distance from a point to a segment."""
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    length2 = dx * dx + dy * dy
    t = F.when(length2 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - s["a"]["x"]) * dx + (py - s["a"]["y"]) * dy) / length2)))
    return F.hypot(px - (s["a"]["x"] + t * dx), py - (s["a"]["y"] + t * dy))


def line_distance(line: Column, px: Column, py: Column) -> Column:
    return F.array_min(F.transform(segments(line), lambda s: segment_distance(px, py, s)))


def clip_ring(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A ring cut to a box, side by side (Sutherland-Hodgman); the area of what is left is right for any simple ring."""

    def side(points: Column, axis: str, at: Column, upper: bool) -> Column:
        def inside(p: Column) -> Column:
            return p[axis] <= at if upper else p[axis] >= at

        def cut(s: Column) -> Column:
            t = (at - s["a"][axis]) / F.nullif(s["b"][axis] - s["a"][axis], F.lit(0.0))
            return F.struct((s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"])).alias("x"), (s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"])).alias("y"))

        def keep(s: Column) -> Column:
            a, b = inside(s["a"]), inside(s["b"])
            empty = F.array().cast("array<struct<x:double,y:double>>")
            return F.when(a & b, F.array(s["b"])).when(a & ~b, F.array(cut(s))).when(~a & b, F.array(cut(s), s["b"])).otherwise(empty)

        made = F.flatten(F.transform(segments(points), keep))
        return F.when(F.size(made) > 0, F.concat(F.slice(made, -1, 1), made)).otherwise(made)

    out = side(ring, "x", x0, False)
    out = F.aggregate(F.array(F.lit(1)), out, lambda r, _: side(r, "x", x1, True))
    out = F.aggregate(F.array(F.lit(1)), out, lambda r, _: side(r, "y", y0, False))
    return F.aggregate(F.array(F.lit(1)), out, lambda r, _: side(r, "y", y1, True))


def simple(ring: Column) -> Column:
    """Whether no two edges cross or overlap, except neighbours in the point they share."""
    parts = F.transform(segments(ring), lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), i.alias("i")))
    n = F.size(ring) - 1

    def turn(p: Column, q: Column, r: Column) -> Column:
        return F.signum((q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"]))

    def meet(s: Column, t: Column) -> Column:
        apart = (turn(s["a"], s["b"], t["a"]) * turn(s["a"], s["b"], t["b"]) < 0) & (turn(t["a"], t["b"], s["a"]) * turn(t["a"], t["b"], s["b"]) < 0)
        touch = on_segment(t["a"]["x"], t["a"]["y"], s) | on_segment(t["b"]["x"], t["b"]["y"], s) | on_segment(s["a"]["x"], s["a"]["y"], t) | on_segment(s["b"]["x"], s["b"]["y"], t)
        return apart | touch

    def beside(s: Column, t: Column) -> Column:
        return (t["i"] - s["i"] == 1) | ((s["i"] == 0) & (t["i"] == n - 1))

    def folded(s: Column, t: Column) -> Column:
        return F.when(t["i"] - s["i"] == 1, on_segment(t["b"]["x"], t["b"]["y"], s) | on_segment(s["a"]["x"], s["a"]["y"], t)).otherwise(on_segment(t["a"]["x"], t["a"]["y"], s) | on_segment(s["b"]["x"], s["b"]["y"], t))

    clash = F.exists(parts, lambda s: F.exists(parts, lambda t: (t["i"] > s["i"]) & F.when(beside(s, t), folded(s, t)).otherwise(meet(s, t))))
    return ~clash

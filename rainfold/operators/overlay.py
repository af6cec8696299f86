"""Spatial joins of rings and lines with what lies in grid squares: filtered by squares, refined on the few edges that matter there.

Filter. A feature becomes a piece for each square that its bounds, grown by its reach, overlap: `near` holds the edges whose bounds
come within reach of the square, `band` those that a ray to the right from within the square can meet. Squares that no edge is near
lie wholly inside or outside; the former are pieces without edges, the latter are left out. So the size of all pieces goes by
edges and squares, not by their product.

Refine. What lies in a square meets the square's pieces by an equi-join, and numpy tests it against the edges of each piece, a row of
the join at a time. Rows are bounded: the cells of a square and the edges of one feature about it.

A feature's parts are its line or ring first, then its holes; each piece has lists of edges (x0, y0, x1, y1, ...) for each part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainfold.operators.graph import salted_join
from rainfold.plans.store import apart, cut

PIECE = "`bx` bigint, `by` bigint, `near` array<array<double>>, `band` array<array<double>>"
#: The largest number of rows of a batch made by a kernel.
BATCH_ROWS = 512


def kinds(df: DataFrame, columns: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in columns)


def edges_of(points: list[dict] | None) -> np.ndarray:
    """(n, 4) edges between neighbouring points."""
    xy = np.array([(p["x"], p["y"]) for p in points or ()], float).reshape(-1, 2)
    return np.hstack([xy[:-1], xy[1:]]) if len(xy) > 1 else np.empty((0, 4))


def covers(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points lie in a ring, by the parity of crossings to their right."""
    x0, y0, x1, y1 = edges.T
    spans = (y0 > y[:, None]) != (y1 > y[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = x0 + (y[:, None] - y0) / (y1 - y0) * (x1 - x0)
    return (spans & (x[:, None] < at)).sum(axis=1) % 2 == 1


def touches(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points lie on an edge."""
    x0, y0, x1, y1 = edges.T
    px, py = x[:, None], y[:, None]
    cross = (x1 - x0) * (py - y0) - (y1 - y0) * (px - x0)
    return ((cross == 0) & (px >= np.minimum(x0, x1)) & (px <= np.maximum(x0, x1)) & (py >= np.minimum(y0, y1)) & (py <= np.maximum(y0, y1))).any(axis=1)


def distance(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of points to the nearest of (m, 4) edges, or of each point's own in (points, m, 4); infinite without one."""
    if not edges.shape[-2]:
        return np.full(len(x), np.inf)
    x0, y0, x1, y1 = np.moveaxis(edges, -1, 0)
    dx, dy = x1 - x0, y1 - y0
    length2 = dx * dx + dy * dy
    t = np.where(length2 == 0, 0.0, np.clip(((x[:, None] - x0) * dx + (y[:, None] - y0) * dy) / np.where(length2 == 0, 1.0, length2), 0.0, 1.0))
    return np.hypot(x[:, None] - (x0 + t * dx), y[:, None] - (y0 + t * dy)).min(axis=1)


def crosses(edges: np.ndarray, left: np.ndarray, low: np.ndarray, right: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether one of (m, 4) edges, or of each box's own in (boxes, m, 4), passes through the inside of boxes; to touch the rim is no crossing."""
    x0, y0, x1, y1 = np.moveaxis(edges, -1, 0)
    enter, leave, there = np.zeros((len(left), 1)), np.ones((len(left), 1)), np.ones((len(left), 1), bool)
    for a, b, near, far in ((x0, x1, left, right), (y0, y1, low, high)):
        d = b - a
        with np.errstate(divide="ignore", invalid="ignore"):
            t0, t1 = (near[:, None] - a) / d, (far[:, None] - a) / d
        flat = d == 0
        there = there & (~flat | ((a > near[:, None]) & (a < far[:, None])))
        enter = np.maximum(enter, np.where(flat, 0.0, np.minimum(t0, t1)))
        leave = np.minimum(leave, np.where(flat, 1.0, np.maximum(t0, t1)))
    return (there & (enter < leave)).any(axis=1)


def area_in(edges: np.ndarray, left: np.ndarray, low: np.ndarray, right: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The area that a ring has in common with boxes: each edge adds what lies between it and the box's left side, within the box.

    Edges wholly left of a box add nothing to it, so those of a band are enough.
    """
    x0, y0, x1, y1 = edges.T
    rise = y1 - y0
    steep = rise != 0
    x0, y0, x1, y1, rise = (v[steep] for v in (x0, y0, x1, y1, rise))
    a, b = np.clip(y0, low[:, None], high[:, None]), np.clip(y1, low[:, None], high[:, None])
    u, v = ((x0 + (t - y0) / rise * (x1 - x0)) - left[:, None] for t in (a, b))
    w = (right - left)[:, None]

    def upto(z: np.ndarray) -> np.ndarray:
        """The integral of z held between 0 and w."""
        held = np.clip(z, 0.0, w)
        return held * held / 2 + w * np.maximum(z - w, 0.0)

    level = np.abs(v - u) < 1e-9 * (np.abs(u) + np.abs(v) + w)
    mean = np.where(level, np.clip((u + v) / 2, 0.0, w), (upto(v) - upto(u)) / np.where(level, 1.0, v - u))
    return np.abs((mean * (b - a)).sum(axis=1))


def pieces(features: DataFrame, keep: Sequence[str], side: float, line: str = "line", reach: Column | float = 0.0, area: Column | bool = True) -> DataFrame:
    """keep + (reach__, bx, by, near, band): what of each feature matters in each square of `side`; see above.

    Features have the line or ring and perhaps `holes`; `area` says whether the line bounds an area. Null lines give no piece.
    """
    holes = F.col("holes") if "holes" in features.columns else F.array().cast("array<array<struct<x:double,y:double>>>")
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    given = features.where(F.col(line).isNotNull()).select(*keep, as_column(reach).cast("double").alias("reach__"), F.concat(F.array(F.col(line)), F.coalesce(holes, F.array().cast("array<array<struct<x:double,y:double>>>"))).alias("parts__"), F.coalesce(as_column(area), F.lit(False)).alias("area__"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("parts__").to_pylist(), b.column("reach__").to_pylist(), b.column("area__").to_pylist(), strict=True)
            at: list[int] = []
            made: tuple[list, list, list, list] = ([], [], [], [])

            def out() -> pa.RecordBatch:
                taken = pa.array(at, pa.int64())
                columns = {c: b.column(c).take(taken) for c in [*keep, "reach__"]}
                lists = pa.list_(pa.list_(pa.float64()))
                got = pa.RecordBatch.from_pydict(columns | {"bx": pa.array(made[0], pa.int64()), "by": pa.array(made[1], pa.int64()), "near": pa.array(made[2], lists), "band": pa.array(made[3], lists)})
                for part in (at, *made):
                    part.clear()
                return got

            for i, (parts, far, bounds) in enumerate(rows):
                for x, y, near, band in _squares([edges_of(p) for p in parts], far, bounds, side):
                    at.append(i)
                    for part, value in zip(made, (x, y, near, band), strict=True):
                        part.append(value)
                    if len(at) >= BATCH_ROWS:
                        yield out()
            yield out()

    return given.mapInArrow(kernel, f"{kinds(given, [*keep, 'reach__'])}, {PIECE}")


def _squares(parts: list[np.ndarray], far: float, bounds: bool, side: float) -> Iterator[tuple[int, int, list, list]]:
    """(bx, by, near, band) of a feature's squares."""
    if not len(parts[0]):
        return
    low = [np.minimum(e[:, :2], e[:, 2:]) for e in parts]
    high = [np.maximum(e[:, :2], e[:, 2:]) for e in parts]
    first = np.floor((low[0].min(axis=0) - far) / side).astype(int)
    last = np.floor((high[0].max(axis=0) + far) / side).astype(int)
    for by in range(first[1], last[1] + 1):
        y0, y1 = by * side, (by + 1) * side
        rows = [(h[:, 1] >= y0 - far) & (a[:, 1] <= y1 + far) for a, h in zip(low, high, strict=True)]
        some = [(e[r], a[r], h[r]) for e, a, h, r in zip(parts, low, high, rows, strict=True)]
        for bx in range(first[0], last[0] + 1):
            x0, x1 = bx * side, (bx + 1) * side
            near = [e[(h[:, 0] >= x0 - far) & (a[:, 0] <= x1 + far)] for e, a, h in some]
            touched = any(map(len, near))
            if not touched and not bounds:
                continue
            right = [e[h[:, 0] >= x0 - far] for e, _, h in some] if bounds else [np.empty((0, 4)) for _ in some]
            if not touched:
                middle = np.array([(x0 + x1) / 2]), np.array([(y0 + y1) / 2])
                if not covers(right[0], *middle)[0] or any(covers(r, *middle)[0] for r in right[1:]):
                    continue
                yield bx, by, [[] for _ in parts], [[] for _ in parts]
            else:
                yield bx, by, [e.ravel().tolist() for e in near], [e.ravel().tolist() for e in right]


Parts = list[np.ndarray]


def inside(near: Parts, band: Parts, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points of a square lie in a piece's ring or on it, and neither in a hole nor on its rim."""
    if not any(map(len, near)):  # the square lies wholly inside
        return np.ones(len(x), bool)
    each = [covers(b, x, y) | touches(n, x, y) for n, b in zip(near, band, strict=True)]
    return each[0] & ~np.any(each[1:], axis=0) if each[1:] else each[0]


def refined(joined: DataFrame, keep: Sequence[str], numbers: Sequence[str], test: Callable[..., dict[str, np.ndarray] | None], schema: str) -> DataFrame:
    """keep + what `test` makes of each row: of the number columns (arrays give arrays), its reach, and its edges near by and in the band.

    `test(values, reach, near, band)` returns columns of equal length, a row each, or None for no row.
    """
    names = [f.split()[0].strip("`") for f in schema.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, made = [], []
            columns = [b.column(c).to_pylist() for c in numbers]
            parts = [[[np.array(e, float).reshape(-1, 4) for e in p] for p in b.column(c).to_pylist()] for c in ("near", "band")]
            for i, reach in enumerate(b.column("reach__").to_pylist()):
                got = test({c: v[i] for c, v in zip(numbers, columns, strict=True)}, reach, parts[0][i], parts[1][i])
                if got is not None:
                    kept += [i] * len(got[names[0]])
                    made.append(got)
            like = {c: b.column(c).take(pa.array(kept, pa.int64())) for c in keep}
            yield pa.RecordBatch.from_pydict(like | {c: pa.array(np.concatenate([m[c] for m in made]) if made else []).cast(shape) for c, shape in zip(names, shapes, strict=True)})

    shapes = [{"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[f.split()[1]] for f in schema.split(", ")]
    return joined.mapInArrow(kernel, f"{kinds(joined, keep)}, {schema}")


def met(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What lies in squares joined with the squares' pieces, dealt by square into all shuffle partitions: few bytes may be much work,
    so the planner is not to join partitions by their size."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(n, *keys).join(right.repartition(n, *keys), list(keys))


#: What a row of `grouped` holds about at most.
GROUP_ROWS = 256


def grouped(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """keys + an array of each of `names`: the rows of a key, those of a crowded one over many groups by their hash."""
    many = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).alias("groups__"))
    dealt = rows.join(many, list(keys)).withColumn("group__", F.pmod(F.xxhash64(*names), F.col("groups__")))
    each = dealt.groupBy(*keys, "group__").agg(F.collect_list(F.struct(*names)).alias("all__"))
    return each.select(*keys, *[F.col(f"all__.{c}").alias(c) for c in names])


#: What a row of `crowds` holds about at most: rows of a square, and edges of its pieces.
CROWD_ROWS, CHUNK_EDGES = 1024, 4096


def crowds(rows: DataFrame, of: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(at__, an array of each of `names`, pieces__): groups of a square's rows with chunks of its pieces `of`, for what one piece can settle.

    A row of the join holds many pieces, so that what an earlier one settles need not meet the later ones. Groups are dealt to tasks each by
    itself: a crowded square is no longer task than others. at__ has the keys.
    """
    at, n = F.struct(*keys).alias("at__"), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given, pieces = rows.select(at, *names), cut(of.select(at, F.struct("reach__", "near", "band").alias("piece__")))
    counts = cut(given.groupBy("at__").agg(F.count(F.lit(1)).alias("n__")))
    groups = counts.select("at__", F.ceil(F.col("n__") / CROWD_ROWS).alias("groups__"))
    dealt = salted_join(given, groups, "at__", counts, cells=True).withColumn("group__", F.pmod(F.xxhash64(*names), F.col("groups__")))
    each = dealt.groupBy("at__", "group__").agg(F.collect_list(F.struct(*names)).alias("all__")).select("at__", "group__", *[F.col(f"all__.{c}").alias(c) for c in names])

    edges = sum((F.aggregate(f"piece__.{c}", F.lit(0), lambda t, e: t + F.size(e)) for c in ("near", "band")), F.lit(4)) / 4
    held = pieces.groupBy("at__").agg(F.ceil(F.sum(edges) / CHUNK_EDGES).alias("chunks__"))
    chunks = pieces.join(apart(held), "at__").withColumn("chunk__", F.pmod(F.xxhash64("piece__"), F.col("chunks__"))).groupBy("at__", "chunk__").agg(F.collect_list("piece__").alias("pieces__"))
    asked = chunks.join(apart(groups), "at__").select("at__", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups__") - 1)).alias("group__"), "pieces__")
    return each.repartition(n, "at__", "group__").join(apart(asked.repartition(n, "at__", "group__")), ["at__", "group__"])


def settled(joined: DataFrame, keep: Sequence[str], name: str, numbers: Sequence[str], test: Callable[..., np.ndarray]) -> DataFrame:
    """keep + name: of the rows in `crowds` those that `test(values, pieces)` tells; values are arrays of `numbers` and the square's bx and by,
    pieces tuples (reach, near, band)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("at__")
            for i in range(b.num_rows):
                values = {c: b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in numbers}
                pieces = [(p["reach__"], *([np.array(e, float).reshape(-1, 4) for e in p[c]] for c in ("near", "band"))) for p in b.column("pieces__")[i].as_py()]
                found = test(values | {c: at.field(c)[i].as_py() for c in ("bx", "by")}, pieces)
                if found.any():
                    ids = b.column(name)[i].values.filter(pa.array(found))
                    yield pa.RecordBatch.from_pydict({c: at.field(c).take(pa.array(np.full(len(ids), i))) for c in keep} | {name: ids})

    types = dict(joined.select("at__.*", F.col(name).getItem(0).alias(name)).dtypes)
    return joined.mapInArrow(kernel, ", ".join(f"`{c}` {types[c]}" for c in [*keep, name]))


def cell_squares(cells: DataFrame, keys: Sequence[str], side: float) -> DataFrame:
    """keys + (bx, by, rows, cols, xs, ys): the cells of each square as arrays; a square holds as many as the resolution allows."""
    at = cells.withColumns({"bx": F.floor(F.col("x") / side).cast("long"), "by": F.floor(F.col("y") / side).cast("long")})
    each = at.groupBy(*keys, "bx", "by").agg(F.collect_list(F.struct(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("c"))
    return each.select(*keys, "bx", "by", F.col("c.row").alias("rows"), F.col("c.col").alias("cols"), F.col("c.x").alias("xs"), F.col("c.y").alias("ys"))

"""Depressions over blocks of cells: each block is flooded once, a graph of spill heights joins what the blocks found.

A flood starts at a block's outlets and, as if water left there, at its cells beside other blocks; each other cell gets the label of the start
that its water reaches. Labels with the least heights at which they spill into each other make a graph with one row for a pair,
far smaller than the raster. The least highest spill on a label's way to an outlet, its bottleneck, then raises the label's cells.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainfold.operators import blocks, graph
from rainfold.operators.raster import DIRECTIONS
from rainfold.plans.store import cut

HIGH = float("inf")
OUTLET, NONE = -2, -1

#: Pairs of labels of a survey up to which a single task finds its bottlenecks; beyond, rounds over rows do.
TASK_SPILLS = 500_000

LABELS = "level double, lrow bigint, lcol bigint, spills array<struct<xr:bigint,xc:bigint,yr:bigint,yc:bigint,h:double>>"


def flooded(block: pa.Table, number: np.ndarray) -> pa.Table:
    """The cells (row, col, z__, outlet, shared) of blocks with these numbers + level, the label's start cell (lrow, lcol), null for water that reaches an outlet, and spills.

    `spills`, on each block's first row alone, are the labels that touch and the least height between them; y is null for outlets.
    """
    row, col = (block.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
    outlet, shared = (block.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("outlet", "shared"))
    z = block.column("z__").to_numpy(zero_copy_only=False)
    spot, wide, size = blocks.stacked(row, col, number)
    place = np.full(size, -1)
    place[spot] = np.arange(len(row))
    starts = outlet | shared
    at, spots, heights = place.tolist(), spot.tolist(), z.tolist()
    level, label, queued = np.where(starts, z, HIGH).tolist(), np.where(outlet, OUTLET, NONE).tolist(), starts.tolist()
    steps, of = {w: [dr * w + dc for _, dr, dc in DIRECTIONS] for w in np.unique(wide).tolist()}, wide.tolist()
    heap = [(level[i], i) for i in np.flatnonzero(starts).tolist()]
    heapq.heapify(heap)
    while heap:
        v, i = heapq.heappop(heap)
        if label[i] == NONE:
            label[i] = i
        mine, here = label[i], spots[i]
        for step in steps[of[i]]:
            n = at[here + step]
            if n < 0 or label[n] != NONE:
                continue
            label[n] = mine
            if not queued[n]:
                queued[n] = True
                level[n] = heights[n] if heights[n] > v else v
                heapq.heappush(heap, (level[n], n))
    label, level = np.array(label, np.int64), np.array(level, float)
    low, high, h = [], [], []
    for step in (1, wide - 1, wide, wide + 1):
        i = np.arange(len(row))
        n = place[spot + step]
        two = (n >= 0) & (label != label[n]) & (label != NONE) & (label[n] != NONE)
        i, n = i[two], n[two]
        low.append(np.minimum(label[i], label[n]))
        high.append(np.maximum(label[i], label[n]))
        h.append(np.maximum(level[i], level[n]))
    low, high, h = np.concatenate(low), np.concatenate(high), np.concatenate(h)
    # labels are places of cells, so they tell blocks apart; OUTLET is one for all, but high is a label where low is not
    order = np.lexsort((h, high, low))
    low, high, h = low[order], high[order], h[order]
    first = np.ones(len(low), bool)
    first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    x, y, h = high[first], low[first], h[first]
    _, heads, own = np.unique(number, return_index=True, return_inverse=True)
    near = np.argsort(heads[own[x]], kind="stable")  # a block's spills lie on its first row
    x, y, h = x[near], y[near], h[near]

    def start(of: np.ndarray, line: np.ndarray) -> pa.Array:
        return pa.array(line[np.maximum(of, 0)] if len(of) else np.zeros(0, np.int64), pa.int64(), mask=of < 0)

    pairs = pa.StructArray.from_arrays([start(x, row), start(x, col), start(y, row), start(y, col), pa.array(h)], ["xr", "xc", "yr", "yc", "h"])
    ends = np.zeros(len(row) + 1, np.int64)
    np.add.at(ends, 1 + heads[own[x]], 1)
    ends = np.cumsum(ends)
    made = block.append_column("level", pa.array(level)).append_column("lrow", start(label, row)).append_column("lcol", start(label, col))
    return made.append_column("spills", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs))


def bottlenecks_of(spills: pa.Table, survey: np.ndarray) -> pa.Table:
    """(survey, row, col, least): the least highest spill between each label of surveys with these numbers and an outlet; none for labels without a way."""
    number: dict[tuple, int] = {}
    ends = [[number.setdefault(k, len(number)) if k[1] is not None else -1 for k in zip(survey.tolist(), *(spills.column(c).to_pylist() for c in names))] for names in (("xr", "xc"), ("yr", "yc"))]
    ways: list[list[tuple[float, int]]] = [[] for _ in number]
    heap = []
    for x, y, h in zip(*ends, spills.column("h").to_pylist()):
        for a, b in ((x, y), (y, x)):
            if a >= 0 and b >= 0:
                ways[a].append((h, b))
            elif a >= 0:
                heap.append((h, a))
    heapq.heapify(heap)
    least = [HIGH] * len(number)
    while heap:
        v, a = heapq.heappop(heap)
        if v < least[a]:
            least[a] = v
            for h, b in ways[a]:
                if max(h, v) < least[b]:
                    heapq.heappush(heap, (max(h, v), b))
    rows, cols = ([k[j] for k in number] for j in (1, 2))
    first = dict(zip(*np.unique(survey, return_index=True)))
    of = spills.column("survey").combine_chunks().take(pa.array([first[k[0]] for k in number], pa.int64()))
    return pa.table({"survey": of, "row": pa.array(rows, pa.int64()), "col": pa.array(cols, pa.int64()), "least": pa.array(least, pa.float64())})


def bottlenecks(spills: DataFrame) -> DataFrame:
    """(label, least) of spills (x, y, h), y null for outlets: the least highest spill between a label and an outlet, by rounds over rows.

    Each round every part takes its lowest spill, before all one to an outlet. That height bounds all its labels from below, and on a way of
    such choices heights never rise, so a label's bottleneck is the highest choice of the parts it was in. Parts that choose each
    other become one; those whose choices end at an outlet are done. The number of parts at least halves.
    """
    both = spills.select("x", "y", "h").unionByName(spills.where("y IS NOT NULL").select(F.col("y").alias("x"), F.col("x").alias("y"), "h"))
    edges = cut(both.where("x IS NOT NULL").groupBy("x", "y").agg(F.min("h").alias("h")))
    names = edges.select(F.col("x").alias("label"), F.col("x").alias("part"), F.lit(-HIGH).alias("least"), F.lit(False).alias("done")).distinct()
    while not edges.isEmpty():
        choice = F.min(F.struct("h", F.col("y").isNotNull().alias("inner"), F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high"), "y"))
        picks = cut(edges.groupBy("x").agg(choice.alias("pick")).select("x", "pick.h", "pick.y"))
        joined = graph.components(picks.where("y IS NOT NULL"), "x", "y").withColumnsRenamed({"node": "x", "component": "to"})
        moves = picks.join(joined, "x", "left").withColumn("to", F.coalesce("to", "x"))
        over = moves.groupBy("to").agg(F.bool_or(F.col("y").isNull()).alias("over"))
        moves = cut(moves.join(over, "to").select(F.col("x").alias("part"), F.col("h").alias("raise"), "to", "over"))
        names = cut(names.join(moves, "part", "left").select("label", F.coalesce("to", "part").alias("part"), F.greatest("least", "raise").alias("least"), (F.col("done") | F.coalesce("over", F.lit(False))).alias("done")))
        of_x = moves.where("NOT over").select(F.col("part").alias("x"), F.col("to").alias("x2"))
        of_y = moves.select(F.col("part").alias("y"), F.col("to").alias("y2"), "over")
        inner = edges.where("y IS NOT NULL").join(of_x, "x").join(of_y, "y").select(F.col("x2").alias("x"), F.when(~F.col("over"), F.col("y2")).alias("y"), "h")
        outer = edges.where("y IS NULL").join(of_x, "x").select(F.col("x2").alias("x"), "y", "h")
        left = inner.unionByName(outer).where(F.col("y").isNull() | (F.col("x") != F.col("y")))
        edges = cut(left.groupBy("x", "y").agg(F.min("h").alias("h")))
    return names.select("label", F.when(F.col("done"), F.col("least")).otherwise(F.lit(HIGH)).alias("least"))


def label_levels(spills: DataFrame, most: int | None = None) -> DataFrame:
    """(survey, row, col, least) of spills (survey, xr, xc, yr, yc, h): small surveys a task each, larger ones by `bottlenecks`."""
    counts = spills.groupBy("survey").agg(F.count(F.lit(1)).alias("n__"))
    sized = cut(spills.join(counts.withColumnRenamed("survey", "of__"), F.col("survey").eqNullSafe(F.col("of__"))).drop("of__"))
    few = F.col("n__") <= (TASK_SPILLS if most is None else most)
    kind = dict(spills.dtypes)["survey"]
    small, many = sized.where(few).drop("n__"), sized.where(~few)
    made = blocks.apply(small, ["survey"], small.count(), bottlenecks_of, f"survey {kind}, row bigint, col bigint, least double")
    if many.isEmpty():
        return made
    x, y = (F.struct("survey", F.col(f"{c}r").alias("row"), F.col(f"{c}c").alias("col")) for c in "xy")
    found = bottlenecks(many.select(x.alias("x"), F.when(F.col("yr").isNotNull(), y).alias("y"), "h"))
    return made.unionByName(found.select("label.*", "least"))


def raised(cells: DataFrame, side: int, count: int) -> DataFrame:
    """cells (survey, row, col, z__, outlet, bounds of with_bounds, more) + level, bounds and z__ left out.

    z__ is minus infinity and `outlet` true where water leaves freely. All `count` cells are flooded by blocks, see `blocks`, with the result
    written, and go through one join with the labels' levels, whatever the number of blocks a drain path crosses.
    """
    line = lambda c: F.floor(F.col(c) / side).cast("long")
    edge = lambda c: ((F.pmod(F.col(c), F.lit(side)) == 0) & (F.col(c) > F.col(f"first_{c[0]}__"))) | ((F.pmod(F.col(c), F.lit(side)) == side - 1) & (F.col(c) < F.col(f"last_{c[0]}__")))
    dealt = cells.withColumns({"shared": edge("row") | edge("col"), "br__": line("row"), "bc__": line("col")}).drop("first_r__", "last_r__", "first_c__", "last_c__")
    shape = ", ".join(f"`{c}` {k}" for c, k in dealt.dtypes) + ", " + LABELS
    local = cut(blocks.apply(dealt, ["survey", "br__", "bc__"], count, flooded, shape))
    within = local.where("size(spills) > 0").select("survey", F.explode("spills").alias("s")).select("survey", "s.*")
    rim = local.where("shared").select("survey", "row", "col", "br__", "bc__", "level", "lrow", "lcol")
    step = F.explode(F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    asked = rim.select("survey", "br__", "bc__", "level", F.col("lrow").alias("xr"), F.col("lcol").alias("xc"), step.alias("n"))
    beyond = asked.where((line("n.row") != F.col("br__")) | (line("n.col") != F.col("bc__"))).select("survey", F.col("n.row").alias("row"), F.col("n.col").alias("col"), "level", "xr", "xc")
    other = rim.select("survey", "row", "col", F.col("level").alias("level2"), F.col("lrow").alias("yr"), F.col("lcol").alias("yc"))
    across = blocks.joined(beyond, other, ("survey", "row", "col"), count).select("survey", "xr", "xc", "yr", "yc", F.greatest("level", "level2").alias("h"))
    # between two blocks, too, only the lowest spill of a pair of labels counts; x is a label where one of both is
    turned = within.unionByName(across).where("xr IS NOT NULL OR yr IS NOT NULL")
    swap: Column = F.col("xr").isNull() | (F.struct("yr", "yc") > F.struct("xr", "xc"))
    pairs = turned.select("survey", *[F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("xr", "yr"), ("xc", "yc"), ("yr", "xr"), ("yc", "xc"))], "h")
    spills = cut(pairs.groupBy("survey", "xr", "xc", "yr", "yc").agg(F.min("h").alias("h")))
    kept = local.drop("spills", "shared", "z__", "outlet")
    if spills.isEmpty():
        return kept.drop("br__", "bc__", "lrow", "lcol")
    least = label_levels(spills).withColumnsRenamed({"row": "lrow", "col": "lcol"})
    free = kept.where("lrow IS NULL").drop("lrow", "lcol")  # reaches an outlet within its block
    held = blocks.joined(kept.where("lrow IS NOT NULL"), least, ("survey", "lrow", "lcol"), count, "left").withColumn("level", F.greatest("level", "least")).drop("least", "lrow", "lcol")
    return free.unionByName(held).drop("br__", "bc__")

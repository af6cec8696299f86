"""Forests and graphs over rows: subtree sizes, ancestors, connected components, all in a logarithm of rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainfold.operators import blocks
from rainfold.plans.store import apart, cut


def _pointers(edges: DataFrame, keys: list[str], node: str, receiver: str, *columns: Column) -> DataFrame:
    """(at, up, ...): nodes as structs of keys and node; up is null at the end of a path."""
    up = F.when(F.col(receiver) != F.col(node), F.struct(*keys, F.col(receiver).alias("node")))
    return cut(edges.select(F.struct(*keys, F.col(node).alias("node")).alias("at"), up.alias("up"), *columns))


def _onward(live: DataFrame, values: DataFrame) -> DataFrame:
    """Rows with an `up` + what `values` (up, next, ...) hold for it; on long rivers most rows ask for few nodes, so these are salted."""
    counts = cut(live.groupBy("up").agg(F.count(F.lit(1)).alias("n__")))
    return salted_join(live, values, "up", counts, "left", cells=True)


def subtree_sums(edges: DataFrame, keys: list[str], node: str, receiver: str, weight: Column) -> DataFrame:
    """keys + (node, total): the weights of a node and of everything that drains to it.

    Pointer doubling: after round k a node holds the sum over what lies less than 2**k steps above it and knows its
    2**k-th receiver. Rounds are the logarithm of the longest path; a row left after the logarithm of all rows is on a cycle.
    A node without a receiver has null or itself as one.
    """
    now = _pointers(edges, keys, node, receiver, weight.alias("total"))
    for _ in range(now.count().bit_length() + 1):
        live = now.where(F.col("up").isNotNull())
        if live.isEmpty():
            return now.select("at.*", "total")
        given = live.groupBy(F.col("up").alias("at")).agg(F.sum("total").alias("more"))
        moved = _onward(live, now.select(F.col("at").alias("up"), F.col("up").alias("next"))).select("at", F.col("next").alias("up"), "total")
        both = moved.unionByName(now.where(F.col("up").isNull()))
        now = cut(both.join(apart(given), "at", "left").select("at", "up", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")))
    raise ValueError("the receivers form a cycle")


def ring_order(step: DataFrame, keys: list[str], node: str, onward: str) -> DataFrame:
    """keys + (node, place): the place of each node of closed rings, 0 at the least node; `step` has keys, a ring each, node and the next.

    The ring is opened at its least node and pointers double: a node knows how many steps on the 2**k-th one lies.
    """
    least = step.groupBy(*keys).agg(F.min(node).alias("least__"))
    opened = step.join(apart(least), keys)
    now = cut(opened.select(*keys, F.col(node).alias("node"), F.when(F.col(onward) != F.col("least__"), F.col(onward)).alias("up"), F.lit(0).cast("long").alias("left")).withColumn("left", F.when(F.col("up").isNotNull(), F.lit(1)).otherwise(0).cast("long")))
    for _ in range(now.count().bit_length() + 1):
        if now.where(F.col("up").isNotNull()).isEmpty():
            last = now.groupBy(*keys).agg(F.max("left").alias("most__"))
            return now.join(apart(last), keys).select(*keys, "node", (F.col("most__") - F.col("left")).alias("place"))
        further = now.select(*keys, F.col("node").alias("up"), F.col("up").alias("next"), F.col("left").alias("more"))
        now = cut(now.join(apart(further), [*keys, "up"], "left").select(*keys, "node", F.col("next").alias("up"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    raise ValueError("the steps are no closed rings")


def marks_ahead(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (node, met): of rows keys + (node, up, met), up null at an end, the union of the arrays `met` on each node's path."""
    now = _pointers(edges, keys, "node", "up", F.col("met"))
    for _ in range(now.count().bit_length() + 1):
        live = now.where(F.col("up").isNotNull())
        if live.isEmpty():
            return now.select("at.*", "met")
        values = now.select(F.col("at").alias("up"), F.col("up").alias("next"), F.col("met").alias("further"))
        moved = _onward(live, values).select("at", F.col("next").alias("up"), F.array_union("met", F.coalesce("further", F.array().cast(now.schema["met"].dataType))).alias("met"))
        now = cut(moved.unionByName(now.where(F.col("up").isNull())))
    raise ValueError("the receivers form a cycle")


def path_sums(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (node, step, last): of rows keys + (node, up, step, last), up null at an end, the sum of `step` on each node's path and the `last` of its end."""
    now = _pointers(edges, keys, "node", "up", F.col("step"), F.col("last"))
    for _ in range(now.count().bit_length() + 1):
        live = now.where(F.col("up").isNotNull())
        if live.isEmpty():
            return now.select("at.*", "step", "last")
        values = now.select(F.col("at").alias("up"), F.col("up").alias("next"), F.col("step").alias("more"), F.col("last").alias("further"))
        moved = _onward(live, values).select("at", F.col("next").alias("up"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"), F.coalesce("further", "last").alias("last"))
        now = cut(moved.unionByName(now.where(F.col("up").isNull())))
    raise ValueError("the receivers form a cycle")


#: Rows of one key from which on the key is salted; it also has to hold a hundredth of all rows, so there are a hundred such keys at most.
HEAVY_ROWS = 1000
#: Rows up to which the planner may take a table of cells for small by its files.
FEW_ROWS = 100_000


def salted_join(rows: DataFrame, values: DataFrame, key: str, counts: DataFrame, how: str = "inner", cells: bool = False) -> DataFrame:
    """rows joined with `values`, of which each key has few; `counts` are (key, n__): about how many of `rows` have a key.

    Rows of heavy keys are dealt over salts by their hash and meet a copy of the key's value in each, so no task gets all
    rows of one key. `counts` is read by a job of its own and so should be cheap. With `cells` the values of many rows are never
    broadcast, see `apart`.
    """
    most, total = counts.agg(F.max("n__"), F.sum("n__")).first()
    limit, many = max(HEAVY_ROWS, int(total or 0) // 100), cells and int(total or 0) > FEW_ROWS
    if int(most or 0) <= limit:
        return rows.join(apart(values) if many else values, key, how)
    salts = 2 * -(-int(most) // limit)
    heavy = F.broadcast(counts.where(F.col("n__") > limit).select(key, F.lit(True).alias("heavy__")))  # 100 rows at most
    every = F.when(F.col("heavy__"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = values.join(heavy, key, "left").withColumn("salt__", F.explode(every)).drop("heavy__")
    salt = F.when(F.col("heavy__"), F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).otherwise(0)
    dealt = rows.join(heavy, key, "left").withColumn("salt__", salt).drop("heavy__")
    return dealt.join(apart(spread) if many else spread, [key, "salt__"], how).drop("salt__")


def _degrees(pairs: DataFrame, rows: int) -> DataFrame:
    """(u, m, n__): the least v of each u and how many it has."""
    return cut(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n__")), rows)


def _with_least(pairs: DataFrame, degrees: DataFrame) -> DataFrame:
    """pairs (u, v) + m, hubs spread over tasks."""
    return salted_join(pairs, degrees.select("u", "m"), "u", degrees.select("u", "n__"), cells=True)


def components(edges: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """(node, component): the least node that a node is connected with; large-star and small-star steps until all are stars."""
    now = cut(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u > v").distinct())
    rows = 2 * now.count()  # no step makes more edges than there were, either way
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        degrees = _degrees(both, rows)
        # in stars each node has one neighbour, a lesser one, or none that is lesser
        if degrees.where("m < u AND n__ > 1").isEmpty():
            break
        large = cut(_with_least(both, degrees).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), rows)
        pairs = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        now = cut(_with_least(large, _degrees(large, rows)).select(F.explode(pairs).alias("e")).select("e.*").where("u > v").distinct(), rows)
    node = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return node.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Steps that a block of `rings` has about at most.
RING_STEPS = 50_000


def chains(block: pa.Table) -> pa.Table:
    """(head, onward, nodes): the longest paths within a block of steps x -> y; onward is the step that a path leaves the block by, null for a ring."""
    x, y = (block.column(c).combine_chunks() for c in ("x", "y"))
    names, follow = (pa.table({"d": c}).flatten() for c in (x, y))
    while any(pa.types.is_struct(t) for t in names.schema.types):
        names, follow = names.flatten(), follow.flatten()
    names, follow = blocks.numbers([names, follow], names.column_names)
    place = np.full(max(names.max(initial=-1), follow.max(initial=-1)) + 1, -1)
    place[names] = np.arange(len(names))
    onward = place[follow].tolist()
    starts = [True] * len(names)
    for i in onward:
        if i >= 0:
            starts[i] = False
    order = [*(i for i, s in enumerate(starts) if s), *(i for i, s in enumerate(starts) if not s)]  # what is left after paths are rings
    flat: list[int] = []
    heads, lasts, ends, seen = [], [], [0], [False] * len(names)
    for head in order:
        if not seen[head]:
            at = head
            while at >= 0 and not seen[at]:
                seen[at] = True
                flat.append(at)
                at = onward[at]
            heads.append(head)
            lasts.append(None if at == head else flat[-1])
            ends.append(len(flat))
    nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x.take(pa.array(flat, pa.int64())))
    return pa.table({"head": x.take(pa.array(heads, pa.int64())), "onward": y.take(pa.array(lasts, pa.int64())), "nodes": nodes})


def rings(step: DataFrame, keys: list[str], px: str, py: str) -> DataFrame:
    """(nodes ARRAY): the closed rings of steps (x, y), each from its least node on; x and y are structs with the fields keys, px and py.

    Two levels: steps are dealt by the place of x into blocks, and a task joins those of a block to paths. Rings within a block are done;
    of others only one row for each path is left, whose order comes from components and doubling pointers.
    """
    at = step.select("x", "y", F.struct(*[F.col(f"x.{k}").alias(k) for k in keys]).alias("k__"), F.col(f"x.{px}").cast("double").alias("px__"), F.col(f"x.{py}").cast("double").alias("py__"))
    sides = F.ceil(F.sqrt(F.count(F.lit(1)) / F.lit(RING_STEPS))).cast("int")
    extent = at.groupBy("k__").agg(*[f(p).alias(f"{n}{p}") for p in ("px__", "py__") for n, f in (("low", F.min), ("high", F.max))], sides.alias("blocks__"))
    dealt = at.join(apart(extent.withColumnRenamed("k__", "of__")), F.col("k__") == F.col("of__"))
    for p in ("px__", "py__"):
        dealt = dealt.withColumn(f"b{p}", F.floor((F.col(p) - F.col(f"low{p}")) / F.greatest(F.col(f"high{p}") - F.col(f"low{p}"), F.lit(1e-12)) * F.col("blocks__") * 0.999999).cast("int"))
    few = max(int(step.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-step.count() // RING_STEPS))
    group = F.when(F.col("blocks__") == 1, F.pmod(F.xxhash64("k__"), F.lit(few))).otherwise(F.xxhash64("k__", "bpx__", "bpy__"))  # small keys share blocks
    kind = step.schema["x"].dataType.simpleString()
    paths = cut(dealt.select(group.alias("group__"), "x", "y").groupBy("group__").applyInArrow(chains, f"head {kind}, onward {kind}, nodes array<{kind}>"))
    whole = paths.where("onward IS NULL").select("nodes")
    open_ = paths.where("onward IS NOT NULL")
    if not open_.isEmpty():
        links = open_.select(F.col("head").alias("x"), F.col("onward").alias("y"))
        named = components(links).select("node", F.col("component").alias("ring"))
        order = ring_order(cut(links.join(apart(named), F.col("x") == F.col("node")).select("ring", "x", "y")), ["ring"], "x", "y")
        parts = order.join(apart(open_), F.col("node") == F.col("head")).groupBy("ring").agg(F.sort_array(F.collect_list(F.struct("place", "nodes"))).alias("parts"))
        whole = whole.unionByName(parts.select(F.flatten("parts.nodes").alias("nodes")))
    least = whole.select("nodes", F.array_position("nodes", F.array_min("nodes")).cast("int").alias("from__"))
    return cut(least.select(F.concat(F.slice("nodes", F.col("from__"), F.size("nodes")), F.slice("nodes", F.lit(1), F.col("from__") - 1)).alias("nodes")))


def labelled(block: pa.Table, number: np.ndarray, diagonal: bool) -> pa.Table:
    """The cells of blocks with these numbers with the least cell of their connected part within their block."""
    row, col = (block.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
    order = np.lexsort((col, row, number))
    row, col, number = row[order], col[order], number[order]
    start = np.ones(len(row), bool)  # runs of cells in a row
    start[1:] = (number[1:] != number[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)
    run = np.cumsum(start) - 1
    first = np.flatnonzero(start)
    last = np.append(first[1:], len(row)) - 1
    up = list(range(len(first)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    low = int(row.min()) if len(row) else 0
    rows = (number * (int(row.max()) - low + 3) + row - low if len(row) else row)[first].tolist()  # blocks one behind the other
    begin, end = col[first].tolist(), col[last].tolist()
    reach, below = int(diagonal), 0
    for i, r in enumerate(rows):
        while rows[below] < r - 1 or (rows[below] == r - 1 and end[below] < begin[i] - reach):
            below += 1
        k = below
        while k < i and rows[k] == r - 1 and begin[k] <= end[i] + reach:
            a, b = root(i), root(k)
            up[max(a, b)] = min(a, b)
            k += 1
    least = first[np.array([root(i) for i in range(len(up))], int)][run] if len(row) else first
    return block.take(pa.array(order)).append_column("crow", pa.array(row[least], pa.int64())).append_column("ccol", pa.array(col[least], pa.int64()))


def grid_components(cells: DataFrame, diagonal: bool, side: int = 512) -> DataFrame:
    """(survey, row, col, crow, ccol) of distinct cells (survey, row, col): the least cell of the part of the raster they lie in.

    Two levels: a task labels a block of `side` by `side` cells; only pairs of labels across the borders of blocks go into a
    search of components. Cells touch by their sides, with `diagonal` also at corners.
    """
    kind = dict(cells.dtypes)["survey"]
    dealt = cells.select("survey", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    dealt = dealt.withColumns({"br__": F.floor(F.col("row") / side).cast("long"), "bc__": F.floor(F.col("col") / side).cast("long")})
    local = cut(blocks.apply(dealt, ["survey", "br__", "bc__"], cells.count(), lambda t, number: labelled(t, number, diagonal), f"survey {kind}, row bigint, col bigint, br__ bigint, bc__ bigint, crow bigint, ccol bigint"))
    label = F.struct("survey", "crow", "ccol")
    rim = local.where(F.pmod("row", F.lit(side)).isin(0, side - 1) | F.pmod("col", F.lit(side)).isin(0, side - 1)).withColumn("label", label)
    moves = [(0, 1), (1, 0), (1, 1), (1, -1)] if diagonal else [(0, 1), (1, 0)]
    onward = F.explode(F.array(*[F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col")) for r, c in moves]))
    asked = rim.select("survey", F.col("label").alias("x"), onward.alias("n")).select("survey", "x", "n.row", "n.col")
    pairs = cut(asked.join(apart(rim.select("survey", "row", "col", F.col("label").alias("y"))), ["survey", "row", "col"]).where("x <> y").select("x", "y").distinct())
    local = local.drop("br__", "bc__")
    if pairs.isEmpty():
        return local
    joined = components(pairs).select(F.col("node.survey").alias("survey"), F.col("node.crow").alias("crow"), F.col("node.ccol").alias("ccol"), F.col("component.crow").alias("r__"), F.col("component.ccol").alias("c__"))
    out = local.join(apart(joined), ["survey", "crow", "ccol"], "left")
    return out.select("survey", "row", "col", F.coalesce("r__", "crow").alias("crow"), F.coalesce("c__", "ccol").alias("ccol"))

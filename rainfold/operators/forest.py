"""Flow forests of rasters in two levels: a task resolves the paths within a block of cells, and only paths across blocks are joined.

A cell that takes water from another block is an entry. From it water runs on to the next entry, in the block that it leaves the first one
for, or ends. Entries with these steps are a forest of their own, with at most one node for a cell on a block's border; pointers double
over it alone, and a second task a block hands the results down to the cells. Cells need survey, row, col, node and receiver.

What crosses the blocks of a survey is few rows, so a survey of up to `TASK_CROSSINGS` of them is joined by one task, many small surveys by
the same one; rounds over rows are left for larger surveys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from rainfold.operators import blocks, graph
from rainfold.plans.store import apart, cut

ENDS, LEAVES = -2, -1
BLOCK = ("survey", "br__", "bc__")

#: Rows on blocks' borders of a survey up to which a single task follows what crosses them; beyond, rounds over rows do.
TASK_CROSSINGS = 250_000


def _dealt(cells: DataFrame, side: int) -> DataFrame:
    return cells.withColumns({b: F.floor(F.col(c) / side).cast("long") for c, b in (("row", "br__"), ("col", "bc__"))})


def _keys(block: pa.Table, number: np.ndarray, more: pa.Table | None = None, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Numbers that tell cells of all blocks of a call apart: of a block's nodes, of their receivers if these lie in the same block, and of the nodes of `more`."""
    node, receiver = (block.column(c).to_numpy().astype(np.int64) for c in ("node", "receiver"))
    named = more.column("node").to_numpy().astype(np.int64) if more is not None else np.zeros(0, np.int64)
    every = np.concatenate([node, receiver, named, [0]])
    low, span = every.min(), every.max() - every.min() + 1
    return number * span + node - low, number * span + receiver - low, (of * span + named - low).tolist() if of is not None else []


def _downward(key: np.ndarray, receiver: np.ndarray) -> tuple[list[int], list[int]]:
    """Of cells and receivers by `_keys`: the place of each one's receiver in its block (ENDS: none, LEAVES: elsewhere), and an order from above to below without cells on cycles."""
    order = np.argsort(key, kind="stable")
    spot = np.minimum(np.searchsorted(key[order], receiver), len(key) - 1)
    onward = np.where(receiver == key, ENDS, np.where(key[order][spot] == receiver, order[spot], LEAVES))
    waits = np.bincount(onward[onward >= 0], minlength=len(key)).tolist()
    to, free = onward.tolist(), np.flatnonzero(np.array(waits) == 0).tolist()
    for i in free:  # grows while it is read
        n = to[i]
        if n >= 0:
            waits[n] -= 1
            if waits[n] == 0:
                free.append(n)
    return to, free


def _ends(receiver: list[int], to: list[int], order: list[int]) -> list[int | None]:
    """The cell of another block that each cell's water reaches first, None where it ends within the block."""
    out: list[int | None] = [None] * len(to)
    for i in reversed(order):
        out[i] = out[to[i]] if to[i] >= 0 else (receiver[i] if to[i] == LEAVES else None)
    return out


def _rim(block: pa.Table, to: list[int], order: list[int], side: int) -> tuple[pa.Table, np.ndarray]:
    """The cells on a block's border with where their water goes, those on cycles too, and their places."""
    cyclic = np.ones(len(to), bool)
    cyclic[np.array(order, np.int64)] = False
    lines = [np.isin(block.column(c).to_numpy().astype(np.int64) % side, (0, side - 1)) for c in ("row", "col")]
    keep = np.flatnonzero(lines[0] | lines[1] | cyclic)
    ends = _ends(block.column("receiver").to_pylist(), to, order)
    made = block.select([*BLOCK, "node", "receiver"]).take(pa.array(keep))
    made = made.append_column("leaves", pa.array([to[i] == LEAVES for i in keep], pa.bool_())).append_column("cyclic", pa.array(cyclic[keep]))
    return made.append_column("up", pa.array([ends[i] for i in keep], pa.int64())), keep


def _totals(block: pa.Table, inflow: dict[int, int], to: list[int], order: list[int], key: np.ndarray) -> list[int]:
    total = block.column("weight__").to_pylist()
    if inflow:
        for i, n in enumerate(key.tolist()):
            total[i] += inflow.get(n, 0)
    for i in order:
        if to[i] >= 0:
            total[to[i]] += total[i]
    return total


def _met(marks: pa.Table, named: list[int], key: np.ndarray, to: list[int], order: list[int]) -> list[frozenset]:
    """The marks on each cell's way, itself included; cells without marks of their own share the set below them."""
    own: dict[int, set] = {}
    for n, some in zip(named, marks.column("met").to_pylist()):
        own.setdefault(n, set()).update(some)
    out, none = [frozenset()] * len(to), frozenset()
    for i in reversed(order):
        below = out[to[i]] if to[i] >= 0 else none
        mine = own.get(int(key[i])) if own else None
        out[i] = below | mine if mine else below
    return out


def _joined(rows: DataFrame, values: DataFrame, key: str = "node") -> DataFrame:
    """rows + what `values` hold for their survey, which may be null, and key."""
    other = values.withColumnsRenamed({"survey": "s__", key: "k__"})
    return rows.join(apart(other), F.col("survey").eqNullSafe(F.col("s__")) & (F.col(key) == F.col("k__"))).drop("s__", "k__")


def _kinds(cells: DataFrame, *more: str) -> str:
    return ", ".join(f"`{c}` {k}" for c, k in cells.select(*BLOCK, "node", "receiver").dtypes) + ", leaves boolean, cyclic boolean, up bigint" + "".join(f", {m}" for m in more)


def _refuse_cycles(rows: DataFrame) -> None:
    if not rows.where("cyclic").isEmpty():
        raise ValueError("the receivers form a cycle")


def _sized(rows: DataFrame) -> tuple[DataFrame, int, DataFrame | None]:
    """rows of surveys that a task can hold, their number, and the rows of larger ones if there are any."""
    counts = rows.groupBy(F.col("survey").alias("of__")).agg(F.count(F.lit(1)).alias("n__"))
    most, total = counts.agg(F.max("n__"), F.sum("n__")).first()
    if (most or 0) <= TASK_CROSSINGS:
        return rows, total or 0, None
    sized = cut(rows.join(counts, F.col("survey").eqNullSafe(F.col("of__"))).drop("of__"))
    small = sized.where(F.col("n__") <= TASK_CROSSINGS).drop("n__")
    return small, small.count(), sized.where(F.col("n__") > TASK_CROSSINGS).drop("n__")


#: Stands for a missing node within tasks.
NO_NODE = np.iinfo(np.int64).min


def _nodes(rows: pa.Table, column: str) -> np.ndarray:
    return rows.column(column).cast(pa.int64()).fill_null(NO_NODE).to_numpy()


def _pairs(survey: np.ndarray, *nodes: np.ndarray) -> list[np.ndarray]:
    """Numbers that tell nodes of all surveys of a call apart, -1 for missing ones."""
    some = np.concatenate([*(n[n != NO_NODE] for n in nodes), [0]])
    low, span = int(some.min()), int(some.max()) - int(some.min()) + 1
    return [np.where(n == NO_NODE, -1, survey * span + n - low) for n in nodes]


def _spot(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The place of each asked number among known ones, -1 for those that are not there."""
    if not len(known):
        return np.full(len(asked), -1)
    order = np.argsort(known, kind="stable")
    at = order[np.minimum(np.searchsorted(known[order], asked), len(known) - 1)]
    return np.where(known[at] == asked, at, -1)


def _rounds(n: int) -> range:
    return range(n.bit_length() + 1)


def _entered(rim: pa.Table, survey: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows on borders: the places of entries, each one's next entry among these (-1: none), the places of rows that leave, and the entry each goes to."""
    key, to, up = _pairs(survey, *(_nodes(rim, c) for c in ("node", "receiver", "up")))
    leaves = np.flatnonzero(rim.column("leaves").to_numpy(zero_copy_only=False).astype(bool))
    entries = np.flatnonzero(np.isin(key, to[leaves]))
    return entries, _spot(key[entries], up[entries]), leaves, _spot(key[entries], to[leaves])


def _crossed_sums(rim: pa.Table, survey: np.ndarray) -> pa.Table:
    """(BLOCK, node, total, cyclic): what comes into the blocks of whole surveys at each entry, by doubled pointers."""
    entries, up, leaves, to = _entered(rim, survey)
    total = np.zeros(len(entries), np.int64)
    there = to >= 0
    np.add.at(total, to[there], rim.column("total").to_numpy()[leaves[there]])
    for _ in _rounds(len(up)):
        live = up >= 0
        if not live.any():
            break
        more = np.zeros(len(total), np.int64)
        np.add.at(more, up[live], total[live])
        total, up = total + more, np.where(live, up[up], -1)
    made = rim.select([*BLOCK, "node"]).take(pa.array(entries))
    return made.append_column("total", pa.array(total)).append_column("cyclic", pa.array(np.full(len(up), bool((up >= 0).any()))))


def _inflow(rim: DataFrame) -> DataFrame:
    """(BLOCK, node, total) of rows on borders with the sums of their blocks: what comes in at each entry, from all blocks above. Written."""
    small, count, large = _sized(rim)
    kinds = ", ".join(f"`{c}` {k}" for c, k in rim.select(*BLOCK, "node", "total").dtypes) + ", cyclic boolean"
    made = cut(blocks.apply(small, ["survey"], count, _crossed_sums, kinds))
    _refuse_cycles(made)
    made = made.drop("cyclic")
    if large is None:
        return made
    given = large.where("leaves").groupBy("survey", F.col("receiver").alias("node")).agg(F.sum("total").alias("total"))
    entries = cut(_joined(large.select(*BLOCK, "node", "up"), given))
    sums = graph.subtree_sums(entries, ["survey"], "node", "up", F.col("total"))
    return cut(made.unionByName(_joined(entries.select(*BLOCK, "node"), sums).select(*BLOCK, "node", "total")))


def _later_marks(rim: DataFrame) -> DataFrame:
    """(BLOCK, node, met) of rows on borders with the marks on their way within a block: for those that leave, the marks on their way beyond."""
    small, count, large = _sized(rim)
    kinds = ", ".join(f"`{c}` {k}" for c, k in rim.select(*BLOCK, "node", "met").dtypes) + ", cyclic boolean"
    many = to_arrow_type(rim.schema["met"].dataType)

    def follow(rows: pa.Table, survey: np.ndarray) -> pa.Table:
        entries, up, leaves, to = _entered(rows, survey)
        own = np.arange(len(entries))
        onward, order = _downward(own, np.where(up < 0, own, up))
        met: list[frozenset] = [frozenset(m) for m in rows.column("met").take(pa.array(entries)).to_pylist()]
        for i in reversed(order):
            if onward[i] >= 0 and met[onward[i]]:
                met[i] = met[i] | met[onward[i]] if met[i] else met[onward[i]]
        keep = [(n, e) for n, e in zip(leaves.tolist(), to.tolist()) if e >= 0 and met[e]]
        if len(order) < len(entries):  # what is in no order lies on a cycle
            keep = [(n, e) for n, e in zip(leaves.tolist(), to.tolist()) if e >= 0]
        made = rows.select([*BLOCK, "node"]).take(pa.array([n for n, _ in keep], pa.int64())).append_column("met", pa.array([list(met[e]) for _, e in keep], many))
        return made.append_column("cyclic", pa.array([len(order) < len(entries)] * len(keep), pa.bool_()))

    made = cut(blocks.apply(small, ["survey"], count, follow, kinds))
    _refuse_cycles(made)
    made = made.drop("cyclic")
    if large is None:
        return made
    asked = large.where("leaves").select("survey", F.col("receiver").alias("node")).distinct()
    entries = _joined(large, asked).select("survey", "node", "up", "met")
    found = graph.marks_ahead(entries, ["survey"]).select("survey", F.col("node").alias("receiver"), "met").where(F.size("met") > 0)
    return made.unionByName(_joined(large.where("leaves").select(*BLOCK, "node", "receiver"), found, "receiver").select(*BLOCK, "node", "met"))


def _handed_on(way: pa.Table, survey: np.ndarray) -> pa.Table:
    """(BLOCK, node, total, root): of whole surveys' rows as `tour` has them, for each that leaves a block its number in its tree and the tree's root."""
    key, to, end = _pairs(survey, *(_nodes(way, c) for c in ("node", "receiver", "end")))
    entry = way.column("entry").to_numpy(zero_copy_only=False).astype(bool)
    enters, leaves = np.flatnonzero(entry), np.flatnonzero(~entry)
    leaves = leaves[np.lexsort((key[leaves], to[leaves]))]  # neighbours of one cell by their nodes
    size = way.column("size").to_numpy()[leaves]
    before = np.cumsum(size) - size
    first = np.ones(len(leaves), bool)
    first[1:] = to[leaves][1:] != to[leaves][:-1]
    start = 1 + before - before[np.maximum.accumulate(np.where(first, np.arange(len(leaves)), 0))] if len(leaves) else before
    begun = _spot(key[leaves], end[enters])
    step = way.column("number").to_numpy()[enters] + (np.where(begun >= 0, start[begun], 0) if len(leaves) else 0)
    last, up = _nodes(way, "end")[enters], _spot(key[enters], to[enters])
    for _ in _rounds(len(up)):
        live = up >= 0
        if not live.any():
            break
        step, last, up = step + np.where(live, step[up], 0), np.where(live, last[up], last), np.where(live, up[up], -1)
    reached = _spot(key[enters], to[leaves])
    some = np.flatnonzero(reached >= 0)
    made = way.select([*BLOCK, "node"]).take(pa.array(leaves[some]))
    return made.append_column("total", pa.array((start[some] + step[reached[some]]).astype(np.int64))).append_column("root", pa.array(last[reached[some]].astype(np.int64)))


def _told(way: DataFrame) -> DataFrame:
    """What `_handed_on` gives for all surveys, larger ones by rounds over rows."""
    small, count, large = _sized(way)
    kinds = ", ".join(f"`{c}` {k}" for c, k in way.select(*BLOCK).dtypes) + ", node bigint, total bigint, root bigint"
    made = blocks.apply(small, ["survey"], count, _handed_on, kinds)
    if large is None:
        return made
    brothers = Window.partitionBy("survey", "receiver").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)  # neighbours of one cell
    starts = cut(large.where("NOT entry").withColumn("start", 1 + F.coalesce(F.sum("size").over(brothers), F.lit(0))).select(*BLOCK, "node", "receiver", "start"))
    begun = starts.select(F.col("survey").alias("s__"), F.col("node").alias("k__"), "start")
    placed = large.where("entry").join(apart(begun), F.col("survey").eqNullSafe(F.col("s__")) & (F.col("end") == F.col("k__")), "left")
    steps = placed.select("survey", "node", F.col("receiver").alias("up"), (F.col("number") + F.coalesce("start", F.lit(0))).alias("step"), F.col("end").alias("last"))
    reached = graph.path_sums(steps, ["survey"]).select("survey", F.col("node").alias("receiver"), "step", "last")
    return made.unionByName(_joined(starts, reached, "receiver").select(*BLOCK, "node", (F.col("start") + F.col("step")).alias("total"), F.col("last").alias("root")))


def accumulation(cells: DataFrame, weight: str, name: str, side: int = 512) -> DataFrame:
    """cells + the sum of `weight`, whole numbers, over a cell and everything that drains to it. A cycle raises a ValueError."""
    dealt, count = _dealt(cells.withColumn("weight__", F.col(weight).cast("long")), side), cells.count()

    def first(block: pa.Table, number: np.ndarray) -> pa.Table:
        key, receiver, _ = _keys(block, number)
        to, order = _downward(key, receiver)
        total = _totals(block, {}, to, order, key)
        made, keep = _rim(block, to, order, side)
        return made.append_column("total", pa.array([total[i] for i in keep], pa.int64()))

    slim = dealt.select(*BLOCK, "row", "col", "node", "receiver", "weight__")
    rim = cut(blocks.apply(slim, BLOCK, count, first, _kinds(slim, "total bigint")))
    _refuse_cycles(rim)
    inflow = _inflow(rim)

    def second(block: pa.Table, number: np.ndarray, more: pa.Table, of: np.ndarray) -> pa.Table:
        kept = block.drop_columns(["br__", "bc__", "weight__"])
        if not block.num_rows:
            return kept.append_column(name, pa.array([], pa.int64()))
        key, receiver, named = _keys(block, number, more, of)
        to, order = _downward(key, receiver)
        known = dict(zip(named, more.column("total").to_pylist()))
        return kept.append_column(name, pa.array(_totals(block, known, to, order, key), pa.int64()))

    shape = StructType([*cells.schema.fields, StructField(name, LongType())])
    return blocks.coapply(dealt, inflow, BLOCK, count, second, shape)


def marks_below(cells: DataFrame, targets: DataFrame, target: str, side: int = 512) -> DataFrame:
    """(survey, node, target): every cell with each target that its path to the outlet meets, itself included.

    Targets are (survey, node, target); those on no cell and repeated ones change nothing. A cycle raises a ValueError.
    """
    dealt, count = _dealt(cells.select("survey", "row", "col", "node", "receiver"), side), cells.count()
    sets = targets.groupBy("survey", "node").agg(F.collect_set(target).alias("met"))
    marks = cut(_joined(dealt.select(*BLOCK, "node"), sets).select(*BLOCK, "node", "met"))
    kind = targets.schema[target].dataType
    many = pa.list_(to_arrow_type(kind))

    def first(block: pa.Table, number: np.ndarray, some: pa.Table, of: np.ndarray) -> pa.Table:
        if not block.num_rows:
            return _rim(block, [], [], side)[0].append_column("met", pa.array([], many))
        key, receiver, named = _keys(block, number, some, of)
        to, order = _downward(key, receiver)
        met = _met(some, named, key, to, order)
        made, keep = _rim(block, to, order, side)
        return made.append_column("met", pa.array([list(met[i]) for i in keep], many))

    rim = cut(blocks.coapply(dealt, marks, BLOCK, count, first, _kinds(dealt, f"met array<{kind.simpleString()}>")))
    _refuse_cycles(rim)
    later = _later_marks(rim)

    def second(block: pa.Table, number: np.ndarray, some: pa.Table, of: np.ndarray) -> pa.Table:
        if not block.num_rows:
            return block.select(["survey", "node"]).append_column("met", pa.array([], many))
        key, receiver, named = _keys(block, number, some, of)
        to, order = _downward(key, receiver)
        met = _met(some, named, key, to, order)
        keep = [i for i, m in enumerate(met) if m]
        made = block.select(["survey", "node"]).take(pa.array(keep, pa.int64()))
        return made.append_column("met", pa.array([list(met[i]) for i in keep], many))

    fields = dealt.select("survey", "node").schema.fields
    done = blocks.coapply(dealt, marks.unionByName(later), BLOCK, count, second, StructType([*fields, StructField("met", ArrayType(kind))]))
    return done.select("survey", "node", F.explode("met").alias(target))


def _numbered(block: pa.Table, key: np.ndarray, receiver: np.ndarray, inflow: dict[int, int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Of blocks sorted by key, with keys of cells and receivers: onward places, sizes of subtrees, numbers from the end of each cell's way within its block, and these ends.

    The cells that drain into one are numbered behind it: first those of other blocks, then its own, the order of its block's walk.
    """
    to, order = _downward(key, receiver)
    size = _totals(block, inflow, to, order, key)
    free = [1 + inflow.get(n, 0) for n in key.tolist()]
    number, end = [0] * len(to), list(range(len(to)))
    for i in order:
        if to[i] >= 0:
            number[i] = free[to[i]]
            free[to[i]] += size[i]
    for i in reversed(order):
        if to[i] >= 0:
            number[i] += number[to[i]]
            end[i] = end[to[i]]
    return to, size, number, end


def tour(cells: DataFrame, side: int = 512) -> DataFrame:
    """(survey, node, receiver, root, first, size): numbers of a walk over each tree, so that what drains to a cell is the numbers from `first` on, `size` of them.

    A cell x drains to y, or is y, if their roots are the same and x.first lies in [y.first, y.first + y.size): catchments are intervals.
    Subtrees of other blocks are placed by the rows on borders alone; see `accumulation` for the two levels. A cycle raises a ValueError.
    """
    dealt = _dealt(cells.select("survey", "row", "col", F.col("node").cast("long").alias("node"), F.col("receiver").cast("long").alias("receiver"), F.lit(1).cast("long").alias("weight__")), side)
    count = cells.count()

    def local(block: pa.Table, number: np.ndarray) -> pa.Table:
        key, receiver, _ = _keys(block, number)
        to, order = _downward(key, receiver)
        total = _totals(block, {}, to, order, key)
        made, keep = _rim(block, to, order, side)
        return made.append_column("total", pa.array([total[i] for i in keep], pa.int64()))

    rim = cut(blocks.apply(dealt, BLOCK, count, local, _kinds(dealt, "total bigint")))
    _refuse_cycles(rim)
    inflow = _inflow(rim)

    def sorted_(block: pa.Table, of: np.ndarray, more: pa.Table, of_more: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray, list[int]]:
        """Blocks by key, with keys of cells, receivers and the nodes of `more`."""
        key, receiver, named = _keys(block, of, more, of_more)
        order = np.argsort(key)
        return block.take(pa.array(order, pa.int64())), key[order], receiver[order], named

    def ways(block: pa.Table, of: np.ndarray, more: pa.Table, of_more: np.ndarray) -> pa.Table:
        """Of blocks that water crosses: the cells that leave one with their sizes, and its entries with the numbers and ends of their ways."""
        block, key, receiver, named = sorted_(block, of, more, of_more)
        known = dict(zip(named, more.column("total").to_pylist()))
        to, size, number, end = _numbered(block, key, receiver, known) if block.num_rows else ([], [], [], [])
        leaves = [i for i, t in enumerate(to) if t == LEAVES]
        enters = [i for i, n in enumerate(key.tolist()) if n in known]
        keep, node, to_elsewhere = leaves + enters, block.column("node").to_pylist(), block.column("receiver").to_pylist()
        made = block.select([*BLOCK, "node"]).take(pa.array(keep, pa.int64()))
        ends = [end[i] for i in keep]
        return (
            made.append_column("entry", pa.array([False] * len(leaves) + [True] * len(enters), pa.bool_()))
            .append_column("receiver", pa.array([to_elsewhere[e] if to[e] == LEAVES else None for e in ends], pa.int64()))
            .append_column("size", pa.array([size[i] for i in keep], pa.int64()))
            .append_column("number", pa.array([number[i] for i in keep], pa.int64()))
            .append_column("end", pa.array([node[e] for e in ends], pa.int64()))
        )

    kinds = ", ".join(f"`{c}` {k}" for c, k in dealt.select(*BLOCK).dtypes) + ", node bigint, entry boolean, receiver bigint, size bigint, number bigint, end bigint"
    crossed = rim.where("leaves").select(*BLOCK).unionByName(inflow.select(*BLOCK)).distinct()
    some = dealt.join(apart(crossed.withColumnsRenamed({b: f"x_{b}" for b in BLOCK})), [F.col(b).eqNullSafe(F.col(f"x_{b}")) for b in BLOCK], "left_semi")
    way = cut(blocks.coapply(some, inflow, BLOCK, count, ways, kinds))
    told = inflow.withColumn("root", F.lit(None).cast("long")).unionByName(_told(way))

    def whole(block: pa.Table, of: np.ndarray, more: pa.Table, of_more: np.ndarray) -> pa.Table:
        block, key, receiver, named = sorted_(block, of, more, of_more)
        rows = list(zip(named, more.column("total").to_pylist(), more.column("root").to_pylist()))
        to, size, number, end = _numbered(block, key, receiver, {n: t for n, t, r in rows if r is None}) if block.num_rows else ([], [], [], [])
        beyond, node = {n: (t, r) for n, t, r in rows if r is not None}, block.column("node").to_pylist()
        bases = [beyond[int(key[e])] if to[e] == LEAVES else (0, node[e]) for e in end]
        made = block.select(["survey", "node", "receiver"]).append_column("root", pa.array([r for _, r in bases], pa.int64()))
        made = made.append_column("first", pa.array([n + b for n, (b, _) in zip(number, bases)], pa.int64()))
        return made.append_column("size", pa.array(size, pa.int64()))

    fields = dealt.select("survey", "node", "receiver").schema.fields
    shape = StructType([*fields, *(StructField(c, LongType()) for c in ("root", "first", "size"))])
    return blocks.coapply(dealt, told, BLOCK, count, whole, shape)

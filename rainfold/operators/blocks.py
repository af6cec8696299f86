"""Blocks of cells dealt to tasks: many small blocks share one call of a kernel, as each call costs far more than a few cells.

Blocks are dealt into packs by the hash of their keys, some `PACK_CELLS` cells each, in a number of partitions that goes by the number of
cells, so neither many small blocks nor cells that compress well make a task large. A kernel gets whole blocks only, up to `CALL_CELLS`
cells or one larger block, and a number for each row that tells its block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainfold.plans.store import apart

#: Cells of a pack, of a kernel's call and of a partition, about.
PACK_CELLS, CALL_CELLS, TASK_CELLS = 16_384, 65_536, 262_144


def numbers(tables: Sequence[pa.Table], keys: Sequence[str]) -> list[np.ndarray]:
    """Of each table's rows the number of its block from 0, the same in all tables."""
    whole = np.zeros(sum(t.num_rows for t in tables), np.int64)
    for c in keys:
        values = pa.concat_tables([t.select([c]) for t in tables]).column(c).combine_chunks()
        if pa.types.is_nested(values.type):
            seen: dict[str, int] = {}
            codes = np.array([seen.setdefault(repr(v), len(seen)) for v in values.to_pylist()], np.int64)
        else:
            codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        if len(whole):
            whole = np.unique(whole * (codes.max() + 1) + codes, return_inverse=True)[1]
    return np.split(whole, np.cumsum([t.num_rows for t in tables])[:-1])


def calls(tables: Sequence[pa.Table], keys: Sequence[str]) -> Iterator[tuple[list[pa.Table], list[np.ndarray]]]:
    """A pack's tables with their block numbers, in parts of whole blocks by the rows of the first table."""
    ids = numbers(tables, keys)
    if tables[0].num_rows <= CALL_CELLS:
        yield list(tables), ids
        return
    count = np.bincount(ids[0], minlength=max(int(i.max()) + 1 for i in ids if len(i)))
    part, held, at = np.zeros(len(count), np.int64), 0, 0
    for b, n in enumerate(count.tolist()):
        if held and held + n > CALL_CELLS:
            at, held = at + 1, 0
        part[b], held = at, held + n
    for p in range(at + 1):
        rows = [np.flatnonzero(part[i] == p) for i in ids]
        yield [t.take(pa.array(r)) for t, r in zip(tables, rows, strict=True)], [i[r] for i, r in zip(ids, rows, strict=True)]


def dealt(cells: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    """cells + pack__, for `count` cells in all; tables that meet have to be dealt with the same count."""
    packs = -(-count // PACK_CELLS) or 1
    return cells.withColumn("pack__", F.pmod(F.xxhash64(*keys), F.lit(packs))).repartition(max(min(packs, 8), -(-count // TASK_CELLS)), "pack__")


def apply(cells: DataFrame, keys: Sequence[str], count: int, kernel: Callable[[pa.Table, np.ndarray], pa.Table], schema) -> DataFrame:
    """What `kernel(cells of some blocks, their blocks' numbers)` makes of `count` cells."""

    def pack(table: pa.Table) -> pa.Table:
        return pa.concat_tables([kernel(t, i) for (t,), (i,) in calls([table.drop_columns(["pack__"])], keys)])

    return dealt(cells, keys, count).groupBy("pack__").applyInArrow(pack, schema)


def coapply(cells: DataFrame, more: DataFrame, keys: Sequence[str], count: int, kernel: Callable[[pa.Table, np.ndarray, pa.Table, np.ndarray], pa.Table], schema) -> DataFrame:
    """What `kernel(cells of some blocks, their blocks' numbers, rows of `more` of these blocks, their numbers)` makes of `count` cells; blocks without cells may come."""

    def pack(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables([kernel(t, i, u, j) for (t, u), (i, j) in calls([left.drop_columns(["pack__"]), right.drop_columns(["pack__"])], keys)])

    return dealt(cells, keys, count).groupBy("pack__").cogroup(dealt(more, keys, count).groupBy("pack__")).applyInArrow(pack, schema)


def keyed(rows: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    """rows with the struct at__ for their keys, one key as a join deals anew by any other; dealt to tasks by `count` cells, so a task stays as large whatever the session's partitions."""
    return rows.select(F.struct(*keys).alias("at__"), *[c for c in rows.columns if c not in keys]).repartition(-(-count // TASK_CELLS) or 1, "at__")


def joined(cells: DataFrame, more: DataFrame, keys: Sequence[str], count: int, how: str = "inner") -> DataFrame:
    """cells + what `more` holds for their keys, null ones too; see `keyed`."""
    made = keyed(cells, keys, count).join(apart(keyed(more, keys, count)), "at__", how)
    return made.select(*[F.col(f"at__.{c}") if c in keys else c for c in cells.columns], *[c for c in more.columns if c not in keys])


def stacked(row: np.ndarray, col: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(spot, wide, size): places of cells in one array in which blocks lie one behind the other, each with an empty rim; the step
    from row to row is its block's `wide`, told for each cell."""
    n = int(block.max()) + 1
    first = [np.full(n, np.iinfo(np.int64).max) for _ in range(2)]
    last = [np.full(n, np.iinfo(np.int64).min) for _ in range(2)]
    for low, high, line in zip(first, last, (row, col), strict=True):
        np.minimum.at(low, block, line)
        np.maximum.at(high, block, line)
    some = first[0] <= last[0]
    tall, broad = (np.where(some, np.where(some, h, 0) - np.where(some, a, 0) + 3, 0) for a, h in zip(first, last, strict=True))
    begin = np.concatenate([[0], np.cumsum(tall * broad)])
    wide = broad[block]
    return begin[block] + (row - first[0][block] + 1) * wide + (col - first[1][block] + 1), wide, int(begin[-1])

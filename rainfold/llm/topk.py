"""Exact top-k inner products by Fagin's threshold algorithm.

Rows are gathered into blocks within their partitions (no shuffle), queries into blocks likewise: a stated query set against
all rows, in blocks. Both are dealt over a grid of groups, rows over its lines and queries over its columns, and each cell of
the grid is an equi-join, so a block is shipped once for each group of the other side and not once for each block of it.
In a block, every dimension has a list of the rows sorted by value. The lists are read from both ends to doubling depths, for
some queries at a time; rows seen are scored in full, and a query's search of the block stops when the sum of what the lists may
still give it is below its k-th score. Equal scores go to the smaller id, so the bound has to be strictly below.
The best k of each block are merged by a window over the query's id.

Vectors with a component from 2**18 on come in blocks of their own, whose scores are summed as Python integers where
64 bits may not hold them. Ranks are right for them too; a score that BIGINT cannot hold is null.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Shorter vectors count as padded with zeros. Of several queries with one id the least vector is the query; rows
with the query's own id are not its candidates.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rainfold.plans.store import apart

BLOCK_ROWS, QUERY_ROWS, FIRST_DEPTH = 8192, 1024, 16
#: Cells of the grid at least, so that few blocks still keep many tasks busy, and pairs of blocks that a cell has about.
LEAST_CELLS, CELL_PAIRS = 16, 16
#: Tasks at most that cells of the grid are dealt to, and queries for which a block's lists are read together.
MOST_TASKS, ASKED_ROWS = 4096, 128
#: Components below it fit a block of 32-bit integers; doubles from WHOLE on are whole numbers of 256ths.
SMALL, WHOLE = float(2**18), float(2**44)


def quantised(vector: Column) -> Column:
    """Components rounded down to 256ths, which doubles hold exactly."""

    def down(x: Column) -> Column:
        x = x.cast("double")
        return F.when(F.abs(x) < WHOLE, F.floor(F.lit(256.0) * x) / F.lit(256.0)).otherwise(x)

    return F.transform(vector, down)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def _packed(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """One row for each block: ids and vectors as bytes, of 256ths in 32 bits or, where one is large, of doubles."""

    def row(ids: list, vectors: list, large: bool) -> pa.RecordBatch:
        width = max(map(len, vectors), default=0)
        block = np.zeros((len(ids), width), np.float64)
        for i, v in enumerate(vectors):
            block[i, : len(v)] = v
        block = block if large else (block * 256).astype(np.int32)
        return pa.RecordBatch.from_pydict({"n": pa.array([len(ids)], pa.int32()), "width": pa.array([width], pa.int32()), "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), "vectors": pa.array([block.tobytes()], pa.binary())})

    held: dict = {False: ([], []), True: ([], [])}
    for b in batches:
        for i, v in zip(b.column("id__").to_pylist(), b.column("v__").to_pylist(), strict=True):
            large = bool(v) and (max(v) >= SMALL or min(v) <= -SMALL)
            ids, vectors = held[large]
            ids.append(i)
            vectors.append(v)
            if len(ids) == rows:
                yield row(ids, vectors, large)
                held[large] = ([], [])
    for large, (ids, vectors) in held.items():
        if ids:
            yield row(ids, vectors, large)


def unpacked(raw: bytes, n: int, width: int, to: int) -> np.ndarray:
    """A block's vectors in 256ths, padded to `to` columns: 64-bit integers, or Python's where those do not hold them."""
    if len(raw) == n * width * 4:
        block = np.frombuffer(raw, np.int32).reshape(n, width).astype(np.int64)
    else:
        block = np.frombuffer(raw, np.float64).reshape(n, width)
        if np.abs(block).max(initial=0) < 2**54:
            block = (block * 256).astype(np.int64)
        else:
            block = np.array([int(x) * 256 if abs(x) >= WHOLE else int(x * 256) for x in block.ravel().tolist()], object).reshape(n, width)
    return np.pad(block, ((0, 0), (0, to - width)))


def sort_key(score: int) -> bytes:
    """Bytes in the order of the integers."""
    size = (score.bit_length() + 7) // 8
    magnitude = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return b"\1" + magnitude if score >= 0 else b"\0" + bytes(255 - x for x in magnitude)


class Lists:
    """A block's rows, the values of each dimension in order, and the depth at which one of these lists first shows a row, from either end."""

    def __init__(self, ids: np.ndarray, block: np.ndarray):
        self.ids, self.block = ids, block
        order = np.argsort(-block, axis=0, kind="stable")
        self.ranked = np.take_along_axis(block, order, axis=0)
        n = len(ids)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.minimum(np.arange(n), np.arange(n)[::-1])[:, None], axis=0)
        shown = place.min(axis=1, initial=n)
        self.found = np.argsort(shown, kind="stable")
        self.shown = shown[self.found]

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k rows, by score and then by id."""
        return self.best_of(np.array([own], np.int64), query[None], k)[1:]

    def best_of(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, ids, scores) of the best k rows for the query at each place, by place, score and then id.

        The lists are read to one depth for all queries that are not done, from both ends, so their fresh rows are scored by one product
        of matrices; each query stops by its own bound.
        """
        n, live = len(self.ids), np.arange(len(own))
        place, ids, scores = (np.empty(0, np.int64) for _ in range(3))
        exact, done, depth = queries.astype(self.block.dtype), 0, FIRST_DEPTH
        lowest = -np.inf if exact.dtype.kind == "f" else np.iinfo(exact.dtype).min
        while n and len(live):
            depth = min(depth, n)
            upto = n if depth == n else int(np.searchsorted(self.shown, depth))  # at the end all, also where vectors have no components
            at = self.found[done:upto]
            if len(at):
                fresh = exact[live] @ self.block[at].T
                fresh[own[live][:, None] == self.ids[at]] = lowest
                edge = np.partition(fresh, len(at) - k, axis=1)[:, len(at) - k] if len(at) > k else np.full(len(live), lowest)
                q, r = np.nonzero((fresh >= edge[:, None]) & (fresh > lowest))
                place, ids, scores = (np.concatenate(x) for x in ((place, live[q]), (ids, self.ids[at][r]), (scores, fresh[q, r].astype(np.int64))))
                order = np.lexsort((ids, -scores, place))
                order = order[np.arange(len(order)) - np.searchsorted(place[order], place[order]) < k]
                place, ids, scores = place[order], ids[order], scores[order]
            if upto == n:
                break
            bound = self.ranked[depth - 1] @ np.maximum(exact[live], 0).T + self.ranked[n - depth] @ np.minimum(exact[live], 0).T
            last = np.searchsorted(place, live, "right") - 1
            full = np.searchsorted(place, live, "right") - np.searchsorted(place, live) >= k
            live = live[~(full & (scores[last] > bound.astype(np.int64)))] if len(scores) else live
            done, depth = upto, depth * 2
        return place, ids, scores


class Scores:
    """A block's rows of Python integers, all scored."""

    def __init__(self, ids: np.ndarray, block: np.ndarray):
        self.ids, self.block = ids, block

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = self.block @ query.astype(object)
        first = heapq.nsmallest(k, ((-x, i) for i, x in zip(self.ids.tolist(), scores.tolist(), strict=True) if i != own))
        return np.array([i for _, i in first], np.int64), np.array([-x for x, _ in first], object)

    def best_of(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        each = [self.best(o, q, k) for o, q in zip(own.tolist(), queries, strict=True)]
        return np.repeat(np.arange(len(own)), [len(i) for i, _ in each]), *(np.concatenate(x) for x in zip(*each, strict=True))


def grid_sides(n_rows: int, n_queries: int) -> tuple[int, int]:
    """Groups of row blocks and of query blocks: as many cells as there is work for, of the shape that ships least."""
    row_blocks, query_blocks = max(1, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    cells = max(LEAST_CELLS, row_blocks * query_blocks // CELL_PAIRS)
    across = min(query_blocks, max(1, round((cells * query_blocks * QUERY_ROWS / (row_blocks * BLOCK_ROWS)) ** 0.5)))
    return -(-cells // across), across


def top_k(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each query; vectors are ARRAY<DOUBLE> as `quantised` gives them."""
    made = "n int, width int, ids binary, vectors binary"
    blocks = rows.select(F.col(id_col).cast("long").alias("id__"), F.col(vector).alias("v__")).mapInArrow(lambda b: _packed(b, BLOCK_ROWS), made)
    asked = queries.groupBy(F.col(id_col).cast("long").alias("id__")).agg(F.min(vector).alias("v__"))
    n_queries = queries.count()
    n_blocks = max(1, -(-n_queries // QUERY_ROWS))
    down, across = grid_sides(rows.count(), n_queries)
    asked = asked.withColumn("no", F.pmod(F.xxhash64("id__"), F.lit(n_blocks)).cast("int")).repartition(n_blocks, "no").sortWithinPartitions("no")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            no = b.column("no").to_numpy()
            for x in np.unique(no):
                part = b.filter(pa.array(no == x))
                for packed in _packed(iter([part]), QUERY_ROWS):
                    yield pa.RecordBatch.from_pydict({"no": pa.array([x], pa.int32()), "q_n": packed["n"], "q_width": packed["width"], "q_ids": packed["ids"], "q_vectors": packed["vectors"]})

    query_blocks = asked.mapInArrow(ask, "no int, q_n int, q_width int, q_ids binary, q_vectors binary")
    dealt = blocks.withColumn("line", F.pmod(F.xxhash64("ids"), F.lit(down)).cast("int")).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    asking = query_blocks.withColumn("column", F.pmod("no", F.lit(across))).withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    # blocks of repeated vectors are few bytes when shuffled and many when not, so neither side is broadcast nor are cells put together by bytes
    cells = min(down * across, MOST_TASKS)
    pairs = dealt.repartition(cells, "line", "column").join(apart(asking.repartition(cells, "line", "column")), ["line", "column"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lists = None
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                width = max(r["width"], r["q_width"])
                block, asked_for = unpacked(r["vectors"], r["n"], r["width"], width), unpacked(r["q_vectors"], r["q_n"], r["q_width"], width)
                most = width * int(np.abs(block).max(initial=0)) * int(np.abs(asked_for).max(initial=0))
                kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**63 else object  # sums stay exact
                if held != (at := (r["ids"], r["vectors"], width, kind)):  # the pairs of a block come one after another
                    rows, held = np.frombuffer(r["ids"], np.int64), at
                    lists = Scores(rows, block.astype(object)) if kind is object else Lists(rows, block.astype(kind))
                out: list[tuple] = []
                asking_ids = np.frombuffer(r["q_ids"], np.int64)
                for first in range(0, len(asking_ids), ASKED_ROWS):
                    own = asking_ids[first : first + ASKED_ROWS]
                    place, ids, scores = lists.best_of(own, asked_for[first : first + ASKED_ROWS], k)
                    out += [(o, i, x if -(2**63) <= x < 2**63 else None, sort_key(x)) for o, i, x in zip(own[place].tolist(), ids.tolist(), scores.tolist(), strict=True)]
                cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
                yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.binary() if c == "key" else pa.int64()) for c, v in zip(("query_id", "vec_id", "score", "key"), cols, strict=True)})

    found = pairs.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint, key binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("key").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_report(embeddings: DataFrame) -> DataFrame:
    """The contract columns of op5."""
    rows = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding")).alias("v"))
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0), "vec_id", "v", 5)

"""Vector codes of a few bytes by delta-maintained Lloyd rounds.

Method. Each vector is cut into equal parts and each part position has a codebook of a few integer entries. A table of rows
(vec_id, label, vector, previous assignment) is written once a round to the shared folder. The task that finds a row's new
assignment also adds up, for the parts whose assignment changed only, what the new entry gains and the old one loses; it
writes these sums, at most one row for each entry and component, beside its rows. So a round reads and writes the rows in place,
without a shuffle, and only the plus/minus sums of changed parts are shuffled. The running integer sums and counts, one number for
each entry and component, are carried on by the driver; entries are floor(sum / count). If nothing changed, later rounds would not change
anything either and are left out.

Exactness. A component x becomes floor(scale * x). Distances are whole numbers below 2**53 for all but huge components and are
found by matrix products; where a component of a row or of a codebook is too large for that, Python integers are used. Sums travel as
limbs of 32 bits, so they cannot overflow.

Memory: a batch of rows, the codebooks, and the sums of a task. A task that runs again writes its rows and sums again, as whole
files. State of the round before last is deleted.

Defined results: null vectors, and those with null or non-finite components, are dropped. The codebooks start as the parts of the
rows of smallest vec_id, null last, repeated ids ordered by vector; with fewer rows there are fewer entries. Repeated rows
give a row each. The length of vectors is that of the smallest vec_id whose length the parts divide; vectors of other lengths have a null
code and error. An error beyond 64 bits is null, and so is the sum over its label;
rows without a code add nothing to it. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rainfold.llm.common import cut, fields, is_small
from rainfold.plans.store import forget, new_path

LIMB = 32
LONG = (1 << 63) - 1


@dataclass
class Codebooks:
    """parts x entries x components, as Python integers."""

    entries: list[list[list[int]]]

    def sha256(self) -> str:
        """Of all components by part, entry and place within the part, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e).encode()).hexdigest()


def quantised(x: float, scale: int) -> int:
    """floor(scale * x) without a bound on its size."""
    return int(x) * scale if abs(x) >= 1 << 53 else int(np.floor(scale * x))


def exact_below(width: int) -> int:
    """Components below this give part distances that doubles hold exactly."""
    return int(np.sqrt((1 << 50) / max(1, width)))


class Rounds:
    """What the tasks of a round need: codebooks as doubles if these are exact, and as integers."""

    def __init__(self, books: Codebooks, scale: int) -> None:
        self.books, self.scale = books.entries, scale
        self.parts, self.k, self.width = len(self.books), len(self.books[0]), len(self.books[0][0])
        self.limit = exact_below(self.width)
        self.small = max(abs(x) for p in self.books for e in p for x in e) < self.limit
        self.doubles = np.array(self.books, np.float64) if self.small else None

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """The entry and the squared distance of each part of rows of whole numbers in doubles."""
        chosen, errors = np.empty((len(x), self.parts), np.uint8), np.zeros(len(x), np.int64)
        for p in range(self.parts):
            own, book = x[:, p * self.width : (p + 1) * self.width], self.doubles[p]
            far = (own * own).sum(axis=1)[:, None] - 2 * (own @ book.T) + (book * book).sum(axis=1)
            chosen[:, p] = far.argmin(axis=1)
            errors += far[np.arange(len(x)), chosen[:, p]].astype(np.int64)
        return chosen, errors.tolist()

    def nearest_wide(self, row: list[int]) -> tuple[list[int], int]:
        chosen, error = [], 0
        for p, book in enumerate(self.books):
            own = row[p * self.width : (p + 1) * self.width]
            far = [sum((a - b) ** 2 for a, b in zip(own, e, strict=True)) for e in book]
            chosen.append(far.index(min(far)))
            error += min(far)
        return chosen, error

    def batch(self, vectors: pa.Array) -> tuple[np.ndarray, list, np.ndarray, np.ndarray, dict[int, list[int]]]:
        """Assignments, errors, whole components as doubles, which rows these are exact for, and the others as integers."""
        raw = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), self.parts * self.width)
        x = np.floor(np.where(np.abs(raw) * self.scale < self.limit, raw, 0.0) * self.scale)
        fine = (np.abs(raw) * self.scale < self.limit).all(axis=1)
        if not self.small:
            fine[:] = False
        chosen, errors, wide = np.zeros((len(x), self.parts), np.uint8), [0] * len(x), {}
        if fine.any():
            some, given = self.nearest(x[fine])
            chosen[fine] = some
            for i, e in zip(np.flatnonzero(fine).tolist(), given, strict=True):
                errors[i] = e
        for i in np.flatnonzero(~fine).tolist():
            wide[i] = [quantised(v, self.scale) for v in raw[i].tolist()]
            chosen[i], errors[i] = self.nearest_wide(wide[i])
        return chosen, errors, x, fine, wide


def limbs(value: int) -> list[int]:
    """The number in base 2**32, lowest first; the last limb has the sign."""
    out = []
    while not -(1 << LIMB) < value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


class Deltas:
    """Plus and minus contributions of parts whose assignment changed."""

    def __init__(self, of: Rounds) -> None:
        self.of = of
        self.sums = [[[0] * (of.width + 1) for _ in range(of.k)] for _ in range(of.parts)]

    def add(self, x: np.ndarray, fine: np.ndarray, wide: dict[int, list[int]], new: np.ndarray, old: np.ndarray | None) -> None:
        w = self.of.width
        for p in range(self.of.parts):
            changed = fine if old is None else fine & (new[:, p] != old[:, p])
            own = np.hstack([x[changed, p * w : (p + 1) * w], np.ones((int(changed.sum()), 1))])
            for sign, entry in ((1, new),) if old is None else ((1, new), (-1, old)):
                hot = (entry[changed, p][None, :] == np.arange(self.of.k)[:, None]).astype(np.float64)
                for e, moved in enumerate((hot @ own).astype(np.int64).tolist()):  # below 2**53: a batch has few rows
                    for i, v in enumerate(moved):
                        self.sums[p][e][i] += sign * v
            for i, row in wide.items():
                if old is None or new[i, p] != old[i, p]:
                    for sign, entry in ((1, new),) if old is None else ((1, new), (-1, old)):
                        at = self.sums[p][int(entry[i, p])]
                        for j, v in enumerate([*row[p * w : (p + 1) * w], 1]):
                            at[j] += sign * v

    def rows(self) -> tuple[list[int], list[int], list[int]]:
        """(place, limb, value) of what is not 0."""
        found = [(i, n, v) for i, total in enumerate(x for p in self.sums for e in p for x in e) if total for n, v in enumerate(limbs(total)) if v]
        return tuple(map(list, zip(*found, strict=True))) if found else ([], [], [])


STATE = "state int, place int, limb int, value bigint"


def _round(rows: DataFrame, books: Codebooks, scale: int, first: bool) -> tuple[DataFrame, DataFrame, str]:
    """The rows with their new assignment, the summed changes (place, limb, value), and the table both are in."""
    of = Rounds(books, scale)
    keep = ["vec_id", "label", "vector"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deltas, last = Deltas(of), None
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                new, _, x, fine, wide = of.batch(b.column("vector"))
                old = None if first else np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(new.shape)
                deltas.add(x, fine, wide, new, old)
                empty = {c: pa.nulls(b.num_rows, t) for c, t in (("place", pa.int32()), ("limb", pa.int32()), ("value", pa.int64()))}
                last = pa.RecordBatch.from_pydict({c: b.column(c) for c in keep} | {"code": pa.array([r.tobytes() for r in new], pa.binary()), "state": pa.array([0] * b.num_rows, pa.int32())} | empty)
                yield last
        place, limb, value = deltas.rows()
        if place:
            yield pa.RecordBatch.from_pydict({f.name: pa.nulls(len(place), f.type) for f in last.schema} | {"state": pa.array([1] * len(place), pa.int32()), "place": pa.array(place, pa.int32()), "limb": pa.array(limb, pa.int32()), "value": pa.array(value, pa.int64())})

    made = rows.mapInArrow(kernel, fields(rows, keep) + ", code binary, " + STATE)
    path = new_path(rows.sparkSession, "codes")
    made.write.partitionBy("state").parquet(path)
    back = rows.sparkSession.read.schema(made.schema).parquet(path)
    moved = back.where("state = 1").groupBy("place", "limb").agg(F.sum("value").alias("value"))
    return back.where("state = 0").select(*keep, "code"), moved, path


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, vector) of the rows whose vector has no null and no non-finite component."""
    fine = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return df.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(vector).alias("vector"))


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code BINARY, error BIGINT) of rows (vec_id, label, vector), and the last codebooks."""
    spark = vectors.sparkSession
    of_kind = vectors.where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    first = of_kind.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").first()
    none = vectors.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    if first is None:
        return none, None
    length = len(first["vector"])
    rows = vectors.where(F.size("vector") == length)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    width = length // parts
    whole = [[quantised(float(x), scale) for x in r["vector"]] for r in start]
    books = Codebooks([[v[p * width : (p + 1) * width] for v in whole] for p in range(parts)])
    sums = [0] * (parts * len(whole) * (width + 1))
    paths: list[str] = []
    for n in range(rounds):
        rows, moved, path = _round(rows, books, scale, n == 0)
        changes = moved.collect()  # a few limbs for each entry and component
        if not changes:
            break
        for r in changes:
            sums[r["place"]] += r["value"] << (LIMB * r["limb"])
        for p in range(parts):
            for e in range(len(whole)):
                *own, count = sums[(p * len(whole) + e) * (width + 1) :][: width + 1]
                if count:
                    books.entries[p][e] = [s // count for s in own]
        paths.append(path)
        if len(paths) > 2:
            forget(spark, paths.pop(0))
    of = Rounds(books, scale)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                new, errors, *_ = of.batch(b.column("vector"))
                yield pa.RecordBatch.from_pydict({"vec_id": b.column("vec_id"), "label": b.column("label"), "code": pa.array([r.tobytes() for r in new], pa.binary()), "error": pa.array([e if e <= LONG else None for e in errors], pa.int64())})

    coded = rows.mapInArrow(last, fields(rows, ["vec_id", "label"]) + ", code binary, error bigint")
    return coded.unionByName(none.where(F.size("vector") != length)), books


def reconstruct(coded: DataFrame, books: Codebooks, scale: int = 4096) -> DataFrame:
    """coded + (vector ARRAY<DOUBLE>): the entries that a code names, over the scale; null for a null code."""
    flat = F.array(*[F.array(*[F.lit(float(x) / scale) for x in e]) for p in books.entries for e in p])
    k = len(books.entries[0])
    named = F.transform(F.sequence(F.lit(0), F.lit(len(books.entries) - 1)), lambda p: F.element_at(flat, (p * k + F.conv(F.hex(F.substring("code", p + 1, F.lit(1))), 16, 10).cast("int") + 1).cast("int")))
    return coded.withColumn("vector", F.when(F.col("code").isNotNull(), F.flatten(named)))


def code_report(embeddings: DataFrame) -> DataFrame:
    """The contract columns of op11, and the label."""
    vectors = usable(embeddings)
    coded, books = compress(vectors)
    coded = cut(coded)
    by_label = coded.groupBy(F.col("label").alias("of__")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum__"), F.max(F.col("error").isNull() & F.col("code").isNotNull()).alias("beyond__"))
    by_label = cut(by_label.select("of__", F.when(~F.col("beyond__"), F.col("sum__")).try_cast("long").alias("label_error")))
    by_label = F.broadcast(by_label) if is_small(by_label) else by_label
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of__")), "left")
    return out.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))

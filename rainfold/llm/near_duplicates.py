"""Jaccard joins of texts by word shingles with parity sketches.

Method. A text's set is its distinct five-word shingles, each a 64-bit hash. Sets of sizes a <= b are linked at
similarity 0.8 only if their symmetric difference has at most (a + b) / 9 members, and then b <= 1.25 a.

* Parity sketch: each shingle flips one bit, so the Hamming distance of two sketches is a lower bound of the symmetric
  difference. Its parts are kept as XORs of the hashes that fall into them: equal parts show as equal numbers.
* Size bands are powers of two; a band has a fixed number of parts, so large that a set occupies more parts than the
  difference it may have (`allowed`). A difference of d spoils at most d parts. So if a set emits its first d + 1 occupied parts, at
  least one of them is the same in any linked set, which emits it too. Sets just above a power of two also
  emit for the band below. Sets that occupy too few parts also emit every shingle; two such sets share one.
* Equal sets are one class from the start. Buckets of classes with an equal part are first joined as stars around their
  least class; pairs that the Hamming distance of their sketches allows are verified on the exact sets. Then only pairs of
  different components are left to test: in each bucket each component with its nearest others, then all that are left.
  Groups of near copies thus cost a star each and not all their pairs, and no link between components is lost.
* A bucket's members are compared in pairs of blocks of at most `BLOCK_ROWS` members each, a task of its own for each pair.
* Components of verified links by alternating large-star and small-star steps.

Classes are named by a digest of their set and numbered; a number stands for one set, whatever doc_ids its rows have.

Memory: rows of parts are (part, class) pairs; exact sets exist only for classes of pairs whose sketches are near and are
joined by shuffles. Which ids those are comes as a Bloom filter of a fixed size; what it lets pass too much is
joined away. Checkpoints in the shared folder cut the lineage between the rounds. Keys that hold over a hundredth of all
rows (a pivot with very many near copies, a bucket) are salted in joins.

Defined results: null and empty texts have 0 shingles and are their own component; texts of one to four words are one
shingle; repeated rows and doc_ids give a row each, and different texts with one doc_id are linked or not by their own
words. A component's id is its least doc_id; rows without a doc_id take part, and have a null one where all lack it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainfold.llm.common import batch_of, cut, fields, in_batches, slices
from rainfold.operators.graph import components, salted_join

WORDS = 5
BLOOM_BITS = 1 << 25
#: What stands for a null doc_id in a Bloom filter; rows of such an id would only pass it too much.
NO_ID = -(2**63) + 1
REMEMBERED = 150_000
#: Members of a bucket's block, and shingles that a block's members have about in sum at most.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 25
#: Which neighbour each component of a bucket is tested with in each round; None tests all pairs that are left.
ROUNDS = (0, 1, None)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got


def times(k: int, odd: np.uint64) -> np.uint64:
    return np.uint64(k * int(odd) & 0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _A
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: Hashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z change case, only ASCII white space parts words
    if not found:
        return np.empty(0, np.uint64)
    each = np.fromiter((hashes[w] for w in found), np.uint64, len(found))
    n = min(words, len(found))
    rows = len(found) - n + 1
    out = np.full(rows, n, np.uint64)
    for i in range(n):
        out = mixed(out + each[i : i + rows])
    return np.unique(out)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def band(n: int) -> int:
    return n.bit_length() - 1


def parts_of(j: int) -> int:
    return int(0.58 * (1 << j)) + 4


def part_keys(own: np.ndarray) -> np.ndarray:
    """The numbers under which a set meets every set that may be linked with it."""
    n = len(own)
    if not n:
        return np.empty(0, np.int64)
    j, out = band(n), []
    aims = [(j, n // 4)]
    if j and n <= 1.25 * ((1 << j) - 1):
        aims.append((j - 1, ((1 << j) - 1 + n) // 9))
    for level, allowed in aims:
        part = (own % np.uint64(parts_of(level))).astype(np.int64)
        order = np.argsort(part, kind="stable")
        ranked = part[order]
        starts = np.flatnonzero(np.diff(ranked, prepend=-1))
        content = np.bitwise_xor.reduceat(mixed(own[order] ^ _A), starts)
        out.append(mixed(mixed(content + times(2 * level + 1, _A)) + ranked[starts].astype(np.uint64))[: allowed + 1])
        if len(starts) <= allowed:
            out.append(mixed(own + times(2 * level + 2, _B)))
    return np.concatenate(out).view(np.int64)


def sketch(own: np.ndarray) -> np.ndarray:
    """Parity of the shingles at each of at least twice as many bits as there are shingles, 256 at least."""
    bits = max(256, 2 << len(own).bit_length())
    at = (mixed(own ^ _B) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


def fold(words: np.ndarray, to: int) -> np.ndarray:
    """The sketch of fewer bits."""
    while words.shape[-1] > to:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _texts(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return in_batches(docs).select(*keep, F.col("doc_id").cast("long").alias("id__"), F.col("text").alias("text__"))


def set_classes(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep + (id__, n_shingles, digest__, sketch__): equal digests mean equal sets."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in slices(batches, ["text__"], 512, 2 << 20):
            rows = [(len(s), _digest(s), sketch(s).tobytes()) for s in (shingles(t, hashes) for t in b.column("text__").to_pylist())]
            yield batch_of(b, [*keep, "id__"], n_shingles=pa.array([n for n, _, _ in rows], pa.int64()), digest__=pa.array([d for _, d, _ in rows], pa.binary()), sketch__=pa.array([k for _, _, k in rows], pa.binary()))

    made = _texts(docs, keep)
    return made.mapInArrow(kernel, fields(made, [*keep, "id__"]) + ", n_shingles bigint, digest__ binary, sketch__ binary")


def keyed_parts(docs: DataFrame) -> DataFrame:
    """(id__, digest__, keys ARRAY<BIGINT>); repeats of an id and set within a task are left out as long as the memory holds."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = Hashes(), set()
        for b in slices(batches, ["text__"], 512, 2 << 20):
            ids, digests, keys = [], [], []
            for i, t in zip(b.column("id__").to_pylist(), b.column("text__").to_pylist(), strict=True):
                own = shingles(t, hashes)
                name = (i, _digest(own))
                if len(own) and name not in known:
                    if len(known) > REMEMBERED:
                        known.clear()
                    known.add(name)
                    ids.append(i)
                    digests.append(name[1])
                    keys.append(part_keys(own))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_pydict({"id__": pa.array(ids, pa.int64()), "digest__": pa.array(digests, pa.binary()), "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})

    return _texts(docs).mapInArrow(kernel, "id__ bigint, digest__ binary, keys array<bigint>")


def of_classes(rows: DataFrame, classes: DataFrame, *columns: str) -> DataFrame:
    """(cls, *columns): from rows with (id__, digest__) one row for each of classes (cls, rep, digest__)."""

    def named(df: DataFrame, of: str, *rest: str) -> DataFrame:
        return df.select(F.coalesce(of, F.lit(0)).alias("id__"), F.col(of).isNull().alias("none__"), "digest__", *rest)

    key = ["id__", "none__", "digest__"]
    met = named(rows, "id__", *columns).join(named(classes, "rep", "cls"), key)
    return met.groupBy(*key).agg(*[F.first(c).alias(c) for c in ("cls", *columns)]).drop(*key)


def _bloom_places(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64)
    return np.concatenate([(mixed(x + times(i, _A)) % np.uint64(BLOOM_BITS)).astype(np.int64) for i in (1, 2, 3)])


def bloom_filter(ids: DataFrame, column: str) -> np.ndarray:
    """BLOOM_BITS / 8 bytes, whatever the number of ids; each of a few tasks sends the filter of its rows to one of a few unions."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS, np.uint8)
        for b in batches:
            bits[_bloom_places(b.column(0).to_numpy())] = 1
        packed = np.packbits(bits).reshape(64, -1)
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_pydict({"no": pa.array(some, pa.int32()), "bits": pa.array([packed[i].tobytes() for i in some], pa.binary())})

    def union(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOOM_BITS // 8 // 64, np.uint8)
        for b in tables:
            for raw in b.column("bits").to_pylist():
                total |= np.frombuffer(raw, np.uint8)
        yield pa.RecordBatch.from_pydict({"no": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})

    filled = ids.select(column).repartition(16).mapInArrow(fill, "no int, bits binary")
    out = np.zeros((64, BLOOM_BITS // 8 // 64), np.uint8)
    for r in filled.groupBy("no").applyInArrow(union, "no int, bits binary").collect():
        out[r["no"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def may_hold(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id may be in the filter; of those in it all are."""
    at = _bloom_places(ids)
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).reshape(3, -1).all(axis=0)


def exact_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, members BINARY) of the classes in `wanted` (cls, rep, digest__)."""
    asked = F.coalesce("rep", F.lit(NO_ID))
    bits = docs.sparkSession.sparkContext.broadcast(bloom_filter(wanted.select(asked.alias("rep")), "rep").tobytes())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = Hashes(), np.frombuffer(bits.value, np.uint8)
        for b in slices(batches, ["text__"], 512, 2 << 20):
            b = b.filter(pa.array(may_hold(known, b.column("id__").fill_null(NO_ID).to_numpy())))
            if b.num_rows:
                sets = [shingles(t, hashes) for t in b.column("text__").to_pylist()]
                yield batch_of(b, ["id__"], digest__=pa.array(map(_digest, sets), pa.binary()), members=pa.array([s.tobytes() for s in sets], pa.binary()))

    return of_classes(_texts(docs).mapInArrow(kernel, "id__ bigint, digest__ binary, members binary"), wanted, "members")


def with_ends(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """pairs (x, y), from a checkpoint, + the columns of values (cls, ...) for both ends, named with the end's letter in front.

    An end that very many pairs have in common is salted.
    """
    each = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("cls")) for side in ("y", "x")]))
    counts = cut(pairs.select(each.alias("e")).groupBy("e.side", "e.cls").agg(F.count(F.lit(1)).alias("n__")), 2 * pairs.count())
    both = pairs
    for side in ("y", "x"):
        named = values.select(F.col("cls").alias(side), *[F.col(c).alias(side + c) for c in values.columns if c != "cls"])
        both = salted_join(both, named, side, counts.where(F.col("side") == side).select(F.col("cls").alias(side), "n__"))
    return both


def near(a: int, b: int, apart: int) -> bool:
    """Whether sets of sizes a and b whose sketches differ in `apart` bits may be linked."""
    return 9 * apart <= a + b and 5 * a >= 4 * b and 5 * b >= 4 * a


def near_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (x, y) that the Hamming distance of their sketches does not rule out; sketches are (cls, size, sketch)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ["xsketch", "ysketch"], 4096):
            keep = []
            for a, z, p, q in zip(*(b.column(c).to_pylist() for c in ("xsize", "ysize", "xsketch", "ysketch")), strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                least = min(len(p), len(q))
                keep.append(near(a, z, int(np.bitwise_count(fold(p, least) ^ fold(q, least)).sum())))
            yield b.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    both = with_ends(pairs, sketches)
    return both.select("x", "y", "xsize", "ysize", "xsketch", "ysketch").mapInArrow(kernel, "x bigint, y bigint")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (x, y) whose sets are linked, by one more pass over the texts for the sets of these pairs."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ["xmembers", "ymembers"], 256):
            rows = zip(b.column("xmembers").to_pylist(), b.column("ymembers").to_pylist(), strict=True)
            keep = pa.array([linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in rows], pa.bool_())
            yield b.select(["x", "y"]).filter(keep)

    asked = pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct()
    sets = exact_sets(docs, cut(classes.join(asked, "cls")))
    both = with_ends(pairs, sets)
    return both.select("x", "y", "xmembers", "ymembers").mapInArrow(kernel, "x bigint, y bigint")


def block_pairs(sizes: np.ndarray, raw: list, comps: np.ndarray, blocks: np.ndarray | None, rank: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places (x, y) of members of different components that are near by sketch, and whether there are any.

    With `blocks` only members of different blocks are compared. With a rank, each component gives one pair at most: its
    rank-th nearest; with None all pairs are given.
    """
    words = [np.frombuffer(s, np.uint64) for s in raw]
    least, n = min(map(len, words)), len(raw)
    bits = np.stack([fold(w, least) for w in words])
    step, xs, ys, far, some = max(1, (4 << 20) // (8 * least * n)), [], [], [], False
    for a in range(0, n, step):
        z = slice(a, a + step)
        distance = np.bitwise_count(bits[z, None, :] ^ bits[None, :, :]).sum(axis=2, dtype=np.int64)
        may = (9 * distance <= sizes[z, None] + sizes[None, :]) & (5 * sizes[z, None] >= 4 * sizes[None, :]) & (5 * sizes[None, :] >= 4 * sizes[z, None])
        may &= comps[z, None] != comps[None, :]
        if blocks is not None:
            may &= blocks[z, None] != blocks[None, :]
        some |= bool(may.any())
        if rank is None:
            i, k = np.nonzero(may & (comps[z, None] < comps[None, :]))
        else:
            distance[~may] = np.iinfo(np.int64).max
            at = min(rank, n - 1)
            k = np.argpartition(distance, at, axis=1)[:, at]
            i = np.arange(len(k))
            near_by = distance[i, k]
            there = near_by < np.iinfo(np.int64).max
            i, k = i[there], k[there]
            far.append(near_by[there])
        xs.append(i + a)
        ys.append(k)
    x, y = np.concatenate(xs), np.concatenate(ys)
    if rank is not None and len(x):  # the nearest of each component's members
        order = np.lexsort((x, np.concatenate(far), comps[x]))
        x, y = x[order], y[order]
        first = np.ones(len(x), bool)
        first[1:] = comps[x[1:]] != comps[x[:-1]]
        x, y = x[first], y[first]
    return x, y, some


def compared(batches: Iterator[pa.RecordBatch], rank: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of rows that come sorted by (key, low, high); see `cross_pairs`."""
    columns = ("cls", "component", "size", "block__", "sketch")
    held: list[list] = [[] for _ in columns]  # the last, perhaps unfinished group
    at: tuple | None = None
    given: set[tuple[int, int]] = set()  # many buckets give the same pairs

    def flush(made: list) -> None:
        if len(held[0]) > 1:
            cls, comps, sizes, blocks = (np.array(held[i], np.int64) for i in range(4))
            x, y, near_by = block_pairs(sizes, held[4], comps, blocks if at[1] != at[2] else None, rank)
            some = set(zip(np.minimum(cls[x], cls[y]).tolist(), np.maximum(cls[x], cls[y]).tolist(), strict=True)) - given
            if len(given) > REMEMBERED:
                given.clear()
            given.update(some)
            if near_by:
                made.append((at[0], None, None))
            made.extend((None, *p) for p in some)
        for part in held:
            part.clear()

    def out(made: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip(("key", "x", "y"), zip(*made, strict=True) if made else ([], [], []), strict=True)})

    for b in batches:
        made: list = []
        values = [b.column(c).to_pylist() for c in columns]
        names = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("key", "low", "high")], axis=1)
        edges = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
        for a, z in zip(edges, edges[1:], strict=False):
            if z > a:
                name = tuple(names[a].tolist())
                if at is not None and at != name:
                    flush(made)
                at = name
                for part, column in zip(held, values, strict=True):
                    part.extend(column[a:z])
        yield out(made)
    made = []
    flush(made)
    yield out(made)


def cross_pairs(buckets: DataFrame, sketches: DataFrame, found: DataFrame, rank: int | None) -> tuple[DataFrame, DataFrame]:
    """(key, x, y): pairs in one bucket but in different components, near enough by sketch, and rows with the key of each
    such bucket; and the number of members of each bucket looked at.

    A bucket without such a pair has none in later rounds either. Large buckets are cut into blocks by a hash, and each
    pair of blocks is a group of its own, so a task holds two blocks at a time. See `block_pairs` for the rank.
    """
    own = found.select(F.col("node").alias("cls"), "component")
    rows = buckets.count()
    named = cut(buckets.join(own, "cls", "left").withColumn("component", F.coalesce("component", "cls")), rows)
    apart = F.min("component") != F.max("component")
    open_ones = cut(named.groupBy("key").agg(apart.alias("apart"), F.count(F.lit(1)).alias("n__"), F.sum("size").alias("shingles__")).where("apart").drop("apart"), rows)
    met = salted_join(named, open_ones, "key", open_ones.select("key", "n__")).join(sketches.drop("size"), "cls")
    blocks = F.greatest(F.ceil(F.col("n__") / BLOCK_ROWS), F.ceil(F.col("shingles__") / BLOCK_SHINGLES)).cast("int")
    split = met.withColumn("blocks__", blocks).withColumn("block__", F.pmod(F.xxhash64("cls"), F.col("blocks__")).cast("int"))
    paired = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks__") - 1)))
    dealt = paired.withColumns({"low": F.least("block__", "other"), "high": F.greatest("block__", "other")}).select("key", "low", "high", "cls", "component", "size", "block__", "sketch")
    sorted_rows = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "component", "cls")
    return sorted_rows.mapInArrow(lambda b: compared(b, rank), "key bigint, x bigint, y bigint"), open_ones.select("key", "n__")


def jaccard_rows(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep + (n_shingles, root, component_id), one row for each row of docs (doc_id, text, ...).

    `root` is a number that linked and equal sets have in common, null for sets that nothing else is linked with.
    """
    sized = cut(set_classes(docs, keep))
    classes = cut(sized.where("n_shingles > 0").groupBy("digest__").agg(F.min("id__").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("cls", F.monotonically_increasing_id()))
    names = classes.select("cls", "rep", "digest__")
    rows = of_classes(keyed_parts(docs), names, "keys").select(F.explode("keys").alias("part"), "cls")
    whole = Window.partitionBy("part")
    met = rows.withColumns({"pivot": F.min("cls").over(whole), "last": F.max("cls").over(whole), "key": F.bit_xor(F.xxhash64("cls")).over(whole)})
    # buckets with the same members are one: their key is a digest of the members
    found = cut(met.where("pivot < last").select("key", "cls", "pivot").distinct())
    own = of_classes(sized.select("id__", "digest__", F.col("n_shingles").alias("size"), F.col("sketch__").alias("sketch")), names.join(found.select("cls").distinct(), "cls", "left_semi"), "size", "sketch")
    sketches = cut(own)
    n_rows = found.count()
    buckets = cut(found.select("key", "cls").join(sketches.select("cls", "size"), "cls"), n_rows)
    stars = cut(found.where("cls > pivot").select(F.col("pivot").alias("x"), F.col("cls").alias("y")).distinct(), n_rows)
    tested = cut(near_pairs(stars, sketches))
    labels = components(verified(tested, docs, names))
    for rank in ROUNDS:
        given, counts = cross_pairs(buckets, sketches, labels, rank)
        given = cut(given)
        left = cut(given.where("key IS NOT NULL").select("key").distinct(), n_rows)
        buckets = cut(salted_join(buckets, left, "key", counts.join(left, "key")), n_rows)
        more = cut(given.where("x IS NOT NULL").select("x", "y").distinct().join(tested, ["x", "y"], "left_anti"), given.count())
        if not more.isEmpty():
            tested, new = tested.unionByName(more), verified(more, docs, names)
            # the components so far stand for the edges they came from
            labels = components(labels.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(new))
    label = labels.select(F.col("node").alias("cls"), F.col("component").alias("root"))
    joined = classes.join(label, "cls", "left").where((F.col("copies") > 1) | F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "cls"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    moved = cut(joined.join(least, "root").select("digest__", "root", "component_id", F.col("copies").alias("n__")))
    out = salted_join(sized.drop("sketch__"), moved.drop("n__"), "digest__", moved.select("digest__", "n__"), "left")
    return out.select(*keep, "n_shingles", "root", F.coalesce("component_id", "id__").alias("component_id"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs (doc_id, text)."""
    return jaccard_rows(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"]).select("doc_id", "n_shingles", "component_id")


def component_report(docs: DataFrame) -> DataFrame:
    """The contract columns of op10."""
    return jaccard_components(docs)


def one_of_each(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Of each component one row: the one with the least doc_id, null last, and of these with the least digest of its text.

    Rows are told apart by doc_id and text; of rows equal in both one is kept. Texts without words are all kept.
    """
    key = ["id__", "none__", "text_md5__"]
    keyed = docs.withColumns({"id__": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "none__": F.col("doc_id").isNull(), "text_md5__": F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))})
    rows = jaccard_rows(keyed.select("doc_id", "text", F.col("id__").alias("k__"), "none__", "text_md5__"), ["k__", "none__", "text_md5__"]).withColumnRenamed("k__", "id__")
    first = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("none__", "id__", "text_md5__")).alias("f"))
    kept = first.select("f.*").select(*key, F.lit(True).alias("once__")).unionByName(rows.where("root IS NULL").select(*key, F.lit(False).alias("once__")).distinct())
    found = keyed.join(kept, key).withColumn("row__", F.when(F.col("once__"), F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    return found.dropDuplicates([*key, "row__"]).select(*columns)

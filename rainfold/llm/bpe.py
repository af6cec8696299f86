"""Byte-level BPE encoding and decoding of whole texts with a given vocabulary of ranks.

Texts of up to `chunk_chars` characters are one piece. Longer ones are cut into overlapping chunks, which are
pre-tokenised in parallel; where the pre-token boundaries of a chunk and of the one before it first meet in the overlap,
the two are stitched, and the pieces between the stitches are encoded in parallel and put together again. A stitch only
lies behind a character that is not white space: the pattern's one look-ahead concerns white space, so a piece alone has
the same pre-tokens as in its text. A text with a chunk that does not meet the one before it in the overlap (a run of
many thousand letters, say) is encoded as one piece, so every text gets the ids of an undivided encoding.

Null and empty texts have no ids. Repeated rows and repeated doc_ids each give a row of their own; an empty table gives none.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainfold.llm.common import batch_of, fields, slices, with_input

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK_CHARS, OVERLAP = 16384, 512
#: Characters that pattern libraries of different Unicode versions may class differently; no stitch lies beside one.
UNSURE = regex.compile("[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7f1\uab6c\uab6d\U00010000-\U0001efff\U00020000-\U0010ffff]")


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    known = ranks(path)
    out = [b""] * (max(known.values()) + 1)
    for raw, i in known.items():
        out[i] = raw
    return out


def boundaries(text: str) -> list[int]:
    """Ends of the pre-tokens of a text."""
    return [m.end() for m in regex.finditer(public_tokenizers.PATTERN, text)]


def cut_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Chunks from each multiple of `size`, each with `overlap` characters of the next one."""
    return [text[a : a + size + overlap] for a in range(0, len(text), size)]


def meeting_points(chunk: str, size: int, overlap: int, last: bool) -> tuple[list[int], list[int]]:
    """Boundaries behind a visible character: those within the overlap with the chunk before, and with the next one.

    Both count from the start of their overlap.
    """
    ends = [b for b in boundaries(chunk) if (b < len(chunk) or last) and not chunk[b - 1].isspace() and not UNSURE.search(chunk, b - 1, b + 1)]
    return [b for b in ends if b <= overlap], [b - size for b in ends if size < b <= size + overlap]


def _ids(texts: Sequence[str], path: str) -> pa.ListArray:
    found = [encoding(path).encode_to_numpy(t) if t else np.empty(0, np.uint32) for t in texts]
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    flat = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode_pieces(df: DataFrame, text: str, keep: Sequence[str], path: str) -> DataFrame:
    """keep + (ids ARRAY<INT>): each text encoded by itself."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, [name]):
            yield batch_of(b, keep, ids=_ids([t or "" for t in b.column(name).to_pylist()], path))

    made, name = with_input(df, keep, text, "text__")
    return made.mapInArrow(kernel, ", ".join(filter(None, [fields(df, keep), "ids array<int>"])))


def encode(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), path: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """keep + (ids ARRAY<INT>): the ids of every whole text. `keep` names small columns; they travel with the chunks."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text__"))
    long_text = F.char_length("text__") > chunk_chars
    short = encode_pieces(rows.where(~long_text), "text__", keep, path)

    # A row's number holds for this scan only; it tells repeated rows apart.
    long_rows = rows.where(long_text).select(F.monotonically_increasing_id().alias("row__"), F.struct(F.lit(0), *keep).alias("kept__"), "text__")

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ["text__"], 16):
            for i, whole in enumerate(b.column("text__").to_pylist()):
                parts = cut_chunks(whole, chunk_chars, overlap)
                one = b.slice(i, 1)
                for a in range(0, len(parts), 64):
                    some = parts[a : a + 64]
                    again = one.take(pa.array([0] * len(some)))
                    yield batch_of(again, ["row__", "kept__"], no=pa.array(range(a, a + len(some)), pa.int32()), last=pa.array([a + j == len(parts) - 1 for j in range(len(some))]), chunk=pa.array(some))

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ["chunk"]):
            met = [meeting_points(c, chunk_chars, overlap, z) for c, z in zip(b.column("chunk").to_pylist(), b.column("last").to_pylist(), strict=True)]
            yield batch_of(b, ["row__", "kept__", "no", "last", "chunk"], head=pa.array([h for h, _ in met], pa.list_(pa.int32())), tail=pa.array([t for _, t in met], pa.list_(pa.int32())))

    base = fields(long_rows, ["row__", "kept__"])
    chunks = long_rows.mapInArrow(chunk, f"{base}, no int, last boolean, chunk string").repartition("row__", "no")
    met = chunks.mapInArrow(pretokenise, f"{base}, no int, last boolean, chunk string, head array<int>, tail array<int>")
    order, whole = Window.partitionBy("row__").orderBy("no"), Window.partitionBy("row__")
    start = F.when(F.col("no") == 0, 0).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    stitched = met.withColumn("start", start).withColumn("end", F.lead("start").over(order) + chunk_chars).withColumn("apart", F.max(F.col("start").isNull()).over(whole))
    piece = F.substring("chunk", F.col("start") + 1, F.coalesce(F.col("end"), F.char_length("chunk")) - F.col("start"))
    in_pieces = stitched.where(~F.col("apart")).select("row__", "kept__", "no", piece.alias("piece"))
    undivided = (
        stitched.where("apart")
        .groupBy("row__")
        .agg(F.first("kept__").alias("kept__"), F.sort_array(F.collect_list(F.struct("no", F.substring("chunk", 1, chunk_chars).alias("part")))).alias("parts"))
        .select("row__", "kept__", F.lit(0).alias("no"), F.array_join("parts.part", "").alias("piece"))
    )
    coded = encode_pieces(in_pieces.unionByName(undivided).repartition("row__", "no"), "piece", ["row__", "kept__", "no"], path)
    joined = coded.groupBy("row__").agg(F.first("kept__").alias("kept__"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(joined.select(*[F.col(f"kept__.{c}").alias(c) for c in keep], "ids"))


def decode(df: DataFrame, ids: str = "ids", keep: Sequence[str] = ("doc_id",), path: str | None = None) -> DataFrame:
    """keep + (decoded BINARY): the raw bytes of each id, one after another. Bytes, as ids may end within a character."""
    path = path or public_tokenizers.path(VOCABULARY)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = token_bytes(path)
        for b in slices(batches, [name]):
            out = [b"".join(map(raw.__getitem__, x or ())) for x in b.column(name).to_pylist()]
            yield batch_of(b, keep, decoded=pa.array(out, pa.binary()))

    made, name = with_input(df, keep, ids, "ids__")
    return made.mapInArrow(kernel, ", ".join(filter(None, [fields(df, keep), "decoded binary"])))


def encoded_digest(docs: DataFrame) -> DataFrame:
    """Every whole text encoded and decoded again: the contract columns of op2."""
    coded = encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "ids")
    return decode(coded, "ids", ["doc_id", "n_tokens", "ids_sha256"]).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))

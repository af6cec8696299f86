"""Language identification by compression with a zstandard raw-content dictionary for each language.

`learn` takes, for every language, the whole-table sample of at most `SAMPLE_ROWS` rows (a documented bound: the row
with the least hash in each of so many buckets, so any executor finds the same rows) and keeps up to `SAMPLE_CHARS`
characters of each as a raw-content dictionary: a block from each of `SAMPLE_BLOCKS` equal stretches of its text. `classify` compresses every whole text (its words in small letters), in
blocks, with each dictionary;
the language whose frames are smallest in sum wins, and the margin to the second decides whether the text is rejected.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the language first by code
point; with no labelled row all texts are `und`; with one language the score is 1. Repeated rows give a row each with equal
values and count once in the sample; an empty table gives an empty result. More than MAX_LANGUAGES languages raise a
ValueError, as the dictionaries are sent to every task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainfold.llm.common import batch_of, fields, slices, with_input

SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_BLOCKS, MAX_LANGUAGES = 96, 1024, 4, 256
LEVEL, BLOCK = 12, 1 << 12
#: A text whose best language saves less than this share of the bytes of the second is rejected.
MARGIN = 0.02
LETTER, OTHER = regex.compile(r"\p{L}"), re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def plain(text: str) -> bytes:
    """Small letters with single spaces between words: case, digits and marks say nothing about a language."""
    return OTHER.sub(" ", text.lower()).encode()


def spread_sample(text: str, seed: str, chars: int) -> Column:
    """The text, or where it is longer than `chars` a block from each stretch of it, placed by a hash of `seed`."""
    n, size = F.length(text), chars // SAMPLE_BLOCKS

    def block(i: int) -> Column:
        first, end = (F.floor(n * F.lit(k) / SAMPLE_BLOCKS).cast("int") for k in (i, i + 1))
        free = F.greatest(F.lit(1), end - first - size + 1)
        return F.substring(F.col(text), first + 1 + F.pmod(F.xxhash64(seed, F.lit(i)), free).cast("int"), F.lit(size))

    return F.when(n <= chars, F.col(text)).otherwise(F.concat_ws(" ", *map(block, range(SAMPLE_BLOCKS))))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionary bytes by language, from the labelled rows of df."""
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    keyed = labelled.withColumns({"hash__": F.xxhash64(key), "bucket__": F.pmod(F.xxhash64(key, F.lit(1)), F.lit(rows)).cast("int")})
    least = keyed.groupBy(F.col(lang).alias("lang__"), "bucket__").agg(F.min("hash__").alias("hash__"))
    most = MAX_LANGUAGES * rows
    chosen = least.limit(most + 1).collect()  # no more, however many values the column holds
    if len(chosen) > most or len({r["lang__"] for r in chosen}) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages; at most so many dictionaries are sent to the tasks")
    if not chosen:
        return {}
    hashes = sorted({r["hash__"] for r in chosen})
    picked = keyed.where(F.col("hash__").isin(hashes)).groupBy(F.col(lang).alias("lang__"), "bucket__", "hash__").agg(F.min(spread_sample(text, "hash__", chars)).alias("part"))
    wanted = {(r["lang__"], r["bucket__"], r["hash__"]) for r in chosen}
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in picked.collect():
        if (r["lang__"], r["bucket__"], r["hash__"]) in wanted:
            parts.setdefault(r["lang__"], []).append((r["bucket__"], r["part"]))
    return {name: b" ".join(plain(p) for _, p in sorted(found)) for name, found in sorted(parts.items())}


def classify(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", keep: Sequence[str] = ("doc_id",), margin: float = MARGIN) -> DataFrame:
    """keep + (lang_pred STRING, score DOUBLE, rejected BOOLEAN)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(dictionaries)
        packers = []
        for known in names:
            raw = zstandard.ZstdCompressionDict(dictionaries[known], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False))
        for b in slices(batches, [name]):
            pred, score, rejected = [], [], []
            for t in b.column(name).to_pylist():
                if not t or not names or not LETTER.search(t):
                    best, s, no = UNKNOWN, 0.0, True
                else:
                    raw = memoryview(plain(t))
                    sizes = np.array([sum(len(p.compress(raw[a : a + BLOCK])) for a in range(0, len(raw), BLOCK)) for p in packers], float)
                    at = int(sizes.argmin())
                    second = np.delete(sizes, at).min(initial=np.inf)
                    s = 1.0 if np.isinf(second) else float(1 - sizes[at] / second)
                    best, no = names[at], s < margin
                pred.append(best)
                score.append(s)
                rejected.append(no)
            yield batch_of(b, keep, lang_pred=pa.array(pred, pa.string()), score=pa.array(score, pa.float64()), rejected=pa.array(rejected, pa.bool_()))

    made, name = with_input(df, keep, text, "text__")
    return made.mapInArrow(kernel, ", ".join(filter(None, [fields(df, keep), "lang_pred string, score double, rejected boolean"])))


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def language_report(docs: DataFrame) -> DataFrame:
    """The contract columns of op3, learnt from the rows that aren't held out, and whether the margin is too narrow."""
    split = docs.select("doc_id", held_out().alias("held_out"), "lang", "text")
    return classify(split, learn(split.where(~F.col("held_out"))), "text", ["doc_id", "held_out"])

"""Phrase collocation mining: n-grams as rows, counted by language, scored by their weakest cut.

Method. Texts are cut at punctuation and line ends into pieces and those into words. The n-grams of pieces, of one word up to
`max_words`, become rows (lang, phrase, count), counted by a hash aggregation. A phrase's score is that of its worst cut into two
parts, whose counts are joined; phrases that a one-word extension of equal count holds are taken out by an anti-join; windows
rank the rest.

What is not exploded. A phrase of `least` occurrences holds no pair of neighbours with fewer, so a first pass counts pairs by
64-bit hashes, and the second explodes n-grams of two and more words only where all their pairs reach `least`. The hashes that do so
go to the tasks as a Bloom filter of a fixed size: what it, or a clash of hashes, lets pass too much is counted by its words and falls
short of `least`. So results rest on the phrases' own counts over all texts, whatever passes the filter.

Why one-word extensions are enough: if a longer phrase holds this one and occurs as often, so does each phrase between them.

Exactness: scores are whole numbers found in DECIMAL(38, 0), which holds 1000 * a * n for any corpus below 3 * 10**17 words.

Memory: a task counts n-grams in blocks of about `BLOCK` words under whole numbers, so what repeats within a block is one row; a block
ends with the text that fills it. Ranks: each of many groups of a language gives its own first rows, and only these meet in one
task.

Defined results: null texts have no words; texts of one word give no phrase; null languages are `und`; repeated rows count each;
ties go by count, then by the phrase's bytes; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rainfold.llm.common import cut, in_batches, slices
from rainfold.llm.near_duplicates import bloom_filter, may_hold, mixed

#: Words that a task counts at a time, and groups that a language's phrases are ranked in at first.
BLOCK, RANK_GROUPS = 1_000_000, 64
_UPPER, _BREAKS = bytes(range(65, 91)), b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_UPPER + _BREAKS + b"\t", _UPPER.lower() + b"." * len(_BREAKS) + b" ")

class Block:
    """Texts as numbers: each word has one by its first place among the distinct words, and 0 ends a piece."""

    def __init__(self) -> None:
        self.names: dict[bytes, int] = {b".": 0}
        self.langs: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.tongues: list[int] = []
        self.size = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        self.parts.append(np.fromiter((self.names.setdefault(w, len(self.names)) for w in words), np.int32, len(words)))
        self.tongues.append(self.langs.setdefault(lang, len(self.langs)))
        self.size += len(words)

    def ids(self) -> np.ndarray:
        return np.concatenate(self.parts).astype(np.int64)

    def tongue(self) -> np.ndarray:
        """The language's number at each place."""
        return np.repeat(np.array(self.tongues, np.int64), [len(p) for p in self.parts])


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in order, and b"." wherever a piece ends."""
    return [*(text or "").encode().translate(_TABLE).replace(b".", b" . ").split(), b"."]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    block = Block()
    for b in slices(batches, ["text__"], 512, 2 << 20):
        for lang, text in zip(b.column("lang__").to_pylist(), b.column("text__").to_pylist(), strict=True):
            block.add(lang, words_of(text))
            if block.size >= BLOCK:
                yield block
                block = Block()
    if block.size:
        yield block


def _texts(docs: DataFrame) -> DataFrame:
    return in_batches(docs).select(F.coalesce("lang", F.lit("und")).alias("lang__"), F.col("text").alias("text__"))


def _pairs(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """At each place a hash of the language, the word and the next one, and whether these are two words of a piece."""
    ids = block.ids()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, block.names), np.uint64, len(block.names))[ids]
    tongue = np.fromiter((xxhash.xxh3_64_intdigest(lang) for lang in block.langs), np.uint64, len(block.langs))[block.tongue()]
    pair = np.zeros(len(ids), bool)
    pair[:-1] = (ids[:-1] > 0) & (ids[1:] > 0)
    return mixed(mixed(each + tongue) + np.roll(each, -1)), pair


def pair_counts(docs: DataFrame) -> DataFrame:
    """(pair BIGINT, n BIGINT): occurrences of neighbours by a hash of language and words."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            keys, pair = _pairs(block)
            found, n = np.unique(keys[pair], return_counts=True)
            for at in range(0, len(found), 1 << 16):
                yield pa.RecordBatch.from_pydict({"pair": pa.array(found[at : at + (1 << 16)].view(np.int64)), "n": pa.array(n[at : at + (1 << 16)].astype(np.int32))})

    return _texts(docs).mapInArrow(kernel, "pair bigint, n int").groupBy("pair").agg(F.sum("n").alias("n"))


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of each key among them, and how often each occurs."""
    return np.unique(keys, return_inverse=True, return_counts=True)


def _grams(block: Block, pair: np.ndarray, max_words: int) -> Iterator[tuple[list[str], list[bytes], np.ndarray]]:
    """(lang, phrase, count) of the block's n-grams of each length, of those only whose neighbours are all in `pair`."""
    spelled, spoken, each = list(block.names), list(block.langs), block.ids()
    at = np.flatnonzero(each)
    found, place, n = _numbered(block.tongue()[at] * len(spelled) + each[at])
    own = [spoken[k // len(spelled)] for k in found.tolist()]
    phrases = [spelled[k % len(spelled)] for k in found.tolist()]
    yield own, phrases, n
    for size in range(2, max_words + 1):
        more = pair[at + size - 2]  # whether the last word of the gram at each place has a neighbour
        at, place = at[more], place[more]
        if not len(at):
            return
        found, place, n = _numbered(place * len(spelled) + each[at + size - 1])
        before, last = (found // len(spelled)).tolist(), (found % len(spelled)).tolist()
        own = [own[k] for k in before]
        phrases = [phrases[k] + b" " + spelled[w] for k, w in zip(before, last, strict=True)]
        yield own, phrases, n


def gram_counts(docs: DataFrame, max_words: int = 5, least: int = 1) -> DataFrame:
    """(lang, phrase, words INT, n BIGINT): single words, and all phrases of at most max_words words and `least` occurrences.

    Rarer phrases may be among them.
    """
    frequent = cut(pair_counts(docs).where(F.col("n") >= least).select("pair")) if least > 1 else None
    known = None if frequent is None else docs.sparkSession.sparkContext.broadcast(bloom_filter(frequent, "pair").tobytes())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if known is None else np.frombuffer(known.value, np.uint8)
        for block in _blocks(batches):
            keys, pair = _pairs(block)
            if bits is not None:
                some = np.flatnonzero(pair)
                pair[some] = may_hold(bits, keys[some])
            for size, (own, phrases, n) in enumerate(_grams(block, pair, max_words), 1):
                for i in range(0, len(n), 1 << 15):
                    part = slice(i, i + (1 << 15))
                    yield pa.RecordBatch.from_pydict({"lang": pa.array(own[part], pa.string()), "phrase": pa.array(phrases[part], pa.binary()).cast(pa.string()), "words": pa.array(np.full(len(n[part]), size, np.int32)), "n": pa.array(n[part].astype(np.int64))})

    rows = _texts(docs).mapInArrow(kernel, "lang string, phrase string, words int, n bigint")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of phrases of two and more words by their worst cut; counts are (lang, phrase, words, a, n).

    All parts of a phrase have to be among the counts, which holds where they are all phrases of so many occurrences.
    """
    parts = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, 1, k), " ").alias("left"), F.array_join(F.slice(parts, k + 1, F.col("words") - k), " ").alias("right")))
    each = counts.where("words > 1").withColumn("cut", F.explode(cuts)).select("lang", "phrase", "words", "a", "n", "cut.*")
    for side, name in (("left", "l"), ("right", "r")):
        each = each.join(counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    score = F.expr("(1000BD * CAST(a AS DECIMAL(18, 0)) * CAST(n AS DECIMAL(18, 0))) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))")
    worst = each.withColumn("score", score).groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    return worst.select("lang", "phrase", "words", "a", "worst.l", "worst.r", "n", "worst.score")


def without_held(phrases: DataFrame) -> DataFrame:
    """The phrases (lang, phrase, words, a) that no one-word extension among them with as many occurrences holds."""
    parts = F.split("phrase", " ")
    held = F.array(F.array_join(F.slice(parts, 1, F.col("words") - 1), " "), F.array_join(F.slice(parts, 2, F.col("words") - 1), " "))
    inner = phrases.where("words > 2").select("lang", F.explode(held).alias("phrase"), F.col("a").alias("more")).groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    return phrases.join(inner, ["lang", "phrase"], "left").where("more IS NULL OR more < a").drop("more")


def collocations(docs: DataFrame, max_words: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` phrases of two to max_words words."""
    grams = cut(gram_counts(docs, max_words, least).where((F.col("words") == 1) | (F.col("n") >= least)))
    totals = grams.where("words = 1").groupBy("lang").agg(F.sum("n").cast("long").alias("n"))
    counts = cut(grams.where(F.col("n") >= least).withColumnRenamed("n", "a").join(totals, "lang"))
    found = without_held(scored(counts))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = found.withColumn("group__", F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "group__").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

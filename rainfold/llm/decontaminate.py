"""Benchmark decontamination by winnowed fingerprints, in DataFrame functions only.

Method. A text is its words: ASCII letters, small, digits, and all characters beyond ASCII; all else parts them. Of a window of n
words the fingerprints are the hashes of its (n + 1) div 2 words long grams that are least among all that the window holds; of
a text, those of all its windows. So a window that two texts share gives both the same fingerprints, and no shared span of n words
goes unseen. Fingerprints of texts and items are joined by hash; each match is extended to both sides, word by word, as far as a window
that holds the gram can reach, and counts if the equal words are a whole window. Unions of these spans are all words hit.

Items of n < `window` words are one window of n words; for each such n that occurs, texts get the fingerprints of that length too.

Shuffles. Items' hashes are broadcast if there are at most `BROADCAST_HASHES` of them (8 bytes each), so texts meet them without a
shuffle; else both sides are shuffled by hash, and the adaptive planner splits hot hashes. Only texts with a match are then asked
for the words about it: the matches are a written table, broadcast up to `BROADCAST_MARKS` of them, else joined by digests of which
hot ones are salted. Items that share a passage meet a text once, as one context with a set of items. Equal texts are told by a
digest of their words, so copies of a text are matched as one.

Memory: a text's words and hashes are arrays of its row; of a text's matches no more come together than it has words.

Defined results: null and empty texts have no words and no hits; repeated rows give a row each; items without words are
never found; items are told apart by item_id, and one without an id takes part in hits, but neither count nor list has it. Without
items nothing is hit; an empty table of documents gives an empty result. Columns beyond those named are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainfold.llm.common import cut
from rainfold.operators.graph import salted_join

WINDOW = 10
#: Hashes of items up to which they are broadcast, 16 MB of numbers.
BROADCAST_HASHES = 2_000_000
#: Matches, or hit texts and their items, up to which they are broadcast, some 30 bytes each.
BROADCAST_MARKS = 500_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal(text: Column) -> Column:
    """The words of a text with a space between them."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), NO_WORD, " "))


def words(of: str) -> Column:
    return F.when(F.col(of) == "", F.array().cast("array<string>")).otherwise(F.split(of, " "))


def gram_words(n: int) -> tuple[int, int]:
    """Of windows of n words: the words of a gram, and the grams of a window."""
    k = (n + 1) // 2
    return k, n - k + 1


def _grams(n: int, k: int) -> Column:
    return F.transform("starts__", lambda x, i: F.xxhash64(F.lit(n), x, *[F.get("hashes__", i + j) for j in range(1, k)]))


def _least(w: int) -> Column:
    """The least gram of each window."""
    if w == 1:
        return F.col("windows__")
    return F.transform("windows__", lambda x, i: F.least(x, *[F.get("grams__", i + j) for j in range(1, w)]))


def _chosen(n: int, w: int) -> Column:
    """Grams that are the least of a window they are in; the leasts of these windows are at most the gram itself."""

    def mark(x: Column, i: Column) -> Column:
        most = F.greatest(*[F.get("least__", i - j) for j in range(w)]) if w > 1 else F.get("least__", i)
        return F.when(x == most, F.struct(F.lit(n).alias("n"), i.alias("p"), x.alias("h")))

    return F.filter(F.transform("grams__", mark), lambda m: m.isNotNull())


def with_fingerprints(df: DataFrame, lengths: list[int], by: Column | None = None) -> DataFrame:
    """df (..., words) + (marks ARRAY<STRUCT<n, p, h>>): the fingerprints of windows of each length, of one only where `by` has its length."""
    df = df.withColumn("hashes__", F.transform("words", lambda w: F.xxhash64(w)))
    for n in lengths:
        k, w = gram_words(n)
        size = F.size("hashes__")
        there = size >= n if by is None else (size >= n) & (by == n)
        df = df.withColumn("starts__", F.slice("hashes__", 1, F.when(there, size - (k - 1)).otherwise(0)))
        df = df.withColumn("grams__", _grams(n, k))
        df = df.withColumn("windows__", F.slice("grams__", 1, F.greatest(F.size("grams__") - (w - 1), F.lit(0))))
        df = df.withColumn("least__", _least(w))
        df = df.withColumn(f"marks{n}__", _chosen(n, w)).drop("starts__", "grams__", "windows__", "least__")
    out = F.concat(*[F.col(f"marks{n}__") for n in lengths]) if lengths else F.array().cast("array<struct<n:int,p:int,h:bigint>>")
    return df.withColumn("marks", out).drop("hashes__", *[f"marks{n}__" for n in lengths])


def exploded(df: DataFrame, *keep: str) -> DataFrame:
    """keep + (m), a row for each of marks. The plain explode would have its arrays found once more, and nested, in a filter below."""
    return df.select(*keep, F.explode_outer("marks").alias("m")).where("m IS NOT NULL")


def context(n: Column, p: Column) -> Column:
    """The gram of a fingerprint, and the words before, the nearest first, and after it that a window with it may hold."""
    k = F.floor((n + 1) / 2).cast("int")
    w = n - k + 1
    start = F.greatest(p - (w - 1), F.lit(0))
    return F.struct(F.reverse(F.slice("words", start + 1, p - start)).alias("before"), F.slice("words", p + 1, k).alias("gram"), F.slice("words", p + k + 1, w - 1).alias("after"))


def equal_run(a: str, b: str) -> Column:
    """How many words two arrays have in common from their first on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")


def item_contexts(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h, n, before, gram, after, items): each distinct context of a fingerprint with the ids of the items that have it."""
    rows = items.select("item_id", normal(F.col("text")).alias("norm__")).where("norm__ <> ''").select("item_id", words("norm__").alias("words"))
    rows = cut(rows.withColumn("own_n__", F.least(F.size("words"), F.lit(window))))
    lengths = [r["own_n__"] for r in rows.select("own_n__").distinct().collect()]  # at most `window`
    marked = with_fingerprints(rows, sorted(lengths), F.col("own_n__"))
    each = exploded(marked, "item_id", "words").select("item_id", F.col("m.h").alias("h"), F.col("m.n").alias("n"), context(F.col("m.n"), F.col("m.p")).alias("c"))
    return each.select("item_id", "h", "n", "c.*").groupBy("h", "n", "before", "gram", "after").agg(F.collect_set("item_id").alias("items"))


def documents_with_words(docs: DataFrame) -> DataFrame:
    """(doc_id, digest BINARY, n_words BIGINT, norm): a written table."""
    made = docs.select("doc_id", normal(F.col("text")).alias("norm"))
    n = F.when(F.col("norm") == "", F.lit(0)).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1)
    return cut(made.select("doc_id", F.unhex(F.md5(F.col("norm").cast("binary"))).alias("digest"), n.cast("long").alias("n_words"), "norm"))


def by_digest(texts: DataFrame, values: DataFrame, sized: str, how: str = "inner") -> DataFrame:
    """Texts joined with a written table of one row a digest, of which the array `sized` is the large column."""
    rows, total = values.agg(F.count(F.lit(1)), F.sum(F.size(sized))).first()
    if rows + (total or 0) <= BROADCAST_MARKS:
        return texts.join(F.broadcast(values), "digest", how)
    copies = cut(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n__")).join(values.select("digest"), "digest", "left_semi"))
    return salted_join(texts, values, "digest", copies, how)


def hits(texts: DataFrame, contexts: DataFrame, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """(digest, first, past, items): spans of whole windows in texts (digest, norm), and the ids of items that hold the span."""
    lengths = [r["n"] for r in contexts.select("n").distinct().orderBy("n").collect()]  # at most `window`
    some = texts.where("norm <> ''").select("digest", words("norm").alias("words"))
    marks = exploded(with_fingerprints(some, lengths), "digest").select("digest", F.col("m.h").alias("h"), "m")
    hashes = contexts.select("h").distinct()
    few = contexts.count() <= broadcast_hashes
    met = marks.join(F.broadcast(hashes) if few else hashes, "h", "left_semi")
    matched = cut(met.groupBy("digest").agg(F.collect_set("m").alias("marks")))
    about = by_digest(texts.select("digest", "norm"), matched, "marks").select("digest", words("norm").alias("words"), "marks")
    about = exploded(about, "digest", "words")
    found = about.select("digest", F.col("m.h").alias("h"), F.col("m.n").alias("n"), F.col("m.p").alias("p"), context(F.col("m.n"), F.col("m.p")).alias("c"))
    found = found.select("digest", "h", "n", "p", F.col("c.before").alias("before__"), F.col("c.gram").alias("gram__"), F.col("c.after").alias("after__"))
    both = found.join(F.broadcast(contexts) if few else contexts, ["h", "n"]).where(F.col("gram__") == F.col("gram"))
    long = both.withColumns({"left__": equal_run("before__", "before"), "right__": equal_run("after__", "after")}).where(F.col("left__") + F.size("gram") + F.col("right__") >= F.col("n"))
    return long.select("digest", (F.col("p") - F.col("left__")).alias("first"), (F.col("p") + F.size("gram") + F.col("right__")).alias("past"), "items")


def covered(spans: Column) -> Column:
    """How many places an array of (first, past) covers."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), start, lambda a, s: F.struct(F.greatest(a["upto"], s["past"]).alias("upto"), (a["n"] + F.greatest(s["past"] - F.greatest(a["upto"], s["first"]), F.lit(0))).alias("n")), lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """(doc_id, n_words, n_hit, items ARRAY): each document's words, those inside a window of an item, and the items, sorted."""
    texts, contexts = documents_with_words(docs), cut(item_contexts(items, window))
    spans = hits(texts, contexts, broadcast_hashes)
    each = spans.groupBy("digest").agg(F.collect_set(F.struct("first", "past")).alias("spans"), F.collect_set("items").alias("items"))
    found = each.select("digest", covered(F.col("spans")).alias("n_hit"), F.array_sort(F.array_distinct(F.transform(F.flatten("items"), lambda x: x.cast("string")))).alias("items"))
    out = by_digest(texts.select("doc_id", "digest", "n_words"), cut(found), "items", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract columns of op12."""
    made = contamination(docs, items)
    return made.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

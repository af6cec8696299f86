"""A corpus pipeline: language, quality, near duplicates, mixing, tokens. Each stage's rows are written and read again."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainfold.llm import bpe, host_quality, language, mixing, near_duplicates
from rainfold.plans.store import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs + what tells its rows apart, whatever their doc_ids: rows that agree in all of KEY are the same document."""
    return docs.withColumns({"id__": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "rest__": F.to_json(F.struct(F.col("doc_id").isNull().alias("none"), "lang", "source", "n_chars", F.col("text").isNull().alias("empty"))), "text__md5": F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))})


KEY = ["id__", "rest__", "text__md5"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language shows by a clear margin; those without a letter, null or empty ones, or with a narrow margin go.

    Of equal sizes the language first by code point counts, with a margin of 0, so ties go. Repeated rows share their verdict; an
    empty table gives none.
    """
    dictionaries = language.learn(docs.where(~language.held_out()))
    return language.classify(docs, dictionaries, "text", COLUMNS).where(~F.col("rejected")).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, with the labels of the folder, does not reject.

    Each row is judged by its own text and site, whatever its doc_id; rows that agree in all columns share their verdict. Texts
    without a word go, a quality just at the limit stays, an empty table gives none.
    """
    made = keyed(docs)
    host, path = host_quality.document_levels()
    judged = host_quality.quality(made, table(spark, sf_dir, "labels"), host, path, keep=KEY)
    fine = judged.where(~F.col("rejected")).select(*KEY).distinct()
    return made.join(fine, KEY, "left_semi").select(*COLUMNS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles, that with the least doc_id, null last; of repeated rows one.

    Null and empty texts are linked with nothing and all stay; an empty table gives none.
    """
    return near_duplicates.one_of_each(docs, COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, to the nearest whole number; some not at all.

    Rows that agree in all columns are taken together. Null and empty texts have no words and go, as the mix takes no word
    of them. Ties of sampling keys go by doc_id and size. An empty table gives none.
    """
    made = keyed(docs)
    taken = mixing.mix(mixing.with_sizes(made, keep=KEY))
    each = F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    copies = taken.groupBy(*KEY).agg(F.sum(each).alias("copies__"), F.count(F.lit(1)).alias("rows__")).where("copies__ > 0")
    rows = made.join(copies, KEY)
    # of rows that agree in all columns the first bears the copies of all
    lone = rows.where("rows__ = 1").unionByName(rows.where("rows__ > 1").dropDuplicates(KEY))
    return lone.withColumn("copy__", F.explode(F.sequence(F.lit(1), F.col("copies__").cast("int")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256) of every row; null and empty texts have no ids.

    Repeated rows give a row each, however long their texts; an empty table gives none.
    """
    keep = ["doc_id", "lang", "source"]
    coded = bpe.encode(docs, "text", keep).withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.array_join("ids", ","), 256)})
    back = bpe.decode(coded, "ids", [*keep, "n_tokens", "ids", "ids_sha256"])
    return back.select(*keep, "n_tokens", "ids", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", known_language),
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_near_duplicates),
    ("mixing sources to target weights", mixed_sources),
    ("byte-level BPE encoding and decoding", tokens),
]
#: Compression, regression and sketches are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is a Parquet table in the folder of spark.checkpoint.dir."""
    folder = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = os.path.join(folder, str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

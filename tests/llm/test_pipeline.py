"""The stages of the corpus pipeline, each against a plain version."""

from collections import Counter

import corpus_pipeline
import pytest
from test_operators import brute_components, encoder

from rainfold.llm import host_quality, language, mixing


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    at, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{at}/{k}")
        out.append(spark.read.parquet(f"{at}/{k}"))
    return out


def test_filters(spark, sf_dir, stages):
    docs, known, good, unique = stages[:4]
    assert all(set(x.columns) == set(docs.columns) for x in (known, good, unique, stages[4]))
    rejected = language.classify(docs, language.learn(docs.where(~language.held_out()))).where("rejected").select("doc_id")
    assert Counter(known.collect()) == Counter(docs.join(rejected, "doc_id", "left_anti").select(*known.columns).collect())
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    low = host_quality.quality(known, labels, *host_quality.document_levels()).where("rejected").select("doc_id")
    assert Counter(good.collect()) == Counter(known.join(low, "doc_id", "left_anti").select(*good.columns).collect())
    found = brute_components([(r["doc_id"], r["text"]) for r in good.collect()])
    assert {r["doc_id"] for r in unique.collect()} == {root for _, _, root in found}
    assert unique.count() == len({root for _, _, root in found})


def test_mix_and_tokens(stages):
    unique, mixed, coded = stages[3:]
    taken = {r["doc_id"]: round(r["taken"] / max(1, r["size"])) for r in mixing.mix(mixing.with_sizes(unique)).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in taken.items() if v})
    lib = encoder()
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    rows = coded.collect()
    assert len(rows) == mixed.count()
    assert all(r["ids"] == lib.encode_ordinary(text[r["doc_id"]]) for r in rows)


LETTERS = "plain words of a text that say this and that in good english "


def odd_documents(spark):
    """Null and empty texts, null ids, a repeated row, one id with two texts, a very long text, columns whose names clash."""
    rows = [(1, None, None, None, None), (None, LETTERS * 2, "en", "s", 3), (2, "", "", "", 0), (3, LETTERS * 9, "en", "s", 1), (3, LETTERS * 9, "en", "s", 1), (5, "a first text of the very same id, long enough to tell its language", "en", "t", 2), (5, "the other text that bears this id as well, with words of its own", "en", "t", 2), (6, LETTERS * 20000, "en", None, 9)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "1 AS size", "2 AS component_id", "'k' AS id__1", "0 AS root", "1.5D AS quality")


def test_odd_rows(spark, sf_dir):
    docs = odd_documents(spark)
    stage = dict(corpus_pipeline.STAGES)

    def run(name, df=docs):
        made = stage[name](spark, df, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == corpus_pipeline.COLUMNS
        return Counter((r["doc_id"], (r["text"] or "")[:40]) for r in made.collect())

    known = run("language ID", docs.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "1 AS size", "2 AS component_id", "'k' AS id__1", "0 AS root", "1.5D AS quality")))
    assert known[3, LETTERS[:40]] == 2 and not [k for k in known if not k[1]]
    good = run("quality classifier")  # too few labels: only texts without a word go
    assert good == Counter({(None, LETTERS[:40]): 1, (3, LETTERS[:40]): 2, (5, "a first text of the very same id, long en"[:40]): 1, (5, "the other text that bears this id as well"[:40]): 1, (6, LETTERS[:40]): 1})
    unique = run("n-gram Jaccard join")
    assert unique == Counter({(1, ""): 1, (2, ""): 1, (3, LETTERS[:40]): 1, (5, "a first text of the very same id, long en"[:40]): 1, (5, "the other text that bears this id as well"[:40]): 1})
    mixed = run("mixing sources to target weights")
    assert set(mixed) <= set(good) and all(text for _, text in mixed)
    for name, made in corpus_pipeline.STAGES:
        assert made(spark, docs.limit(0), sf_dir).count() == 0
    coded = stage["byte-level BPE encoding and decoding"](spark, docs, sf_dir).collect()
    assert Counter((r["doc_id"], r["n_tokens"] == 0) for r in coded) == Counter((r["doc_id"], not r["text"]) for r in docs.collect())


def test_rows_of_one_id_are_judged_apart(spark, sf_dir):
    """Two texts with one id: one is clean, one is junk; neither shares the other's verdict or copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)["quality classifier"]
    fine = {r["doc_id"] for r in stage(spark, docs, sf_dir).collect()}
    bad = [r for r in docs.join(labels.where("quality = 0"), "doc_id").select(*corpus_pipeline.COLUMNS).collect() if r["doc_id"] not in fine]
    good = [r for r in docs.join(labels, "doc_id", "left_anti").collect() if r["doc_id"] in fine]  # a label would be both rows'
    extra = spark.createDataFrame([(good[0]["doc_id"], *tuple(bad[0])[1:])], docs.schema)
    got = [r for r in stage(spark, docs.unionByName(extra), sf_dir).collect() if r["doc_id"] == good[0]["doc_id"]]
    assert [r["text"] for r in got] == [good[0]["text"]]

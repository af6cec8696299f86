"""Document quality with hierarchical empirical Bayes over sites.

A logistic model on a dozen statistics of the text, fitted on at most `SAMPLE` labelled rows (a documented bound; which
rows is a matter of their id's hash), gives each document its evidence. Grouped aggregation over all documents gives hosts
and paths the sums of their documents' probabilities. A host's rate is shrunk to the global rate, a path's to its host's,
with strengths found by the method of moments, so sparse sites stay near their prior. A document's own probability is
taken out of its sites' sums. The posterior adds the site's log-odds over the global ones to the evidence.

Texts are read once, by a map; all else are aggregations and joins of small rows. Joins with sites are broadcast up to
BROADCAST_SITES rows, beyond by shuffle, where adaptive execution splits a large site.

Defined results: texts without a word have quality 0 and are rejected; with fewer than MIN_LABELS labels of either kind
the evidence of all others is 0 and none is rejected; null hosts and paths are sites of their own. Repeated rows give a row
each and count each in their site; an empty table gives none. Rows without an id are judged, but no label is theirs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rainfold.llm.common import batch_of, cut, fields, in_batches, is_small, slices

SAMPLE, MIN_LABELS, BROADCAST_SITES = 20_000, 5, 10_000
#: Weight of the site beside the document, and the quality under which a document is rejected.
SITE_WEIGHT, REJECT_BELOW = 0.5, 0.2
NAMES = ("letters", "upper", "marks", "digits", "blank", "word_length", "log_words", "variety", "repeats", "lines", "marked_words", "short_words")
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91)]] = 1
_KIND[[*range(97, 123)]] = 2
_KIND[[*range(128, 256)]] = 3
_KIND[[*range(48, 58)]] = 4
_KIND[[*range(9, 14), 32]] = 5
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 6


def statistics(text: str | None) -> list[float] | None:
    """Numbers of about 0 to 1 on a text's make-up, in the order of NAMES; None without a word."""
    words = (text or "").split()
    if not words:
        return None
    raw = np.frombuffer(text.encode(), np.uint8)
    n = np.bincount(_KIND[raw], minlength=7) / len(raw)
    count = len(words)
    distinct = len(set(words))
    same = sum(map(str.__eq__, words, words[1:]))
    lines = text.split("\n")
    last = "".join(w[-1] for w in words)
    plain = sum(c.isalnum() or c in ".,;:'\")?" for c in last)
    letters = max(n[1] + n[2] + n[3], 1e-9)
    return [
        float(n[1] + n[2] + n[3]),
        sum(w.isupper() and len(w) > 1 for w in words) / count,
        float(n[0]),
        float(n[4]),
        float(n[5]),
        min(4.0, len(text) / count / 6),
        float(np.log1p(count)) / 10,
        distinct / count ** 0.8,
        same / count,
        len(set(lines)) / len(lines),
        1 - plain / count,
        float(n[1] / letters),
    ]


def text_statistics(df: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """keep + (stats ARRAY<DOUBLE>), null for texts without a word."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ["text__"]):
            yield batch_of(b, keep, stats=pa.array([statistics(t) for t in b.column("text__").to_pylist()], pa.list_(pa.float64())))

    return in_batches(df).select(*keep, F.col(text).alias("text__")).mapInArrow(kernel, fields(df, keep) + ", stats array<double>")


def fit(stats: np.ndarray, good: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with the constant last, means, deviations) of a ridge logistic regression by Newton steps."""
    mean, spread = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    x = np.hstack([(stats - mean) / spread, np.ones((len(stats), 1))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + keep, x.T @ (good - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, spread


def labelled_sample(stats: DataFrame, labels: DataFrame, key: str, label: str, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """At most about `most` labelled rows, picked by their ids' hashes."""
    joined = stats.where(F.col("stats").isNotNull()).join(labels.where(F.col(label).isNotNull()).select(key, label), key)
    rows = joined.select(F.xxhash64(key).alias("h"), "stats", F.col(label).cast("double").alias("good"))
    n = labels.count()
    share = min(1.0, most / max(1, n))
    some = rows.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("h").limit(most).collect()
    return np.array([r["stats"] for r in some], float).reshape(-1, len(NAMES)), np.array([r["good"] for r in some], float)


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def strength(groups: DataFrame, prior: Column) -> Column:
    """Pseudo-counts of the prior: large where the groups' rates differ no more than chance makes them. Aggregates."""
    n, rate = F.col("n"), F.col("total") / F.col("n")
    within = F.avg(prior * (1 - prior) / n)
    between = F.greatest(F.avg((rate - prior) * (rate - prior)) - within, F.lit(1e-4))
    return F.greatest(F.lit(1.0), F.least(F.avg(prior * (1 - prior)) / between - 1, F.lit(10_000.0)))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, n_path, total_path, n_host, total_host, prior, host_strength, path_strength) from (host, path, p)."""
    paths = cut(scored.groupBy("host", "path").agg(F.count("p").alias("n"), F.sum("p").alias("total")).where("n > 0"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    got = paths.agg((F.sum("total") / F.sum("n")).alias("prior")).first()
    prior = 0.5 if got["prior"] is None else got["prior"]
    a = hosts.agg(strength(hosts, F.lit(prior)).alias("a")).first()["a"] or 1.0
    named = paths.join(hosts.select(F.col("host").alias("host__"), F.col("n").alias("n_host"), F.col("total").alias("total_host")), F.col("host").eqNullSafe(F.col("host__"))).drop("host__")
    shrunk = named.withColumn("rate_host", (F.col("total_host") + a * prior) / (F.col("n_host") + a))
    b = shrunk.agg(strength(shrunk, F.col("rate_host")).alias("b")).first()["b"] or 1.0
    return shrunk.drop("rate_host").withColumnsRenamed({"n": "n_path", "total": "total_path"}).withColumns({"prior": F.lit(prior), "host_strength": F.lit(float(a)), "path_strength": F.lit(float(b))})


def quality(df: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text", label: str = "quality", keep: Sequence[str] = ()) -> DataFrame:
    """(key, keep..., host, path, evidence, host_posterior, path_posterior, quality, rejected), one row for each row of df."""
    stats = cut(text_statistics(df.select(F.col(key), *keep, host.alias("host"), path.alias("path"), F.col(text).alias("text")), [key, *keep, "host", "path"]))
    x, good = labelled_sample(stats, labels, key, label)
    if min((good == 1).sum(), (good == 0).sum()) >= MIN_LABELS:
        w, mean, spread = fit(x, good)
        terms = [F.lit(float(w[i] / spread[i])) * (F.col("stats")[i] - float(mean[i])) for i in range(len(NAMES))]
        evidence = F.least(F.greatest(sum(terms, F.lit(float(w[-1]))), F.lit(-30.0)), F.lit(30.0))
    else:
        evidence = F.lit(0.0)
    scored = stats.withColumn("evidence", F.when(F.col("stats").isNotNull(), evidence)).withColumn("p", sigmoid(F.col("evidence"))).drop("stats")
    sites = cut(site_posteriors(scored).withColumnsRenamed({"host": "host__", "path": "path__"}))
    sites = F.broadcast(sites) if is_small(sites, BROADCAST_SITES) else sites
    rows = scored.join(sites, F.col("host").eqNullSafe(F.col("host__")) & F.col("path").eqNullSafe(F.col("path__")), "left")
    a, b = F.col("host_strength"), F.col("path_strength")
    rows = rows.withColumn("host_posterior", (F.col("total_host") - F.col("p") + a * F.col("prior")) / (F.col("n_host") - 1 + a))
    rows = rows.withColumn("path_posterior", (F.col("total_path") - F.col("p") + b * F.col("host_posterior")) / (F.col("n_path") - 1 + b))
    judged = sigmoid(F.col("evidence") + SITE_WEIGHT * (logit(F.col("path_posterior")) - logit(F.col("prior"))))
    rows = rows.withColumn("quality", F.coalesce(judged, F.lit(0.0)))
    return rows.select(key, *keep, "host", "path", "evidence", "host_posterior", "path_posterior", "quality", (F.col("quality") < REJECT_BELOW).alias("rejected"))


def url_levels(url: Column) -> tuple[Column, Column]:
    """Host, and host with the first segment of the path, of a URL; null where it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]+)", 1))
    first = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)
    return F.nullif(host, F.lit("")), F.nullif(F.concat(host, F.lit("/"), first), F.lit("/"))


def document_levels() -> tuple[Column, Column]:
    """Documents have no URL: their source stands for the host, its part in one language for the path."""
    return F.col("source"), F.concat_ws("/", "source", "lang")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op9: the quality of every document."""
    return quality(docs, labels, *document_levels())

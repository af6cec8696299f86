"""Top-k search: nothing is broadcast by its compressed size, and the lists of a block are read for many queries at a time."""

import numpy as np
from pyspark.sql import functions as F

from rainfold.llm import topk


def test_blocks_are_not_broadcast(spark):
    """Blocks of repeated vectors are few bytes when shuffled and many on the driver."""
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.col("id") % 3 + 0.5, F.lit(1.0)).alias("embedding"))
    made = topk.search_report(df)
    assert "BroadcastExchange" not in made._jdf.queryExecution().executedPlan().toString()
    rows = made.collect()
    assert "BroadcastExchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert [r["vec_id"] for r in sorted(rows) if r["query_id"] == 50] == [2, 5, 8, 11, 14]


def test_queries_of_a_block_share_its_lists(monkeypatch):
    rng = np.random.default_rng(6)
    block, ids = rng.integers(-4, 5, (700, 3)).astype(np.float32), rng.integers(0, 500, 700)
    queries, own = np.vstack([rng.integers(-4, 5, (40, 3)), np.zeros((1, 3), int)]), rng.integers(0, 500, 41)
    lists, read = topk.Lists(ids, block), []
    monkeypatch.setattr(lists, "block", type("Counted", (), {"dtype": block.dtype, "__getitem__": lambda self, at: read.append(len(at)) or block[at]})())
    place, found, scores = lists.best_of(own, queries, 5)
    assert len(read) < 10 and sum(read) <= 700
    for j, q in enumerate(queries):
        want = sorted((-int(b @ q), int(i)) for i, b in zip(ids, block) if i != own[j])[:5]
        assert [(-int(s), int(i)) for s, i in zip(scores[place == j], found[place == j])] == want

import math

import pytest
from pyspark.sql import functions as F

from colloquy.operators import counts, semantic


@pytest.mark.parametrize("most", [1 << 22, 5])
def test_pooling_moves_a_vector_once_a_block(spark, monkeypatch, most):
    """Sums as by hand, in one block or many; repeated keys share a sum; no aggregate of vectors a text."""
    monkeypatch.setattr(counts, "POOLED_WORDS", most)
    texts = [(1, "x", "cats cats dogs"), (2, "y", "zzz"), (3, "x", "dogs up"), (3, "z", "cats"), (4, "x", None), (5, "x", "up down"), (6, "x", "down zzz down")]
    rows = spark.createDataFrame(texts, "id int, k string, t string")
    words = spark.createDataFrame([("cats", 1.5, [127, 0]), ("dogs", 2.0, [0, 127]), ("up", 1.0, [0, 5]), ("down", 1.0, [0, -5]), ("none", 1.0, None)], "term string, idf double, q array<tinyint>")
    got = semantic.pool(semantic.token_rows(rows, "id", F.col("t"), "k"), "id", words, "k")
    unit = lambda x, y: [x / math.hypot(x, y), y / math.hypot(x, y)]
    want = {(1, "x"): unit(3, 2), (3, "x"): unit(1.5, 2 + 5 / 127), (3, "z"): unit(1.5, 2 + 5 / 127), (6, "x"): [0, -1]}
    assert {(r.id, r.k): pytest.approx(r.vec) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate_metrics" not in plan and "summarizer" not in plan.lower()


def test_blocks_are_smaller_where_vectors_are_longer(spark, monkeypatch):
    """A block meets the vectors of its words in one row: it has an eighth of the words if they are doubles, and the same sums."""
    monkeypatch.setattr(counts, "POOLED_WORDS", 16)
    monkeypatch.setattr(counts, "ROWS", 2)
    made, blocks = [], counts.blocks
    monkeypatch.setattr(counts, "blocks", lambda *a, **k: made.append(blocks(*a, **k)) or made[-1])
    rows = spark.createDataFrame([(k, "cats dogs cats") for k in range(40)], "id int, t string").coalesce(1)
    words = spark.createDataFrame([("cats", 1.5, [127, 0]), ("dogs", 2.0, [0, 127])], "term string, idf double, q array<tinyint>")
    tokens = semantic.token_rows(rows, "id", F.col("t"))
    pooled = [semantic.pool(tokens, "id", w).collect() for w in (words, words.withColumn("vec", F.col("q").cast("array<double>")).drop("q"))]
    assert {r.id: pytest.approx(r.vec) for r in pooled[0]} == {r.id: r.vec for r in pooled[1]} and len(pooled[0]) == 40
    assert made[1].count() > made[0].count() >= 4

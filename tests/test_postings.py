import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import counts, keyword

SEGMENTS = "segment_id long, episode_id string, shard string, type string, start_sec int, question string, answer string"


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def segments(spark, monkeypatch):
    """Segments whose ids repeat (one over several batches), texts without words, nulls."""
    monkeypatch.setattr(counts, "ROWS", 2)
    monkeypatch.setattr(counts, "OUT", 7)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)] + ["x", "Été", ""]
    rows = [(k % 17 if k % 3 else 4, f"e{k % 2}" if k % 3 else "e", [None, "en", "fr"][k % 3], "intro", None, " ".join(rng.choices(words, k=k % 5)), " ".join(rng.choices(words, k=k % 9))) for k in range(60)]
    return spark.createDataFrame([*rows, (99, "e", "en", "intro", 1, None, None), (98, "e", "en", "intro", 1, "-", "")], SEGMENTS)


def test_postings_count_repeated_ids_over_batches(segments):
    plain = keyword.terms_of(segments, "segment_id", *keyword.META).groupBy("shard", "term", "segment_id", *keyword.META).agg(F.sum("boost").alias("weight"), F.count("*").alias("freq"))
    made = keyword.postings(segments)
    assert sorted(map(str, made.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert "Aggregate" not in plan_of(made)  # a task holds no more postings than a batch has


def test_placed_postings_are_those_of_their_segments(segments):
    blocks = keyword.placed(segments, 4)
    plain = keyword.postings(segments)
    assert sorted(map(str, blocks.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    places = {(r.shard, r.segment_id): r.place for r in blocks.collect()}
    assert sorted(places.values()) == list(range(len(places))) and {r.place // 4 == r.block for r in blocks.collect()} == {True}
    plan = plan_of(blocks)
    assert "rangepartitioning(shard" in plan and "term" not in "".join(line for line in plan.splitlines() if "Exchange" in line)

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import order, semantic


@pytest.mark.parametrize("side, small, wide", [(1 << 9, 0, 64), (1 << 12, 0, 4)])
def test_factors_of_packed_pairs_agree_with_the_named_matrix(spark, monkeypatch, side, small, wide):
    """One task or many slices, groups and parts, double or single precision: as a dense solution, and no column has a name."""
    for name, value in (("SIDE", side), ("SMALL", small), ("WIDE", wide)):
        monkeypatch.setattr(semantic, name, value)
    rng = random.Random(2)
    texts = [(k, " ".join(f"t{n:02d}" for n in rng.choices(range(30), weights=[1 + ((j + k) % 5 == 0) * 9 for j in range(30)], k=60))) for k in range(20)]
    docs = spark.createDataFrame([*texts, (99, "alone " * 6)], "id int, t string")  # one word without a pair
    tokens = semantic.token_rows(docs, "id", F.col("t"))
    stats = order.stored(semantic.term_stats(tokens, "id"))
    rows = semantic.ppmi(tokens, "id", stats).collect()
    terms = sorted({r.a for r in rows})
    dense = np.zeros((len(terms), len(terms)))
    for r in rows:
        dense[terms.index(r.a), terms.index(r.b)] = r.ppmi
    values, vectors = np.linalg.eigh(dense)
    want = vectors[:, -3:] * np.sqrt(values[-3:])
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    made = semantic.factors(tokens, stats.select("term", "df"), 3, 9, 20)
    found = {r.term: r for r in made.collect()}
    assert sorted(found) == terms and all(r.df > 0 and math.isclose(sum(x * x for x in r.vec), 1) for r in found.values())
    got = np.array([found[t].vec for t in terms])
    assert np.abs(got @ got.T - want @ want.T).max() < (1e-8 if wide > 12 else 1e-4)


def test_entries_are_not_shuffled_again_in_a_step(spark):
    """Copies of the entries stay where their tasks read them."""
    rows = [(f"w{i}", f"w{j}", 1.0 + (i == j)) for i in range(6) for j in range(6)]
    plans = []

    def cut(made):
        plans.append(made._jdf.queryExecution().executedPlan().toString())
        return made.checkpoint()

    order.shared_folder(spark)
    semantic.factorize(spark.createDataFrame(rows, "a string, b string, ppmi double"), 2, 2, cut=cut)
    steps = [p for p in plans if p.count("FlatMapCoGroupsInArrow") == 1 and "FlatMapGroupsInArrow" in p]
    assert steps and all("Exchange hashpartitioning(task" in p for p in steps)
    assert all(p.count("Exchange hashpartitioning(task") == 1 for p in steps)


def test_tasks_are_dealt_to_unlike_partitions(spark):
    numbers = order.apart(spark, 6)
    rows = order.together(spark.createDataFrame([(n,) for n in numbers], "n long"), "n")
    held = sorted(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())
    assert len(set(numbers)) == 6 and held == [1, 1, 2, 2]

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.operators import counts, order, semantic


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_statistics_count_a_document_once(spark, monkeypatch):
    monkeypatch.setattr(counts, "ROWS", 2)
    docs = [(k % 5, " ".join(f"t{(k * j) % 7}" for j in range(k))) for k in range(30)] + [(3, None)]
    tokens = semantic.token_rows(spark.createDataFrame(docs, "id int, t string"), "id", F.col("t"))
    stats = semantic.term_stats(tokens, "id", 1)
    freq = Counter(t for _, x in docs for t in (x or "").split())
    df = Counter(t for k in range(5) for t in {t for i, x in docs if i == k for t in (x or "").split()})
    assert {r.term: (r.freq, r.df) for r in stats.collect()} == {t: (freq[t], df[t]) for t in freq}
    assert "Generate" not in plan_of(stats)  # no row a word


@pytest.mark.parametrize("words", [1 << 20, 40])
def test_pairs_of_blocks_add_up(spark, monkeypatch, words):
    """Rare words go before pairs are made, and sums of both words come with their names: no join has a row a pair."""
    monkeypatch.setattr(counts, "ROWS", 3)
    monkeypatch.setattr(counts, "BLOCK_WORDS", words)
    rng = random.Random(words)
    docs = [(k, " ".join(rng.choices([f"t{n:02d}" for n in range(20)], weights=range(1, 21), k=k % 13))) for k in range(60)] + [(60, None), (61, "rare")]
    tokens = semantic.token_rows(spark.createDataFrame(docs, "id int, t string"), "id", F.col("t"))
    stats = order.stored(semantic.term_stats(tokens, "id"))
    known, want = {r.term for r in stats.collect()}, Counter()
    for _, x in docs:
        own = (x or "").split()
        want.update((min(u, v), max(u, v)) for i, u in enumerate(own) for v in own[i + 1 : i + 6] if u != v and {u, v} <= known)
    found = semantic.cooccurrences(tokens, "id", stats)
    assert {(r.a, r.b): r.n for r in found.collect()} == want and found.count() == len(want)
    m, total = Counter(), 2 * sum(want.values())
    for (a, b), n in want.items():
        m[a] += n
        m[b] += n
    value = {p: math.log(n * total / (m[p[0]] * m[p[1]])) for p, n in want.items()}
    made = semantic.ppmi(tokens, "id", stats)
    got = {(r.a, r.b): r.ppmi for r in made.collect()}
    assert got == pytest.approx({q: v for (a, b), v in value.items() if v > 0 for q in ((a, b), (b, a))}) and made.count() == len(got)
    assert "HashJoin" not in plan_of(made) and plan_of(made).count("SortMergeJoin") <= 1  # blocks with their words
    few = spark.createDataFrame([("t19",), ("t18",)], "term string")  # cells without a pair
    assert {(r.a, r.b) for r in semantic.cooccurrences(tokens, "id", few).collect()} == {("t18", "t19")}
    empty = semantic.ppmi(tokens, "id", stats.limit(0))
    assert empty.count() == 0


def test_pairs_are_stored_in_few_bytes(spark):
    """Keys of pairs come back from their packed steps; a pair takes a few bytes, where two plain numbers take sixteen."""
    import numpy as np

    for own in (np.array([5, -1, 1 << 40]), np.zeros(0, np.int64), np.arange(7, dtype=np.int32)):
        assert counts.unpacked(counts.packed(own), own.dtype.type).tolist() == own.tolist()
    rng = random.Random(5)
    texts = [(k, " ".join(f"w{int(1500 * rng.random() ** 2)}" for _ in range(300))) for k in range(300)]
    tokens = semantic.token_rows(spark.createDataFrame(texts, "id int, t string"), "id", F.col("t"))
    cells, ids, sides = semantic._pair_cells(tokens, semantic.term_stats(tokens, "id"), 5)
    rows = cells.collect()
    pairs = sum(len(counts.unpacked(r.n, np.int64)) for r in rows)
    assert pairs > 50_000 and sum(len(r["keys"]) + len(r.n) for r in rows) < 5 * pairs
    known = ids.count()
    for r in rows:
        keys = np.cumsum(counts.unpacked(r["keys"], np.int64))
        low, high = keys >> counts.ID_BITS, keys & counts.ID_MASK
        assert (np.diff(keys) > 0).all() and (low < high).all() and high.max() < known
        assert set(low % sides * sides + high % sides) == {r.cell}

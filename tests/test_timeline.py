"""Cues in the order of their questions, against trying every choice."""

import itertools
import random

import pandas as pd

from colloquy.operators import timeline

SHAPE = "episode_id string, place long, question_id string, start_sec long, score double"


def every_choice(rows):
    """The best chain of one episode's (place, question, start, millionths), of all choices of at most one cue a question."""
    asked = sorted({r[:2] for r in rows})
    options = [[None, *(r for r in rows if r[:2] == q)] for q in asked]
    chains = [[r for r in pick if r] for pick in itertools.product(*options)]
    good = [c for c in chains if all(a[2] < b[2] for a, b in itertools.pairwise(c))]
    return min(good, key=lambda c: (-sum(r[3] for r in c), [r[:3] for r in reversed(c)]))


def made(rng, episode, questions, far):
    rows = []
    for place in range(questions):
        for start in rng.sample(range(place * 10, place * 10 + far), rng.randint(0, 3)):
            rows.append((episode, place, f"q{place}", start, rng.choice([0.5, 0.5, 0.75, 1.25])))
    return rows


def test_chosen_cues_are_the_best_of_all_choices(spark):
    rng = random.Random(5)
    rows = [r for i in range(40) for r in made(rng, f"e{i}", rng.randint(1, 6), rng.choice([8, 25, 60]))]
    odd = [(None, 1, "n", 3, 1.0), ("e0", None, "n", 3, 1.0), ("e0", 1, "z", None, 1.0), ("e0", 1, "z", 4, None), ("e0", 1, "z", 4, 0.0), ("e0", 1, "z", 4, -1.0)]
    frame = spark.createDataFrame(rows + odd + rows[:10] + [(*rows[0][:4], 0.25)], SHAPE)
    got = {}
    for r in timeline.in_order(frame).collect():
        got.setdefault(r.episode_id, set()).add((r.place, r.question_id, r.start_sec, r.weight))
    for i in range(40):
        own = [(p, q, s, round(w * timeline.UNIT)) for e, p, q, s, w in rows if e == f"e{i}"]
        assert got.get(f"e{i}", set()) == set(every_choice(own)), i
    assert timeline.in_order(frame.where("false")).count() == 0


def test_blocks_part_where_nothing_crosses(spark):
    rows = [("e", 1, "a", 5, 1.0), ("e", 2, "b", 4, 1.0), ("e", 2, "b", 9, 1.0), ("e", 3, "c", 10, 1.0), ("e", 4, "d", 10, 1.0), ("e", 5, "f", 20, 1.0)]
    frame = spark.createDataFrame([(*r[:4], 1) for r in rows], "episode_id string, place long, question_id string, start_sec long, weight long")
    found = {}
    for r in timeline.in_blocks(frame).collect():
        found.setdefault(r.block, set()).add(r.question_id)
    # equal starts forbid each other, so they stay together
    assert sorted(map(sorted, found.values())) == [["a", "b"], ["c", "d"], ["f"]]


def test_a_long_block_takes_few_steps():
    n = 60_000
    rows = pd.DataFrame({"place": range(n), "question_id": "q", "start_sec": [i ^ 1 for i in range(n)], "weight": 1})
    assert len(timeline.best_chain(rows)) == n // 2
    assert len(timeline.best_chain(rows[:0])) == 0


def test_times_between(spark):
    chosen = spark.createDataFrame([("e", 2, "b", 100, 800_000), ("e", 6, "f", 201, 1_500_000)], "episode_id string, place long, question_id string, start_sec long, weight long")
    asked = spark.createDataFrame([("e", i, q) for i, q in enumerate("abcdefg", 1)] + [("x", 1, "lone")], "episode_id string, place long, question_id string")
    got = {r.question_id: (r.start_sec, r.confidence) for r in timeline.between(asked, chosen).collect()}
    assert got == {"a": (None, 0.0), "b": (100, 0.8), "c": (125, 0.4), "d": (150, 0.4), "e": (175, 0.4), "f": (201, 1.0), "g": (None, 0.0), "lone": (None, 0.0)}


def test_short_blocks_are_solved_by_the_batch(spark, monkeypatch):
    """Many blocks of two questions: their chains are those of each block by itself, whatever batches cut."""
    monkeypatch.setattr(timeline.counts, "ROWS", 3)
    rng = random.Random(11)
    rows = [(e, q, q, 100 * (q // 2) + rng.randrange(40), rng.random()) for e in range(12) for q in range(8) for _ in range(3)]
    candidates = spark.createDataFrame(rows, "episode_id int, place int, question_id int, start_sec int, score double")
    found = timeline.in_order(candidates)
    best = {}
    for e, q, _, s, score in rows:
        best[e, q, s] = max(best.get((e, q, s), 0), round(score * timeline.UNIT))
    for e in range(12):
        own = pd.DataFrame([(q, q, s, w) for (of, q, s), w in best.items() if of == e and w], columns=["place", "question_id", "start_sec", "weight"])
        want = [tuple(r) for r in timeline.best_chain(own).itertuples(index=False)]
        assert sorted((r.place, r.question_id, r.start_sec, r.weight) for r in found.where(f"episode_id = {e}").collect()) == want
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()  # no frame a block

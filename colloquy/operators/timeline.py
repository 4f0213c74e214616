"""Times of an episode's questions: cues chosen so that they follow the order of the questions, and times in between.

The best cue of each question by itself may stand before that of an earlier question. Here an episode's cues are chosen together:
at most one a question, later questions at later cues, with the largest sum of scores (weighted longest increasing chain).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.operators import counts

#: Scores are counted in millionths, so that sums are exact and ties are ties.
UNIT = 1_000_000


def in_blocks(candidates: DataFrame) -> DataFrame:
    """Candidates (episode_id, place, question_id, start_sec, weight) with ``block``: chains of different blocks always go together.

    Between two questions is a cut if all cues of those before start earlier than all cues of those behind. What is chosen on one
    side then never forbids anything on the other. Windows see one row a question.
    """
    spans = candidates.groupBy("episode_id", "place", "question_id").agg(F.min("start_sec").alias("_low"), F.max("start_sec").alias("_high"))
    order = Window.partitionBy("episode_id").orderBy("place", "question_id")
    behind = Window.partitionBy("episode_id").orderBy(F.desc("place"), F.desc("question_id"))
    whole = Window.unboundedPreceding
    marked = spans.withColumn("_least", F.min("_low").over(behind.rowsBetween(whole, 0))).withColumn("_most", F.max("_high").over(order.rowsBetween(whole, -1)))
    cut = F.coalesce(F.col("_most") < F.col("_least"), F.lit(False)).cast("long")
    of = marked.withColumn("block", F.sum(cut).over(order.rowsBetween(whole, 0))).select("episode_id", "place", "question_id", "block")
    return candidates.join(of, ["episode_id", "place", "question_id"])


def chain_of(asked: list[tuple], starts: list, weights: list[int]) -> list[int]:
    """The rows of one block that make its best chain; rows are sorted by ``asked`` (place, question_id), then start. Weights are whole, above 0.

    Of equal sums the chain whose last cue is earliest (by question, then by start), then the one before that, and so on. Each row
    looks up the best chain that ends before its start in a tree of running maxima: n log n steps.
    """
    places = {start: k for k, start in enumerate(sorted(set(starts)), 1)}
    ranks, n = [places[start] for start in starts], len(starts)
    best: list[tuple[int, int]] = [(0, 0)] * (len(places) + 1)  # (sum, -row - 1); (0, 0): no chain
    sums, before = [0] * n, [-1] * n
    first = 0
    while first < n:
        end = first
        while end < n and asked[end] == asked[first]:  # a question's rows do not follow each other
            found, at = (0, 0), ranks[end] - 1
            while at > 0:
                found, at = max(found, best[at]), at & (at - 1)
            sums[end], before[end] = found[0] + weights[end], -found[1] - 1
            end += 1
        for i in range(first, end):
            at = ranks[i]
            while at < len(best):
                best[at] = max(best[at], (sums[i], -i - 1))
                at += at & -at
        first = end
    chain, at = [], max(range(n), key=lambda i: (sums[i], -i), default=-1)
    while at >= 0:
        chain.append(at)
        at = before[at]
    return chain[::-1]


def best_chain(rows: pd.DataFrame) -> pd.DataFrame:
    """``chain_of`` rows (place, question_id, start_sec, weight) in any order."""
    rows = rows.sort_values(["place", "question_id", "start_sec"], ignore_index=True)
    return rows.iloc[chain_of(list(zip(rows["place"].tolist(), rows["question_id"].tolist())), rows["start_sec"].tolist(), rows["weight"].tolist())]


def in_order(candidates: DataFrame) -> DataFrame:
    """episode_id, place, question_id, start_sec, weight: the chosen cue of each question that has one.

    ``candidates``: episode_id, place (the question's number), question_id, start_sec, score. Rows with a null or a score of 0 or
    less take no part; of repeated rows the best counts. Questions of one place stand in order of their ids. A task holds a
    batch of whole blocks, or one long block; with bounded windows for the cues of a question, blocks are a few questions long, so
    they are solved by the batch.
    """
    names = ["episode_id", "place", "question_id", "start_sec"]
    weight = F.round(F.col("score") * UNIT).cast("long")
    rows = candidates.select(*names, weight.alias("weight")).where("weight > 0").dropna().groupBy(*names).agg(F.max("weight").alias("weight"))
    own, keys = rows.columns, ["episode_id", "block"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, runs in counts.whole(batches, keys):
            place, asked, starts, weights = (table[c].to_pylist() for c in ("place", "question_id", "start_sec", "weight"))
            asked, chosen = list(zip(place, asked)), []
            edges = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(runs)]
            for first, end in zip(edges, edges[1:]):
                chosen += [first + i for i in chain_of(asked[first:end], starts[first:end], weights[first:end])]
            yield from table.select(own).take(pa.array(chosen)).to_batches(counts.OUT)

    return counts.batched(in_blocks(rows).repartition(*keys).sortWithinPartitions(*keys, "place", "question_id", "start_sec"), solve, rows.schema)


def between(questions: DataFrame, chosen: DataFrame) -> DataFrame:
    """question_id, start_sec, confidence: each question's time. ``questions``: episode_id, place, question_id.

    A chosen cue keeps its start, with its score, at most 1, as confidence. Other questions get a time in proportion to their
    place between the chosen ones around them, with half of the smaller confidence. Before the first and after the last chosen
    one the time is null and the confidence 0.
    """
    met = questions.select("episode_id", "place", "question_id").join(chosen.select("question_id", "start_sec", "weight"), "question_id", "left")
    order = Window.partitionBy("episode_id").orderBy("place", "question_id")
    known = F.when(F.col("start_sec").isNotNull(), F.struct(F.col("place").alias("p"), F.col("start_sec").alias("s"), F.least(F.lit(1.0), F.col("weight") / UNIT).alias("c")))
    rows = met.withColumn("_a", F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_z", F.first(known, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    share = F.when(F.col("_z.p") > F.col("_a.p"), (F.col("place") - F.col("_a.p")) / (F.col("_z.p") - F.col("_a.p"))).otherwise(0.0)
    middle = F.floor(F.col("_a.s") + (F.col("_z.s") - F.col("_a.s")) * share)
    inside = F.col("_a").isNotNull() & F.col("_z").isNotNull()
    time = F.coalesce(F.col("start_sec").cast("long"), F.when(inside, middle))
    sure = F.when(F.col("start_sec").isNotNull(), F.col("_a.c")).when(inside, F.least("_a.c", "_z.c") / 2).otherwise(0.0)
    return rows.select("question_id", time.alias("start_sec"), sure.alias("confidence"))

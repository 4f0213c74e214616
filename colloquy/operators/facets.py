"""Facets, totals, filter chips and recovery from empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels of segment types.
TYPE_LABELS = {"question": "Questions", "answer": "Answers", "intro": "Intro", "other": "Other"}


def episode_counts(segments: DataFrame) -> DataFrame:
    """episode_id, shard, n: the small table that all facets are made of."""
    return segments.groupBy("episode_id", "shard").agg(F.count("*").alias("n"))


def shards(counts: DataFrame) -> DataFrame:
    return counts.groupBy("shard").agg(F.sum("n").alias("n")).orderBy(F.desc("shard"))


def episodes(counts: DataFrame) -> DataFrame:
    return counts.groupBy("episode_id").agg(F.sum("n").alias("n"), F.max("shard").alias("latest")).orderBy(F.desc("latest"), "episode_id")


def totals(counts: DataFrame) -> DataFrame:
    return counts.agg(F.countDistinct("episode_id").alias("episodes"), F.sum("n").alias("segments"), F.max("shard").alias("latest"))


def matching(rows: DataFrame, title: str, text: str, other: str | None = None) -> DataFrame:
    """Rows whose title has the text (case aside), or whose ``other`` column does."""
    keep = F.contains(F.lower(title), F.lit(text.lower()))
    if other:
        keep |= F.contains(F.col(other).cast("string"), F.lit(text))
    return rows.where(keep)


def chips(states: DataFrame, episode_numbers: DataFrame, label: str = "AMA") -> DataFrame:
    """The states (year, type, episode) with ``chips``: (key, label) of each active filter; unknown episodes have none."""
    known = states.join(F.broadcast(episode_numbers.select(F.col("id").alias("episode"), "number")), "episode", "left")
    labels = F.create_map(*(F.lit(x) for pair in TYPE_LABELS.items() for x in pair))
    chip = lambda key, text: F.struct(F.lit(key).alias("key"), text.alias("label"))
    year = F.when(F.col("year") != "", chip("year", F.concat(F.lit("Year: "), "year")))
    episode = F.when(F.col("number").isNotNull(), chip("episode", F.concat(F.lit(f"Episode: {label} "), F.col("number").cast("string"))))
    kind = F.when(F.col("type") != "all", chip("type", labels[F.col("type")]))
    return known.withColumn("chips", F.array_compact(F.array(year, episode, kind))).drop("number")


def sample_queries(queries: DataFrame, n: int = 3, seed: int | None = None) -> DataFrame:
    """n queries drawn at random, the same ones for the same seed."""
    return queries.orderBy(F.rand(seed)).limit(n)

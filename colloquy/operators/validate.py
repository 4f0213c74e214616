"""Data quality: one table of violations over episodes and segments, and a gate that fails on any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The kinds of segment.
KINDS = ("question", "answer", "intro", "other")


def _broken(rows: DataFrame, rule: str, bad: Column) -> DataFrame:
    return rows.where(bad).select(F.lit(rule).alias("rule"), "episode_id", "segment_id")


def violations(segments: DataFrame) -> DataFrame:
    """(rule, episode_id, segment_id) of segments (episode_id, segment_id, type, start_sec, end_sec, ord).

    One window over an episode serves the order rule; duplicates and missing questions are aggregates with partial sums.
    """
    before = Window.partitionBy("episode_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.withColumn("_last", F.last("start_sec", ignorenulls=True).over(before))
    twice = segments.groupBy("episode_id", "segment_id").agg(F.count("*").alias("n")).where("n > 1")
    silent = segments.groupBy("episode_id").agg(F.count_if(F.col("type") == "question").alias("n")).where("n = 0")
    return (
        _broken(rows, "not_monotonic", F.col("start_sec") < F.col("_last"))
        .unionByName(_broken(segments, "end_before_start", F.col("end_sec") < F.col("start_sec")))
        .unionByName(_broken(segments, "foreign_segment", ~F.startswith(F.col("segment_id").cast("string"), F.concat(F.col("episode_id").cast("string"), F.lit("#")))))
        .unionByName(_broken(segments, "unknown_type", ~F.col("type").isin(list(KINDS))))
        .unionByName(_broken(segments, "negative_time", (F.col("start_sec") < 0) | (F.col("end_sec") <= 0)))
        .unionByName(twice.select(F.lit("duplicate_segment").alias("rule"), "episode_id", "segment_id"))
        .unionByName(silent.select(F.lit("no_question").alias("rule"), "episode_id", F.lit(None).cast(segments.schema["segment_id"].dataType).alias("segment_id")))
    )


def episode_violations(episodes: DataFrame, prefix: str = "ama") -> DataFrame:
    """(rule, episode_id, segment_id) of the headers: keys, hashes, numbers, dates, addresses, and ids found twice."""
    empty = episodes.withColumn("segment_id", F.lit(None).cast("string"))
    url = lambda c: ~F.coalesce(F.col(c).rlike("^[a-z][a-z0-9+.-]*://[^ ]+$"), F.lit(False))
    twice = episodes.groupBy("episode_id").agg(F.count("*").alias("n")).where("n > 1")
    return (
        _broken(empty, "bad_key", ~F.col("episode_id").rlike(f"^{prefix}-[a-z0-9-]+$"))
        .unionByName(_broken(empty, "bad_hash", ~F.col("content_hash").rlike("^[a-f0-9]{64}$")))
        .unionByName(_broken(empty, "bad_number", F.col("number") <= 0))
        .unionByName(_broken(empty, "bad_duration", F.col("duration_sec") <= 0))
        .unionByName(_broken(empty, "no_date", F.col("publish_date").isNull()))
        .unionByName(_broken(empty, "bad_url", url("source_url") | url("transcript_url") | url("audio_url")))
        .unionByName(twice.select(F.lit("duplicate_episode").alias("rule"), "episode_id", F.lit(None).cast("string").alias("segment_id")))
    )


def require_valid(found: DataFrame) -> None:
    """Fails with the first violations if there are any."""
    first = found.orderBy("rule", "episode_id", "segment_id").limit(5).collect()
    if first:
        raise ValueError("; ".join(f"{r.rule}: {r.episode_id} {r.segment_id or ''}".strip() for r in first))

"""Session events: recent searches, stale responses, bursts and key chords, as windows over a user's events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RECENT, QUIET_MS, CHORD_MS = 5, 120, 900


def recent_searches(events: DataFrame, n: int = RECENT) -> DataFrame:
    """user_id, query, mode, at, rank: the newest n distinct (query, mode) of each user; blank queries do not count.

    Grouping first leaves one row for each distinct search before the window ranks them.
    """
    latest = events.where("trim(query) <> ''").groupBy("user_id", F.trim("query").alias("query"), "mode").agg(F.max("at").alias("at"))
    order = Window.partitionBy("user_id").orderBy(F.desc("at"), "query", "mode")
    return latest.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def without(recent: DataFrame, query: str, mode: str) -> DataFrame:
    return recent.where(~((F.col("query") == query) & (F.col("mode") == mode)))


def newest_response(responses: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """The values that came with the highest request number of each key; later requests make earlier answers stale."""
    return responses.groupBy(key).agg(F.max(order).alias(order), *(F.max_by(v, order).alias(v) for v in values))


def settled(events: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """The events (user_id, at_ms, event_id) that no other of the user follows within ``quiet_ms``."""
    later = Window.partitionBy("user_id").orderBy("at_ms", "event_id")
    gap = F.lead("at_ms").over(later) - F.col("at_ms")
    return events.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") >= quiet_ms)).drop("_gap")


def chords(events: DataFrame, first: str, then: tuple[str, ...], within_ms: int = CHORD_MS) -> DataFrame:
    """user_id, first_ms, event_type, after_ms: a ``first`` event whose next one is of ``then`` within the time."""
    later = Window.partitionBy("user_id").orderBy("at_ms", "event_id")
    rows = events.withColumn("next_type", F.lead("event_type").over(later)).withColumn("after_ms", F.lead("at_ms").over(later) - F.col("at_ms"))
    hit = (F.col("event_type") == first) & F.col("next_type").isin(list(then)) & (F.col("after_ms") < within_ms)
    return rows.where(hit).select("user_id", F.col("at_ms").alias("first_ms"), F.col("next_type").alias("event_type"), "after_ms")

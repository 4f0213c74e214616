"""Incremental ingest: what is new, its numbers and snapshots, and episodes made of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import episode_key, segment_key, token_count
from colloquy.operators import order, segment
from colloquy.sources import pages as html


def without(found: DataFrame, known: DataFrame, *columns: str) -> DataFrame:
    """The found rows of which no column's value is known: an anti-join each instead of one with OR, so all are hash joins."""
    for c in columns:
        found = found.join(known.select(c).distinct(), c, "left_anti")
    return found


def unseen(discovered: DataFrame, existing: DataFrame) -> DataFrame:
    """Discovered episodes (title, source_url, publish_date) whose key and address are both unknown; one a key.

    Of two posts in a month the later one stays.
    """
    keyed = discovered.withColumn("episode_id", episode_key(F.col("publish_date")))
    new = without(keyed, existing, "episode_id", "source_url")
    return new.groupBy("episode_id").agg(F.max_by(F.struct("title", "source_url", "publish_date"), F.struct("publish_date", "source_url")).alias("r")).select("episode_id", "r.*")


def numbered(new: DataFrame, existing: DataFrame) -> DataFrame:
    """With ``number`` going on from the highest known one by date."""
    last = existing.agg(F.coalesce(F.max("number"), F.lit(0))).head()[0]
    return order.numbered(new, "publish_date", "source_url", start=last + 1).withColumn("number", F.col("number").cast("int"))


def summary(discovered: DataFrame, new: DataFrame) -> DataFrame:
    """discovered, processed, skipped."""
    counts = discovered.agg(F.count("*").alias("discovered")).crossJoin(new.agg(F.count("*").alias("processed")))  # one row each
    return counts.withColumn("skipped", F.col("discovered") - F.col("processed"))


def heard(cues: DataFrame) -> DataFrame:
    """episode_id, last (the start of the last cue), voices (the distinct speakers)."""
    return cues.groupBy("episode_id").agg(F.max("start_sec").alias("last"), F.collect_set("speaker").alias("voices"))


def episodes(new: DataFrame, pages: DataFrame, host: str, aliases: tuple[str, ...] = ()) -> DataFrame:
    """Canonical episodes of numbered new ones and their pages (url, html).

    Pages with a transcript give timed segments; question-only pages give one segment a question, without times.
    """
    own = new.join(pages.withColumnRenamed("url", "source_url"), "source_url")
    texts = html.transcripts(own.select(F.col("source_url").alias("url"), "html")).withColumnRenamed("url", "source_url")
    head = own.join(texts, "source_url").select("episode_id", "number", "title", "publish_date", "source_url", F.col("source_url").alias("transcript_url"), F.coalesce("transcript_text", F.lit("")).alias("transcript_text"), html.audio_of(F.col("html"), F.col("source_url")).alias("audio_url"), html.video_of(F.col("html")).alias("youtube_id"))
    cues = segment.cues(head.where("transcript_text <> ''"), host, aliases)
    timed = segment.segments(cues, host, aliases)
    asked = html.legacy_questions(own.select(F.col("source_url").alias("url"), "html")).withColumnRenamed("url", "source_url").join(head.where("transcript_text = ''").select("source_url", "episode_id"), "source_url")
    listed = asked.select("episode_id", segment_key(F.col("episode_id"), F.col("ord")).alias("segment_id"), F.lit("question").alias("type"), F.col("text").alias("question_text"), F.lit("").alias("answer_text"), F.lit(None).cast("int").alias("start_sec"), F.lit(None).cast("int").alias("end_sec"), "ord", token_count(F.col("text")).alias("tokens"), F.array("speaker").alias("speaker_names"))
    fields = ["segment_id", "type", "question_text", "answer_text", "start_sec", "end_sec", F.col("ord"), F.col("tokens").cast("int").alias("tokens"), "speaker_names"]
    nested = timed.unionByName(listed).groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct(F.col("ord").alias("_at"), F.struct(*fields).alias("s")))).alias("s"))
    full = head.join(nested, "episode_id").join(heard(cues), "episode_id", "left").withColumn("segments", F.transform("s", lambda x: x["s"]))
    speakers = F.array_sort(F.array_distinct(F.concat(F.coalesce("voices", F.array().cast("array<string>")), F.flatten(F.transform("segments", lambda s: s["speaker_names"])))))
    out = full.select("episode_id", "number", "title", "publish_date", "source_url", "transcript_url", "transcript_text", speakers.alias("speakers"), "audio_url", "youtube_id", F.greatest(F.lit(1), F.coalesce("last", F.lit(1))).cast("int").alias("duration_sec"), "segments")
    return out.withColumn("content_hash", F.sha2(F.to_json(F.struct(*out.columns)), 256))

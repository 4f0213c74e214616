"""Timed-text captions in json3 form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import clean_text

JSON3 = "struct<events:array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>>"


def parse(sources: DataFrame) -> DataFrame:
    """episode_id, start_sec, end_sec, text of (episode_id, json), by start; events without a start or text drop out.

    An event's pieces are joined by a space, and runs of white space become one.
    """
    event = F.explode(F.from_json("json", JSON3)["events"])
    rows = sources.select("episode_id", event.alias("e")).where("e.tStartMs is not null")
    text = clean_text(F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), " "))
    start = F.col("e.tStartMs") / 1000
    out = rows.select("episode_id", start.alias("start_sec"), (start + F.coalesce("e.dDurationMs", F.lit(0)) / 1000).alias("end_sec"), text.alias("text"))
    return out.where("text <> ''").orderBy("episode_id", "start_sec")

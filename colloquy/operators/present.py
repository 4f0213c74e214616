"""Results: ranked rows joined with texts and episodes, previews and highlights, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.ranges import first_ranges, snippet

PAGE = 24
#: Characters on each side of a passage's preview; others have the default of ``snippet``.
PASSAGE_RADIUS = 200


#: The columns of every answer, whatever the mode: a segment, how it was found, and what to show of it.
#: found_by is keyword, semantic or both; char_offset is null but for passages; match is the preview.
RESPONSE = ("segment_id", "episode_id", "shard", "type", "start_sec", "question", "answer", "score", "rank", "found_by", "char_offset", "match", "highlights", "semantic_only", "episode")
#: What an answer holds of its episode; null where the engine has no episodes.
EPISODE = "struct<episode_id string, number int, title string, publish_date date, source_url string, audio_url string, youtube_id string, duration_sec int>"


def results(ranked: DataFrame, segments: DataFrame, episodes: DataFrame | None, terms: list[str]) -> DataFrame:
    """The ranked rows (segment_id, score, rank, maybe found_by and char_offset) as RESPONSE.

    A hit with the place of an answer's passage is shown from there; other previews centre on the first term found.
    ``highlights`` has the ranges of the terms in the question and in the preview.

    ``ranked`` is cut to a few hundred rows before, so it is broadcast and the texts are not shuffled. Rows without a text
    or an episode drop out.
    """
    given = lambda name, other: F.col(name) if name in ranked.columns else other
    ids = ranked.select("segment_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank"), given("found_by", F.lit("keyword")).alias("found_by"), given("char_offset", F.lit(None)).cast("long").alias("char_offset"))
    out = segments.join(F.broadcast(ids), "segment_id")
    if episodes is None:
        out = out.withColumn("episode", F.lit(None).cast(EPISODE))
    else:
        fields = [part.split()[0] for part in EPISODE[len("struct<") : -1].split(", ")]
        known = episodes.select(F.col("episode_id").alias("of"), F.struct(*(F.col(f) if f in episodes.columns else F.lit(None).alias(f) for f in fields)).cast(EPISODE).alias("episode"))
        out = out.join(known, out["episode_id"].cast("string") == known["of"].cast("string"))
    source = F.when(F.trim("answer") != "", F.col("answer")).otherwise(F.col("question"))
    passage = F.substr(source, F.col("char_offset").cast("int") + 1)
    preview = F.when(F.col("char_offset") >= 0, snippet(passage, terms, PASSAGE_RADIUS)).otherwise(snippet(source, terms))
    out = out.withColumn("match", preview)
    out = out.withColumn("highlights", F.struct(first_ranges(F.col("question"), terms).alias("question"), first_ranges(F.col("match"), terms).alias("answer")))
    flag = F.lit(bool(terms)) & (F.col("found_by") != "keyword") & (F.size("highlights.question") == 0) & (F.size("highlights.answer") == 0)
    return out.withColumn("semantic_only", flag).select(*RESPONSE).orderBy("rank")


def page(rows: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """Page ``number`` from 0 of rows with a rank from 1: a filter, not an offset."""
    return rows.where((F.col("rank") > number * size) & (F.col("rank") <= (number + 1) * size))

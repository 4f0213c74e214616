"""Canonical episodes: the declared schema, the JSON scan and sink, and the flattened relations."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = "struct<segment_id:string, type:string, question_text:string, answer_text:string, start_sec:int, end_sec:int, ord:int, tokens:int, speaker_names:array<string>>"
EPISODE = f"episode_id string, number int, title string, publish_date date, source_url string, transcript_url string, transcript_text string, speakers array<string>, audio_url string, youtube_id string, duration_sec int, segments array<{SEGMENT}>, content_hash string"


def read_lines(spark: SparkSession, path: str, schema: str, whole_files: bool = False) -> DataFrame:
    """JSON rows under a folder; a malformed one fails the scan, a missing folder has none."""
    try:
        return spark.read.schema(schema).option("multiLine", whole_files).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The episodes under a folder."""
    return read_lines(spark, path, EPISODE, whole_files=True)


def append(episodes: DataFrame, path: str) -> None:
    """One folder an episode, as JSON."""
    episodes.withColumn("key", F.col("episode_id")).repartition("key").write.mode("append").partitionBy("key").json(path)


def segments(episodes: DataFrame) -> DataFrame:
    """One row a segment, with its episode and year."""
    return episodes.select("episode_id", F.year("publish_date").alias("shard"), F.explode("segments").alias("s")).select("episode_id", "shard", "s.*", F.col("s.question_text").alias("question"), F.col("s.answer_text").alias("answer"))


def headers(episodes: DataFrame) -> DataFrame:
    """The small dimension of episodes."""
    return episodes.select("episode_id", "number", "title", "publish_date", "audio_url", "youtube_id", F.size("segments").alias("count"))

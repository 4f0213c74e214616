"""The driver tables as the domain's relations: documents are segments, their language the shard, their source the episode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(rows: DataFrame) -> DataFrame:
    """Texts over all cores: a table of fewer partitions than cores is dealt out. A large table has more, and is left as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_id, episode_id, shard, type, start_sec, question (first line), answer (the rest)."""
    text = F.coalesce("text", F.lit(""))
    cut = F.instr(text, "\n")
    kind = F.when(F.col("doc_id") % 4 == 0, "intro").when(F.col("doc_id") % 4 == 1, "answer").otherwise("question")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("segment_id"), F.col("source").alias("episode_id"), F.col("lang").alias("shard"), kind.alias("type"), (F.col("doc_id") % 3600).alias("start_sec"),
        F.when(cut > 0, F.substring(text, F.lit(1), cut - 1)).otherwise(text).alias("question"),
        F.when(cut > 0, F.substr(text, cut + 1)).otherwise("").alias("answer"),
    )

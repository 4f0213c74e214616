"""Incremental ingest as a stream of page files: each batch adds the episodes and snapshots that are new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.operators import ingest
from colloquy.sources import episodes as store
from colloquy.sources import pages as html

PAGES = "title string, source_url string, publish_date date, html string"


def add_batch(pages: DataFrame, content: str, cache: str, host: str, aliases: tuple[str, ...] = ()) -> DataFrame:
    """Store what is new of a batch of episode pages, and return discovered, processed, skipped. Running it again adds nothing."""
    spark = pages.sparkSession
    existing = store.read(spark, content).select("episode_id", "source_url", "number")
    new = ingest.numbered(ingest.unseen(pages.drop("html"), existing), existing).persist()
    counts = ingest.summary(pages, new).collect()
    bodies = pages.select(F.col("source_url").alias("url"), "html")
    made = ingest.episodes(new, bodies, host, aliases).persist()
    if not made.isEmpty():
        used = bodies.join(new.select(F.col("source_url").alias("url")), "url", "left_semi")
        html.append_cache(used, cache)
        store.append(made, content)
    new.unpersist(), made.unpersist()
    return spark.createDataFrame(counts, "discovered long, processed long, skipped long")


def start(spark: SparkSession, pages: str, content: str, cache: str, progress: str, host: str, aliases: tuple[str, ...] = ()) -> StreamingQuery:
    """Read new page files (JSON lines) once and stop; the anti-joins make a repeated batch harmless."""
    def add(batch: DataFrame, _: int) -> None:
        kept = batch.persist()
        try:
            add_batch(kept, content, cache, host, aliases)
        finally:
            kept.unpersist()

    stream = spark.readStream.schema(PAGES).json(pages)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", progress).trigger(availableNow=True).start()

"""The keyword index as stored tables, each written on first use and then read.

keyword      shard, term, segment_id, weight and what filters and order need: ranged and sorted by (shard, term, segment_id), so a
             term's rows are a few row groups, a hot term is cut over files, and the number of files follows the data
autocomplete shard, term, freq, rk: the most frequent terms of each shard, sorted by term
prefixes     shard, prefix, term, rk: the first suggestions of each prefix of up to four letters, sorted by prefix
spellings    shard, word: each shard's vocabulary, sorted by word
blocks       the keyword table's rows with place and block: ranged by (shard, place), sorted by (shard, block, term)
tops         shard, term, block, top: the largest weight of a term in a block
bitmaps      facet, value, bucket, bits: the places of each type's and episode's segments
statistics   term, freq, df of the embedding tokens of all texts
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import keyword, semantic


def by_range(rows: DataFrame, *order: str) -> DataFrame:
    """Ranged over partitions and sorted inside them: clustered for reads by ``order``, without a constant or a hot file."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def files_state(rows: DataFrame) -> str:
    """A digest of the paths, sizes and times of the files that the rows are read from: another one if any changes."""
    files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    got = files.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("*")), F.lit(0)).alias("x")).head()
    return f"{got.n}-{got.x & 0xFFFFFFFFFFFFFFFF:016x}"


class Store:
    """The tables of one folder. ``segments`` gives the segments of the texts that they are made of."""

    def __init__(self, segments: Callable[[], DataFrame], folder: str):
        self.segments, self.folder = segments, folder
        self.written: set[str] = set()
        self._schemas: dict = {}

    def _make(self, name: str) -> DataFrame:
        if name == "keyword":
            return by_range(keyword.postings(self.segments()), "shard", "term", "segment_id")
        if name == "autocomplete":
            return by_range(keyword.ranked_terms(self.read("keyword")), "shard", "term")
        if name == "prefixes":
            return by_range(keyword.prefix_blocks(self.read("autocomplete")), "shard", "prefix", "rk")
        if name == "spellings":
            return by_range(self.read("blocks" if "keyword" not in self.written and "blocks" in self.written else "keyword").select("shard", F.col("term").alias("word")).distinct(), "shard", "word")
        if name == "blocks":
            return keyword.placed(self.segments())
        if name == "tops":
            return by_range(keyword.block_tops(self.read("blocks")), "shard", "term", "block")
        if name == "bitmaps":
            return keyword.facet_bitmaps(self.read("blocks"), "type", "episode_id").sortWithinPartitions("facet", "value")
        text = F.concat_ws("\n", F.nullif("question", F.lit("")), F.nullif("answer", F.lit("")))
        return semantic.term_stats(semantic.token_rows(self.segments(), "segment_id", text), "segment_id").sortWithinPartitions("term")

    def read(self, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        if name not in self.written:
            made = self._make(name)
            writer = made.write.mode("overwrite")
            (writer.partitionBy("shard") if "shard" in made.columns else writer).parquet(path)
            self._schemas[name] = made.schema
            self.written.add(name)
        spark = self.segments().sparkSession
        return spark.read.schema(self._schemas[name]).parquet(path)

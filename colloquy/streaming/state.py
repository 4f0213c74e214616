"""Keyed state that outlives a batch: processors with named, typed states in the RocksDB store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed(rows: DataFrame, key: str, processor: StatefulProcessor, output: str, time_mode: str = "None") -> DataFrame:
    """The rows of a stream through a processor with state for each key, in update mode.

    Such state needs the RocksDB store: sessions that name no store, and this one alone, are set to it.
    """
    spark = rows.sparkSession
    if spark.conf.get(PROVIDER, "").endswith("HDFSBackedStateStoreProvider") or not spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)
    return rows.groupBy(key).transformWithStateInPandas(processor, output, "update", time_mode)

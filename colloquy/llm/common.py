"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from colloquy.sources.corpus import table  # noqa: F401  the tables of the registered queries

#: Rows and bytes of one Arrow batch, so that a batch of long documents stays small in a Python worker.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. One is made only for a local master without it (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def by_position(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], fields: list[StructField] | None = None) -> DataFrame:
    """``docs.mapInArrow`` that goes by the places of columns, so that they may have any names; ``fields``: of the result."""
    fields = list(docs.schema) if fields is None else fields
    given, made = ([f"c{k}" for k in range(n)] for n in (len(docs.columns), len(fields)))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, made)

    return docs.toDF(*given).mapInArrow(named, StructType([StructField(n, f.dataType) for n, f in zip(made, fields)])).toDF(*(f.name for f in fields))


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, with a number behind each that ``columns`` has already (letter case aside)."""
    have = {c.lower() for c in columns}
    return [next(n for n in (name, *(f"{name}_{k}" for k in range(len(have) + 1))) if n.lower() not in have) for name in names]


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learnt from: crc32 of the id as text, mod 3, is 1 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learnt_labels(labels: DataFrame, target: str, fold: bool = True) -> DataFrame:
    """(doc_id, y) of the labelled ids that may be learnt from: the larger of an id's labels; not the held-out ids when ``fold``."""
    rows = labels.select("doc_id", F.col(target).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if fold:
        rows = rows.where(~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, fold: bool = True) -> DataFrame:
    """(doc_id, y, text) of at most ``per_class`` labelled documents of each class, from whole texts.

    The rows with the smallest hash of the id are taken, so a run repeats. Held-out ids are left out when ``fold``.
    Ids with several labels count as the larger one, repeated ids count once, null labels or ids not at all.
    """
    rows = learnt_labels(labels, target, fold)
    picks = [rows.where(F.col("y") == k).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(per_class) for k in (0, 1)]
    picked = picks[0].unionByName(picks[1])  # at most 2 * per_class rows, so it may be broadcast
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end, and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if column.null_count:  # a null may cover bytes
        return utf8(column.fill_null(b""))
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(ends), np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def roc_auc(y: np.ndarray, score: np.ndarray) -> float:
    """Area under the ROC curve with ties counted as half."""
    order = np.argsort(score, kind="stable")
    ranked, ranks = score[order], np.empty(len(score))
    first, last = np.searchsorted(ranked, ranked, "left"), np.searchsorted(ranked, ranked, "right")
    ranks[order] = (first + last + 1) / 2
    positive = y == 1
    n1, n0 = positive.sum(), (~positive).sum()
    return float((ranks[positive].sum() - n1 * (n1 + 1) / 2) / max(n1 * n0, 1))

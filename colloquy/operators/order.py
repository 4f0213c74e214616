"""Numbers in an order, without one task that sees all rows, and the shared folder that cuts lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ``monotonically_increasing_id`` keeps the partition above this many bits, and the place in it below.
PLACE_BITS = 33


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one is made only for a local master without it (tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def stored(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, without the lineage that made them."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def apart(spark: SparkSession, n: int) -> list[int]:
    """n numbers that ``together`` deals to unlike partitions, or evenly if they are more than those."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found: dict[int, list[int]] = {}
    for number, part in spark.range(16 * max(n, parts)).select("id", F.pmod(F.hash("id"), F.lit(parts))).collect():
        found.setdefault(part, []).append(number)
    return [number for _, number in sorted((place, number) for own in found.values() for place, number in enumerate(own))[:n]]


def stored_by(rows: DataFrame, key: str, cut: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """The rows stored with those of a key in one partition, in a way that later groups by the key read them where they are.

    Adaptive plans don't tell how their rows are dealt out, so this one is made as it stands."""
    conf = rows.sparkSession.conf
    was = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(together(rows, key))
    finally:
        conf.set("spark.sql.adaptive.enabled", was)


def together(rows: DataFrame, key: str) -> DataFrame:
    """The rows with those of a key in one partition: counts by the key and what a row explodes to need no further shuffle."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _free(rows: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that are in use."""
    have = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name in have:
            name = f"_{name}"
        have.add(name)
        out.append(name)
    return out


def ranged(rows: DataFrame, *order: str | Column) -> tuple[DataFrame, list[str]]:
    """The rows ranged over partitions and sorted in them, stored with two more columns (named in the list): partition and place in it.

    Stored, so that whatever reads them twice sees one order even if a task runs again.
    """
    mark, part, inside = _free(rows, "_mark", "_part", "_inside")
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id()))
    return placed.withColumn(part, F.shiftright(mark, PLACE_BITS)).withColumn(inside, F.col(mark).bitwiseAND((1 << PLACE_BITS) - 1)).drop(mark), [part, inside]


def numbered(rows: DataFrame, *order: str | Column, start: int = 1, name: str = "number") -> DataFrame:
    """The rows with a gapless ``name`` from ``start`` in ``order`` (a total order, or ties fall anyhow).

    Partitions add what stands before them: one row a partition, broadcast.
    """
    placed, (part, inside) = ranged(rows, *order)
    count, ahead = _free(placed, "_rows", "_ahead")
    sizes = placed.groupBy(part).agg(F.count("*").alias(count))
    before = F.coalesce(F.sum(count).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = placed.join(F.broadcast(sizes.select(part, before.alias(ahead))), part)
    return met.withColumn(name, F.col(ahead) + F.col(inside) + F.lit(start)).drop(part, inside, ahead)


def neighbours(rows: DataFrame, key: str, by: str) -> DataFrame:
    """The rows with ``before`` and ``after``: ``by`` of the row before and after in the key's order, or their own at an end.

    Rows are ranged by (key, by), so a key of any size is cut over tasks; each range is told the last row before it and the first
    behind it: one row a range.
    """
    placed, (part, inside) = ranged(rows, key, by)
    edge = placed.groupBy(part).agg(F.max_by(F.struct(key, by), inside).alias("_last"), F.min_by(F.struct(key, by), inside).alias("_first"))
    whole = Window.orderBy(part)
    edges = edge.select(F.col(part).alias("_of"), F.lag("_last").over(whole).alias("_left"), F.lead("_first").over(whole).alias("_right"))
    met = placed.join(F.broadcast(edges), F.col(part) == F.col("_of"))
    own = Window.partitionBy(part).orderBy(inside)
    near = lambda step, at_edge: F.when(step(key).over(own).isNull() & step(by).over(own).isNull(), at_edge).otherwise(F.struct(step(key).over(own).alias(key), step(by).over(own).alias(by)))
    both = met.withColumn("_b", near(F.lag, F.col("_left"))).withColumn("_a", near(F.lead, F.col("_right")))
    same = lambda c: F.when(F.col(c)[key].eqNullSafe(F.col(key)), F.col(c)[by])
    return both.select(*rows.columns, F.coalesce(same("_b"), F.col(by)).alias("before"), F.coalesce(same("_a"), F.col(by)).alias("after"))

"""Reciprocal rank fusion of two limited lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SMOOTH = 60


def ranked(rows: DataFrame, name: str, *order) -> DataFrame:
    """A rank from 1; the list is already cut to a few hundred rows, so one task holds it."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def fuse(first: DataFrame, second: DataFrame, key: str, n: int, smooth: int = SMOOTH) -> DataFrame:
    """key, first_rank, second_rank, score: the sum of 1 / (smooth + rank) over the lists that have the key.

    ``first`` has key and ``first_rank``, ``second`` key and ``second_rank``. Ties keep the first list's order, then the second's.
    """
    part = lambda c: F.coalesce(1.0 / (smooth + F.col(c)), F.lit(0.0))
    both = first.select(key, "first_rank").join(second.select(key, "second_rank"), key, "full_outer")
    score = part("first_rank") + part("second_rank")
    return both.withColumn("score", score).orderBy(F.desc("score"), F.col("first_rank").asc_nulls_last(), F.col("second_rank").asc_nulls_last()).limit(n)

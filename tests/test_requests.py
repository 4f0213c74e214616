"""A stale request ends, and ended ones are on record."""

import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.plans.query_state import QueryState
from colloquy.plans.requests import Requests


class Slow:
    """An engine whose "slow" query takes 100 s on four cores."""

    def __init__(self, spark):
        self.spark = spark

    def search(self, state):
        @F.pandas_udf("long")
        def wait(x: pd.Series) -> pd.Series:
            time.sleep(5)
            return x

        rows = self.spark.range(0, 80, 1, 80)
        return rows.select(wait("id").alias("id")) if state.query == "slow" else rows.limit(7)


def test_a_newer_request_ends_the_one_before(spark):
    asked, got = Requests(Slow(spark)), {}
    older = threading.Thread(target=lambda: got.update(old=asked.ask(1, QueryState("slow"))))
    began = time.perf_counter()
    older.start()
    while not spark.sparkContext.statusTracker().getActiveJobsIds():
        time.sleep(0.2)
    assert len(asked.ask(2, QueryState("fast", "keyword"))) == 7
    older.join(40)
    assert not older.is_alive() and got == {"old": None}
    assert time.perf_counter() - began < 60  # its tasks under way end, the others never begin
    assert asked.ask(1, QueryState("late")) is None
    log = {r.request: r for r in asked.log().collect()}
    assert (log[2].rows, log[2].mode, log[2].stale) == (7, "keyword", False) and log[2].milliseconds > 0
    assert log[1].stale and log[1].rows is None


def test_errors_of_the_newest_request_are_raised(spark):
    class Broken(Slow):
        def search(self, state):
            return self.spark.range(1).select(F.raise_error(F.lit("broken")))

    with pytest.raises(Exception, match="broken"):
        Requests(Broken(spark)).ask(1, QueryState("x"))

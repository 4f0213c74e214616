"""Requests of one session: a newer one ends the jobs of those before it, and each that ends leaves a record of its latency."""

from __future__ import annotations

import time
import uuid
from threading import Lock

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

from colloquy.plans.query_state import QueryState

RECORD = "request long, mode string, query string, rows long, milliseconds double, stale boolean"


class Requests:
    """``ask`` may be called from several threads of a driver; request numbers grow with time."""

    def __init__(self, engine):
        self.engine, self.spark, self.context = engine, engine.spark, engine.spark.sparkContext
        self.name, self.newest, self.lock = f"requests-{uuid.uuid4().hex}", -1, Lock()
        self.running: set[int] = set()
        self.records: list[tuple] = []

    def _tag(self, request: int) -> str:
        return f"{self.name}-{request}"

    def ask(self, request: int, state: QueryState) -> list[Row] | None:
        """The results, in order; None if a newer request has come before the end, whose jobs are then stopped."""
        with self.lock:
            if request < self.newest:
                return None
            stale, self.newest = [r for r in self.running if r < request], request
            self.running.add(request)
        for old in stale:
            self.context.cancelJobsWithTag(self._tag(old))
        began, rows, counted = time.perf_counter(), None, Observation()
        self.context.addJobTag(self._tag(request))
        try:
            found = self.engine.search(state).observe(counted, F.count(F.lit(1)).alias("rows"))
            if request >= self.newest:  # made stale before any of its jobs ran
                rows = found.collect()
        except (PySparkException, Py4JError):
            if request >= self.newest:
                raise
        finally:
            self.context.removeJobTag(self._tag(request))
            with self.lock:
                self.running.discard(request)
        stale_now = request < self.newest
        self.records.append((request, state.mode, state.query, counted.get["rows"] if rows is not None else None, 1000 * (time.perf_counter() - began), stale_now))
        return None if stale_now else rows

    def log(self) -> DataFrame:
        """request, mode, query, rows, milliseconds, stale of the requests that have ended."""
        return self.spark.createDataFrame(self.records, RECORD)

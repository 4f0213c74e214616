"""A coarse vector index: cells around k-means centres, searched from the nearest cell on.

Centres are fitted on at most SAMPLE vectors (those of the smallest hash of their key, so a build repeats); every vector is stored
in the cell of its nearest centre, with cells as partitions, so a query reads the folders of the cells that it probes. The
exact mode bounds each cell: with r the largest distance of a vector of the cell to its centre c, no vector of it has a product
with the query q above q . c + |q| r. Cells are read by falling bound, and those whose bound lies below the k-th score are never
read; so the result is that of reading all.

Vectors are byte vectors (``quantize``), products are whole numbers. Ties go to the smaller key. Null vectors have no cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.vectors import int_dot

#: Vectors that centres are fitted on, rounds of fitting, and vectors that a cell should hold.
SAMPLE, ROUNDS, EACH, SEED = 16_384, 8, 4096, 19


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)


def fit(vectors: DataFrame, key: str, count: int) -> np.ndarray:
    """Up to ``count`` centres (count, dimension): k-means over the sample, on the driver, whose size is bounded."""
    rows = vectors.where("q is not null").orderBy(F.xxhash64(key, F.lit(SEED)), key).select("q").limit(SAMPLE).collect()
    if not rows:
        return np.zeros((0, 0))
    x = np.unique(np.array([r.q for r in rows], float), axis=0)
    rng = np.random.default_rng(SEED)
    centres = x[np.sort(rng.permutation(len(x))[:count])]
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """The vectors (key, q) with ``cell``, the number of the nearest centre; the centres are bounded and go with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_nearest(x, centres).astype(np.int32))], ["key", "q", "cell"])

    return vectors.mapInArrow(run, "key long, q array<tinyint>, cell int")


@dataclass
class Cells:
    """A stored index: its table (key, q, cell, ...), the centres, and of each cell the count and the radius."""

    vectors: DataFrame
    centres: np.ndarray
    counts: dict[int, int]
    radius: dict[int, float]

    def order(self, query: list[int]) -> list[int]:
        """The cells, that with the largest product of centre and query first."""
        if not self.counts:
            return []
        return [k for k in np.argsort(-(self.centres @ np.array(query, float)), kind="stable").tolist() if k in self.counts]

    def bound(self, query: list[int]) -> dict[int, float]:
        """What the product of the query with any vector of a cell cannot exceed."""
        if not self.counts:
            return {}
        q = np.array(query, float)
        dots, norm = self.centres @ q, float(np.sqrt(q @ q))
        return {k: float(dots[k]) + norm * r + 1e-6 * (1 + abs(float(dots[k])) + norm * r) for k, r in self.radius.items()}

    def _scored(self, query: list[int], cells: list[int], skip: int | None) -> DataFrame:
        literal = F.array(*(F.lit(int(v)) for v in query))
        rows = self.vectors.where(F.col("cell").isin(cells))
        if skip is not None:
            rows = rows.where(F.col("key") != skip)
        return rows.select("key", int_dot(literal, F.col("q")).alias("score"))

    def probe(self, query: list[int], n: int, probes: int, skip: int | None = None) -> DataFrame:
        """key, score of the n best vectors in the first ``probes`` cells of ``order``; ``skip`` is a key to leave out."""
        return self._scored(query, self.order(query)[:probes], skip).orderBy(F.desc("score"), "key").limit(n)

    def exact(self, query: list[int], n: int, skip: int | None = None) -> tuple[DataFrame, list[int]]:
        """key, score of the n best of all vectors, and the cells that were read."""
        bounds = self.bound(query)
        left = sorted(bounds, key=lambda k: (-bounds[k], k))
        read, best, step = [], None, 1
        while left:
            least = best[-1].score if best is not None and len(best) == n else -np.inf
            now = [k for k in left[:step] if bounds[k] >= least]
            if not now:
                break
            found = self._scored(query, now, skip).orderBy(F.desc("score"), "key").limit(n).collect()
            best = sorted((best or []) + found, key=lambda r: (-r.score, r.key))[:n]
            read, left, step = read + now, left[step:], step * 2
        spark = self.vectors.sparkSession
        rows = [(r.key, r.score) for r in best or []]
        empty = spark.range(0).select(F.col("id").alias("key"), F.col("id").alias("score"))
        made = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).cast("long").alias("key"), F.lit(s).cast("long").alias("score")) for k, s in rows)))) if rows else empty
        return made, read


def build(vectors: DataFrame, key: str, path: str, count: int | None = None) -> Cells:
    """Write the vectors (key, q) by cell below ``path``; without ``count`` a cell holds EACH vectors or so."""
    own = vectors.select(F.col(key).cast("long").alias("key"), "q").where("q is not null")
    if count is None:
        count = max(1, min(-(-own.count() // EACH), SAMPLE // 16))
    centres = fit(own, "key", count)
    # a cell may be large: its rows are dealt over files by key
    placed(own, centres).repartitionByRange("cell", "key").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark = vectors.sparkSession
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    stored = spark.read.schema("key long, q array<tinyint>, cell int").parquet(f"{path}/vectors")
    centre = spark.read.parquet(f"{path}/centres")
    off = F.aggregate(F.zip_with("q", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    shape = stored.join(centre, "cell").groupBy("cell").agg(F.count("*").alias("n"), F.sqrt(F.max(off)).alias("radius"))
    shape.coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")
    return open_(spark, path)


def open_(spark: SparkSession, path: str) -> Cells:
    """A stored index. Centres and shapes are bounded by the number of cells."""
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    shape = spark.read.parquet(f"{path}/shape").collect()
    vectors = spark.read.schema("key long, q array<tinyint>, cell int").parquet(f"{path}/vectors")
    return Cells(vectors, np.array([r.centre for r in centres]) if centres else np.zeros((0, 0)), {r.cell: r.n for r in shape}, {r.cell: r.radius for r in shape})

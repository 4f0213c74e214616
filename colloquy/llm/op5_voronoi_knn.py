"""Exact top-k inner-product search as a Voronoi k-nearest-neighbour join.

Vectors are turned into integers, floor(1024 x). One more coordinate, sqrt(M^2 - |v|^2) for data and 0 for queries with M the
largest norm, makes Euclidean order the inverse of inner-product order. Queries and data are grouped by their nearest pivot.
Summaries of the groups (query count and radius, the k + 1 ids of each data group nearest to its pivot, with their vectors)
bound how far any query's k-th neighbour can be: by the triangle inequality over the pivots, and more closely by Cauchy and
Schwarz, since pivot . x plus and minus radius |x| bound the score of every query of a group. A data row is copied only to the
query groups whose bounds it can meet, once for each block of the group's queries, and each (query group, data block) is solved
locally. The local top k are merged by rank. Where a sample shows that the bounds prune too little for several groups to pay (evenly
spread vectors, which no bound can part), all queries are one group.

Rows whose vector is null or empty, holds a null or non-finite component, or has another length than the most common one (of two
as common, the shorter) take no part, nor do null ids. A query's own id is never among its candidates. Repeated ids: the query is the smallest of its vectors; as
candidates all their rows count. Scores must fit a 64-bit integer. Equal scores go to the smaller id. No rows: no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, SCALE, EVERY = 10, 1024, 100
#: Pivots come from a sample of at most SAMPLE vectors; one pivot for QUERIES_EACH queries, within PIVOTS.
SAMPLE, QUERIES_EACH, PIVOTS, SEED = 2048, 256, (4, 256), 3
#: Rows of a data block and of a query block, which bound a local problem.
BLOCK, QUERY_BLOCK = 2048, 512
#: What a copy of a row costs, which is shuffled, against a score of it.
COPY = 64


@dataclass
class Bounds:
    pivots: np.ndarray
    radius: np.ndarray  # of each query group; -1 without queries
    reach: np.ndarray  # how far the k-th neighbour of any query of the group can be
    spread: np.ndarray  # as radius, without the extra coordinate
    least: np.ndarray  # the score that the k-th neighbour of any query of the group has at least
    parts: np.ndarray  # query blocks of each group
    sizes: np.ndarray  # queries of each group
    largest: float  # M^2

    def needed(self, v: np.ndarray) -> np.ndarray:
        """(row, group): whether a query of the group may have the row among its k best."""
        lifted = raised(v, self.largest)
        near = distances(lifted, self.pivots) - self.radius <= self.reach + 1e-6 * (1 + np.sqrt(self.largest))
        v = v.astype(float)
        score = v @ self.pivots[:, :-1].T + self.spread * np.sqrt((v * v).sum(1))[:, None]
        return (self.radius >= 0) & near & (score >= self.least - 1e-9 * (1 + self.largest))


def whole(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, as integers."""
    valid = vectors.select(F.col("vec_id").cast("long"), "embedding").where("vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    sizes = valid.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return valid.where(F.size("embedding") == (sizes[0].n if sizes else 0)).select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long")).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def raised(v: np.ndarray, largest: float | None) -> np.ndarray:
    """``v`` with the extra coordinate: of a data row, or 0 for a query (``largest`` None)."""
    v = v.astype(float)
    extra = np.zeros(len(v)) if largest is None else np.sqrt(np.maximum(largest - (v * v).sum(1), 0))
    return np.hstack([v, extra[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """A few rounds of k-means over the sample."""
    rng = np.random.default_rng(SEED)
    pivots = sample[np.sort(rng.permutation(len(sample))[:count])]
    for _ in range(5):
        near = distances(sample, pivots).argmin(1)
        pivots = np.stack([sample[near == j].mean(0) if (near == j).any() else pivots[j] for j in range(len(pivots))])
    return pivots


def asking(queries: DataFrame, pivots: np.ndarray) -> list:
    """cell, n, radius, spread of the groups of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(raised(matrix(batch.column("v")), None), pivots)
                cell = d.argmin(1)
                flat = np.sqrt(np.maximum(d.min(1) ** 2 - pivots[cell, -1] ** 2, 0))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(d.min(1)), pa.array(flat)], ["cell", "radius", "spread"])

    return queries.select("v").mapInArrow(run, "cell int, radius double, spread double").groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius"), F.max("spread").alias("spread")).collect()


def nearest(data: DataFrame, pivots: np.ndarray, largest: float, k: int) -> list:
    """cell, distance, vec_id, v of the k + 1 ids of each group of data nearest to its pivot; each task sends no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v = batch.column("vec_id").to_numpy(zero_copy_only=False), matrix(batch.column("v"))
            d = distances(raised(v, largest), pivots)
            cell = d.argmin(1)
            for c in np.unique(cell).tolist():
                own = np.flatnonzero(cell == c)
                far, at, x = (np.concatenate(pair) for pair in zip(held.get(c, (np.zeros(0), np.zeros(0, np.int64), v[:0])), (d[own, c], ids[own], v[own])))
                order = np.lexsort((at, far))
                first = np.sort(np.unique(at[order], return_index=True)[1])[: k + 1]  # a repeated id counts once
                held[c] = (far[order][first], at[order][first], x[order][first])
        for c, (far, at, x) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(far), pa.array(at), pa.array(x.tolist(), pa.list_(pa.int64()))], ["cell", "distance", "vec_id", "v"])

    found = data.mapInArrow(run, "cell int, distance double, vec_id long, v array<long>")
    apart = found.groupBy("cell", "vec_id").agg(F.min("distance").alias("distance"), F.min_by("v", "distance").alias("v"))
    order = Window.partitionBy("cell").orderBy("distance", "vec_id")
    return apart.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1).drop("rank").collect()


def bound(data: DataFrame, queries: DataFrame, pivots: np.ndarray, largest: float, k: int) -> Bounds:
    count = len(pivots)
    radius, spread, parts, sizes = np.full(count, -1.0), np.zeros(count), np.zeros(count, np.int64), np.zeros(count, np.int64)
    for r in asking(queries, pivots):
        radius[r.cell], spread[r.cell], parts[r.cell], sizes[r.cell] = r.radius, r.spread, -(-r.n // QUERY_BLOCK), r.n
    between = distances(pivots, pivots)
    known = nearest(data, pivots, largest, k)
    reach, least = np.full(count, np.inf), np.full(count, -np.inf)
    ids, own = np.unique(np.array([r.vec_id for r in known], np.int64), return_inverse=True)
    if len(ids) > k:
        cell, near = np.array([r.cell for r in known]), np.array([r.distance for r in known])
        v = np.array([r.v for r in known], float)
        size = np.sqrt((v * v).sum(1))
        for i in np.flatnonzero(radius >= 0):
            each, score = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)  # an id may have rows in several cells
            np.minimum.at(each, own, radius[i] + between[i, cell] + near)
            np.maximum.at(score, own, v @ pivots[i, :-1] - spread[i] * size)
            reach[i] = np.partition(each, k)[k]  # k + 1 ids, as one may be the query's own
            least[i] = -np.partition(-score, k)[k]
    return Bounds(pivots, radius, reach, spread, least, parts, sizes, largest)


def planned(data: DataFrame, queries: DataFrame, asked: int, largest: float, k: int) -> Bounds:
    """The groups and their bounds; one group where the sample shows that several would cost more.

    A row costs its copies, COPY each, and the scores of the queries that it meets. Without pruning the scores are the same, so one
    group makes the fewest copies: one for each block that all queries fill.
    """
    sample = np.array([r.v for r in data.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE).collect()], np.int64)
    lifted = raised(sample, largest)
    bounds = bound(data, queries, choose_pivots(lifted, int(np.clip(-(-asked // QUERIES_EACH), *PIVOTS))), largest, k)
    if (bounds.needed(sample) @ (COPY * bounds.parts + bounds.sizes)).mean() < COPY * -(-asked // QUERY_BLOCK) + asked:
        return bounds
    return bound(data, queries, choose_pivots(lifted, 1), largest, k)


def best(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each query's k best of one block: larger score first, then smaller id."""
    exact = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * data.shape[1] < 2.0**52
    scores = (queries.astype(float) @ data.T.astype(float)).astype(np.int64) if exact else queries @ data.T
    for q, row in zip(query_ids, scores):
        other = ids != q
        own, score = ids[other], row[other]
        if len(own) > k:
            may = score >= np.partition(score, len(own) - k)[len(own) - k]
            own, score = own[may], score[may]
        order = np.lexsort((own, -score))[:k]
        yield int(q), own[order], score[order]


KEYED = "cell int, part int, block int, vec_id long, v array<long>"


def spread_over(ids: pa.Array, parts: int | np.ndarray) -> np.ndarray:
    """A part of ``parts`` for each id, by its hash."""
    x = ids.to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
    return x % np.asarray(parts).astype(np.uint64)


def copies(data: DataFrame, bounds: Bounds, blocks: int) -> DataFrame:
    """Each data row once for each query group that may need it and each block of that group's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, cell = np.nonzero(bounds.needed(matrix(batch.column("v"))))
            times = bounds.parts[cell]
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            block = spread_over(batch.column("vec_id"), blocks).astype(np.int32)
            for at in range(0, len(row), 8192):
                s = slice(at, at + 8192)
                yield pa.RecordBatch.from_arrays([pa.array(cell[s].astype(np.int32)), pa.array(part[s].astype(np.int32)), pa.array(block[row[s]]), *batch.take(pa.array(row[s])).columns], ["cell", "part", "block", "vec_id", "v"])

    return data.mapInArrow(run, KEYED)


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    data = whole(vectors)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size = data.agg(F.count("*").alias("n"), F.max(square).alias("largest"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q")).collect()[0]
    if not size.n or not size.q:
        return spark.createDataFrame([], schema)
    queries = data.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    bounds = planned(data, queries, size.q, size.largest, k)
    blocks = -(-size.n // BLOCK)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query in its group and block, once for each data block."""
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = distances(raised(matrix(batch.column("v")), None), bounds.pivots).argmin(1)
            part = (spread_over(batch.column("vec_id"), bounds.parts[cell])).astype(np.int32)
            for block in range(blocks):
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(part), pa.array(np.full(len(cell), block, np.int32)), *batch.columns], ["cell", "part", "block", "vec_id", "v"])

    def solve(queried: pd.DataFrame, having: pd.DataFrame) -> pd.DataFrame:
        if queried.empty or having.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        found = [(np.full(len(i), q), i, s) for q, i, s in best(np.stack(queried.v.to_list()), queried.vec_id.to_numpy(), np.stack(having.v.to_list()), having.vec_id.to_numpy(), k)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(x) for x in zip(*found)))))

    keys = ("cell", "part", "block")
    local = queries.select("vec_id", "v").mapInArrow(asked, KEYED).groupBy(*keys).cogroup(copies(data, bounds, blocks).groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

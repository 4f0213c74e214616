"""Target-distribution importance resampling: documents are drawn as if from the target's distribution of hashed word runs.

Features of a text are all its runs of 1 to GRAMS consecutive words (A-Z lower-cased; words of letters, digits and characters
beyond ASCII), joined by single spaces; a feature's bucket is its CRC-32 modulo BUCKETS. One scan of a text makes them from a ring
of running zlib states, one for each of the last GRAMS starts: a new word begins a state, extends each other by a space and the
word, and the oldest leaves. No feature is ever built as a string.

1. Bucket counts of all documents and of the target are summed in each task, then over tasks: BUCKETS numbers reach the driver.
2. A bucket's gain is floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))), with s of S features of all documents in it,
   and t of T of the target. A second scan sums the gains of each document's features (its weight) and adds floor(1000 g), g the
   Gumbel noise of the hash of its id: the highest scores are a draw without replacement in proportion to exp(weight / 1000).
3. Of the documents with LEAST_WORDS words or more, the SHARE of highest scores is drawn. They are numbered over range partitions,
   so no task ranks all of them.

Null and empty texts have no features and weight 0. A null doc_id hashes as an empty one and comes after all others of its
score. Repeated ids give a row each, and equal scores of one id fall in any order. Other columns are ignored by ``scores`` and
kept by ``resample``. Without target texts t and T are 0; without documents there is no result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from colloquy.llm.common import by_position, checkpoint, unused
from colloquy.llm.op4_toxicity import texts
from colloquy.operators.order import numbered

GRAMS, BUCKETS, LEAST_WORDS, SHARE, SEED = 3, 10_000, 20, 5, 42
#: What a lower-cased text's bytes become: those of words stay, all others part words.
KEPT = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b >= 0x80 else 32 for b in range(256))
#: Words of a text whose buckets are held at once, and bytes that are split at once.
PART, BLOCK = 1 << 16, 1 << 20


def scan(text: bytes, grams: int = GRAMS, modulus: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """How many words, and the buckets of the features that end in them: in parts of at most PART words."""
    kept, at = text.lower().translate(KEPT), 0
    ring = [0] * grams  # ring[k]: the state of the start k words back, which has taken in k + 1 words
    older = range(0)  # the starts that the next word extends, oldest first
    out: list[int] = []
    words, tell = 0, out.append
    while at < len(kept):
        cut = kept.find(b" ", at + BLOCK)
        cut = cut if cut >= 0 else len(kept)
        for word in kept[at:cut].split():
            spaced = b" " + word
            for k in older:
                state = ring[k] = crc32(spaced, ring[k - 1])
                tell(state)
            state = ring[0] = crc32(word)
            tell(state)
            if len(older) < grams - 1:
                older = range(len(older) + 1, 0, -1)
            words += 1
            if words == PART:
                yield words, np.array(out, np.int64) % modulus
                out.clear()
                words = 0
        at = cut
    if words:
        yield words, np.array(out, np.int64) % modulus


def counts(docs: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for raw in texts(batch, 0):
                for _, part in scan(raw):
                    total += np.bincount(part, minlength=BUCKETS)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: np.ndarray, *names: str) -> DataFrame:
    """The columns of ``docs``, and under ``names``: features, words, weight and score."""
    at, by = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((4, batch.num_rows), np.int64)
            for k, (doc_id, raw) in enumerate(zip(batch.column(by).to_pylist(), texts(batch, at))):
                for words, part in scan(raw):
                    rows[:3, k] += len(part), words, gain[part].sum()
                rows[3, k] = rows[2, k] + noise(doc_id)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, rows)], [str(k) for k in range(batch.num_columns + 4)])

    return by_position(docs, run, [*docs.schema, *(StructField(n, LongType()) for n in names)])


def scores(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank (1 is the first drawn; null: not drawn) of every document."""
    named = weighed(docs.select(F.col("doc_id").cast("long"), "text"), gains(counts(docs), counts(target)), "n_features", "n_words", "weight", "score")
    rows = checkpoint(named.drop("text"))
    fit = F.col("n_words") >= LEAST_WORDS
    drawn = rows.where(fit).count() * SHARE // 100
    ranked = numbered(rows.where(fit), F.desc("score"), F.col("doc_id").asc_nulls_last(), name="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The drawn documents, as they are. Rows of the last drawn one's score and id all stay."""
    gain = gains(counts(docs), counts(target))
    features, words, weight, score = names = unused(docs.columns, "n_features", "n_words", "weight", "score")
    own = F.col("doc_id").cast("long").alias("doc_id")
    fit = checkpoint(weighed(docs.select(own, "text"), gain, *names).where(F.col(words) >= LEAST_WORDS).select("doc_id", score))
    order = F.desc(score), F.col("doc_id").asc_nulls_last()
    last = numbered(fit, *order, name=words).where(F.col(words) == fit.count() * SHARE // 100).head()
    if last is None:
        return docs.where(F.lit(False))
    before = F.lit(True) if last.doc_id is None else F.coalesce(F.col("doc_id") <= last.doc_id, F.lit(False))
    kept = weighed(docs, gain, *names).where((F.col(words) >= LEAST_WORDS) & ((F.col(score) > last[score]) | (F.col(score) == last[score]) & before))
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))

"""Quality rules: boosted trees over document statistics, scored as flat numpy node arrays.

The statistics of each whole text (words, symbols, repeated lines, repeated three-word windows, ...) feed trees that are held
monotonic on chosen ones: more symbols, repeated lines or repeated windows never raise a score. The trees are fitted on a
bounded, documented sample of labelled documents outside the held-out fold (``PER_CLASS`` of each class). A document is kept
if the base rules pass and the score is 0.5 or more.

Null and empty texts have no words: all statistics are 0 and the base rules fail. Repeated ids give a row each. Other columns
are ignored. Without two classes of labels the base rules alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import labelled_sample
from colloquy.llm.op4_toxicity import texts
from colloquy.llm.trees import Trees, fit as fit_trees

PER_CLASS, LEAST_WORDS, LEAST_SCORE = 2000, 50, 0.5
#: The symbols that count.
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "capitals", "digits", "ends", "line_words")
FALLING = {FEATURES.index(k): -1 for k in ("symbols", "dup_lines", "repeats")}

_KEEP = lambda chars: bytes(c for c in range(256) if c not in chars)
_NOT_SYMBOL, _NOT_SPACE, _NOT_UPPER, _NOT_DIGIT, _NOT_END = (_KEEP(x) for x in (SYMBOLS, b" \t\n\v\f\r", bytes(range(65, 91)), b"0123456789", b".!?"))
_CONTINUES = bytes(range(0x80, 0xC0))


def repeated(ids: np.ndarray) -> int:
    """Words that stand in a three-word window found twice or more; each counts once."""
    if len(ids) < 4:
        return 0
    if ids.max() < 1 << 21:
        key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # number the pairs first, so that a window still fits one integer
        pair = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True)[1]
        key = (pair[:-1] << 32) | ids[2:]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= again
    return int(covered.sum())


def statistics(raw: bytes) -> tuple[tuple[int, ...], list[float]]:
    """The base statistics and the trees' features of one text (UTF-8)."""
    words = raw.split()  # bytes split at exactly space and \t \n \v \f \r
    n = len(words)
    chars = len(raw) - len(raw.translate(None, _NOT_SPACE)) - len(raw.translate(None, bytes(set(range(256)) - set(_CONTINUES))))
    symbols = len(raw.translate(None, _NOT_SYMBOL))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dups = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    repeats = repeated(ids)
    m, size = max(n, 1), max(len(raw), 1)
    rest = [np.log1p(n), chars / m, symbols / m, dups / max(len(lines), 1), repeats / m, len(seen) / m, len(raw.translate(None, _NOT_UPPER)) / size, len(raw.translate(None, _NOT_DIGIT)) / size, len(raw.translate(None, _NOT_END)) / m, n / max(len(lines), 1)]
    return (n, chars, symbols, dups, repeats), rest


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Trees | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([statistics(raw)[1] for raw in texts(batch, 2)], pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = sorted(labelled_sample(docs, labels, "quality", per_class).mapInArrow(run, "doc_id long, y int, x array<double>").collect(), key=lambda r: r.doc_id)
    y = np.array([r.y for r in rows], float)
    return fit_trees(np.array([r.x for r in rows]), y, FALLING) if 0 < y.sum() < len(y) else None


def judge(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and the score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [statistics(raw) for raw in texts(batch)]
            score = trees.score(np.array([x for _, x in both])) if trees and both else np.ones(len(both))
            base = np.array([b for b, _ in both], np.int64).reshape(len(both), len(BASE))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(score)], ["doc_id", *BASE, "score"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", score double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", failed).select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("score") >= LEAST_SCORE)).alias("kept"), "score")

"""Toxicity: boosted trees over dense features, calibrated by isotonic regression.

The lexicon of words and of word stems (first four bytes) is learnt from a bounded, documented sample of labelled documents
outside the held-out fold (``PER_CLASS`` of each class): terms that are far more frequent in toxic documents. The features of
a document are lexicon densities, nearness of second-person words, rates of capitals and punctuation, and rates of obfuscated
words (letters mixed with digits or signs, read back to letters; a word ends at any ASCII white space). All documents are
scored over their whole texts, in time that grows with their length.

Null and empty texts have zero features and get the score that goes with them. Repeated ids give a row each. Other columns
are ignored. Without two classes of labels every document gets the share of toxic labels seen, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import by_position, held_out, labelled_sample, learnt_labels, utf8
from colloquy.llm.trees import Trees, fit as fit_trees, isotonic

#: A term enters the lexicon if LEAST_DOCS toxic documents of the sample have it, and LEAST_SHARE of them.
PER_CLASS, LEXICON, LEAST_DOCS, LEAST_SHARE, LEAST_WEIGHT, STEM, NEAR, FOLDS, THRESHOLD = 1500, 400, 4, 0.02, 2.5, 4, 5, 3, 0.7
#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine tu te toi ton ta vous votre vos ti tus usted ustedes vosotros".encode().split()
)
#: Signs that stand for letters.
LEET = bytes.maketrans(b"0134578@$!|", b"oieastbasil")
FEATURES = ("word_density", "word_hits", "stem_density", "stem_hits", "weight", "near_second", "second_rate", "capitals", "exclaims", "questions", "punctuation", "obfuscated", "obfuscated_hits", "words")
RISING = {i: 1 for i, name in enumerate(FEATURES) if name in ("word_density", "word_hits", "stem_density", "stem_hits", "weight", "obfuscated_hits")}

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
#: Classes of bytes: 1 capital, 2 small or beyond ASCII, 3 digit or sign that stands for a letter, 4 "!", 5 "?", 6 other punctuation, 0 space.
_CLASS = np.array([1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 or c >= 128 else 4 if c == 33 else 5 if c == 63 else 3 if 48 <= c <= 57 or c in b"@$*|" else 6 if c > 32 else 0 for c in range(256)], np.uint8)
_LETTER, _STANDS = np.isin(_CLASS, (1, 2)), np.isin(_CLASS, (3, 4))
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


@dataclass
class Model:
    words: dict[bytes, tuple[float, int]]  # weight, toxic documents of the sample
    stems: dict[bytes, tuple[float, int]]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def disguised(raw: bytes, data: np.ndarray) -> tuple[int, list[bytes]]:
    """How many signs or digits stand between two letters, and the words (between ASCII white space) that have some, each once."""
    letters = _LETTER[data]
    stands = np.flatnonzero(_STANDS[data[1:-1]] & letters[:-2] & letters[2:]) + 1
    if not len(stands):
        return 0, []
    edges = np.concatenate([[-1], np.flatnonzero(_SPACE[data]), [len(raw)]])
    k = np.unique(np.searchsorted(edges, stands))
    return len(stands), [raw[a + 1 : b] for a, b in zip(edges[k - 1].tolist(), edges[k].tolist())]


def features(raw: bytes, words: dict[bytes, tuple[float, int]], stems: dict[bytes, tuple[float, int]], least: int = 0) -> list[float]:
    """The features of one text. Terms that fewer than ``least`` toxic documents have do not count: a training document
    must not be recognised by words that only its own label put into the lexicon."""
    own = terms(raw)
    n = len(own)
    if not n:
        return [0.0] * len(FEATURES)
    hit = [i for i, w in enumerate(own) if w in words and words[w][1] >= least]
    stem = [i for i, w in enumerate(own) if w[:STEM] in stems and stems[w[:STEM]][1] >= least]
    second = [i for i, w in enumerate(own) if w in SECOND_PERSON]
    near = 0
    if second and (hit or stem):
        at = np.array(second)
        found = np.array(hit + stem)
        k = np.searchsorted(at, found)
        near = int((np.minimum(np.abs(found - at[np.maximum(k - 1, 0)]), np.abs(at[np.minimum(k, len(at) - 1)] - found)) <= NEAR).sum())
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(_CLASS[data], minlength=7)
    stands, masked = disguised(raw, data)
    plain = [w for word in masked for w in terms(word.translate(LEET))]
    hidden = sum((w in words and words[w][1] >= least) or (w[:STEM] in stems and stems[w[:STEM]][1] >= least) for w in plain)
    weight = sum(words[own[i]][0] for i in hit) + sum(stems[own[i][:STEM]][0] for i in stem)
    size = max(int(counts[1:].sum()), 1)
    return [100 * len(hit) / n, np.log1p(len(hit)), 100 * len(stem) / n, np.log1p(len(stem)), weight / np.sqrt(n), near, len(second) / n, counts[1] / max(counts[1] + counts[2], 1), counts[4] / size, counts[5] / size, counts[6] / size, stands / n, hidden, np.log1p(n)]


def texts(batch: pa.RecordBatch, column: int = 1) -> Iterator[bytes]:
    data, offsets = utf8(batch.column(column))
    raw = data.tobytes()
    ends = offsets.tolist()
    return (raw[a:b] for a, b in zip(ends, ends[1:]))


def sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each labelled document's distinct words and stems; ``kind`` 0 is a word, 1 a stem."""
    for batch in batches:
        for y, raw in zip(batch.column("y").to_pylist(), texts(batch, 2)):
            own = set(terms(raw))
            both = [(0, w) for w in own] + [(1, w) for w in {w[:STEM] for w in own if len(w) > STEM}]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in both], pa.int32()), pa.array([w for _, w in both], pa.binary()), pa.array([y] * len(both), pa.int32())], ["kind", "term", "y"])


def least_docs(toxic: int) -> int:
    return max(LEAST_DOCS, int(LEAST_SHARE * toxic))


def learn_lexicon(sample: DataFrame, toxic: int, clean: int) -> list[dict[bytes, tuple[float, int]]]:
    counts = sample.mapInArrow(sample_terms, "kind int, term binary, y int").groupBy("kind", "term").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    weight = F.log((F.col("bad") + 0.5) / (toxic + 1.0)) - F.log((F.col("good") + 0.5) / (clean + 1.0))
    strong = counts.where(F.col("bad") >= least_docs(toxic)).withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT)
    found: list[dict[bytes, tuple[float, int]]] = [{}, {}]
    for kind in (0, 1):
        for r in strong.where(F.col("kind") == kind).orderBy((F.col("weight") * F.col("bad")).desc(), "term").limit(LEXICON).collect():
            found[kind][bytes(r.term)] = (r.weight, r.bad)
    # a stem stands for words that are not in the lexicon themselves
    return [found[0], {t: v for t, v in found[1].items() if not any(w.startswith(t) and c >= 0.5 * v[1] for w, (_, c) in found[0].items())}]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    sample = labelled_sample(docs, labels, "toxic", per_class).persist()
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
        sample.unpersist()
        return Model({}, {}, None, (np.array([0.0]), np.array([share])))
    words, stems = learn_lexicon(sample, sizes[1], sizes[0])
    least = least_docs(sizes[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(raw, words, stems, least + y) for y, raw in zip(batch.column("y").to_pylist(), texts(batch, 2))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = sorted(sample.mapInArrow(run, "doc_id long, y int, x array<double>").collect(), key=lambda r: r.doc_id)
    sample.unpersist()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows], float)
    fold = np.arange(len(y)) % FOLDS
    unseen = np.zeros(len(y))
    for k in range(FOLDS):
        unseen[fold == k] = fit_trees(x[fold != k], y[fold != k], RISING).margin(x[fold == k])
    shares = {r.y: r.n for r in learnt_labels(labels, "toxic").groupBy("y").agg(F.count("*").alias("n")).collect()}
    weight = np.where(y == 1, shares[1] / sizes[1], shares[0] / sizes[0])
    return Model(words, stems, fit_trees(x, y, RISING), isotonic(unseen, y, weight / weight.mean()))


def probabilities(model: Model, raws: Iterator[bytes]) -> np.ndarray:
    rows = [features(raw, model.words, model.stems) for raw in raws]
    if model.trees is None or not rows:
        return np.full(len(rows), model.knots[1][0])
    return np.interp(model.trees.margin(np.array(rows)), *model.knots)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probabilities(model, texts(batch)))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, that are not predicted toxic; one pass, nothing is joined."""
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(probabilities(model, texts(batch, at)) < THRESHOLD))

    return by_position(docs, run)

"""Importance resampling and vector codes against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import op12_crc_resampling as resampling
from colloquy.llm import op13_heap_lloyd as lloyd
from colloquy.llm.common import tune
from tests.llm.conftest import prose


def features(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(words), [zlib.crc32(" ".join(words[i : i + g]).encode()) % resampling.BUCKETS for g in (1, 2, 3) for i in range(len(words) - g + 1)]


def plain_scores(docs, target):
    """(doc_id, text) rows -> sorted (doc_id, n_features, weight, score, rank)."""
    s, t = np.zeros(resampling.BUCKETS), np.zeros(resampling.BUCKETS)
    for table, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            np.add.at(table, features(text)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + len(s)) / ((a + 1) * (t.sum() + len(s))))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        words, own = features(text)
        weight = sum(gain[b] for b in own)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words])
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(fit[: 5 * len(fit) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=str)


@pytest.fixture(scope="module")
def target(spark):
    rng = random.Random(3)
    return spark.createDataFrame([(k, prose(rng, 30)) for k in range(5)] + [(9, None), (10, "Ünï-códe  WORDS_and 12")], "item_id long, text string")


def test_scores_match_a_plain_count(spark, corpus, target):
    tune(spark)
    docs = corpus[0]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = plain_scores(rows, [r.text for r in target.collect()])
    assert sorted((tuple(r) for r in resampling.scores(docs, target).collect()), key=str) == expected


def test_parts_and_rings_change_nothing(monkeypatch):
    text = prose(random.Random(1), 300).encode()
    expected = np.concatenate([b for _, b in resampling.scan(text)])
    monkeypatch.setattr(resampling, "PART", 7)
    monkeypatch.setattr(resampling, "BLOCK", 40)
    parts = list(resampling.scan(text))
    assert sum(w for w, _ in parts) == 300 and (np.concatenate([b for _, b in parts]) == expected).all()
    words = text.lower().rstrip(b".").split()
    for grams in (1, 2, 5):
        found = np.concatenate([b for _, b in resampling.scan(text, grams)]).tolist()
        assert sorted(found) == sorted(zlib.crc32(b" ".join(words[i : i + g])) % 10_000 for g in range(1, grams + 1) for i in range(len(words) - g + 1))


def test_drawn_documents_stay_as_they_are(spark, corpus, target, empty):
    tune(spark)
    docs = corpus[0].withColumn("weight", F.lit("theirs"))
    ranked = {r.doc_id for r in resampling.scores(docs, target).where("rank is not null").collect()}
    drawn = resampling.resample(docs, target)
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == ranked
    assert drawn.where("weight = 'theirs'").count() == len(ranked)
    assert resampling.scores(empty[0], target).count() == 0 and resampling.resample(empty[0], target).count() == 0
    assert resampling.scores(docs, target.where("item_id < 0")).count() == docs.count()


def plain_codes(rows):
    """(vec_id, label, vector) rows in order -> codes, errors, entries, by comparing every part with every entry each round."""
    width = -(-max(len(v) for _, _, v in rows) // 4)
    x = np.array([[math.floor(1024 * a) for a in v] + [0] * (4 * width - len(v)) for _, _, v in rows], np.int64).reshape(len(rows), 4, width)
    books = [x[:256, p].copy() for p in range(4)]

    def assign():
        dist = [((x[:, p, None] - books[p][None]) ** 2).sum(2) for p in range(4)]
        return np.stack([d.argmin(1) for d in dist], 1), sum(d.min(1) for d in dist)

    for _ in range(4):
        codes, _ = assign()
        for p in range(4):
            for e in range(len(books[p])):
                own = x[codes[:, p] == e, p]
                if len(own):
                    books[p][e] = own.sum(0) // len(own)
    codes, error = assign()
    return codes, error, ",".join(str(c) for b in books for c in b.ravel().tolist())


def vectors(seed, n, width=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(40, width))
    rows = [(k, k % 7 if k % 11 else None, (middle[rng.integers(40)] + rng.normal(size=width) * 0.2).round(3).tolist()) for k in range(n)]
    return rows + [(n + k, 3, rows[k][2]) for k in range(20)]  # repeated vectors: ties


VECTORS = "vec_id long, label int, embedding array<double>"


def check(spark, rows):
    out = {r.vec_id: r for r in lloyd.report(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()}
    codes, error, books = plain_codes(rows)
    assert len(out) == len(rows)
    by_label = {}
    for (_, label, _), e in zip(rows, error.tolist()):
        by_label[label] = by_label.get(label, 0) + e
    for (vec_id, label, _), code, e in zip(rows, codes, error.tolist()):
        r = out[vec_id]
        assert (r.code, r.error, r.label_error) == ("".join(f"{c:02x}" for c in code), e, by_label[label])
        assert r.codebooks_sha256 == hashlib.sha256(books.encode()).hexdigest()


def test_codes_match_plain_rounds(spark):
    tune(spark)
    check(spark, vectors(1, 900))


def test_few_rows_ragged_and_large_vectors(spark):
    tune(spark)
    check(spark, [(k, None, [float(k % 3), 0.5, -1.0, 2.0, 0.25][: 1 + k % 5]) for k in range(30)])
    check(spark, [(k, 1, [(-1.0) ** k * 3_000.0 * (k + 1), 3e3, -3e4 + k, 1.0] * 2) for k in range(9)])
    check(spark, [(5, 2, [0.1, 0.2, 0.3, 0.4])])


def test_rows_that_drop_out_and_columns_that_stay(spark):
    tune(spark)
    rows = [(1, 1, [0.1] * 4), (2, 1, None), (3, 1, [0.1, None, 0.2, 0.3]), (4, 1, [float("nan")] * 4), (5, 1, [float("inf")] * 4), (None, 2, [0.3] * 4), (6, 2, [1e300, -1e300, 0.0, 0.0]), (1, 1, [0.1] * 4)]
    made = spark.createDataFrame([(*r, "x") for r in rows], VECTORS + ", CODE string")
    out, books = lloyd.compress(made)
    assert out.columns == ["vec_id", "label", "CODE", "code_0", "error"] and out.count() == 4 and books.entries.shape == (4, 4, 1)
    assert {r.error for r in out.collect()} == {0} and out.where("CODE = 'x'").count() == 4
    none = lloyd.report(spark.createDataFrame(rows[1:3], VECTORS))
    assert none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and none.count() == 0


def test_heaps_leave_most_parts_alone_once_entries_rest():
    """After a round without moves nothing is popped; after small moves, only parts near a border; codes stay exact."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(2000, 4, 6)) * 1000).astype(np.int64)
    entries = np.stack([x[:256, p] for p in range(4)])
    books = lloyd.Codebooks(entries, np.zeros((4, 256)))
    block = lloyd.Block(x, books)
    block = lloyd.Block.unpack(block.pack(), books)
    block.assign(books)
    assert block.rescanned <= 4 * 2000 // 4  # entries stand on rows, whose slack is largest; ties only
    small = books.moved(entries + rng.integers(-3, 4, entries.shape))
    block.assign(small)
    assert 0 < block.rescanned < 2000
    far = small.moved(entries + rng.integers(-400, 400, entries.shape))
    block.assign(far)
    for p in range(4):
        assert (block.codes[:, p] == ((x[:, p, None] - far.entries[p][None]) ** 2).sum(2).argmin(1)).all()
        assert (block.counts[p] == np.bincount(block.codes[:, p], minlength=256)).all()
        sums = np.zeros((256, 6), np.int64)
        np.add.at(sums, block.codes[:, p], x[:, p])
        assert (block.sums[p] == sums).all()


def test_large_numbers_stay_exact():
    x = np.array([[1 << 25, -(1 << 25)], [(1 << 25) - 1, 5]])
    assert lloyd.squares(x, -x).tolist() == [[sum((a + b) ** 2 for a, b in zip(r, e)) for e in x.tolist()] for r in x.tolist()]

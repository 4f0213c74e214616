"""The coarse vector index against scoring every vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions.vectors import quantize
from colloquy.operators import cells


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(24, 16))
    x = middle[rng.integers(24, size=3000)] + rng.normal(size=(3000, 16)) * 0.25
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[50] = x[51]  # a tie
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9000, None)]
    return spark.createDataFrame(rows, "vec_id long, v array<double>").select("vec_id", quantize(F.col("v")).alias("q")).cache()


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return cells.build(vectors, "vec_id", str(tmp_path_factory.mktemp("cells")), 24)


def plain(vectors, query, n, skip):
    x = {r.vec_id: np.array(r.q, int) for r in vectors.where("q is not null").collect()}
    scored = sorted(((-int(v @ np.array(query)), k) for k, v in x.items() if k != skip))[:n]
    return [(k, -s) for s, k in scored]


def test_every_vector_is_in_its_nearest_cell(vectors, index):
    rows = index.vectors.collect()
    assert len(rows) == 3000 and sum(index.counts.values()) == 3000
    x = np.array([r.q for r in rows], float)
    far = ((x[:, None] - index.centres[None]) ** 2).sum(2)
    own = far[np.arange(len(rows)), [r.cell for r in rows]]
    assert np.allclose(own, far.min(1))
    for cell, radius in index.radius.items():
        assert own[[k for k, r in enumerate(rows) if r.cell == cell]].max() <= radius**2 + 1e-6


def test_exact_search_reads_few_cells_and_probing_finds_nine_tenths(vectors, index):
    queries = {r.vec_id: list(r.q) for r in vectors.where("vec_id % 150 = 0 and q is not null or vec_id in (50, 51)").collect()}
    hit = asked = read = probed = 0
    for vec_id, q in queries.items():
        want = plain(vectors, q, 10, vec_id)
        found, used = index.exact(q, 10, vec_id)
        assert [(r.key, r.score) for r in found.orderBy(F.desc("score"), "key").collect()] == want
        read += sum(index.counts[c] for c in used)
        near = {r.key for r in index.probe(q, 10, 3, vec_id).collect()}
        probed += sum(index.counts[c] for c in index.order(q)[:3])
        hit, asked = hit + len(near & {k for k, _ in want}), asked + len(want)
    assert hit / asked >= 0.9 and probed < 0.35 * 3000 * len(queries)
    assert read < 0.6 * 3000 * len(queries)  # cells below the k-th score stay unread


def test_few_and_no_vectors(spark, vectors, tmp_path):
    few = cells.build(vectors.where("vec_id < 3"), "vec_id", str(tmp_path / "few"), 50)
    q = [1] * 16
    assert [tuple(r) for r in few.exact(q, 10)[0].orderBy(F.desc("score"), "key").collect()] == plain(vectors.where("vec_id < 3"), q, 10, None)
    none = cells.build(vectors.where("q is null"), "vec_id", str(tmp_path / "none"))
    assert none.exact(q, 5)[0].count() == 0 and none.probe(q, 5, 2).count() == 0

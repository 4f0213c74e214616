"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters run over each chunk's byte
embeddings and are max-pooled in the chunk; mean, maximum and minimum of the chunks' pooled vectors are combined into one
probability. Training takes a bounded, documented sample of labelled documents (``PER_CLASS`` of each class, in the order of a
hash of the id while their texts fit in ``SAMPLE_BYTES`` a class). Training and scoring both read every chunk of a document.

Null and empty texts score as one chunk of padding. Repeated ids give a row each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import checkpoint, held_out, labelled_sample, sigmoid, utf8

CHUNK, STEP = 256, 192
WIDTH, STRIDE, DIM, FILTERS = 8, 4, 8, 24
#: A pass over few documents has few steps, so small samples get more passes.
PER_CLASS, SAMPLE_BYTES, EPOCHS, STEPS, SEED = 1500, 48 << 20, 10, 400, 5
BATCH, BLOCK = 64, 1024


@dataclass
class Network:
    embedding: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # 3 * FILTERS
    offset: float


def chunk_starts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document and the start of each chunk; a document has one at least."""
    counts = 1 + np.maximum(0, -(-(lengths - CHUNK) // STEP))
    doc = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(counts) - counts
    return doc, (np.arange(len(doc)) - first[doc]) * STEP


def cut(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The chunks' bytes, zeros after a document's end."""
    at = (offsets[doc] + start)[:, None] + np.arange(CHUNK)[None, :]
    inside = at < offsets[doc + 1][:, None]
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


def windows(net: Network, chunks: np.ndarray) -> np.ndarray:
    """(chunk, window, WIDTH * DIM) byte embeddings under each filter position."""
    embedded = net.embedding[chunks].reshape(len(chunks), CHUNK * DIM)
    n = (CHUNK - WIDTH) // STRIDE + 1
    view = np.lib.stride_tricks.as_strided(embedded, (len(chunks), n, WIDTH * DIM), (embedded.strides[0], STRIDE * DIM * 4, 4))
    return np.ascontiguousarray(view)


def pooled(net: Network, chunks: np.ndarray) -> np.ndarray:
    w = windows(net, chunks)
    return np.maximum((w.reshape(-1, WIDTH * DIM) @ net.filters).reshape(len(chunks), -1, FILTERS).max(1) + net.bias, 0)


def combine(parts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Mean, maximum and minimum of the chunks of each document; ``doc`` is sorted and has no gap."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    counts = np.diff(np.append(first, len(doc)))[:, None]
    return np.hstack([np.add.reduceat(parts, first) / counts, np.maximum.reduceat(parts, first), np.minimum.reduceat(parts, first)])


def probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    doc, start = chunk_starts(np.diff(offsets))
    if not len(doc):
        return np.zeros(0)
    parts = np.concatenate([pooled(net, cut(data, offsets, doc[i : i + BLOCK], start[i : i + BLOCK])) for i in range(0, len(doc), BLOCK)])
    return sigmoid(combine(parts, doc).astype(float) @ net.weights + net.offset)


def peaks(net: Network, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunk, filter): the window that each filter likes best, and its value there."""
    raw = (windows(net, chunks).reshape(-1, WIDTH * DIM) @ net.filters).reshape(len(chunks), -1, FILTERS)
    best = raw.argmax(1)
    return best, np.take_along_axis(raw, best[:, None, :], 1)[:, 0] + net.bias


def gradients(net: Network, weights: np.ndarray, offset: float, data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss of the documents ``docs``, over all their chunks, BLOCK of them at a time."""
    own, start = chunk_starts(np.diff(offsets)[docs])
    blocks = [slice(i, i + BLOCK) for i in range(0, len(own), BLOCK)]
    best, top = (np.concatenate(x) for x in zip(*(peaks(net, cut(data, offsets, docs[own[s]], start[s])) for s in blocks)))
    parts = np.maximum(top, 0)
    z = combine(parts, own).astype(float)
    d = (sigmoid(z @ weights + offset) - y) / len(docs)
    dz = d[:, None] * weights[None, :]
    mean, high, low = np.split(dz, 3, axis=1)
    dp = (mean / np.bincount(own)[:, None])[own]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    for edge, flow in ((z[:, FILTERS : 2 * FILTERS], high), (z[:, 2 * FILTERS :], low)):
        at = edge[own] == parts  # overlapping chunks may share a window, and so the edge
        dp += at * (flow / np.add.reduceat(at.astype(float), first))[own]
    dp *= top > 0
    out = {"weights": z.T @ d, "offset": np.array([d.sum()]), "bias": dp.sum(0), "filters": np.zeros(net.filters.shape), "embedding": np.zeros(net.embedding.shape)}
    for s in blocks:
        chunk = cut(data, offsets, docs[own[s]], start[s])
        at_byte = chunk[np.arange(len(chunk))[:, None, None], best[s][:, :, None] * STRIDE + np.arange(WIDTH)]
        taken = net.embedding[at_byte].reshape(len(chunk), FILTERS, WIDTH * DIM)
        out["filters"] += np.einsum("cf,cfk->kf", dp[s], taken)
        flow = dp[s][:, :, None, None] * net.filters.T.reshape(1, FILTERS, WIDTH, DIM)
        out["embedding"] += np.stack([np.bincount(at_byte.ravel(), flow[..., k].ravel(), 256) for k in range(DIM)], 1)
    return out


def train(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on the logistic loss of each document's combined vector, BATCH documents a step."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (256, DIM)).astype(np.float32), rng.normal(0, 0.15, (WIDTH * DIM, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(3 * FILTERS), 0.0)
    if len(set(y.tolist())) < 2:  # nothing to tell apart: the prior
        net.offset = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
        return net
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    params = {"embedding": net.embedding, "filters": net.filters, "bias": net.bias, "weights": net.weights, "offset": np.zeros(1)}
    moments = {k: (np.zeros_like(v, dtype=float), np.zeros_like(v, dtype=float)) for k, v in params.items()}
    step, epochs = 0, max(epochs, -(-STEPS * BATCH // len(y)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            grads = gradients(net, params["weights"], params["offset"][0], data, offsets, docs, y[docs])
            grads["weights"] += 1e-4 * params["weights"]
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                params[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(params[k].dtype)
    net.weights, net.offset = params["weights"], float(params["offset"][0])
    return net


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> Network:
    sample = checkpoint(labelled_sample(docs, labels, "quality", per_class))
    sizes = sample.select("doc_id", "y", F.octet_length("text").alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    taken, held = [], {0: 0, 1: 0}
    for r in sorted(sizes, key=lambda r: (r.h, r.doc_id)):
        if held[r.y] + r.n <= most_bytes:
            held[r.y] += r.n
            taken.append(r.doc_id)
    rows = sample.where(F.col("doc_id").isin(taken)).select("doc_id", "y", F.col("text").cast("binary").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return train([bytes(r.text) for r in rows], np.array([r.y for r in rows], float))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(probabilities(net, *utf8(batch.column(1))))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

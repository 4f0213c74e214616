"""Mixing sources to target weights with soft membership.

A softmax classifier over byte and hashed byte-pair frequencies, fitted on a bounded sample of a labelled (doc_id, domain)
table (``PER_DOMAIN`` documents of each domain), gives every document a posterior over domains. Document rates r >= 0 are
then fitted so that the expected tokens of each domain, sum of r * tokens * posterior, meet their targets: least squares with
residuals scaled by the targets and a slight pull towards rate 1, which makes the answer unique. Its dual has one number a
domain: the rate is max(1 + posterior . lean, 0). Newton steps solve for ``lean``, and the pull is then moved to the rates
found, until every domain is within TOLERANCE of its target; a small target slows none of the others. Targets that cannot be
met (no text of a domain, junk in every posterior) end at MOST rounds with a warning that names the domains; so do targets of
domains without any label, whose weight the others share. All labelled domains count: the driver holds one row of weights and
a k x k matrix for k of them. A round is one pass over the small (tokens, posterior) table; no round writes state and only totals reach the driver.

Tokens are words of whole texts. Null and empty texts have none: the rate they get changes no total. ``copies`` is the rate,
rounded up or down by a hash of the id so that it holds on average. Repeated ids are rows of their own. Without labels all
domains are equally likely. Other columns are ignored by ``rates`` and kept by ``mix``.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.llm.common import by_position, checkpoint, utf8

PER_DOMAIN, PULL, PAIRS, SEED = 500, 1e-3, 1024, 11
#: How far a domain's expected tokens may be from their target, as a share of it (of 1 % of all, if that is more); most passes.
TOLERANCE, MOST = 1e-3, 100
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


@dataclass
class Mixture:
    domains: list[str]
    weights: np.ndarray  # features + 1 x domains
    lean: np.ndarray | None = None  # the dual's number of each domain; None: all 0
    gradients: list[np.ndarray] = field(default_factory=list)
    step: float = 1.0
    residual: np.ndarray | None = None  # of each domain, relative to its target

    def posterior(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return softmax(features(data, offsets) @ self.weights[:-1] + self.weights[-1])

    def rate(self, posterior: np.ndarray) -> np.ndarray:
        """The dual's rate of each document, then its projected-gradient path if there is one."""
        r = np.ones(len(posterior)) if self.lean is None else np.maximum(1 + posterior @ self.lean, 0)
        for g in self.gradients:
            r = np.maximum(r - self.step * (posterior @ g + PULL * (r - 1)), 0)
        return r


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of bytes and of hashed byte pairs of each text."""
    out = np.zeros((len(offsets) - 1, 256 + PAIRS))
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if a < b:
            own = data[a:b]
            out[i, :256] = np.bincount(own, minlength=256)
            pair = (own[:-1].astype(np.int64) * 131 + own[1:]) * 2654435761 >> 12 & PAIRS - 1
            out[i, 256:] = np.bincount(pair, minlength=PAIRS)
            out[i, :256] /= b - a
            out[i, 256:] /= max(b - a - 1, 1)
    return np.sqrt(out)


def words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each text: bytes outside white space at the text's start or after white space."""
    starts = ~_SPACE[data]
    if len(data):
        first = offsets[:-1][np.diff(offsets) > 0]
        opens = starts.copy()
        starts[1:] &= _SPACE[data[:-1]]
        starts[first] = opens[first]
    total = np.concatenate([[0], np.cumsum(starts)])
    return total[offsets[1:]] - total[offsets[:-1]]


def fit_classifier(docs: DataFrame, labelled: DataFrame, per_domain: int = PER_DOMAIN, rounds: int = 250) -> Mixture:
    """``labelled``: (doc_id, domain). All its domains count; of each, the rows with the smallest hash."""
    rows = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    # ranks below ``per_domain`` are cut before the shuffle, so a hot domain sends no more rows than others
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id"))
    picked = checkpoint(rows.withColumn("_place", place).where(F.col("_place") <= per_domain).drop("_place"))
    names = sorted(r.domain for r in picked.select("domain").distinct().collect())
    if not names:
        return Mixture(["all"], np.zeros((257 + PAIRS, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(*utf8(batch.column("text"))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("domain"), pa.array([row.tobytes() for row in x], pa.binary())], ["doc_id", "domain", "x"])

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text")).mapInArrow(run, "doc_id long, domain string, x binary").collect()
    found.sort(key=lambda r: r.doc_id)
    if not found:
        return Mixture(names, np.zeros((257 + PAIRS, len(names))))
    x = np.stack([np.frombuffer(bytes(r.x), np.float32) for r in found]).astype(float)
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.zeros((len(x), len(names)))
    y[np.arange(len(x)), [names.index(r.domain) for r in found]] = 1
    # classes of unlike sizes are weighed alike
    weight = (1 / np.maximum(y.sum(0), 1))[y.argmax(1)][:, None]
    weight /= weight.sum()
    w, m, v = (np.zeros((x.shape[1], len(names))) for _ in range(3))
    for t in range(1, rounds + 1):
        g = x.T @ ((softmax(x @ w) - y) * weight) + 1e-6 * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Mixture(names, w)


def memberships(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """(doc_id, n_tokens, posterior) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            p = mixture.posterior(data, offsets)
            lists = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1], pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words(data, offsets).astype(np.int64)), lists], ["doc_id", "n_tokens", "posterior"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>")


def fit_rates(members: DataFrame, mixture: Mixture, targets: dict[str, float], tokens: float | None = None, rounds: int | None = None) -> Mixture:
    """``mixture`` with rates that meet the targets, or with the gradients of ``rounds`` plain projected-gradient rounds.

    ``targets``: weights of domains; domains without one get 0. ``tokens``: the mix's expected tokens. None: as few as need
    no document of a target domain thinned out, so the domain that is most plentiful for its weight keeps rate 1.
    """
    k = len(mixture.domains)

    def sums(now: Mixture) -> tuple[np.ndarray, np.ndarray, float]:
        """The domains' tokens, their change with the rates that are not 0 (k x k), and half the sum of tokens * rate^2."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k * k + k + 1)
            for batch in batches:
                if batch.num_rows:
                    p = batch.column("posterior").flatten().to_numpy().reshape(-1, k)
                    n, r = batch.column("n_tokens").to_numpy(), now.rate(p)
                    total += np.concatenate([(n * r) @ p, ((n * (r > 0))[:, None] * p).T.__matmul__(p).ravel(), [0.5 * (n * r) @ r]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "total"])

        out = np.zeros(k * k + k + 1)
        for r in members.select("n_tokens", "posterior").mapInArrow(run, "k int, total double").groupBy("k").agg(F.sum("total").alias("total")).collect():
            out[r.k] = r.total
        return out[:k], out[k:-1].reshape(k, k), float(out[-1])

    unknown = sorted(d for d, w in targets.items() if w > 0 and d not in mixture.domains)
    if unknown and mixture.domains != ["all"]:
        warnings.warn(f"no labelled document of {unknown}: the other targets share what was meant for them", stacklevel=2)
    weight = np.array([max(targets.get(d, 0.0), 0.0) for d in mixture.domains])
    weight = weight / weight.sum() if weight.sum() else np.full(k, 1 / k)
    now = Mixture(mixture.domains, mixture.weights)
    there, bend, energy = sums(now)
    if not there.sum():
        return now
    plenty = weight >= 0.05  # small targets are meant to thin out
    tokens = tokens or float((there / np.maximum(weight, 1e-12))[plenty if plenty.any() else slice(None)].max())
    goal = weight * tokens
    scale = np.maximum(goal, 0.01 * tokens)
    if rounds is not None:
        now.step = float(1 / ((there / scale).max() + PULL))
        for _ in range(rounds):
            now.gradients.append((sums(now)[0] - goal) / scale)
        return now

    def slope() -> np.ndarray:
        return there - goal + PULL * scale * (now.lean - anchor)

    def height(lean: np.ndarray, energy: float) -> float:
        return energy - goal @ lean + 0.5 * PULL * scale @ (lean - anchor) ** 2

    now.lean = anchor = np.zeros(k)
    for _ in range(MOST):
        now.residual = (there - goal) / scale
        if np.abs(now.residual).max() <= TOLERANCE:
            return now
        if np.abs(slope() / scale).max() <= TOLERANCE / 10:
            anchor = now.lean
        # scaled by the targets, so that a small one counts as much as the others
        root = np.sqrt(scale)
        way = np.linalg.solve(bend / np.outer(root, root) + PULL * np.eye(k), -slope() / root) / root
        before, falls, t = height(now.lean, energy), slope() @ way, 1.0
        start = now.lean
        while True:
            now.lean = start + t * way
            there, bend, energy = sums(now)
            if t < 1e-3 or height(now.lean, energy) <= before + 1e-4 * t * falls + 1e-12 * abs(before):
                break
            t /= 2
    now.residual = (there - goal) / scale
    missed = {d: f"{x:+.1%}" for d, x in zip(now.domains, now.residual) if abs(x) > TOLERANCE}
    if missed:
        warnings.warn(f"mixing targets missed after {MOST} rounds, expected tokens against target: {missed}", stacklevel=2)
    return now


def _copies(rate: np.ndarray, ids: pa.Array) -> np.ndarray:
    """The rate rounded by a hash of the id; a null id counts as 0."""
    x = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) ^ (x >> np.uint64(shift))
        x = x * np.uint64(by)
    x ^= x >> np.uint64(31)
    luck = (x >> np.uint64(11)).astype(float) / 2.0**53
    near = np.round(rate, 2)  # what differs from a whole rate by a trace of another domain is that rate
    return (np.floor(near) + (luck < near - np.floor(near))).astype(np.int64)


def rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], tokens: float | None = None) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), rate, copies of every document."""
    mixture = fit_classifier(docs, labelled)
    members = checkpoint(memberships(docs, mixture))
    mixture = fit_rates(members, mixture, targets, tokens)
    k = len(mixture.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("posterior").flatten().to_numpy().reshape(-1, k)
            rate = mixture.rate(p)
            domain = pa.array([mixture.domains[i] for i in p.argmax(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), domain, pa.array(rate), pa.array(_copies(rate, batch.column("doc_id")))], ["doc_id", "n_tokens", "domain", "rate", "copies"])

    return members.mapInArrow(run, "doc_id long, n_tokens long, domain string, rate double, copies long")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], tokens: float | None = None) -> DataFrame:
    """The documents, all columns, as often as the mix asks for; posteriors are computed anew rather than joined."""
    mixture = fit_classifier(docs, labelled)
    mixture = fit_rates(checkpoint(memberships(docs, mixture)), mixture, targets, tokens)
    text, ids = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = _copies(mixture.rate(mixture.posterior(*utf8(batch.column(text)))), batch.column(ids))
            row = np.repeat(np.arange(batch.num_rows), copies)
            for at in range(0, len(row), max(batch.num_rows, 1)):
                yield batch.take(pa.array(row[at : at + batch.num_rows]))

    return by_position(docs, run)


#: The mix of the registered query and the pipeline: clean text by language, and junk thinned out.
TARGETS = {"en": 0.60, "fr": 0.15, "de": 0.13, "es": 0.11, "junk": 0.01}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table: junk where ``quality`` is 0, else the language."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return docs.select("doc_id", "lang").join(known, "doc_id").select("doc_id", F.when(F.col("quality") == 0, "junk").otherwise(F.col("lang")).alias("domain"))

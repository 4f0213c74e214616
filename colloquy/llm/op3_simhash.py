"""SimHash near-duplicates, found through the generalised pigeonhole principle.

Fingerprints: one bit is set if more than half of the 64-bit hashes of a text's word shingles have it. Links join
fingerprints that differ in TAU bits or fewer. The search works on distinct fingerprints:

1. Bits are grouped into m parts so that correlated bits share a part (correlations over all fingerprints).
2. If two fingerprints differ in at most TAU bits, then for any thresholds e_1 .. e_m of -1 or more whose sum is
   TAU - m + 1 some part differs in at most e_i bits. For each fingerprint a dynamic programme picks the thresholds with
   the fewest probes and estimated candidates. The estimates come from histograms of sub-blocks of each part over all
   fingerprints (at most 2^11 bins each, so their size is bounded whatever the input).
3. Probes (all values of part i within e_i bits) meet the index of part values in an equi-join that verifies each pair in
   its condition; only links leave the join. A hot part value is split by adaptive execution.

A fingerprint's probes alone find all of its links, so each link is looked for from its smaller end only. Components come
from star rounds. Nothing but the bounded statistics reaches the driver.

Null and empty texts, and texts of white space, have fingerprint zero and link like any other; texts of fewer words than a
shingle are one shingle. Equal texts share a fingerprint. A null doc_id keeps its row and never names a component unless
all ids of it are null. Other columns are ignored by ``near_duplicates`` and kept by ``keep_one``.

``keep_one`` can look further, to ``reach`` bits. Links of up to ``tau`` bits count as they are, and are searched first: those of
TAU bits, then the others. Each later search leaves out pairs of one group, so a large group of near copies adds few rows to it;
links of over ``tau`` bits count only if the exact Jaccard similarity of the texts' AGREE_WORDS-word shingles is AGREE or more. A
fingerprint's text is there that of one of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import checkpoint, unused
from colloquy.llm.components import components
from colloquy.llm.op4_toxicity import texts

#: Differing bits of a link in reports, and in ``keep_one``: there near copies of some edited words are to be met as well.
TAU, STAGE_TAU = 2, 4
#: The pipeline's stage takes fingerprints of STAGE_SHINGLE words, of which an edited word spoils fewer, and looks as far as REACH
#: bits, where links of more than STAGE_TAU bits need texts that agree.
STAGE_SHINGLE, REACH, AGREE_WORDS, AGREE = 2, 7, 5, 0.8
SHINGLE, SEED, BITS, SUB = 3, 42, 64, 11
#: What a probe costs, which is shuffled and sorted, against a candidate, which is only compared in the join.
PROBE = 32


def shingles(raw: bytes, size: int) -> np.ndarray:
    """Hashes of the word shingles of a text's UTF-8 bytes; ``lower`` and ``split`` of bytes touch A-Z and ASCII white space only."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    text, n = b" ".join(words), max(len(words) - size + 1, 1)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(text, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest, seed = xxhash.xxh64_intdigest, SEED
    return np.fromiter((digest(text[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist())), np.uint64, n)


def fingerprint(raw: bytes, size: int = SHINGLE) -> int:
    hashes = shingles(raw, size)
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def row_key() -> Column:
    """One number for the rows of equal id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, row) of every document; fp is the signed reading of the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(raw, size) for raw in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), batch.column(2)], ["doc_id", "fp", "row"])

    return docs.select(F.col("doc_id").cast("long"), "text", row_key().alias("row")).mapInArrow(run, "doc_id long, fp long, row long")


def bits_of(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def part_values(bits: np.ndarray, part: list[int]) -> np.ndarray:
    return bits[:, part].astype(np.int64) @ (1 << np.arange(len(part), dtype=np.int64))


def tallied(distinct: DataFrame, tally, cells: int) -> np.ndarray:
    """The sum over all fingerprints of ``tally`` (batch of fingerprints -> ``cells`` numbers); bounded in size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += tally(batch.column(0).to_numpy(zero_copy_only=False))
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["cell", "n"])

    out = np.zeros(cells)
    for r in distinct.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out


def group_bits(together: np.ndarray, n: float, parts: int) -> list[list[int]]:
    """Greedy parts of near equal width; each next bit joins the open part it correlates with most."""
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    linked = np.abs((together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(linked, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        first = max(sorted(left), key=lambda b: linked[b, sorted(left)].sum())
        own = [first]
        left.remove(first)
        while len(own) < width:
            nxt = max(sorted(left), key=lambda b: linked[b, own].sum())
            own.append(nxt)
            left.remove(nxt)
        out.append(sorted(own))
    return out


def near_counts(histogram: np.ndarray, width: int, most: int) -> np.ndarray:
    """(distance, value): how many rows' sub-block values lie exactly that far from each value."""
    values = np.arange(1 << width)
    out = np.zeros((most + 1, 1 << width))
    for d in range(min(most, width) + 1):
        for flips in combinations(range(width), d):
            out[d] += histogram[values ^ sum(1 << f for f in flips)]
    return out


def even_cost(n: int, tau: int, m: int) -> float:
    """Probes and candidates of one fingerprint among n evenly spread ones, with m parts and the best thresholds: few wide
    parts probe more and meet fewer candidates."""
    width = BITS // m
    ball = np.cumsum([comb(width, d) for d in range(tau + 1)], dtype=float)
    cost = [0.0, *(ball * (PROBE + n / 2.0**width))]
    best = [0.0] + [np.inf] * (tau + 1)
    for _ in range(m):
        best = [min(best[s - u] + cost[u] for u in range(s + 1)) for s in range(tau + 2)]
    return best[tau + 1]


class Plan:
    """The parts, their sub-block histograms and, from these, each fingerprint's thresholds."""

    def __init__(self, distinct: DataFrame, n: int, tau: int = TAU):
        self.tau, self.n = tau, max(n, 1)
        self.m = min((2, 3, 4), key=lambda m: even_cost(n, tau, m))
        together = tallied(distinct, lambda fp: (b := bits_of(fp).astype(np.float32)).T.__matmul__(b).astype(np.int64).ravel(), BITS * BITS).reshape(BITS, BITS)
        self.parts = group_bits(together, n, self.m)
        self.subs = [[part[a : a + SUB] for a in range(0, len(part), SUB)] for part in self.parts]
        flat = [s for subs in self.subs for s in subs]
        histograms = tallied(distinct, lambda fp: np.concatenate([np.bincount(part_values(b, s), minlength=1 << SUB) for b in [bits_of(fp)] for s in flat]), len(flat) << SUB).reshape(len(flat), 1 << SUB)
        near = iter(near_counts(h[: 1 << len(s)], len(s), tau) / self.n for h, s in zip(histograms, flat))
        self.near = [[next(near) for _ in subs] for subs in self.subs]

    def candidates(self, bits: np.ndarray, part: int) -> np.ndarray:
        """(fingerprint, e): estimated fingerprints within e of its value of the part, sub-blocks taken as independent."""
        spread = np.zeros((len(bits), self.tau + 1))
        spread[:, 0] = 1
        for sub, near in zip(self.subs[part], self.near[part]):
            own, before = near[:, part_values(bits, sub)].T, spread
            spread = np.stack([sum(before[:, a] * own[:, d - a] for a in range(d + 1)) for d in range(self.tau + 1)], 1)
        return self.n * spread.cumsum(1)

    def thresholds(self, bits: np.ndarray) -> np.ndarray:
        """(fingerprint, part): the cheapest e with sum tau - m + 1, by dynamic programming over parts; e + 1 are units."""
        units = self.tau + 1
        best = np.full((len(bits), units + 1), np.inf)
        best[:, 0] = 0
        took = []
        for i, part in enumerate(self.parts):
            w = len(part)
            probes = np.cumsum([float(comb(w, d)) for d in range(self.tau + 1)])
            cost = np.hstack([np.zeros((len(bits), 1)), self.candidates(bits, i) + PROBE * probes])
            options = np.stack([np.stack([best[:, s - u] + cost[:, u] if u <= s else np.full(len(bits), np.inf) for u in range(units + 1)], 1) for s in range(units + 1)], 1)
            took.append(options.argmin(2))
            best = options.min(2)
        out, left = np.zeros((len(bits), self.m), int), np.full(len(bits), units)
        for i in range(self.m - 1, -1, -1):
            out[:, i] = took[i][np.arange(len(bits)), left]
            left -= out[:, i]
        return out - 1

    def keys(self, fp: np.ndarray, probe: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, rows of ``fp`` that have them) of the index, or of the probes that the thresholds ask for."""
        bits = bits_of(fp)
        e = self.thresholds(bits) if probe else np.zeros((len(fp), self.m), int)
        for i, part in enumerate(self.parts):
            values = part_values(bits, part) | (i << 56)
            for d in range(self.tau + 1):
                rows = np.flatnonzero(e[:, i] >= d)
                if len(rows):
                    for flips in combinations(range(len(part)), d):
                        yield values[rows] ^ sum(1 << f for f in flips), rows


def keyed(distinct: DataFrame, plan: Plan, probe: bool) -> DataFrame:
    """The probes (key, a, group_a) or the index (key, b, group_b) of fingerprints (fp, group)."""
    names = ["key", *(("a", "group_a") if probe else ("b", "group_b"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fp, group = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                for key, rows in plan.keys(fp, probe):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[rows]), pa.array(group[rows])], names)

    return distinct.select("fp", "group").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def links(distinct: DataFrame, plan: Plan) -> DataFrame:
    """a, b, group_a, group_b: every pair a < b of distinct fingerprints (fp, group) that differ in tau bits or fewer and are
    of unlike groups; a pair may come twice."""
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= plan.tau) & (F.col("group_a") != F.col("group_b"))
    probes, index = keyed(distinct, plan, True), keyed(distinct, plan, False)
    return probes.join(index, (probes.key == index.key) & close).select("a", "b", "group_a", "group_b")


def shingle_sets(texts_of: DataFrame) -> DataFrame:
    """(fp, set) of (fp, text): the distinct AGREE_WORDS-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(raw, AGREE_WORDS)).view(np.int64) for raw in texts(batch)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))], ["fp", "set"])

    return texts_of.select("fp", "text").mapInArrow(run, "fp long, set array<long>")


def agreed(docs: DataFrame, distinct: DataFrame, far: DataFrame) -> DataFrame:
    """(a, b): groups that a link of ``far`` (a, b, group_a, group_b) with agreeing texts joins. ``distinct``: fp, row.

    Two groups need one such link, so the closest link of each two groups is tried first, and all others only between groups
    that it has not joined.
    """
    left = checkpoint(far.select("a", "b", F.least("group_a", "group_b").alias("lo"), F.greatest("group_a", "group_b").alias("hi")).distinct())
    wanted = left.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(distinct, "fp").select("fp", "row")
    sets = checkpoint(shingle_sets(docs.select(row_key().alias("row"), "text").join(wanted, "row").groupBy("fp").agg(F.min("text").alias("text"))))

    def agreeing(tried: DataFrame) -> DataFrame:
        both = tried.join(sets.select(F.col("fp").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("set").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return checkpoint(both.where(shared >= AGREE * (F.size("x") + F.size("y") - shared)).select("lo", "hi").distinct())

    closest = F.min(F.struct(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("bits"), "a", "b"))
    first = agreeing(left.groupBy("lo", "hi").agg(closest.alias("l")).select("l.a", "l.b", "lo", "hi"))
    rest = agreeing(left.join(first, ["lo", "hi"], "left_anti"))
    return first.unionByName(rest).toDF("a", "b")


def grouped(docs: DataFrame, size: int, tau: int, reach: int) -> DataFrame:
    """doc_id, fp, row, root (one for each component), component_id of every document; links of over ``tau`` bits must agree."""
    own = checkpoint(fingerprints(docs, size))
    distinct = checkpoint(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("row").alias("row")))
    n, in_groups, roots = distinct.count(), distinct.withColumn("group", F.col("fp")), None
    # the nearest links make groups first, and later searches leave their pairs out, so that the links of a large group of
    # near copies do not grow with its square
    for bits in sorted({min(TAU, tau), tau, max(tau, reach)}):
        found = links(in_groups, Plan(distinct, n, bits))
        found = found.select(F.col("group_a").alias("a"), F.col("group_b").alias("b")).distinct() if bits <= tau else agreed(docs, distinct, found)
        if roots is not None:
            found = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)
        roots = components(found)
        if bits < max(tau, reach):
            roots = checkpoint(roots)
            in_groups = checkpoint(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("group")))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # written first, so that the join below is of two plain exchanges and a root with many fingerprints can be split
    smallest = checkpoint(named.groupBy("root").agg(F.min("first").alias("component_id")))
    return own.join(checkpoint(named.join(smallest, "root").select("fp", "root", "component_id")), "fp")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, tau: int = TAU) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) of every document."""
    return grouped(docs, size, tau, tau).select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, tau: int = STAGE_TAU, reach: int = STAGE_TAU) -> DataFrame:
    """One document, all columns, of each component: a row of its smallest doc_id. Over ``tau`` bits, texts must agree.

    Rows are judged by id and text, so an id of unlike texts stays once in each group that it names. Of several rows of a
    group with that id the one with the smallest JSON form stays. Rows without an id are kept as they are, since no id names
    them. Only ids are joined with the texts, but for repeated ids. Other columns may have any name and type.
    """
    id_, rows, row, root, best = unused(docs.columns, "_id", "_rows", "_row", "_root", "_best")
    named = checkpoint(grouped(docs, size, tau, reach).where("doc_id is not null"))
    verdict = checkpoint(named.groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias(rows), F.max(F.col("doc_id") == F.col("component_id")).alias("names")).where("names").drop("names"))
    kept = docs.join(verdict, F.col("doc_id") == F.col(id_), "left").where(F.col("doc_id").isNull() | F.col(id_).isNotNull())
    own = [F.col(f"`{c}`") for c in docs.columns]
    if verdict.where(F.col(rows) > 1).isEmpty():
        return kept.select(*own)
    first = named.where("doc_id = component_id").select(F.col("row").alias(row), F.col("root").alias(root)).distinct()
    again = kept.where(F.col(rows) > 1).withColumn(row, row_key()).join(first, row)
    again = again.groupBy(root).agg(F.min_by(F.struct(*own), F.to_json(F.struct(*own))).alias(best)).select(f"{best}.*")
    return kept.where(F.col(rows).isNull() | (F.col(rows) == 1)).select(*own).unionByName(again)

"""Vector code compression: product quantisation by Lloyd's rounds whose exact bounds sit in heaps.

Components become integers, floor(1024 x); vectors are cut into PARTS equal parts, each with a codebook of up to ENTRIES entries,
at first the parts of the smallest vec_ids. Each of ROUNDS rounds assigns every part to its nearest entry (squared distance, ties
to the lower index) and moves each entry to the floor of its parts' mean. Then parts are assigned once more.

Rows are held in blocks of BLOCK vectors, and a block keeps one heap for each entry of each part position. A heap's key is a
part's slack, the lower bound of its distance to any other entry minus the upper bound of that to its own, plus the entry's
cumulative drift when the part came in. An entry's drift grows each round by its own move and the largest move of the others, the
most by which a slack can shrink. So the parts whose bounds may be violated are those with keys up to the present drift: they
alone are popped, compared with all entries in exact integers, and pushed onto the heap of their nearest entry. Other parts are
not looked at. Blocks are stored between rounds with their heaps as they are (heap order is kept in the arrays), with each
entry's count and sums, which change only by the parts that move. Only the entries' counts and sums are added up over blocks:
ENTRIES (dimension + PARTS) numbers a round, whatever the input.

Vectors that are null or hold a null or non-finite component drop out; other rows stay, a null vec_id counting as the largest and
equal ids going by their vectors. Components beyond LIMIT either way are held there. The dimension is that of the longest vector,
made up to a multiple of PARTS; shorter ones end in zeros. Fewer rows than ENTRIES make smaller codebooks. Repeated rows give a
row each. ``compress`` keeps all other columns. No rows: no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from colloquy.llm.common import checkpoint, unused

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors of a block; components are held within LIMIT, so that distances fit 64 bits up to 1,024 dimensions a part.
BLOCK, LIMIT = 4096, 1 << 25
#: What rounding may add to a bound; a key this near to the drift counts as violated.
MARGIN = 1e-6


@dataclass
class Codebooks:
    """Entries (part, entry, component), their cumulative drifts, and the part whose move each last round made largest."""

    entries: np.ndarray
    drift: np.ndarray

    def moved(self, entries: np.ndarray) -> Codebooks:
        step = np.sqrt(((entries - self.entries).astype(float) ** 2).sum(2))
        return Codebooks(entries, self.drift + step + others(step))


def others(step: np.ndarray) -> np.ndarray:
    """The largest of each row's other values; 0 where there is none."""
    if step.shape[1] < 2:
        return np.zeros_like(step)
    top = np.sort(step, axis=1)
    return np.where(step == top[:, -1:], top[:, -2:-1], top[:, -1:]) if step.size else step


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (row, entry) of whole numbers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * max(x.shape[1], 1) < 1 << 53:  # then every step below is a whole number that a double holds
        a, b = x.astype(float), entries.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's nearest entry (the lower of equal ones), its squared distance, and the slack to the next one."""
    found = squares(x, entries)
    rows = np.arange(len(x))
    best = found.argmin(1)
    least = found[rows, best]
    if found.shape[1] < 2:
        return best, least, np.full(len(x), np.inf)
    found[rows, best] = np.iinfo(np.int64).max
    return best, least, np.sqrt(found.min(1)) - np.sqrt(least)


class Block:
    """The vectors of a block, their codes, and a heap of (key, row) for each part position and entry."""

    def __init__(self, x: np.ndarray, books: Codebooks):
        self.x = x  # (row, part, component)
        self.codes = np.zeros((len(x), PARTS), np.int32)
        entries = books.entries.shape[1]
        self.heaps: list[list[list[tuple[float, int]]]] = [[[] for _ in range(entries)] for _ in range(PARTS)]
        self.counts = np.zeros((PARTS, entries), np.int64)
        self.sums = np.zeros(books.entries.shape, np.int64)
        for part in range(PARTS):
            best, _, slack = nearest(x[:, part], books.entries[part])
            self.codes[:, part] = best
            for row, (entry, key) in enumerate(zip(best.tolist(), (slack + books.drift[part, best]).tolist())):
                self.heaps[part][entry].append((key, row))
            for heap in self.heaps[part]:
                heapify(heap)
            self._count(part, best, x[:, part], 1)
        self.rescanned = len(x) * PARTS

    def _count(self, part: int, entries: np.ndarray, x: np.ndarray, sign: int) -> None:
        np.add.at(self.counts[part], entries, sign)
        np.add.at(self.sums[part], entries, sign * x)

    def assign(self, books: Codebooks) -> None:
        """Pop the parts that may have a nearer entry, and push them where they belong."""
        self.rescanned = 0
        for part in range(PARTS):
            popped = []
            for heap, drift in zip(self.heaps[part], (books.drift[part] * (1 + 1e-12) + MARGIN).tolist()):
                while heap and heap[0][0] <= drift:
                    popped.append(heappop(heap)[1])
            if not popped:
                continue
            rows = np.array(popped)
            x, before = self.x[rows, part], self.codes[rows, part]
            best, _, slack = nearest(x, books.entries[part])
            for row, entry, key in zip(popped, best.tolist(), (slack + books.drift[part, best]).tolist()):
                heappush(self.heaps[part][entry], (key, row))
            went = best != before
            self.codes[rows, part] = best
            self._count(part, before[went], x[went], -1)
            self._count(part, best[went], x[went], 1)
            self.rescanned += len(popped)

    def errors(self, books: Codebooks) -> np.ndarray:
        own = books.entries[np.arange(PARTS), self.codes]
        return ((self.x - own) ** 2).sum((1, 2))

    def pack(self) -> list[bytes]:
        """The state by the names of STATE; heaps as sizes, keys and rows, in heap order."""
        flat = [pair for part in self.heaps for heap in part for pair in heap]
        sizes = np.array([len(heap) for part in self.heaps for heap in part], np.int32)
        keys, rows = np.array([k for k, _ in flat]), np.array([r for _, r in flat], np.int32)
        return [a.tobytes() for a in (self.x, self.codes, sizes, keys, rows, self.counts, self.sums)]

    @classmethod
    def unpack(cls, state: list, books: Codebooks) -> Block:
        x, codes, sizes, keys, rows, counts, sums = state
        out = cls.__new__(cls)
        _, entries, width = books.entries.shape
        out.x = np.frombuffer(x, np.int64).reshape(-1, PARTS, width)
        out.codes = np.frombuffer(codes, np.int32).reshape(-1, PARTS).copy()
        pairs = list(zip(np.frombuffer(keys).tolist(), np.frombuffer(rows, np.int32).tolist()))
        ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
        cut = [pairs[a:b] for a, b in zip([0, *ends], ends)]
        out.heaps = [cut[part * entries : (part + 1) * entries] for part in range(PARTS)]
        out.counts = np.frombuffer(counts, np.int64).reshape(PARTS, entries).copy()
        out.sums = np.frombuffer(sums, np.int64).reshape(books.entries.shape).copy()
        return out


def whole(vectors: DataFrame, name: str = "v") -> DataFrame:
    """The kept rows without the vector, and under ``name``, last, the vector in whole numbers."""
    fine = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(double(x)) < double('infinity'))"
    scaled = lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * SCALE)))
    rest = [F.col(f"`{c}`") for c in vectors.columns if c != "embedding"]
    return vectors.where(fine).select(*rest, F.transform("embedding", scaled).alias(name))


STATE = [StructField(n, BinaryType()) for n in ("x", "codes", "sizes", "keys", "rows", "counts", "sums")] + [StructField("rescanned", LongType())]


def start(rows: DataFrame) -> Codebooks | None:
    """The codebooks of the smallest vec_ids; None without rows."""
    first = [r.v for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()]
    if not first:
        return None
    longest = rows.agg(F.max(F.size("v")).alias("n")).head().n
    entries = np.zeros((len(first), max(-(-longest // PARTS), 1) * PARTS), np.int64)
    for k, v in enumerate(first):
        entries[k, : len(v)] = v
    return Codebooks(entries.reshape(len(first), PARTS, -1).transpose(1, 0, 2).copy(), np.zeros((PARTS, len(first))))


def _states(batch: pa.RecordBatch, books: Codebooks) -> Iterator[Block]:
    """The blocks of a batch, whose last columns are those of STATE."""
    for state in zip(*batch.columns[-len(STATE) : -1]):
        yield Block.unpack([s.as_buffer() for s in state], books)


def _record(kept: list[pa.Array], block: Block, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*kept, *(pa.array([b], pa.binary()) for b in block.pack()), pa.array([block.rescanned])], names)


def blocked(rows: DataFrame, books: Codebooks) -> DataFrame:
    """Blocks of rows (``v`` the last column), parts assigned for the first time: each other column as a list, then STATE."""
    kept = list(rows.schema)[:-1]
    fields = StructType([StructField(f"k{k}", ArrayType(f.dataType)) for k, f in enumerate(kept)] + STATE)
    names, (_, _, width) = fields.names, books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks()
            n, v = whole.num_rows, whole.column(len(kept)).combine_chunks()
            x = np.zeros((n, PARTS * width), np.int64)
            for k, own in enumerate(v):
                x[k, : len(own)] = own.values.to_numpy(zero_copy_only=False)
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c.combine_chunks()) for c in whole.columns[: len(kept)]]
            return _record(lists, Block(x.reshape(n, PARTS, width), books), names)

        parts, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                parts.append(batch.slice(at, BLOCK))
                held += parts[-1].num_rows
                if held >= BLOCK:
                    yield made(parts)
                    parts, held = [], 0
        if held:
            yield made(parts)

    return rows.toDF(*(f"c{k}" for k in range(len(rows.columns)))).mapInArrow(run, fields)


def reassigned(blocks: DataFrame, books: Codebooks) -> DataFrame:
    names, states = blocks.columns, len(STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block in enumerate(_states(batch, books)):
                block.assign(books)
                yield _record([c.slice(k, 1) for c in batch.columns[:-states]], block, names)

    return blocks.mapInArrow(run, blocks.schema)


def means(blocks: DataFrame, books: Codebooks) -> np.ndarray:
    """The entries at the floors of their parts' means; those without parts stay."""
    shape = books.entries.shape
    cells = shape[0] * shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.zeros(cells * (1 + shape[2]), np.int64)
        for batch in batches:
            for counts, sums in zip(*batch.columns):
                every[:cells] += np.frombuffer(counts.as_buffer(), np.int64)
                every[cells:] += np.frombuffer(sums.as_buffer(), np.int64)
        own = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(every[own])], ["cell", "n"])

    total = np.zeros(cells * (1 + shape[2]), np.int64)
    for r in blocks.select("counts", "sums").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total[r.cell] = r.n
    counts, sums = total[:cells, None], total[cells:].reshape(cells, -1)
    return np.where(counts > 0, sums // np.maximum(counts, 1), books.entries.reshape(cells, -1)).reshape(shape)


def rounds(rows: DataFrame, books: Codebooks) -> tuple[DataFrame, Codebooks]:
    """The stored blocks after the last assignment, and the codebooks they are assigned to."""
    blocks = checkpoint(blocked(rows, books))
    for _ in range(ROUNDS):
        books = books.moved(means(blocks, books))
        blocks = checkpoint(reassigned(blocks, books))
    return blocks, books


def compress(vectors: DataFrame) -> tuple[DataFrame, Codebooks | None]:
    """The kept rows without the vector, with ``code`` (an entry a part, a byte each) and ``error`` (squared distance); the codebooks.

    ``code_0`` and ``error_0`` where those names are in use.
    """
    kept = [f for f in vectors.schema if f.name != "embedding"]
    code, error, v = unused([f.name for f in kept], "code", "error", "v")
    fields = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate(kept)] + [StructField("code", BinaryType()), StructField("error", LongType())])
    rows = whole(vectors, v)
    books = start(rows.select("vec_id", F.col(v).alias("v")))
    if books is None:
        return vectors.sparkSession.createDataFrame([], fields).toDF(*(f.name for f in kept), code, error), None
    blocks, last = rounds(rows, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block in enumerate(_states(batch, last)):
                own = [c.slice(k, 1).flatten() for c in batch.columns[: len(kept)]]
                codes = pa.array([c.tobytes() for c in block.codes.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([*own, codes, pa.array(block.errors(last))], fields.names)

    return blocks.mapInArrow(run, fields).toDF(*(f.name for f in kept), code, error), last


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code (hex), error, label_error (of all rows of the label), codebooks_sha256."""
    rows, books = compress(vectors.select("vec_id", "label", "embedding"))
    rows = checkpoint(rows.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"))
    by_label = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    met = rows.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(books) if books else "").alias("codebooks_sha256"))

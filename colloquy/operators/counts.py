"""Words counted text by text inside Arrow batches, so that no task holds or sorts more words than a batch has.

Texts are dealt out by their key and sorted by it; rows of a key follow each other, and a batch's last key waits for the next
batch. What comes out is counted: a row a text and word, a row a batch and word, or a row a block and pair of words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

from colloquy.operators.order import together

#: Rows and bytes of a batch that a Python worker receives, rows of one that it gives, and about the most words of a block.
ROWS, BYTES, OUT, BLOCK_WORDS = 1024, 16 << 20, 1 << 17, 1 << 20
#: About the most words of a block that meets the vectors of its words.
POOLED_WORDS = 1 << 22
#: Bits of a block's number in its partition.
BLOCK_BITS = 33
#: A pair's key has the smaller id above these bits.
ID_BITS, ID_MASK = 32, (1 << 32) - 1


def batched(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over bounded batches."""
    conf = rows.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)
    return rows.mapInArrow(run, schema)


def by_key(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows with those of equal keys side by side in one partition."""
    return together(rows, keys[0]).sortWithinPartitions(*keys)


def whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The batches of rows sorted by ``keys`` as tables that cut no run of equal keys, each with its rows' run numbers."""
    kept: list[pa.RecordBatch] = []
    last = None

    def numbered(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        own = list(zip(*(pa.chunked_array([p.column(k) for p in parts]).to_pylist() for k in keys)))
        return pa.Table.from_batches(parts), np.cumsum([0, *(x != y for x, y in zip(own, own[1:]))])

    for batch in batches:
        if not batch.num_rows:
            continue
        of = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        cut = len(of) - 1
        while cut > 0 and of[cut - 1] == of[-1]:
            cut -= 1
        if cut == 0 and (last is None or last == of[-1]):
            kept.append(batch)
        else:
            if cut:
                kept.append(batch.slice(0, cut))
            yield numbered(kept)
            kept = [batch.slice(cut)]
        last = of[-1]
    if kept:
        yield numbered(kept)


def split(texts: pa.ChunkedArray) -> pa.ListArray:
    """The words of texts that have one space between words; empty for null."""
    return pc.split_pattern(pc.fill_null(texts, "").combine_chunks(), " ")


def per_run(lists: list[pa.ListArray], runs: np.ndarray, least: int = 1) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """words, run, word, counts: how often each word of ``least`` letters or more comes in each run, a column a list.

    Words are ASCII or counted by bytes. Rows go by run, then by the word's place in ``words``."""
    flat, of, kind = [], [], []
    for j, words in enumerate(lists):
        own = words.flatten()
        at = np.repeat(runs, pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        if least > 1:
            long = pc.greater_equal(pc.binary_length(own), least)
            own, at = own.filter(long), at[long.to_numpy(zero_copy_only=False)]
        flat.append(own)
        of.append(at)
        kind.append(np.full(len(own), j))
    coded = pa.concat_arrays(flat).dictionary_encode()
    n, k = max(len(coded.dictionary), 1), len(lists)
    keys = (np.concatenate(of).astype(np.int64) * n + coded.indices.to_numpy()) * k + np.concatenate(kind)
    keys.sort()
    pair = keys // k
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.stack([np.add.reduceat((keys % k == j).astype(np.int64), first) if len(first) else first for j in range(k)], axis=1)
    return coded.dictionary, pair[first] // n, pair[first] % n, counts


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes, first bytes first: small numbers and small steps take little."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys as packed steps."""
    return packed(np.diff(keys, prepend=keys.dtype.type(0)))


def keys_of(steps: bytes) -> np.ndarray:
    return np.cumsum(unpacked(steps, np.int64))


#: Packed entries of a matrix, and how many.
ENTRIES = "keys binary, value binary, size long"


def entries_of(keys: np.ndarray, value: np.ndarray) -> pa.Table:
    """A row of ``ENTRIES`` with sorted keys and their values."""
    return pa.table({"keys": pa.array([_steps(keys)], pa.binary()), "value": pa.array([packed(value)], pa.binary()), "size": pa.array([len(keys)])})


def _blocks(batches: Iterator[pa.RecordBatch], most: int, rest: list[str]) -> Iterator[pa.RecordBatch]:
    """block, terms (sorted), codes, sizes (both packed): many texts' words as places in one list, and how many each text has; rest: as lists.

    With ``rest``, texts are sorted by its first column, and a block has all or none of the rows of a value."""
    part, number, kept, held = TaskContext.get().partitionId(), 0, [], 0

    def made() -> pa.RecordBatch:
        lists = pa.concat_arrays([c for t in kept for c in t["tokens"].chunks])
        coded = lists.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int32)
        terms = coded.dictionary.take(pa.array(order))
        lists_of = [pa.concat_arrays([c for t in kept for c in t[name].chunks]) for name in rest]
        columns = [pa.array([(part << BLOCK_BITS) + number]), pa.array([packed(place[coded.indices.to_numpy()])], pa.binary()), pa.array([packed(sizes)], pa.binary())]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (terms, *lists_of)]
        return pa.RecordBatch.from_arrays(columns, ["block", "codes", "sizes", "terms", *rest])

    for rows in (t for t, _ in whole(batches, rest[:1])) if rest else (pa.Table.from_batches([b]) for b in batches if b.num_rows):
        kept.append(rows)
        held += pc.sum(pc.list_value_length(rows["tokens"])).as_py() or 0
        if held >= most:
            yield made()
            number, kept, held = number + 1, [], 0
    if held:
        yield made()


def blocks(tokens: DataFrame, *rest: str, most: int | None = None) -> DataFrame:
    """The rows' ``tokens`` in blocks of many texts. To be stored before it is read twice: blocks are numbered by partition.

    ``rest``: columns to keep, of which the first has its equal values in one partition; they come as lists. ``most``: about the
    most words of a block."""
    most = BLOCK_WORDS if most is None else most
    rows = tokens.select("tokens", *rest).sortWithinPartitions(rest[0]) if rest else tokens.select("tokens")
    kept = [StructField(c, ArrayType(rows.schema[c].dataType)) for c in rest]
    schema = StructType([StructField("block", LongType()), StructField("codes", BinaryType()), StructField("sizes", BinaryType()), StructField("terms", ArrayType(StringType())), *kept])
    return batched(rows, lambda batches: _blocks(batches, most, [*rest]), schema)


def pooled(known_blocks: DataFrame, rest: list[str], schema: StructType) -> DataFrame:
    """rest, vec: of each row of ``blocks`` with ``known`` (place, idf, vec of the words that count) the idf-weighted sum of its
    words' vectors, at unit length; rows of an equal first column share a sum, and sums of zero drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                codes, sizes, known = (batch.column(c)[at] for c in ("codes", "sizes", "known"))
                codes, sizes, known = unpacked(codes.as_py(), np.int32), unpacked(sizes.as_py(), np.int32), known.values
                lists = [batch.column(c)[at].values for c in rest]
                own = lists[0].to_pylist()
                runs = np.cumsum([0, *(x != y for x, y in zip(own, own[1:]))])
                place = np.full(len(batch.column("terms")[at].values), -1)
                place[known.field("place").to_numpy()] = np.arange(len(known))
                word, of = place[codes], np.repeat(runs, sizes)
                of, word = of[word >= 0], word[word >= 0]
                if not len(of):
                    continue
                vec, idf = known.field("vec"), known.field("idf").to_numpy()
                vec = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(known), -1).astype(float)
                keys, n = np.unique(of * len(known) + word, return_counts=True)
                of, word = keys // len(known), keys % len(known)
                total = np.zeros((runs[-1] + 1, vec.shape[1]))
                for start in range(0, len(of), ROWS * 16):
                    cut = slice(start, start + ROWS * 16)
                    to, first = np.unique(of[cut], return_index=True)
                    total[to] += np.add.reduceat(vec[word[cut]] * (n[cut] * idf[word[cut]])[:, None], first, axis=0)
                norm = np.sqrt(np.einsum("ij,ij->i", total, total))
                total /= np.where(norm > 0, norm, 1)[:, None]
                rows = np.flatnonzero(norm[runs] > 0)
                for start in range(0, len(rows), ROWS * 4):
                    cut = rows[start : start + ROWS * 4]
                    made = total[runs[cut]]
                    vecs = pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1], pa.array(made.ravel()))
                    yield pa.RecordBatch.from_arrays([*(x.take(pa.array(cut)) for x in lists), vecs], [*rest, "vec"])

    return batched(known_blocks, run, StructType([*schema, StructField("vec", ArrayType(DoubleType()))]))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and their sums of n."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def pairs(known_blocks: DataFrame, window: int, sides: int) -> DataFrame:
    """cell, keys, n (both packed): pairs of unlike words at most ``window`` places apart in a text, a row a block and cell.

    ``known_blocks``: ``blocks`` with ``kept``: (place, id) of the words that count; others keep their places. Keys have the smaller
    id above, and a cell has the pairs whose ids leave the same remainders by ``sides``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, codes, sizes, kept in zip(*(batch.column(c) for c in ("terms", "codes", "sizes", "kept"))):
                known, own = np.full(len(terms.values), -1), kept.values
                known[own.field("place").to_numpy()] = own.field("id").to_numpy()
                ids, sizes = known[unpacked(codes.as_py(), np.int32)], unpacked(sizes.as_py(), np.int32)
                text, found = np.repeat(np.arange(len(sizes)), sizes), []
                for k in range(1, window + 1):
                    x, y = ids[:-k], ids[k:]
                    near = (text[:-k] == text[k:]) & (x >= 0) & (y >= 0) & (x != y)
                    x, y = x[near], y[near]
                    found.append(np.minimum(x, y) << ID_BITS | np.maximum(x, y))
                keys = np.concatenate(found)
                keys.sort()
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                keys, n = keys[first], np.diff(np.append(first, len(keys)))
                cell = (keys >> ID_BITS) % sides * sides + (keys & ID_MASK) % sides
                order = np.argsort(cell, kind="stable")
                cells, first = np.unique(cell[order], return_index=True)
                keys, n = keys[order], n[order]
                for c, start, stop in zip(cells.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)]):
                    yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([_steps(keys[start:stop])]), pa.array([packed(n[start:stop])])], ["cell", "keys", "n"])

    return batched(known_blocks, run, "cell long, keys binary, n binary")


def margins(cells: DataFrame) -> DataFrame:
    """id, m: how many pairs each word is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column("keys"), batch.column("n")):
                keys, n = keys_of(keys.as_py()), unpacked(n.as_py(), np.int64)
                ids, m = _summed(np.concatenate([keys >> ID_BITS, keys & ID_MASK]), np.concatenate([n, n]))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(m)], ["id", "m"])

    return batched(cells.select("keys", "n"), run, "id long, m long").groupBy("id").agg(F.sum("m").alias("m"))


def met(cells: DataFrame, words: DataFrame, sides: int, make: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.StructArray], pa.Table], schema: str) -> DataFrame:
    """What ``make`` makes of each cell: of its pairs' keys in order, their sums of n over all blocks, and both words' places in the cell's words.

    ``words``: id and what else is needed of a word. Each word goes to the cells of its remainder; a task holds one cell."""
    share = F.pmod(F.col("id"), F.lit(sides))
    packed_ = words.groupBy(share.alias("share")).agg(F.collect_list(F.struct(*words.columns)).alias("words"))
    all_ = F.sequence(F.lit(0), F.lit(sides - 1))
    cell = F.array_distinct(F.concat(F.transform(all_, lambda i: F.col("share") * sides + i), F.transform(all_, lambda i: i * sides + F.col("share"))))
    copies = packed_.select(F.explode(cell).alias("cell"), "words")

    def merge(own: pa.Table, of: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        keys, n = _summed(np.concatenate([none, *(keys_of(x.as_py()) for x in own["keys"])]), np.concatenate([none, *(unpacked(x.as_py(), np.int64) for x in own["n"])]))
        known = pa.concat_arrays([x.flatten() for x in of["words"].chunks])
        ids = known.field("id").to_numpy()
        order = np.argsort(ids)
        x, y = (order[np.searchsorted(ids[order], k)] for k in (keys >> ID_BITS, keys & ID_MASK))
        return make(keys, n, x, y, known)

    return cells.groupBy("cell").cogroup(copies.groupBy("cell")).applyInArrow(merge, schema)


def summed(cells: DataFrame, words: DataFrame, sides: int, value: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """a, b and what ``value`` makes of n: each pair once, counted over all blocks, under its words.

    ``words``: id, term and whatever ``value`` is given of both words besides n."""
    more = [c for c in words.columns if c not in ("id", "term")]
    names = [f.split()[0] for f in schema.split(", ")]

    def make(keys: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, known: pa.StructArray) -> pa.Table:
        given = [known.field(c).to_numpy()[at] for c in more for at in (x, y)]
        made = {"a": known.field("term").take(pa.array(x)), "b": known.field("term").take(pa.array(y))} | value(n, *given)
        return pa.table({c: made[c] for c in names})

    return met(cells, words, sides, make, schema)

"""Word vectors from co-occurrence (positive pointwise mutual information, low-rank factors), pooling, and vector ranking.

Everything over the vocabulary is a DataFrame: counts are joins and aggregates, and the factorisation multiplies the packed
sparse matrix with slices of a block of vectors. Only k x k matrices (k: dimensions and a margin) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from colloquy.functions.text import embedding_tokens
from colloquy.functions.vectors import dot
from colloquy.operators import counts
from colloquy.operators.order import apart, numbered, stored, stored_by, together

LEAST, WINDOW, DIMENSIONS, MARGIN, POWER, SEED = 5, 5, 256, 16, 2, 0x1234ABCD
#: About the most bytes of vectors in a task, and of entries; most entries of a cell; entries up to which one task multiplies.
SIDE, CELL, SMALL = 128 << 20, 1 << 23, 1 << 16
#: Tasks that share the columns of a block of vectors, at least; columns from which a block is kept in single precision.
SLICES, WIDE = 8, 64
#: Remainders of words by which pairs are parted, at least.
SIDES = 6
CHUNK, STRIDE, CHUNKS, NEIGHBOURS = 220, 190, 3, 8


def token_rows(docs: DataFrame, key: str, text: Column, *keep: str, dealt: bool = True) -> DataFrame:
    """key, keep, tokens: each document's embedding tokens in order. Texts are dealt out by key before they are cut, if they are to be."""
    rows = docs.select(key, *keep, text.alias("_text"))
    return (together(rows, key) if dealt else rows).select(key, *keep, embedding_tokens(F.col("_text")).alias("tokens"))


def term_stats(tokens: DataFrame, key: str, least: int = LEAST) -> DataFrame:
    """term, freq, df of the terms with ``least`` occurrences: one row a batch of documents and term is shuffled.

    ``tokens``: ``token_rows``, which have a key's rows in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, runs in counts.whole(batches, [key]):
            words, _, word, n = counts.per_run([rows["tokens"].combine_chunks()], runs)
            freq, df = (np.bincount(word, weights=w, minlength=len(words)).astype(np.int64) for w in (n[:, 0], None))
            yield pa.RecordBatch.from_arrays([words, pa.array(freq), pa.array(df)], ["term", "freq", "df"])

    per_batch = counts.batched(tokens.select(key, "tokens").sortWithinPartitions(key), run, "term string, freq long, df long")
    return per_batch.groupBy("term").agg(F.sum("freq").alias("freq"), F.sum("df").alias("df")).where(F.col("freq") >= least)


def idf(documents: int) -> Column:
    return F.log(1 + F.lit(float(documents)) / F.col("df"))


def _pair_cells(tokens: DataFrame, vocabulary: DataFrame, window: int) -> tuple[DataFrame, DataFrame, int]:
    """Pairs of vocabulary words, packed by cell (see ``counts.pairs``); the vocabulary with an id; and the sides of the square of cells.

    Documents are stored in blocks with a list of words each. The lists meet the vocabulary, a row a block and word, so rare words
    go before any pair is made. Ids follow the order of the words.
    """
    blocks = stored(counts.blocks(tokens))
    ids = stored(numbered(vocabulary, "term", start=0, name="id"))
    kept = blocks.select("block", F.posexplode("terms").alias("place", "term")).join(ids.select("id", "term"), "term").groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("kept"))
    # a block has up to five million pairs, a cell about as many as one of them
    sides = max(math.isqrt(blocks.count()) + 1, SIDES)
    return counts.pairs(blocks.join(kept, "block"), window, sides), ids, sides


def cooccurrences(tokens: DataFrame, key: str, vocabulary: DataFrame, window: int = WINDOW) -> DataFrame:
    """a, b, n for a < b: pairs of unlike vocabulary words at most ``window`` positions apart. Positions count all tokens.

    Pairs are counted in blocks of documents and shuffled as packed numbers; a task adds up a cell of them and names its words.
    """
    cells, ids, sides = _pair_cells(tokens, vocabulary, window)
    return counts.summed(cells, ids.select("id", "term"), sides, lambda n: {"n": n}, "a string, b string, n long")


def ppmi(tokens: DataFrame, key: str, vocabulary: DataFrame, window: int = WINDOW) -> DataFrame:
    """a, b, ppmi > 0 in both directions, of ``cooccurrences``. Cells are stored, and their words bring their sums with them."""
    cells, ids, sides = _pair_cells(tokens, vocabulary, window)
    cells = stored(cells)
    words = stored(ids.select("id", "term").join(counts.margins(cells), "id"))
    total = float(words.agg(F.sum("m").alias("t")).head().t or 1)
    made = counts.summed(cells, words, sides, lambda n, x, y: {"ppmi": np.log(n * total / (x.astype(float) * y))}, "a string, b string, ppmi double").where("ppmi > 0")
    return made.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))), "ppmi")


def _row_blocks(column: pa.Array, of: type, k: int) -> Iterator[np.ndarray]:
    for x in column:
        yield np.frombuffer(x.as_py(), of).reshape(-1, k)


class _Block:
    """A block of vectors, k a word, as stored rows (part, v): v has the vectors of the part's ids, one after another; ``by``: a k x k
    matrix that the vectors are still to be multiplied with."""

    def __init__(self, rows: DataFrame, k: int, of: type, by: np.ndarray | None = None):
        self.rows, self.k, self.of, self.by = rows, k, of, np.eye(k) if by is None else by

    def turned(self, by: np.ndarray) -> _Block:
        return _Block(self.rows, self.k, self.of, self.by @ by)

    def gram(self) -> np.ndarray:
        """The sum of all vectors' products with themselves; each task sends its own sum."""
        k, of, by = self.k, self.of, self.by

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k))
            for batch in batches:
                for v in _row_blocks(batch.column("v"), of, k):
                    v = v.astype(float) @ by
                    total += v.T @ v
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["at", "value"])

        return _square(counts.batched(self.rows.select("v"), run, "at long, value double"), k)

    def orthonormal(self) -> _Block:
        """Orthonormal columns, through the Gram matrix's eigenvectors (twice, for accuracy); directions without weight go to 0."""
        out = self
        for _ in range(2):
            values, vectors = np.linalg.eigh(out.gram())
            keep = values > values.max(initial=0) * 1e-13
            out = out.turned(vectors * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0))
        return out


def _square(rows: DataFrame, k: int) -> np.ndarray:
    """at, value of k x k matrices, added up."""
    out = np.zeros(k * k)
    for r in rows.groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r.value
    return out.reshape(k, k)


class _Matrix:
    """A symmetric matrix of words, as it is multiplied with blocks of vectors.

    Rows of ``entries`` (keys, value) have packed entries, each pair of ids once (see ``counts``). A task takes a slice of the columns and
    a group of the entries: entries are copied once a slice, and stored where their task reads them; of a block, a slice goes to each group.
    So in a step no more than the block is moved, there and back. Value is that of an entry, or a count n from which it is
    ln n - level(a) - level(b), with ``levels`` (id, level).
    """

    def __init__(self, entries: DataFrame, n: int, k: int, cut: Callable[[DataFrame], DataFrame], levels: DataFrame | None = None):
        self.n, self.k, self.cut, self.of = n, k, cut, np.float32 if k > WIDE else np.float64
        held = entries.agg(F.sum(F.length("keys") + F.length("value")).alias("bytes"), F.sum("size").alias("size")).head()
        slices = min(k, max(-(-n * k * 8 // SIDE), 1 if (held["size"] or 0) < SMALL else SLICES))
        self.width = -(-k // slices)
        self.slices, self.groups = -(-k // self.width), (held["bytes"] or 0) // SIDE + 1
        #: Ids of a part.
        self.size = max(1, SIDE // (64 * k))
        self.parts = -(-n // self.size)
        group = F.pmod(F.xxhash64("keys"), F.lit(self.groups))
        each = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
        self.tasks = F.array(*(F.lit(x).cast("long") for x in apart(entries.sparkSession, self.slices * self.groups)))
        copies = entries.select(F.explode(F.transform(each(self.slices), lambda s: self._task(s, group))).alias("task"), F.lit(-1).cast("long").alias("part"), "keys", "value")
        self.counted = levels is not None
        if levels is not None:
            copies = copies.unionByName(self._levels(levels).select(F.explode(self.tasks).alias("task"), "part", F.lit(None).cast("binary").alias("keys"), "value"))
        self.rows = stored_by(copies, "task", cut)

    def _task(self, slice_: Column, group: Column) -> Column:
        return F.element_at(self.tasks, (slice_ * self.groups + group + 1).cast("int"))

    def _levels(self, levels: DataFrame) -> DataFrame:
        """part, value: the levels of the part's ids in order; ids without one have 0."""
        size, n = self.size, self.n

        def run(own: pa.Table) -> pa.Table:
            part = own["part"][0].as_py()
            out = np.zeros(min(size, n - part * size))
            out[own["id"].to_numpy() - part * size] = own["level"].to_numpy()
            return pa.table({"part": pa.array([part]), "value": pa.array([out.tobytes()], pa.binary())})

        return levels.select(F.floor(F.col("id") / size).alias("part"), "id", F.col("level").cast("double").alias("level")).groupBy("part").applyInArrow(run, "part long, value binary")

    def start(self, spark: SparkSession, seed: int) -> _Block:
        k, n, size, of = self.k, self.n, self.size, self.of

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in batch.column("part").to_pylist():
                    v = np.random.default_rng([seed, part]).standard_normal((min(size, n - part * size), k)).astype(of)
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([v.tobytes()], pa.binary())], ["part", "v"])

        return _Block(self.cut(counts.batched(spark.range(self.parts).withColumnRenamed("id", "part"), run, "part long, v binary")), k, of)

    def times(self, block: _Block) -> _Block:
        k, n, size, of, by, width, slices, counted = self.k, self.n, self.size, self.of, block.by, self.width, self.slices, self.counted

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, v in zip(batch.column("part").to_pylist(), _row_blocks(batch.column("v"), of, k)):
                    v = np.ascontiguousarray((v.astype(float) @ by).T.astype(of))
                    for s in range(slices):
                        yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([part]), pa.array([v[s * width : (s + 1) * width].tobytes()], pa.binary())], ["slice", "part", "v"])

        def product(entries: pa.Table, vectors: pa.Table) -> pa.Table:
            own = min(width, k - vectors["slice"][0].as_py() * width) if len(vectors) else 0
            x, out, level = np.zeros((own, n)), np.zeros((own, n)), np.zeros(n if counted else 0)
            for part, v in zip(vectors["part"].to_pylist(), vectors["v"]):
                v = np.frombuffer(v.as_py(), of).reshape(own, -1)
                x[:, part * size : part * size + v.shape[1]] = v
            parts = entries["part"].to_pylist()
            for part, value in zip(parts, entries["value"]):
                if part >= 0:
                    given = np.frombuffer(value.as_py())
                    level[part * size : part * size + len(given)] = given
            for part, steps, value in zip(parts, entries["keys"], entries["value"]):
                if part < 0:
                    _multiply(counts.keys_of(steps.as_py()), counts.unpacked(value.as_py(), np.int64 if counted else np.float64), level, x, out)
            made = [out[:, at : at + size].astype(of).tobytes() for at in range(0, n, size)]
            return pa.table({"slice": pa.array([vectors["slice"][0].as_py()] * len(made), pa.int64()), "part": pa.array(range(len(made)), pa.int64()), "v": pa.array(made, pa.binary())})

        def joined(rows: pa.Table) -> pa.Table:
            part = rows["part"][0].as_py()
            total = np.zeros((k, min(size, n - part * size)))
            for s, v in zip(rows["slice"].to_pylist(), rows["v"]):
                v = np.frombuffer(v.as_py(), of).reshape(-1, total.shape[1])
                total[s * width : s * width + len(v)] += v
            return pa.table({"part": pa.array([part]), "v": pa.array([np.ascontiguousarray(total.T.astype(of)).tobytes()], pa.binary())})

        cuts = counts.batched(block.rows, cut, "slice long, part long, v binary")
        copies = cuts.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(self.groups - 1)), lambda g: self._task(F.col("slice"), g))).alias("task"), "slice", "part", "v")
        made = self.rows.groupBy("task").cogroup(copies.groupBy("task")).applyInArrow(product, "slice long, part long, v binary")
        return _Block(self.cut(made.groupBy("part").applyInArrow(joined, "part long, v binary")), k, of)


def _multiply(keys: np.ndarray, value: np.ndarray, level: np.ndarray, x: np.ndarray, out: np.ndarray) -> None:
    """Adds the product of packed entries with the rows of ``x``, both ways, to ``out``."""
    for start in range(0, len(keys), CELL):
        a, b = keys[start : start + CELL] >> counts.ID_BITS, keys[start : start + CELL] & counts.ID_MASK
        v = value[start : start + CELL]
        if len(level):
            v = np.log(v) - level[a] - level[b]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        rows, sizes, back = a[first], np.diff(np.append(first, len(a))), np.where(a == b, 0, v)
        for own, to in zip(x, out):
            to[rows] += np.add.reduceat(v * own[b], first)
            to += np.bincount(b, weights=back * np.repeat(own[rows], sizes), minlength=len(to))


def _leading(matrix: _Matrix, names: DataFrame, dimensions: int, power: int, seed: int) -> DataFrame:
    """The columns of ``names`` but id, and vec: rows of V sqrt(L), L the largest positive eigenvalues, at unit length; words of no entry drop out.

    A random block is multiplied and made orthonormal 1 + ``power`` times, then the small projected matrix is solved.
    """
    k, n, size, of = matrix.k, matrix.n, matrix.size, matrix.of
    block = matrix.start(names.sparkSession, seed)
    for _ in range(1 + power):
        block = matrix.times(block).orthonormal()
    by = block.by

    def inner(v: pa.Table, u: pa.Table) -> pa.Table:
        one = next(_row_blocks(v["v"].combine_chunks(), of, k)).astype(float) @ by
        return pa.table({"at": pa.array(np.arange(k * k)), "value": pa.array((one.T @ next(_row_blocks(u["v"].combine_chunks(), of, k))).ravel())})

    small = _square(block.rows.groupBy("part").cogroup(matrix.times(block).rows.groupBy("part")).applyInArrow(inner, "at long, value double"), k)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = [i for i in np.argsort(-values) if values[i] > 1e-9][:dimensions]
    rest = [c for c in names.columns if c != "id"]
    schema = StructType([*(names.schema[c] for c in rest), StructField("vec", ArrayType(DoubleType()))])
    if not order:
        return names.sparkSession.createDataFrame([], schema)
    last = by @ (vectors[:, order] * np.sqrt(values[order]))

    def named(v: pa.Table, own: pa.Table) -> pa.Table:
        part = v["part"][0].as_py()
        made = (next(_row_blocks(v["v"].combine_chunks(), of, k)).astype(float) @ last)[own["id"].to_numpy() - part * size]
        norm = np.sqrt(np.einsum("ij,ij->i", made, made))
        rows = np.flatnonzero(norm > 0)
        made = made[rows] / norm[rows, None]
        vecs = pa.ListArray.from_arrays(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1], pa.array(made.ravel()))
        return own.select(rest).take(pa.array(rows)).append_column("vec", vecs)

    return block.rows.groupBy("part").cogroup(names.withColumn("part", F.floor(F.col("id") / size)).groupBy("part")).applyInArrow(named, schema)


def factorize(matrix: DataFrame, dimensions: int = DIMENSIONS, margin: int = MARGIN, power: int = POWER, seed: int = SEED, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """term, vec: the ``dimensions`` leading factors of the symmetric ``matrix`` (a, b, ppmi), see ``_leading``.

    ``cut`` ends the lineage of a step (default: the shared folder).
    """
    cut = cut or stored
    matrix = cut(matrix)
    ids = stored(numbered(matrix.select(F.col("a").alias("term")).distinct(), "term", start=0, name="id"))
    sides = math.isqrt(matrix.count() // CELL) + 1
    side = lambda c: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(sides))
    all_ = F.sequence(F.lit(0), F.lit(sides - 1))
    cells = matrix.where("a <= b").select((side("a") * sides + side("b")).alias("cell"), "a", "b", "ppmi")
    copies = ids.select(F.explode(F.array_distinct(F.concat(F.transform(all_, lambda i: side("term") * sides + i), F.transform(all_, lambda i: i * sides + side("term"))))).alias("cell"), "id", "term")

    def pack(own: pa.Table, of: pa.Table) -> pa.Table:
        if not len(own):
            return pa.table({"keys": pa.array([], pa.binary()), "value": pa.array([], pa.binary()), "size": pa.array([], pa.int64())})
        a, b = (of["id"].to_numpy()[pc.index_in(own[c].combine_chunks(), value_set=of["term"].combine_chunks()).to_numpy()] for c in ("a", "b"))
        keys = np.minimum(a, b) << counts.ID_BITS | np.maximum(a, b)
        order = np.argsort(keys)
        return counts.entries_of(keys[order], own["ppmi"].to_numpy()[order])

    entries = cut(cells.groupBy("cell").cogroup(copies.groupBy("cell")).applyInArrow(pack, counts.ENTRIES))
    return _leading(_Matrix(entries, ids.count(), dimensions + margin, cut), ids, dimensions, power, seed)


def factors(tokens: DataFrame, vocabulary: DataFrame, dimensions: int = DIMENSIONS, margin: int = MARGIN, power: int = POWER, seed: int = SEED, window: int = WINDOW) -> DataFrame:
    """The vocabulary's columns and vec: ``factorize`` of the words' ``ppmi``, whose entries stay packed and without names."""
    cells, ids, sides = _pair_cells(tokens, vocabulary, window)
    cells = stored(cells)
    words = stored(counts.margins(cells))
    total = float(words.agg(F.sum("m").alias("t")).head().t or 1)

    def positive(keys: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, known: pa.StructArray) -> pa.Table:
        m = known.field("m").to_numpy().astype(float)
        good = n * total / (m[x] * m[y]) > 1
        return counts.entries_of(keys[good], n[good])

    entries = stored(counts.met(cells, words, sides, positive, counts.ENTRIES))
    matrix = _Matrix(entries, ids.count(), dimensions + margin, stored, words.select("id", (F.log("m") - math.log(total) / 2).alias("level")))
    return _leading(matrix, ids, dimensions, power, seed)


def train(docs: DataFrame, key: str, text: Column, dimensions: int = DIMENSIONS, least: int = LEAST, margin: int = MARGIN) -> DataFrame:
    """The word table: term, idf, vec."""
    stats = stored(term_stats(token_rows(docs, key, text), key, least))
    words = stats.select("term", idf(docs.count()).alias("idf"))
    return factors(token_rows(docs, key, text, dealt=False), words, dimensions, margin)


def pool(tokens: DataFrame, key: str, words: DataFrame, *keep: str) -> DataFrame:
    """key, keep, vec: the idf-weighted sum of a text's word vectors at unit length; texts without a known word drop out.

    ``tokens`` has a key's rows in one partition; they share a sum. Texts are stored in blocks with a list of words each. The lists
    meet ``words`` (term, idf and vec, or its bytes q), a row a block and word, so no vector is moved once for each text it is in.
    """
    short = "q" in words.columns
    blocks = stored(counts.blocks(tokens, key, *keep, most=counts.POOLED_WORDS if short else counts.POOLED_WORDS // 8))  # a block's vectors are a row
    vec = F.col("q" if short else "vec").alias("vec")
    known = blocks.select("block", F.posexplode("terms").alias("place", "term")).join(words.select("term", "idf", vec), "term")
    known = known.where("idf is not null and vec is not null").groupBy("block").agg(F.collect_list(F.struct("place", "idf", "vec")).alias("known"))
    return counts.pooled(blocks.join(known, "block"), [key, *keep], tokens.select(key, *keep).schema)


def passages(segments: DataFrame, *keep: str, chunks: int | None = CHUNKS) -> DataFrame:
    """segment_id, start_sec, keep, idx, char_offset, text: the question (offset -1), then chunks of the answer: up to three, or to its end (None).

    Chunks have up to 220 words and start every 190; none starts after one has reached the end. Offsets are code points.
    """
    own = ("segment_id", "start_sec", *keep)
    answer = segments.select(*own, F.regexp_extract_all("answer", F.lit(r"(?U)\s*\S+"), F.lit(0)).alias("w"))
    n = F.when(F.size("w") > 0, F.greatest(F.lit(1), F.ceil((F.size("w") - (CHUNK - STRIDE)) / STRIDE).cast("int"))).otherwise(0)
    steps = F.when(n > 0, F.sequence(F.lit(0), (n if chunks is None else F.least(n, F.lit(chunks))) - 1)).otherwise(F.array().cast("array<int>"))
    strides = answer.withColumn("_steps", steps).withColumn("_lengths", F.transform("_steps", lambda i: F.length(F.array_join(F.slice("w", i * STRIDE + 1, F.lit(STRIDE)), ""))))
    before = F.aggregate("_lengths", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))

    def chunk(i: Column, ahead: Column) -> Column:
        first = F.element_at("w", i * STRIDE + 1)
        lead = F.length(first) - F.length(F.regexp_replace(first, r"(?U)\A\s+", ""))
        body = F.substr(F.array_join(F.slice("w", i * STRIDE + 1, F.lit(CHUNK)), ""), lead + 1)
        return F.struct((i + 1).cast("long").alias("idx"), (ahead + lead).cast("long").alias("char_offset"), body.alias("text"))

    placed = strides.withColumn("_before", before)
    answers = placed.select(*own, F.inline(F.transform("_steps", lambda i: chunk(i, F.element_at("_before", i + 1)))))
    questions = segments.where("trim(question) <> ''").select(*own, F.lit(0).cast("long").alias("idx"), F.lit(-1).cast("long").alias("char_offset"), F.col("question").alias("text"))
    return questions.unionByName(answers)


def of_kind(kind: str) -> Column:
    """On passages, ``question`` and ``answer`` choose question and answer passages; other kinds do not filter."""
    return F.col("char_offset") < 0 if kind == "question" else F.col("char_offset") >= 0 if kind == "answer" else F.lit(True)


def best_passages(scored: DataFrame, n: int, *order: str) -> DataFrame:
    """Each segment's best passage (ties: ``order``), then the n best segments."""
    first = Window.partitionBy("segment_id").orderBy(F.desc("score"), *order)
    return scored.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first").orderBy(F.desc("score"), "segment_id").limit(n)


def rank(vectors: DataFrame, query: list[float], n: int, kind: str = "all", episode: str = "", shards: list[str] | None = None) -> DataFrame:
    """The n best segments by cosine; the query is a literal, so filters and the product run in the scan's stage."""
    keep = of_kind(kind)
    if episode:
        keep &= F.col("episode_id") == episode
    if shards:
        keep &= F.col("shard").isin(shards)
    score = dot(F.array(*(F.lit(float(x)) for x in query)), F.col("q")) / 127
    return best_passages(vectors.where(keep).withColumn("score", score), n, "char_offset")


def nearest_words(words: DataFrame, word: str, n: int = NEIGHBOURS) -> DataFrame:
    """term, score of the words closest to ``word``, itself left out."""
    own = words.where(F.col("term") == word).select("vec").head()
    if own is None:
        return words.select("term", F.lit(0.0).alias("score")).where(F.lit(False))
    score = dot(F.array(*(F.lit(float(x)) for x in own.vec)), F.col("vec"))
    return words.where(F.col("term") != word).select("term", score.alias("score")).orderBy(F.desc("score"), "term").limit(n)

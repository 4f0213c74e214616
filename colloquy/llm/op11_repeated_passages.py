"""Substring dedup: repeated passages are located by sharded Aho-Corasick automata and cut from all but their first place.

A window is WINDOW consecutive words (parted by ASCII white space) of one text. A word goes if a window that covers it stands
earlier too: in a row with a smaller doc_id, or in the same row further ahead.

1. Each row's words, joined by single spaces and compressed, are dealt out by row and stored once.
2. Each window names its anchor, the GRAM-word phrase in it with the smallest hash (the first of equal ones). Equal windows name
   equal anchors, so a window can recur only if its anchor does. Anchors are counted over all texts, with a partial count before
   the shuffle; a recurring anchor's home is its first row. About one anchor in six words leaves the texts, as a hash.
3. Anchors that share a home share a shard, about KEYS of them each. A row sends each shard the stretches whose windows have
   anchors of that shard, and nothing else. A shard with many stretches (a passage that a third of all rows has) is dealt to
   several tasks, each with the shard's automaton.
4. A task compiles the home rows' anchor phrases into an automaton over word numbers, then streams the stretches through it. At
   each hit the words of both places are compared outwards, so what is found is equal word by word, not by hash.
5. Windows that have a recurring anchor but do not stand in its home are settled by the same steps once more, with the whole
   window's hash in the place of the anchor: then its first row has it. If two unlike windows share a hash, another round with
   another hash settles them; rounds end when no window is left.

No task holds more than one shard's home stretches and one stretch, and nothing but counts of rows reaches the driver.

Null and empty texts have no words; a text shorter than a window loses none. A null doc_id counts as the largest. Rows of equal
id are taken in the order of their texts' hashes; rows of equal id and text count as one and each get its result. Other columns
are ignored by ``repeats`` and kept by ``deduplicate``, which replaces the texts that lose words. No rows: no result.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import checkpoint, shared_folder, unused
from colloquy.llm.op4_toxicity import texts
from colloquy.operators.order import numbered

WINDOW, GRAM = 20, 8
#: Recurring keys a shard, and occurrences of them that one task streams through a shard's automaton.
KEYS, STREAM = 1 << 14, 1 << 18
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The powers of BASE and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for k, factor in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n, factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + np.uint64((seed * BASE) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of a text whose words are joined by single spaces."""
    out, at = [], 0
    while at < len(text):
        cut = text.rfind(b" ", at, at + BLOCK) if len(text) - at > BLOCK else len(text)
        if cut <= at:  # a word longer than a block
            cut = text.find(b" ", at)
            cut = len(text) if cut < 0 else cut
        data = np.frombuffer(text, np.uint8, cut - at, at)
        gaps = np.flatnonzero(data == 32)
        starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
        up, down = powers(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
        out.append(mixed((sums[ends] - sums[starts]) * down[starts]))
        at = cut + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def rolled(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    n = len(words) - size + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        total = total * np.uint64(BASE) + words[k : k + n]
    return mixed(total, seed)


def window_keys(words: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's key and where it stands: its anchor for seed 0, else its own hash by that seed."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if seed:
        keys = rolled(words, WINDOW, seed)
        return keys.view(np.int64), np.arange(len(keys))
    value = rolled(words, GRAM)
    place, width = np.arange(len(value)), 1
    while width < WINDOW - GRAM + 1:  # the first minimum of ever wider runs
        step = min(width, WINDOW - GRAM + 1 - width)
        first = value[:-step] <= value[step:]
        value, place, width = np.where(first, value[:-step], value[step:]), np.where(first, place[:-step], place[step:]), width + step
    return value.view(np.int64), place


def packed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, tie, words): compressed words of each row; rows number the distinct (doc_id, text) in the order of the removal."""
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), "text")
    if keyed.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        keyed = keyed.withColumn("row", F.col("doc_id"))
    else:
        rows = numbered(keyed.select("doc_id", "tie").distinct(), F.col("doc_id").asc_nulls_last(), "tie", name="row")
        rows = rows.select(F.col("doc_id").alias("id"), F.col("tie").alias("of"), "row")
        keyed = keyed.join(rows, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tie") == F.col("of")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        for batch in batches:
            words = [press.compress(b" ".join(raw.split())) for raw in texts(batch, 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words, pa.binary())], ["row", "doc_id", "tie", "words"])

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    # stored by row, so that later joins by row move the other side only
    return checkpoint(keyed.select("row", "doc_id", "tie", "text").mapInArrow(run, "row long, doc_id long, tie long, words binary").repartition(parts, "row"))


def unpack(column: pa.Array) -> Iterator[bytes]:
    press = zstandard.ZstdDecompressor()
    return (press.decompress(w.as_buffer()) for w in column)


def anchors(rows: DataFrame) -> DataFrame:
    """(key, row): one row each place of an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in _gathered(zip(batch.column(0).to_pylist(), unpack(batch.column(1)))):
                hashes = word_hashes(b" ".join(found))
                counts = np.array([t.count(b" ") + 1 for t in found])
                keys, place = window_keys(hashes, 0)
                of = np.repeat(np.arange(len(found)), counts)
                keep = of[: len(keys)] == of[WINDOW - 1 :][: len(keys)]  # windows of one text
                keep[1:] &= ~((place[1:] == place[:-1]) & keep[:-1])  # a place that the window before names too
                rows_of = np.array(part, np.int64)[of[: len(keys)][keep]]
                yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(rows_of)], ["key", "row"])

    return rows.select("row", "words").mapInArrow(run, "key long, row long")


def _gathered(rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows with words in lists of about BLOCK bytes."""
    part, found, size = [], [], 0
    for row, text in rows:
        if text:
            part.append(row)
            found.append(text)
            size += len(text)
            if size >= BLOCK:
                yield part, found
                part, found, size = [], [], 0
    if part:
        yield part, found


def stretches(rows: DataFrame, marks: DataFrame, seed: int) -> DataFrame:
    """(shard, salt, kind, row, start, text, keys): each row's stretches for the shards of its recurring keys.

    kind 0: of the keys' home, with these keys, for each task of the shard; kind 1: of another row, for one of its tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            size = 0
            for row, text, own in zip(batch.column(0).to_pylist(), unpack(batch.column(1)), batch.column(2)):
                mark = own.values
                known, shard, salts, home = (mark.field(n).to_numpy(zero_copy_only=False) for n in ("key", "shard", "salts", "home"))
                sort = np.argsort(known)
                known, shard, salts, home = known[sort], shard[sort], salts[sort], home[sort]
                keys, _ = window_keys(word_hashes(text), seed)
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                starts = np.flatnonzero(known[at] == keys)
                at = at[starts]
                words = text.split(b" ")
                group = shard[at] * 2 + home[at]
                for g in np.unique(group).tolist():
                    mine = np.flatnonzero(group == g)
                    s, k = starts[mine], at[mine]
                    breaks = np.flatnonzero(np.diff(s) > WINDOW) + 1
                    for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(s)]):
                        first, last, many = int(s[a]), int(s[b - 1]) + WINDOW, int(salts[k[a]])
                        piece = b" ".join(words[first:last])
                        listed = np.unique(known[k[a:b]]).tolist() if g % 2 else None
                        for salt in range(many) if g % 2 else [(row * 0x9E3779B1 >> 16) % many]:
                            for column, value in zip(out, (g // 2, salt, 1 - g % 2, row, first, piece, listed)):
                                column.append(value)
                            size += len(piece)
                if size >= BLOCK:
                    yield _batch(out)
                    out, size = [[] for _ in range(7)], 0
            yield _batch(out)

    met = rows.join(marks, "row").select("row", "words", "marks")
    return met.mapInArrow(run, "shard int, salt int, kind int, row long, start int, text binary, keys array<long>")


def _batch(out: list[list]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["shard", "salt", "kind", "row", "start", "text", "keys"])


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are known; ``known`` is sorted and not empty."""
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


class Passages:
    """One shard's home stretches and the automaton over their key phrases."""

    def __init__(self, seed: int):
        self.seed, self.width = seed, WINDOW if seed else GRAM
        self.numbers: dict[bytes, int] = {}
        self.homes: list[tuple[int, int, np.ndarray, list[int]]] = []  # row, start, word numbers twice
        self.places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.settings: set[tuple[int, tuple[int, ...]]] = set()
        self.keys: set[int] = set()
        self.automaton: ahocorasick.Automaton | None = None

    def add(self, row: int, start: int, text: bytes, keys: list[int]) -> None:
        words = text.split(b" ")
        for w in words:
            self.numbers.setdefault(w, len(self.numbers) + 1)
        own = list(map(self.numbers.__getitem__, words))
        found, place = window_keys(word_hashes(text), self.seed)
        for at in np.unique(place[among(found, np.array(keys, np.int64))]).tolist():
            # the same words around the phrase as at an earlier place of its row: whatever matches here matches there
            before = max(at + self.width - WINDOW, 0)
            setting = at - before, tuple(own[before : at + WINDOW])
            if setting not in self.settings:
                self.settings.add(setting)
                self.places.setdefault(tuple(own[at : at + self.width]), []).append((len(self.homes), at))
        self.homes.append((row, start, np.array(own, np.int32), own))
        self.keys.update(keys)

    def compile(self) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for phrase, places in self.places.items():
            self.automaton.add_word(phrase, places)
        self.automaton.make_automaton()
        self.known = np.array(sorted(self.keys), np.int64)

    def locate(self, row: int, start: int, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For each window of a stretch: whether it stands earlier in a home row, and whether its key is of this shard."""
        words = text.split(b" ")
        numbers = list(map(self.numbers.get, words, repeat(0)))
        own = np.array(numbers, np.int32)
        keys, place = window_keys(word_hashes(text), self.seed)
        found, of, met = np.zeros(len(keys), bool), place.tolist(), set()
        first, last = 0, 0  # windows of the newest line that matched
        width, half = self.width, (WINDOW - self.width) // 2
        for end, places in self.automaton.iter(tuple(numbers)) if self.places else ():
            at = end - width + 1
            low, high = bisect_left(of, at), bisect_right(of, at)
            if first <= low and high <= last or found[low:high].all():  # none names this place, or all are found
                continue
            left, right = numbers[at - half : at] if at >= half else None, numbers[end + 1 : end + 1 + half]
            for home, there in places:
                shift = there - at
                if (home, shift) in met:
                    continue
                row_of, start_of, theirs, listed = self.homes[home]
                if row_of == row and start_of + there >= start + at:
                    continue
                # a whole window needs half of its other words on one side at least; a later place of the line may have them
                beyond = there + width
                if not (left is not None and there >= half and listed[there - half : there] == left) and listed[beyond : beyond + half] != right:
                    continue
                met.add((home, shift))
                a, b = max(0, -shift), min(len(own), len(theirs) - shift)
                unlike = np.flatnonzero(own[a:b] != theirs[a + shift : b + shift])
                edges = np.concatenate([[-1], unlike, [b - a]])
                for k in np.flatnonzero(np.diff(edges) > WINDOW).tolist():
                    x, y = a + int(edges[k]) + 1, a + int(edges[k + 1]) - WINDOW + 1
                    found[x:y] = True
                    if x <= low < y:
                        first, last = x, y
                if first <= low and high <= last or found[low:high].all():
                    break
        return found, among(keys, self.known)


def located(pieces: DataFrame, seed: int) -> DataFrame:
    """(row, start, stop, key): words to cut (key null), and windows that their key's home lacks (key: the next seed's)."""
    split = pieces.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind", "row", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, passages, own, out = None, Passages(seed), [], []

        def settle(row: int, start: int, text: bytes, home: bool) -> None:
            found, mine = passages.locate(row, start, text)
            s = np.flatnonzero(found)
            if len(s):
                breaks = np.flatnonzero(np.diff(s) > WINDOW) + 1
                firsts, lasts = s[np.concatenate([[0], breaks])], s[np.concatenate([breaks - 1, [len(s) - 1]])]
                out.append((np.full(len(firsts), row), start + firsts, start + lasts + WINDOW, pa.nulls(len(firsts), pa.int64())))
            left = np.flatnonzero(mine & ~found)
            if len(left) and not home:
                keys, _ = window_keys(word_hashes(text), seed + 1)
                out.append((np.full(len(left), row), start + left, start + left + WINDOW, pa.array(keys[left])))

        def ready() -> None:
            """All home stretches are in: they may repeat themselves, too."""
            if passages.automaton is None:
                passages.compile()
                for piece in own:
                    settle(*piece, True)
                own.clear()

        def told() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate([o[k] for o in out]), t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()))]
            keys = pa.concat_arrays([o[3] for o in out])
            out.clear()
            return pa.RecordBatch.from_arrays([*columns, keys], ["row", "start", "stop", "key"])

        for batch in batches:
            for shard, salt, kind, row, start, text, keys in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (shard, salt):
                    ready()
                    now, passages = (shard, salt), Passages(seed)
                if kind == 0:
                    passages.add(row, start, text, keys)
                    if salt == 0:
                        own.append((row, start, text))
                else:
                    ready()
                    settle(row, start, text, False)
            if out:
                yield told()
        ready()
        if out:
            yield told()

    return split.mapInArrow(run, "row long, start int, stop int, key long")


def written(rows: DataFrame) -> DataFrame:
    """The rows, from a Parquet table in the shared folder."""
    path = f"{shared_folder(rows.sparkSession)}/passages-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def cuts(rows: DataFrame) -> DataFrame:
    """(row, start, stop): the words to cut of each of the ``packed`` rows; spans of a row may meet."""
    keys, seed, out = anchors(rows), 0, None
    while True:
        counted = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1")
        counted = written(counted)
        shards = -(-max(counted.count(), 1) // KEYS)
        placed = counted.withColumn("shard", F.pmod(F.xxhash64("first"), F.lit(shards)).cast("int"))
        load = placed.groupBy("shard").agg(F.ceil(F.sum("n") / STREAM).cast("int").alias("salts"))
        placed = placed.join(load, "shard")
        mark = F.struct("key", "shard", "salts", (F.col("row") == F.col("first")).cast("int").alias("home"))
        marks = keys.join(placed, "key").groupBy("row").agg(F.collect_set(mark).alias("marks"))
        found = written(located(stretches(rows, marks, seed), seed))
        spans = found.where("key is null").select("row", "start", "stop")
        out = spans if out is None else out.unionByName(spans)
        keys, seed = found.where("key is not null").select("key", "row"), seed + 1
        if keys.isEmpty():
            return out


def _kept(text: bytes, spans: list[dict] | None) -> tuple[int, list[bytes]]:
    """How many words a text has, and those outside the spans."""
    words = text.split(b" ") if text else []
    keep = np.ones(len(words), bool)
    for span in spans or ():
        keep[span["start"] : span["stop"]] = False
    return len(words), [words[k] for k in np.flatnonzero(keep).tolist()] if spans else words


def _with_spans(rows: DataFrame) -> DataFrame:
    gathered = cuts(rows).groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return rows.join(gathered, "row", "left")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by single spaces) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, digests = [], [], []
            for text, spans in zip(unpack(batch.column(1)), batch.column(2).to_pylist()):
                n, kept = _kept(text, spans)
                counts.append(n)
                removed.append(n - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _with_spans(packed(docs)).select("doc_id", "words", "spans")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents with their repeated words cut: texts that lose words become their kept words, joined by single spaces."""
    twin, tie, cut = unused(docs.columns, "twin", "tie", "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [b" ".join(_kept(t, s)[1]).decode() for t, s in zip(unpack(batch.column(2)), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.string())], [twin, tie, cut])

    changed = _with_spans(packed(docs)).where("spans is not null").select("doc_id", "tie", "words", "spans")
    texts_ = changed.mapInArrow(run, f"{twin} long, {tie} long, {cut} string").dropDuplicates([twin, tie])
    joined = docs.join(texts_, F.col("doc_id").cast("long").eqNullSafe(F.col(twin)) & (F.xxhash64("text") == F.col(tie)), "left")
    return joined.select(*(F.coalesce(cut, "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))

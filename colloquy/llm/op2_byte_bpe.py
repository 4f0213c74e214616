"""Byte-level BPE encoding and decoding with recursive DuckDB queries in each partition.

A text is split by the tokenizer's pattern. The distinct matches that a worker has not met yet become token-position rows
(match, position, token), at first one row a byte. A recursive query joins neighbouring rows with the merge table and contracts
each match's leftmost pair of minimum rank until no pair of it merges. Decoding is an ordered aggregation: the rows (run,
position, token) join the vocabulary and their bytes are joined by position. Matches repeat much, so each worker remembers the
ids of up to ``REMEMBERED`` matches; what is forgotten is computed again.

The merge table holds every pair of tokens whose bytes joined are a token, which is what the rank files mean. ``ENCODE`` takes
a round for each merge of its longest match. Matches of over ``LONG`` bytes (a run of letters or signs without a break) are first
cut where two bytes meet that no token has side by side, since nothing ever merges there. Pieces that are still over ``LONG`` go
to ``ENCODE_LONG``, which contracts many pairs a round: every pair that is first among all pairs that start within the longest
token's length before it, or twice that length behind it. An earlier merge from farther off can reach a pair only through one
token that takes its first or its second token in: such a token ends less than one length behind the start of the second, which
itself lies less than one length behind the pair's, or starts less than one length before the pair's end. So the result is that
of one contraction after another. Equal pairs go together, every other one of a run from its start, if none of the run has to
wait and no pair with their token has a lower rank. The rounds hardly grow with the match; the query is started anew from its
last round where the rounds' rows would fill the memory.

Null and empty texts have no tokens. Repeated rows give a row each. Special tokens are ordinary text. Other columns are
ignored by ``encode`` and kept by ``tokenize``, whose own columns take other names (``tokens_0``) if theirs are in use.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField

from colloquy.llm.common import by_position, unused
from colloquy.llm.op4_toxicity import texts

REMEMBERED, AT_ONCE, LONG, ROWS = 700_000, 40_000, 160, 4_000_000
#: What a worker's database may hold; a piece of over 3 MB without any place to cut takes 120 times its size.
MEMORY = 384 << 20

ENCODE = """
WITH RECURSIVE state(w, p, tok, nxt, q, done) AS (
  SELECT w, p, tok, lead(tok) OVER o, lead(p) OVER o, false FROM tokens WINDOW o AS (PARTITION BY w ORDER BY p)
  UNION ALL (
    WITH paired AS MATERIALIZED (
      SELECT s.w, s.p, s.tok, s.q, CASE WHEN m.merged IS NOT NULL THEN (m.merged::BIGINT << 32) + s.p END AS pair
      FROM state s LEFT JOIN merges m ON s.tok = m.a AND s.nxt = m.b
      WHERE NOT s.done
    ), chosen AS (
      SELECT w, min(pair) AS best, arg_min(q, pair) AS gone FROM paired GROUP BY w
    ), contracted AS (
      SELECT w, p, CASE WHEN pair = best THEN (best >> 32)::INTEGER ELSE tok END AS tok, best
      FROM paired JOIN chosen USING (w) WHERE best IS NULL OR p <> gone
    )
    SELECT w, p, tok, lead(tok) OVER o, lead(p) OVER o, best IS NULL FROM contracted WINDOW o AS (PARTITION BY w ORDER BY p)
  )
)
SELECT w, list(tok ORDER BY p) AS ids FROM state WHERE done GROUP BY w
"""

#: rank: of the pair that starts at a position; low, before: the lowest one as near as it matters, and ahead of it.
ENCODE_LONG = """
WITH RECURSIVE state(w, p, tok, nxt, done, round) AS (
  SELECT w, p, tok, lead(tok) OVER o, false, 0 FROM tokens WINDOW o AS (PARTITION BY w ORDER BY p)
  UNION ALL (
    WITH paired AS (
      SELECT s.w, s.p, s.tok, s.round, m.merged AS rank, m.steady
      FROM state s LEFT JOIN merges m ON s.tok = m.a AND s.nxt = m.b
      WHERE NOT s.done AND s.round < $rounds
    ), near AS (
      SELECT *, row_number() OVER o AS i, lag(rank) OVER o IS DISTINCT FROM rank AS opens,
             min(rank) OVER (PARTITION BY w ORDER BY p RANGE BETWEEN $reach PRECEDING AND 2 * $reach FOLLOWING) AS low,
             min(rank) OVER (PARTITION BY w ORDER BY p RANGE BETWEEN $reach PRECEDING AND 1 PRECEDING) AS before
      FROM paired WINDOW o AS (PARTITION BY w ORDER BY p)
    ), placed AS (
      SELECT *, max(CASE WHEN opens THEN i END) OVER upto AS start, max(CASE WHEN rank > low THEN i END) OVER upto AS waits
      FROM near WINDOW upto AS (PARTITION BY w ORDER BY p ROWS UNBOUNDED PRECEDING)
    ), chosen AS (
      SELECT w, p, tok, round, rank, rank IS NOT NULL AND rank = low
             AND CASE WHEN steady THEN (i - start) % 2 = 0 AND coalesce(waits, 0) < start ELSE before IS NULL OR before > rank END AS goes
      FROM placed
    ), contracted AS (
      SELECT w, p, CASE WHEN goes THEN rank ELSE tok END AS tok, round, coalesce(lag(goes) OVER o, false) AS gone, bool_or(goes) OVER (PARTITION BY w) AS moved
      FROM chosen WINDOW o AS (PARTITION BY w ORDER BY p)
    )
    SELECT w, p, tok, lead(tok) OVER o, NOT moved, round + 1 FROM contracted WHERE NOT gone WINDOW o AS (PARTITION BY w ORDER BY p)
  )
)
SELECT w, done, list(p ORDER BY p) AS at, list(tok ORDER BY p) AS ids FROM state WHERE done OR round = $rounds GROUP BY w, done
"""

DECODE = """
SELECT r.w, unhex(string_agg(v.piece, '' ORDER BY r.p)) AS bytes FROM runs r JOIN vocabulary v ON r.tok = v.tok GROUP BY r.w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Tokenizer:
    """One worker's database, merge table and memory."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], rank) for t, rank in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        a, b, merged = (np.array(x, np.int32) for x in zip(*pairs))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY >> 20}MB"})
        # steady: no pair with the merged token has a lower rank than it
        least = np.full(merged.max(initial=0) + 1, np.iinfo(np.int32).max, np.int32)
        for side in (a, b):
            inner = side < len(least)
            np.minimum.at(least, side[inner], merged[inner])
        self._load("merges", {"a": a, "b": b, "merged": merged, "steady": least[merged] > merged})
        self.reach = max(map(len, self.ranks))
        # which bytes stand side by side in a token
        whole = np.frombuffer(b"".join(self.ranks), np.uint8)
        inner = np.ones(len(whole), bool)
        inner[np.cumsum(np.fromiter(map(len, self.ranks), np.int64, len(self.ranks))) - 1] = False
        self.meet = np.zeros((256, 256), bool)
        self.meet[whole[:-1][inner[:-1]], whole[1:][inner[:-1]]] = True
        self._load("vocabulary", {"tok": np.array(list(self.ranks.values()), np.int32), "piece": [t.hex() for t in self.ranks]})
        self.known: dict[str, bytes] = {}
        self.runs: dict[bytes, bytes] = {}

    def _load(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _query(self, sql: str, name: str, columns: dict, **values: int) -> pa.Table:
        self.db.register(name, pa.table(columns))
        try:
            return self.db.sql(sql, params=values or None).to_arrow_table()
        finally:
            self.db.unregister(name)

    def pieces(self, raw: bytes) -> list[bytes]:
        """A match cut where nothing merges."""
        data = np.frombuffer(raw, np.uint8)
        cuts = [0, *(np.flatnonzero(~self.meet[data[:-1], data[1:]]) + 1).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def _long(self, raw: bytes) -> bytes:
        at, ids = np.arange(len(raw), dtype=np.int32), self.single[np.frombuffer(raw, np.uint8)]
        self.db.execute(f"SET memory_limit = '{max(MEMORY, 120 * len(raw)) >> 20}MB'")
        done = False
        while not done:
            rounds = max(ROWS // len(ids), 2)
            (row,) = self._query(ENCODE_LONG, "tokens", {"w": np.zeros(len(ids), np.int32), "p": at, "tok": ids}, rounds=rounds, reach=self.reach).to_pylist()
            done, at, ids = row["done"], np.array(row["at"], np.int32), np.array(row["ids"], np.int32)
        self.db.execute(f"SET memory_limit = '{MEMORY >> 20}MB'")
        return ids.astype("<u4").tobytes()

    def _learn_long(self, match: str, raw: bytes) -> None:
        self.known[match] = self._long(raw)

    def _short(self, raws: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each with its ids, AT_ONCE in one query."""
        raws = sorted(raws, key=len)  # those of like length end in like rounds
        for at in range(0, len(raws), AT_ONCE):
            part = raws[at : at + AT_ONCE]
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            data = np.frombuffer(b"".join(part), np.uint8)
            starts = np.cumsum(lengths) - lengths
            w = np.repeat(np.arange(len(part), dtype=np.int32), lengths)
            found = self._query(ENCODE, "tokens", {"w": w, "p": (np.arange(len(data)) - starts[w]).astype(np.int32), "tok": self.single[data]})
            ids = found["ids"].combine_chunks()
            flat, ends = ids.flatten().to_numpy().astype("<u4"), np.cumsum(ids.value_lengths().to_numpy())
            for k, a, b in zip(found["w"].to_pylist(), np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
                yield part[k], flat[a:b].tobytes()

    def learn(self, matches: list[str]) -> None:
        """Put the ids of new matches into memory."""
        cut = {m: self.pieces(raw) if len(raw) > LONG else [raw] for m, raw in ((m, m.encode()) for m in matches)}
        own = {raw for raws in cut.values() for raw in raws}
        ids = dict(self._short([raw for raw in own if len(raw) <= LONG]))
        ids |= {raw: self._long(raw) for raw in own if len(raw) > LONG}
        for m, raws in cut.items():
            self.known[m] = b"".join(map(ids.__getitem__, raws))

    def read(self, runs: list[bytes]) -> None:
        """Put the bytes of new runs of ids into memory."""
        for at in range(0, len(runs), AT_ONCE):
            part = runs[at : at + AT_ONCE]
            lengths = np.fromiter((len(r) // 4 for r in part), np.int64, len(part))
            w = np.repeat(np.arange(len(part), dtype=np.int32), lengths)
            p = (np.arange(len(w)) - (np.cumsum(lengths) - lengths)[w]).astype(np.int32)
            found = self._query(DECODE, "runs", {"w": w, "p": p, "tok": np.frombuffer(b"".join(part), "<u4").astype(np.int32)})
            for k, raw in zip(found["w"].to_pylist(), found["bytes"].to_pylist()):
                self.runs[part[k]] = raw

    def encode(self, own: list[str]) -> Iterator[list[bytes]]:
        """The ids of each text, as a run of little-endian 32-bit ids for each match."""
        split = [self.pattern.findall(t) for t in own]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = set().union(*split).difference(self.known)
        if new:
            self.learn(sorted(new))
        get = self.known.__getitem__
        return [list(map(get, matches)) for matches in split]

    def decode(self, encoded: list[list[bytes]]) -> list[bytes]:
        if len(self.runs) > REMEMBERED:
            self.runs.clear()
        new = set().union(*encoded).difference(self.runs)
        if new:
            self.read(sorted(new))
        get = self.runs.__getitem__
        return [b"".join(map(get, runs)) for runs in encoded]


_made: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One for each worker process: its merge table and memory serve all partitions that the worker gets."""
    if (path, pattern) not in _made:
        _made[path, pattern] = Tokenizer(path, pattern)
    return _made[path, pattern]


def blocks(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[list[str]]:
    """The texts in lists of about ``size`` characters, so that the memory of a step is bounded."""
    part, chars = [], 0
    for raw in texts(batch, column):
        part.append(raw.decode())
        chars += len(raw)
        if chars >= size:
            yield part
            part, chars = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encoded, then decoded from its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path, pattern)
        for batch in batches:
            counts, ids_digest, text_digest = [], [], []
            for part in blocks(batch, 1):
                encoded = coder.encode(part)
                for runs, decoded in zip(encoded, coder.decode(encoded)):
                    ids = b"".join(runs)
                    counts.append(len(ids) // 4)
                    ids_digest.append(hashlib.sha256(ids).hexdigest())
                    text_digest.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenize(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The documents' columns but the text, with ``n_tokens``, ``tokens`` (the ids) and ``restored``: they decode to the text.

    Where ``docs`` has a column of such a name, that one stays and the new one is named anew: ``tokens_0``.
    """
    at = docs.columns.index("text")
    kept = [f for f in docs.schema if f.name != "text"]
    names = [f.name for f in kept]
    made = unused(names, "n_tokens", "tokens", "restored")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path, pattern)
        for batch in batches:
            own, same = [], []
            for part in blocks(batch, at):
                encoded = coder.encode(part)
                same += [raw == t.encode() for raw, t in zip(coder.decode(encoded), part)]
                own += [np.frombuffer(b"".join(runs), "<u4").astype(np.int32) for runs in encoded]
            counts = np.array([len(x) for x in own], np.int64)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own) if own else np.zeros(0, np.int32)))
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(counts), lists, pa.array(same, pa.bool_())], [str(k) for k in range(len(rest) + 3)])

    types = (LongType(), ArrayType(IntegerType()), BooleanType())
    return by_position(docs, run, [*kept, *(StructField(name, t) for name, t in zip(made, types))])


def detokenize(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ``text``, the text that each row's ``tokens`` stand for; null tokens give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path, pattern)
        for batch in batches:
            rows = [np.array(ids or [], "<u4") for ids in batch.column(1).to_pylist()]
            runs = [[x[i : i + 64].tobytes() for i in range(0, len(x), 64)] for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw.decode("utf-8", "replace") for raw in coder.decode(runs)], pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), "tokens").mapInArrow(run, "doc_id long, text string")

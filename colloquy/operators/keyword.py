"""Keyword retrieval: a weighted inverted index, exact hits before near ones, and suggestions.

The index is a long table (shard, term, segment_id, weight, and what filters and order need), stored by range of shard and term. A
query has a handful of terms, so they enter as literals: exact lookup is a pushed-down IN filter, not a join. Near words come
from one scan of each shard's vocabulary and join the same filter. Scores are summed by segment with a partial sum
before the shuffle; type, episode and start stand in the postings, so nothing but the texts is joined, to at most a few hundred rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from colloquy.functions.text import close_words, index_words, normalize_index
from colloquy.operators import counts, spelling
from colloquy.operators.order import numbered

QUESTION, ANSWER, EXACT = 4, 1, 10
CANDIDATES, RESULTS, DICTIONARY, SUGGESTIONS = 240, 200, 12_000, 8
#: Letters of the longest stored prefix, and near words that enter a query as literals; more are joined.
PREFIX, LITERALS = 4, 1000
#: Segments of a block (32,768 is a multiple), and blocks that are scored before any is left out.
BLOCK, FIRST_BLOCKS = 128, 32
#: What the postings keep of a segment, so that filters and order need no join.
META = ("episode_id", "type", "start_sec")


def terms_of(segments: DataFrame, *keep: str) -> DataFrame:
    """One row a word: shard, term, boost (question words count four times)."""
    both = F.concat(F.transform(index_words(F.col("question")), lambda w: F.struct(w.alias("term"), F.lit(QUESTION).alias("boost"))), F.transform(index_words(F.col("answer")), lambda w: F.struct(w.alias("term"), F.lit(ANSWER).alias("boost"))))
    return segments.select("shard", *keep, F.explode(both).alias("w")).select("shard", *keep, "w.term", "w.boost")


def postings(segments: DataFrame) -> DataFrame:
    """shard, term, segment_id, weight, freq (the unweighted count) and META.

    Segments are dealt out by id before they are cut into words, so texts are shuffled and postings are not.
    """
    keys = ["segment_id", "shard", *META]
    return _counted(counts.by_key(segments.select(*keys, "question", "answer"), *keys), keys)


def _counted(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Postings of texts whose rows of equal ``keys`` stand side by side; words are counted in each batch."""
    fields = {f.name: f for f in texts.schema}
    rest = [k for k in keys if k not in ("shard", "segment_id")]
    out = StructType([fields["shard"], StructField("term", StringType()), fields["segment_id"], *(fields[k] for k in rest), StructField("weight", LongType()), StructField("freq", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, runs in counts.whole(batches, keys):
            words, of, word, n = counts.per_run([counts.split(rows["_question"]), counts.split(rows["_answer"])], runs, 2)
            own = rows.select(keys).take(pa.array(runs.searchsorted(range(int(runs[-1]) + 1))))
            for at in range(0, len(of), counts.OUT):
                cut = slice(at, at + counts.OUT)
                made = {k: c.combine_chunks() for k, c in zip(keys, own.take(pa.array(of[cut])).columns)}
                made |= {"term": words.take(pa.array(word[cut])), "weight": pa.array(n[cut, 0] * QUESTION + n[cut, 1] * ANSWER), "freq": pa.array(n[cut].sum(axis=1))}
                yield pa.RecordBatch.from_arrays([made[f.name] for f in out], [f.name for f in out])

    return counts.batched(texts.select(*keys, normalize_index(F.col("question")).alias("_question"), normalize_index(F.col("answer")).alias("_answer")), run, out)


def ranked_terms(index: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """shard, term, freq, rk: the most frequent terms of each shard of an index, with their rank from 1.

    Terms are numbered over ranges of (shard, freq, term), so no task ranks a whole shard.
    """
    counts = index.groupBy("shard", "term").agg(F.sum("freq").alias("freq"))
    placed = numbered(counts, "shard", F.desc("freq"), "term", name="at")
    before = placed.groupBy(F.col("shard").alias("of")).agg((F.min("at") - 1).alias("before"))
    return placed.join(before, F.col("shard").eqNullSafe(F.col("of"))).withColumn("rk", F.col("at") - F.col("before")).where(F.col("rk") <= size).select("shard", "term", "freq", "rk")


def dictionary(segments: DataFrame, size: int = DICTIONARY) -> DataFrame:
    """``ranked_terms`` of segments."""
    return ranked_terms(terms_of(segments).groupBy("shard", "term").agg(F.count("*").alias("freq")), size)


def prefix_blocks(words: DataFrame, n: int = SUGGESTIONS) -> DataFrame:
    """shard, prefix, term, rk: of each prefix of up to PREFIX letters the n best terms of each shard's dictionary.

    A shard's n best are enough for the n best of several shards: what a term of a newer shard repeats is one of these, too.
    """
    lengths = F.sequence(F.lit(1), F.least(F.lit(PREFIX), F.length("term")))
    rows = words.select("shard", "term", "rk", F.explode(F.transform(lengths, lambda k: F.substring("term", F.lit(1), k))).alias("prefix"))
    best = Window.partitionBy("shard", "prefix").orderBy("rk")
    return rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n).select("shard", "prefix", "term", "rk")


def _rows(index: DataFrame, rows: list[tuple], *names: str) -> DataFrame:
    """A handful of literal rows, made without a Python worker."""
    return index.sparkSession.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows))))


def near_words(index: DataFrame, lacking: list[tuple[str, str, int]], spellings: DataFrame | Callable[[], DataFrame] | None = None) -> DataFrame:
    """shard, word, n: the shards' words near the terms that they lack (shard, term, how often it was asked).

    ``spellings``: the stored vocabulary (shard, word), or a function that reads it once it is needed, or None. A query lacks a
    handful of terms, so each word is compared with them where it is read; deletion keys pay where many terms are asked at once.
    """
    shards = sorted({s for s, _, _ in lacking})
    words = index.select("shard", F.col("term").alias("word")) if spellings is None else spellings() if callable(spellings) else spellings
    words = words.where(F.col("shard").isin(shards))
    words = words.distinct() if spellings is None else words.select("shard", "word")
    asked = F.array(*(F.struct(F.lit(s).alias("of"), F.lit(t).alias("term"), F.lit(n).cast("long").alias("n")) for s, t, n in lacking))
    close = F.filter(asked, lambda a: (a["of"] == F.col("shard")) & close_words(a["term"], F.col("word")))
    met = words.withColumn("n", F.aggregate(close, F.lit(0).cast("long"), lambda total, a: total + a["n"]))
    return met.where("n > 0").select("shard", "word", "n")


def weights_of(index: DataFrame, terms: list[str], shards: list[str], spellings: DataFrame | Callable[[], DataFrame] | None = None) -> tuple[Column, Column] | DataFrame | None:
    """What a posting of (shard, term) counts for a query, times its weight, and which postings count; None: none do.

    Exact hits weigh EXACT times; where a shard lacks a term, its near words count once. Whether a shard has a term is a question
    to its whole vocabulary, so type and episode filters come after this. The answer, at most one row a term and shard, is fetched
    first. Up to LITERALS near words enter as literals; with more, (shard, term, factor) is a table to join.
    """
    counts = Counter(terms)
    if not counts or not shards:
        return None
    times = F.create_map(*(F.lit(x) for pair in counts.items() for x in pair))
    inside, asked = F.col("shard").isin(shards), F.col("term").isin(list(counts))
    own = index.where(inside & asked).select("shard", "term").distinct().collect()
    found = {(r.shard, r.term) for r in own}
    exact = times[F.col("term")] * EXACT, inside & asked
    lacking = [(s, t, n) for t, n in counts.items() if len(t) >= spelling.SHORT for s in shards if (s, t) not in found]
    near = near_words(index, lacking, spellings) if lacking else None
    words = near.limit(LITERALS + 1).collect() if lacking else []
    if not words:
        return exact if found else None
    if len(words) > LITERALS:
        hits = _rows(index, [(s, t, counts[t] * EXACT) for s, t in found], "shard", "term", "factor") if found else None
        more = near.select("shard", F.col("word").alias("term"), F.col("n").alias("factor"))
        return more if hits is None else more.unionByName(hits).groupBy("shard", "term").agg(F.sum("factor").alias("factor"))
    pair = F.concat_ws("\0", "shard", "term")
    of_pair = {f"{r.shard}\0{r.word}": r.n for r in words}
    factor = F.create_map(*(F.lit(x) for item in of_pair.items() for x in item))[pair]
    seek = inside & (asked | F.col("term").isin(sorted({r.word for r in words})) & pair.isin(list(of_pair)))
    return F.coalesce(F.when(asked, times[F.col("term")] * EXACT), F.lit(0)) + F.coalesce(factor, F.lit(0)), seek


def weighed(index: DataFrame, by: tuple[Column, Column] | DataFrame | None) -> DataFrame:
    """The rows of an index that count, with their ``factor``."""
    if by is None:
        return index.withColumn("factor", F.lit(0)).where(F.lit(False))
    if isinstance(by, DataFrame):
        return index.join(by, ["shard", "term"])
    factor, seek = by
    return index.where(seek).withColumn("factor", factor)


def contributions(index: DataFrame, terms: list[str], shards: list[str], spellings: DataFrame | Callable[[], DataFrame] | None = None) -> DataFrame:
    """The postings that count for the terms, with ``contrib``, what they add to their segment's score."""
    return weighed(index, weights_of(index, terms, shards, spellings)).withColumn("contrib", F.col("factor") * F.col("weight"))


def filters(kind: str = "all", episode: str = "", shards: list[str] | None = None) -> Column:
    keep = F.lit(True)
    if shards:
        keep &= F.col("shard").isin(shards)
    if kind != "all":
        keep &= F.col("type") == kind
    if episode:
        keep &= F.col("episode_id") == episode
    return keep


def best(scored: DataFrame, n: int) -> DataFrame:
    """Top n: score, then later start (null is 0), then segment."""
    return scored.orderBy(F.desc("score"), F.desc(F.coalesce("start_sec", F.lit(0))), "segment_id").limit(n)


def rank(index: DataFrame, segments: DataFrame, terms: list[str], kind: str = "all", episode: str = "", shards: list[str] | None = None, n: int = CANDIDATES, spellings: DataFrame | Callable[[], DataFrame] | None = None) -> DataFrame:
    """The n best segments without their texts. No terms: every segment, scored 0 (browsing)."""
    keep = filters(kind, episode, shards)
    if not terms:
        return best(segments.where(keep).select("segment_id", "shard", *META).withColumn("score", F.lit(0).cast("long")), n)
    known = shards or sorted(r.shard for r in segments.select("shard").distinct().collect() if r.shard is not None)
    hits = contributions(index, terms, known, spellings).where(keep)
    return best(hits.groupBy("segment_id", "shard", *META).agg(F.sum("contrib").alias("score")), n)


def placed(segments: DataFrame, size: int = BLOCK) -> DataFrame:
    """The postings of segments with ``place`` and ``block``: segments numbered from 0, in each shard the longest first, ``size`` of them a block.

    Long segments have the largest weights, so few blocks hold the best segments of most queries. Segments are placed and ranged by
    place before they are cut into words: no posting is shuffled, and each partition's postings are sorted by (shard, block, term).
    """
    words = F.coalesce(F.size(index_words(F.col("question"))), F.lit(0)) + F.coalesce(F.size(index_words(F.col("answer"))), F.lit(0))
    lengths = segments.select("shard", "segment_id", words.alias("_n")).groupBy("shard", "segment_id").agg(F.sum("_n").alias("words")).where("words > 0")
    places = numbered(lengths, "shard", F.desc("words"), "segment_id", start=0, name="place").select(F.col("shard").alias("_shard"), F.col("segment_id").alias("_of"), "place")
    met = segments.join(places, (F.col("segment_id") == F.col("_of")) & F.col("shard").eqNullSafe(F.col("_shard")))
    keys = ["segment_id", "shard", *META, "place"]
    ranged = met.select(*keys, "question", "answer").repartitionByRange("shard", "place").sortWithinPartitions("shard", "place", *META)
    return _counted(ranged, keys).withColumn("block", F.floor(F.col("place") / size)).sortWithinPartitions("shard", "block", "term", "segment_id")


def block_tops(index: DataFrame) -> DataFrame:
    """shard, term, block, top: the largest weight that a term has in a block of a ``placed`` index."""
    return index.groupBy("shard", "term", "block").agg(F.max("weight").alias("top"))


def facet_bitmaps(index: DataFrame, *facets: str) -> DataFrame:
    """facet, value, bucket, bits: for each value of a facet the places of its segments, 32,768 of them a bitmap."""
    rows = index.select("place", *facets).distinct().select("place", F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets))).alias("f")).select("f.facet", "f.value", (F.col("place") + 1).alias("at"))
    return rows.groupBy("facet", "value", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))


def allowed(bitmaps: DataFrame, chosen: dict[str, str]) -> DataFrame:
    """bucket, bits: the places that have all of the chosen values."""
    keep = F.lit(False)
    for facet, value in chosen.items():
        keep |= (F.col("facet") == facet) & (F.col("value") == value)
    both = bitmaps.where(keep).groupBy("bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits"))
    return both.where((F.col("n") == len(chosen)) & (F.bitmap_count("bits") > 0)).select("bucket", "bits")


def _bit(bits: Column, place: Column) -> Column:
    """Whether a bitmap has a place (from 0)."""
    at = F.bitmap_bit_position(place + 1)
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), F.pmod(at, F.lit(8))).cast("int")) > 0


def rank_blocks(index: DataFrame, tops: DataFrame, terms: list[str], shards: list[str], chosen: dict[str, str] | None = None, bitmaps: DataFrame | None = None, n: int = CANDIDATES, spellings: DataFrame | Callable[[], DataFrame] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """``rank`` over a ``placed`` index that leaves blocks unread whose segments cannot be among the n best; and how many it read.

    No segment of a block scores more than its terms' factors times their largest weights there. The FIRST_BLOCKS blocks of the
    highest such bounds are scored first; their n-th score is one that all others must reach, so of the other blocks only
    those are read whose bound does. ``chosen`` values of facets are and-ed as bitmaps before anything is scored; blocks without
    a place left are not read, and of others only the places that are left.
    """
    by = weights_of(index, terms, shards, spellings)
    bound = weighed(tops, by).groupBy("block").agg(F.sum(F.col("factor") * F.col("top")).alias("bound"))
    left = allowed(bitmaps, chosen) if chosen else None
    if left is not None:
        # blocks of the buckets that have a place left: a bucket is as long as many blocks
        each = 32_768 // BLOCK
        block = F.explode(F.sequence((F.col("bucket") - 1) * each, F.col("bucket") * each - 1))
        open_ = left.select(block.alias("block"), "bits").where(F.expr(f"hex(substring(bits, cast(block % {each} * {BLOCK // 8} + 1 as int), {BLOCK // 8})) != repeat('0', {BLOCK // 4})"))
        bound = bound.join(open_.select("block"), "block")
    bound = bound.persist()
    first = bound.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS).collect()
    seen = [r.block for r in first]

    def scored(keep: DataFrame | list[int]) -> DataFrame:
        rows = index.where(F.col("block").isin(keep)) if isinstance(keep, list) else index.join(keep, "block", "left_semi")
        rows = weighed(rows, by)
        if left is not None:
            rows = rows.join(left, F.bitmap_bucket_number(F.col("place") + 1) == F.col("bucket")).where(_bit(F.col("bits"), F.col("place")))
        return rows.groupBy("segment_id", "shard", *META).agg(F.sum(F.col("factor") * F.col("weight")).alias("score"))

    found = best(scored(seen), n).collect()
    least = found[-1].score if len(found) == n else 0
    others = bound.where(~F.col("block").isin(seen)).where(F.col("bound") >= least) if len(first) == FIRST_BLOCKS else bound.where(F.lit(False))
    rest = others.select("block").limit(LITERALS + 1).collect()
    read = {"blocks": bound.count(), "read": len(seen) + (len(rest) if len(rest) <= LITERALS else others.count())}
    out = scored(seen)
    if rest:
        out = out.unionByName(scored([r.block for r in rest] if len(rest) <= LITERALS else others.select("block")))
    bound.unpersist()
    return best(out, n), read


def suggest(words: DataFrame, prefix: str, n: int = SUGGESTIONS) -> DataFrame:
    """term, position: words with the prefix, newest shard (by name, descending) first, then by rank; each once.

    ``words`` is a dictionary, or ``prefix_blocks`` for a prefix of up to PREFIX letters.
    """
    if not prefix:
        return words.select("term", F.lit(0).cast("long").alias("position")).where(F.lit(False))
    asked = F.col("prefix") == prefix if "prefix" in words.columns else F.col("term").startswith(prefix)
    # the first shard that has the term decides its place
    first = words.where(asked).groupBy("term").agg(F.max(F.struct("shard", -F.col("rk"))).alias("place"))
    top = first.orderBy(F.desc("place"), "term").limit(n)
    order = Window.orderBy(F.desc("place"), "term")  # over at most n rows
    return top.select("term", F.row_number().over(order).cast("long").alias("position"))


def bm25(index: DataFrame, segments: DataFrame, terms: list[str], n: int = CANDIDATES, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """An opt-in ranking: saturated weights, inverse document frequency and length. ``rank`` does not use it.

    Lengths are sums of weights; both statistics are aggregates over the index, and only two numbers reach the driver.
    """
    size = index.groupBy("segment_id").agg(F.sum("weight").alias("size"))
    whole = size.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).head()
    if not whole.n:
        return best(segments.withColumn("score", F.lit(0.0)).where(F.lit(False)), n)
    own = index.where(F.col("term").isin(terms))
    rarity = own.groupBy("term").agg(F.count("*").alias("df")).select("term", F.log(1 + (whole.n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("weight") * (k1 + 1) / (F.col("weight") + k1 * (1 - b + b * F.col("size") / whole.mean))
    # a handful of terms
    scores = own.join(F.broadcast(rarity), "term").join(size, "segment_id").groupBy("segment_id").agg(F.sum(part).alias("score"))
    return best(segments.join(scores, "segment_id"), n)

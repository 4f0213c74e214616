"""Index artifacts as partitioned Parquet, and their manifest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.vectors import dequantize, quantize
from colloquy.operators import order, semantic
from colloquy.sources import episodes as source
from colloquy.sources import index

MODEL, VERSION = "corpus-lsa-ppmi-svd", 3


def runs(text: str) -> Column:
    """Letter or digit runs and what stands between them."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))


def text_dictionary(rows: DataFrame, text: str, length: int = 3, more_than: int = 2) -> DataFrame:
    """run, n of the runs worth a dictionary entry. Parquet pages encode them so by themselves; this is the analytic form."""
    return rows.select(F.explode(runs(text)).alias("run")).where(F.length("run") >= length).groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def word_table(words: DataFrame) -> DataFrame:
    """The query-time form: bytes, and idf to three places."""
    return words.select("term", F.round("idf", 3).alias("idf"), quantize(F.col("vec")).alias("q"))


def query_words(stored: DataFrame) -> DataFrame:
    return stored.select("term", "idf", dequantize(F.col("q")).alias("vec"))


CACHE = "passage string, text_hash string, model string, q array<tinyint>"


def model_of(stored: DataFrame) -> str:
    """A digest of a word table in its query-time form, whatever the order of its rows."""
    got = stored.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("term", "idf", "q")), F.lit(0)).alias("x")).head()
    return f"{MODEL}-{got.n}-{got.x & 0xFFFFFFFFFFFFFFFF:016x}"


#: What a passage's row has of its segment.
META = ("segment_id", "episode_id", "type", "start_sec")


def _keyed(segments: DataFrame) -> DataFrame:
    """The passages of whole texts, with ``passage`` as their key."""
    return semantic.passages(segments, "shard", "episode_id", "type", chunks=None).withColumn("passage", F.concat_ws("/", "segment_id", "idx"))


def _hashed(segments: DataFrame) -> DataFrame:
    return _keyed(segments).select("passage", "text", F.sha2("text", 256).alias("text_hash"))


def _pooled(passages: DataFrame, words: DataFrame, *keep: str) -> DataFrame:
    """passage, keep, q of the passages that have a known word."""
    tokens = semantic.token_rows(passages, "passage", F.col("text"), *keep)
    return semantic.pool(tokens, "passage", words, *keep).select("passage", *keep, quantize(F.col("vec")).alias("q"))


def uncached(passages: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """The passages whose text the cache has no row of, by this model."""
    return passages.join(cache.where(F.col("model") == model).select("passage", "text_hash"), ["passage", "text_hash"], "left_anti")


def cached_vectors(segments: DataFrame, stored: DataFrame, path: str) -> tuple[DataFrame, int]:
    """passage, q of the segments' passages, and how many had to be pooled: those that the cache below ``path`` lacks, which it then has.

    A row is kept for each passage, text and model (of the ``word_table``), with a null vector where no word is known, so a
    second build pools nothing and a changed text or word table pools again what it changes.
    """
    spark, model = segments.sparkSession, model_of(stored)
    read = lambda: spark.read.schema(CACHE).parquet(path)
    try:
        cache = read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        spark.createDataFrame([], CACHE).write.parquet(path)
        cache = read()
    passages = _hashed(segments)
    todo = order.stored(uncached(passages, cache, model).select("passage", "text_hash", "text"))
    made = todo.join(_pooled(todo, stored), "passage", "left").select("passage", "text_hash", F.lit(model).alias("model"), "q")
    fresh = todo.count()
    if fresh:
        order.stored(made).write.mode("append").parquet(path)
        cache = read()
    own = cache.where(F.col("model") == model).groupBy("passage", "text_hash").agg(F.first("q", ignorenulls=True).alias("q"))
    return passages.select("passage", "text_hash").join(own, ["passage", "text_hash"]).where("q is not null").select("passage", "q"), fresh


def passage_vectors(segments: DataFrame, words: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """One row a passage with a known word: shard, segment, offset and byte vector; ``words``: in bytes (``word_table``) or as ``query_words``;
    ``vectors``: from ``cached_vectors``."""
    keyed = _keyed(segments)
    rest = ("shard", *META, "char_offset")
    if vectors is None:
        return _pooled(keyed, words, *rest).select(*rest, "q")
    return keyed.select("passage", *rest).join(vectors, "passage").select(*rest, "q")


#: Shard tables, and what the digest of each covers.
SHARDS = {
    "keyword": ("shard", "term", "segment_id", "weight"),
    "autocomplete": ("shard", "term", "freq", "rk"),
    "prefixes": ("shard", "prefix", "term", "rk"),
    "spellings": ("shard", "word"),
    "docs": ("shard", "segment_id", "episode_id", "type", "question", "answer"),
    "vectors": ("shard", "segment_id", "char_offset", "q"),
}
MANIFEST = "kind string, shard string, rows long, digest string, files long, bytes long"
SUMMARY = "build_id string, model string, version int, dimensions int, shards array<string>, types array<string>, episodes long, segments long"


def write(segments: DataFrame, words: DataFrame, path: str, headers: DataFrame | None = None, cache: str | None = None) -> None:
    """Write the tables of a search engine below ``path``, replacing what is there.

    ``words`` (term, idf, vec) is the word table, trained or given; ``headers`` the episodes, if there are any; ``cache`` a folder of
    ``cached_vectors``. Shard tables are
    partitioned by shard and clustered for their reads; ``index.Store`` names those of keyword search.
    """
    word_table(words).write.mode("overwrite").parquet(f"{path}/vocab")
    stored = segments.sparkSession.read.parquet(f"{path}/vocab")  # passages take the table that queries will see
    index.by_range(segments, "shard", "segment_id").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/docs")
    vectors = cached_vectors(segments, stored, cache)[0] if cache else None
    passage_vectors(segments, stored, vectors).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/vectors")
    tables = index.Store(lambda: segments, path)
    for name in ("keyword", "autocomplete", "prefixes", "spellings"):
        tables.read(name)
    if headers is not None:
        headers.write.mode("overwrite").parquet(f"{path}/episodes")


def build(spark: SparkSession, episodes: DataFrame, path: str, dimensions: int = semantic.DIMENSIONS, least: int = semantic.LEAST, margin: int = semantic.MARGIN) -> DataFrame:
    """Train the word table, ``write`` all artifacts of the episodes, and the manifest and its summary; returns the manifest."""
    segments = source.segments(episodes)
    docs = segments.withColumn("text", F.concat_ws(" ", "question", "answer"))
    words = semantic.train(docs, "segment_id", F.col("text"), dimensions, least, margin)
    write(segments, words, path, source.headers(episodes))
    found = manifest(spark, path)
    found.write.mode("overwrite").json(f"{path}/manifest")
    # an order-free digest: no task holds all hashes
    mixed = (F.bit_xor(F.xxhash64("content_hash", F.lit(k))).cast("string") for k in range(2))
    build_id = episodes.agg(F.substring(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *mixed), 256), 1, 16)).head()[0]
    summary(spark, path, build_id).write.mode("overwrite").json(f"{path}/summary")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest that ``build`` wrote: of each kind and shard the rows, their digest, files and bytes."""
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY).json(f"{path}/summary")


def row_digest(*columns: str) -> Column:
    """A number of 60 bits from a row's values as text, split by a sign that texts do not use."""
    value = lambda c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ",") if c == "q" else F.col(c).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.array_join(F.array(*map(value, columns)), "\x1f")), 1, 15), 16, 10).cast("decimal(20,0)")


def digests(rows: DataFrame, *columns: str) -> DataFrame:
    """shard, rows, digest: a digest of each shard's rows that their order does not change."""
    whole = F.sum(row_digest(*columns)) % F.lit(1 << 60).cast("decimal(20,0)")
    return rows.groupBy(F.col("shard").cast("string").alias("shard")).agg(F.count("*").alias("rows"), F.lpad(F.lower(F.hex(whole.cast("long"))), 15, "0").alias("digest"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """kind, shard, rows, digest, files, bytes of each shard table below ``path``; bytes are those of the compressed files."""
    out = None
    for kind, columns in SHARDS.items():
        rows = spark.read.parquet(f"{path}/{kind}")
        files = rows.select(F.col("shard").cast("string").alias("of"), "_metadata.file_path", "_metadata.file_size").distinct()
        sizes = files.groupBy("of").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
        own = digests(rows, *columns).join(sizes, F.col("shard").eqNullSafe(F.col("of"))).select(F.lit(kind).alias("kind"), "shard", "rows", "digest", "files", "bytes")
        out = own if out is None else out.unionByName(own)
    return out.orderBy("kind", "shard")


def summary(spark: SparkSession, path: str, build_id: str) -> DataFrame:
    """One row on a build: ids, the vectors' dimension, and what its facets can be."""
    docs = spark.read.parquet(f"{path}/docs")
    of_docs = docs.agg(F.array_sort(F.collect_set(F.col("shard").cast("string"))).alias("shards"), F.array_sort(F.collect_set("type")).alias("types"), F.countDistinct("episode_id").alias("episodes"), F.count("*").alias("segments"))
    dimensions = spark.read.parquet(f"{path}/vocab").select(F.size("q").alias("n")).head()
    return of_docs.select(F.lit(build_id).alias("build_id"), F.lit(MODEL).alias("model"), F.lit(VERSION).alias("version"), F.lit(dimensions.n if dimensions else 0).alias("dimensions"), "shards", "types", "episodes", "segments")


def encoded(rows: DataFrame, key: str, text: str, dictionary: DataFrame) -> DataFrame:
    """key, parts: each text's runs in order, as a dictionary id where the run has one (run, id), else as they are."""
    cut = rows.select(key, F.posexplode(runs(text)).alias("pos", "run"))
    known = cut.join(dictionary.select("run", "id"), "run", "left")
    return known.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", F.when(F.col("id").isNull(), F.col("run")).alias("raw")))), lambda x: F.struct(x["id"].alias("id"), x["raw"].alias("raw"))).alias("parts"))


def decoded(rows: DataFrame, key: str, dictionary: DataFrame) -> DataFrame:
    """key, text of ``encoded`` rows."""
    cut = rows.select(key, F.posexplode("parts").alias("pos", "p")).select(key, "pos", "p.id", "p.raw")
    back = cut.join(dictionary.select("id", "run"), "id", "left")
    return back.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("run", "raw").alias("t")))), lambda x: x["t"]), "").alias("text"))


def shard_stats(segments: DataFrame, shard: str = "shard") -> DataFrame:
    """shard, segments, characters and the longest segment."""
    size = F.length("question") + F.length("answer")
    return segments.groupBy(shard).agg(F.count("*").alias("segments"), F.sum(size).cast("long").alias("chars"), F.max(size).cast("long").alias("longest"))

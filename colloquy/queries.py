"""The catalogue of registered queries over the driver tables, each with the same query as SQL where SQL expresses it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colloquy.functions import ranges, text, vectors
from colloquy.operators import align, cells, facets, fusion, ingest, keyword, order, present, segment, semantic, session, spelling, timeline, validate
from colloquy.plans import query_state
from colloquy.plans.engine import Engine
from colloquy.sources import artifacts, captions, index, pages
from colloquy.sources.corpus import segments, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


SEG = """seg AS (
  SELECT doc_id AS segment_id, source AS episode_id, lang AS shard, doc_id % 3600 AS start_sec,
         CASE doc_id % 4 WHEN 0 THEN 'intro' WHEN 1 THEN 'answer' ELSE 'question' END AS type,
         CASE WHEN strpos(t, chr(10)) > 0 THEN substr(t, 1, strpos(t, chr(10)) - 1) ELSE t END AS question,
         CASE WHEN strpos(t, chr(10)) > 0 THEN substr(t, strpos(t, chr(10)) + 1) ELSE '' END AS answer
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)
)"""
NORM = "trim(regexp_replace(strip_accents(lower({})), '[^a-z0-9]+', ' ', 'g'))"
WORDS = "list_filter(string_split(" + NORM + ", ' '), lambda w: length(w) > 1)"
PLAIN = "regexp_replace(strip_accents(lower({})), '[^a-z0-9]', ' ', 'g')"
POSTINGS = f"""{SEG}, words AS (
  SELECT shard, segment_id, unnest({WORDS.format('question')}) AS term, 4 AS boost FROM seg
  UNION ALL SELECT shard, segment_id, unnest({WORDS.format('answer')}) AS term, 1 AS boost FROM seg
), postings AS (SELECT shard, term, segment_id, CAST(sum(boost) AS BIGINT) AS weight FROM words GROUP BY ALL)"""


def _keyword_sql(terms: list[str], where: str = "true", shards: str = "true", select: str = "segment_id, shard, score") -> str:
    asked = ", ".join(f"('{t}')" for t in terms)
    return f"""WITH {POSTINGS}, asked AS (SELECT t, CAST(count(*) AS BIGINT) AS times FROM (VALUES {asked}) v(t) GROUP BY t),
own AS (SELECT * FROM postings WHERE {shards}), vocab AS (SELECT DISTINCT shard, term FROM own),
missing AS (SELECT s.shard, t, times FROM (SELECT DISTINCT shard FROM own) s, asked a WHERE NOT EXISTS (SELECT 1 FROM vocab v WHERE v.shard = s.shard AND v.term = a.t)),
near AS (SELECT v.shard, v.term, times FROM vocab v JOIN missing m ON v.shard = m.shard AND length(t) > 3 AND length(v.term) <= length(t) + 2
         AND levenshtein(t, v.term) <= CASE WHEN length(t) > 7 THEN 2 ELSE 1 END),
hits AS (SELECT shard, segment_id, times * 10 * weight AS c FROM own JOIN asked ON term = t
         UNION ALL SELECT shard, segment_id, times * weight FROM own JOIN near USING (shard, term)),
scored AS (SELECT shard, segment_id, CAST(sum(c) AS BIGINT) AS score FROM hits GROUP BY ALL)
SELECT {select} FROM scored JOIN seg USING (shard, segment_id) WHERE {where}
ORDER BY score DESC, start_sec DESC, segment_id LIMIT 240"""


_stores: dict[tuple[str, str], index.Store] = {}


def _store(spark: SparkSession, sf_dir: str) -> index.Store:
    """The index as an engine stores it: in the shared folder, once an application and state of the documents' files."""
    state = index.files_state(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    key = spark.sparkContext.applicationId, state
    if key not in _stores:
        _stores[key] = index.Store(lambda: segments(spark, sf_dir), f"{order.shared_folder(spark)}/index-{uuid.uuid4().hex}")
    return _stores[key]


def _rank(spark: SparkSession, sf_dir: str, terms: list[str], *filters, **more) -> DataFrame:
    store = _store(spark, sf_dir)
    return keyword.rank(store.read("keyword"), segments(spark, sf_dir), terms, *filters, spellings=lambda: store.read("spellings"), **more)


TERMS = ["with", "the", "tion", "the"]


@query(f"SELECT segment_id, shard, episode_id, type, start_sec, score, question FROM ({_keyword_sql(TERMS, select='*')}) ORDER BY score DESC, start_sec DESC, segment_id LIMIT 200")
def keyword_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments(spark, sf_dir)
    ranked = keyword.best(_rank(spark, sf_dir, TERMS), keyword.RESULTS)
    return seg.select("segment_id", "question").join(F.broadcast(ranked), "segment_id").select("segment_id", "shard", "episode_id", "type", "start_sec", "score", "question")


FUZZY = ["tion", "keit", "reading", "copyright"]


@query(_keyword_sql(FUZZY))
def keyword_fuzzy_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank(spark, sf_dir, FUZZY).select("segment_id", "shard", "score")


@query(_keyword_sql(["with", "tion"], "type = 'question' AND episode_id = 'src3'", "shard = 'en'"))
def keyword_filters_episode_type_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank(spark, sf_dir, ["with", "tion"], "question", "src3", ["en"]).select("segment_id", "shard", "score")


def _blocks(spark: SparkSession, sf_dir: str, terms: list[str], shards: list[str] | None = None, **chosen: str) -> DataFrame:
    store = _store(spark, sf_dir)
    blocks = store.read("blocks")
    shards = shards or sorted(r.shard for r in segments(spark, sf_dir).select("shard").distinct().collect() if r.shard is not None)
    found, _ = keyword.rank_blocks(blocks, store.read("tops"), terms, shards, chosen, store.read("bitmaps") if chosen else None, spellings=lambda: store.read("spellings"))
    return found


@query(_keyword_sql(FUZZY))
def keyword_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 240 best segments from the blocks that can hold them."""
    return _blocks(spark, sf_dir, FUZZY).select("segment_id", "shard", "score")


@query(_keyword_sql(["with", "tion"], "type = 'question' AND episode_id = 'src3'"))
def keyword_bitmap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two facets and-ed as bitmaps before any score."""
    return _blocks(spark, sf_dir, ["with", "tion"], type="question", episode_id="src3").select("segment_id", "shard", "score")


@query(f"WITH {SEG} SELECT segment_id, start_sec, CAST(0 AS BIGINT) AS score FROM seg WHERE type = 'question' ORDER BY start_sec DESC, segment_id LIMIT 240")
def keyword_browse_empty_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank(spark, sf_dir, [], "question").select("segment_id", "start_sec", "score")


@query(f"WITH {POSTINGS} SELECT * FROM postings")
def postings_weighted_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.postings(segments(spark, sf_dir)).select("shard", "term", "segment_id", "weight")


DICTIONARY = f"""{POSTINGS}, dictionary AS (
  SELECT shard, term, freq, row_number() OVER (PARTITION BY shard ORDER BY freq DESC, term) AS rk
  FROM (SELECT shard, term, count(*) AS freq FROM words GROUP BY ALL) QUALIFY rk <= 12000)"""


@query(f"WITH {DICTIONARY} SELECT * FROM dictionary")
def vocab_freq_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.dictionary(segments(spark, sf_dir))


def _suggest_sql(prefix: str) -> str:
    return f"""(SELECT term, row_number() OVER (ORDER BY shard DESC, rk, term) AS position
  FROM (SELECT term, shard, rk FROM dictionary WHERE starts_with(term, '{prefix}') QUALIFY row_number() OVER (PARTITION BY term ORDER BY shard DESC, rk) = 1)
  QUALIFY position <= 8)"""


@query(f"WITH {DICTIONARY} SELECT * FROM {_suggest_sql('en')}")
def autocomplete_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.suggest(_store(spark, sf_dir).read("prefixes"), "en")


@query(f"WITH {DICTIONARY} SELECT 'reading th' AS query, 'reading ' || term AS suggestion FROM {_suggest_sql('th')} WHERE position = 1 AND term <> 'th'")
def did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = keyword.suggest(_store(spark, sf_dir).read("prefixes"), "th").where("position = 1")
    return best.select(F.lit("reading th").alias("query"), text.rewrite_last_term(F.lit("reading th"), F.col("term")).alias("suggestion")).where("suggestion is not null")


@query(f"""SELECT doc_id, CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) AS n_index,
  CAST(len(list_filter(string_split(trim({PLAIN.format("coalesce(text, '')")}), ' '), lambda w: w <> '')) AS BIGINT) AS n_query,
  CAST(len(list_filter(string_split({NORM.format("coalesce(text, '')")}, ' '), lambda w: length(w) BETWEEN 2 AND 23)) AS BIGINT) AS n_embed,
  array_to_string({WORDS.format("coalesce(text, '')")}[1:8], ' ') AS head FROM documents""")
def normalize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    size = lambda c: F.size(c).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", size(text.index_words(t)).alias("n_index"), size(text.query_terms(t)).alias("n_query"), size(text.embedding_tokens(t)).alias("n_embed"), F.array_join(F.slice(text.index_words(t), 1, 8), " ").alias("head"))


TOKENS = f"""tokens AS (SELECT doc_id, list_filter(string_split({NORM.format("coalesce(text, '')")}, ' '), lambda w: length(w) BETWEEN 2 AND 23) AS tokens FROM documents),
rows_ AS (SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS p FROM tokens),
stats AS (SELECT term, count(*) AS freq, count(DISTINCT doc_id) AS df FROM rows_ GROUP BY term HAVING count(*) >= 5)"""


def _tokens(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    return semantic.token_rows(table(spark, sf_dir, "documents"), "doc_id", F.coalesce("text", F.lit("")), dealt=dealt)


@query(f"WITH {TOKENS} SELECT term, freq, df, round(ln(1 + (SELECT count(*) FROM documents) / df), 6) AS idf FROM stats")
def doc_freq_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = semantic.term_stats(_tokens(spark, sf_dir), "doc_id")
    return stats.withColumn("idf", F.round(semantic.idf(table(spark, sf_dir, "documents").count()), 6))


PAIRS = f"""{TOKENS}, known AS (SELECT r.* FROM rows_ r SEMI JOIN stats USING (term)),
pairs AS (SELECT least(x.term, y.term) AS a, greatest(x.term, y.term) AS b, count(*) AS n
  FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS k FROM known) x JOIN known y ON x.doc_id = y.doc_id AND y.p = x.p + x.k AND x.term <> y.term GROUP BY ALL)"""


@query(f"WITH {PAIRS} SELECT a, b, n FROM pairs")
def cooccurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.cooccurrences(_tokens(spark, sf_dir, False), "doc_id", _store(spark, sf_dir).read("statistics"))


@query(f"""WITH {PAIRS}, both_ AS (SELECT a, b, n FROM pairs UNION ALL SELECT b, a, n FROM pairs), margin AS (SELECT a, sum(n) AS m FROM both_ GROUP BY a)
SELECT x.a, x.b, round(ln(x.n * CAST((SELECT sum(n) FROM both_) AS DOUBLE) / (CAST(p.m AS DOUBLE) * q.m)), 6) AS ppmi
FROM both_ x JOIN margin p ON x.a = p.a JOIN margin q ON x.b = q.a WHERE ln(x.n * CAST((SELECT sum(n) FROM both_) AS DOUBLE) / (CAST(p.m AS DOUBLE) * q.m)) > 1e-9""")
def ppmi_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.ppmi(_tokens(spark, sf_dir, False), "doc_id", _store(spark, sf_dir).read("statistics")).where("ppmi > 1e-9").select("a", "b", F.round("ppmi", 6).alias("ppmi"))


def _factors_sql(steps: int = 36, size: int = 4) -> str:
    """The ``size`` leading factors by plain powers of the matrix, made orthonormal one after another."""
    x, q = ([f"{c}{k}" for k in range(1, size + 1)] for c in "xq")
    powers = [f"x_{k} AS MATERIALIZED (SELECT a AS term, {', '.join(f'sum(v * {c}) AS {c}' for c in x)} FROM matrix_ JOIN x_{k - 1} ON b = term GROUP BY a)" for k in range(1, steps + 1)]
    turned, before = [], f"x_{steps}"
    for k in range(size):
        less = "".join(f" - (SELECT sum({p} * {x[k]}) FROM {before}) * {p}" for p in q[:k])
        turned.append(f"p_{k} AS MATERIALIZED (SELECT term, {''.join(p + ', ' for p in q[:k])}{x[k]}{less} AS y{''.join(', ' + c for c in x[k + 1:])} FROM {before})")
        turned.append(f"h_{k} AS MATERIALIZED (SELECT term, {''.join(p + ', ' for p in q[:k])}y / sqrt((SELECT sum(y * y) FROM p_{k})) AS {q[k]}{''.join(', ' + c for c in x[k + 1:])} FROM p_{k})")
        before = f"h_{k}"
    inner = ", ".join(f"sum({p} * z{j}) AS s{i}_{j}" for i, p in enumerate(q) for j in range(size))
    return f"""WITH {PAIRS}, both_ AS (SELECT a, b, n FROM pairs UNION ALL SELECT b, a, n FROM pairs), margin AS (SELECT a, sum(n) AS m FROM both_ GROUP BY a),
matrix_ AS MATERIALIZED (SELECT * FROM (SELECT x.a, x.b, ln(x.n * CAST((SELECT sum(n) FROM both_) AS DOUBLE) / (CAST(p.m AS DOUBLE) * q.m)) AS v FROM both_ x JOIN margin p ON x.a = p.a JOIN margin q ON x.b = q.a) WHERE v > 0),
x_0 AS (SELECT a AS term, {', '.join(f"sin(hash(a || '{k}') % 1000003) AS {c}" for k, c in enumerate(x))} FROM matrix_ GROUP BY a),
{', '.join(powers + turned)},
z AS (SELECT a AS term, {', '.join(f'sum(v * {p}) AS z{j}' for j, p in enumerate(q))} FROM matrix_ JOIN {before} ON b = term GROUP BY a),
inner_ AS (SELECT {inner} FROM {before} JOIN z USING (term)),
r AS (SELECT term, {', '.join(q)}, {', '.join(' + '.join(f'{p} * s{i}_{j}' for i, p in enumerate(q)) + f' AS r{j}' for j in range(size))} FROM {before}, inner_),
own AS (SELECT *, {' + '.join(f'r{j} * {p}' for j, p in enumerate(q))} AS self FROM r),
probe AS (SELECT * FROM own WHERE term IN (SELECT term FROM stats ORDER BY freq DESC, term LIMIT 3))
SELECT t.term, p.term AS probe, round(({' + '.join(f't.r{j} * p.{c}' for j, c in enumerate(q))}) / sqrt(t.self * p.self), 2) + 0.0 AS similarity FROM own t, probe p"""


@query(_factors_sql())
def word_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading factors of the word matrix, by what no sign or rotation changes: cosines with the most frequent words."""
    stats = order.stored(semantic.term_stats(_tokens(spark, sf_dir), "doc_id"))
    vectors_ = order.stored(semantic.factors(_tokens(spark, sf_dir, False), stats.select("term"), 4, 12, 12))
    top = stats.orderBy(F.desc("freq"), "term").limit(3).select("term")
    rows = vectors_.join(top, "term").collect()  # three
    probes = F.inline(F.array(*(F.struct(F.lit(r.term).alias("probe"), F.array(*map(F.lit, r.vec)).alias("of")) for r in rows)))
    return vectors_.select("term", "vec", probes).select("term", "probe", (F.round(vectors.dot(F.col("vec"), F.col("of")), 2) + 0.0).alias("similarity"))


@query(f"""WITH {SEG}, w AS (SELECT segment_id, start_sec, regexp_extract_all(answer, '\\s*\\S+') AS w FROM seg),
chunks AS (SELECT segment_id, start_sec, w, i, i * 190 AS s FROM w, (VALUES (0), (1), (2)) v(i) WHERE (i = 0 AND len(w) > 0) OR (i > 0 AND (i - 1) * 190 + 220 < len(w))),
placed AS (SELECT *, length(w[s + 1]) - length(regexp_replace(w[s + 1], '^\\s+', '')) AS lead FROM chunks)
SELECT segment_id, start_sec, CAST(i + 1 AS BIGINT) AS idx, CAST(length(array_to_string(w[1:s], '')) + lead AS BIGINT) AS char_offset, substr(array_to_string(w[s + 1:s + 220], ''), CAST(lead + 1 AS BIGINT)) AS text FROM placed
UNION ALL SELECT segment_id, start_sec, 0, -1, question FROM seg WHERE trim(question) <> ''""")
def passage_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.passages(segments(spark, sf_dir))


@query("""SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+')) AS run FROM documents) WHERE length(run) >= 3 GROUP BY run HAVING count(*) > 2""")
def docs_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.text_dictionary(table(spark, sf_dir, "documents"), "text")


MARKS = ["the", "then", "tion", "keit"]
FIRSTS = " UNION ALL ".join(f"SELECT segment_id, strpos(p, '{t}') - 1 AS s, strpos(p, '{t}') - 1 + {len(t)} AS e FROM plain WHERE strpos(p, '{t}') > 0" for t in MARKS)
FIRST_RANGES = f"{SEG}, plain AS (SELECT segment_id, {PLAIN.format('answer')} AS p FROM seg), firsts AS ({FIRSTS})"


@query(f"WITH {FIRST_RANGES} SELECT segment_id, CAST(s AS INTEGER) AS range_start, CAST(e AS INTEGER) AS range_end FROM firsts")
def highlight_first_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments(spark, sf_dir).select("segment_id", F.explode(ranges.first_ranges(F.col("answer"), MARKS)).alias("r"))
    return found.select("segment_id", F.col("r.start").alias("range_start"), F.col("r.end").alias("range_end"))


@query(f"""WITH {SEG}, plain AS (SELECT segment_id, {PLAIN.format('answer')} AS p FROM seg)
SELECT segment_id, CAST({" + ".join(f"(length(p) - length(replace(p, '{t}', ''))) // {len(t)}" for t in MARKS)} AS BIGINT) AS matches FROM plain""")
def highlight_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("segment_id", ranges.count_matches(F.col("answer"), MARKS).alias("matches"))


@query(f"""WITH {SEG}, plain AS (SELECT segment_id, string_split({PLAIN.format('question')}, 'tion') AS p FROM seg),
cut AS (SELECT segment_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k, len(p) AS n FROM plain)
SELECT segment_id, CAST(sum(length(piece)) OVER w + (k - 1) * 4 AS INTEGER) AS range_start, CAST(sum(length(piece)) OVER w + k * 4 AS INTEGER) AS range_end FROM cut
WINDOW w AS (PARTITION BY segment_id ORDER BY k) QUALIFY k < n""")
def highlight_all_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments(spark, sf_dir).select("segment_id", F.explode(ranges.all_ranges(F.col("question"), ["tion"])).alias("r"))
    return found.select("segment_id", F.col("r.start").alias("range_start"), F.col("r.end").alias("range_end"))


@query(f"""WITH {FIRST_RANGES}, flagged AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY segment_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM firsts),
islands AS (SELECT *, sum(opens) OVER (PARTITION BY segment_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM flagged)
SELECT segment_id, CAST(min(s) AS INTEGER) AS range_start, CAST(max(e) AS INTEGER) AS range_end FROM islands GROUP BY segment_id, g""")
def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = ranges.merge_ranges(ranges.first_ranges(F.col("answer"), MARKS))
    found = segments(spark, sf_dir).select("segment_id", F.explode(merged).alias("r"))
    return found.select("segment_id", F.col("r.start").alias("range_start"), F.col("r.end").alias("range_end"))


@query(f"""WITH {SEG}, plain AS (SELECT segment_id, answer, length(answer) AS n, least(nullif(strpos({PLAIN.format('answer')}, 'tion'), 0), nullif(strpos({PLAIN.format('answer')}, 'keit'), 0)) - 1 AS c FROM seg),
win AS (SELECT *, greatest(c - 170, 0) AS l, least(c + 170, n) AS r FROM plain),
grown AS (SELECT *, l - length(regexp_extract(substr(answer, 1, l), '\\S*\\z')) AS s, r + length(regexp_extract(substr(answer, r + 1), '^\\S*')) AS e FROM win)
SELECT segment_id, CASE WHEN n = 0 THEN '' WHEN c IS NOT NULL THEN
  (CASE WHEN s > 0 THEN '…' ELSE '' END) || regexp_replace(substr(answer, s + 1, e - s), '^\\s+|\\s+\\z', '', 'g') || (CASE WHEN e < n THEN '…' ELSE '' END)
  WHEN n <= 340 THEN answer ELSE regexp_replace(substr(answer, 1, 340) || regexp_extract(substr(answer, 341), '^\\S*'), '\\s+\\z', '') || '…' END AS preview FROM grown""")
def snippet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(spark, sf_dir).select("segment_id", ranges.snippet(F.col("answer"), ["tion", "keit"]).alias("preview"))


@query(f"""WITH vocab AS (SELECT DISTINCT unnest({WORDS.format("coalesce(text, '')")}) AS word FROM documents),
asked AS (SELECT item_id, {WORDS.format('text')}[2] AS term FROM benchmark)
SELECT item_id, term, word, CAST(levenshtein(term, word) AS BIGINT) AS distance FROM asked JOIN vocab
ON length(term) > 3 AND length(word) <= length(term) + 2 AND levenshtein(term, word) <= CASE WHEN length(term) > 7 THEN 2 ELSE 1 END""")
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's second word with its near words among all words of the documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(text.index_words(F.coalesce("text", F.lit(""))))).alias("word")).distinct()
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.get(text.index_words(F.col("text")), F.lit(1)).alias("term")).where("term is not null")
    # items may share a word
    pairs = spelling.near(asked.select("term").distinct(), spelling.index(words))
    return asked.join(pairs, "term").select("item_id", "term", "word", F.levenshtein("term", "word").cast("long").alias("distance"))


QUANT = "list_transform(embedding, lambda x: CAST(greatest(-127, least(127, floor(CAST(x AS DOUBLE) * 127 + 0.5))) AS INTEGER))"
INT_DOT = "CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT)"


def _byte_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("embedding is not null and forall(embedding, x -> x is not null and not isnan(x))").select("vec_id", "label", vectors.quantize(F.col("embedding")).alias("q"))


def _vector(rows: DataFrame, vec_id: int) -> Column:
    """One vector as a literal."""
    own = rows.where(F.col("vec_id") == vec_id).select("q").head()
    return F.array(*(F.lit(int(x)) for x in own.q)) if own else F.array().cast("array<int>")


@query(f"WITH v AS (SELECT vec_id, {QUANT} AS q FROM embeddings) SELECT vec_id, array_to_string(q, ',') AS bytes FROM v")
def quantize_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _byte_vectors(spark, sf_dir).select("vec_id", F.array_join(F.col("q").cast("array<string>"), ",").alias("bytes"))


@query(f"""WITH v AS (SELECT vec_id, label, {QUANT} AS q FROM embeddings),
scored AS (SELECT b.label, b.vec_id, {INT_DOT} AS score FROM v a, v b WHERE a.vec_id = 0)
SELECT label, vec_id, score FROM scored QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1 ORDER BY score DESC, label LIMIT 240""")
def semantic_topk_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _byte_vectors(spark, sf_dir)
    scored = rows.select(F.col("label").alias("segment_id"), "vec_id", vectors.int_dot(_vector(rows, 0), F.col("q")).alias("score"))
    return semantic.best_passages(scored, keyword.CANDIDATES, "vec_id").select(F.col("segment_id").alias("label"), "vec_id", "score")


@query(f"WITH v AS (SELECT vec_id, {QUANT} AS q FROM embeddings) SELECT b.vec_id, {INT_DOT} AS score FROM v a, v b WHERE a.vec_id = 7 AND b.vec_id <> 7 ORDER BY score DESC, b.vec_id LIMIT 8")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _byte_vectors(spark, sf_dir).select(F.col("vec_id").alias("term"), "q", F.col("q").cast("array<double>").alias("vec"))
    return semantic.nearest_words(words, 7).select(F.col("term").alias("vec_id"), F.col("score").cast("long").alias("score"))


_cells: dict[tuple[str, str], cells.Cells] = {}


def _coarse(spark: SparkSession, sf_dir: str) -> cells.Cells:
    """The coarse index of the embeddings, built once an application and state of the files."""
    key = spark.sparkContext.applicationId, index.files_state(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    if key not in _cells:
        # cells of some 64 vectors, so that these tables have several
        rows = _byte_vectors(spark, sf_dir)
        count = max(rows.count() // 64, 1)
        _cells[key] = cells.build(rows, "vec_id", f"{order.shared_folder(spark)}/cells-{uuid.uuid4().hex}", min(count, 256))
    return _cells[key]


def _query_vector(found: cells.Cells, vec_id: int) -> list[int] | None:
    own = found.vectors.where(F.col("key") == vec_id).select("q").head()
    return list(own.q) if own else None


@query(f"WITH v AS (SELECT vec_id, {QUANT} AS q FROM embeddings) SELECT b.vec_id, {INT_DOT} AS score FROM v a, v b WHERE a.vec_id = 3 AND b.vec_id <> 3 ORDER BY score DESC, b.vec_id LIMIT 10")
def vector_cells_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact mode of the coarse index: cells are read by falling bound until none can hold a better vector."""
    found = _coarse(spark, sf_dir)
    best, _ = found.exact(_query_vector(found, 3) or [0], 10, 3)
    return best.select(F.col("key").alias("vec_id"), "score")


@query()
def vector_cells_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of five vectors as queries: how many of the 10 best of all a probe of seven eighths of the cells finds, and the share of rows read.

    These vectors are spread evenly, so cells part them badly."""
    found = _coarse(spark, sf_dir)
    probes, rows = max(-(-7 * len(found.counts) // 8), 1), []
    for vec_id in (0, 100, 200, 300, 400):
        q = _query_vector(found, vec_id)
        if q is not None:
            want, got = (found.probe(q, 10, n, vec_id).select("key") for n in (len(found.counts), probes))
            share = sum(found.counts[c] for c in found.order(q)[:probes]) / max(sum(found.counts.values()), 1)
            rows.append(want.join(got, "key").agg(F.lit(vec_id).cast("long").alias("query_id"), F.count("*").alias("found"), F.lit(probes).alias("cells"), F.lit(round(share, 4)).alias("share_read")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(f"""WITH v AS (SELECT vec_id, {QUANT} AS q FROM embeddings),
sem AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS second_rank FROM (SELECT b.vec_id, {INT_DOT} AS score FROM v a, v b WHERE a.vec_id = 0 ORDER BY score DESC, b.vec_id LIMIT 240)),
kw AS (SELECT segment_id AS id, row_number() OVER (ORDER BY score DESC, start_sec DESC, segment_id) AS first_rank FROM ({_keyword_sql(['with', 'tion'], select='*')}))
SELECT id, coalesce(first_rank, 0) AS first_rank, coalesce(second_rank, 0) AS second_rank, round(coalesce(1.0 / (60 + first_rank), 0) + coalesce(1.0 / (60 + second_rank), 0), 9) AS score FROM kw FULL JOIN sem USING (id)
ORDER BY coalesce(1.0 / (60 + first_rank), 0) + coalesce(1.0 / (60 + second_rank), 0) DESC, kw.first_rank NULLS LAST, sem.second_rank NULLS LAST LIMIT 200""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _byte_vectors(spark, sf_dir)
    exact = _rank(spark, sf_dir, ["with", "tion"])
    near = rows.select("vec_id", vectors.int_dot(_vector(rows, 0), F.col("q")).alias("score")).orderBy(F.desc("score"), "vec_id").limit(keyword.CANDIDATES)
    first = fusion.ranked(exact.withColumnRenamed("segment_id", "id"), "first_rank", F.desc("score"), F.desc("start_sec"), "id")
    second = fusion.ranked(near.withColumnRenamed("vec_id", "id"), "second_rank", F.desc("score"), "id")
    return fusion.fuse(first, second, "id", keyword.RESULTS).withColumn("score", F.round("score", 9)).fillna(0, ["first_rank", "second_rank"])


def _keyword_engine(spark: SparkSession, sf_dir: str, **more: DataFrame) -> Engine:
    """An engine over the stored index of the documents."""
    store = _store(spark, sf_dir)
    return Engine(segments(spark, sf_dir), store.read("keyword"), store.read("prefixes"), store.read("autocomplete"), lambda: store.read("spellings"), **more)


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the documents, with word vectors trained on them."""
    seg = segments(spark, sf_dir)
    docs = seg.select("segment_id", F.concat_ws(" ", "question", "answer").alias("text"))
    stored = order.stored(artifacts.word_table(semantic.train(docs, "segment_id", F.col("text"))))
    return _keyword_engine(spark, sf_dir, vectors=artifacts.passage_vectors(seg, stored), table=artifacts.query_words(stored))


@query()
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector retrieval fused, with previews. Vectors have no stable sign, so no SQL."""
    found = _engine(spark, sf_dir).search(query_state.QueryState("with the other"))
    return found.select("segment_id", "rank", "score", "found_by", "match", F.size("highlights.answer").alias("n_highlights"))


@query(f"SELECT segment_id, row_number() OVER (ORDER BY score DESC, start_sec DESC, segment_id) AS rank, score FROM ({_keyword_sql(TERMS, select='*')}) QUALIFY rank <= 200")
def engine_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine over the stored index, asked by an address in keyword mode."""
    return _keyword_engine(spark, sf_dir).search(query_state.QueryState(" ".join(TERMS), "keyword")).select("segment_id", "rank", F.col("score").cast("long").alias("score"))


_built: dict[tuple[str, str], str] = {}


def _opened(spark: SparkSession, sf_dir: str) -> tuple[Engine, str]:
    """An engine opened over written artifacts, and their folder. Vectors are given: the n-th most frequent word has embedding n."""
    docs, given = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    key = spark.sparkContext.applicationId, f"{index.files_state(docs)}/{index.files_state(given)}"
    if key not in _built:
        path = f"{order.shared_folder(spark)}/engine-{uuid.uuid4().hex}"
        artifacts.write(segments(spark, sf_dir), _given_words(spark, sf_dir), path)
        _built[key] = path
    return Engine.open(spark, _built[key]), _built[key]


def _given_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = order.numbered(_store(spark, sf_dir).read("statistics"), F.desc("freq"), "term", start=0, name="vec_id")
    vectors_ = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    return ranked.withColumn("idf", semantic.idf(table(spark, sf_dir, "documents").count())).join(vectors_, "vec_id").select("term", "idf", "vec")


#: Passages with their byte vectors, and the pooled query, over the word table in bytes.
SEMANTIC = f"""{TOKENS}, {SEG}, ranked AS (SELECT term, round(ln(1 + (SELECT count(*) FROM documents) / df), 3) AS idf, row_number() OVER (ORDER BY freq DESC, term) - 1 AS vec_id FROM stats),
given AS (SELECT term, idf, list_transform({QUANT}, lambda x: x / CAST(127 AS DOUBLE)) AS vec FROM ranked JOIN embeddings USING (vec_id)),
w AS (SELECT segment_id, regexp_extract_all(answer, '\\s*\\S+') AS w FROM seg),
chunks AS (SELECT segment_id, w, i, i * 190 AS s FROM (SELECT *, unnest(range(len(w) // 190 + 2)) AS i FROM w) WHERE (i = 0 AND len(w) > 0) OR (i > 0 AND (i - 1) * 190 + 220 < len(w))),
passages AS (SELECT segment_id, length(array_to_string(w[1:s], '')) + length(w[s + 1]) - length(regexp_replace(w[s + 1], '^\\s+', '')) AS char_offset, array_to_string(w[s + 1:s + 220], '') AS t FROM chunks
  UNION ALL SELECT segment_id, -1, question FROM seg WHERE trim(question) <> ''),
asked AS (SELECT segment_id, char_offset, unnest(list_filter(string_split({NORM.format('t')}, ' '), lambda w: length(w) BETWEEN 2 AND 23)) AS term FROM passages
  UNION ALL SELECT -1, 0, unnest(['with', 'the', 'other'])),
dims AS (SELECT segment_id, char_offset, sum(idf * x) AS x, d FROM (SELECT segment_id, char_offset, term, count(*) AS times FROM asked GROUP BY ALL) a
  JOIN (SELECT term, idf, unnest(vec) AS x, unnest(range(1, len(vec) + 1)) AS d FROM given) g USING (term), range(times) GROUP BY segment_id, char_offset, d),
units AS (SELECT segment_id, char_offset, d, x / sqrt(sum(x * x) OVER (PARTITION BY segment_id, char_offset)) AS x FROM dims),
scores AS (SELECT p.segment_id, p.char_offset, sum(q.x * greatest(-127, least(127, floor(p.x * 127 + 0.5)))) / 127 AS score FROM units p JOIN units q ON q.segment_id = -1 AND p.segment_id <> -1 AND p.d = q.d GROUP BY ALL),
near_ AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY round(score, 9) DESC, char_offset) = 1 ORDER BY round(score, 9) DESC, segment_id LIMIT 240),
second_ AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, segment_id) AS second_rank FROM near_)"""


@query(f"WITH {SEMANTIC} SELECT segment_id, char_offset, second_rank AS rank, round(score, 6) AS score FROM second_ WHERE second_rank <= 200")
def engine_semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine opened over written artifacts, asked by meaning."""
    found = _opened(spark, sf_dir)[0].search(query_state.QueryState("with the other", "semantic"))
    return found.select("segment_id", "char_offset", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {SEMANTIC}, first_ AS (SELECT segment_id, row_number() OVER (ORDER BY score DESC, start_sec DESC, segment_id) AS first_rank FROM ({_keyword_sql(['with', 'the', 'other'], select='*')})),
fused AS (SELECT segment_id, first_rank, second_rank, coalesce(1.0 / (60 + first_rank), 0) + coalesce(1.0 / (60 + second_rank), 0) AS score FROM first_ FULL JOIN second_ USING (segment_id))
SELECT segment_id, row_number() OVER (ORDER BY score DESC, first_rank NULLS LAST, second_rank NULLS LAST) AS rank, round(score, 9) AS score,
  CASE WHEN first_rank IS NULL THEN 'semantic' WHEN second_rank IS NULL THEN 'keyword' ELSE 'both' END AS found_by FROM fused QUALIFY rank <= 200""")
def engine_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same engine, keyword and semantic results fused."""
    found = _opened(spark, sf_dir)[0].search(query_state.QueryState("with the other"))
    return found.select("segment_id", "rank", F.round("score", 9).alias("score"), "found_by")


def _digest_sql(source: str, kind: str, *columns: str) -> str:
    value = "concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns) + ")"
    number = f"list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, 16), lambda i: strpos('0123456789abcdef', md5({value})[i]) - 1)), lambda a, b: 16 * a + b)"
    return f"SELECT '{kind}' AS kind, CAST(shard AS VARCHAR) AS shard, count(*) AS rows, printf('%015x', CAST(sum({number}) % 1152921504606846976 AS BIGINT)) AS digest FROM {source} GROUP BY shard"


@query(f"""WITH {DICTIONARY}, firsts AS (SELECT shard, term, rk, substr(term, 1, k) AS prefix FROM dictionary, (VALUES (1), (2), (3), (4)) v(k) WHERE k <= length(term)),
prefixes AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY shard, prefix ORDER BY rk) <= 8)
{_digest_sql('postings', 'keyword', *artifacts.SHARDS['keyword'])} UNION ALL {_digest_sql('dictionary', 'autocomplete', *artifacts.SHARDS['autocomplete'])}
UNION ALL {_digest_sql('prefixes', 'prefixes', *artifacts.SHARDS['prefixes'])} UNION ALL {_digest_sql('seg', 'docs', *artifacts.SHARDS['docs'])}""")
def artifact_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and content of the written shards, as the manifest has them, for the kinds that SQL makes as well."""
    found = artifacts.manifest(spark, _opened(spark, sf_dir)[1]).where("kind in ('keyword', 'autocomplete', 'prefixes', 'docs') and files > 0 and bytes > 0")
    return found.select("kind", "shard", "rows", "digest")


@query(f"WITH {SEG} SELECT segment_id, start_sec, type, question FROM seg WHERE episode_id = 'src3'")
def engine_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword_engine(spark, sf_dir).episode("src3").select("segment_id", "start_sec", "type", "question")


@query()
def train_word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors at unit length; a rotation of them is as good, so tests hold invariants."""
    docs = table(spark, sf_dir, "documents")
    words = semantic.train(docs, "doc_id", F.coalesce("text", F.lit("")))
    return words.select("term", F.round("idf", 6).alias("idf"), F.size("vec").alias("dimensions"), F.round(vectors.dot(F.col("vec"), F.col("vec")), 6).alias("norm"))


@query(f"""WITH {TOKENS}, ranked AS (SELECT term, ln(1 + (SELECT count(*) FROM documents) / df) AS idf, row_number() OVER (ORDER BY freq DESC, term) - 1 AS vec_id FROM stats),
words_ AS (SELECT term, idf, embedding AS vec FROM ranked JOIN embeddings USING (vec_id)),
asked AS (SELECT item_id, unnest(list_filter(string_split({NORM.format('text')}, ' '), lambda w: length(w) BETWEEN 2 AND 23)) AS term FROM benchmark),
dims AS (SELECT item_id, idf * CAST(unnest(vec) AS DOUBLE) AS x, unnest(range(1, len(vec) + 1)) AS d FROM asked JOIN words_ USING (term)),
sums AS (SELECT item_id, d, sum(x) AS x FROM dims GROUP BY ALL)
SELECT item_id, CAST(d AS INTEGER) AS d, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 5) + 0.0 AS x FROM sums""")
def query_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts pooled over a word table whose vectors are given: the n-th most frequent word has vector n."""
    stats = _store(spark, sf_dir).read("statistics")
    ranked = order.numbered(stats, F.desc("freq"), "term", start=0, name="vec_id")
    words = ranked.withColumn("idf", semantic.idf(table(spark, sf_dir, "documents").count())).join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec")), "vec_id")
    asked = semantic.token_rows(table(spark, sf_dir, "benchmark"), "item_id", F.col("text"))
    pooled = semantic.pool(asked, "item_id", words.select("term", "idf", "vec"))
    return pooled.select("item_id", F.posexplode("vec").alias("d", "x")).select("item_id", (F.col("d") + 1).alias("d"), (F.round("x", 5) + 0.0).alias("x"))


COUNTS = f"{SEG}, counts AS (SELECT episode_id, shard, count(*) AS n FROM seg GROUP BY ALL)"


@query(f"WITH {COUNTS} SELECT shard, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY shard")
def facet_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.shards(facets.episode_counts(segments(spark, sf_dir)))


@query(f"WITH {COUNTS} SELECT episode_id, CAST(sum(n) AS BIGINT) AS n, max(shard) AS latest FROM counts GROUP BY episode_id")
def facet_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.episodes(facets.episode_counts(segments(spark, sf_dir)))


@query(f"WITH {COUNTS} SELECT count(DISTINCT episode_id) AS episodes, CAST(sum(n) AS BIGINT) AS segments, max(shard) AS latest FROM counts")
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.totals(facets.episode_counts(segments(spark, sf_dir)))


@query(f"WITH {SEG} SELECT segment_id, question FROM seg WHERE contains(lower(question), 'with') ORDER BY segment_id LIMIT 20")
def episode_filter_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.matching(segments(spark, sf_dir), "question", "with").select("segment_id", "question").orderBy("segment_id").limit(20)


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 5 ORDER BY turn")
def episode_segments_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("conv_id = 5").select("conv_id", "turn", "role", "text").orderBy("turn")


@query("""WITH spoken AS (SELECT * FROM conversations WHERE role <> 'system'),
flagged AS (SELECT *, CASE WHEN role = 'user' AND coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') <> 'user' THEN 1 ELSE 0 END AS opens FROM spoken),
numbered AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ord FROM flagged)
SELECT conv_id, ord, count(*) AS turns, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '') AS question,
  coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), '') AS answer, CASE WHEN ord = 0 THEN 'intro' ELSE 'question' END AS type FROM numbered GROUP BY conv_id, ord""")
def segment_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.turn_sections(table(spark, sf_dir, "conversations"))


HOST = "Host"


CLEAN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


@query(f"""WITH said AS (SELECT conv_id AS e, turn, CASE WHEN role = 'assistant' THEN 'Host' ELSE 'Guest ' || role END AS speaker, {CLEAN.format('text')} || CASE WHEN role = 'user' THEN '?' ELSE '' END AS t FROM conversations WHERE text IS NOT NULL AND trim(text) <> ''),
marked AS (SELECT *, speaker <> 'Host' AND ends_with(t, '?') AS asks FROM said), opened AS (SELECT *, asks AND NOT coalesce(lag(asks) OVER (PARTITION BY e ORDER BY turn), false) AS opens FROM marked),
placed AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY e ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM opened),
voices AS (SELECT e, section, voice, min(place) AS place FROM (SELECT e, section, speaker AS voice, turn * 2 AS place FROM placed UNION ALL SELECT e, section, 'Host', turn * 2 + 1 FROM placed WHERE opens) GROUP BY ALL),
named AS (SELECT e, section, string_agg(voice, ', ' ORDER BY place) AS speakers FROM voices GROUP BY ALL),
made AS (SELECT e, section, min(turn) * 30 AS start_sec, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (asks), '') AS q, coalesce(string_agg(t, ' ' ORDER BY turn) FILTER (NOT asks), '') AS a FROM placed GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER w AS n, lead(start_sec) OVER w AS end_sec FROM made WINDOW w AS (PARTITION BY e ORDER BY section))
SELECT CAST(e AS VARCHAR) AS episode_id, e || '#q' || printf('%02d', n) AS segment_id, CASE WHEN section = 0 THEN 'intro' ELSE 'question' END AS type, q AS question_text, a AS answer_text,
  CAST(start_sec AS INTEGER) AS start_sec, CAST(end_sec AS INTEGER) AS end_sec, CAST(n - 1 AS INTEGER) AS ord, CAST(len(string_split({CLEAN.format("q || ' ' || a")}, ' ')) AS BIGINT) AS tokens, speakers FROM numbered JOIN named USING (e, section)""")
def transcript_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts, cut into segments by the section state machine. Guests ask, so sections open at the first of their cues in a row."""
    turns = table(spark, sf_dir, "conversations").where("text is not null and trim(text) <> ''")
    speaker = F.when(F.col("role") == "assistant", HOST).otherwise(F.concat(F.lit("Guest "), F.col("role")))
    asked = F.when(F.col("role") == "user", F.concat(text.clean_text(F.col("text")), F.lit("?"))).otherwise(text.clean_text(F.col("text")))
    cues = turns.select(F.col("conv_id").cast("string").alias("episode_id"), F.col("turn").cast("int").alias("pos"), (F.col("turn") * 30).cast("int").alias("start_sec"), speaker.alias("speaker"), asked.alias("text"))
    return segment.segments(cues, HOST).withColumn("speakers", F.array_join("speaker_names", ", ")).drop("speaker_names")


NAMED = "regexp_extract(text, '[A-Za-z]+')"


@query(f"""WITH n AS (SELECT item_id, upper(substr({NAMED}, 1, 1)) || lower(substr({NAMED}, 2)) AS w FROM benchmark)
SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'Mara Quill' WHEN 1 THEN w || ' Lee' WHEN 2 THEN w WHEN 3 THEN '' WHEN 4 THEN 'Mara Quill' ELSE w || ' de Boer' END AS name FROM n""")
def questioner_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Askers as a host reads them out: with lead-ins, trailing words, pronouns, and the host's aliases."""
    word = F.initcap(F.regexp_extract("text", "[A-Za-z]+", 0))
    k = F.col("item_id") % 6
    put = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    read = F.when(k == 0, "and MQ.").when(k == 1, put("So ", word, " Lee,")).when(k == 2, put(word, " who")).when(k == 3, "then She").when(k == 4, "mara  quill..").otherwise(put("okay ", word, " de Boer and"))
    return table(spark, sf_dir, "benchmark").select("item_id", text.questioner(read, "Mara Quill", ("MQ",)).alias("name"))


@query("""WITH d AS (SELECT page_id, CAST(printf('20%02d-%02d-%02d', 10 + page_id % 15, 1 + page_id % 12, 1 + page_id % 28) AS DATE) AS day FROM pages)
SELECT page_id, CAST(day AS VARCHAR) AS day, strftime(day, 'ama-%Y-%m') AS episode, strftime(day, '%B %Y') AS month, 'AMA · ' || upper(strftime(day, '%B %Y')) AS badge, strftime(day, 'ama-%Y-%m') || '#q' || printf('%02d', page_id % 130 + 1) AS segment FROM d""")
def dates_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as written, in two forms, or from the address, and the keys and labels made of them."""
    p = F.col("page_id")
    parts = (10 + p % 15).cast("int"), (1 + p % 12).cast("int"), (1 + p % 28).cast("int")
    written = F.when(p % 3 == 0, F.format_string("20%02d-%02d-%02d", *parts)).when(p % 3 == 1, F.format_string("20%02d-%02d-%02dT08:30:00", *parts)).otherwise("soon")
    day = text.iso_date(written, F.format_string("https://site.example/20%02d/%02d/%02d/ama", *parts))
    key = text.episode_key(day)
    return table(spark, sf_dir, "pages").select("page_id", day.cast("string").alias("day"), key.alias("episode"), text.month_year(day).alias("month"), text.episode_badge(day).alias("badge"), text.segment_key(key, (p % 130).cast("int")).alias("segment"))


@query(f"""WITH v AS (SELECT vec_id, {{QUANT}} AS q FROM embeddings)
SELECT vec_id, to_base64(unhex(array_to_string(list_transform(q, lambda x: printf('%02X', x & 255)), ''))) AS packed, true AS restored FROM v""".replace("{QUANT}", QUANT))
def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte vectors as base64 for readers outside Spark, and back."""
    rows = _byte_vectors(spark, sf_dir).select("vec_id", "q", vectors.packed(F.col("q")).alias("packed"))
    return rows.select("vec_id", "packed", (vectors.unpacked(F.col("packed")) == F.col("q")).alias("restored"))


@query(f"""WITH {SEG}, found AS (SELECT segment_id, question AS t, strpos({PLAIN.format('question')}, 'tion') AS p FROM seg)
SELECT segment_id, CASE WHEN t = '' THEN '' WHEN p = 0 THEN t ELSE substr(t, 1, p - 1) || '[' || substr(t, p, 4) || ']' || substr(t, p + 4) END AS shown FROM found""")
def highlighted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their first match between brackets; ranges beyond the text do not count."""
    beyond = F.array(F.struct((F.length("question") - 1).alias("start"), (F.length("question") + 3).alias("end")), F.struct(F.lit(3).alias("start"), F.lit(3).alias("end"))).cast(ranges.RANGE)
    runs = ranges.marked_runs(F.col("question"), F.concat(ranges.first_ranges(F.col("question"), ["tion"]), beyond))
    shown = F.array_join(F.transform(runs, lambda r: F.when(r["is_match"], F.concat(F.lit("["), r["text"], F.lit("]"))).otherwise(r["text"])), "")
    return segments(spark, sf_dir).select("segment_id", shown.alias("shown"))


CARD = f"""cards AS (SELECT segment_id, rank, question, CASE WHEN trim(answer) <> '' THEN answer ELSE question END AS src FROM (SELECT *, row_number() OVER (ORDER BY score DESC, start_sec DESC, segment_id) AS rank FROM ({_keyword_sql(TERMS, select='*')})) WHERE rank <= 200),
mid AS (SELECT *, length(src) AS n, least({', '.join(f"nullif(strpos({PLAIN.format('src')}, '{t}'), 0)" for t in sorted(set(TERMS)))}) - 1 AS c FROM cards),
win AS (SELECT *, greatest(c - 170, 0) AS l, least(c + 170, n) AS r FROM mid),
grown AS (SELECT *, l - length(regexp_extract(substr(src, 1, l), '\\S*\\z')) AS s, r + length(regexp_extract(substr(src, r + 1), '^\\S*')) AS e FROM win),
shown AS (SELECT segment_id, rank, question, CASE WHEN n = 0 THEN '' WHEN c IS NOT NULL THEN (CASE WHEN s > 0 THEN '…' ELSE '' END) || regexp_replace(substr(src, s + 1, e - s), '^\\s+|\\s+\\z', '', 'g') || (CASE WHEN e < n THEN '…' ELSE '' END)
  WHEN n <= 340 THEN src ELSE regexp_replace(substr(src, 1, 340) || regexp_extract(substr(src, 341), '^\\S*'), '\\s+\\z', '') || '…' END AS match FROM grown)"""


@query(f"""WITH {CARD} SELECT segment_id, rank, match, {' + '.join(f"CASE WHEN contains({PLAIN.format('question')}, '{t}') THEN 1 ELSE 0 END" for t in TERMS)} AS in_question,
  {' + '.join(f"CASE WHEN contains({PLAIN.format('match')}, '{t}') THEN 1 ELSE 0 END" for t in TERMS)} AS in_match, 'keyword' AS found_by, false AS semantic_only FROM shown""")
def result_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer shows of each result: the preview around the earliest term, and the terms marked in it and in the question."""
    found = _keyword_engine(spark, sf_dir).search(query_state.QueryState(" ".join(TERMS), "keyword"))
    return found.select("segment_id", "rank", "match", F.size("highlights.question").alias("in_question"), F.size("highlights.answer").alias("in_match"), "found_by", "semantic_only")


@query("SELECT count(*) AS discovered, count(*) FILTER (page_id % 3 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)) AS processed, count(*) FILTER (page_id % 3 = 0 OR url IN (SELECT url FROM pages WHERE page_id % 3 = 0)) AS skipped FROM pages")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ingest reports: found, new and known pages (every third is known)."""
    found = table(spark, sf_dir, "pages").select("page_id", "url")
    return ingest.summary(found, ingest.without(found, found.where("page_id % 3 = 0"), "page_id", "url"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://site.example/archive/?page=' || page_id WHEN 1 THEN 'https://site.example/p/' || page_id WHEN 2 THEN 'https://other.example/' || page_id WHEN 3 THEN 'https://site.example/archive/n' || page_id ELSE '' END AS next FROM pages""")
def archive_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next archive page that a page names, behind its own links: by relation, by a navigation block, by classes, or not at all."""
    p, key = F.col("page_id"), F.col("page_id").cast("string")
    put = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    forms = F.when(p % 5 == 0, put('<a rel="nofollow next" href="?page=', key, '">older</a>')).when(p % 5 == 1, put('<div class="nav-next"><a href="/p/', key, '">older</a></div>')).when(p % 5 == 2, put('<a class="next page-numbers" href="https://other.example/', key, '">2</a><a rel="next" href="/late">x</a>')).when(p % 5 == 3, put('<style>a rel="next" href="/no"</style><a href="n', key, '" rel="next">x</a>')).otherwise('<a rel="prev" href="/back">newer</a>')
    rows = table(spark, sf_dir, "pages").select("page_id", F.lit("https://site.example/archive/").alias("url"), F.concat("html", forms).alias("html"))
    return pages.next_pages(rows, "page_id").select("page_id", F.coalesce("next", F.lit("")).alias("next"))


@query("SELECT event_id, user_id, epoch_us(ts) AS at_us, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS end_us FROM events")
def segment_end_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    return at.withColumn("end_us", F.coalesce(segment.next_start("at_us", "user_id", "at_us", "event_id"), F.lit(-1)))


@query("SELECT conv_id, greatest(1, max(turn) * 30) AS duration_sec, string_agg(DISTINCT role, ',' ORDER BY role) AS speakers FROM conversations GROUP BY conv_id")
def duration_and_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode_id"), (F.col("turn") * 30).alias("start_sec"), F.col("role").alias("speaker"))
    return ingest.heard(cues).select(F.col("episode_id").alias("conv_id"), F.greatest(F.lit(1).cast("long"), "last").alias("duration_sec"), F.array_join(F.array_sort("voices"), ",").alias("speakers"))


@query("SELECT conv_id, turn, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS tokens FROM conversations")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.token_count(F.col("text")).alias("tokens"))


EVENT_SEG = """es AS (SELECT CAST(user_id AS VARCHAR) AS episode_id, CASE WHEN event_id % 97 = 0 THEN 'x#' ELSE CAST(user_id AS VARCHAR) || '#' END || CAST(event_id // 2 AS VARCHAR) AS segment_id,
  CASE WHEN event_id % 5 = 0 THEN 'question' ELSE 'answer' END AS type, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 500 AS INTEGER) END AS start_sec,
  CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 300 AS INTEGER) END AS end_sec, event_id AS ord FROM events)"""


@query(f"""WITH {EVENT_SEG}, w AS (SELECT *, last_value(start_sec IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM es)
SELECT 'not_monotonic' AS rule, episode_id, segment_id FROM w WHERE start_sec < prev
UNION ALL SELECT 'end_before_start', episode_id, segment_id FROM es WHERE end_sec < start_sec
UNION ALL SELECT 'foreign_segment', episode_id, segment_id FROM es WHERE NOT starts_with(segment_id, episode_id || '#')
UNION ALL SELECT 'negative_time', episode_id, segment_id FROM es WHERE start_sec < 0 OR end_sec <= 0
UNION ALL SELECT 'duplicate_segment', episode_id, segment_id FROM es GROUP BY episode_id, segment_id HAVING count(*) > 1
UNION ALL SELECT 'no_question', episode_id, NULL FROM es GROUP BY episode_id HAVING count(*) FILTER (type = 'question') = 0""")
def validation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, user = F.col("event_id"), F.col("user_id").cast("string")
    rows = table(spark, sf_dir, "events").select(
        user.alias("episode_id"), F.concat(F.when(e % 97 == 0, "x#").otherwise(F.concat(user, F.lit("#"))), F.floor(e / 2).cast("string")).alias("segment_id"),
        F.when(e % 5 == 0, "question").otherwise("answer").alias("type"), F.when(e % 11 != 0, (e % 500).cast("int")).alias("start_sec"),
        F.when(e % 7 == 0, (e % 300).cast("int")).alias("end_sec"), e.alias("ord"),
    )
    return validate.violations(rows)


@query("""WITH d AS (SELECT page_id, url, row_number() OVER (ORDER BY page_id) AS n FROM pages WHERE NOT EXISTS (SELECT 1 FROM pages o WHERE o.page_id % 3 = 0 AND (o.page_id = pages.page_id OR o.url = pages.url)))
SELECT page_id, url, n + (SELECT max(page_id) FROM pages WHERE page_id % 3 = 0) AS number FROM d""")
def incremental_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose id and address are both unknown (every third page is known), numbered on."""
    found = table(spark, sf_dir, "pages").select("page_id", "url")
    known = found.where("page_id % 3 = 0")
    last = known.agg(F.coalesce(F.max("page_id"), F.lit(0))).head()[0]
    return order.numbered(ingest.without(found, known, "page_id", "url"), "page_id", start=last + 1)


@query("SELECT sha256(html) AS sha, min(page_id) AS first_page, count(*) AS pages FROM pages GROUP BY sha256(html)")
def raw_cache_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.sha2("html", 256).alias("sha")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("pages"))


@query("""SELECT sha256(html) AS sha, CAST(length(min(html)) AS INTEGER) AS chars FROM pages WHERE sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 2 = 0) GROUP BY sha256(html)""")
def snapshot_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents that a cache of every second page lacks."""
    found = table(spark, sf_dir, "pages").select("page_id", "html")
    known = pages.new_snapshots(found.where("page_id % 2 = 0"), spark.createDataFrame([], pages.SNAPSHOT))
    return pages.new_snapshots(found, known).select("sha", F.length("html").alias("chars"))


SITE = "https://site.example/p/"


@query(f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://site.example/a/' || page_id || '.mp3' WHEN 1 THEN '{SITE}files/' || page_id || '.mp3?v=2' WHEN 2 THEN 'https://cdn.example/' || page_id ELSE '{SITE}' || page_id END AS audio,
  CASE WHEN page_id % 3 = 0 THEN 'abcdefghij' || page_id % 10 END AS video FROM pages""")
def page_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audio address and the video of pages that have an element, a link, a source or none put on."""
    p, key = F.col("page_id"), F.col("page_id").cast("string")
    put = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    audio = F.when(p % 4 == 0, put('<audio controls src="/a/', key, '.mp3"></audio>')).when(p % 4 == 1, put('<a class="x" href="files/', key, '.mp3?v=2">listen</a>')).when(p % 4 == 2, put('<audio><source src="https://cdn.example/', key, '"></audio>')).otherwise("")
    video = F.when(p % 3 == 0, put('<iframe src="https://www.youtube.com/embed/abcdefghij', (p % 10).cast("string"), '"></iframe>')).otherwise("")
    html = F.concat("html", audio, video)
    return table(spark, sf_dir, "pages").select("page_id", pages.audio_of(html, put(SITE, key)).alias("audio"), pages.video_of(html).alias("video"))


@query("""SELECT DISTINCT 'AMA | May 2024' AS title, 'https://site.example/2024/0' || (1 + page_id % 9) || '/1' || page_id % 10 || '/ama-' || page_id % 500 AS source_url,
  CAST('2024-0' || (1 + page_id % 9) || '-1' || page_id % 10 AS DATE) AS publish_date FROM pages""")
def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive pages with an episode's link and another one; an address that several pages name counts once."""
    p = F.col("page_id")
    path = F.concat(F.lit("/2024/0"), (1 + p % 9).cast("string"), F.lit("/1"), (p % 10).cast("string"), F.lit("/ama-"), (p % 500).cast("string"))
    html = F.concat(F.lit('<article><h2><a href="'), path, F.lit('">AMA | May 2024</a></h2></article><a href="/other">Another post</a>'))
    return pages.discovered(table(spark, sf_dir, "pages").select(p.alias("page_no"), F.lit("https://site.example/archive/").alias("url"), html.alias("html")))


BARE = "regexp_replace(regexp_replace(html, '(?is)<style\\b.*?</style\\s*>', '', 'g'), '(?is)<script\\b.*?</script\\s*>', '', 'g')"


@query(f"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
  len(regexp_extract_all({BARE}, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) AS n_links,
  coalesce(regexp_extract_all({BARE}, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)[1], '') AS first_link,
  length(trim(regexp_replace(regexp_replace({BARE}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n_visible FROM pages""")
def html_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    links = pages.links_of(html)
    return table(spark, sf_dir, "pages").select("page_id", pages.title_of(html).alias("title"), F.size(links).cast("long").alias("n_links"), F.coalesce(F.get(links, F.lit(0)), F.lit("")).alias("first_link"), F.length(pages.visible_text(html)).cast("long").alias("n_visible"))


@query("""SELECT page_id, regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS ref, CASE WHEN page_id % 3 = 0 THEN 'keyword' ELSE 'hybrid' END AS mode, CASE WHEN page_id % 2 = 0 THEN 'intro' ELSE 'all' END AS type, 'free will ' || page_id AS query FROM pages""")
def query_url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses with query fields put on, read back; unknown modes and types fall to the defaults."""
    p = F.col("page_id")
    asked = F.concat(F.lit("https://example.org/?q=free+will+"), p.cast("string"), F.lit("&mode="), F.when(p % 3 == 0, "keyword").otherwise("other"), F.lit("&type="), F.when(p % 2 == 0, "intro").otherwise("what"))
    got = query_state.parsed(asked)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "[?&]ref=([^&#]*)", 1).alias("ref"), got["mode"].alias("mode"), got["type"].alias("type"), got["query"].alias("query"))


CLOCK = "CASE WHEN s IS NULL THEN 'Episode' WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END"


@query(f"SELECT event_id, {CLOCK} AS clock, coalesce(s, -1) AS seconds FROM (SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN event_id % 9000 END AS s FROM events)")
def clock_format_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("event_id") % 13 != 0, F.col("event_id") % 9000)
    clock = text.clock_of(s)
    padded = F.when(F.length(clock) == 4, F.concat(F.lit("0"), clock)).otherwise(clock)
    return table(spark, sf_dir, "events").select("event_id", clock.alias("clock"), F.coalesce(text.seconds_of(padded), F.lit(-1)).alias("seconds"))


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'https://www.youtube.com/watch?v=abcdefghij' || event_id % 10 || coalesce('&t=' || s || 's', '') END, 'https://a.example/' || user_id || '.mp3' || coalesce('#t=' || s, '')) AS media,
  '?e=u' || user_id || '&s=u' || user_id || '%23q' || event_id AS link, '#q' || event_id AS label FROM (SELECT *, CASE WHEN event_id % 5 <> 0 THEN event_id % 4000 END AS s FROM events)""")
def media_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, user = F.col("event_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    start, video = F.when(e % 5 != 0, e % 4000), F.when(e % 3 == 0, F.concat(F.lit("abcdefghij"), (e % 10).cast("string")))
    segment_id = F.concat(user, F.lit("#q"), e.cast("string"))
    audio = F.concat(F.lit("https://a.example/"), F.col("user_id").cast("string"), F.lit(".mp3"))
    return table(spark, sf_dir, "events").select("event_id", text.media_url(video, audio, start).alias("media"), text.deep_link(user, segment_id).alias("link"), text.question_label(segment_id).alias("label"))


CUES = """cues AS (SELECT user_id AS episode_id, event_id, epoch_us(ts) // 1000000 AS start_sec, epoch_us(ts) // 1000000 + 5 AS end_sec, event_type || CASE WHEN event_id % 3 = 0 THEN '?' ELSE '' END AS text FROM events)"""


def _cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as caption cues on each user's time axis."""
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"), "event_id", at.alias("start_sec"), (at + 5).alias("end_sec"), F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "?").otherwise("")).alias("text"))


@query(f"""WITH {CUES}, spans AS (SELECT episode_id, event_id AS span_id, start_sec AS f, start_sec + 20000 AS u FROM cues WHERE ends_with(text, '?'))
SELECT s.span_id, string_agg(text, ' ' ORDER BY start_sec, text) AS text FROM spans s JOIN cues c ON s.episode_id = c.episode_id AND start_sec >= f AND start_sec < u GROUP BY s.span_id""")
def caption_interval_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said in the 20,000 seconds from each asking cue."""
    cues = _cues(spark, sf_dir)
    spans = cues.where(F.endswith("text", F.lit("?"))).select("episode_id", F.col("event_id").alias("span_id"), F.col("start_sec").alias("from_sec"), (F.col("start_sec") + 20000).alias("until_sec"))
    return align.text_between(cues, spans, 20_000).select("span_id", "text")


@query(f"""WITH {CUES}, c AS (SELECT *, lead(start_sec) OVER (PARTITION BY episode_id ORDER BY start_sec, end_sec, text) AS nxt FROM cues),
q AS (SELECT episode_id, event_id AS question_id, start_sec AS asked, start_sec + 4 AS earliest FROM cues WHERE ends_with(text, '?')),
spoken AS (SELECT question_id, min({{'a': c.start_sec, 'v': coalesce(nxt, end_sec)}}).v AS spoken FROM q JOIN c ON q.episode_id = c.episode_id AND c.start_sec BETWEEN asked AND earliest + 12
  WHERE ends_with(c.text, '?') AND end_sec >= earliest GROUP BY question_id),
later AS (SELECT q.*, c.start_sec AS later FROM q ASOF LEFT JOIN cues c ON q.episode_id = c.episode_id AND q.earliest <= c.start_sec)
SELECT question_id, CAST(coalesce(spoken, later, earliest) AS BIGINT) AS answer_sec FROM later LEFT JOIN spoken USING (question_id)""")
def caption_asof_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the answer to each asking cue begins. The tables' cues are hours apart, so slices are of a day."""
    cues = _cues(spark, sf_dir)
    asked = cues.where(F.endswith("text", F.lit("?"))).select("episode_id", F.col("event_id").alias("question_id"), F.lit("What now?").alias("question_text"), "start_sec", F.lit(None).cast("double").alias("next_sec"))
    return align.answer_starts(asked, cues.drop("event_id"), 86_400)


STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
FLAT = "regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')"
CONTENT = "list_filter(string_split(" + FLAT + f", ' '), lambda w: length(w) > 2 AND NOT list_contains([{STOP}], w))"


@query(f"""WITH q AS (SELECT item_id, list_distinct({CONTENT.format('text')}) AS w FROM benchmark), c AS (SELECT conv_id, turn, {FLAT.format("coalesce(text, '')")} AS flat FROM conversations),
hits AS (SELECT item_id, conv_id, turn, round(CAST(len(list_filter(w, lambda x: contains(flat, x))) AS DOUBLE) / len(w), 6) AS score FROM q, c)
SELECT item_id, conv_id, turn, score FROM hits WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, conv_id, turn) = 1""")
def caption_align_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text's best turn: the largest share of its words that are part of the turn's text."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(text.content_words(F.col("text"))).alias("words"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", align.flat(F.coalesce("text", F.lit(""))).alias("flat"))
    return align.best_overlaps(asked, turns, "item_id", "conv_id", "turn").select("item_id", "conv_id", "turn", F.round("share", 6).alias("score"))


def _turns_and_cues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """User turns as questions, and all turns as cues of their conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    cues = turns.select(F.col("conv_id").alias("episode_id"), (F.col("turn") * 30).alias("start_sec"), (F.col("turn") * 30 + 25).alias("end_sec"), "text")
    second = F.get(text.content_words(F.col("text")), F.lit(1))
    name = F.when(F.length(second) > 1, F.substr(second, F.lit(1), F.length(second) - 1))
    asked = turns.where("role = 'user'").select(F.col("conv_id").alias("episode_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question_text"), F.array_compact(F.array(name)).alias("speaker_names"), F.lit(0).alias("from_sec"), F.lit(None).cast("double").alias("until_sec"))
    return asked, cues


ALIGNED = f"""turns AS (SELECT conv_id AS e, turn, turn * 30 AS sec, turn * 30 + 25 AS ends, coalesce(text, '') AS t, role FROM conversations),
cues AS (SELECT e, sec, ends, t, {FLAT.format('t')} AS flat, {CONTENT.format('t')} AS heard FROM turns),
ahead AS (SELECT a.e, a.sec, {FLAT.format("string_agg(b.t, ' ' ORDER BY b.sec)")} AS ahead FROM cues a JOIN cues b ON a.e = b.e AND b.sec >= a.sec AND b.sec < a.sec + 100 GROUP BY a.e, a.sec),
q AS (SELECT e * 1000 + turn AS question_id, e, {CONTENT.format('t')} AS w FROM turns WHERE role = 'user'),
named AS (SELECT *, [w[2][:-2]] AS name FROM q),
met AS (SELECT n.*, c.sec, c.ends, c.flat, c.heard, a.ahead FROM named n JOIN cues c USING (e) JOIN ahead a USING (e, sec)),
judged AS (SELECT *, CASE WHEN length(coalesce(name[1], '')) > 2 AND NOT list_contains([{STOP}], name[1]) AND len(list_filter(heard, lambda c: c = name[1] OR starts_with(c, name[1][1:4])
    OR (length(name[1]) >= 5 AND levenshtein(name[1], c) <= greatest(1, length(name[1]) // 4)))) > 0 THEN 1.0 ELSE 0.0 END AS named,
  len(list_filter(w[1:8], lambda x: contains(flat, x))) > 0 AS opens, list_filter(w, lambda x: contains(ahead, x))[1] AS first_word, list_distinct(w) AS dw FROM met),
scored AS (SELECT question_id, sec, ends, CASE WHEN len(dw) > 0 THEN CAST(len(list_filter(dw, lambda x: contains(ahead, x))) AS DOUBLE) / len(dw) ELSE 0.0 END + named * CAST(0.8 AS DOUBLE)
  - coalesce(least(CAST(0.8 AS DOUBLE), CAST(strpos(ahead, first_word) - 1 AS DOUBLE) / 150), CAST(0.8 AS DOUBLE)) AS score FROM judged WHERE named > 0 OR opens)"""


@query(f"WITH {ALIGNED} SELECT question_id, CAST(sec AS BIGINT) AS start_sec, CAST(ends AS BIGINT) AS answer_start_sec, round(score, 6) AS score FROM scored WHERE score >= 0.45 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, sec) = 1")
def caption_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user turn's text is introduced in its conversation, turns being cues of 25 seconds; its second word, without its end, is a name."""
    found = align.align(*_turns_and_cues(spark, sf_dir))
    return found.select("question_id", F.col("start_sec").cast("long").alias("start_sec"), F.col("answer_start_sec").cast("long").alias("answer_start_sec"), F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {ALIGNED},
cand AS (SELECT e, w.question_id % 1000 AS place, sec, CAST(round(score * 1000000) AS BIGINT) AS weight FROM scored w JOIN q USING (question_id) WHERE score >= 0.45),
step AS (SELECT *, dense_rank() OVER (PARTITION BY e ORDER BY place) AS k FROM cand),
chain AS (
  SELECT DISTINCT e, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS sec, CAST(0 AS BIGINT) AS total, CAST([] AS BIGINT[]) AS path FROM cand
  UNION ALL (
    SELECT e, k + 1, sec, total, path FROM chain WHERE k < (SELECT max(k) FROM step)
    UNION ALL
    SELECT e, k, sec, total, path FROM (
      SELECT s.e, s.k, CAST(s.sec AS BIGINT) AS sec, c.total + s.weight AS total, list_prepend(CAST(s.place * 1000000 + s.sec AS BIGINT), c.path) AS path,
             row_number() OVER (PARTITION BY s.e, s.sec ORDER BY c.total + s.weight DESC, c.path) AS nth
      FROM chain c JOIN step s ON c.e = s.e AND s.k = c.k + 1 AND s.sec > c.sec) WHERE nth = 1)),
best AS (SELECT e, path FROM chain WHERE k = (SELECT max(k) FROM step) QUALIFY row_number() OVER (PARTITION BY e ORDER BY total DESC, path) = 1),
chosen AS (SELECT e, v // 1000000 AS place, v % 1000000 AS sec FROM (SELECT e, unnest(path) AS v FROM best)),
known AS (SELECT q.e, q.question_id % 1000 AS place, q.question_id, sec, least(1.0, weight / 1000000) AS sure FROM q
  LEFT JOIN (SELECT e, place, sec, weight FROM chosen JOIN cand USING (e, place, sec)) c ON q.e = c.e AND q.question_id % 1000 = c.place),
around AS (SELECT *, last_value(CASE WHEN sec IS NOT NULL THEN {{'p': place, 's': sec, 'c': sure}} END IGNORE NULLS) OVER (PARTITION BY e ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
  first_value(CASE WHEN sec IS NOT NULL THEN {{'p': place, 's': sec, 'c': sure}} END IGNORE NULLS) OVER (PARTITION BY e ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM known)
SELECT question_id, CAST(CASE WHEN sec IS NOT NULL THEN sec WHEN a IS NOT NULL AND z IS NOT NULL THEN floor(a.s + (z.s - a.s) * (CAST(place - a.p AS DOUBLE) / (z.p - a.p))) END AS BIGINT) AS start_sec,
  round(CASE WHEN sec IS NOT NULL THEN sure WHEN a IS NOT NULL AND z IS NOT NULL THEN least(a.c, z.c) / 2 ELSE 0.0 END, 6) AS confidence FROM around""")
def caption_times_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time for each user turn: cues chosen together so that they follow the turns' order, times in between for the others."""
    asked, cues = _turns_and_cues(spark, sf_dir)
    places = asked.select("episode_id", "question_id", (F.col("question_id") % 1000).alias("place"))
    sure = align.candidates(asked, cues).where(F.col("score") >= align.ACCEPT)
    chosen = timeline.in_order(sure.join(places, ["episode_id", "question_id"]))
    return timeline.between(places, chosen).select("question_id", "start_sec", F.round("confidence", 6).alias("confidence"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")).where("k is not null")


@query("""SELECT user_id AS episode_id, round(epoch_us(ts) // 1000 / 1000.0, 3) AS start_sec, round((epoch_us(ts) // 1000 + event_id % 4000) / 1000.0, 3) AS end_sec, event_type || ' then ' || event_id AS text FROM events WHERE event_id % 9 <> 0""")
def caption_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a caption file of pieces, parsed back; a ninth of them has no text."""
    e = F.col("event_id")
    pieces = F.when(e % 9 == 0, F.array(F.lit(" "))).otherwise(F.array("event_type", F.lit(" then\n"), e.cast("string")))
    event = F.struct(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("tStartMs"), (e % 4000).alias("dDurationMs"), F.transform(pieces, lambda x: F.struct(x.alias("utf8"))).alias("segs"))
    files = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("episode_id")).agg(F.to_json(F.struct(F.collect_list(event).alias("events"))).alias("json"))
    return captions.parse(files).select("episode_id", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"), "text")


@query("""SELECT user_id, query, mode, "at", "rank" FROM (SELECT user_id, CAST(event_id % 40 AS VARCHAR) AS query, event_type AS mode, max(epoch_us(ts)) AS "at",
  row_number() OVER (PARTITION BY user_id ORDER BY max(epoch_us(ts)) DESC, CAST(event_id % 40 AS VARCHAR), event_type) AS "rank" FROM events GROUP BY user_id, CAST(event_id % 40 AS VARCHAR), event_type) WHERE "rank" <= 5""")
def recent_searches_mru(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 40).cast("string").alias("query"), F.col("event_type").alias("mode"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return session.recent_searches(asked)


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def stale_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.newest_response(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "value")


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at_ms"))


TIMED = "timed AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000 AS at_ms FROM events)"


@query(f"""WITH {TIMED}, w AS (SELECT *, lead(event_type) OVER o AS nxt, lead(at_ms) OVER o - at_ms AS after_ms FROM timed WINDOW o AS (PARTITION BY user_id ORDER BY at_ms, event_id))
SELECT user_id, at_ms AS first_ms, nxt AS event_type, after_ms FROM w WHERE event_type = (SELECT min(event_type) FROM events) AND nxt <> event_type AND after_ms < 3600000""")
def chord_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event of the first kind whose next one is of another kind within the hour (the tables' events are minutes apart)."""
    timed = _timed(spark, sf_dir)
    kinds = sorted(r.event_type for r in timed.select("event_type").distinct().collect())  # a handful of kinds
    return session.chords(timed, kinds[0], tuple(kinds[1:]), 3_600_000)


@query(f"""WITH {TIMED}, w AS (SELECT *, lead(at_ms) OVER (PARTITION BY user_id ORDER BY at_ms, event_id) - at_ms AS gap FROM timed)
SELECT user_id, event_id, event_type, at_ms FROM w WHERE gap IS NULL OR gap >= 3600000""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.settled(_timed(spark, sf_dir), 3_600_000)


@query(f"SELECT segment_id, rank FROM (SELECT segment_id, row_number() OVER (ORDER BY score DESC, start_sec DESC, segment_id) AS rank FROM ({_keyword_sql(TERMS, select='*')})) WHERE rank > 24 AND rank <= 48")
def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = fusion.ranked(_rank(spark, sf_dir, TERMS), "rank", F.desc("score"), F.desc("start_sec"), "segment_id")
    return present.page(ranked, 1).select("segment_id", "rank")


@query(f"WITH {SEG} SELECT shard, count(*) AS segments, CAST(sum(length(question) + length(answer)) AS BIGINT) AS chars, max(length(question) + length(answer)) AS longest FROM seg GROUP BY shard")
def shard_stats_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.shard_stats(segments(spark, sf_dir))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'Year: ' || lang END, CASE WHEN source IN ('src1', 'src2') THEN 'Episode: AMA ' || substr(source, 4) END,
  CASE doc_id % 4 WHEN 0 THEN 'Intro' WHEN 1 THEN 'Answers' WHEN 2 THEN 'Questions' END], lambda x: x IS NOT NULL), '; ') AS chips FROM documents""")
def filter_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    states = table(spark, sf_dir, "documents").select("doc_id", F.when(d % 3 == 0, F.col("lang")).otherwise("").alias("year"), F.col("source").alias("episode"), F.when(d % 4 == 0, "intro").when(d % 4 == 1, "answer").when(d % 4 == 2, "question").otherwise("all").alias("type"))
    known = spark.createDataFrame([("src1", 1), ("src2", 2)], "id string, number int")
    return facets.chips(states, known).select("doc_id", F.array_join(F.transform("chips", lambda c: c["label"]), "; ").alias("chips"))


@query("SELECT doc_id, coalesce(doc_id - lag(doc_id) OVER w, 0) AS back, coalesce(lead(doc_id) OVER w, doc_id) AS onward FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def segment_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments before and after each within its episode, held at the ends."""
    rows = order.neighbours(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")
    return rows.select("doc_id", (F.col("doc_id") - F.col("before")).alias("back"), F.col("after").alias("onward"))

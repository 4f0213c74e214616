"""The registered queries of the training-data operators, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import op1_quality_cnn, op2_byte_bpe, op3_simhash, op4_toxicity, op5_voronoi_knn, op6_host_reputation, op7_balanced_shards, op8_quality_rules, op9_soft_mixing, op10_pii_crf, op11_repeated_passages, op12_crc_resampling, op13_heap_lloyd
from colloquy.llm.common import table, tune


def op1_quality_cnn_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    return op1_quality_cnn.score(docs, op1_quality_cnn.fit(docs, table(spark, sf_dir, "labels")))


#: The rank file of the registered query and the pipeline.
RANKS = "byte_bpe_multi_50k.tiktoken"


def vocabulary() -> tuple[str, str]:
    """The place of the rank file and the pattern that splits texts."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def op2_byte_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return op2_byte_bpe.encode(table(spark, sf_dir, "documents"), *vocabulary())


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return op3_simhash.report(table(spark, sf_dir, "documents"))


def op4_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    return op4_toxicity.score(docs, op4_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_voronoi_knn_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return op5_voronoi_knn.search(table(spark, sf_dir, "embeddings"))


def op6_host_reputation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_host_reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op7_balanced_shards_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_balanced_shards.shard(table(spark, sf_dir, "documents"))


def op9_soft_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    return op9_soft_mixing.rates(docs, op9_soft_mixing.labelled_domains(docs, table(spark, sf_dir, "labels")), op9_soft_mixing.TARGETS)


def op10_pii_crf_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return op10_pii_crf.find(table(spark, sf_dir, "documents"), op10_pii_crf.train())


def op8_quality_rules_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    return op8_quality_rules.judge(docs, op8_quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op11_repeated_passages_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return op11_repeated_passages.repeats(table(spark, sf_dir, "documents"))


def op12_crc_resampling_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return op12_crc_resampling.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_heap_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return op13_heap_lloyd.report(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_cnn": op1_quality_cnn_scores,
        "op2_byte_bpe": op2_byte_bpe_digests,
        "op3_simhash": op3_simhash_components,
        "op4_toxicity": op4_toxicity_scores,
        "op5_voronoi_knn": op5_voronoi_knn_top10,
        "op6_host_reputation": op6_host_reputation_verdicts,
        "op7_balanced_shards": op7_balanced_shards_rows,
        "op8_quality_rules": op8_quality_rules_verdicts,
        "op9_soft_mixing": op9_soft_mixing_rates,
        "op10_pii_crf": op10_pii_crf_spans,
        "op11_repeated_passages": op11_repeated_passages_cut,
        "op12_crc_resampling": op12_crc_resampling_draw,
        "op13_heap_lloyd": op13_heap_lloyd_codes,
    }


#: Brute force over every pair of a query and a vector.
OP5_SQL = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM valid q JOIN valid d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id
)
SELECT query_id, CAST(rn AS INTEGER) AS "rank", vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM scored)
WHERE rn <= 10
"""


def _spread(children: str, parent: str, column: str) -> str:
    """The strength of a prior, as op6_host_reputation.strength has it."""
    return f"""(
  SELECT CASE WHEN spread IS NULL OR spread <= chance OR room = 0 THEN 200.0
              ELSE least(greatest(room / (spread - chance) - 1, 1.0), 200.0) END
  FROM (SELECT sum(c.n * pow(c.bad / c.n - p.bad / p.n, 2)) AS spread, sum(p.bad / p.n * (1 - p.bad / p.n)) AS chance,
               sum(p.bad / p.n * (1 - p.bad / p.n) * (c.n - 1)) AS room
        FROM {children} c JOIN {parent} p USING ({column}) WHERE c.n > 0))"""


def _op6_sql() -> str:
    """Written out rather than taken from the module that it checks; longest rules first."""
    upper, lower, second = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "ac|co|com|edu|gov|net|org"
    rules = [
        ("www.example.com/en/", "allow", "(host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/')"),
        ("example.com/en/", "block", "(host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/')"),
        ("net/es/", "block", "(host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/')"),
        ("net/fr/", "block", "(host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/')"),
        ("com/", "allow", "(host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/')"),
    ]
    rule = "CASE " + " ".join(f"WHEN {fits} THEN '{name}'" for name, _, fits in rules) + " END"
    action = "CASE " + " ".join(f"WHEN {fits} THEN '{verdict}'" for _, verdict, fits in rules) + " END"
    return f"""
WITH found AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{upper}', '{lower}') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), outcome AS (
  SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id
), counted AS (
  SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad
  FROM (SELECT DISTINCT page_id, host FROM found) JOIN outcome ON page_id = doc_id GROUP BY host
), named AS (
  SELECT DISTINCT host, regexp_replace(host, ':[0-9]*$', '') AS name FROM found
), parted AS (
  SELECT host, name, CASE WHEN regexp_extract(name, '((?:^|\\.)(?:{second})\\.[a-z][a-z])$', 1) <> ''
                          THEN ltrim(regexp_extract(name, '((?:^|\\.)(?:{second})\\.[a-z][a-z])$', 1), '.')
                          ELSE list_extract(string_split(name, '.'), -1) END AS suffix
  FROM named
), hosts AS (
  SELECT host, suffix, CASE WHEN before = '' THEN suffix ELSE list_extract(string_split(before, '.'), -1) || '.' || suffix END AS domain,
         '' AS root, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad
  FROM (SELECT *, rtrim(substr(name, 1, greatest(length(name) - length(suffix), 0)), '.') AS before FROM parted) LEFT JOIN counted USING (host)
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, root, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
roots AS (SELECT root, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
domain_n AS (SELECT domain, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
w AS (SELECT {_spread("suffixes", "roots", "root")} AS suffix_w, {_spread("domains", "suffixes", "suffix")} AS domain_w, {_spread("hosts", "domain_n", "domain")} AS host_w,
             ((SELECT sum(bad) FROM hosts) + 1) / ((SELECT sum(n) FROM hosts) + 2) AS share),
suffix_m AS (SELECT suffix, (bad + suffix_w * share) / (n + suffix_w) AS m FROM suffixes, w),
domain_m AS (SELECT domain, (d.bad + domain_w * s.m) / (d.n + domain_w) AS m FROM domains d JOIN suffix_m s USING (suffix), w),
posterior AS (SELECT host, h.bad + host_w * d.m AS a, h.n - h.bad + host_w * (1 - d.m) AS b FROM hosts h JOIN domain_m d USING (domain), w),
blocked AS (
  SELECT host FROM posterior
  WHERE a / (a + b) - 1.64 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > 0.5
)
SELECT page_id, host, path, {rule} AS rule,
       coalesce({action}, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' END, 'allow') AS verdict
FROM found
"""


#: Every window as a text of its own.
OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p
  FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1
), words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: CRC-32 byte by byte over the distinct features, with its table made from the polynomial.
OP12_SQL = r"""
WITH RECURSIVE steps(b, c, k) AS (
  SELECT b, b, 0 FROM range(256) r(b)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
texts AS (SELECT doc_id, 0 AS kind, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark),
split AS (
  SELECT doc_id, kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS (
  SELECT doc_id, kind, array_to_string(w[i:i + g - 1], ' ') AS f
  FROM (SELECT doc_id, kind, w, g, unnest(range(1, len(w) - g + 2)) AS i FROM split, (VALUES (1), (2), (3)) v(g))
), counted AS (SELECT doc_id, kind, f, count(*) AS n FROM runs GROUP BY ALL),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: 16 * (strpos('0123456789ABCDEF', h[i]) - 1) + strpos('0123456789ABCDEF', h[i + 1]) - 1)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM hexed, crc
), placed AS (SELECT doc_id, kind, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
cells AS (SELECT bucket, sum(n) FILTER (kind = 0) AS s, sum(n) FILTER (kind = 1) AS t FROM placed GROUP BY bucket),
whole AS (SELECT CAST(coalesce(sum(s), 0) + 10000 AS DOUBLE) AS s_all, CAST(coalesce(sum(t), 0) + 10000 AS DOUBLE) AS t_all FROM cells),
gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * s_all / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * t_all))) AS BIGINT) AS gain FROM cells, whole),
weights AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM placed JOIN gains USING (bucket) WHERE kind = 0 GROUP BY doc_id),
noise AS (
  SELECT doc_id, len(w) AS words, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', sha256('42:' || doc_id)[i]) - 1)), lambda a, b: 16 * a + b) AS h FROM split WHERE kind = 0
), scored AS (
  SELECT doc_id, words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM noise LEFT JOIN weights USING (doc_id)
), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT 5 * count(*) // 100 FROM ranked) THEN r END AS "rank" FROM scored LEFT JOIN ranked USING (doc_id)
"""


def _op13_sql() -> str:
    """Every round compares every part with every entry."""
    assigned = """SELECT vec_id, label, part, i, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (
  SELECT x.*, e, CAST(list_sum(list_transform(list_zip(x.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS dist FROM parts x JOIN {} b USING (part)) GROUP BY ALL"""
    steps = []
    for k in range(5):
        steps.append(f"a{k} AS MATERIALIZED ({assigned.format(f'b{k}')})")
        if k < 4:
            steps.append(f"""cells{k} AS (SELECT a.part, a.e, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS d FROM a{k} a JOIN parts USING (i, part)),
means{k} AS (SELECT part, e, list(m ORDER BY d) AS v FROM (SELECT part, e, d, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM cells{k} GROUP BY ALL) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN means{k} m USING (part, e))""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS i
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, label, i, part, v[part * (len(v) // 4) + 1:(part + 1) * (len(v) // 4)] AS v FROM kept, range(4) r(part)
), b0 AS MATERIALIZED (SELECT part, i AS e, v FROM parts WHERE i < 256),
{", ".join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b4),
coded AS (SELECT vec_id, label, i, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a4 GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_voronoi_knn": OP5_SQL, "op6_host_reputation": _op6_sql(), "op11_repeated_passages": OP11_SQL, "op12_crc_resampling": OP12_SQL, "op13_heap_lloyd": _op13_sql()}

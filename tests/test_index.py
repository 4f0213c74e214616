"""Near spellings and the stored index against plain comparisons."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text
from colloquy.operators import keyword, spelling
from colloquy.sources import index

SEGMENTS = "segment_id long, episode_id string, shard string, type string, start_sec int, question string, answer string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited(rng, word, n):
    for _ in range(n):
        at, how = rng.randrange(len(word) + 1), rng.randrange(3)
        word = word[:at] + (rng.choice("abcd") if how < 2 else "") + word[at + (how > 0) :]
    return word


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(21)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))) for _ in range(500)}
    words |= {edited(rng, w, rng.randint(1, 3)) for w in sorted(words) for _ in range(2)} | {"x" * 40, "x" * 41 + "y", "ab" * 3000}
    return sorted(w for w in words if w)


def test_near_pairs_are_those_of_comparing_all(spark, vocabulary):
    asked = vocabulary[::9] + ["x" * 39, "", "abc", "ab" * 2999 + "aa"]
    words = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    got = {(r.term, r.word) for r in spelling.near(spark.createDataFrame([(t,) for t in asked], "term string"), spelling.index(words)).collect()}
    allowed = lambda t: 0 if len(t) < 4 else 1 if len(t) < 8 else 2
    near = lambda t, w: abs(len(t) - len(w)) <= allowed(t) and (t[:900] == w[:900] or max(len(t), len(w)) < 900) and distance(t[-90:] if len(t) > 900 else t, w[-90:] if len(w) > 900 else w) <= allowed(t)
    assert got == {(t, w) for t in asked if len(t) > 3 for w in vocabulary if near(t, w)}
    assert ("x" * 39, "x" * 41 + "y") not in got and ("x" * 39, "x" * 40) in got


def test_keys_of_a_word_are_bounded(spark):
    row = spark.sql("select 'abcdefghijklmnopqrstuvwxyz' word").select(F.size(spelling.keys(F.col("word"), F.lit(2))).alias("n")).head()
    assert row.n == 1 + 10 + 45


def test_the_join_has_no_product_and_examines_few_pairs(spark, vocabulary):
    words, terms = (spark.createDataFrame([(w,) for w in rows], f"{name} string") for rows, name in ((vocabulary, "word"), (vocabulary[::9], "term")))
    found = spelling.near(terms, spelling.index(words))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # random words over four letters are as dense as words can be; still only a small part of all pairs meets
    met = spelling.asked(terms).join(spelling.index(words), "key").count()
    assert met < 0.1 * len(vocabulary) * len(vocabulary[::9])


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory, vocabulary):
    rng = random.Random(5)
    rows = [(k, f"e{k % 5}", ["2023", "2024", None][k % 3], ["question", "intro"][k % 2], k % 7 or None, " ".join(rng.choices(vocabulary, k=4)), " ".join(rng.choices(vocabulary, k=30))) for k in range(90)]
    segments = spark.createDataFrame(rows, SEGMENTS).cache()
    return index.Store(lambda: segments, str(tmp_path_factory.mktemp("index"))), segments


def test_stored_and_live_ranking_agree(spark, store, vocabulary, monkeypatch):
    tables, segments = store
    live = keyword.postings(segments)
    for k, terms in enumerate([vocabulary[3:6], [edited(random.Random(4), w, 1) for w in vocabulary[40:44]], ["zzzzzzzz"], []]):
        for limit in (1000, 0):
            monkeypatch.setattr(keyword, "LITERALS", limit)
            own = keyword.rank(tables.read("keyword"), segments, terms, spellings=tables.read("spellings"))
            other = keyword.rank(live, segments, terms)
            assert own.collect() == other.collect(), (k, limit)


def test_prefix_blocks_suggest_as_the_dictionary_does(spark, store):
    tables, segments = store
    words = keyword.dictionary(segments)
    assert sorted(map(str, tables.read("autocomplete").select(words.columns).collect())) == sorted(map(str, words.collect()))
    for prefix in ("a", "ab", "abc", "dcba", "x", "q"):
        whole = keyword.suggest(words, prefix).collect()
        assert keyword.suggest(tables.read("prefixes"), prefix).collect() == whole, prefix


def test_ranks_of_terms_are_those_of_a_sort(spark, store):
    _, segments = store
    counts = {}
    for r in keyword.terms_of(segments).collect():
        counts.setdefault(r.shard, {}).setdefault(r.term, [0])[0] += 1
    got = {(r.shard, r.rk): (r.term, r.freq) for r in keyword.dictionary(segments, 50).collect()}
    want = {(s, k): (t, n) for s, terms in counts.items() for k, (t, (n,)) in enumerate(sorted(terms.items(), key=lambda x: (-x[1][0], x[0]))[:50], 1)}
    assert got == want


def test_another_state_of_the_files_is_another_digest(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    first = index.files_state(spark.read.parquet(path))
    assert first == index.files_state(spark.read.parquet(path))
    spark.range(1).write.mode("append").parquet(path)
    assert first != index.files_state(spark.read.parquet(path))


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Some thousand segments of very unlike length, so that blocks differ."""
    rng = random.Random(13)
    pool = [f"word{k:03d}" for k in range(200)]
    rows = []
    for k in range(5000):
        n = int(3 * 1.0016**k) % 900 + 3
        rows.append((k, f"e{k % 9}", ["2023", "2024"][k % 2], ["question", "answer", "intro"][k % 3], k % 100, rng.choice(pool), " ".join(rng.choices(pool, weights=range(1, 201), k=n))))
    segments = spark.createDataFrame(rows, SEGMENTS).cache()
    return index.Store(lambda: segments, str(tmp_path_factory.mktemp("blocks"))), segments


@pytest.mark.parametrize("chosen", [{}, {"type": "intro"}, {"type": "question", "episode_id": "e3"}, {"episode_id": "none"}])
def test_blocks_rank_as_the_whole_index_and_few_are_read(spark, large, monkeypatch, chosen):
    tables, segments = large
    monkeypatch.setattr(keyword, "FIRST_BLOCKS", 4)
    terms = ["word150", "word199", "word003", "wrod1777"]
    whole = keyword.rank(tables.read("keyword"), segments, terms, chosen.get("type", "all"), chosen.get("episode_id", ""), n=60, spellings=tables.read("spellings"))
    found, read = keyword.rank_blocks(tables.read("blocks"), tables.read("tops"), terms, ["2023", "2024"], chosen, tables.read("bitmaps"), 60, tables.read("spellings"))
    assert found.select(whole.columns).collect() == whole.collect()
    if not chosen:
        assert read["blocks"] == 40 and read["read"] < 20  # of 5,000 segments, 128 a block


def test_bitmaps_hold_the_places_of_their_segments(spark, large):
    tables, segments = large
    rows = tables.read("blocks").select("segment_id", "place", "type", "episode_id").distinct().collect()
    assert sorted(r.place for r in rows) == list(range(5000))
    left = keyword.allowed(tables.read("bitmaps"), {"type": "intro", "episode_id": "e2"}).collect()
    bits = {(r.bucket - 1) * 32768 + 8 * k + b for r in left for k, byte in enumerate(r.bits) for b in range(8) if byte >> b & 1}
    assert bits == {r.place for r in rows if (r.type, r.episode_id) == ("intro", "e2")}


def test_a_second_build_pools_nothing(spark, tmp_path):
    from colloquy.sources import artifacts

    rows = [(k, "e", "2024", "question", k, f"cats and dogs {k}", "unknown" if k == 3 else f"dogs sleep {k} nights") for k in range(8)]
    segments = spark.createDataFrame(rows, SEGMENTS)
    words = spark.createDataFrame([("cats", 1.5, [1.0, 0.0]), ("dogs", 2.0, [0.6, 0.8])], "term string, idf double, vec array<double>")
    stored, path = artifacts.word_table(words), str(tmp_path / "cache")
    first, made = artifacts.cached_vectors(segments, stored, path)
    direct = artifacts.passage_vectors(segments, artifacts.query_words(stored))
    key = lambda df: sorted(map(str, df.collect()))
    assert made == 16 and key(artifacts.passage_vectors(segments, None, first)) == key(direct) and direct.count() == 15
    again, made = artifacts.cached_vectors(segments, stored, path)
    assert made == 0 and key(again) == key(first)
    changed = segments.withColumn("answer", F.when(F.col("segment_id") == 5, "cats").otherwise(F.col("answer")))
    third, made = artifacts.cached_vectors(changed, stored, path)
    assert made == 1 and key(artifacts.passage_vectors(changed, None, third)) == key(artifacts.passage_vectors(changed, artifacts.query_words(stored)))
    other = artifacts.word_table(words.where("term = 'cats'"))
    assert artifacts.cached_vectors(segments, other, path)[1] == 16


def test_near_words_come_from_a_vocabulary_without_keys(spark, store, vocabulary):
    """One row a word is stored, whatever its length, and a query compares it with what a shard lacks."""
    tables, _ = store
    stored = tables.read("spellings")
    words = tables.read("keyword").select("shard", F.col("term").alias("word")).distinct()
    assert sorted(stored.columns) == ["shard", "word"] and stored.count() == words.count()
    rng = random.Random(3)
    lacking = [(s, edited(rng, w, 1), n) for n, w in enumerate(vocabulary[60:66], 1) for s in ("2023", "2024")]
    near = {(r.shard, r.word): r.n for r in keyword.near_words(tables.read("keyword"), lacking, stored).collect()}
    terms = spark.createDataFrame(lacking, "shard string, term string, n int")
    plain = terms.join(words, "shard").where(text.close_words(F.col("term"), F.col("word"))).groupBy("shard", "word").agg(F.sum("n").alias("n"))
    assert near and near == {(r.shard, r.word): r.n for r in plain.collect()}


def test_postings_of_one_segment_meet_without_a_shuffle_of_postings(store):
    plan = keyword.postings(store[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(segment_id" in plan

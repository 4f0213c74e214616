import pytest
from pyspark.sql import functions as F

from colloquy.operators import facets, fusion, keyword, present, semantic, session
from colloquy.plans.engine import Engine
from colloquy.plans.query_state import QueryState
from colloquy.sources import artifacts

ROWS = [
    ("s1", "e1", "2024", "question", 10, "What is time", "time is a coordinate and time is relative"),
    ("s2", "e1", "2024", "intro", None, "", "welcome to the show about entropy"),
    ("s3", "e2", "2023", "question", 30, "Why entropy", "the arrow follows entropy"),
    ("s4", "e2", "2023", "question", 30, "Why entrepy", "nothing here"),
]
SCHEMA = "segment_id string, episode_id string, shard string, type string, start_sec int, question string, answer string"
CORPUS = ["cats purr and cats sleep on soft beds", "cats sleep on soft beds and purr", "soft beds make cats purr and sleep", "atoms collide and quarks bind in dense plasma", "quarks bind atoms in dense plasma", "dense plasma makes quarks and atoms collide"]


@pytest.fixture(scope="module")
def seg(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def scores(df):
    return {r.segment_id: r.score for r in df.collect()}


def test_exact_hits_weigh_ten_and_questions_four(spark, seg):
    # question "time" 4, answer "time" twice
    assert scores(keyword.rank(keyword.postings(seg), seg, ["time"])) == {"s1": 60}
    assert scores(keyword.rank(keyword.postings(seg), seg, ["time", "time", "unknownword"])) == {"s1": 120}


def test_near_words_count_only_where_the_shard_lacks_the_term(spark, seg):
    # 2023 has "entropy"; there "entrepy" is no near hit. 2024 has it too
    assert scores(keyword.rank(keyword.postings(seg), seg, ["entropy"])) == {"s2": 10, "s3": 50}
    # no shard has "entrapy": near words count once each
    assert scores(keyword.rank(keyword.postings(seg), seg, ["entrapy"])) == {"s2": 1, "s3": 5, "s4": 4}


def test_a_filter_does_not_make_a_term_missing(spark, seg):
    assert scores(keyword.rank(keyword.postings(seg), seg, ["entropy"], "intro")) == {"s2": 10}
    assert scores(keyword.rank(keyword.postings(seg), seg, ["entropy"], "question", "e2", ["2023"])) == {"s3": 50}


def test_browsing_orders_by_start_with_null_as_zero(spark, seg):
    assert [r.segment_id for r in keyword.rank(keyword.postings(seg), seg, []).collect()] == ["s3", "s4", "s1", "s2"]


def test_suggestions_take_newer_shards_first(spark, seg):
    words = keyword.dictionary(seg)
    assert [r.term for r in keyword.suggest(words, "en").orderBy("position").collect()] == ["entropy", "entrepy"]
    assert keyword.suggest(words, "").count() == 0


def test_fusion_matches_hand_computed_scores(spark):
    first = spark.createDataFrame([("a", 1), ("b", 2)], "id string, first_rank long")
    second = spark.createDataFrame([("b", 1), ("c", 2)], "id string, second_rank long")
    got = fusion.fuse(first, second, "id", 3).collect()
    assert [r.id for r in got] == ["b", "a", "c"]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61)


def test_facets_chips_and_pages(spark, seg):
    counts = facets.episode_counts(seg)
    assert [(r.shard, r.n) for r in facets.shards(counts).collect()] == [("2024", 2), ("2023", 2)]
    assert facets.totals(counts).head().segments == 4
    states = spark.createDataFrame([("2024", "question", "e1"), ("", "all", "zz")], "year string, type string, episode string")
    known = spark.createDataFrame([("e1", 7)], "id string, number int")
    got = {r.episode: [c.label for c in r.chips] for r in facets.chips(states, known).collect()}
    assert got == {"e1": ["Year: 2024", "Episode: AMA 7", "Questions"], "zz": []}
    ranked = spark.range(60).select((F.col("id") + 1).alias("rank"))
    assert [r.rank for r in present.page(ranked, 2).orderBy("rank").collect()] == list(range(49, 61))


@pytest.fixture(scope="module")
def words(spark):
    docs = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id int, text string")
    return semantic.train(docs, "doc_id", F.col("text"), dimensions=4, least=1, margin=4).cache()


def test_word_vectors_keep_topics_apart(spark, words):
    assert all(abs(sum(x * x for x in r.vec) - 1) < 1e-6 for r in words.collect())
    near = [r.term for r in semantic.nearest_words(words, "quarks", 3).collect()]
    assert set(near) <= {"atoms", "plasma", "dense", "bind", "collide", "in", "makes"}
    assert semantic.nearest_words(words, "unknown").count() == 0


def test_factors_agree_with_a_dense_eigendecomposition(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a = np.abs(rng.normal(size=(12, 12)))
    a = a + a.T
    rows = [(f"t{i:02d}", f"t{j:02d}", float(a[i, j])) for i in range(12) for j in range(12)]
    got = {r.term: np.array(r.vec) for r in semantic.factorize(spark.createDataFrame(rows, "a string, b string, ppmi double"), 3, 9).collect()}
    values, vectors = np.linalg.eigh(a)
    top = [i for i in np.argsort(-values) if values[i] > 0][:3]
    want = vectors[:, top] * np.sqrt(values[top])
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    mine = np.stack([got[f"t{i:02d}"] for i in range(12)])
    assert np.allclose(mine @ mine.T, want @ want.T, atol=1e-6)


def test_pooling_drops_unknown_texts(spark, words):
    rows = spark.createDataFrame([(1, ["cats", "purr"]), (2, ["zzz"]), (3, [])], "id int, tokens array<string>")
    got = semantic.pool(rows, "id", words).collect()
    assert [r.id for r in got] == [1] and abs(sum(x * x for x in got[0].vec) - 1) < 1e-6


def test_long_answers_have_three_chunks(spark):
    answer = " ".join(f"w{i}" for i in range(900))
    rows = spark.createDataFrame([("s", 42, "Why?", answer), ("t", 1, " ", "two  words")], "segment_id string, start_sec int, question string, answer string")
    got = [r for r in semantic.passages(rows).orderBy("segment_id", "idx").collect()]
    own = [r for r in got if r.segment_id == "s"]
    assert [r.char_offset < 0 for r in own] == [True, False, False, False] and {r.start_sec for r in own} == {42}
    assert [len(r.text.split()) for r in own[1:]] == [220, 220, 220]
    assert all(answer[r.char_offset :].startswith(r.text) for r in own[1:])
    assert [r.text for r in got if r.segment_id == "t"] == ["two  words"]


def test_engine_searches_in_all_modes(spark, tmp_path):
    rows = [(f"e{i % 2}#q{i:02d}", f"e{i % 2}", "2024" if i < 3 else "2023", "question", i * 10, f"about {t.split()[0]}", t) for i, t in enumerate(CORPUS)]
    seg = spark.createDataFrame(rows, SCHEMA)
    docs = seg.select("segment_id", F.concat_ws(" ", "question", "answer").alias("text"))
    stored = artifacts.word_table(semantic.train(docs, "segment_id", F.col("text"), 4, 1, 4)).cache()
    table = artifacts.query_words(stored)
    index = keyword.postings(seg)
    words = keyword.dictionary(seg)
    engine = Engine(seg, index, keyword.prefix_blocks(words), words, vectors=artifacts.passage_vectors(seg, table), table=table)
    assert engine.search(QueryState("purr", "keyword")).count() == 3
    schemas = {tuple((f.name, f.dataType.simpleString()) for f in engine.search(QueryState(q, mode)).schema) for mode in ("keyword", "semantic", "hybrid") for q in ("purr", "zzzzzz", "")}
    assert len(schemas) == 1 and tuple(n for n, _ in schemas.pop()) == present.RESPONSE
    near = engine.search(QueryState("purr", "semantic")).collect()
    assert near[0].answer.startswith(("cats", "soft"))
    both = engine.search(QueryState("purr")).collect()
    assert both[0].found_by == "both" and [r["rank"] for r in both] == list(range(1, len(both) + 1))
    assert [k for k, _ in engine.search_progressive(QueryState("purr"))] == ["partial", "final"]
    assert engine.search(QueryState("zzzzzz", "semantic")).count() == 0
    assert engine.did_you_mean("soft pla") == "soft plasma"
    assert [s.mode for s in engine.recover(QueryState("pla", "keyword", year="2024"))] == ["keyword", "hybrid", "keyword"]
    assert engine.episode("e0").count() == 3


def test_sessions(spark):
    asked = spark.createDataFrame([(1, f" q{i % 7} ", "hybrid", i) for i in range(20)] + [(1, " ", "hybrid", 99)], "user_id int, query string, mode string, at long")
    recent = session.recent_searches(asked)
    assert [r.query for r in recent.orderBy("rank").collect()] == ["q5", "q4", "q3", "q2", "q1"]
    assert session.without(recent, "q5", "hybrid").count() == 4
    answers = spark.createDataFrame([("u", 2, "new"), ("u", 1, "old")], "k string, n int, v string")
    assert session.newest_response(answers, "k", "n", "v").head().v == "new"
    keys = spark.createDataFrame([(1, 1, "g", 0), (1, 2, "k", 500), (1, 3, "g", 2000), (1, 4, "h", 3000)], "user_id int, event_id int, event_type string, at_ms long")
    assert [(r.first_ms, r.event_type) for r in session.chords(keys, "g", ("k", "h")).collect()] == [(0, "k")]
    assert [r.event_id for r in session.settled(keys, 900).orderBy("event_id").collect()] == [2, 3, 4]


def test_dictionary_encoding_round_trips(spark):
    rows = spark.createDataFrame([(1, "the cat, the dog"), (2, "the end"), (3, "")], "k int, t string")
    words = artifacts.text_dictionary(rows, "t").where("run = 'the'").select("run", F.lit(0).alias("id"))
    coded = artifacts.encoded(rows, "k", "t", words)
    assert [p.id for p in coded.where("k = 2").head().parts] == [0, None, None]
    assert {r.k: r.text for r in artifacts.decoded(coded, "k", words).collect()} == {1: "the cat, the dog", 2: "the end"}


def test_opt_in_ranking_prefers_rare_terms(spark, seg):
    got = keyword.bm25(keyword.postings(seg), seg, ["entropy", "coordinate"]).collect()
    assert {r.segment_id for r in got} == {"s1", "s2", "s3"} and all(r.score > 0 for r in got)
    assert keyword.bm25(keyword.postings(seg).limit(0), seg, ["x"]).count() == 0


def test_sampled_queries_repeat_by_seed(spark):
    pool = spark.createDataFrame([(f"q{i}",) for i in range(8)], "q string")
    draw = lambda: [r.q for r in facets.sample_queries(pool, 3, 5).collect()]
    assert draw() == draw() and len(set(draw())) == 3


@pytest.mark.parametrize("side, small", [(1 << 27, 1 << 16), (1 << 9, 0)])
def test_matrix_products_by_cells_agree_with_a_whole_one(spark, monkeypatch, side, small):
    """One cell, or many: the leading factors of a matrix are the same, and no joined row of an entry and a vector is shuffled."""
    import numpy as np

    monkeypatch.setattr(semantic, "SIDE", side)
    monkeypatch.setattr(semantic, "SMALL", small)
    rng = np.random.default_rng(3)
    base = rng.random((30, 4))
    whole = base @ base.T
    rows = [(f"w{i}", f"w{j}", float(whole[i, j])) for i in range(30) for j in range(30)]
    found = {r.term: np.array(r.vec) for r in semantic.factorize(spark.createDataFrame(rows, "a string, b string, ppmi double"), 4, 6).collect()}
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    got = np.array([found[f"w{i}"] for i in range(30)])
    assert np.abs(got @ got.T - unit @ unit.T).max() < 1e-9


def test_products_need_no_join_of_entries_with_vectors(spark):
    plans = []
    rows = [(f"w{i}", f"w{j}", 1.0 + (i == j)) for i in range(6) for j in range(6)]

    def cut(made):
        plans.append(made._jdf.queryExecution().optimizedPlan().toString())
        return made.localCheckpoint()

    semantic.factorize(spark.createDataFrame(rows, "a string, b string, ppmi double"), 2, 2, cut=cut)
    assert not any("Join" in p or "mean" in p for p in plans)

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions import ranges, text, vectors
from colloquy.plans.query_state import QueryState


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'long'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).head().x


def pairs(found):
    return [(r.start, r.end) for r in found]


def test_normalizers_and_tokenizers(spark):
    s = "  École-Straße, l'été! a 42"
    assert one(spark, text.normalize_index(F.col("s")), s=s) == "ecole stra e l ete a 42"
    assert one(spark, text.normalize_exact(F.col("s")), s=s) == "ecole stra e l ete a 42"
    assert one(spark, text.index_words(F.col("s")), s="cafe\u0301 Ti\u1ebfng \ufb01n") == ["cafe", "tieng", "fin"]
    assert one(spark, text.query_terms(F.col("s")), s="Cafe\u0301, ti\u1ebfng") == ["cafe", "tieng"]
    assert len(one(spark, text.normalize_query(F.col("s")), s=s)) == len(s)
    assert one(spark, text.index_words(F.col("s")), s=s) == ["ecole", "stra", "ete", "42"]
    assert one(spark, text.query_terms(F.col("s")), s="Time, a time") == ["time", "a", "time"]
    assert one(spark, text.embedding_tokens(F.col("s")), s="x " + "y" * 24 + " free will") == ["free", "will"]
    assert one(spark, text.content_words(F.col("s")), s="What is the arrow of time?") == ["arrow", "time"]
    assert one(spark, text.token_count(F.col("s")), s=" a  b c ") == 3
    assert one(spark, text.token_count(F.col("s")), s=None) == 0


def test_clocks(spark):
    assert one(spark, text.clock_of(F.col("s")), s=3723) == "1:02:03"
    assert one(spark, text.clock_of(F.col("s")), s=65) == "1:05"
    assert one(spark, text.clock_of(F.lit(None).cast("long"))) == "Episode"
    for value, seconds in (("0:01:00", 60), ("12:34", 754), ("1:02:03.9", 3723), ("12", None), ("a:b", None), ("123:00", None)):
        assert one(spark, text.seconds_of(F.col("s")), s=value) == seconds


def test_links_and_labels(spark):
    assert one(spark, text.video_url(F.lit("abc"), F.lit(5))).endswith("watch?v=abc&t=5s")
    assert one(spark, text.video_url(F.lit(None).cast("string"), F.lit(5))) is None
    assert one(spark, text.media_url(F.lit(None).cast("string"), F.lit("a.mp3"), F.lit(5))) == "a.mp3#t=5"
    assert one(spark, text.media_url(F.lit(None).cast("string"), F.lit("a.mp3"), F.lit(None).cast("int"))) == "a.mp3"
    assert one(spark, text.question_label(F.lit("ama-2024-06#q14"))) == "#q14"
    assert one(spark, text.episode_badge(F.lit(datetime.date(2026, 6, 1)))) == "AMA · JUNE 2026"
    assert one(spark, text.segment_key(F.lit("e"), F.lit(99))) == "e#q100"
    assert one(spark, text.deep_link(F.lit("e"), F.lit("e#q1"))) == "?e=e&s=e%23q1"


def test_dates(spark):
    day = datetime.date(2024, 1, 8)
    assert one(spark, text.iso_date(F.lit("2024-01-08"), F.lit(""))) == day
    assert one(spark, text.iso_date(F.lit("soon"), F.lit("https://x.example/2024/01/08/post/"))) == day
    with pytest.raises(Exception, match="no date"):
        one(spark, text.iso_date(F.lit("soon"), F.lit("https://x.example/")))


def test_names(spark):
    assert one(spark, text.canonical_speaker(F.lit("Ada L.."), "Host", ("SC",))) == "Ada L"
    assert one(spark, text.canonical_speaker(F.lit("sc"), "Host", ("SC",))) == "Host"
    assert one(spark, text.questioner(F.lit("And Eve F, who"), "Host")) == "Eve F"
    assert one(spark, text.questioner(F.lit("they"), "Host")) == ""


def test_words_that_lead_in_are_names_where_who_follows_them(spark):
    for read, name in (("And who", "And"), ("It who", "It"), ("he who", ""), ("and Ann who", "Ann"), ("Then She", "")):
        assert one(spark, text.questioner(F.lit(read), "Host")) == name


def test_highlights(spark):
    s = "Free will, frée will and free"
    assert pairs(one(spark, ranges.first_ranges(F.col("s"), ["free", "none", "will"]), s=s)) == [(0, 4), (5, 9)]
    assert pairs(one(spark, ranges.all_ranges(F.col("s"), ["free"]), s=s)) == [(0, 4), (11, 15), (25, 29)]
    assert pairs(one(spark, ranges.all_ranges(F.col("s"), ["aa"]), s="aaaa a")) == [(0, 2), (2, 4)]
    assert one(spark, ranges.count_matches(F.col("s"), ["free", "will"]), s=s) == 5
    runs = one(spark, ranges.marked_runs(F.lit("free will"), ranges.first_ranges(F.lit("free will"), ["will"])))
    assert [(r.text, r.is_match) for r in runs] == [("free ", False), ("will", True)]


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 6)), max_size=6))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_merged_ranges_cover_the_same(spark, found):
    own = [(a, a + n) for a, n in found]
    literal = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in own)).cast(ranges.RANGE)
    merged = pairs(one(spark, ranges.merge_ranges(literal)))
    assert {x for a, b in merged for x in range(a, b)} == {x for a, b in own for x in range(a, b)}
    assert all(b < c for (_, b), (c, _) in zip(merged, merged[1:]))


def test_snippets(spark):
    words = " ".join(f"word{i}" for i in range(200))
    cut = one(spark, ranges.snippet(F.lit(words), ["word100"], 20))
    assert cut.startswith("…word") and cut.endswith("…") and "word100" in cut
    assert one(spark, ranges.snippet(F.lit("short text"), ["none"])) == "short text"
    head = one(spark, ranges.snippet(F.lit(words), ["none"], 20))
    assert head.startswith("word0") and head.endswith("…") and all(w.startswith("word") for w in head[:-1].split())
    assert one(spark, ranges.snippet(F.lit(""), ["x"])) == ""


def test_vectors(spark):
    v = F.array(F.lit(0.5), F.lit(-2.5 / 127), F.lit(9.0))
    assert one(spark, vectors.quantize(v)) == [64, -2, 127]
    assert one(spark, vectors.dot(v, v)) == pytest.approx(0.25 + (2.5 / 127) ** 2 + 81)
    assert one(spark, vectors.unit(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.unit(F.array(F.lit(0.0)))) is None


def test_packed_bytes_round_trip(spark):
    q = vectors.quantize(F.array(F.lit(0.5), F.lit(-1.0), F.lit(0.0)))
    assert one(spark, vectors.packed(q)) == "QIEA"
    assert one(spark, vectors.unpacked(vectors.packed(q))) == [64, -127, 0]
    assert one(spark, vectors.unpacked(F.lit(""))) == []
    assert one(spark, text.accept_suggestion(F.lit("free wi"), F.lit("will"))) == "free will "


def test_query_state():
    assert QueryState.from_url("") == QueryState()
    full = QueryState("free will", "semantic", "2024", "question", "ama-2024-01", "ama-2024-01#q02")
    assert QueryState.from_url(full.to_url()) == full
    assert QueryState.from_url("?mode=odd&type=odd") == QueryState()
    assert QueryState().to_url() == ""

import json
import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import align, ingest, segment, validate
from colloquy.sources import artifacts, captions, episodes, pages
from colloquy.streaming import ingest as stream

HOST, ALIASES = "Mara Quill", ("MQ",)
NEWEST = """<ul><li><article><time datetime="2022-05-30T08:00:00Z">spring</time><a class="t" href="/letters/may/">AMA – May 2022</a></article></li>
<li><article><a href="/letters/extra/">Lighthouses of the coast</a><time datetime="2022-05-12">x</time></article></li>
<li><a href="https://letters.example/2022/03/28/march/">AMA: March 2022</a></li></ul>
<p>older <a rel="prev" href="/newer">up</a> <a rel="next nofollow" href="?page=2">more</a></p>"""
OLDEST = """<script>var a = "<a href='/x/'>AMA May 1999</a>";</script><div><article><a href="../2021/">
AMA | November
2021</a><time datetime="2021-11-29">x</time></article><a class="page-numbers" href="?page=1">1</a></div>"""
LIGHTHOUSE = """<main><script>var t = "0:01 X: no";</script><audio controls><source src="/sound/may.mp3" type="audio/mpeg"></audio>
<p>See <a href="https://youtu.be/Qw3_rty-UI0?t=3">the film</a></p><h3>Click to Show Episode Transcript</h3>
<p>0:05 MQ: Good evening. Tonight I answer letters.</p>

<p>0:40 Mara Quill: Ivo Brandt wrote, “How old is the lighthouse?” It was built in 1874, and rebuilt later.</p>

<p>1:30 Mara Quill: The stones came from the old pier.</p>

<p>2:15 Tess Orlo: Is it still in use?</p>

<p>2:20.5 Mara Quill.: It is,
on foggy nights.</p>

<p>3:00 Mara Quill: A follow-up question: Nadia Voss asks, "Who keeps it?" A family of four.</p>

<p>4:10 Mara Quill: Let me combine three questions here. The first is from Pavel Rusk, and he says, "Can one visit?" Lise asks, "Is there a fee?"</p>

<p>4:50 Mara Quill: Omar de Witt wants to know, "Are dogs allowed?" Yes to all three, dogs on a lead.</p>

<p>5:30 Mara Quill: Jun writes that the lamp was replaced twice? Right, in 1910 and 1962.</p>

<p>1:06:10 Mara Quill: The keeper says little about it.</p>

Leave a Comment</main>"""
LEGACY = """<article><div class="entry-content"><p>[accordion title="Click to Show AMA Questions"]Click above.</p>
<p>Ivo Brandt.<br>How old is it?</p><p>only one line</p><p>Lise<br/>Is there a fee?<br>And for dogs?<br>[/accordion-item][/accordion]</p></div></article>"""


def cues_of(spark, transcript):
    return segment.cues(spark.createDataFrame([("ama-2024-01", transcript)], "episode_id string, transcript_text string"), HOST, ALIASES)


def test_archive_pages_are_walked_and_filtered(spark):
    site, calls = {"https://letters.example/all/": NEWEST, "https://letters.example/all/?page=2": OLDEST}, []
    archive = pages.crawl(spark, lambda url: calls.append(url) or site[url], "https://letters.example/all/")
    got = [(r.title, str(r.publish_date), r.source_url) for r in pages.discovered(archive).collect()]
    assert got == [
        ("AMA | November 2021", "2021-11-29", "https://letters.example/2021/"),
        ("AMA: March 2022", "2022-03-28", "https://letters.example/2022/03/28/march/"),
        ("AMA – May 2022", "2022-05-30", "https://letters.example/letters/may/"),
    ]
    assert calls == list(site)


def test_archives_of_over_a_hundred_pages_are_walked_to_the_end(spark):
    """The last page links to the first, which ends the walk."""
    page = '<article><a href="/ama-{0}/">AMA | May {0}</a></article><a rel="next" href="/page/{1}/">older</a>'
    archive = pages.crawl(spark, lambda url: page.format(2000 + int(url.split("/")[-2]), (int(url.split("/")[-2]) + 1) % 130), "https://pod.example/page/0/")
    assert [r.page_no for r in archive.orderBy("page_no").collect()] == list(range(130))
    assert pages.discovered(archive).count() == 130
    assert archive.rdd.getNumPartitions() > 1


def test_cues_and_segments(spark):
    text = pages.transcripts(spark.createDataFrame([("u", LIGHTHOUSE)], "url string, html string")).head().transcript_text
    cues = cues_of(spark, text)
    own = cues.orderBy("pos").collect()
    assert [(r.start_sec, r.speaker == HOST) for r in own] == [(5, True), (40, True), (90, True), (135, False), (140, True), (180, True), (250, True), (290, True), (330, True), (3970, True)]
    assert own[4].text.split() == "It is, on foggy nights.".split()
    got = segment.segments(cues, HOST, ALIASES).orderBy("ord").collect()
    assert [(r.type, r.start_sec, r.end_sec) for r in got] == [("intro", 5, 40), ("question", 40, 135), ("question", 135, 250), ("question", 250, 330), ("question", 330, None)]
    assert [r.question_text for r in got] == [
        "", "How old is the lighthouse?", "Is it still in use?\n\nWho keeps it?",
        "Pavel Rusk: Can one visit?\n\nLise: Is there a fee?\n\nAre dogs allowed?", "that the lamp was replaced twice?",
    ]
    assert [r.answer_text for r in got] == [
        "Good evening. Tonight I answer letters.", "It was built in 1874, and rebuilt later. The stones came from the old pier.",
        "It is, on foggy nights. A family of four.", "Yes to all three, dogs on a lead.", "Right, in 1910 and 1962. The keeper says little about it.",
    ]
    assert [r.speaker_names for r in got] == [[HOST], ["Ivo Brandt", HOST], ["Tess Orlo", HOST, "Nadia Voss"], ["Pavel Rusk", "Lise", HOST, "Omar de Witt"], ["Jun", HOST]]
    assert got[1].segment_id == "ama-2024-01#q02" and got[1].tokens == 5 + 15


@pytest.mark.parametrize("said, parts, rest", [
    ('and then łukasz asks, "why?"', [], 'and then łukasz asks, "why?"'),
    ('Then Ann Lee asks, "Why?" and Bo says, "never", I think.', [("Ann Lee", "Why?")], 'and Bo says, "never", I think.'),
    ("Ann asks whether it is so. And how?", [("Ann", "whether it is so. And how?")], ""),
    ("Ann asks: is it so? " + "Nobody can tell, not even those who were there. " * 4, [], None),
    ("Ann asks, is it? Is it? Well, it is. Or is it?", [("Ann", "is it? Is it?")], "Well, it is. Or is it?"),
    ('He asks, "Why?" She wrote, "Who?"', [], None),
    ("Combine several questions together. Ann Lee writes, \"One?\" Ann asks, \"Two?\"", [("Ann Lee", "One?"), ("Ann Lee", "Two?")], ""),
    ('The first is from Cy, she says, “Why?” So.', [("Cy", "Why?")], "So."),
    ('Ann asks, "open without an end? Sure.', [("Ann", "open without an end?")], "Sure."),
    ("", [], ""),
])
def test_cues_are_cut_at_askers(spark, said, parts, rest):
    cue = spark.createDataFrame([("e", 0, 1, HOST, said)], "episode_id string, pos int, start_sec int, speaker string, text string")
    got = segment.asking_cues(cue, HOST, ALIASES).head()
    assert [(p.name, p.question) for p in got.parts] == parts
    assert got.rest == (said if rest is None else rest)


@pytest.mark.parametrize("kinds, sections", [
    ("A q A", "0 1 1"), ("q q q", "1 1 1"), ("qr q A q", "1 2 2 3"), ("A f A f q", "0 1 1 1 2"), ("A q A f q q", "0 1 1 1 2 2"),
    ("q A g q q", "1 1 2 2 2"), ("q A fg q q", "1 1 1 1 2"), ("qr f fr q", "1 1 1 2"), ("gr q", "1 2"), ("f f", "1 1"),
])
def test_sections_follow_from_the_cues_beside(spark, kinds, sections):
    """A: an answer; q: a question, with r an answer behind it, f a follow-up, g a group announced."""
    rows = [("e", k, k, HOST, "t", [("n", "q?")] * (x != "A"), "t" if x == "A" or "r" in x else "", "g" in x, "f" in x) for k, x in enumerate(kinds.split())]
    asked = spark.createDataFrame(rows, f"episode_id string, pos int, start_sec int, speaker string, text string, parts array<{segment.PART}>, rest string, groups boolean, follows boolean")
    assert [r.section for r in segment.numbered_sections(asked).orderBy("pos").collect()] == [int(x) for x in sections.split()]


def test_question_only_pages(spark):
    got = pages.legacy_questions(spark.createDataFrame([("u", LEGACY)], "url string, html string")).orderBy("ord").collect()
    assert [(r.ord, r.speaker, r.text) for r in got] == [(0, "Ivo Brandt", "How old is it?"), (1, "Lise", "Is there a fee? And for dogs?")]


def test_snapshots_are_named_by_content(spark, tmp_path):
    found = spark.createDataFrame([(0, "a", "same"), (1, "b", "same"), (2, "a", "newer")], "page_no long, url string, html string")
    none = spark.createDataFrame([], "sha string, html string")
    assert pages.new_snapshots(found, none).count() == 2
    cache = str(tmp_path / "cache")
    for n in (0, 1, 2, 2):
        pages.append_cache(found.where(F.col("page_no") == n).select("url", "html"), cache)
    index, snapshots = pages.read_cache(spark, cache)
    # a content seen under two addresses in two batches keeps both
    assert {r.url for r in index.collect()} == {"a", "b"} and snapshots.count() == 2
    cached = pages.with_snapshots(spark.createDataFrame([("a",), ("b",), ("z",)], "url string"), index, snapshots)
    assert {r.url: r.html for r in cached.collect()} == {"a": "newer", "b": "same", "z": None}
    assert spark.read.json(f"{cache}/index").count() == 3


def test_incremental_ingest_adds_once(spark, tmp_path):
    rows = [("AMA – May 2022", "https://letters.example/may", "2022-05-30", LIGHTHOUSE), ("AMA: March 2022", "https://letters.example/march", "2022-03-28", LIGHTHOUSE)]
    batch = spark.createDataFrame(rows, "title string, source_url string, d string, html string").select("title", "source_url", F.col("d").cast("date").alias("publish_date"), "html")
    content, cache = str(tmp_path / "content"), str(tmp_path / "cache")
    first = stream.add_batch(batch, content, cache, HOST, ALIASES).head()
    assert (first.discovered, first.processed, first.skipped) == (2, 2, 0)
    second = stream.add_batch(batch, content, cache, HOST, ALIASES).head()
    assert (second.discovered, second.processed, second.skipped) == (2, 0, 2)
    stored = episodes.read(spark, content)
    assert [(r.episode_id, r.number) for r in stored.orderBy("number").collect()] == [("ama-2022-03", 1), ("ama-2022-05", 2)]
    one = stored.where("number = 2").head()
    assert one.youtube_id == "Qw3_rty-UI0" and one.audio_url == "https://letters.example/sound/may.mp3" and one.duration_sec == 3970
    index, snapshots = pages.read_cache(spark, str(tmp_path / "cache"))
    assert (index.count(), snapshots.count()) == (2, 1)  # two addresses, one body
    validate.require_valid(validate.violations(episodes.segments(stored)))
    validate.require_valid(validate.episode_violations(stored))
    built = artifacts.build(spark, stored, str(tmp_path / "index"), dimensions=2, least=1, margin=2)
    listed = {(r.kind, r.shard): r for r in built.collect()}
    assert {kind for kind, _ in listed} == set(artifacts.SHARDS) and all(r.rows and r.files and r.bytes and len(r.digest) == 15 for r in listed.values())
    docs = spark.read.parquet(str(tmp_path / "index" / "docs"))
    again = artifacts.digests(docs.orderBy(F.desc("segment_id")).repartition(3), *artifacts.SHARDS["docs"]).head()
    assert again.digest == listed["docs", "2022"].digest
    changed = docs.withColumn("answer", F.when(F.col("segment_id").endswith("q01"), "other").otherwise(F.col("answer")))
    assert artifacts.digests(changed, *artifacts.SHARDS["docs"]).head().digest != again.digest
    whole = artifacts.read_summary(spark, str(tmp_path / "index")).head()
    assert (whole.model, whole.dimensions, whole.shards, whole.episodes, len(whole.build_id)) == (artifacts.MODEL, 2, ["2022"], 2, 16)
    from colloquy.plans.engine import Engine
    from colloquy.plans.query_state import QueryState

    engine = Engine.open(spark, str(tmp_path / "index"))
    assert engine.search(QueryState("lighthouse", "keyword", year="2022")).count() == 2


def test_streamed_ingest(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.json").write_text(json.dumps({"title": "AMA – May 2022", "source_url": "https://letters.example/may", "publish_date": "2022-05-30", "html": LIGHTHOUSE}) + "\n")
    args = (str(inbox), str(tmp_path / "content"), str(tmp_path / "cache"), str(tmp_path / "progress"), HOST, ALIASES)
    stream.start(spark, *args).awaitTermination(120)
    stream.start(spark, *args).awaitTermination(120)
    assert episodes.read(spark, args[1]).count() == 1


def test_missing_folder_has_no_episodes(spark, tmp_path):
    assert episodes.read(spark, str(tmp_path / "none")).count() == 0


def test_captions_align(spark):
    """Pieces of an event are joined by spaces; a misspelt name still counts."""
    heard = [(1200, 2800, ["The", "harbour", "is quiet"]), (64_500, 3000, ["Ivo", " Brandd ", "wonders:\n", "when was the lighthouse first built?"]), (70_250, 900, ["In eighteen", "seventy-four."]), (99_000, None, ["Now the fee?"]), (None, 5, ["no start"]), (120_000, 10, [" ", None]), (130_000, 10, None)]
    source = {"events": [{"tStartMs": a, "dDurationMs": d, "segs": p and [{"utf8": x} for x in p]} for a, d, p in heard]}
    cues = captions.parse(spark.createDataFrame([("e", json.dumps(source))], "episode_id string, json string"))
    assert [(r.start_sec, r.end_sec, r.text) for r in cues.orderBy("start_sec").collect()] == [(1.2, 4.0, "The harbour is quiet"), (64.5, 67.5, "Ivo Brandd wonders: when was the lighthouse first built?"), (70.25, 71.15, "In eighteen seventy-four."), (99.0, 99.0, "Now the fee?")]
    asked = spark.createDataFrame([("e", "q1", "When was the lighthouse first built?", ["Ivo Brandt"], 0.0, None)], "episode_id string, question_id string, question_text string, speaker_names array<string>, from_sec double, until_sec double")
    assert align.align(asked, cues).head().start_sec == 64
    after = spark.createDataFrame([("e", "q1", "First built?", 64.5, None)], "episode_id string, question_id string, question_text string, start_sec double, next_sec double")
    assert align.answer_starts(after, cues).head().answer_sec == 70
    span = spark.createDataFrame([("e", "s", 60.0, 99.0)], "episode_id string, span_id string, from_sec double, until_sec double")
    assert align.text_between(cues, span).head().text == "Ivo Brandd wonders: when was the lighthouse first built? In eighteen seventy-four."


def test_captions_meet_by_slices(spark):
    """Against brute force: spans and questions that cross slices, ties, open ends, and rows without an episode or a start."""
    import random

    rng = random.Random(5)
    heard = [(rng.choice("xy"), float(rng.randrange(400)), "what?" if rng.random() < 0.3 else f"w{k}") for k in range(120)]
    cues = spark.createDataFrame([*((e, a, a + 6, t) for e, a, t in heard), (None, 1.0, 2.0, "no episode"), ("x", None, None, "no start")], "episode_id string, start_sec double, end_sec double, text string")
    spans = [(rng.choice("xyz"), f"s{k}", float(rng.randrange(-50, 450)), None if k % 5 == 0 else float(rng.randrange(500))) for k in range(60)]
    got = align.text_between(cues, spark.createDataFrame([*spans, (None, "none", 0.0, None)], "episode_id string, span_id string, from_sec double, until_sec double"), 37)
    inside = {s: sorted((a, t) for e, a, t in heard if e == own and low <= a and (high is None or a < high)) for own, s, low, high in spans}
    assert {r.span_id: r.text for r in got.collect()} == {s: " ".join(t for _, t in found) for s, found in inside.items() if found}

    asked = [(rng.choice("xyz"), f"q{k}", "so?", float(rng.randrange(450)), None) for k in range(60)] + [(None, "none", "so?", 3.0, None)]
    starts = align.answer_starts(spark.createDataFrame(asked, "episode_id string, question_id string, question_text string, start_sec double, next_sec double"), cues, 37)
    due = {}
    for own, q, _, at, _ in asked:
        line = sorted((a, a + 6, t) for e, a, t in heard if e == own)
        follow = {k: (line[k + 1][0] if k + 1 < len(line) else line[k][1]) for k in range(len(line))}
        spoken = [follow[k] for k, (a, end, t) in enumerate(line) if at <= a <= at + 16 and "?" in t and end >= at + 4]
        due[q] = (spoken or [a for a, _, _ in line if a >= at + 4] or [at + 4])[0]
    assert {r.question_id: r.answer_sec for r in starts.collect()} == due


def test_validation_finds_backward_times(spark):
    schema = "episode_id string, segment_id string, type string, start_sec int, end_sec int, ord int"
    good = [("e", "e#q01", "question", 10, 20, 0), ("e", "e#q02", "question", None, None, 1)]
    assert validate.violations(spark.createDataFrame(good, schema)).count() == 0
    bad = [*good, ("e", "e#q03", "intro", 5, 3, 2), ("f", "x", "odd", 1, None, 0)]
    found = {r.rule for r in validate.violations(spark.createDataFrame(bad, schema)).collect()}
    assert found == {"not_monotonic", "end_before_start", "foreign_segment", "unknown_type", "no_question"}
    with pytest.raises(ValueError, match="monotonic"):
        validate.require_valid(validate.violations(spark.createDataFrame(bad, schema)).where("rule = 'not_monotonic'"))


def test_recent_searches_stream(spark, tmp_path):
    from colloquy.streaming import recents

    rows = [{"user_id": 1, "query": f"q{i}", "mode": "hybrid", "at": i} for i in range(8)]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    events = spark.readStream.schema("user_id long, query string, mode string, at long").json(str(tmp_path))
    q = recents.recent_searches(events).writeStream.outputMode("update").format("memory").queryName("recents").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select queries from recents").head().queries == ["q7", "q6", "q5", "q4", "q3"]


def test_best_overlaps_match_brute_force(spark):
    """Words count as parts of tokens; the best text has most of them, then the smallest keys; long tokens are cut into pieces."""
    rng = random.Random(17)
    syllables = ["ka", "to", "mi", "re", "su", "ba", "lo"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    asked = {k: sorted({word(rng.randint(1, 4)) for _ in range(rng.randint(1, 12))}) for k in range(40)}
    asked |= {100: ["cat", "running"], 101: ["concat"], 102: [], 103: None, 104: ["dog", "cat", "absent"], 105: ["zebra"]}
    flats = {k: " ".join(word(rng.randint(1, 6)) for _ in range(rng.randint(0, 25))) for k in range(60)}
    flats |= {200: "a cat concatenates", 201: "concat running shoes", 202: "", 203: "dog dog " + "x" * 3000 + "absent" + "y" * 500, 204: None, 205: flats[3], 206: "z" * 63 + "ebra"}
    q = spark.createDataFrame(list(asked.items()), "id int, words array<string>")
    t = spark.createDataFrame([(k, k, v) for k, v in flats.items()], "a int, b int, flat string")
    want = set()
    for i, words in asked.items():
        scored = [(-sum(w in flat for w in words), k) for k, flat in flats.items() if flat] if words else []
        if scored and min(scored)[0] < 0:
            n, k = min(scored)
            want.add((i, k, k, round(-n / len(words), 6)))
    got = {(r.id, r.a, r.b, round(r.share, 6)) for r in align.best_overlaps(q, t, "id", "a", "b").collect()}
    assert got == want
    assert align.best_overlaps(q.where("false"), t, "id", "a", "b").count() == 0
    assert align.best_overlaps(q, t.where("false"), "id", "a", "b").count() == 0


def test_a_token_of_millions_of_letters_takes_linear_time(spark):
    import time

    took = []
    for n in (1_000_000, 4_000_000):
        tokens = spark.sql(f"select concat(repeat('ab1', {n} div 3), 'needle', repeat('q', 50)) token")
        words = spark.createDataFrame([("needle",), ("b1a",), ("absent",), ("qq",)], "w string")
        began = time.perf_counter()
        assert {r.w for r in align.containing(words, tokens).collect()} == {"needle", "b1a", "qq"}
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * max(took[0], 1)


def test_alignment_without_any_word_in_sight(spark):
    cues = spark.createDataFrame([("e", 0, 5, "name here"), ("e", 200, 205, "nothing")], "episode_id string, start_sec int, end_sec int, text string")
    asked = spark.createDataFrame([("e", 1, "zebra stripes", ["name"], 0, None), ("e", 2, "", ["name"], 0, None), ("e", 3, "zebra", [], 0, None)], "episode_id string, question_id int, question_text string, speaker_names array<string>, from_sec int, until_sec double")
    assert align.align(asked, cues).count() == 0  # a name alone weighs as much as the longest delay takes off

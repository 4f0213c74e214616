"""Repeated passages against a plain search for every window."""

import hashlib
import random
import re

import pytest

from colloquy.llm import op11_repeated_passages as passages
from colloquy.llm.common import tune
from tests.llm.conftest import DOCS, prose, row


def plain(rows):
    """(doc_id, text) rows in the order of the removal -> (doc_id, n_words, n_removed, digest) of each."""
    seen, out = {}, []
    for k, (doc_id, text) in enumerate(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - passages.WINDOW + 1):
            if seen.setdefault(tuple(words[i : i + passages.WINDOW]), (k, i)) != (k, i):
                gone.update(range(i, i + passages.WINDOW))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc_id, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def given(rows):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows.collect())


@pytest.fixture(scope="module")
def rows():
    """Copies, shared passages inside other text, a phrase of just under a window in many settings, periods, odd white space."""
    rng = random.Random(11)
    phrase, passage = prose(rng, 12), prose(rng, 50)
    texts = []
    for k in range(160):
        own = prose(rng, rng.randint(0, 90))
        kind = k % 8
        if kind == 1:
            own = f"{own} {passage} {prose(rng, 15)}"
        elif kind == 2:
            own = f"{prose(rng, 9)} {phrase} {prose(rng, 9)}"
        elif kind == 3:
            own = f"{prose(rng, rng.randint(0, 4))} {phrase} {own} {phrase}"
        elif kind == 4:
            own = " ".join(rng.choice(["na", "la", "ho na la"]) for _ in range(rng.randint(10, 70)))
        elif kind == 5:
            own = texts[rng.randrange(len(texts))].replace(" ", rng.choice(["\n", " \t", "  "]), 3)
        elif kind == 6:
            words = texts[rng.randrange(len(texts))].split(" ")
            at = rng.randrange(len(words) + 1)
            own = " ".join([*words[:at], "edited", *words[at:]])
        texts.append(own)
    texts += ["na " * 500, ("ab cd ef " * 300), passage, passage.split(" ", 1)[1], "one " * 19, "one " * 20, "one " * 21, "é" * 5000 + " " + passage]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return sorted(zip(ids, texts))


@pytest.mark.parametrize("keys, stream", [(1 << 14, 1 << 18), (16, 64)])
def test_windows_go_as_a_plain_search_finds(spark, rows, monkeypatch, keys, stream):
    """Few keys a shard and few occurrences a task change nothing."""
    monkeypatch.setattr(passages, "KEYS", keys)
    monkeypatch.setattr(passages, "STREAM", stream)
    tune(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert given(passages.repeats(docs)) == sorted(plain(rows))


def test_a_line_that_fails_at_one_place_is_tried_at_the_next(spark):
    """Copies with single words replaced, so that later passages stand at the same distance as phrases in other words."""
    tune(spark)
    rng = random.Random(21)
    rows = []
    for k in range(60):
        words = prose(rng, 160).split(" ")
        other = list(words)
        for at in range(0, 90, 13):
            other[at] = "edited"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        rows.append((1000 + k, " ".join(words[:90])))
        for at in range(0, 90, 13):  # each phrase between the edits recurs in whole windows too
            rows.append((2000 + 10 * k + at // 13, " ".join(["so", *other[max(at - 6, 0) : at + 22], "on"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert given(passages.repeats(docs)) == sorted(plain(sorted(rows)))


def test_unlike_windows_of_one_hash_are_told_apart(spark, rows, monkeypatch):
    """A weak hash of windows makes them meet by mistake; another round with another hash settles what is left."""
    real = passages.rolled
    weak = lambda words, size, seed=0: real(words, size, seed) % (1 << 5 if seed == 1 else 1 << 62)
    monkeypatch.setattr(passages, "rolled", weak)
    tune(spark)
    docs = spark.createDataFrame(rows[:90], "doc_id long, text string")
    found = passages.Passages(1)
    words = [f"w{k}".encode() for k in range(60)]
    found.add(1, 0, b" ".join(words), passages.window_keys(passages.word_hashes(b" ".join(words)), 1)[0].tolist())
    found.compile()
    other = b" ".join(f"v{k}".encode() for k in range(60))
    located, mine = found.locate(2, 0, other)
    assert mine.any() and not located.any()  # alike by hash, not by words
    monkeypatch.undo()
    assert given(passages.repeats(docs)) == sorted(plain(rows[:90]))


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(5)
    text = b" ".join(bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40))) for _ in range(400))
    whole = passages.word_hashes(text)
    monkeypatch.setattr(passages, "BLOCK", 16)
    assert (passages.word_hashes(text) == whole).all() and len(whole) == text.count(b" ") + 1
    same = {}
    for w, h in zip(text.split(b" "), whole.tolist()):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)


def test_odd_rows(spark, corpus, empty):
    tune(spark)
    docs = corpus[0]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    known = sorted({(i is None, i or 0, t or "", i, t) for i, t in rows})
    expected = {(i, t): w for (_, _, _, i, t), w in zip(known, plain([(i, t) for _, _, _, i, t in known]))}
    # no two texts of one id here, so the order within an id does not matter
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in passages.repeats(docs).collect()), key=key) == sorted((expected[r] for r in rows), key=key)
    assert passages.repeats(empty[0]).count() == 0


def test_texts_of_one_id_and_repeated_rows(spark):
    tune(spark)
    rng = random.Random(8)
    passage = prose(rng, 40)
    docs = spark.createDataFrame([(7, passage), (7, passage), (7, f"other {passage}"), (None, passage), (3, "few words")], "doc_id long, text string")
    found = passages.repeats(docs).collect()
    assert len(found) == 5
    of_seven = sorted(r.n_removed for r in found if r.doc_id == 7)
    assert of_seven in ([0, 0, 40], [0, 40, 40])  # the twins count as one; which text comes first is the order of hashes
    assert [r.n_removed for r in found if r.doc_id is None] == [40]


def test_texts_lose_their_repeats_and_other_columns_stay(spark, corpus):
    tune(spark)
    rng = random.Random(9)
    passage = prose(rng, 30)
    docs = spark.createDataFrame([row(1, f"first {passage} last"), row(2, f"second  {passage} end"), row(3, None), row(4, " kept \n as it is ")], DOCS).withColumnRenamed("score", "CUT")
    out = {r.doc_id: r for r in passages.deduplicate(docs).collect()}
    assert len(out) == 4 and out[1].text == f"first {passage} last" and out[2].text == "second end" and out[3].text is None and out[4].text == " kept \n as it is "
    assert out[2].CUT == -1.0 and out[2].lang == "en"

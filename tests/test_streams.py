"""Streams with keyed state: several batches, late rows, forgotten searches, sections as the batch form makes them."""

import json
import os
import time

import pytest

from colloquy.operators import segment
from colloquy.streaming import recents, sections


@pytest.fixture()
def played(spark, tmp_path):
    """Plays batches of rows through a stream, one file a batch; returns all rows that came out, by batch.

    ``endless``: states with a time to live look for what has expired in batches without data, so the stream is stopped once as
    many batches as there are files have put out rows.
    """

    def play(schema, batches, make, endless=False):
        for i, rows in enumerate(batches):
            (tmp_path / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
            os.utime(tmp_path / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in order of their times
        out = []
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path)))
        writer = stream.writeStream.outputMode("update").foreachBatch(lambda rows, n: out.append(rows.collect()))
        query = (writer if endless else writer.trigger(availableNow=True)).start()
        end = time.time() + 100
        while query.isActive and time.time() < end and not (endless and sum(map(bool, out)) >= len(batches)):
            time.sleep(0.2)
        done = endless or not query.isActive
        query.stop()
        assert done and query.exception() is None
        return out

    return play


def test_recent_searches_over_batches(played):
    row = lambda user, q, at: {"user_id": user, "query": q, "mode": "keyword", "at": at}
    batches = [[row(1, f"q{i}", i) for i in range(6)] + [row(2, "  ", 1)], [row(1, " q2 ", 9), row(1, "old", 0), row(2, "b", 2), row(2, "a", 2)]]
    seen = {}
    for rows in played("user_id long, query string, mode string, at long", batches, recents.recent_searches):
        seen |= {r.user_id: r.queries for r in rows}
    assert seen == {1: ["q2", "q5", "q4", "q3", "q1"], 2: ["a", "b"]}


def test_searches_are_forgotten_after_their_time(played):
    row = lambda q, at: {"user_id": 1, "query": q, "mode": "keyword", "at": at}
    out = played("user_id long, query string, mode string, at long", [[row("a", 1)], [row("b", 2)]], lambda s: recents.recent_searches(s, ttl_ms=1), endless=True)
    assert [r.queries for rows in out for r in rows][-1] == ["b"]


def test_sections_are_those_of_the_batch_form(spark, played):
    roles = [["system", "user", "user", "assistant", "user", "assistant", "assistant"], ["assistant", "user", "system", "user", "assistant"], ["user"], ["system"]]
    turns = [{"conv_id": c, "turn": t, "role": r, "text": None if (c, t) == (0, 4) else f"{r} {c}.{t}"} for c, line in enumerate(roles) for t, r in enumerate(line)]
    batches = [[r for r in reversed(turns) if r["turn"] < 2], [r for r in turns if 2 <= r["turn"] < 5], [r for r in turns if r["turn"] >= 5] + [{"conv_id": 1, "turn": 0, "role": "user", "text": "behind"}]]
    schema, got, late = "conv_id long, turn long, role string, text string", {}, []
    for rows in played(schema, batches, sections.turn_sections):
        late += [(r.conv_id, r.question) for r in rows if r.type == "late"]
        got |= {(r.conv_id, r.ord): (r.turns, r.question, r.answer, r.type) for r in rows if r.type != "late"}
    want = segment.turn_sections(spark.createDataFrame(turns, schema)).collect()
    assert got == {(r.conv_id, r.ord): (r.turns, r.question, r.answer, r.type) for r in want}
    assert late == [(1, "behind")]

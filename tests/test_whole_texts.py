from colloquy.operators import semantic
from colloquy.sources import artifacts

SEGMENTS = "segment_id int, episode_id string, shard string, type string, start_sec int, question string, answer string"


def test_passages_reach_the_end_of_a_text(spark):
    """A word behind the first three chunks is found, at its offset."""
    answer = " ".join(f"w{i}" for i in range(2000)) + "  \n cats"
    rows = spark.createDataFrame([(1, "e", "2024", "question", 7, "Why?", answer), (2, "e", "2024", "question", 8, " ", " ")], SEGMENTS)
    got = semantic.passages(rows, chunks=None).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(12)) and got[-1].text.endswith("cats")
    assert all(answer[r.char_offset :].startswith(r.text) for r in got[1:])
    assert [r.text.split()[0] for r in got[1:]] == [f"w{190 * i}" for i in range(11)]
    words = spark.createDataFrame([("cats", 1.5, [1.0, 0.0])], "term string, idf double, vec array<double>")
    found = artifacts.passage_vectors(rows, artifacts.word_table(words)).collect()
    assert [(r.segment_id, r.char_offset, r.shard, r.q) for r in found] == [(1, got[-1].char_offset, "2024", [127, 0])]

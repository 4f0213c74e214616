import random

import pytest

LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, y int, shard string, rank long"
BAD = ("idiot", "scum", "moron", "trash")


def prose(rng, n):
    return " ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."


def row(doc_id, text, lang="en"):
    """A document with extra columns whose names the operators use themselves."""
    return (doc_id, text, lang, "src0", None if text is None else len(text), -1.0, 7, "x", -5)


@pytest.fixture(scope="session")
def corpus(spark):
    """Clean, junk and toxic prose with labels, and the odd rows: null, empty, blank, one word, long, repeated, no id."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(360):
        kind = i % 6
        text = prose(rng, rng.randint(60, 160))
        if kind == 1:
            words = text.split()
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
            text = " ".join(words)
        elif kind == 2:
            text = " ".join(w.upper() + "!!" for w in text.split()) if i % 12 == 2 else " ".join(w + "&&&" for w in text.split())
        rows.append(row(i, text))
        labels.append((i, int(kind != 2), int(kind == 1)))
    odd = [row(1000, None), row(1001, ""), row(1002, " \n\t "), row(1003, "one"), row(1004, prose(rng, 60_000)), row(None, "no id here"), row(1005, "same"), row(1005, "same"), row(1006, "é" * 3000)]
    labels += [(None, 1, 0), (5, None, None), (7, 1, 0), (7, 1, 1), (4000, 0, 0)]
    return spark.createDataFrame(rows + odd, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)

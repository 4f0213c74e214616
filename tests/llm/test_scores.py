import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import op1_quality_cnn, op4_toxicity, op8_quality_rules, trees
from colloquy.llm.common import roc_auc

WHITE = " \t\n\v\f\r"


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def auc(rows, truth):
    kept = [(truth[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in truth]
    return roc_auc(np.array([y for y, _ in kept]), np.array([s for _, s in kept]))


@pytest.mark.parametrize("op, column", [(op1_quality_cnn, "quality"), (op4_toxicity, "toxic")])
def test_scores_hold_on_the_held_out_fold(corpus, op, column):
    docs, labels = corpus
    rows = op.score(docs, op.fit(docs, labels)).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.held_out == held_out(r.doc_id) for r in rows)
    edge = 0.5 if column == "quality" else 0.7
    assert all(r.predicted == int(r.score >= edge) for r in rows)
    truth = {r.doc_id: r[column] for r in labels.collect() if r.doc_id is not None and r.doc_id < 360 and r[column] is not None}
    assert auc(rows, truth) > 0.9
    assert len({r.score for r in rows if r.doc_id == 1005}) == 1


def test_held_out_labels_change_no_toxicity_score(corpus):
    docs, labels = corpus
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(string(doc_id)) % 3 = 1 then 1 else toxic end as toxic")
    scores = [{r.doc_id: r.score for r in op4_toxicity.score(docs, op4_toxicity.fit(docs, own)).collect()} for own in (labels, flipped)]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("op", [op1_quality_cnn, op4_toxicity])
def test_empty_tables_and_missing_labels(corpus, empty, op):
    assert op.score(empty[0], op.fit(*empty)).count() == 0
    docs, labels = corpus
    rows = op.score(docs.limit(5), op.fit(docs, labels.limit(0))).collect()
    assert [r.score for r in rows] == pytest.approx([0.5] * 5)


def test_held_out_labels_are_never_learnt(corpus):
    """Neither by the network nor by the trees of the quality rules; of toxicity, above."""
    docs, labels = corpus
    flipped = labels.selectExpr("doc_id", "case when crc32(string(doc_id)) % 3 = 1 then 1 - quality else quality end as quality", "toxic")
    a = op1_quality_cnn.fit(docs, labels)
    b = op1_quality_cnn.fit(docs, flipped)
    assert np.array_equal(a.filters, b.filters) and a.offset == b.offset
    c, d = op8_quality_rules.fit(docs, labels), op8_quality_rules.fit(docs, flipped)
    assert np.array_equal(c.value, d.value) and np.array_equal(c.threshold, d.threshold) and c.base == d.base


def test_every_part_of_a_text_is_scored(corpus):
    docs, labels = corpus
    net = op1_quality_cnn.fit(docs, labels)
    one = lambda raw: op1_quality_cnn.probabilities(net, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    clean = b"some plain words in a row " * 400
    assert one(clean) != one(clean + b"JUNK!! &&& " * 20)
    doc, start = op1_quality_cnn.chunk_starts(np.array([0, 1, 256, 257, 1000]))
    for d, n in enumerate((0, 1, 256, 257, 1000)):
        assert {x for s in start[doc == d] for x in range(s, min(s + 256, n))} == set(range(n))


def random_network(seed=0):
    rng = np.random.default_rng(seed)
    f = op1_quality_cnn
    return f.Network(rng.normal(size=(256, f.DIM)).astype(np.float32), rng.normal(size=(f.WIDTH * f.DIM, f.FILTERS)).astype(np.float32), rng.normal(size=f.FILTERS).astype(np.float32), rng.normal(0, 0.05, 3 * f.FILTERS), 0.3)


def brute_probability(net, raw):
    """One text's probability in plain loops."""
    chunks = []
    for start in range(0, max(len(raw) - 256 + 192, 1), 192):
        chunk = raw[start : start + 256] + bytes(max(0, start + 256 - len(raw)))
        values = []
        for k in range(24):
            each = [sum(float(net.embedding[chunk[p + i], d]) * float(net.filters[i * 8 + d, k]) for i in range(8) for d in range(8)) for p in range(0, 249, 4)]
            values.append(max(max(each) + float(net.bias[k]), 0))
        chunks.append(values)
    columns = list(zip(*chunks))
    z = [sum(c) / len(c) for c in columns] + [max(c) for c in columns] + [min(c) for c in columns]
    return 1 / (1 + math.exp(-(sum(a * w for a, w in zip(z, net.weights)) + net.offset)))


def test_network_scores_match_brute_force():
    net, texts = random_network(), [b"", b"short", b"x" * 256, b"some more words of it " * 13, "é\n".encode() * 150]
    got = op1_quality_cnn.probabilities(net, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert got == pytest.approx([brute_probability(net, t) for t in texts], rel=1e-4)


def test_network_gradients_match_differences(monkeypatch):
    """Training sees every chunk: the gradients of texts of many chunks, in small blocks, are those of the loss."""
    monkeypatch.setattr(op1_quality_cnn, "BLOCK", 3)
    rng = np.random.default_rng(5)
    net = random_network(1)
    net.embedding, net.filters, net.bias = (x.astype(float) for x in (net.embedding, net.filters, net.bias))
    monkeypatch.setattr(op1_quality_cnn, "windows", lambda n, c: np.stack([n.embedding[c[:, s : s + 8]].reshape(len(c), -1) for s in range(0, 249, 4)], 1))
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 90, 2500, 700)]
    data, offsets, docs, y = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), np.arange(4), np.array([1.0, 0, 1, 0])

    def loss():
        p = op1_quality_cnn.probabilities(net, data, offsets)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = op1_quality_cnn.gradients(net, net.weights, net.offset, data, offsets, docs, y)
    for name in ("embedding", "filters", "bias", "weights"):
        values, flat = getattr(net, name).reshape(-1), grads[name].reshape(-1)
        for k in np.argsort(-np.abs(flat))[:6]:
            was = values[k]
            values[k] = was + 1e-6
            up = loss()
            values[k] = was - 1e-6
            down = loss()
            values[k] = was
            assert flat[k] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-7), name


def test_training_reads_the_end_of_long_texts():
    """Only the last of 12 chunks tells the classes apart."""
    rng = random.Random(2)
    filler = lambda: "".join(rng.choice("abcdefgh ") for _ in range(2200)).encode()
    texts = [filler() + (b"!!ZZ!!ZZ!!ZZ" if k % 2 else b"") for k in range(30)]
    net = op1_quality_cnn.train(texts, np.array([k % 2 for k in range(30)], float))
    got = op1_quality_cnn.probabilities(net, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert roc_auc(np.array([k % 2 for k in range(30)]), got) > 0.99


def test_the_training_sample_is_bounded_in_bytes(corpus):
    docs, labels = corpus
    a = op1_quality_cnn.fit(docs, labels, most_bytes=20_000)
    assert not np.array_equal(a.filters, op1_quality_cnn.fit(docs, labels).filters)
    assert op1_quality_cnn.fit(docs, labels, most_bytes=0).offset == 0.0


def test_toxic_words_behind_signs_are_found():
    words = {b"idiot": (5.0, 99)}
    hidden = op4_toxicity.FEATURES.index("obfuscated_hits")
    assert op4_toxicity.features(b"what an 1d10t-like 1d1ot ID!OT here", words, {})[hidden] >= 1
    assert op4_toxicity.features(b"you idiot", words, {})[op4_toxicity.FEATURES.index("near_second")] == 1


def brute_features(raw, words, stems):
    """The features in plain loops over characters and words."""
    letter = lambda c: c >= 128 or chr(c).isalpha()
    fold = "".join(chr(c).lower() if c < 128 and chr(c).isalnum() else chr(c) if c >= 128 else " " for c in raw)
    own = [w.encode("latin-1") for w in fold.split(" ") if w]
    if not own:
        return [0.0] * len(op4_toxicity.FEATURES)
    hit = [i for i, w in enumerate(own) if w in words]
    stem = [i for i, w in enumerate(own) if w[:4] in stems]
    second = [i for i, w in enumerate(own) if w in op4_toxicity.SECOND_PERSON]
    near = sum(any(abs(i - j) <= 5 for j in second) for i in hit + stem)
    white, signs, spans, start = b" \t\n\v\f\r", b"0123456789@$*|!", [], 0
    for i in range(len(raw) + 1):
        if i == len(raw) or raw[i] in white:
            spans.append((start, i))
            start = i + 1
    stands = [i for i in range(1, len(raw) - 1) if raw[i] in signs and letter(raw[i - 1]) and letter(raw[i + 1])]
    hidden = 0
    for a, b in spans:
        if any(a <= i < b for i in stands):
            plain = raw[a:b].translate(op4_toxicity.LEET).translate(op4_toxicity._FOLD).split()
            hidden += sum(w in words or w[:4] in stems for w in plain)
    capitals = sum(65 <= c <= 90 for c in raw)
    small = sum(97 <= c <= 122 or c >= 128 for c in raw)
    printed = max(sum(c > 32 for c in raw), 1)
    punctuation = sum(c > 32 and not letter(c) and c not in signs and c != 63 for c in raw)
    weight = sum(words[own[i]][0] for i in hit) + sum(stems[own[i][:4]][0] for i in stem)
    n = len(own)
    return [100 * len(hit) / n, np.log1p(len(hit)), 100 * len(stem) / n, np.log1p(len(stem)), weight / np.sqrt(n), near, len(second) / n, capitals / max(capitals + small, 1), raw.count(b"!") / printed, raw.count(b"?") / printed, punctuation / printed, len(stands) / n, hidden, np.log1p(n)]


def test_toxicity_features_match_brute_force():
    words, stems = {b"idiot": (5.0, 99), b"b": (3.0, 9)}, {b"mast": (4.0, 50)}
    rng = random.Random(3)
    texts = [b"line\n\tw0rd here", b"you\tb4stard m4sterly\r\nid1ot\x0bx1y\x0cz", b"\tif x1y:\r\n\t\treturn id10t", b"", b"a", b"a1", b"a1b", "é1é m4stür".encode()]
    pieces = ["idiot", "1d1ot", "id!ot", "you", "tu", "m4ster", "x1y", "B", "?", "é0b", "plain", "it's", "***", "a$b$c", "master"]
    texts += ["".join(rng.choice(pieces) + rng.choice([" ", "\t", "\n", "\v", "\f", "\r", "\r\n", "", "-", "\x00"]) for _ in range(rng.randint(1, 60))).encode() for _ in range(400)]
    for raw in texts:
        assert op4_toxicity.features(raw, words, stems) == pytest.approx(brute_features(raw, words, stems)), raw


def test_a_long_line_of_disguised_words_takes_linear_time():
    raw = b"x1y\tid10t " * 200_000
    began = time.perf_counter()
    got = op4_toxicity.features(raw, {b"idiot": (5.0, 99)}, {})
    assert got[op4_toxicity.FEATURES.index("obfuscated")] > 0
    assert time.perf_counter() - began < 30


def test_clean_documents_stay(corpus):
    docs, labels = corpus
    model = op4_toxicity.fit(docs, labels)
    gone = {r.doc_id for r in op4_toxicity.score(docs, model).collect() if r.predicted}
    kept = op4_toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len(gone)
    assert all(d % 6 == 1 for d in gone) and len(gone) > 40


def brute_statistics(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in WHITE:
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    lines = [x for x in (text or "").split("\n") if any(c not in WHITE for c in x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_match_brute_force(spark, corpus):
    docs, labels = corpus
    more = [(2000, "a b a b a b a b\n\nline\nline\n \nline", "de"), (2001, "a b c d e a b c", "de"), (2002, "x\u00a0y z\u3000w ## a|b\r\nq", "de"), (2003, "# " * 60, "fr")]
    docs = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text)
    rows = op8_quality_rules.judge(docs, op8_quality_rules.fit(docs, labels)).collect()
    for r in rows:
        want = brute_statistics(texts[r.doc_id])
        assert tuple(r[c] for c in op8_quality_rules.BASE) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    good = [r.kept for r in rows if r.doc_id is not None and r.doc_id < 360 and r.doc_id % 6 != 2]
    assert np.mean(good) > 0.98
    assert not any(r.kept for r in rows if r.doc_id is not None and r.doc_id < 360 and r.doc_id % 6 == 2)


def test_quality_rules_on_empty_tables(empty):
    assert op8_quality_rules.judge(empty[0], op8_quality_rules.fit(*empty)).count() == 0


def test_trees_learn_and_keep_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] + x[:, 1] ** 2 + rng.normal(0, 0.3, 800)) > 1).astype(float)
    model = trees.fit(x, y, {0: 1})
    assert roc_auc(y, model.score(x)) > 0.95
    for base in x[:20]:
        grid = np.repeat(base[None], 40, 0)
        grid[:, 0] = np.linspace(-3, 3, 40)
        assert (np.diff(model.margin(grid)) >= -1e-12).all()
    assert trees.fit(np.zeros((0, 3)), np.zeros(0)).margin(x).shape == (800,)


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.default_rng(1)
    s = rng.uniform(size=3000)
    y = (rng.uniform(size=3000) < s**2).astype(float)
    at, fit = trees.isotonic(s, y)
    assert (np.diff(fit) >= 0).all()
    assert abs(np.interp(0.9, at, fit) - 0.81) < 0.1

import base64
import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from colloquy.llm import op2_byte_bpe
from colloquy.llm.common import tune
from colloquy.llm.queries import vocabulary


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op2_byte_bpe.read_ranks(vocabulary()[0]), special_tokens={})


def test_digests_match_the_library(spark, corpus, library):
    tune(spark)
    docs = corpus[0]
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text or "")
    rows = op2_byte_bpe.encode(docs, *vocabulary()).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_random_and_long_matches(library):
    rng = random.Random(2)
    coder = op2_byte_bpe.Tokenizer(*vocabulary())
    texts = ["".join(rng.choice("the nrsa\n  é'1.!日😀") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += ["", "a" * 2000, "ab" * 700, "-" * 999, "".join(rng.choice("etaoin") for _ in range(3000)), "<|endoftext|>"]
    for text, runs in zip(texts, coder.encode(texts)):
        assert np.frombuffer(b"".join(runs), "<u4").tolist() == library.encode_ordinary(text)


def test_both_recursions_agree_with_the_library(library, monkeypatch):
    """The windows of the long form change nothing, at any reach that the longest token allows, nor do restarts."""
    rng = random.Random(7)
    coder = op2_byte_bpe.Tokenizer(*vocabulary())
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 400))) for letters in ("theinrsaou", "ab", "aé日", "xyzQ", "-=", "a") for _ in range(4)]
    words += ["a" * n for n in (161, 1001)] + ["ab" * 500 + "a" * 501, "-" * 1024, "erer" * 300 + "e"]
    for rows in (op2_byte_bpe.ROWS, 1000):
        monkeypatch.setattr(op2_byte_bpe, "ROWS", rows)
        for word in words:
            coder._learn_long(word, word.encode())
            assert np.frombuffer(coder.known[word], "<u4").tolist() == library._encode_single_piece(word.encode()), word[:40]


def test_pairs_whose_token_merges_earlier_wait(monkeypatch, tmp_path):
    """A merge table where a joined token has a pair of lower rank than its own: equal pairs cannot go together."""
    ranks = {bytes([b]): b for b in range(256)}
    for k, token in enumerate((b"bc", b"aba", b"ab", b"abab", b"cab", b"aa", b"aab")):
        ranks[token] = 256 + k
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items()))
    own = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    coder = op2_byte_bpe.Tokenizer(str(path), r"\S+|\s+")
    rng = random.Random(3)
    for _ in range(60):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))
        for learn in (lambda w: coder._learn_long(w, w.encode()), lambda w: coder.learn([w])):
            coder.known.clear()
            learn(word)
            assert np.frombuffer(coder.known[word], "<u4").tolist() == own.encode_ordinary(word), word


def own_ranks(tmp_path, tokens):
    """A tokenizer of single bytes and the tokens in this order, and the library's."""
    ranks = {bytes([b]): b for b in range(256)}
    for token in tokens:
        ranks.setdefault(token, len(ranks))
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items()))
    return op2_byte_bpe.Tokenizer(str(path), r"\S+|\s+"), tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})


def test_a_chain_beyond_one_longest_token_counts(tmp_path):
    """Merges far to the right make a token that takes a pair's second token away, which is itself as long as a token can be."""
    falling = [b"AB", b"CD", b"EF", b"GH", b"IJ", b"KL", b"MN", b"OP", b"QR", b"ST", b"UV", b"WX", b"YZ", b"01"]
    coder, own = own_ranks(tmp_path, [b"qw", b"qwe", b"qwer", b"qwert", b"zx", b"zxc", *falling, b"mn", b"zxcmn", b"yzxcmn", b"qwerty"])
    pad = b"....".join(reversed(falling)).decode()
    for match in ("qwertyzxcmn" + "...." + pad + "....", pad + "....qwertyzxcmn" + "." * 99, ("qwertyzxcmn...." + pad) * 3):
        for learn in (lambda w: coder._learn_long(w, w.encode()), lambda w: coder.learn([w])):
            coder.known.clear()
            learn(match)
            assert np.frombuffer(coder.known[match], "<u4").tolist() == own.encode_ordinary(match), match


def test_random_small_rank_files(tmp_path):
    """Tokens grown at random from random texts, so that chains of merges of mixed ranks are common."""
    rng = random.Random(12)
    for _ in range(12):
        letters, tokens = "abcdef"[: rng.randint(2, 6)], []
        parts = [c.encode() for c in letters]
        for _ in range(rng.randint(4, 40)):
            joined = rng.choice(parts) + rng.choice(parts)
            if len(joined) <= rng.choice((3, 6, 9)) and joined not in parts:
                parts.append(joined)
                tokens.append(joined)
        rng.shuffle(tokens)
        coder, own = own_ranks(tmp_path, tokens)
        for _ in range(12):
            word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 90)))
            if rng.random() < 0.3:
                word += rng.choice("xyz") + word[::-1]
            coder._learn_long(word, word.encode())
            assert np.frombuffer(coder.known[word], "<u4").tolist() == own.encode_ordinary(word), (tokens, word)
            coder.known.clear()
            coder.learn([word * 6])
            assert np.frombuffer(coder.known[word * 6], "<u4").tolist() == own.encode_ordinary(word * 6), (tokens, word)


def test_a_match_of_megabytes_is_cut_where_nothing_merges(library):
    coder = op2_byte_bpe.Tokenizer(*vocabulary())
    rng = random.Random(6)
    word = "".join(rng.choice("etaoinzqx") for _ in range(300)) + "日本" * 40
    match = word * 2000
    pieces = coder.pieces(match.encode())
    assert b"".join(pieces) == match.encode() and max(map(len, pieces)) < 3000
    coder.learn([match])
    ids = np.frombuffer(coder.known[match], "<u4").tolist()
    assert b"".join(library.decode_single_token_bytes(i) for i in set(ids)) and library.decode_bytes(ids) == match.encode()
    assert ids == library._encode_single_piece(match.encode())


def test_columns_of_the_same_names_stay(spark):
    docs = spark.createDataFrame([(1, "some words", [9], 5, "x"), (2, None, None, None, None)], "doc_id long, text string, tokens array<long>, N_TOKENS int, `a.b` string")
    out = op2_byte_bpe.tokenize(docs, *vocabulary())
    assert out.columns == ["doc_id", "tokens", "N_TOKENS", "a.b", "n_tokens_0", "tokens_0", "restored"]
    one = out.where("doc_id = 1").head()
    assert (one.tokens, one.N_TOKENS, one["a.b"], one.n_tokens_0, one.restored) == ([9], 5, "x", len(one.tokens_0), True)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(op2_byte_bpe, "REMEMBERED", 5)
    coder = op2_byte_bpe.Tokenizer(*vocabulary())
    for text in ("some words of a text", "and other words of it", "some words of a text"):
        (runs,) = coder.encode([text])
        assert coder.decode([runs]) == [text.encode()]
        assert np.frombuffer(b"".join(runs), "<u4").tolist() == library.encode_ordinary(text)


def test_tokens_round_trip(spark, corpus, empty):
    docs = corpus[0].where("doc_id >= 1000 or doc_id < 20")
    tokens = op2_byte_bpe.tokenize(docs, *vocabulary())
    assert tokens.where("not restored or n_tokens <> size(tokens)").count() == 0
    back = op2_byte_bpe.detokenize(tokens, *vocabulary())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.text == texts[r.doc_id] for r in back.collect())
    assert op2_byte_bpe.encode(empty[0], *vocabulary()).count() == 0
    assert op2_byte_bpe.detokenize(spark.range(1).select(F.col("id").alias("doc_id"), F.lit(None).cast("array<int>").alias("tokens")), *vocabulary()).head().text == ""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colloquy.llm import op3_simhash
from colloquy.llm.components import components
from tests.llm.conftest import prose, row, DOCS


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, tau):
    """The smallest id reachable, by comparing all pairs."""
    fps = [fp for _, fp in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= tau:
                root[find(i)] = find(j)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            best[find(i)] = min(doc_id, best.get(find(i), doc_id))
    return [best.get(find(i)) for i in range(len(rows))]


@pytest.fixture(scope="module")
def copies(spark):
    """Base texts, copies with a few words changed, exact copies, and odd rows."""
    rng = random.Random(9)
    rows, n = [], 0
    for _ in range(30):
        words = prose(rng, 150).split()
        for k in range(rng.randint(1, 7)):
            own = list(words)
            for _ in range(k % 4):
                own[rng.randrange(len(own))] = "changed"
            rows.append(row(n, " ".join(own)))
            n += 1
    rows += [row(500, None), row(501, ""), row(502, " \u00a0 "), row(503, "A b"), row(504, "a B"), row(None, "A b"), row(505, "x"), row(505, "x"), row(None, "alone here")]
    return spark.createDataFrame(rows, DOCS).repartition(4)


@pytest.mark.parametrize("tau", [2, 4])
def test_components_match_all_pairs(copies, tau):
    rows = op3_simhash.near_duplicates(copies, tau=tau).collect()
    assert len(rows) == copies.count()
    pairs = [(r.doc_id, r.fp & (1 << 64) - 1) for r in rows]
    assert [r.component_id for r in rows] == brute_components(pairs, tau)


def test_fingerprints_match_brute_force(copies, corpus):
    docs = copies.unionByName(corpus[0].where("doc_id is null or doc_id > 990 or doc_id < 30"))
    texts = {(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()}
    got = {(r.doc_id, int(r.fingerprint, 16)) for r in op3_simhash.report(docs).collect()}
    assert got == texts
    assert all(len(r.fingerprint) == 16 for r in op3_simhash.report(docs.limit(3)).collect())


def test_crowded_fingerprints_lose_no_link(spark):
    """Many fingerprints around one centre, and evenly spread ones: thresholds differ, links do not."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    fps = [centre]
    for _ in range(300):
        x = centre
        for b in rng.choice(63, rng.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        fps.append(x)
    fps = sorted(set(fps + [int(x) for x in rng.integers(0, 1 << 62, 300)]))
    distinct = spark.createDataFrame([(f, f) for f in fps], "fp long, group long")
    for tau in (2, 3, 4):
        plan = op3_simhash.Plan(distinct, len(fps), tau)
        assert sorted(b for p in plan.parts for b in p) == list(range(64))
        units = plan.thresholds(op3_simhash.bits_of(np.array(fps))) + 1
        assert (units.sum(1) == tau + 1).all()
        got = {(r.a, r.b) for r in op3_simhash.links(distinct, plan).collect()}
        assert got == {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(a ^ b).count("1") <= tau}


def test_pairs_of_one_group_leave_the_search_out(spark):
    rng = np.random.default_rng(4)
    fps = sorted({int(x) ^ (1 << int(b)) for x in rng.integers(0, 1 << 62, 3) for b in range(40)})
    distinct = spark.createDataFrame([(f, fps[0] if k % 2 else f) for k, f in enumerate(fps)], "fp long, group long")
    got = {(r.a, r.b) for r in op3_simhash.links(distinct, op3_simhash.Plan(distinct, len(fps), 3)).collect()}
    group = {f: fps[0] if k % 2 else f for k, f in enumerate(fps)}
    assert got == {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin(a ^ b).count("1") <= 3 and group[a] != group[b]}


@pytest.mark.parametrize("names", [("_id", "_rows", "_row"), ("_root", "_best", "_ROWS"), ("fp", "root", "component_id"), ("a.b", "row", "names")])
def test_columns_of_any_name_and_type_are_kept(spark, names):
    rng = random.Random(21)
    texts = [prose(rng, 80) for _ in range(4)]
    rows = [(k // 2 if k < 6 else k, texts[k % 4], k, {"m": k}, [k]) for k in range(10)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, `{names[0]}` long, `{names[1]}` map<string,long>, `{names[2]}` array<long>")
    kept = op3_simhash.keep_one(docs, reach=op3_simhash.REACH)
    assert kept.columns == docs.columns
    own = sorted((r[0], r[1]) for r in kept.collect())
    smallest = {t: min(d for d, x, *_ in rows if x == t) for t in texts}
    assert own == sorted((d, t) for t, d in smallest.items())


def test_one_document_of_each_group_stays(copies, empty):
    found = op3_simhash.near_duplicates(copies, tau=op3_simhash.STAGE_TAU).where("doc_id is not null").collect()
    kept = op3_simhash.keep_one(copies)
    assert kept.columns == copies.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r.component_id for r in found})
    assert ids.count(None) == 2
    assert op3_simhash.report(empty[0]).count() == 0 and op3_simhash.keep_one(empty[0]).count() == 0


def test_repeated_ids_of_unlike_texts_keep_every_group(spark):
    rng = random.Random(2)
    a, b, c = (prose(rng, 120) for _ in range(3))
    docs = spark.createDataFrame([row(5, a), row(7, a), row(5, b), row(3, b), row(9, c), row(9, a), row(5, a)], DOCS).repartition(3)
    assert sorted((r.doc_id, r.text) for r in op3_simhash.keep_one(docs).collect()) == sorted([(5, a), (3, b), (9, c)])
    two = spark.createDataFrame([row(5, a), row(5, b)], DOCS)
    assert {r.text for r in op3_simhash.keep_one(two).collect()} == {a, b}


def test_far_fingerprints_need_texts_that_agree(spark):
    """Pairs of 5 to 7 bits: near copies by five-word shingles leave one, others stay both."""
    rng, rows, expected, k = random.Random(12), [], set(), 0
    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    sets = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    seen = {True: 0, False: 0}
    while min(seen.values()) < 5:
        one = prose(rng, 120)
        words = one.split()
        for at in rng.sample(range(0, 120, 12), rng.choice((1, 2, 5, 6))):
            words[at] = prose(rng, 1)
        two = " ".join(words)
        bits = bin(brute_fingerprint(one) ^ brute_fingerprint(two)).count("1")
        near = alike(sets(one), sets(two))
        if 5 <= bits <= 7 and seen[near] < 5:
            seen[near] += 1
            rows += [row(k, one), row(k + 1, two)]
            expected |= {k} if near else {k, k + 1}
            k += 2
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert {r.doc_id for r in op3_simhash.keep_one(docs, reach=op3_simhash.REACH).collect()} == expected


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = spark.createDataFrame(chain + star + [(7, 7), (3, 2)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(200))
    assert components(edges.where(F.lit(False))).count() == 0

import itertools
import random

import numpy as np

from reelframe.llm import near_dups
from reelframe.llm.common import Scratch
from reelframe.llm.components import components
from tests.llm.helpers import TEXTS, empty, odd_documents


def brute(rows, k=2, percent=80):
    """Component of each (id, text), by all pairs of different texts."""
    sets = {i: near_dups.word_shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def corpus(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    out = []
    for size in (3, 8, 20, 60, 200):
        base = [word() for _ in range(size)]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randint(0, max(1, size // 8))):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
        out += [" ".join(base)] * 5
    out += [" ".join(word() for _ in range(50)) for _ in range(40)]
    rng.shuffle(out)
    return list(enumerate(out))


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    got = {r["doc_id"]: r for r in near_dups.near_duplicates(docs).collect()}
    want = brute(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) and r["n_shingles"] == len(near_dups.word_shingles(dict(rows)[i])) for i, r in got.items())


def test_large_groups_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "SMALL", 4)
    monkeypatch.setattr(near_dups, "BLOCK", 8)
    monkeypatch.setattr(near_dups, "ASKED", 5)
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(docs).collect()} == brute(rows)


def test_five_words(spark):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(docs, shingle=5).collect()} == brute(rows, 5)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = near_dups.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS) + 3
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[0] == by[0][:1] == [(0, 0, True)] and by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)]
    assert by[3] == [(1, 3, True)] * 3 and by[6] == [(1, 6, True)] and by[7] == [(1, 6, False)] and by[8] == [(1, 8, True)]
    assert by[None] == [(1, None, True)]
    assert near_dups.near_duplicates(empty(docs)).count() == 0


def test_words_and_case():
    assert near_dups.words("A\u00a0b\tÉ") == ["a\u00a0b".encode(), "É".encode()]
    assert near_dups.words("a\x1cb\u2003c") == ["a\x1cb\u2003c".encode()]
    assert near_dups.word_shingles("one") == {b"one"} and near_dups.word_shingles(" \n") == set()


def test_matches_by_chance_follow_both_sizes():
    rng = np.random.default_rng(1)
    sketch = lambda n: near_dups.sketch(np.unique(rng.integers(0, 2**64, n, np.uint64)))
    for n, m in ((3000, 3000), (3000, 400)):
        pairs = [(sketch(n), sketch(m)) for _ in range(1500)]
        seen = np.mean([((a == b) & (a > 0)).sum() for a, b in pairs])
        told = float(near_dups.chance(np.array([n]), np.array([m]))[0])
        assert abs(seen - told) < 0.02, (n, m, seen, told)
    small, large = (float(near_dups.chance(np.array([2**20]), np.array([m]))[0]) for m in (2**10, 2**20))
    assert small < large and abs(large - 0.1699 / 4) < 0.003


def test_sketches_estimate():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(20):
            both = rng.integers(0, 2**64, 2000, np.uint64)
            n = int(2000 * share)
            rest = [rng.integers(0, 2**64, (2000 - n) // 2, np.uint64) for _ in "ab"]
            a, b = (near_dups.sketch(np.unique(np.concatenate([both[:n], r]))) for r in rest)
            errors.append(((a == b) & (a > 0)).sum() / ((a > 0) | (b > 0)).sum() - share)
        assert abs(np.mean(errors)) < 0.03
    few = near_dups.densify(near_dups.sketch(np.array([5], np.uint64))[None, :])
    assert (few > 0).all() and len(np.unique(few)) == 1
    assert not near_dups.densify(np.zeros((2, 256), np.uint16)).any()


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 240), rng.randrange(200, 240)) for _ in range(25)] + [(7, 7), (1, 0)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "c").count() == 0

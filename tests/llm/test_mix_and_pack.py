import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.llm import length_buckets, soft_mixing
from reelframe.llm.common import read
from tests.llm.helpers import TEXTS, empty, odd_documents


def padding(lengths, ends):
    return sum(min(e for e in ends if e >= n) - n for n in lengths)


def test_boundaries_are_optimal():
    rng = random.Random(0)
    for _ in range(30):
        lengths = [rng.randint(0, 30) for _ in range(rng.randint(1, 25))]
        cells = sorted(set(lengths))
        count = np.array([lengths.count(c) for c in cells])
        for buckets in (1, 2, 3, 5):
            ends = length_buckets.boundaries(np.array(cells), count, buckets)
            best = min(padding(lengths, [*c, cells[-1]]) for c in itertools.combinations(cells[:-1], min(buckets, len(cells)) - 1))
            assert padding(lengths, ends) == best and len(ends) == min(buckets, len(cells)) and ends == sorted(ends)


def test_batches_hold_their_budget(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(["w"] * int(rng.paretovariate(0.7)))) for i in range(500)] + [(9000, "w " * 5000)], "doc_id long, text string")
    got = length_buckets.pack(docs, buckets=5, tokens=1000).collect()
    assert len(got) == 501
    batches = {}
    for r in got:
        assert r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["bucket_len"])
    assert all(sum(b) <= 1000 or len(b) == 1 for b in batches.values())
    for bucket in {b for b, _ in batches}:
        own = sorted(b for k, b in batches if k == bucket)
        assert own == list(range(len(own)))  # batches run on without a gap
        sizes = [len(batches[bucket, b]) for b in own]
        assert len(set(sizes[:-1])) <= 1 and sizes[-1] <= sizes[0]


def test_boundaries_are_optimal_for_long_texts():
    """Clustered lengths far beyond 511 tokens, against the plain recurrence over all cuts."""
    rng = random.Random(3)
    lengths = sorted(rng.choice([600, 1500, 1515, 7000, 7040, 20_000]) + rng.randint(0, 40) for _ in range(400))
    cells = sorted(set(lengths))
    best = {0: 0}
    for buckets in range(1, 7):
        best = {j: min(best[i] + sum(cells[j - 1] - n for n in lengths if (i == 0 or n > cells[i - 1]) and n <= cells[j - 1]) for i in best if i < j) for j in range(buckets, len(cells) + 1)}
        ends = length_buckets.boundaries(np.array(cells), np.array([lengths.count(c) for c in cells]), buckets)
        assert padding(lengths, ends) == best[len(cells)]


def test_equal_rows_are_counted_and_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(length_buckets, "RUN", 7)
    docs = spark.createDataFrame([(None, "a b")] * 50 + [(None, "c")] * 20 + [(4, "d e")] * 30 + [(i, "x y z") for i in range(10)], "doc_id long, text string")
    got = length_buckets.pack(docs, buckets=2, tokens=8).collect()
    assert len(got) == 110 and sum(r["doc_id"] is None for r in got) == 70
    held = {}
    for r in got:
        held.setdefault((r["bucket"], r["batch"]), []).append(r["bucket_len"])
    for bucket in (0, 1):
        own = sorted(b for k, b in held if k == bucket)
        assert own == list(range(len(own)))
    assert all(sum(b) <= 8 for b in held.values())


def test_pack_odd_rows(spark):
    docs = odd_documents(spark)
    got = length_buckets.pack(docs).collect()
    assert len(got) == len(TEXTS) + 3
    assert {r["doc_id"]: r["n_tokens"] for r in got}[8] == 30_000
    assert length_buckets.pack(empty(docs)).count() == 0
    same = spark.createDataFrame([(1, "a b")] * 7, "doc_id long, text string")
    assert {(r["bucket"], r["padding"]) for r in length_buckets.pack(same).collect()} == {(0, 0)}
    own = length_buckets.pack(docs, length=F.coalesce(F.length("text"), F.lit(0)))
    assert {r["doc_id"]: r["n_tokens"] for r in own.collect()}[9] == 5000


def brute_mix(rows, labels, targets):
    """The same classifier and gradient steps document by document, in numpy."""
    share = lambda t, chars: sum(t.count(c) for c in chars) / (len(t) + 1)
    x = np.array([[share(t, soft_mixing.SYMBOLS), share(t, soft_mixing.CAPITALS), share(t, " "), share(t, ".,"), len(set(t.split("\n"))) / len(t.split("\n"))] for _, t in rows])
    y = np.array([labels.get(i, -1) for i, _ in rows])
    logs = []
    for k in sorted(targets):
        own = x[y == k]
        m, s = own.mean(axis=0), np.maximum(own.std(axis=0), soft_mixing.FLOOR)
        logs.append((math.log((y == k).sum() / (y >= 0).sum()) - ((x - m) ** 2 / (2 * s * s) + np.log(s)).sum(axis=1)) / soft_mixing.TEMPER)
    e = np.exp(np.array(logs) - np.max(logs, axis=0))
    p = np.round(e / e.sum(axis=0) * soft_mixing.GRID)
    p = p / p.sum(axis=0)
    tokens = np.array([len(t.split()) for _, t in rows], float)
    whole, goal = tokens.sum(), np.array([targets[k] for k in sorted(targets)])
    mass = (p * tokens).sum(axis=1) / whole
    r, step = np.ones(len(rows)), 1 / (1 + soft_mixing.RIDGE)
    for _ in range(200):
        residual = ((p * tokens * r).sum(axis=1) / whole - goal) / mass
        r = np.maximum(0, r - step * (p.T @ residual + soft_mixing.RIDGE * (r - 1)))
    return p, tokens, r


def test_mixing_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    labels = {r["doc_id"]: r["quality"] for r in read(spark, sf, "labels").collect()}
    p, tokens, r = brute_mix(rows, labels, soft_mixing.TARGETS)
    got = soft_mixing.query(spark, sf).orderBy("doc_id").collect()
    assert np.allclose([g["n_tokens"] for g in got], tokens)
    assert np.mean(np.isclose([g["rate"] for g in got], r, atol=2e-3)) > 0.97
    total = np.array([[g["rate"] * g["n_tokens"] * v for v in g["posterior"]] for g in got]).sum(axis=0) / tokens.sum()
    assert np.allclose(total, [0.05, 0.95], atol=2e-3)
    assert all(abs(g["copies"] - g["rate"]) < 1 for g in got)


def test_mixing_is_native(spark, sf):
    plan = soft_mixing.query(spark, sf)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "Cartesian", "BroadcastNestedLoop"))


def test_mixing_keeps_columns_that_clash(spark):
    docs = spark.createDataFrame([(i, "one two " * (i + 1), i, 0.5, "p") for i in range(20)], "doc_id long, text string, n_tokens long, x0 double, p string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    got = soft_mixing.mix(docs, labels, keep=["doc_id", "text", "x0", "p"])
    assert got.columns[:4] == ["doc_id", "text", "x0", "p"]
    rows = got.select("doc_id", "text", "n_tokens", "x0").collect()
    assert len(rows) == 20 and all(r["text"] == "one two " * (r["doc_id"] + 1) and r["n_tokens"] == 2 * (r["doc_id"] + 1) and r["x0"] == 0.5 for r in rows)


def test_mixing_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, None), (11, 0), (9, 5)], "doc_id long, quality int")
    got = soft_mixing.mix(docs, labels).collect()
    assert len(got) == len(TEXTS) + 3 and all(r["rate"] >= 0 and r["copies"] >= 0 for r in got)
    assert len({r["copies"] for r in got if r["doc_id"] == 3}) == 1
    assert soft_mixing.mix(empty(docs), labels).count() == 0
    none = soft_mixing.mix(docs, empty(labels)).collect()
    assert len({tuple(r["posterior"]) for r in none}) == 1
    three = soft_mixing.mix(docs, labels, targets={0: 1, 1: 1, 2: 1}).collect()
    assert len(three) == len(got) and all(r["posterior"][2] == 0 for r in three)


def rare_documents(spark, odd, rare, plain):
    """Two domains that texts tell apart; ``rare`` documents, whose text is odd, belong to domain 0."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(odd if i < rare else plain) for _ in range(50)) for i in range(1000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i >= rare)) for i in range(1000)], "doc_id long, quality int")


def token_shares(got):
    whole = sum(g["n_tokens"] for g in got)
    return np.array([[g["rate"] * g["n_tokens"] * v for v in g["posterior"]] for g in got]).sum(axis=0) / whole


def test_mixing_reaches_the_targets_of_a_rare_domain(spark):
    docs, labels = rare_documents(spark, ["#*%", "{}=", "<>", "a"], 10, ["word", "Another", "thing."])
    for targets in ({0: 0.5, 1: 0.5}, {0: 0.9, 1: 0.1}):
        got = soft_mixing.mix(docs, labels, targets=targets).collect()
        assert np.allclose(token_shares(got), [targets[0], targets[1]], rtol=2e-3)
        assert all(g["targets_met"] for g in got) and max(g["rate"] for g in got) > 45
        assert all(abs(g["copies"] - g["rate"]) < 1 for g in got)


def test_mixing_converges_for_a_weak_classifier(spark):
    docs, labels = rare_documents(spark, ["word", "Another", "thing."], 500, ["word", "Another", "thing", "thing."])
    base = token_shares([{**g.asDict(), "rate": 1.0} for g in soft_mixing.mix(docs, labels).collect()])
    for by in (0.02, 0.1):
        goal = {0: base[0] + by, 1: base[1] - by}
        got = soft_mixing.mix(docs, labels, targets=goal).collect()
        assert np.allclose(token_shares(got), [goal[0], goal[1]], rtol=2e-3) and all(g["targets_met"] for g in got)


def test_mixing_tells_of_targets_out_of_reach(spark):
    docs, labels = rare_documents(spark, ["#*%", "{}="], 10, ["word", "thing."])
    with pytest.warns(UserWarning, match="miss the targets"):
        got = soft_mixing.mix(docs, labels, targets={0: 0.4, 1: 0.4, 2: 0.2}).collect()
    assert len(got) == 1000 and not any(g["targets_met"] for g in got)

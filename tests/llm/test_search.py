import numpy as np
import pytest

from reelframe.llm import additive_codes, hamming_search
from tests.llm.helpers import empty

FIELDS = "vec_id long, embedding array<float>, rank int, code string"


def vectors(spark, n=400, d=16, seed=0, copies=120):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[50 : 50 + copies] = x[50]
    rows = [(i, v.tolist(), 1, "c") for i, v in enumerate(x)]
    odd = [(1000, None, 1, "c"), (1001, [0.0] * d, 1, "c"), (1020, [float("nan")] * d, 1, "c"), (1040, [None] + [1.0] * (d - 1), 1, "c"), (1060, [], 1, "c"), (1080, [1.0], 1, "c"), (None, [1.0] * d, 1, "c"), (1100, [float("inf")] * d, 1, "c"), (7, x[7].tolist(), 1, "c")]
    return x, spark.createDataFrame(rows + odd, FIELDS)


@pytest.mark.parametrize("every_row", [False, True])
def test_additive_against_brute_force(spark, monkeypatch, every_row):
    monkeypatch.setattr(additive_codes, "SHORTLIST", 20)
    monkeypatch.setattr(additive_codes, "LEAST_GROUP", 100)
    x, df = vectors(spark)
    got = {}
    for r in additive_codes.search(df, every=20, k=10, exact=every_row).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    exact = x.astype(float) @ x.astype(float).T
    hits = 0
    assert sorted(got) == list(range(0, 400, 20))
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, 11))
        order = [i for i in np.lexsort((np.arange(400), -exact[q])) if i != q][:10]
        hits += len({v for v, _ in ranks.values()} & set(order))
        scores = [ranks[k][1] for k in range(1, 11)]
        assert scores == sorted(scores, reverse=True)
        assert all(abs(s - exact[q, v]) < 1e-9 for v, s in ranks.values())
    assert hits >= (1 if every_row else 0.9) * 10 * len(got)
    # of equal vectors the smaller ids
    for ranks in got.values():
        own = [v for v, _ in (ranks[k] for k in sorted(ranks)) if 50 <= v < 170]
        assert own == sorted(own)


def test_recall_does_not_fall_with_the_rows(spark):
    """In one group, at two sizes, with the production shortlist."""
    rng = np.random.default_rng(8)
    for n in (2000, 20_000):
        x = rng.normal(size=(n, 32)).astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        got = {}
        for r in additive_codes.search(df.coalesce(4), every=n // 20, group=1 << 17).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        exact = x[:: n // 20].astype(float) @ x.astype(float).T
        hits = [len(got[q] & set([j for j in np.argsort(-exact[i]) if j != q][:20])) for i, q in enumerate(range(0, n, n // 20))]
        assert np.mean(hits) >= 0.95 * 20


def test_additive_in_double_precision(spark):
    rows = [(0, [1e200, 1.0]), (20, [1e-200, 0.0]), (1, [1e-150, 3.0]), (2, [0.1, 0.2]), (3, [-1.0, 1e-300])]
    got = additive_codes.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4).collect()
    by = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    x = dict(rows)
    assert len(by) == 8 and all(s == x[q][0] * x[v][0] + x[q][1] * x[v][1] for (q, v), s in by.items())


def test_additive_on_little(spark):
    _, df = vectors(spark)
    assert additive_codes.search(empty(df)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, ""), (1, [1.0, 0.0], 1, ""), (2, [0.0, 2.0], 1, "")], FIELDS)
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in additive_codes.search(few).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]
    one = spark.createDataFrame([(0, [1.0, 0.0], 1, "")], FIELDS)
    assert additive_codes.search(one).count() == 0


def test_codes_shrink_the_error():
    x = np.random.default_rng(1).normal(size=(2000, 16)).astype(np.float32)
    error = []
    for books in (1, 4, 8):
        c = additive_codes.Codebooks.fit(x, books, 16, 4, 1)
        error.append(float(((x - c.decode(c.encode(x))) ** 2).sum() / (x**2).sum()))
    assert error[0] > error[1] > error[2]
    c = additive_codes.Codebooks.fit(x, 4, 16, 4, 1)
    codes = c.encode(x[:50])
    assert np.allclose(c.scores(x[:5], codes, np.ones(50, np.float32)), x[:5] @ c.decode(codes).T, atol=1e-3)


@pytest.mark.parametrize("d,k", [(16, 5), (64, 10), (70, 3)])
def test_hamming_is_exact(spark, monkeypatch, d, k):
    monkeypatch.setattr(hamming_search, "LEAST_GROUP", 80)
    x, df = vectors(spark, d=d, seed=d)
    codes = hamming_search.binary_codes(df, "vec_id", "embedding")
    got = {}
    for r in hamming_search.search_codes(codes, codes.where("id % 20 = 0"), k=k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["distance"]))
    ids = [*range(400), 1001]
    bits = np.concatenate([x > 0, np.zeros((1, d), bool)])
    for q in range(0, 400, 20):
        dist = (bits != bits[q]).sum(axis=1)
        want = sorted((int(dist[j]), ids[j]) for j in range(len(ids)) if ids[j] != q)[:k]
        assert [(d_, v) for _, v, d_ in sorted(got[q])] == want


def test_hamming_on_little(spark):
    _, df = vectors(spark)
    codes = hamming_search.binary_codes(empty(df), "vec_id", "embedding")
    assert hamming_search.search_codes(codes, codes).count() == 0

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelframe.operators import packing


def fold(sizes, costs, size, memory):
    p = packing.Packer(size, memory)
    return [p.place(s, c) for s, c in zip(sizes, costs, strict=True)]


entries = st.lists(st.tuples(st.integers(0, 160), st.integers(0, 9)), max_size=60)


@given(entries, st.one_of(st.none(), st.integers(1, 25)), st.integers(0, 60), st.integers(0, 60))
def test_ranges_pack_like_the_fold(rows, memory, a, b):
    sizes, costs = (np.array(x, np.int64) for x in (list(zip(*rows, strict=True)) or ([], [])))
    want = fold(sizes.tolist(), costs.tolist(), 100, memory)
    cuts = [0, *sorted(min(x, len(rows)) for x in (a, b)), len(rows)]
    state, got = [0, 0, 0, 0], []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        r = packing.Range(sizes[lo:hi], costs[lo:hi], 100, memory)
        got += list(zip(*(x.tolist() for x in r.places(*state)), strict=True))
        closed, last = r.chains()
        reach = min(r.n, int(np.searchsorted(r.bytes, r.most, "right")))
        of = last[: reach + 1]
        arrays = [r.bytes[: reach + 1], r.held[: reach + 1], closed[: reach + 1], r.n - of, r.bytes[-1] - r.bytes[of], r.held[-1] - r.held[of]]
        row = dict(zip(packing.SUMMARY[1:7], (x.astype(np.int64).tobytes() for x in arrays), strict=True)) | {"n": r.n, "all_bytes": int(r.bytes[-1]), "all_held": int(r.held[-1])}
        state = packing._after(row, state, 100, memory)
    assert got == want


@pytest.mark.parametrize("memory", [None, 40])
def test_pack_in_several_ranges(spark, monkeypatch, memory):
    monkeypatch.setattr(packing, "RANGE", 300)
    rng = np.random.default_rng(1)
    sizes, costs = rng.integers(0, 90, 2000).tolist(), rng.integers(0, 9, 2000).tolist()
    rows = spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(zip(sizes, costs, strict=True))], "ord long, size long, cost long").repartition(5)
    got = packing.pack_slices(rows, 400, order=["ord"], memory=memory, cost="cost").orderBy("ord").collect()
    assert [(r["slice"], r["file_num"]) for r in got] == fold(sizes, costs, 400, memory)
    plan = packing.pack_slices(rows, 400, order=["ord"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert packing.pack_slices(rows.where(F.lit(False)), 400, order=["ord"]).count() == 0


def test_running_over_ranges(spark):
    rows = spark.createDataFrame([(min(i, 700), i, i % 3) for i in range(1000)], "a long, b long, w long").repartition(3)
    got = packing.running(rows, [F.col("a"), F.col("b")], F.col("w"), "before", most=64).orderBy("b").collect()
    assert [r["before"] for r in got] == np.concatenate([[0], np.cumsum([i % 3 for i in range(999)])]).tolist()

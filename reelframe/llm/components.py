"""Connected components of a graph given as an edge table, by stars.

Large-star and small-star steps alternate: each hangs neighbours under the smallest
id seen so far, so the longest path shrinks by a factor at every round.  Minima are
aggregated before the shuffle and joined back, so that a hub with very many
neighbours is split like any skewed join; no neighbourhood is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.common import Scratch


def _hang(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(u, v, m), m the smallest of u and its neighbours.

    The minima are written first, so the join has two plain sides and a hub is split.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(scratch.keep(least, name), "u")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root the smallest id reachable.

    Self loops and repeated edges do no harm; no edges give no rows.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())

    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    seen, turn = state(now), 0
    while seen[0]:
        turn += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both, scratch, f"{name}-large-{turn}").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.keep(large, f"{name}-between-{turn}")
        small = _hang(large, scratch, f"{name}-small-{turn}")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        then = scratch.keep(small, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}", *(f"{name}-{step}-{turn}" for step in ("large", "between", "small")))
        now, before, seen = then, seen, state(then)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()

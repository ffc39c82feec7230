"""Exact top-k search: incremental multi-index hashing for binary codes.

A code is cut into segments of 16 bits.  Two codes at Hamming distance d agree in some
segment up to distance d // segments, so once all segments have been searched to
radius r, every code up to distance segments * (r + 1) - 1 has been seen.  A query
grows r until the k-th best verified distance is within that bound; what it returns is
exact, ties included.

The codes are dealt by a hash into groups of bounded size.  A task holds one group,
builds its index once, and all queries stream by; it returns the best of each query, and
the best of all groups are ranked.  So a code is shuffled once and a query once for
each group.  Equal codes are indexed once and stand for their k + 1 smallest ids, which
no ranking can need more of, so a code with very many copies neither fills a bucket
nor a task.

Nulls and odd input: rows with a null id, or a vector that is null, empty, has null
or non-finite components or not the usual length, are neither queries nor candidates; a zero component
gives bit 0; ties go to the smaller id; a repeated id counts once for each different
code; with fewer candidates than k all are returned; empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelframe.llm.common import Scratch, against, labels, read

K = 10
GROUP, LEAST_GROUP = 1 << 18, 8192  # codes of a group at most, and at least where there are several


class MultiIndex:
    """Multi-index hashing over a block of different codes (rows, bytes)."""

    def __init__(self, codes: np.ndarray):
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], axis=1)
        self.codes = np.ascontiguousarray(codes).view(np.uint16)
        self.segments = []
        for j in range(self.codes.shape[1]):
            order = np.argsort(self.codes[:, j], kind="stable")
            values, start = np.unique(self.codes[order, j], return_index=True)
            self.segments.append((values, np.append(start, len(order)), order))

    def nearest(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of all codes as near as the k-th nearest, or nearer."""
        q = np.zeros(self.codes.shape[1] * 2, np.uint8)
        q[: len(code)] = code
        q = q.view(np.uint16)
        away = [np.bitwise_count(values ^ v) for (values, _, _), v in zip(self.segments, q, strict=True)]
        seen = np.zeros(len(self.codes), bool)
        rows, dist = np.empty(0, np.int64), np.empty(0, np.int64)
        for r in range(17):
            for (_, start, order), a in zip(self.segments, away, strict=True):
                at = np.flatnonzero(a == r)
                if not len(at):
                    continue
                n = start[at + 1] - start[at]
                own = order[np.repeat(start[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                own = own[~seen[own]]
                seen[own] = True
                rows = np.concatenate([rows, own])
                dist = np.concatenate([dist, np.bitwise_count(self.codes[own] ^ q).sum(axis=1, dtype=np.int64)])
            if len(rows) >= min(k, len(self.codes)):
                kth = np.partition(dist, min(k, len(dist)) - 1)[min(k, len(dist)) - 1]
                if kth <= len(self.segments) * (r + 1) - 1 or len(rows) == len(self.codes):
                    break
        keep = dist <= kth if len(rows) else np.zeros(0, bool)
        return rows[keep], dist[keep]


def binary_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, code): the signs of the components, eight to a byte."""
    v = F.col(vector_col)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    rows = rows.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length:
        rows = rows.where(F.size("v") == length["n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bits = np.packbits(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) > 0, axis=1)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in bits], pa.binary())], names=["id", "code"])

    return rows.mapInArrow(run, "id long, code binary")


def nearest_in_group(held: pa.Table, keep: int) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """Answers queries (rep: their number, code) with the ``keep`` nearest codes of a group: query, rep, distance."""
    reps, raw = held.column("rep").to_numpy(), held.column("code").to_pylist()
    index = MultiIndex(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1))

    def answer(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for c in b.column("code").to_pylist():
            rows, dist = index.nearest(np.frombuffer(c, np.uint8), keep)
            best = np.lexsort((reps[rows], dist))[:keep]
            out.append((reps[rows[best]], dist[best]))
        at = np.repeat(np.arange(len(out)), [len(r) for r, _ in out])
        yield pa.RecordBatch.from_arrays([b.column("rep").take(pa.array(at)), pa.array(np.concatenate([r for r, _ in out])), pa.array(np.concatenate([d for _, d in out]).astype(np.int32))], names=["query", "rep", "distance"])

    return answer


def search_codes(codes: DataFrame, queries: DataFrame, *, k: int = K, group: int = GROUP) -> DataFrame:
    """The k nearest of ``codes`` (id, code) for each of ``queries`` (id, code), the row with its own id left out."""
    spark = codes.sparkSession
    scratch = Scratch(spark, "hamming-search")
    same = W.partitionBy("code").orderBy("id")
    members = codes.dropDuplicates(["id", "code"]).withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    members = scratch.keep(members.withColumn("rep", F.first("id").over(same)), "members")
    asked = scratch.keep(queries.dropDuplicates(["id", "code"]).withColumn("query", F.monotonically_increasing_id()), "asked")
    first = members.where("nth = 1")
    n, wide = first.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-n // group), min(wide, n // LEAST_GROUP))
    places = F.array(*(F.lit(p).cast("long") for p in labels(spark, parts)))
    held = first.select(F.get(places, F.pmod(F.xxhash64("code"), F.lit(parts)).cast("int")).alias("part"), F.lit(False).alias("asked"), "rep", "code")
    sent = asked.select(F.explode(places).alias("part"), F.lit(True).alias("asked"), F.col("query").alias("rep"), "code")
    near = against(held.unionByName(sent), "part", lambda t: nearest_in_group(t, k + 1), "query long, rep long, distance int", parts)
    best = F.row_number().over(W.partitionBy("query").orderBy("distance", "rep"))
    ranked = near.withColumn("r", best).where(F.col("r") <= k + 1).join(asked.select("query", F.col("id").alias("query_id")), "query")
    whole = ranked.join(members.select("rep", F.col("id").alias("vec_id")), "rep").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", "vec_id"))
    return whole.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = binary_codes(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search_codes(codes, codes.where("id % 100 = 0"))


SQL = f"""
WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, len(list_filter(list_zip(q.embedding, c.embedding), lambda z: (z[1] > 0) <> (z[2] > 0)))::INTEGER AS distance
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank, vec_id, distance FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= {K}
"""

"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of ``BOOKS`` codebooks; codewords have
all dimensions of the vector.  The codebooks start as residual k-means, one level
after another, and are then fitted together: encode by beam search, solve the least
squares problem of all codewords, and again.  Encoding keeps the ``BEAM`` best partial
sums at each codebook.  With the codes goes the norm of the sum and of the vector.

The rows are dealt by a hash into groups of ``GROUP`` at most; a task holds one group, its
codes and vectors, and all queries stream by.  So each code and vector is shuffled
once, and a query once for each group.  A query is answered from tables of its inner
products with all codewords: a code's score is the sum of ``BOOKS`` look-ups, scaled by
the stored norms (vector by sum).  Of each group the best codes, one in ``SHARE`` and
``SHORTLIST`` at least, are scored anew on the original vectors in double precision, and
the group's nearest go on; of these the ``k`` nearest are returned.  As each group has a
shortlist of its own, what is scored anew grows with the rows, and recall does not fall
as they do.  ``exact=True`` scores every row anew, in blocks.

What is fitted on a sample are the codebooks alone (``FIT_ROWS`` rows at most, those
with the smallest hash of their id); every row is encoded, and every query is held
against all codes.  Equal vectors are encoded once and stand for their k + 1 smallest
ids, which no ranking can need more of, so a vector with very many copies neither fills
the shortlist nor one task.  Codes are of directions: a vector's length is only in its norm.

Nulls and odd input: rows whose vector is null, zero, of another length than most or
with null or non-finite components, or whose id is null, are neither queries nor
candidates; ties go to the smaller id; a repeated id counts once for each different
vector; with fewer candidates than k all are returned; empty tables give no rows;
components may be floats or doubles, and scores are of their own precision; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelframe.llm.common import Scratch, against, labels, read

BOOKS, WORDS, BEAM = 32, 64, 6
FIT_ROWS, ROUNDS, FIT_BEAM = 16_384, 3, 4
K, SHORTLIST, SHARE = 20, 64, 256
GROUP, LEAST_GROUP, BLOCK = 1 << 17, 4096, 8192  # rows of a group at most, and at least where there are several


class Codebooks:
    """``books`` codebooks of ``words`` codewords each."""

    def __init__(self, c: np.ndarray):
        self.c = c.astype(np.float32)  # (books, words, dimensions)

    @classmethod
    def fit(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, beam: int = FIT_BEAM, rounds: int = ROUNDS, seed: int = 5) -> Codebooks:
        rng, rest = np.random.default_rng(seed), x.astype(np.float32).copy()
        words, levels = max(1, min(words, len(x))), []
        for _ in range(books):
            c = rest[rng.choice(len(rest), words, replace=False)].copy()
            for _ in range(8):
                at = (rest @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
                n = np.bincount(at, minlength=words)
                sums = np.zeros_like(c)
                np.add.at(sums, at, rest)
                c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], rest[rng.choice(len(rest), words)])
            at = (rest @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
            rest -= c[at]
            levels.append(c)
        self = cls(np.stack(levels))
        for _ in range(rounds):
            codes = self.encode(x, beam)
            # all codewords at once: min |A C - x|, A the one-hot rows of the codes
            size = books * words
            gram, right = np.zeros((size, size)), np.zeros((size, x.shape[1]))
            for i in range(books):
                rows = slice(i * words, (i + 1) * words)
                one = np.zeros((len(x), words), np.float32)
                one[np.arange(len(x)), codes[:, i]] = 1
                right[rows] = one.T @ x
                for j in range(i, books):
                    block = np.bincount(codes[:, i].astype(np.int64) * words + codes[:, j], minlength=words * words).reshape(words, words)
                    gram[rows, j * words : (j + 1) * words] = block
                    gram[j * words : (j + 1) * words, rows] = block.T
            own = self.c.reshape(size, -1).astype(np.float64)
            self = cls(np.linalg.solve(gram + 0.1 * np.eye(size), right + 0.1 * own).reshape(self.c.shape))
        return self

    def encode(self, x: np.ndarray, beam: int = BEAM, block: int = 1024) -> np.ndarray:
        """Codes (rows, books) by beam search over partial sums."""
        books, words, _ = self.c.shape
        out = np.empty((len(x), books), np.uint8)
        half = 0.5 * (self.c * self.c).sum(axis=2)
        for at in range(0, len(x), block):
            v = x[at : at + block].astype(np.float32)
            n, d = v.shape
            # rest: what the words so far leave of the vector; cost: half its square less the vector's
            rest, cost, picked = v[:, None, :], np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.uint8)
            for m in range(books):
                more = half[m] - (rest.reshape(-1, d) @ self.c[m].T).reshape(n, -1, words) + cost[:, :, None]
                flat = more.reshape(n, -1)
                width = min(beam if m < books - 1 else 1, flat.shape[1])
                best = np.argpartition(flat, width - 1, axis=1)[:, :width]
                cost = np.take_along_axis(flat, best, axis=1)
                word = best % words
                before = best // words
                rest = np.take_along_axis(rest, before[:, :, None], axis=1) - self.c[m][word]
                picked = np.concatenate([np.take_along_axis(picked, before[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
            out[at : at + block] = picked[:, 0]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.c[m][codes[:, m]] for m in range(len(self.c)))

    def scores(self, queries: np.ndarray, codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """(queries, codes): sums of look-ups, scaled by the stored norms."""
        tables = np.einsum("qd,mwd->mwq", queries.astype(np.float32), self.c, optimize=True)
        total = tables[0][codes[:, 0]]
        for m in range(1, len(tables)):
            total += tables[m][codes[:, m]]
        total *= scale[:, None]
        return total.T


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part; v: array of float or double."""
    v = F.col(vector_col)
    kind = "array<float>" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "array<double>"
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).select(F.col(id_col).cast("long").alias("id"), v.cast(kind).alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda e: e != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == length["n"]) if length else rows


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def directions(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in single precision, however large or small they are."""
    x = x / np.abs(x).max(axis=1, keepdims=True).astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products over the last axis in double precision, component after component."""
    total = np.zeros(np.broadcast_shapes(x.shape[:-1], q.shape[:-1]))
    for j in range(x.shape[-1]):
        total += x[..., j].astype(np.float64) * q[..., j].astype(np.float64)
    return total


def encode(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds code and scale (the vector's norm by that of its code's sum) to (rep, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = matrix(b.column("v")).astype(np.float64)
                x = directions(v)
                codes = books.encode(x)
                norm = np.abs(v).max(axis=1) * np.linalg.norm(v / np.abs(v).max(axis=1, keepdims=True), axis=1)
                scale = norm / np.maximum(np.linalg.norm(books.decode(codes), axis=1), 1e-12)
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("v"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale)], names=["rep", "v", "code", "scale"])

    return run


def nearest_in_group(held: pa.Table, books: Codebooks, keep: int, exact: bool) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """Answers queries (rep: their number, v) with the ``keep`` nearest rows of a group: query, rep, score."""
    reps, x, scale = held.column("rep").to_numpy(), matrix(held.column("v")), held.column("scale").to_numpy()
    codes = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(len(reps), -1)
    short = len(reps) if exact else min(len(reps), max(SHORTLIST, 3 * keep, len(reps) // SHARE))

    def answer(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        q = matrix(b.column("v"))
        if short < len(reps):
            guess, rows, small = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64), directions(q)
            for at in range(0, len(reps), BLOCK):
                own = slice(at, min(at + BLOCK, len(reps)))
                s = books.scores(small, codes[own], scale[own])
                guess, rows = np.concatenate([guess, s], axis=1), np.concatenate([rows, np.broadcast_to(np.arange(own.start, own.stop), s.shape)], axis=1)
                if guess.shape[1] > short:
                    top = np.argpartition(-guess, short - 1, axis=1)[:, :short]
                    guess, rows = (np.take_along_axis(z, top, axis=1) for z in (guess, rows))
        out = []
        for i in range(len(q)):
            near, score = (rows[i], products(x[rows[i]], q[i])) if short < len(reps) else (np.arange(len(reps)), products(x, q[i]))
            best = np.lexsort((reps[near], -score))[:keep]
            out.append((near[best], score[best]))
        at = np.repeat(np.arange(len(q)), [len(n) for n, _ in out])
        yield pa.RecordBatch.from_arrays([b.column("rep").take(pa.array(at)), pa.array(reps[np.concatenate([n for n, _ in out])]), pa.array(np.concatenate([s for _, s in out]))], names=["query", "rep", "score"])

    return answer


def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = K, exact: bool = False, group: int = GROUP) -> DataFrame:
    """The k nearest by inner product of each row whose id ``every`` divides: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "additive-codes")
    rows = usable(vectors, id_col, vector_col).dropDuplicates(["id", "v"])
    same = W.partitionBy("v").orderBy("id")
    members = rows.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    members = scratch.keep(members.withColumn("rep", F.first("id").over(same)), "members")
    first = members.where("nth = 1").select("rep", "v")
    sample = first.orderBy(F.xxhash64("rep"), "rep").limit(FIT_ROWS).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = np.argsort(sample.column("rep").to_numpy(), kind="stable")
    books = Codebooks.fit(directions(matrix(sample.column("v"))[order]))

    kind = first.schema["v"].dataType.simpleString()
    codes = scratch.keep(first.mapInArrow(encode(books), f"rep long, v {kind}, code binary, scale double"), "codes")
    asked = scratch.keep(rows.where(F.pmod("id", F.lit(every)) == 0).withColumn("query", F.monotonically_increasing_id()), "asked")

    # groups of bounded size; where few rows are enough for all, as many as there are tasks
    n, wide = codes.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-n // group), min(wide, n // LEAST_GROUP))
    places = F.array(*(F.lit(p).cast("long") for p in labels(spark, parts)))
    held = codes.select(F.get(places, F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int")).alias("part"), F.lit(False).alias("asked"), "rep", "v", "code", "scale")
    queries = asked.select(F.explode(places).alias("part"), F.lit(True).alias("asked"), F.col("query").alias("rep"), "v", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("scale"))
    near = against(held.unionByName(queries), "part", lambda t: nearest_in_group(t, books, k + 1, exact), "query long, rep long, score double", parts)
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "rep"))
    ranked = near.withColumn("r", best).where(F.col("r") <= k + 1).join(asked.select("query", F.col("id").alias("query_id")), "query")
    whole = ranked.join(members.select("rep", F.col("id").alias("vec_id")), "rep").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return whole.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))

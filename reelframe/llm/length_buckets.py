"""Packing: optimal length buckets.

The lengths of all documents form one global histogram, a row for each length that
occurs.  D different lengths have D * D / 2 tokens at least, so T tokens make at most
the root of 2 T rows: a thousand million tokens 45,000, 100 TB of text some millions.
Dynamic programming over them chooses the ``BUCKETS`` longest lengths that make the
padding least when each document is padded to the boundary of its bucket.  The cost of
a bucket is of Monge kind, so the best cuts rise with the length and each step
divides and conquers: buckets x D log D operations.  Inside a bucket documents are put
in an order of their own (by a digest of id and length, so that sources mix) and
cut into batches that hold ``TOKENS`` tokens at most, padding included.  A document
longer than that is a batch by itself; none is cut or left out.

Documents are numbered inside a bucket in two steps (counts of digest ranges, then
places inside a range), and rows with one id and one length, which the result cannot
tell apart, are counted first and dealt out again last: neither a bucket with most
of the rows nor an id that most rows have is numbered by one task.

Nulls and odd input: a null or empty text has 0 tokens; rows with a null id are packed
like others; repeated rows stand side by side; an empty table gives no rows; fewer
different lengths than buckets make a bucket each; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelframe.llm.common import Scratch, read

BUCKETS, TOKENS = 12, 16_384
RUN = 10_000  # equal rows that one row of the deal stands for at most
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def boundaries(length: np.ndarray, count: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The bucket boundaries with least padding, of rising lengths and how many documents have each.

    Ties go to the shorter boundary.
    """
    n, total = (np.concatenate([[0], np.cumsum(x.astype(np.int64))]) for x in (count, count * length))
    size, most = len(length), min(buckets, len(length))
    best = np.full(size + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    back = []
    for b in range(1, most + 1):
        now, cut = np.full(size + 1, np.iinfo(np.int64).max // 4), np.zeros(size + 1, np.int64)
        # ranges of ends (low, high) whose best starts lie in (first, last); halved level by level
        low, high, first, last = (np.array([x]) for x in (b, size, b - 1, size - 1))
        while len(low):
            mid = (low + high) // 2
            stop = np.minimum(last, mid - 1)
            many = stop - first + 1
            at = np.cumsum(many) - many
            start = np.repeat(first - at, many) + np.arange(many.sum())
            end = np.repeat(mid, many)
            # lengths start .. end - 1 padded to the longest of them
            cost = best[start] + (n[end] - n[start]) * length[end - 1] - (total[end] - total[start])
            least = np.minimum.reduceat(cost, at)
            hit = np.flatnonzero(cost == np.repeat(least, many))
            own = start[hit[np.searchsorted(hit, at)]]
            now[mid], cut[mid] = least, own
            low, high, first, last = (np.concatenate(x) for x in ((low, mid + 1), (mid - 1, high), (first, own), (own, last)))
            keep = low <= high
            low, high, first, last = low[keep], high[keep], first[keep], last[keep]
        best = now
        back.append(cut)
    out, j = [], size
    for cut in reversed(back):
        out.append(int(length[j - 1]))
        j = int(cut[j])
    return out[::-1]


def pack(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, buckets: int = BUCKETS, tokens: int = TOKENS) -> DataFrame:
    """One row per document: id, n_tokens, bucket, bucket_len, batch, padding.

    length: the number of tokens as a column of ``documents``; words of the text if
    not given.  batch counts from 0 in each bucket.
    """
    scratch = Scratch(documents.sparkSession, "length-buckets")
    n = length if length is not None else word_count(F.col(text_col))
    lengths = documents.select(F.col(id_col).alias("id"), n.cast("long").alias("n_tokens"))
    rows = scratch.keep(lengths.groupBy("id", "n_tokens").agg(F.count("*").alias("m")), "lengths")
    cells = rows.groupBy("n_tokens").agg(F.sum("m").alias("m")).orderBy("n_tokens").toArrow()  # at most the root of twice the tokens
    ends = boundaries(*(cells.column(c).to_numpy() for c in ("n_tokens", "m")), buckets) if cells.num_rows else [0]

    bounds = F.array(*(F.lit(e).cast("long") for e in ends))
    digest = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("/"), F.col("n_tokens").cast("string")).cast("binary"))
    rows = rows.withColumn("bucket", F.size(F.filter(bounds, lambda b: b < F.col("n_tokens")))).withColumn("bucket_len", F.get(bounds, F.col("bucket"))).withColumn("part", F.substring(digest, 1, 3))
    counts = rows.groupBy("bucket", "part").agg(F.sum("m").alias("all"))
    before = counts.select("bucket", "part", (F.sum("all").over(W.partitionBy("bucket").orderBy("part")) - F.col("all")).alias("before"))
    place = F.sum("m").over(W.partitionBy("bucket", "part").orderBy("id", "n_tokens")) - F.col("m")
    numbered = scratch.keep(rows.withColumn("place", place).join(F.broadcast(before), ["bucket", "part"]), "numbered")  # 4096 rows a bucket at most
    # equal rows become rows again, many of them in several tasks
    runs = numbered.where(F.col("m") > RUN).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(RUN).cast("long")))).repartition("id", "n_tokens", "from")
    single = numbered.where(F.col("m") <= RUN).withColumn("from", F.lit(0).cast("long"))
    dealt = single.unionByName(runs).withColumn("own", F.explode(F.sequence("from", F.least(F.col("m"), F.col("from") + RUN) - 1)))
    size = F.greatest(F.lit(1), F.floor(F.lit(tokens) / F.greatest(F.lit(1), "bucket_len"))).cast("long")
    batch = F.floor((F.col("place") + F.col("before") + F.col("own")) / size).cast("long")
    return dealt.select(F.col("id").alias(id_col), "n_tokens", "bucket", "bucket_len", batch.alias("batch"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same dynamic programming in SQL, all cuts of all lengths, one common table for each bucket."""
    steps = ["p0 AS (SELECT 0::BIGINT AS j, 0::BIGINT AS cost, 0::BIGINT AS back)"]
    for b in range(1, BUCKETS + 1):
        steps.append(
            f"""p{b} AS (
  SELECT c.j, min({{'cost': p.cost + (c.n - q.n) * c.m - (c.t - q.t), 'back': p.j}}) AS x FROM c JOIN (SELECT * FROM c UNION ALL SELECT 0, 0, 0, 0) q ON q.j < c.j JOIN (SELECT j, {'cost' if b == 1 else 'x.cost AS cost'} FROM p{b - 1}) p ON p.j = q.j
  GROUP BY c.j)"""
        )
    walk = [f"w{BUCKETS} AS (SELECT max(j) AS j FROM c)"]
    for b in range(BUCKETS, 0, -1):
        walk.append(f"w{b - 1} AS (SELECT p.x.back AS j FROM p{b} p JOIN w{b} w ON p.j = w.j)")
    ends = " UNION ALL ".join(f"SELECT c.m FROM c JOIN w{b} w ON c.j = w.j" for b in range(1, BUCKETS + 1))
    return f"""
WITH l AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
h AS (SELECT n_tokens AS m, count(*) AS n, sum(n_tokens) AS t FROM l GROUP BY 1),
c AS (SELECT row_number() OVER (ORDER BY m) AS j, (sum(n) OVER (ORDER BY m))::BIGINT AS n, (sum(t) OVER (ORDER BY m))::BIGINT AS t, m FROM h),
{", ".join(steps)},
{", ".join(walk)},
ends AS ({ends}),
b AS (SELECT l.doc_id, l.n_tokens, substr(md5(coalesce(l.doc_id::VARCHAR, '') || '/' || l.n_tokens), 1, 3) AS part, (SELECT count(*) FROM ends WHERE m < l.n_tokens)::INTEGER AS bucket, (SELECT min(m) FROM ends WHERE m >= l.n_tokens) AS bucket_len FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY part, doc_id NULLS FIRST, n_tokens) - 1 AS place FROM b)
SELECT doc_id, n_tokens, bucket, bucket_len, (place // greatest(1, {TOKENS} // greatest(1, bucket_len)))::BIGINT AS batch, bucket_len - n_tokens AS padding
FROM o
"""


SQL = _sql()

"""What the operators share: reading tables, scratch tables, splits by crc32."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of a column as text, modulo ``modulus``; null where the column is."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a session on one machine may go without that setting; it then gets a
    temporary folder.  A cluster without it is an error, since executors would
    not see each other's files.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        global _own
        if _own is None:
            _own = tempfile.mkdtemp(prefix="reelframe-")
        return _own
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


_own: str | None = None


class Scratch:
    """Tables that cut a plan's lineage, in the shared folder.

    ``keep`` writes a DataFrame as Parquet and reads it back, so a lost executor
    costs only the stages after it.  ``drop`` removes a table that later steps
    no longer read; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
        to = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self, *names: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            if jvm is None:
                return
            for path in [f"{self.root}/{n}" for n in names] or [self.root]:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            if names:
                raise  # at the end of the driver the session may be gone already


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, Python workers get so many rows at a time: rows here may be long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def labels(spark: SparkSession, n: int) -> list[int]:
    """``n`` longs that a hash partitioning into ``n`` deals to a partition each."""
    at = spark.range(64 + 24 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()  # n rows
    found = sorted(r["id"] for r in at)
    return found if len(found) == n else list(range(n))


def against(rows: DataFrame, key: str, work: Callable[[pa.Table], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str, parts: int | None = None, most: int = 256) -> DataFrame:
    """In each value of ``key`` (a long), the rows that are asked meet those that are held.

    rows: has a boolean column ``asked``.  The held rows of a key come first and are
    kept; ``work`` makes of them the function that answers the asked rows, which
    stream by, ``most`` at a time.  Only the held rows of one key need fit in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, answer = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys, asked = b.column(key).to_numpy(zero_copy_only=False), b.column("asked").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (asked[1:] != asked[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if keys[lo] != now:
                    now, held, answer = keys[lo], [], None
                part = b.slice(lo, hi - lo)
                if not asked[lo]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if answer is None:
                    answer = work(pa.Table.from_batches(held))
                    held = [True]
                for at in range(0, part.num_rows, most):
                    yield from answer(part.slice(at, most))

    dealt = rows.repartition(parts, key) if parts else rows.repartition(key)
    return dealt.sortWithinPartitions(key, "asked").mapInArrow(run, schema)

"""Tables that cut a plan's lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


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


class Scratch:
    """``keep`` writes a DataFrame as Parquet and reads it back, so a lost executor costs
    only the stages after it.  ``drop`` removes a table that later steps no longer
    read; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
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

"""The training-data pipeline: a table of documents through five stages.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, and
returns a DataFrame; it is written as Parquet and read again for the next one.  All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm import language_id, length_buckets, near_dups, soft_mixing, toxicity
from reelframe.llm.common import Scratch, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go; a low score is no reason, as clean texts in several languages have one."""
    model = language_id.train(read(spark, sf_dir, "documents"))
    found = language_id.identify(docs, model, keep=COLUMNS)
    return found.where(F.col("lang_pred") != language_id.UND).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    model = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles) the smallest id stays.

    Rows of one id and one text are one document; so are those without an id that have
    one text.  Different texts under one id are documents of their own: they are then
    numbered in the order of their ids, and judged by their numbers.
    """
    own = F.coalesce(F.md5("text"), F.lit("")).alias("own")
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", own)
    if texts.groupBy("doc_id").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a < b").isEmpty():
        rows = docs.withColumn("n", F.col("doc_id"))
    else:
        scratch = Scratch(spark, "texts")
        ordered = texts.distinct().repartitionByRange("doc_id", "own").sortWithinPartitions("doc_id", "own")
        numbers = scratch.keep(ordered.withColumn("n", F.monotonically_increasing_id()), "numbers")
        rows = scratch.keep(docs.withColumn("own", own).join(numbers, ["doc_id", "own"], "left").select(*COLUMNS, "n"), "numbered")
    gone = near_dups.near_duplicates(rows, id_col="n", shingle=5).where("not kept").select("n").distinct()
    left = rows.join(gone, "n", "left_anti").withColumn("own", F.when(F.col("n").isNull(), F.col("text")))
    return left.dropDuplicates(["n", "own"]).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its rate says."""
    mixed = soft_mixing.mix(docs, read(spark, sf_dir, "labels"), keep=COLUMNS)
    return mixed.where("copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of what is left."""
    return length_buckets.pack(docs)


STAGES = [("language id", languages), ("toxicity", toxic), ("near duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Recurrent networks, FTRL and sketches are not to be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs

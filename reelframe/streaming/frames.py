"""Frames as a stream: the validator as keyed state, a volume log that ends.

A source of spool volumes is watched for new files; frames of an archive keep their
validator between micro-batches, so replays are held against records accepted in
earlier ones and a conflict is reported, not dropped.  The query's checkpoint makes
this state outlive the process.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelframe.operators.validate import NEEDS, Validator
from reelframe.sources.frames import check_frames, parse_headers

OUTPUT = "archive_uuid string, ord bigint, global_frame_seq_num decimal(20,0), slice_seq_num decimal(20,0), status string, message string"


def fold_stream(frames: DataFrame, mode: str = "restore", seeded: bool = True) -> DataFrame:
    """Judged frames of a stream with headers, integrity columns and ord, by archive.

    Frames of one micro-batch are judged in the order of ord, batches as they come.
    A column ``connection``, if there, starts a new replay where it changes.
    """
    columns = ["archive_uuid", "ord", *(["connection"] if "connection" in frames.columns else []), *(n for n in NEEDS if n != "archive_uuid")]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        v, last = pickle.loads(state.get[0]) if state.exists else (Validator(mode, seeded), None)
        rows = pd.concat(list(parts)).sort_values("ord", kind="stable")
        out = []
        for row in rows.to_dict("records"):
            if "connection" in row and row["connection"] != last:
                v.connect()
                last = row["connection"]
            row["norm_hash"] = bytes(row["norm_hash"]) if row["norm_hash"] is not None else None
            out.append((key[0], row["ord"], row["global_frame_seq_num"], row["slice_seq_num"], *v.judge(row)))
        state.update((pickle.dumps((v, last)),))
        yield pd.DataFrame(out, columns=["archive_uuid", "ord", "global_frame_seq_num", "slice_seq_num", "status", "message"])

    own = frames.select(*columns).where("archive_uuid IS NOT NULL")
    return own.groupBy("archive_uuid").applyInPandasWithState(step, OUTPUT, "state binary", "append", GroupStateTimeout.NoTimeout)


def frame_stream(records: DataFrame) -> DataFrame:
    """Records of a stream (ord, record, ...) with headers and integrity, without their bytes."""
    return check_frames(parse_headers(records)).drop("record")


def table_stream(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream, so many a trigger at most."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def run_to_end(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Appends what there is to a Parquet folder and stops; a later run goes on from there."""
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def high_water(judged: DataFrame) -> DataFrame:
    """The next number each archive waits for, from what was accepted."""
    return judged.where(F.col("status").isin("ok", "warning")).groupBy("archive_uuid").agg((F.max("global_frame_seq_num") + 1).alias("next_seq"))


def resume_log(judged: DataFrame) -> DataFrame:
    """First accepted number of each slice: what a producer would write to resume."""
    return judged.where(F.col("status") == "ok").groupBy("archive_uuid", F.col("slice_seq_num").alias("slice")).agg(F.min("global_frame_seq_num").alias("global_seq"))

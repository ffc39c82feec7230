"""Reports over frames, entries and logs: inspect, scan, catalog, restore, resume, audit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.operators.folds import ordered_fold
from reelframe.operators.lookups import signatures
from reelframe.operators.packing import running
from reelframe.operators.validate import validate_frames
from reelframe.sources.frames import ARCHIVE_END, CONTENT, METADATA, check_frames, has_magic, parse_headers, payload

MEDIA = ["file_num", "rec_idx"]


def after_prefix(records: DataFrame, magic: Column, order: list[str], keys: list[str]) -> DataFrame:
    """Leaves out the foreign records before a medium's first frame."""
    seen = F.max(magic).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return records.withColumn("__seen", seen).where("__seen").drop("__seen")


def frame_report(records: DataFrame, keys: list[str] | None = None, order: list[str] | None = None, mode: str = "inspect", verify: DataFrame | None = None, required: bool = False, domain: bytes = b"", per_archive: bool = False) -> DataFrame:
    """Records of media to one judged row per frame, without the record's bytes.

    keys: the columns of a medium.  Foreign records before the first frame are left out.
    Records are parsed and hashed where they are read; what is put in order and judged
    are their header rows.
    per_archive: each archive of a medium is judged by itself; else a second one breaks
    the rules of the first.
    """
    keys, order = keys or [], order or MEDIA
    marked = records.withColumn("medium", F.lit(0)) if not keys else records
    keys = keys or ["medium"]
    checked = check_frames(parse_headers(marked.withColumn("magic", has_magic(F.col("record"))))).drop("record")
    if per_archive:
        checked = after_prefix(checked, F.col("magic"), order, keys)
    judged = validate_frames(checked, [*keys, "archive_uuid"] if per_archive else keys, order, mode).where("status <> 'prefix'")
    return signatures(judged.drop("magic"), verify, required, domain)


def inspect_summary(report: DataFrame) -> DataFrame:
    """Counts of a frame report in one row, with compliance and completeness."""
    count = lambda c: F.count_if(c).alias
    c = F.col
    bad = (c("status") == "error") | (c("signature_status") == "invalid")
    return report.agg(
        F.count("*").alias("total_frames"),
        count(c("channel_type") == CONTENT)("content_frames"),
        count(c("channel_type") == METADATA)("metadata_frames"),
        count(c("channel_type") == ARCHIVE_END)("archive_end_frames"),
        F.countDistinct("file_num").alias("tape_files"),
        count(c("is_signed"))("signed_frames"),
        count(~c("is_signed"))("unsigned_frames"),
        count(c("signature_status") == "signed_unverified")("signed_unverified"),
        count(c("signature_status") == "verified")("signatures_verified"),
        count(c("signature_status") == "invalid")("signature_errors"),
        count(c("status") == "replay")("replays"),
        (F.count_if(c("status") == "error") + F.count_if(c("signature_status") == "invalid")).alias("errors"),
        F.coalesce(F.sum("frame_payload_size"), F.lit(0)).alias("payload_bytes"),
        (F.count_if(bad) == 0).alias("compliant"),
        ((F.count_if(bad) == 0) & (F.min("global_frame_seq_num") == 0) & (F.count_if((c("channel_type") == ARCHIVE_END) & (c("status") == "ok")) > 0)).alias("complete"),
    )


def issues(report: DataFrame) -> DataFrame:
    return report.where((F.col("status") == "error") | (F.col("signature_status") == "invalid")).select(*MEDIA, "global_frame_seq_num", F.coalesce("message", F.lit("invalid signature")).alias("issue"))


def first_frames(frames: DataFrame, file: str = "file_num", idx: str = "rec_idx") -> DataFrame:
    """The first record of each tape file."""
    rest = [c for c in frames.columns if c != file]
    return frames.groupBy(file).agg(F.min_by(F.struct(*rest), idx).alias("f")).select(file, "f.*")


def scan_archives(first: DataFrame) -> DataFrame:
    """Marks the file in which an archive, by uuid and label, is first seen."""
    own = W.partitionBy("archive_uuid", "archive_label").orderBy("file_num")
    return first.withColumn("new_archive", F.row_number().over(own) == 1)


def scan_counts(first: DataFrame) -> DataFrame:
    return first.agg(F.count("*").alias("tape_files"), F.countDistinct("archive_uuid", "archive_label").alias("archives"))


def resume_points(first: DataFrame) -> DataFrame:
    """Files that open a slice after the first, and the archive end."""
    opens = (F.col("channel_type") != ARCHIVE_END) & (F.col("slice_seq_num") > 0) & (F.col("channel_frame_seq_num") == 0)
    kind = F.when(F.col("channel_type") == ARCHIVE_END, "archive_end").when(opens, "slice")
    return first.select("file_num", kind.alias("kind"), F.col("slice_seq_num").alias("slice"), F.col("global_frame_seq_num").alias("global_seq"), F.col("volume_seq_num").alias("volume")).where("kind IS NOT NULL")


def superseded(points: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Resume points that stay: a record for a slice drops those for it and later ones."""
    after = W.partitionBy(*keys).orderBy(order).rowsBetween(1, W.unboundedFollowing)
    least = F.min("slice").over(after)
    return points.withColumn("__least", least).where(F.col("__least").isNull() | (F.col("__least") > F.col("slice"))).drop("__least")


def point_errors(points: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """Points that stay but do not follow: a slice skipped, a number not rising, a volume falling."""
    own = W.partitionBy(*keys).orderBy(order)
    bad = (F.col("slice") > F.lag("slice").over(own) + 1) | (F.col("global_seq") <= F.lag("global_seq").over(own)) | (F.col("volume") < F.lag("volume").over(own))
    return points.withColumn("bad", F.coalesce(bad, F.lit(False))).where("bad").drop("bad")


def catalog_frames(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Metadata frames of slice 0 up to the one that ends the channel."""
    own = frames.where((F.col("channel_type") == METADATA) & (F.col("slice_seq_num") == 0))
    ended = F.coalesce(F.max(F.col("is_end")).over(W.partitionBy(*keys).orderBy("global_frame_seq_num").rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    return own.withColumn("__ended", ended).where("NOT __ended").drop("__ended")


def catalog_summary(entries: DataFrame) -> DataFrame:
    """Entries and bytes of each slice, and of the whole (slice null)."""
    return entries.where("error IS NULL AND chdir IS NULL").rollup("slice").agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def stream_digests(frames: DataFrame, keys: list[str], order: str, data: str) -> DataFrame:
    """SHA-256, in hex, of each key's payloads in order, of streams of any length.

    A fold holds one batch and the hash; the rows it returns are narrow.  Null payloads
    add nothing; a stream of nulls only has a null digest.
    """

    def step(state: list, row: dict) -> tuple:
        state[0] += 1
        if row[data] is not None:
            state[1] = state[1] or hashlib.sha256()
            state[1].update(row[data])
        return state[0], state[1] and state[1].hexdigest()

    adds = T.StructType([T.StructField("__n", T.LongType()), T.StructField("digest", T.StringType())])
    rows = ordered_fold(frames.select(*keys, order, data), keys, [order, data], lambda _: [0, None], step, adds, [data], keep=keys)
    return rows.groupBy(*keys).agg(F.max_by("digest", "__n").alias("digest"))


def restorable(records: DataFrame, report: DataFrame, metadata: bool = False) -> DataFrame:
    """(global_frame_seq_num, slice_seq_num, payload) of the frames that a report accepts."""
    good = report.where(F.col("status").isin("ok", *(["warning"] if not metadata else [])) & (F.col("channel_type") == (METADATA if metadata else CONTENT)))
    good = good.where(F.col("hash_ok")) if metadata else good
    own = good.select(*MEDIA, "global_frame_seq_num", "slice_seq_num", "frame_payload_size")
    return records.join(own, MEDIA).select("global_frame_seq_num", "slice_seq_num", payload(F.col("record"), F.col("frame_payload_size")).alias("payload"))


def restore_stream(payloads: DataFrame) -> Iterator[tuple[int, bytes]]:
    """(slice, bytes) in order, one partition at a time on the driver."""
    for row in payloads.orderBy("global_frame_seq_num").toLocalIterator():
        yield int(row["slice_seq_num"]), bytes(row["payload"])


def restore_to(payloads: DataFrame, path: str) -> int:
    """Writes the stream to a file, flushed at each slice; the bytes written."""
    written, now = 0, None
    with open(path, "wb") as out:
        for slice_, data in restore_stream(payloads):
            if now is not None and slice_ != now:
                out.flush()
            now, written = slice_, written + out.write(data)
    return written


def differences(manifest: DataFrame, restored: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Paths that are missing, extra or differ between two manifests."""
    a = manifest.select(key, F.struct(*values).alias("a"), F.lit(1).alias("in_a"))
    b = restored.select(key, F.struct(*values).alias("b"), F.lit(1).alias("in_b"))
    state = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "differs")
    return a.join(b, key, "full_outer").withColumn("difference", state).where("difference IS NOT NULL").select(key, "difference")


def unequal_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with their multiplicity, that only one side has."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def volume_ledger(ledger: DataFrame) -> DataFrame:
    """Records, first and last number, bytes of each volume of a record ledger."""
    return ledger.groupBy("volume").agg(F.count("*").alias("records"), F.min("global").alias("first_global"), F.max("global").alias("last_global"), F.sum("bytes").cast("long").alias("bytes"))


def retried(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("global").agg(F.count("*").alias("written")).where("written > 1")


def connection_summary(log: DataFrame, conn: str = "connection", acks: str = "acked") -> DataFrame:
    """Volumes used by connections: a volume's number rises only after one with acknowledged frames."""
    return log.agg(F.sum(acks).alias("committed_frames"), F.count("*").alias("connections"), F.count_if(F.col(acks) > 0).alias("volumes"), F.count_if(F.col(acks) == 0).alias("empty_connections"))


def volume_ordinals(log: DataFrame, order: str = "connection", acks: str = "acked") -> DataFrame:
    """Adds volume: how many earlier connections had acknowledged frames (a log has a row per connection).

    ``order`` is a long; the count runs over ranges of it, not in one task.
    """
    return running(log, [F.col(order)], (F.col(acks) > 0).cast("int"), "volume")

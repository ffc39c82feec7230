"""The tools' jobs as functions over spool directories and DataFrames.

Each takes and returns DataFrames, or writes a spool directory, a plan or a file.
"""

from __future__ import annotations

import os
import shutil
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.functions.blake3 import Blake3
from reelframe.operators import build, lookups, packing, pax, reports
from reelframe.operators.scratch import Scratch
from reelframe.sources import frames as fr
from reelframe.sources import records, spool, walk

SLICE_SIZE = 64 << 30


class UsageError(ValueError):
    """Options that cannot go together."""


@dataclass
class Archive:
    """What stays the same over an archive's volumes; capacity: bytes of a volume."""

    uuid: str
    label: bytes = b""
    block: int = 1 << 20
    capacity: int = 1 << 40
    seed: bytes | None = None
    key_id: bytes = bytes(8)
    domain: bytes = b""

    def __post_init__(self):
        if self.block % 1024 or not fr.LEAST_BLOCK <= self.block <= fr.MOST_BLOCK:
            raise UsageError("the block size is a multiple of 1024 from 4 KiB to 8 MiB")


def plan_tree(spark: SparkSession, sources: list[str], users: DataFrame | None = None, groups: DataFrame | None = None, slice_size: int = SLICE_SIZE, one_device: bool = False) -> DataFrame:
    """Entries of directory trees in slices; users and groups: (id, name), unknown ids have no name."""
    entries = walk.scan_tree(spark, sources, one_device).where("error IS NULL")
    for table, number, name in ((users, "uid", "uname"), (groups, "gid", "gname")):
        entries = lookups.named(entries, table, number, name, "id", "name") if table is not None else entries.withColumn(name, F.lit(""))
    return packing.pack_slices(entries, slice_size, order=["ord"])


def write_plan(plan: DataFrame, path: str) -> int:
    """A plan file, in order; the number of entries."""
    n = 0
    with open(path, "wb") as out:
        for row in records.encode_plan(plan).orderBy("ord").select("record").toLocalIterator():
            out.write(row["record"])
            n += 1
    return n


def archive_streams(streams: DataFrame, archive: Archive, catalog: bytes | None = None) -> DataFrame:
    """Records of an archive from slices' streams (slice_seq_num, data), an optional catalog in front.

    Slices are numbered from 0.  The catalog is the metadata channel of slice 0.
    """
    spark = streams.sparkSession
    cut = packing.cut_frames(streams.select(F.col("slice_seq_num").cast("long"), F.col("data").cast("binary")), archive.block).withColumn("channel_type", F.lit(fr.CONTENT))
    if catalog:
        front = spark.createDataFrame([(0, bytearray(catalog))], "slice_seq_num long, data binary")
        cut = cut.unionByName(packing.cut_frames(front, archive.block).withColumn("channel_type", F.lit(fr.METADATA)))
    lead = F.col("slice_seq_num") * 2 + (F.col("channel_type") == fr.CONTENT).cast("long")
    numbered = packing.number_frames(cut.withColumn("lead", lead), ["lead", "channel_frame_seq_num"])
    placed = numbered.withColumn("volume_seq_num", packing.volume_of(F.col("global_frame_seq_num"), archive.block, archive.capacity))
    closed = build.with_archive_end(placed)
    return build.build_records(closed, archive.block, archive.uuid, archive.label, archive.seed, archive.key_id, archive.domain)


def archive_files(written: DataFrame, archive: Archive, catalog: str | None = None) -> DataFrame:
    """Records of an archive from slices in files, as ``pax.write_slices`` tells of them; an optional plan file in front.

    What ``archive_streams`` makes of the files' bytes, for slices of any length.
    """
    files = written.select(F.col("slice").cast("long").alias("slice_seq_num"), F.lit(fr.CONTENT).alias("channel_type"), "name", F.col("output_bytes").cast("long").alias("size"))
    if catalog:
        front = written.sparkSession.createDataFrame([(0, fr.METADATA, catalog, os.path.getsize(catalog))], "slice_seq_num long, channel_type int, name string, size long")
        files = files.unionByName(front)
    lead = F.col("slice_seq_num") * 2 + (F.col("channel_type") == fr.CONTENT).cast("long")
    frames, ends = packing.number_files(files.withColumn("lead", lead), archive.block, ["lead"])
    volume = lambda c: packing.volume_of(F.col(c), archive.block, archive.capacity)
    heads = ends.select(F.col("last").alias("global_frame_seq_num"), volume("last").alias("volume_seq_num"))
    closed = build.with_archive_end(frames.withColumn("volume_seq_num", volume("global_frame_seq_num")), heads)
    return build.build_records(closed, archive.block, archive.uuid, archive.label, archive.seed, archive.key_id, archive.domain)


def store(record: DataFrame, path: str, volume: int) -> None:
    """One volume's records as a spool directory of one tape file."""
    own = record.where(F.col("volume_seq_num") == volume).select(F.lit(1).alias("file_num"), F.col("global_frame_seq_num").alias("rec_idx"), "record")
    spool.write_spool(own, path)


def write_volumes(record: DataFrame, paths: list[str], overwrite: bool = False, per_file: int | None = None, bundle: str | None = None) -> int:
    """An archive's volumes, in order, as spool directories, written in one go; how many volumes are still without one.

    A directory with spool files is left alone unless ``overwrite``.  per_file: records of a
    tape file, so that a volume is written by several tasks; all in one if not given.
    bundle: a file that is put beside each volume, for recovery.
    """
    for p in paths:
        if os.path.isdir(p) and spool.spool_files(p) and not overwrite:
            raise UsageError(f"{p} holds a volume already")
    if bundle:
        for p in paths:
            install_bundle(bundle, p)
    targets = F.array(*(F.lit(p) for p in paths))
    heads = record.select("global_frame_seq_num", "volume_seq_num")
    starts = heads.groupBy("volume_seq_num").agg(F.min("global_frame_seq_num").alias("first")) if per_file else None
    own = record.where(F.col("volume_seq_num") < len(paths))
    file_num = F.lit(1).cast("long")
    if per_file:
        own = own.join(lookups.bounded(starts), "volume_seq_num")
        file_num = F.floor((F.col("global_frame_seq_num") - F.col("first")) / per_file) + 1
    rows = own.select(file_num.alias("file_num"), F.get(targets, F.col("volume_seq_num").cast("int")).alias("file_name"), F.col("global_frame_seq_num").alias("rec_idx"), "record")
    spool.write_spool(rows, paths[0], "overwrite" if overwrite else "append")
    return max(0, (heads.agg(F.max("volume_seq_num")).first()[0] or 0) + 1 - len(paths))


def install_bundle(source: str, root: str, record: int | None = None) -> int:
    """Puts a recovery bundle into a spool directory; the bytes it takes, in whole records if on tape."""
    os.makedirs(root, exist_ok=True)
    pending = os.path.join(root, "RECOVERY.TMP")
    shutil.copyfile(source, pending)
    os.rename(pending, os.path.join(root, "RECOVERY.TAR"))
    size = os.path.getsize(source)
    return size if record is None else -(-size // record) * record


def forwarded(records: DataFrame, order: list[str] | None = None) -> tuple[DataFrame, dict]:
    """What a reader sends of one volume: frames whose header parses; and how many it sent, skipped and met.

    Foreign records before the first frame are skipped; the first frame must parse, later
    ones that do not are left out, and who receives them decides about the gap.
    """
    order = order or reports.MEDIA
    parsed = fr.parse_headers(records.withColumn("magic", fr.has_magic(F.col("record"))))
    heads = parsed.select(*order, "magic", "header_error")
    first = heads.where("magic").agg(F.min(F.struct(*order, "header_error")).alias("f")).first()["f"]
    if first is None:
        return parsed.where(F.lit(False)), {"forwarded_frames": 0, "skipped_prefix": heads.count(), "unavailable": 0, "filemarks": 0}
    if first["header_error"]:
        raise ValueError(f"the first frame does not parse: {first['header_error']}")
    after = F.struct(*order) >= F.struct(*(F.lit(first[c]).cast(parsed.schema[c].dataType).alias(c) for c in order))
    counts = heads.agg(F.count_if(after & F.col("header_error").isNull()).alias("forwarded_frames"), F.count_if(~after).alias("skipped_prefix"), F.count_if(after & F.col("header_error").isNotNull()).alias("unavailable"), F.countDistinct(order[0]).alias("filemarks")).first()
    return parsed.where(after & F.col("header_error").isNull()), counts.asDict()


def mt_pax(entries: DataFrame, prefix: str, first_slice: int = 0) -> tuple[dict, str]:
    """Planned entries as a pax file for each slice from ``first_slice`` on; totals and the BLAKE3 of all.

    entries: what ``plan_tree`` gives, with source_path.  Links are resolved over all
    slices first, so an entry may be a link to one that was written earlier.
    """
    chosen = lookups.resolve_links(entries, first_slice)
    scratch = Scratch(entries.sparkSession, "pax")
    return pax.stream_hash(scratch.keep(pax.write_slices(chosen, prefix), "written"))


def resumed(record: DataFrame, global_seq: int, volume: int) -> DataFrame:
    """An archive's records from a resume point on, put on volumes from ``volume`` on."""
    own = record.where(F.col("global_frame_seq_num") >= global_seq)
    start = own.agg(F.min("volume_seq_num")).first()[0] or 0
    return own.withColumn("volume_seq_num", F.col("volume_seq_num") - start + volume)


def raw_store(spark: SparkSession, data: bytes, archive: Archive, path: str) -> int:
    """Uninterpreted bytes as one slice on one volume; the records written."""
    streams = spark.createDataFrame([(0, bytearray(data))], "slice_seq_num long, data binary")
    made = archive_streams(streams, archive)
    store(made, path, 0)
    return spool.read_spool(spark, path).count()


def volumes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of several spool directories, in the order given."""
    parts = [spool.read_spool(spark, p).withColumn("source_ord", F.lit(i)) for i, p in enumerate(paths)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # files are numbered on over the volumes
    return out.withColumn("file_num", F.col("source_ord") * 1_000_000 + F.col("file_num"))


def inspect(spark: SparkSession, paths: list[str], keys: DataFrame | None = None, required: bool = False, domain: bytes = b"") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, summary, issues) of volumes read one after the other."""
    report = reports.frame_report(volumes(spark, paths), mode="inspect", verify=keys, required=required, domain=domain)
    return report, reports.inspect_summary(report), reports.issues(report)


def scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(first frames with new_archive, resume points), from headers only."""
    heads = spool.read_spool(spark, path, "first_record")
    first = reports.first_frames(fr.parse_headers(heads).where("header_error IS NULL").drop("record"))
    return reports.scan_archives(first), reports.resume_points(first)


def resume_file(spark: SparkSession, path: str, opening: str) -> bytes:
    """A resume file from a scan, which must find one archive; opening: its first record."""
    first, points = scan(spark, path)
    rows = first.orderBy("file_num").collect()  # a row per tape file
    if len({(r["archive_uuid"], bytes(r["archive_label"])) for r in rows}) != 1:
        raise UsageError("a resume file needs exactly one archive")
    head = rows[0]
    found = points.orderBy("file_num").collect()
    ends = [int(p["global_seq"]) for p in found if p["kind"] == "archive_end"]
    header = {"archive_uuid": head["archive_uuid"], "block_size_kib": head["volume_block_size_kib"], "sign_key_id": bytes(head["signature"][:8]).hex() if head["is_signed"] else "", "plan_blake3": "", "archive_name": bytes(head["archive_label"])}
    return records.encode_resume(opening, header, [(int(p["slice"]), int(p["global_seq"]), int(p["volume"])) for p in found if p["kind"] == "slice"], ends[-1] if ends else None)


def catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The plan that an archive carries, as entries; the catalog's bytes, of any length, are those of one plan file."""
    media = volumes(spark, paths)
    report = reports.frame_report(media, mode="restore")
    own = reports.catalog_frames(report.where("status IN ('ok')").withColumn("one", F.lit(1)), ["one"])
    raw = media.join(own.select("file_num", "rec_idx", "frame_payload_size", "global_frame_seq_num"), ["file_num", "rec_idx"])
    parts = raw.select("global_frame_seq_num", fr.payload(F.col("record"), F.col("frame_payload_size")).alias("bytes"))
    return records.parse_plan(Scratch(spark, "catalog").keep(records.split_stream(parts, "global_frame_seq_num", "bytes", "catalog"), "records"))


def catalog_to(spark: SparkSession, paths: list[str], to: str) -> int:
    """The bytes of the catalog that an archive carries, written to a file as they stream by; their number."""
    media = volumes(spark, paths)
    report = reports.frame_report(media, mode="restore")
    own = reports.catalog_frames(report.where("status = 'ok'").withColumn("one", F.lit(1)), ["one"])
    parts = media.join(own.select("file_num", "rec_idx", "frame_payload_size", "global_frame_seq_num", "slice_seq_num"), ["file_num", "rec_idx"])
    return reports.restore_to(parts.select("global_frame_seq_num", "slice_seq_num", fr.payload(F.col("record"), F.col("frame_payload_size")).alias("payload")), to)


def processed_frames(report: DataFrame) -> int:
    """Frames that an extraction took: replays, errors and what it did not read left out."""
    return report.where(F.col("status").isin("ok", "warning")).count()


def extract(spark: SparkSession, paths: list[str], to: str, salvage: bool = False) -> DataFrame:
    """Restores (or salvages) the content of volumes into a file; the frame report."""
    media = volumes(spark, paths)
    report = Scratch(spark, "extract").keep(reports.frame_report(media, mode="salvage" if salvage else "restore"), "report")
    reports.restore_to(reports.restorable(media, report), to)
    return report


def dump(spark: SparkSession, source: str, target: str) -> dict:
    """A volume copied unread: counts of records, bytes and files."""
    return spool.copy_spool(spark, source, target)


def plan_hash(path: str) -> str:
    hasher = Blake3()
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            hasher.update(piece)
    return hasher.digest().hex()

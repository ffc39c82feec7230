"""Frames to records: header, payload, padding, hash and signature."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.functions.blake3 import blake3_many
from reelframe.sources.frames import ARCHIVE_END, HASH, HEADER, SIGNATURE, build_header, canonical

NEEDS = ["channel_type", "volume_seq_num", "global_frame_seq_num", "slice_seq_num", "channel_frame_seq_num", "frame_payload_size", "is_end", "payload"]


def with_archive_end(frames: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Adds the closing frame, which takes the next global number; heads: rows that tell the last one, if not all frames shall."""
    end = (frames if heads is None else heads).agg(F.coalesce(F.max("global_frame_seq_num") + 1, F.lit(0)).alias("global_frame_seq_num"), F.coalesce(F.max("volume_seq_num"), F.lit(0)).alias("volume_seq_num"))
    end = end.select(F.lit(ARCHIVE_END).alias("channel_type"), "volume_seq_num", "global_frame_seq_num", F.lit(0).alias("slice_seq_num"), F.lit(0).alias("channel_frame_seq_num"), F.lit(0).alias("frame_payload_size"), F.lit(True).alias("is_end"), F.lit(b"").alias("payload"))
    return frames.select(*NEEDS).unionByName(end)


def build_records(frames: DataFrame, block: int, uuid: str, label: bytes, seed: bytes | None = None, key_id: bytes = bytes(8), domain: bytes = b"") -> DataFrame:
    """(global_frame_seq_num, volume_seq_num, record) of frames with NEEDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from reelframe.functions.ed25519 import sign

        for b in batches:
            rows = [dict(zip(NEEDS, v, strict=True)) for v in zip(*(b.column(n).to_pylist() for n in NEEDS), strict=True)]
            same = {"volume_block_size_kib": block // 1024, "archive_uuid": uuid, "archive_label": label, "is_signed": seed is not None}
            out = [bytearray(build_header(r | same | {"is_clean_end": r["channel_type"] == ARCHIVE_END}) + (r["payload"] or b"").ljust(block - HEADER, b"\0")) for r in rows]
            for record, digest in zip(out, blake3_many([canonical(bytes(r)) for r in out]), strict=True):
                record[HASH:HEADER] = digest
                if seed:
                    record[SIGNATURE:HASH] = key_id + sign(seed, domain + digest)
            yield pa.RecordBatch.from_arrays([b.column("global_frame_seq_num"), b.column("volume_seq_num"), pa.array([bytes(r) for r in out], pa.binary())], names=["global_frame_seq_num", "volume_seq_num", "record"])

    own = frames.select(*(F.col(n).cast("long") if n in NEEDS[1:6] else F.col(n) for n in NEEDS))
    return own.mapInArrow(run, "global_frame_seq_num long, volume_seq_num long, record binary")

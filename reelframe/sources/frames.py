"""Frame records: fixed-size blocks of a 512-byte header and a payload.

Headers are read with built-in expressions from a binary column, so pruning and
code generation apply; hashing and building records are Arrow functions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions.blake3 import blake3_many
from reelframe.functions.numbers import U64, little_endian

# Fixed values of the format: the magic (seven ASCII letters and NUL), sizes, offsets, flag bits.
MAGIC = bytes.fromhex("4E656F5461706500")
HEADER, LEAST_BLOCK, MOST_BLOCK = 512, 4096, 8192 * 1024
VERSION, CHANNEL, BLOCK_KIB, UUID, LABEL = 8, 9, 10, 12, 49
VOLUME, GLOBAL, SLICE, CHANNEL_SEQ, PAYLOAD, FLAGS = 114, 122, 130, 138, 146, 150
RESERVED, SIDEBAND, SIGNATURE, HASH = 158, 280, 408, 480
END, SIGNED, SIDE, CLEAN_END = 0, 1, 2, 63
CONTENT, METADATA, ARCHIVE_END = 1, 2, 255

FIELDS = ["channel_type", "volume_block_size_kib", "archive_uuid", "archive_label", "volume_seq_num", "global_frame_seq_num", "slice_seq_num", "channel_frame_seq_num", "frame_payload_size", "is_end", "is_signed", "is_sideband", "is_clean_end", "signature", "frame_hash"]


def has_magic(record: Column) -> Column:
    return F.coalesce(F.substring(record, 1, 8) == F.lit(MAGIC), F.lit(False))


def _part(record: Column, offset: int, width: int) -> Column:
    return F.substring(record, offset + 1, width)


def _zero(record: Column, offset: int, width: int) -> Column:
    return _part(record, offset, width) == F.lit(bytes(width))


def _text(record: Column, offset: int, width: int) -> tuple[Column, Column]:
    """A NUL-padded field: its bytes, and whether only zeros follow the first NUL."""
    digits = F.hex(_part(record, offset, width))
    core = F.regexp_replace(digits, "(00)*$", "")
    core = F.when(F.length(core) % 2 == 1, F.concat(core, F.lit("0"))).otherwise(core)
    inner = core.rlike("^(?:..)*?00")
    return F.unhex(core), (F.length(core) < 2 * width) & ~inner


def _bit(record: Column, n: int) -> Column:
    byte = F.conv(F.hex(_part(record, FLAGS + n // 8, 1)), 16, 10).cast("int")
    return F.shiftright(byte, n % 8).bitwiseAND(F.lit(1)) == 1


def parse_headers(frames: DataFrame, record: str = "record", size: str | None = None) -> DataFrame:
    """Adds the header's fields and header_error, the first rule it breaks (else null).

    Fields are null where there is an error.  size: a column with the record's length
    if ``record`` holds only the header.
    """
    r = F.col(record)
    length = F.col(size) if size else F.octet_length(r)
    channel, block = (F.conv(F.hex(_part(r, CHANNEL, 1)), 16, 10).cast("short"), little_endian(r, BLOCK_KIB, 2).cast("int"))
    uuid, uuid_ok = _text(r, UUID, 37)
    label, label_ok = _text(r, LABEL, 65)
    payload = little_endian(r, PAYLOAD, 4).cast("long")
    end, signed, side, clean = (_bit(r, n) for n in (END, SIGNED, SIDE, CLEAN_END))
    capacity = block.cast("long") * 1024 - HEADER
    others = (F.conv(F.hex(_part(r, FLAGS, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0xF8)) != 0) | ~_zero(r, FLAGS + 1, 6) | (F.conv(F.hex(_part(r, FLAGS + 7, 1)), 16, 10).cast("int").bitwiseAND(F.lit(0x7F)) != 0)
    last = channel == ARCHIVE_END
    slice_, seq = little_endian(r, SLICE, 8), little_endian(r, CHANNEL_SEQ, 8)
    rules = [
        (length < HEADER, "record shorter than the header"),
        (~has_magic(r), "no magic"),
        (_part(r, VERSION, 1) != F.lit(b"\x01"), "unknown header version"),
        (~channel.isin(CONTENT, METADATA, ARCHIVE_END), "unknown channel"),
        (~uuid_ok | ~label_ok, "text field not closed by zeros"),
        (~_zero(r, RESERVED, 122), "reserved bytes in use"),
        (~block.between(LEAST_BLOCK // 1024, MOST_BLOCK // 1024), "block size out of range"),
        (payload > capacity, "payload larger than the block"),
        (others, "reserved flags in use"),
        (side | ~_zero(r, SIDEBAND, 128), "sideband in use"),
        (last & ~(end & clean), "archive end without its flags"),
        (last & ((slice_ != 0) | (seq != 0)), "archive end with a slice or channel number"),
        (last & (payload != 0), "archive end with a payload"),
        (~last & clean, "CLEAN_END before the archive end"),
        (~last & ~end & (payload != capacity), "payload does not fill the record"),
        (~signed & ~_zero(r, SIGNATURE, 72), "signature on an unsigned frame"),
    ]
    error = F.coalesce(*(F.when(F.coalesce(c, F.lit(True)), F.lit(why)) for c, why in rules))
    fields = [channel, block, uuid.cast("string"), label, little_endian(r, VOLUME, 8), little_endian(r, GLOBAL, 8), slice_, seq, payload, end, signed, side, clean, _part(r, SIGNATURE, 72), _part(r, HASH, 32)]
    own = frames.withColumn("header_error", error)
    return own.withColumns({n: F.when(F.col("header_error").isNull(), c) for n, c in zip(FIELDS, fields, strict=True)})


def build_header(f: dict) -> bytes:
    """512 bytes for a dict of fields, hash and signature as given (zeros if not)."""
    uuid, label = f["archive_uuid"].encode(), bytes(f.get("archive_label") or b"")
    if len(uuid) > 36 or len(label) > 64 or b"\0" in uuid + label:
        raise ValueError("text field too long or with NUL")
    flags = sum(1 << bit for bit, name in ((END, "is_end"), (SIGNED, "is_signed"), (SIDE, "is_sideband"), (CLEAN_END, "is_clean_end")) if f.get(name))
    out = bytearray(HEADER)
    out[:8] = MAGIC
    struct.pack_into("<BBH37s65s", out, VERSION, 1, f["channel_type"], f["volume_block_size_kib"], uuid, label)
    struct.pack_into("<QQQQIQ", out, VOLUME, *(int(f.get(n) or 0) for n in ("volume_seq_num", "global_frame_seq_num", "slice_seq_num", "channel_frame_seq_num", "frame_payload_size")), flags)
    out[SIGNATURE:HASH] = bytes(f.get("signature") or bytes(72))
    out[HASH:] = bytes(f.get("frame_hash") or bytes(32))
    return bytes(out)


def canonical(record: bytes, volume: int | None = None) -> bytes:
    """The record as it is hashed: without signature and hash, the volume number replaced if given."""
    out = bytearray(record)
    out[SIGNATURE:HEADER] = bytes(HEADER - SIGNATURE)
    if volume is not None:
        struct.pack_into("<Q", out, VOLUME, volume)
    return bytes(out)


def finish(record: bytes, volume: int, seed: bytes | None = None, key_id: bytes = bytes(8), domain: bytes = b"") -> bytes:
    """A record for a volume: its number, hash and, with a seed, signature put in."""
    from reelframe.functions.ed25519 import sign

    out = bytearray(canonical(record, volume))
    out[HASH:HEADER] = digest = blake3_many([bytes(out)])[0]
    if seed:
        out[SIGNATURE:HASH] = key_id + sign(seed, domain + digest)
    return bytes(out)


def check_frames(frames: DataFrame, record: str = "record") -> DataFrame:
    """Adds size_ok, hash_ok, padding_ok and norm_hash to frames with parsed headers.

    norm_hash is the hash with the volume number set to 0: two records differ in
    nothing but that number exactly when their norm_hash is the same.  Rows with a
    header_error get nulls.
    """
    names = frames.columns
    more = "size_ok boolean, hash_ok boolean, padding_ok boolean, norm_hash binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {n: b.column(n).to_pylist() for n in (record, "header_error", "volume_block_size_kib", "frame_payload_size", "frame_hash")}
            rows = [i for i, e in enumerate(at["header_error"]) if e is None]
            size = {i: len(at[record][i]) == at["volume_block_size_kib"][i] * 1024 for i in rows}
            whole = [i for i in rows if size[i]]
            own = blake3_many([canonical(at[record][i]) for i in whole])
            norm = blake3_many([canonical(at[record][i], 0) for i in whole])
            out = [[None] * b.num_rows for _ in range(4)]
            for i in rows:
                out[0][i], out[1][i], out[2][i] = size[i], False, False
            for i, digest, alike in zip(whole, own, norm, strict=True):
                pad = np.frombuffer(at[record][i], np.uint8)[HEADER + at["frame_payload_size"][i] :]
                out[1][i], out[2][i], out[3][i] = digest == at["frame_hash"][i], not pad.any(), alike
            types = [pa.bool_(), pa.bool_(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=[*names, "size_ok", "hash_ok", "padding_ok", "norm_hash"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields)
    return frames.mapInArrow(run, f"{schema}, {more}")


def payload(record: Column, length: Column) -> Column:
    return F.substring(record, F.lit(HEADER + 1), length.cast("int"))


__all__ = ["FIELDS", "U64", "build_header", "canonical", "check_frames", "finish", "has_magic", "parse_headers", "payload"]

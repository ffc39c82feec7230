"""Message logs: a type byte, a little-endian 64-bit length, a payload."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions.numbers import little_endian_bytes

MOST = 16 << 20  # bytes of a payload


def encode_messages(messages: DataFrame, kind: str = "type", payload: str = "payload") -> DataFrame:
    """Adds the bytes of each message."""
    own: Column = F.coalesce(F.col(payload), F.lit(b""))
    return messages.withColumn("message", F.concat(little_endian_bytes(F.col(kind), 1), little_endian_bytes(F.octet_length(own), 8), own))


def decode_log(log: bytes) -> Iterator[tuple[int, int | None, int | None, bytes | None, str | None]]:
    """(ord, type, length, payload, error); an error ends the log."""
    at, n = 0, 0
    while at < len(log):
        n += 1
        head = log[at : at + 9]
        if len(head) < 9:
            yield n, None, None, None, "short header"
            return
        kind, length = head[0], int.from_bytes(head[1:], "little")
        if not 1 <= kind <= 7:
            yield n, kind, None, None, "unknown type"
            return
        if length > MOST:
            yield n, kind, length, None, "payload too large"
            return
        body = log[at + 9 : at + 9 + length]
        if len(body) < length:
            yield n, kind, length, None, "short payload"
            return
        yield n, kind, length, body, None
        at += 9 + length


def decode_messages(logs: DataFrame, name: str = "name", data: str = "bytes") -> DataFrame:
    """(name, ord, type, length, payload, error) from whole logs, one log a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(n, *m) for n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in decode_log(raw or b"")]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = (pa.string(), pa.int64(), pa.int16(), pa.decimal128(20, 0), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["name", "ord", "type", "length", "payload", "error"])

    return logs.select(F.col(name).cast("string"), F.col(data).cast("binary")).mapInArrow(run, "name string, ord bigint, type smallint, length decimal(20,0), payload binary, error string")

"""Entries as pax members: header, data and padding, by the standard library."""

from __future__ import annotations

import os
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions.blake3 import Blake3

TYPES = {"f": tarfile.REGTYPE, "d": tarfile.DIRTYPE, "l": tarfile.SYMTYPE, "h": tarfile.LNKTYPE, "c": tarfile.CHRTYPE, "b": tarfile.BLKTYPE, "p": tarfile.FIFOTYPE}
#: What closes a slice's stream.
CLOSING = bytes(2 * tarfile.BLOCKSIZE)


def header(path: bytes, kind: str, size: int, mtime: int, uid: int, gid: int, uname: str = "", gname: str = "", link: bytes = b"", mode: int = 0o644) -> bytes | None:
    """The header blocks of an entry; a socket has none."""
    if kind not in TYPES:
        return None
    t = tarfile.TarInfo(path.decode("utf-8", "surrogateescape"))
    t.type, t.mtime, t.uid, t.gid, t.uname, t.gname, t.mode = TYPES[kind], mtime, uid, gid, uname, gname, mode
    t.linkname = link.decode("utf-8", "surrogateescape")
    t.size = size if kind == "f" else 0
    return t.tobuf(tarfile.PAX_FORMAT, "utf-8", "surrogateescape")


def member(path: bytes, kind: str, data: bytes | None, mtime: int, uid: int, gid: int, uname: str = "", gname: str = "", link: bytes = b"", mode: int = 0o644) -> bytes:
    """One entry; a socket has none."""
    body = data or b"" if kind == "f" else b""
    head = header(path, kind, len(body), mtime, uid, gid, uname, gname, link, mode)
    return b"" if head is None else head + body + bytes(-len(body) % tarfile.BLOCKSIZE)


def pax_members(entries: DataFrame) -> DataFrame:
    """Adds member to entries with path, kind, data, mtime, uid, gid, uname, gname and link."""
    names = entries.columns
    needs = ["path", "kind", "data", "mtime", "uid", "gid", "uname", "gname", "link"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(n).to_pylist() for n in needs), strict=True)
            made = [member(p, k, d, m or 0, u or 0, g or 0, un or "", gn or "", ln or b"") for p, k, d, m, u, g, un, gn, ln in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=[*names, "member"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema.fields)
    return entries.mapInArrow(run, f"{schema}, member binary")


WRITTEN = "slice bigint, name string, entries bigint, input_bytes bigint, output_bytes bigint"
PIECE = 1 << 20


def write_slices(entries: DataFrame, prefix: str) -> DataFrame:
    """Writes each slice of planned entries as ``<prefix>NNNNNN.pax`` and returns a row for each: WRITTEN.

    entries: slice, file_num, source_path (where the file is read), path, kind, size, mtime,
    uid, gid, uname, gname and link.  A slice is one task's; file contents are read by the
    executors in pieces, so memory does not grow with a file or a slice.  A file that has
    become shorter is filled with zeros, a longer one is cut to its planned size.  Files get
    their name when they are whole.
    """
    needs = ["slice", "file_num", "source_path", "path", "kind", "size", "mtime", "uid", "gid", "uname", "gname", "link"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out, now, done = None, None, []

        def finish() -> None:
            out.write(CLOSING)
            done[-1][4] = out.tell()
            out.flush()
            os.fsync(out.fileno())
            out.close()
            os.rename(out.name, done[-1][1])

        for b in batches:
            for slice_, _, source, path, kind, size, mtime, uid, gid, uname, gname, link in zip(*(b.column(n).to_pylist() for n in needs), strict=True):
                if slice_ != now:
                    if out:
                        finish()
                    now, name = slice_, f"{prefix}{slice_:06d}.pax"
                    out = open(f"{name}.{task.taskAttemptId()}.TMP", "wb")  # noqa: SIM115
                    done.append([slice_, name, 0, 0, 0])
                done[-1][2] += 1
                t = header(path, kind, size or 0, mtime or 0, uid or 0, gid or 0, uname or "", gname or "", link or b"")
                if t is None:
                    continue
                out.write(t)
                if kind == "f" and size:
                    done[-1][3] += size
                    with open(source, "rb") as f:
                        left = size
                        while left:
                            piece = f.read(min(PIECE, left)) or bytes(min(PIECE, left))
                            out.write(piece)
                            left -= len(piece)
                    out.write(bytes(-size % tarfile.BLOCKSIZE))
        if out:
            finish()
        cols = list(zip(*done, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), *[pa.int64()] * 3), strict=True)], names=["slice", "name", "entries", "input_bytes", "output_bytes"])

    return entries.select(*needs).repartition("slice").sortWithinPartitions("slice", "file_num").mapInArrow(run, WRITTEN)


def stream_hash(written: DataFrame) -> tuple[dict, str]:
    """Totals of written slices, and the BLAKE3 of all their bytes one after the other."""
    hasher, total = Blake3(), {"slices": 0, "entries": 0, "input_bytes": 0, "output_bytes": 0}
    for row in written.orderBy("slice").toLocalIterator():
        total["slices"] += 1
        for c in ("entries", "input_bytes", "output_bytes"):
            total[c] += row[c]
        with open(row["name"], "rb") as f:
            while piece := f.read(PIECE):
                hasher.update(piece)
    return total, hasher.digest().hex()


def verbose_line(mode: Column, links: Column, user: Column, group: Column, size: Column, when: Column, path: Column) -> Column:
    """mode, links, owner, group, size for people, [time], path."""
    return F.format_string("%s %3d %10s %10s %6s [%s] %s", mode, links, user, group, size, when, path)

"""Spool directories as tables: a data source that reads and writes them.

``format("spool")`` reads one directory, the dump of a volume, into rows of (file_num,
file_name, rec_idx, rec_size, record), or only the first record's header of each
file with ``mode=first_record``.  A file is cut into ranges of records, each a
partition of its own, so a large file is read by many tasks; the record size comes
from an archive's first header and is learnt anew after an archive end.  An end with
records of another size after it in one file needs ``framing=sequential``, a task for each
file; a range that meets such records is an error, not a wrong cut.  A short tail is left
out with a warning, as an interrupted write.  ``skip_files`` is a list of file numbers
to leave out, ``skip_foreign`` leaves out files that do not begin with a frame.

Writing puts each file's records under a temporary name of the task's attempt and
renames on commit what the attempts that count have written, so a repeated or
speculative task does no harm.  The partitioning of the written rows must hold each
file_num in one task, in order.  A row's file_name, if any, is the directory it goes to.

Directories are read and written with plain file calls: they must be mounted at the
same place for the driver and all executors.
"""

from __future__ import annotations

import errno
import os
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from reelframe.functions.blake3 import blake3_many
from reelframe.sources.frames import ARCHIVE_END, BLOCK_KIB, CHANNEL, HASH, HEADER, MAGIC, canonical

NAME = re.compile(r"NT([0-9]{1,6})\.NTS", re.IGNORECASE)
SCHEMA = "file_num bigint, file_name string, rec_idx bigint, rec_size bigint, record binary"
RANGE = 64 << 20  # bytes of a file that one task reads


def spool_files(root: str) -> list[tuple[int, str, int]]:
    """(number, name, length) of a directory's spool files by number; a number twice is an error."""
    found = sorted((int(m[1]), p.name, p.stat().st_size) for p in Path(root).iterdir() if p.is_file() and (m := NAME.fullmatch(p.name)))
    for (a, x, _), (b, y, _) in zip(found, found[1:], strict=False):
        if a == b:
            raise ValueError(f"two files have the number {a}: {x} and {y}")
    return found


def spool_gaps(root: str) -> list[tuple[int, int]]:
    """Numbers (before, after) between which files are missing."""
    n = [x[0] for x in spool_files(root)]
    return [(a, b) for a, b in zip(n, n[1:], strict=False) if b != a + 1]


def block_size(header: bytes) -> int | None:
    if len(header) < HEADER or header[:8] != MAGIC:
        return None
    size = int.from_bytes(header[BLOCK_KIB : BLOCK_KIB + 2], "little") * 1024
    return size or None


def is_end(record: bytes) -> bool:
    """Whether a whole record is an archive end whose hash is right."""
    return record[:8] == MAGIC and record[CHANNEL] == ARCHIVE_END and blake3_many([canonical(record)])[0] == record[HASH:HEADER]


@dataclass
class Part(InputPartition):
    file_num: int
    name: str
    first: int
    count: int
    size: int  # of a record; None: from the file itself

    def __post_init__(self):
        self.value = None


class SpoolReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.mode = options["path"], options.get("mode", "all")
        self.sequential = options.get("framing", "ranges") == "sequential"
        self.skipped = {int(x) for x in options.get("skip_files", "").split(",") if x.strip()}
        self.foreign = options.get("skip_foreign", "false") == "true"
        if self.mode not in ("all", "first_record"):
            raise ValueError(f"mode is all or first_record, not {self.mode}")

    def head(self, name: str) -> int | None:
        with open(os.path.join(self.root, name), "rb") as f:
            return block_size(f.read(HEADER))

    def partitions(self) -> list[Part]:
        parts, size = [], None
        for num, name, length in spool_files(self.root):
            if num in self.skipped or self.foreign and self.head(name) is None:
                continue
            if self.mode == "first_record":
                parts.append(Part(num, name, 0, 1, HEADER))
                continue
            if size is None:
                size = self.head(name)
                if size is None:
                    raise ValueError(f"{name}: the first record of the archive has no header")
            if self.sequential:
                parts.append(Part(num, name, 0, -1, size))
                size = self.last_size(name, size)
                continue
            if length % size:
                warnings.warn(f"{name}: a short tail of {length % size} bytes is left out", stacklevel=2)
            per = max(1, RANGE // size)
            parts += [Part(num, name, at, min(per, length // size - at), size) for at in range(0, length // size, per)]
            if length >= size and self.ends(name, length // size - 1, size):
                size = None
        return parts or [Part(0, "", 0, 0, HEADER)]

    def ends(self, name: str, index: int, size: int) -> bool:
        with open(os.path.join(self.root, name), "rb") as f:
            f.seek(index * size)
            return is_end(f.read(size))

    def last_size(self, name: str, size: int) -> int | None:
        """The record size that holds after a file."""
        for _, record in self.framed(name, size):
            size = None if is_end(record) else len(record)
        return size

    def framed(self, name: str, size: int | None) -> Iterator[tuple[int, bytes]]:
        """Records of a file one after another; the size is learnt anew after an archive end."""
        with open(os.path.join(self.root, name), "rb") as f:
            i = 0
            while True:
                if size is None:
                    head = f.read(HEADER)
                    size = block_size(head)
                    if size is None:
                        if head:
                            warnings.warn(f"{name}: a short tail or records without a header after record {i} are left out", stacklevel=2)
                        return
                    f.seek(-HEADER, os.SEEK_CUR)
                record = f.read(size)
                if len(record) < size:
                    if record:
                        warnings.warn(f"{name}: a short tail of {len(record)} bytes is left out", stacklevel=2)
                    return
                yield i, record
                i += 1
                if is_end(record):
                    size = None

    def read(self, part: Part) -> Iterator[tuple]:
        if part.count < 0:
            for i, record in self.framed(part.name, part.size):
                yield part.file_num, part.name, i, len(record), record
        if part.count <= 0:
            return
        with open(os.path.join(self.root, part.name), "rb") as f:
            f.seek(part.first * part.size)
            for i in range(part.first, part.first + part.count):
                record = f.read(part.size)
                if len(record) < part.size:
                    return
                if self.mode == "all" and record[:8] == MAGIC and block_size(record) not in (None, part.size) and i > 0:
                    with open(os.path.join(self.root, part.name), "rb") as g:
                        g.seek((i - 1) * part.size)
                        if is_end(g.read(part.size)):
                            raise ValueError(f"{part.name}: an archive of another record size begins at record {i}; read with framing=sequential")
                yield part.file_num, part.name, i, len(record), record


@dataclass
class Written(WriterCommitMessage):
    names: list


class SpoolWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite
        os.makedirs(self.root, exist_ok=True)
        if not overwrite and spool_files(self.root):
            raise ValueError(f"{self.root} holds spool files already")

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        attempt = task.taskAttemptId() if task else 0
        names, out, now = [], None, None
        try:
            for row in rows:
                root = row.file_name or self.root
                if (root, row.file_num) != now:
                    if out:
                        self.close(out)
                    now = root, row.file_num
                    path = os.path.join(root, f"NT{row.file_num:06d}.{attempt}.TMP")
                    if path in names:
                        raise ValueError(f"the rows of file {row.file_num} are not together")
                    os.makedirs(root, exist_ok=True)
                    names.append(path)
                    out = open(path, "wb")  # noqa: SIM115
                whole = out.tell()
                try:
                    out.write(row.record)
                    out.flush()
                except OSError as e:
                    if e.errno == errno.ENOSPC:  # whole records only are left
                        out.truncate(whole)
                    raise
        finally:
            if out:
                self.close(out)
        return Written(names)

    @staticmethod
    def close(out) -> None:
        out.flush()
        os.fsync(out.fileno())
        out.close()

    def commit(self, messages: list) -> None:
        written = [n for m in messages if m for n in m.names]
        if self.overwrite:
            for root in {self.root, *map(os.path.dirname, written)}:
                for _, name, _ in spool_files(root):
                    os.remove(os.path.join(root, name))
        for path in written:
            os.rename(path, re.sub(r"\.[0-9]+\.TMP$", ".NTS", path))
        for root in {self.root, *map(os.path.dirname, written)}:
            for name in os.listdir(root):  # of attempts that do not count
                if re.fullmatch(r"NT[0-9]+\.[0-9]+\.TMP", name):
                    os.remove(os.path.join(root, name))

    def abort(self, messages: list) -> None:
        for path in (n for m in messages if m for n in m.names):
            if os.path.exists(path):
                os.remove(path)


class Spool(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spool"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SpoolReader:
        return SpoolReader(self.options)

    def writer(self, schema, overwrite: bool) -> SpoolWriter:
        return SpoolWriter(self.options, overwrite)


def read_spool(spark: SparkSession, path: str, mode: str = "all", **options: str) -> DataFrame:
    spark.dataSource.register(Spool)
    return spark.read.format("spool").options(mode=mode, **options).load(path)


def write_spool(frames: DataFrame, path: str, mode: str = "append") -> None:
    """Rows of file_num, rec_idx and record (and file_name, the directory if not ``path``) as files, each in one task."""
    frames.sparkSession.dataSource.register(Spool)
    own = frames if "file_name" in frames.columns else frames.selectExpr("*", "'' AS file_name")
    ordered = own.repartition("file_name", "file_num").sortWithinPartitions("file_name", "file_num", "rec_idx")
    ordered.selectExpr("file_num", "file_name", "rec_idx", "octet_length(record) AS rec_size", "record").write.format("spool").mode(mode).save(path)


def copy_spool(spark: SparkSession, source: str, target: str) -> dict:
    """Dump a spool to another, unread: counts of records, bytes and files."""
    rows = read_spool(spark, source)
    write_spool(rows.drop("file_name"), target)
    r = rows.selectExpr("count(*) AS records", "coalesce(sum(rec_size), 0) AS bytes", "count(DISTINCT file_num) AS files").first()
    return r.asDict()

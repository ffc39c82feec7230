"""NUL-LF records: plan and resume files.

A record ends with NUL and LF.  Text fields are opaque bytes, so records are split as
ISO-8859-1, which maps every byte to one character and back.
"""

from __future__ import annotations

import itertools
import os
import warnings
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelframe.functions.names import is_lower_hex
from reelframe.functions.numbers import signed, unsigned
from reelframe.operators.lookups import bounded

KINDS = "fhdlcbps"
PLAN = ["slice", "file_num", "kind", "size", "mtime", "uid", "uname", "gid", "gname"]
#: Records of one file that are judged in one task.
SPAN = 1 << 18
RESUME = ["archive_uuid", "block_size_kib", "sign_key_id", "plan_blake3", "archive_name"]


def _split(chunks: Iterable[bytes]) -> Iterator[tuple[str, bytes]]:
    """(state, record) of a file that comes in pieces; what is held is a piece and a record."""
    held = b""
    for chunk in chunks:
        held, at = held + chunk, 0
        while 0 <= (end := held.find(b"\0", at)) < len(held) - 1:
            whole = held[end + 1] == 10
            yield "record" if whole else "malformed", held[at:end]
            if not whole:
                return
            at = end + 2
        held = held[at:]
    if held:
        yield "truncated", held.removesuffix(b"\0")


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while part := list(itertools.islice(rows, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["name", "ord", "state", "record"])


SPLIT = "name string, ord bigint, state string, record binary"


def split_records(files: DataFrame, name: str = "name", data: str = "bytes") -> DataFrame:
    """(name, ord, state, record) from whole files: state is record, truncated or malformed.

    The first record that is not whole ends its file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = ((n.as_py(), raw.as_py() or b"") for b in batches for n, raw in zip(b.column(0), b.column(1), strict=True))
        yield from _batches((n, i, *found) for n, raw in files for i, found in enumerate(_split([raw]), 1))

    return files.select(F.col(name).cast("string"), F.col(data).cast("binary")).mapInArrow(run, SPLIT)


def split_stream(parts: DataFrame, order: str, data: str, name: str) -> DataFrame:
    """What ``split_records`` gives, of one stream whose parts stand in rows; ``name`` is put beside its records.

    The parts stream through one task in order, a batch at a time, as a record may begin in
    one part and end in a later one.  The records are dealt anew by whoever reads them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = (raw.as_py() or b"" for b in batches for raw in b.column(1))
        yield from _batches((name, i, *found) for i, found in enumerate(_split(chunks), 1))

    return parts.select(order, F.col(data).cast("binary")).repartition(1).sortWithinPartitions(order).mapInArrow(run, SPLIT)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """What ``split_records`` gives, of plan or resume files by their path, read by ranges without Python.

    A range of a file is a task.  How many records a range has is counted first; what
    number its first record has follows from the ranges before it.  The reader drops a byte
    order mark in front and does not tell whether the last record had its end; both follow
    from the file's size.
    """
    text = _latin(F.col("piece"))
    nul = F.instr(text, "\0")
    rows = spark.read.text(path, lineSep="\0\n").select(
        F.col("_metadata.file_path").alias("name"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("piece"),
    )
    ranges = rows.groupBy("name", "size", "start").agg(F.min("at").alias("least"), F.count("*").alias("n"), F.sum(F.octet_length("piece") + 2).alias("bytes"), F.min(F.when(nul > 0, F.col("at"))).alias("odd"))
    file = W.partitionBy("name")
    before = F.coalesce(F.sum("n").over(file.orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumns({"before": before, "total": F.sum("n").over(file), "extra": F.col("size") - F.sum("bytes").over(file)})
    ranges = ranges.withColumn("stop", F.min(F.col("before") + F.col("odd") - F.col("least") + 1).over(file)).drop("size", "bytes", "odd", "n")
    placed = rows.drop("size").join(bounded(ranges), ["name", "start"]).withColumn("ord", F.col("before") + F.col("at") - F.col("least") + 1)
    placed = placed.where(F.col("stop").isNull() | (F.col("ord") <= F.col("stop")))
    marked = (F.col("ord") == 1) & F.col("extra").isin(3, 1)
    torn = (F.col("ord") == F.col("total")) & F.col("extra").isin(-2, 1)
    state = F.when(torn & nul.isin(0, F.length(text)), "truncated").when(nul > 0, "malformed").otherwise("record")
    record = F.when(nul > 0, F.expr("substring(piece, 1, instr(decode(piece, 'ISO-8859-1'), '\\0') - 1)")).otherwise(F.col("piece"))
    return placed.select("name", "ord", state.alias("state"), F.when(marked, F.concat(F.lit(b"\xef\xbb\xbf"), record)).otherwise(record).alias("record"))


def _latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def _bytes(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def parse_plan(records: DataFrame) -> DataFrame:
    """Plan fields of (name, ord, state, record) and error, the first rule a record breaks.

    Slices and file numbers must run without a gap; a directive may only come first.
    Rows after a file's first error are left out, as reading stops there.  A file is judged
    by spans of ``SPAN`` numbers: the last entry before a span, and whether an error is before
    it, come from one row a span.
    """
    text = _latin(F.col("record"))
    parts = F.split(F.substr(text, F.lit(2)), "/", 10)
    field = lambda i: F.get(parts, F.lit(i))
    rows = records.withColumns(
        {
            "chdir": F.when(text.startswith("/chdir/"), _bytes(F.substr(text, F.lit(8)))),
            "slice": unsigned(field(0)), "file_num": unsigned(field(1)), "kind": field(2), "size": unsigned(field(3)), "mtime": signed(field(4)),
            "uid": unsigned(field(5), 0, 2**32 - 1).cast("long"), "uname": _bytes(field(6)), "gid": unsigned(field(7), 0, 2**32 - 1).cast("long"), "gname": _bytes(field(8)), "path": _bytes(field(9)),
            "fields": F.size(parts),
        }
    )
    entry = F.col("chdir").isNull()
    rows = rows.withColumn("span", F.floor(F.col("ord") / SPAN))
    numbers = F.when(entry, F.struct("slice", "file_num"))
    earlier = W.partitionBy("name").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    seams = rows.groupBy("name", "span").agg(F.max_by(numbers, F.when(entry, F.col("ord"))).alias("own"))
    seams = seams.select("name", "span", F.last("own", ignorenulls=True).over(earlier).alias("seam"))
    before = W.partitionBy("name", "span").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.last(numbers, ignorenulls=True).over(before)).join(seams, ["name", "span"], "left")
    last = F.coalesce("near", "seam")
    follows = F.when(last.isNull(), (F.col("slice") == 0) & (F.col("file_num") == 0)).otherwise(
        ((F.col("slice") == last["slice"]) & (F.col("file_num") == last["file_num"] + 1)) | ((F.col("slice") == last["slice"] + 1) & (F.col("file_num") == 0))
    )
    bad = entry & (
        ~text.startswith("/") | (F.col("fields") < 10) | (F.length("kind") != 1) | ~F.col("kind").isin(*KINDS) | (F.octet_length("path") == 0) | _latin(F.col("path")).startswith("/")
        | F.col("slice").isNull() | F.col("file_num").isNull() | F.col("size").isNull() | F.col("mtime").isNull() | F.col("uid").isNull() | F.col("gid").isNull()
    )
    error = (
        F.when(F.col("state") != "record", "unterminated record")
        .when(~entry & ((F.col("ord") != 1) | (F.octet_length("chdir") == 0)), "directive not first or empty")
        .when(F.coalesce(bad, F.lit(True)), "invalid record")
        .when(entry & (F.col("kind") == "h") & (F.col("size") != 0), "hard link with a size")
        .when(entry & ~F.coalesce(follows, F.lit(False)), "slice or file number does not follow")
    )
    rows = rows.withColumn("error", error)
    ended = rows.groupBy("name", "span").agg(F.max(F.col("error").isNotNull()).alias("own"))
    ended = ended.select("name", "span", F.max("own").over(earlier).alias("ended"))
    failed = F.max(F.col("error").isNotNull()).over(before)
    rows = rows.withColumn("failed", failed).join(ended, ["name", "span"], "left").where(~F.coalesce("failed", F.lit(False)) & ~F.coalesce("ended", F.lit(False)))
    good = F.col("error").isNull()
    only = {c: F.when(good & entry, F.col(c)) for c in [*PLAN, "path"]} | {"chdir": F.when(good, F.col("chdir"))}
    return rows.withColumns(only).select("name", "ord", "chdir", *PLAN, "path", "error")


def encode_plan(entries: DataFrame) -> DataFrame:
    """Adds the record of each entry: an owner's name with a slash or NUL is left empty."""

    def owner(c: str) -> Column:
        text = _latin(F.col(c).cast("binary"))
        return F.when(text.contains("/") | text.contains("\0"), "").otherwise(text)

    texts = ["slice", "file_num", "kind", "size", "mtime", "uid", owner("uname"), "gid", owner("gname"), _latin(F.col("path").cast("binary"))]
    body = F.concat(*(F.concat(F.lit("/"), (F.col(t) if isinstance(t, str) else t).cast("string")) for t in texts))
    return entries.withColumn("record", F.concat(_bytes(body), F.lit(b"\0\n")))


def parse_resume(records: DataFrame, first: str | None = None) -> DataFrame:
    """Keys and values of resume records: (name, ord, key, value, slice, global_seq, volume, error).

    first: what the first record must be; if not given, ``/<word>-resume/1``.  A
    truncated last record is left out.
    """
    text = _latin(F.col("record"))
    key, value = F.regexp_extract(text, "(?s)^/([^/]*)/", 1), F.regexp_replace(text, "(?s)^/[^/]*/", "")
    head = (text == F.lit(first)) if first else text.rlike("^/[a-z]+-resume/1$")
    point = F.split(value, "/")
    part = lambda i, least=0: unsigned(F.get(point, F.lit(i)), least)
    rows = records.where("state <> 'truncated'").withColumns({"key": key, "value": value, "slice": F.when(key == "slice", part(0, 1)), "global_seq": F.when(key == "slice", part(1)).when(key == "archive_end", unsigned(value)), "volume": F.when(key == "slice", part(2))})
    header = F.col("key").isin(*RESUME)
    before = W.partitionBy("name").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    seen = F.collect_set(F.when(header, F.col("key"))).over(before)  # five keys at most
    rows = rows.withColumns({"seen": seen, "ended": F.coalesce(F.max(F.col("key") == "archive_end").over(before), F.lit(False)), "pointed": F.coalesce(F.max(F.col("key") == "slice").over(before), F.lit(False))})
    error = (
        F.when(F.col("state") == "malformed", "invalid terminator")
        .when(F.col("ord") == 1, F.when(~head, "not a resume file"))
        .when(~text.rlike("(?s)^/[^/]*/"), "invalid record")
        .when(F.col("ended"), "record after the archive end")
        .when(~header & ~F.col("key").isin("slice", "archive_end"), "unknown record")
        .when(~header & (F.size("seen") < 5), "record before the whole header")
        .when(header & (F.array_contains("seen", F.col("key")) | F.col("pointed")), "repeated header record")
        .when((F.col("key") == "archive_uuid") & (value == ""), "empty uuid")
        .when((F.col("key") == "block_size_kib") & unsigned(value, 1, 65535).isNull(), "invalid block size")
        .when((F.col("key") == "sign_key_id") & ~((value == "") | is_lower_hex(value, 16)), "invalid key id")
        .when((F.col("key") == "plan_blake3") & ~((value == "") | is_lower_hex(value, 64)), "invalid plan hash")
        .when((F.col("key") == "slice") & ((F.size(point) != 3) | F.col("slice").isNull() | F.col("global_seq").isNull() | F.col("volume").isNull()), "invalid slice record")
        .when((F.col("key") == "archive_end") & F.col("global_seq").isNull(), "invalid archive end")
    )
    return rows.withColumn("error", error).select("name", "ord", F.when(F.col("ord") > 1, F.col("key")).alias("key"), _bytes(F.col("value")).alias("value"), "slice", "global_seq", "volume", F.octet_length("record").alias("length"), "error")


def encode_resume(first: str, header: dict, points: list[tuple[int, int, int]], archive_end: int | None = None) -> bytes:
    """A resume file; first is its opening record."""
    lines = [first.encode(), *(f"/{k}/".encode() + (v if isinstance(v := header[k], bytes) else str(v).encode()) for k in RESUME)]
    lines += [f"/slice/{s}/{g}/{v}".encode() for s, g, v in points]
    lines += [f"/archive_end/{archive_end}".encode()] if archive_end is not None else []
    return b"".join(x + b"\0\n" for x in lines)


class ResumeLog:
    """A resume file that grows: records are appended and synced; a failure ends the log, not the run.

    points are told when a slice starts and written once the frame that opens it is
    acknowledged.  ``reopen`` cuts off a record that a crash left torn.
    """

    def __init__(self, path: str, out, last: int | None = None):
        self.path, self.out, self.last, self.waiting, self.acked = path, out, last, [], None

    @classmethod
    def create(cls, path: str, opening: str, header: dict) -> ResumeLog:
        self = cls(path, open(path, "xb"))  # noqa: SIM115
        self.append(encode_resume(opening, header, []))
        return self

    @classmethod
    def reopen(cls, path: str, restart: tuple[int, int, int] | None = None) -> ResumeLog:
        out = open(path, "r+b")  # noqa: SIM115
        end = out.read().rfind(b"\0\n")
        out.truncate(end + 2 if end >= 0 else 0)
        out.seek(0, os.SEEK_END)
        self = cls(path, out)
        if restart:
            self.last = restart[0]
            self.append(f"/slice/{restart[0]}/{restart[1]}/{restart[2]}".encode() + b"\0\n")
        return self

    def append(self, data: bytes) -> None:
        if self.out is None:
            return
        try:
            self.out.write(data)
            self.out.flush()
            os.fsync(self.out.fileno())
        except OSError as e:
            warnings.warn(f"{self.path}: later slices are not recorded ({e.strerror})", stacklevel=2)
            self.out = None

    def slice_started(self, slice_: int, global_seq: int) -> None:
        self.waiting.append((slice_, global_seq))

    def frame_acked(self, global_seq: int, volume: int) -> None:
        self.acked = global_seq
        while self.waiting and self.waiting[0][1] <= global_seq:
            slice_, first = self.waiting.pop(0)
            if self.last is None or slice_ > self.last:
                self.append(f"/slice/{slice_}/{first}/{volume}".encode() + b"\0\n")
                self.last = slice_

    def completed(self) -> None:
        self.append(f"/archive_end/{self.acked}".encode() + b"\0\n")

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Record ledgers, tab-separated with a header line: the rows of event ``record`` as (volume, file, global, bytes).

    The volume is the number in the name of the folder that holds the file.
    """
    rows = spark.read.csv(path, sep="\t", header=True).where("event = 'record'")
    volume = F.regexp_extract(F.col("_metadata.file_path"), "volume-([0-9]+)/", 1).try_cast("long")
    return rows.select(volume.alias("volume"), *(F.col(c).cast("long").alias(c) for c in ("file", "global", "bytes")))

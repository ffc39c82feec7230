"""Packing entries into slices, cutting streams into frames, frames onto volumes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from reelframe.operators.folds import ordered_fold
from reelframe.operators.scratch import Scratch
from reelframe.sources.frames import HEADER

U64_MAX = 2**64 - 1
PLACE = T.StructType([T.StructField("slice", T.LongType()), T.StructField("file_num", T.LongType())])


class Packer:
    """Greedy slices of whole entries, in order.

    An entry that would take a slice beyond one and a half times its size goes to the
    next one; a slice that has reached its size, or the limit of what its entries
    take in memory, is closed.  An entry larger than that stands alone.
    """

    def __init__(self, slice_size: int, memory: int | None = None):
        self.size, self.most = slice_size, min(U64_MAX, slice_size + slice_size // 2)
        self.memory, self.slice, self.entries, self.bytes, self.held = memory, 0, 0, 0, 0

    def close(self) -> None:
        if self.entries:
            self.slice, self.entries, self.bytes, self.held = self.slice + 1, 0, 0, 0

    def place(self, size: int, cost: int = 0) -> tuple[int, int]:
        if self.bytes + size > self.most:
            self.close()
        at = (self.slice, self.entries)
        self.entries, self.bytes, self.held = self.entries + 1, self.bytes + size, self.held + cost
        if self.bytes >= self.size or self.memory is not None and self.held >= self.memory:
            self.close()
        return at


#: Entries of a range; one range is packed by one task.
RANGE = 1 << 20
FAR = 1 << 62


class Range:
    """Sizes and costs in order, as running sums: where a slice ends follows from sums alone."""

    def __init__(self, sizes: np.ndarray, costs: np.ndarray, slice_size: int, memory: int | None):
        self.bytes, self.held = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (sizes, costs))
        self.size, self.most, self.memory = min(slice_size, FAR), min(slice_size + slice_size // 2, FAR), memory
        self.n = len(sizes)

    def ends(self, start: np.ndarray, bytes_: np.ndarray, held: np.ndarray, empty: bool) -> np.ndarray:
        """The first entry after the slice that is open at ``start`` with so much in it; n + 1 if it stays open."""
        full = np.searchsorted(self.bytes, self.bytes[start] + self.size - bytes_, "left")
        over = np.searchsorted(self.bytes, self.bytes[start] + self.most - bytes_, "right")
        # what takes it to its size may take it too far, and then stands in the next one
        end = np.where((full == over) & (over <= self.n) & ((over - 1 > start) | (not empty)), over - 1, full)
        if self.memory is None:
            return end
        spent = np.searchsorted(self.held, self.held[start] + self.memory - held, "left")
        return np.where(spent < full, spent, end)

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        """For a slice begun at each entry: slices closed up to the range's end, where the last one begins."""
        at = np.arange(self.n + 1)
        step = self.ends(at, 0, 0, True)
        last, closed = np.where(step > self.n, at, step), (step <= self.n).astype(np.int64)
        last[self.n], closed[self.n] = self.n, 0
        for _ in range(self.n.bit_length() + 1):
            if (last[last] == last).all():
                break
            closed, last = closed + closed[last], last[last]
        return closed, last

    def places(self, slice_: int, entries: int, bytes_: int, held: int) -> tuple[np.ndarray, np.ndarray]:
        """Slice and file number of each entry, given what is open before the first."""
        starts, at = [0], 0
        if entries:
            at = int(self.ends(np.array([0]), bytes_, held, False)[0])
            starts.append(at)
        while at < self.n:
            at = int(self.ends(np.array([at]), 0, 0, True)[0])
            starts.append(at)
        starts = np.array([x for x in starts if x <= self.n])
        nth = np.searchsorted(starts, np.arange(self.n), "right") - 1
        number = np.arange(self.n) - starts[nth] + np.where(nth == 0, entries, 0)
        return slice_ + nth, number


def pack_slices(entries: DataFrame, slice_size: int, *, keys: list[str] | None = None, order: list[str], size: str = "size", memory: int | None = None, cost: str | None = None) -> DataFrame:
    """Adds slice and file_num.  keys: what makes an archive; none if all is one.

    Archives are packed side by side, each as a fold.  A single one is cut into ranges
    of its order (the first of ``order`` is a long) of about ``RANGE`` entries: each
    tells what would become of a slice that is open at its start, for every amount
    it may hold; these summaries are run through in order, and then all ranges place
    their entries at once.  A summary has as many numbers as a slice has entries.
    """
    if keys:
        inputs = [size, *([cost] if cost else [])]
        step = lambda p, row: p.place(int(row[size] or 0), int(row[cost] or 0) if cost else 0)
        return ordered_fold(entries, keys, order, lambda _: Packer(slice_size, memory), step, PLACE, inputs)
    names = entries.columns
    own = entries.withColumns({"__size": F.coalesce(F.col(size).cast("long"), F.lit(0)), "__cost": F.coalesce(F.col(cost).cast("long"), F.lit(0)) if cost else F.lit(0).cast("long")})
    schema = T.StructType([*entries.schema.fields, *PLACE.fields])

    def ranged(b: pa.Table) -> Range:
        return Range(b.column("__size").to_numpy(), b.column("__cost").to_numpy(), slice_size, memory)

    def place(table: pa.Table) -> Iterator[pa.RecordBatch]:
        state = [table.column(c)[0].as_py() for c in STATE]
        slices, numbers = ranged(table).places(*state)
        kept = table.select(names).append_column("slice", pa.array(slices, pa.int64())).append_column("file_num", pa.array(numbers, pa.int64()))
        yield from kept.to_batches()

    cut = bounds_of(own, F.col(order[0]), RANGE)
    if not cut:
        zero = own.withColumns({c: F.lit(0).cast("long") for c in STATE})
        return _by_range(zero.withColumn("__part", F.lit(0)).repartition(1), order, place, schema)

    def summary(table: pa.Table) -> Iterator[pa.RecordBatch]:
        r = ranged(table)
        closed, last = r.chains()
        # a slice that is open at the start ends here at the latest
        reach = min(r.n, int(np.searchsorted(r.bytes, r.most, "right")))
        of = last[: reach + 1]
        arrays = [r.bytes[: reach + 1], r.held[: reach + 1], closed[: reach + 1], r.n - of, r.bytes[-1] - r.bytes[of], r.held[-1] - r.held[of]]
        whole = [r.n, int(r.bytes[-1]), int(r.held[-1])]
        yield pa.RecordBatch.from_arrays([pa.array([table.column("__part")[0].as_py()], pa.int32()), *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in arrays), *(pa.array([w], pa.int64()) for w in whole)], names=SUMMARY)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [0, 0, 0, 0]
        for b in batches:
            for row in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([row["__part"]], pa.int32()), *(pa.array([x], pa.int64()) for x in state)], names=["__part", *STATE])
                state = _after(row, state, slice_size, memory)

    scratch = Scratch(entries.sparkSession, "packing")
    parted = own.withColumn("__part", part_of(F.col(order[0]), cut))
    kinds = T.StructType([T.StructField("__part", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in SUMMARY[1:7]), *(T.StructField(c, T.LongType()) for c in SUMMARY[7:])])
    told = _by_range(parted.select(*order, "__part", "__size", "__cost").repartition(len(cut) + 1, "__part"), order, summary, kinds)
    states = told.repartition(1).sortWithinPartitions("__part").mapInArrow(compose, T.StructType([kinds["__part"], *(T.StructField(c, T.LongType()) for c in STATE)]))
    states = scratch.keep(states, "states")  # a row for each range
    return _by_range(parted.join(states, "__part").repartition(len(cut) + 1, "__part"), order, place, schema)


STATE = ["__slice", "__entries", "__bytes", "__held"]
SUMMARY = ["__part", "bytes", "held", "closed", "open_entries", "open_bytes", "open_held", "n", "all_bytes", "all_held"]


def _after(row: dict, state: list[int], slice_size: int, memory: int | None) -> list[int]:
    """What is open after a range, from its summary and what was open before."""
    slice_, entries, bytes_, held = state
    r = Range(np.zeros(0, np.int64), np.zeros(0, np.int64), slice_size, memory)
    at = {c: np.frombuffer(row[c], np.int64) for c in SUMMARY[1:7]}
    r.bytes, r.held, r.n = at["bytes"], at["held"], len(at["bytes"]) - 1
    end = int(r.ends(np.array([0]), bytes_, held, False)[0]) if entries else 0
    if end > r.n:  # the open slice takes the whole range
        return [slice_, entries + row["n"], bytes_ + row["all_bytes"], held + row["all_held"]]
    return [slice_ + bool(entries) + int(at["closed"][end]), *(int(at[c][end]) for c in ("open_entries", "open_bytes", "open_held"))]


def _by_range(rows: DataFrame, order: list[str], work, schema: T.StructType) -> DataFrame:
    """``work`` over each range as one table, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            keys = b.column("__part").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if lo == hi:
                    continue
                if keys[lo] != now and held:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                now = keys[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from work(pa.Table.from_batches(held))

    return rows.sortWithinPartitions("__part", *order).mapInArrow(run, schema)


def bounds_of(rows: DataFrame, lead: Column, most: int) -> list[int]:
    """Values of ``lead`` that cut the rows into ranges of about ``most``; none if all fit in one."""
    n = rows.count()
    parts = -(-n // most)
    if parts < 2:
        return []
    at = rows.select(lead.cast("double").alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 1 / (4 * parts))
    return sorted({int(x) for x in at})


def part_of(lead: Column, cut: list[int]) -> Column:
    """The range of a value: how many of the bounds are not above it."""
    cuts = F.array(*(F.lit(c).cast("long") for c in cut)) if cut else F.array().cast("array<bigint>")
    return F.size(F.filter(cuts, lambda c: c <= lead))


def slice_summary(placed: DataFrame, size: str = "size") -> DataFrame:
    return placed.groupBy("slice").agg(F.count("*").alias("entries"), F.sum(size).cast("long").alias("bytes"))


def slice_stats(summary: DataFrame) -> DataFrame:
    """Smallest, mean, largest slice and population deviation, cut to whole bytes."""
    return summary.agg(F.min("bytes").alias("min_bytes"), F.floor(F.avg("bytes")).alias("avg_bytes"), F.max("bytes").alias("max_bytes"), F.floor(F.stddev_pop("bytes")).alias("stddev_bytes"))


def cut_frames(streams: DataFrame, block: int, data: str = "data") -> DataFrame:
    """One row per frame of each stream: channel_frame_seq_num, frame_payload_size, is_end, payload.

    Frames are full but for the last, which ends the channel; an empty stream has none.
    """
    capacity = block - HEADER
    length = F.octet_length(data).cast("long")
    many = F.ceil(length / capacity).cast("long")
    at = lambda i: i * capacity
    # the parts are made first, so that a stream's bytes are not copied for each of them
    part = lambda i: F.struct(i.alias("channel_frame_seq_num"), F.least(F.lit(capacity).cast("long"), length - at(i)).alias("frame_payload_size"), (at(i) + capacity >= length).alias("is_end"), F.substring(F.col(data).cast("binary"), (at(i) + 1).cast("int"), F.lit(capacity)).alias("payload"))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), many - 1), part)
    kept = [c for c in streams.columns if c != data]
    return streams.where(length > 0).select(*kept, F.explode(parts).alias("__part")).select(*kept, "__part.*")


def running(rows: DataFrame, order: list[Column], weight: Column, name: str, most: int = 1 << 16) -> DataFrame:
    """The sum of ``weight`` over all rows before each one, in an order, by ranges.

    Rows are dealt into ranges of the first of ``order`` (a long), of about ``most`` rows by
    its quantiles; each range is summed by itself and only the ranges' totals meet in one place.
    """
    own = rows.withColumn("__part", part_of(order[0], bounds_of(rows, order[0], most)))
    totals = own.groupBy("__part").agg(F.sum(weight).alias("__sum"))
    before = totals.select("__part", (F.sum("__sum").over(W.orderBy("__part")) - F.col("__sum")).alias("__before"))  # a row for each range
    inside = F.sum(weight).over(W.partitionBy("__part").orderBy(*order)) - weight
    return own.withColumn(name, inside).join(before, "__part").withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__part", "__before")


def number_streams(streams: DataFrame, block: int, order: list[str], data: str = "data", start: int = 0) -> DataFrame:
    """Frames of streams with global_frame_seq_num: streams are counted, numbered as narrow rows, then cut.

    ``order`` tells streams apart; the first of it is a long.
    """
    many = F.ceil(F.octet_length(data).cast("long") / (block - HEADER)).cast("long")
    scratch = Scratch(streams.sparkSession, "streams")
    counts = scratch.keep(streams.select(*order, many.alias("__many")).where("__many > 0"), "counts")
    first = running(counts, [F.col(c) for c in order], F.col("__many"), "__first").drop("__many")
    cut = cut_frames(streams.join(first, order), block, data)
    return cut.withColumn("global_frame_seq_num", F.col("__first") + F.col("channel_frame_seq_num") + start).drop("__first")


#: Bytes of a file that a task reads, and of the frames that it holds at once; most tasks of a job.
PIECE, HELD, TASKS = 64 << 20, 16 << 20, 1 << 16


def number_files(files: DataFrame, block: int, order: list[str], start: int = 0) -> tuple[DataFrame, DataFrame]:
    """What ``number_streams`` gives, of streams in files of any length; and (last), each stream's last global number.

    files: name and size beside the columns of a stream, a row each.  Files are read where
    executors and driver reach them by the same path, a range a task, a few frames at a
    time.  One that has become shorter is an error, of a longer one the rest is left.
    """
    capacity, kept = block - HEADER, [c for c in files.columns if c not in ("name", "size")]
    per, step = max(1, PIECE // capacity), max(1, HELD // block)
    scratch = Scratch(files.sparkSession, "files")
    counts = scratch.keep(files.withColumn("__many", F.expr(f"(size + {capacity - 1}) div {capacity}")).where("__many > 0"), "counts")
    first = scratch.keep(running(counts, [F.col(c) for c in order], F.col("__many"), "__first"), "first")
    # a number of tasks that is asked for, as the rows are too narrow to tell how much is read for them
    tasks = first.agg(F.sum(F.ceil(F.col("__many") / per))).first()[0] or 1
    pieces = first.withColumn("__at", F.explode(F.expr(f"sequence(0L, __many - 1, {per}L)"))).repartition(min(tasks, TASKS), *order, "__at")
    schema = T.StructType([*(files.schema[c] for c in kept), *(T.StructField(c, t) for c, t in CUT.items())])
    arrow = {f.name: to_arrow_type(f.dataType) for f in schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            with open(row["name"], "rb") as f:
                f.seek(row["__at"] * capacity)
                end = min(row["__at"] + per, row["__many"])
                for lo in range(row["__at"], end, step):
                    numbers = range(lo, min(lo + step, end))
                    sizes = [min(capacity, row["size"] - i * capacity) for i in numbers]
                    parts = [f.read(n) for n in sizes]
                    if [len(p) for p in parts] != sizes:
                        raise OSError(f"{row['name']} is shorter than {row['size']} bytes")
                    ends, seqs = [i + 1 == row["__many"] for i in numbers], [start + row["__first"] + i for i in numbers]
                    values = [*([row[c]] * len(parts) for c in kept), list(numbers), sizes, ends, parts, seqs]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, arrow.values(), strict=True)], names=list(arrow))

    return pieces.mapInArrow(run, schema), first.select((F.col("__first") + F.col("__many") - 1 + start).alias("last"))


CUT = {"channel_frame_seq_num": T.LongType(), "frame_payload_size": T.LongType(), "is_end": T.BooleanType(), "payload": T.BinaryType(), "global_frame_seq_num": T.LongType()}


def number_frames(frames: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """Adds global_frame_seq_num, gapless in the order; the first of ``order`` is a long."""
    out = running(frames, [F.col(c) for c in order], F.lit(1), "global_frame_seq_num")
    return out.withColumn("global_frame_seq_num", F.col("global_frame_seq_num") + start)


def volume_of(seq: Column, record: int, capacity: int, taken: int = 0) -> Column:
    """The volume of a record, when a record that would exceed the capacity starts the next.

    taken: bytes that the first volume has lost already.
    """
    first, each = max(0, capacity - taken) // record, capacity // record
    if not each:
        raise ValueError("a volume holds no record")
    return F.when(seq < first, 0).otherwise(F.floor((seq - first) / each) + 1).cast("long")

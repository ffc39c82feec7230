"""The pull protocol as a streaming source: frames by global number, a window at a time.

A spool volume is the producer.  An offset is the next global number that is not yet
acknowledged; a micro-batch asks for at most ``windows`` times ``window`` frames after it, and
its commit is the acknowledgement.  The source replays any range that was not committed, so
a query that stops goes on where it was.

A micro-batch costs the same however few frames it has, so one window each is for volumes
that grow slowly; a long volume at rest is pulled many windows at a time.  They are dealt
to tasks of ``TASK`` bytes, which hold one frame each: the volume itself retains the rest.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from reelframe.sources.spool import block_size, spool_files

WINDOW = 256
WINDOWS = 1024  # of a micro-batch, for volumes at rest
TASK = 16 << 20  # bytes that one task reads


class Retention:
    """The frames not yet acknowledged, at most so many: the oldest goes when it is full."""

    def __init__(self, most: int = WINDOW):
        self.most, self.frames = most, OrderedDict()

    def add(self, seq: int, record: bytes) -> None:
        while len(self.frames) >= self.most:
            self.frames.popitem(last=False)
        self.frames[seq] = record

    def ack(self, seq: int) -> None:
        self.frames.pop(seq, None)

    def get(self, seq: int) -> bytes | None:
        return self.frames.get(seq)


@dataclass
class Span:
    path: str
    first: int  # record of the file
    seq: int
    count: int
    size: int


@dataclass
class Part(InputPartition):
    """Spans of one file or several, in order: what a task reads."""

    spans: list[Span]

    def __post_init__(self):
        self.value = None


class PullReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.window = options["path"], int(options.get("window", WINDOW))
        self.most = self.window * int(options.get("windows", 1))
        self.next = 0

    def files(self) -> list[tuple[str, int, int]]:
        """(path, records, record size), in order."""
        out, size = [], None
        for _, name, length in spool_files(self.root):
            path = os.path.join(self.root, name)
            if size is None:
                with open(path, "rb") as f:
                    size = block_size(f.read(512))
            if size:
                out.append((path, length // size, size))
        return out

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        """So far as the windows let it go beyond what was committed."""
        there = sum(n for _, n, _ in self.files())
        self.next = min(there, self.next + self.most)
        return {"next": self.next}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        self.next = max(self.next, end["next"])
        out, seq, left = [], 0, 0
        for path, n, size in self.files():
            lo, hi = max(start["next"], seq), min(end["next"], seq + n)
            while lo < hi:
                if left < size:
                    out.append(Part([]))
                    left = max(TASK, size)
                count = min(hi - lo, left // size)
                out[-1].spans.append(Span(path, lo - seq, lo, count, size))
                lo, left = lo + count, left - count * size
            seq += n
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        for s in part.spans:
            with open(s.path, "rb") as f:
                f.seek(s.first * s.size)
                for i in range(s.count):
                    yield s.seq + i, f.read(s.size)

    def commit(self, end: dict) -> None:
        self.next = max(self.next, end["next"])


class Pull(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pull"

    def schema(self) -> str:
        return "ord bigint, record binary"

    def streamReader(self, schema) -> PullReader:
        return PullReader(self.options)


def pull_stream(spark: SparkSession, path: str, window: int = WINDOW, windows: int = 1) -> DataFrame:
    """(ord, record) of a volume that may still grow, at most ``windows`` windows of ``window`` frames a micro-batch."""
    spark.dataSource.register(Pull)
    return spark.readStream.format("pull").option("window", window).option("windows", windows).load(path)

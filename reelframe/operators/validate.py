"""The frame validator: sequence, slice and channel rules over ordered frames.

Rules come in an order, and the first broken one is a frame's result.  What a frame
changes depends on how far it got, so one gap can fail every frame after it; that
cascade is part of the result.  One class serves batch folds and streams.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from reelframe.operators.folds import ordered_fold
from reelframe.sources.frames import ARCHIVE_END, CONTENT, METADATA

#: Accepted records that a replay can be held against.
HISTORY = 8192
MAGIC = "magic"
NEEDS = ["channel_type", "volume_block_size_kib", "archive_uuid", "archive_label", "global_frame_seq_num", "slice_seq_num", "channel_frame_seq_num", "is_end", "size_ok", "hash_ok", "padding_ok", "norm_hash", "header_error"]
RESULT = T.StructType([T.StructField("status", T.StringType()), T.StructField("message", T.StringType())])


class Broken(Exception):
    """A rule that a frame breaks."""


@dataclass
class Channel:
    """Where a channel stands in the current slice; following None: not known yet."""

    following: int | None = 0
    seen: bool = False
    ended: bool = False


@dataclass
class Validator:
    """State over the frames of one archive.

    mode: inspect judges every frame; restore lets metadata pass with a bad hash, as
    a warning, and stops at the first error; salvage checks frames by themselves and
    replays only.  seeded: the first frame may come from the middle of an archive.
    """

    mode: str = "inspect"
    seeded: bool = True
    expected: int = 0
    slice: int = 0
    block: int | None = None
    identity: tuple | None = None
    started: bool = False
    ended: bool = False
    stopped: bool = False
    fresh: bool = True
    framed: bool = False
    channels: dict = field(default_factory=dict)
    history: OrderedDict = field(default_factory=OrderedDict)
    replaying: int | None = None

    def connect(self) -> None:
        """A new connection may start a new replay; all else stays."""
        self.replaying = None

    def judge(self, frame: dict) -> tuple[str, str | None]:
        """(status, message): ok, replay, warning, error, or unread after a restore's first error.

        A record known to be without magic, before the first that has it, is a prefix.
        """
        if self.stopped:
            return "unread", None
        if not self.framed:
            if not frame.get(MAGIC, True):
                return "prefix", None
            self.framed = True
        if frame.get("header_error"):
            return self.failed(f"header: {frame['header_error']}")
        if self.fresh:
            self.fresh = False
            if self.seeded and self.mode != "salvage":
                self.expected, self.slice = int(frame["global_frame_seq_num"]), int(frame["slice_seq_num"])
                self.channels = {c: Channel(None) for c in (CONTENT, METADATA)}
        try:
            replay = self.salvage(frame) if self.mode == "salvage" else self.whole(frame)
        except Broken as e:
            return self.failed(str(e))
        if replay:
            return "replay", None
        return ("ok", None) if frame["hash_ok"] else ("warning", "metadata hash mismatch")

    def failed(self, message: str) -> tuple[str, str]:
        self.stopped = self.mode == "restore"
        return "error", message

    def replayed(self, frame: dict) -> bool:
        """True for a repeat of an accepted record; repeats run on to the last one accepted."""
        seq = int(frame["global_frame_seq_num"])
        if seq >= self.expected:
            if self.replaying is not None:
                raise Broken("new frame before the replay is complete")
            return False
        if not frame["hash_ok"]:
            raise Broken("replay with a bad hash")
        if seq not in self.history:
            raise Broken("replay of a record that is not remembered")
        if self.history[seq] != frame["norm_hash"]:
            raise Broken("replay differs from the accepted record")
        if self.replaying not in (None, seq):
            raise Broken("replay out of order")
        self.replaying = seq + 1 if seq + 1 < self.expected else None
        return True

    def remember(self, frame: dict) -> None:
        if frame["hash_ok"]:
            self.history.setdefault(int(frame["global_frame_seq_num"]), frame["norm_hash"])
            while len(self.history) > HISTORY:
                self.history.popitem(last=False)

    def intact(self, frame: dict, any_hash: bool) -> None:
        for good, what in ((frame["size_ok"], "record size"), (frame["hash_ok"] or any_hash, "hash mismatch"), (frame["padding_ok"], "bytes in the padding")):
            if not good:
                raise Broken(what)

    def whole(self, frame: dict) -> bool:
        if self.replayed(frame):
            return True
        if self.ended:
            raise Broken("frame after the archive end")
        self.intact(frame, self.mode == "restore" and frame["channel_type"] == METADATA)
        self.same(frame)
        seq = int(frame["global_frame_seq_num"])
        if seq != self.expected:
            raise Broken(f"global number {seq}, expected {self.expected}")
        self.expected += 1
        if frame["channel_type"] == ARCHIVE_END:
            if self.started and not self.complete():
                raise Broken("archive end before the channels' ends")
            self.ended = True
        else:
            self.enter_slice(int(frame["slice_seq_num"]))
            self.advance(frame)
        self.remember(frame)
        return False

    def same(self, frame: dict) -> None:
        if self.block is None:
            self.block = frame["volume_block_size_kib"]
        elif self.block != frame["volume_block_size_kib"]:
            raise Broken("block size changed")
        own = (frame["archive_uuid"], bytes(frame["archive_label"] or b""))
        if self.identity is None:
            self.identity = own
        elif own != self.identity:
            raise Broken("archive uuid mismatch" if own[0] != self.identity[0] else "archive label mismatch")

    def complete(self) -> bool:
        return all(c.ended for c in self.channels.values() if c.seen)

    def enter_slice(self, number: int) -> None:
        if not self.started:
            if not self.seeded and number:
                raise Broken(f"first slice is {number}, not 0")
            self.slice, self.started = number, True
        if number == self.slice:
            return
        if number != self.slice + 1:
            raise Broken(f"slice {number} after {self.slice}")
        if not self.complete():
            raise Broken("new slice before the channels' ends")
        self.slice, self.channels = number, {}

    def advance(self, frame: dict) -> None:
        channel = self.channels.setdefault(frame["channel_type"], Channel())
        if channel.ended:
            raise Broken("frame after its channel's end")
        seq = int(frame["channel_frame_seq_num"])
        if channel.following is None:
            channel.following = seq
        if seq != channel.following:
            raise Broken(f"channel number {seq}, expected {channel.following}")
        channel.seen, channel.following, channel.ended = True, seq + 1, bool(frame["is_end"])

    def salvage(self, frame: dict) -> bool:
        self.intact(frame, False)
        own = (frame["archive_uuid"],)
        if self.identity != own:
            self.identity, self.expected, self.replaying = own, 0, None
            self.history.clear()
        if self.replayed(frame):
            return True
        self.remember(frame)
        self.expected = int(frame["global_frame_seq_num"]) + 1
        return False


def validate_frames(frames: DataFrame, keys: list[str], order: list[str], mode: str = "inspect", seeded: bool = True) -> DataFrame:
    """Adds status and message to frames with headers and integrity columns.

    Payloads are not needed: drop the record column first, so the fold moves headers only.
    """
    inputs = [*NEEDS, *([MAGIC] if MAGIC in frames.columns else [])]
    return ordered_fold(frames, keys, order, lambda _: Validator(mode, seeded), lambda v, row: v.judge(row), RESULT, inputs)

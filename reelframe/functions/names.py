"""Names and fixed texts: spool files, flags, kinds, owners, listing lines."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format: channels, message types and file kinds by number.
CHANNELS = {1: "CH_CONTENT", 2: "CH_METADATA", 255: "ARCHIVE_END"}
CHANNEL_SHORT = {1: "content ", 2: "metadata", 255: "arch_end"}
MESSAGES = {1: "NEXT_FRAME", 2: "FRAME_RECORD", 3: "TAPE_EOF", 4: "ERROR", 5: "ACK_FRAME", 6: "AUTH_CHALLENGE", 7: "AUTH_RESPONSE"}
KINDS = {0o100000: "f", 0o040000: "d", 0o120000: "l", 0o020000: "c", 0o060000: "b", 0o010000: "p", 0o140000: "s"}
#: Code points that reorder or hide text (first, last).
HIDING = [(0xAD, 0xAD), (0x61C, 0x61C), (0x180E, 0x180E), (0x200B, 0x200F), (0x2028, 0x202E), (0x2060, 0x206F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB), (0xE0000, 0xE007F)]


def _named(code: Column, names: dict[int, str], other: Column) -> Column:
    found = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.element_at(found, code.cast("int")), other)


def channel_name(code: Column) -> Column:
    return _named(code, CHANNELS, F.lit("unknown"))


def channel_short(code: Column) -> Column:
    return _named(code, CHANNEL_SHORT, F.lit("?"))


def message_name(code: Column) -> Column:
    return _named(code, MESSAGES, F.format_string("UNKNOWN(%d)", code))


def flags_text(end: Column, clean_end: Column, signed: Column) -> Column:
    """E for END, C for CLEAN_END, ! for SIGNED; a dot for none."""
    marks = F.concat(*(F.when(c, m).otherwise("") for c, m in ((end, "E"), (clean_end, "C"), (signed, "!"))))
    return F.when(marks == "", ".").otherwise(marks)


def spool_number(name: Column) -> Column:
    """The number of a spool file name, null for any other name."""
    return F.when(name.rlike(r"(?i)^NT[0-9]{1,6}\.NTS$"), F.regexp_extract(name, "([0-9]+)", 1)).cast("long")


def spool_name(n: Column, suffix: str = "NTS") -> Column:
    return F.format_string(f"NT%06d.{suffix}", n)


def is_spool_temporary(name: Column) -> Column:
    return name.rlike(r"(?i)^NT[0-9]{0,6}\.TMP$")


def slice_file_name(prefix: Column, n: Column) -> Column:
    return F.concat(prefix, F.format_string("%06d.pax", n))


def is_lower_hex(text: Column, length: int) -> Column:
    return text.rlike(f"^[0-9a-f]{{{length}}}$")


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def kind_of_mode(mode: Column) -> Column:
    """The kind letter for the type bits of a file mode, ? for none."""
    return _named(mode.bitwiseAND(F.lit(0o170000)), KINDS, F.lit("?"))


def disk_bytes(blocks: Column) -> Column:
    return F.greatest(F.lit(0), blocks) * 512


def apparent_bytes(mode: Column, length: Column) -> Column:
    """Files and symbolic links have a size; all else is 0."""
    return F.when(kind_of_mode(mode).isin("f", "l"), F.greatest(F.lit(0), length)).otherwise(0)


def owner(name: Column, number: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), number.cast("string"))


def minute(seconds: Column, zone: str = "UTC") -> Column:
    """Epoch seconds as YYYY-MM-DD HH:MM in a zone."""
    local = F.from_utc_timestamp(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), zone)
    return F.date_format(local, "yyyy-MM-dd HH:mm")


def listing_line(slice_: Column, kind: Column, length: Column, when: Column, user: Column, group: Column, path: Column) -> Column:
    return F.format_string("%6d %s %14d %s %s/%s %s", slice_, kind, length, when, user, group, path)


def _shown(ch: str) -> bool:
    c = ord(ch)
    return c >= 0xA0 and not any(a <= c <= b for a, b in HIDING)


def escape_bytes(data: bytes) -> str:
    """For display: printable ASCII and harmless UTF-8 as they are, a backslash twice, other bytes as \\xNN."""
    out = []
    # undecodable bytes become lone surrogates, which carry the byte
    for ch in data.decode("utf-8", "surrogateescape"):
        if ch == "\\":
            out.append("\\\\")
        elif " " <= ch <= "~" or _shown(ch) and not "\udc80" <= ch <= "\udcff":
            out.append(ch)
        else:
            out += [f"\\x{b:02x}" for b in ch.encode("utf-8", "surrogateescape")]
    return "".join(out)


@F.pandas_udf(T.StringType())
def escape_display(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else escape_bytes(bytes(b)))


def new_uuid() -> Column:
    """A random UUID, version 4, for each row."""
    return F.uuid()


def source_spec(argument: str) -> tuple[str, str]:
    """(path to open, prefix inside the archive) of a source argument."""
    clean = re.sub(r"(?<=.)/+$", "", argument)
    return os.path.normpath(os.path.abspath(clean)), clean.removeprefix("/")


def archive_path(spec: tuple[str, str], path: str) -> str:
    """A path below a source as it is named in the archive."""
    inside = os.path.relpath(os.path.normpath(os.path.abspath(path)), spec[0])
    return spec[1] if inside == "." else f"{spec[1]}/{inside}" if spec[1] else inside


def media_address(text: str) -> dict:
    """A locator: ``host:port``, ``[v6]:port`` or ``unix:path``."""
    if text.startswith("unix:"):
        if len(text) == 5:
            raise ValueError("empty socket path")
        return {"kind": "unix", "path": text[5:]}
    m = re.fullmatch(r"(?:\[([^\]]+)\]|([^:\[\]]*)):([0-9]{1,5})", text)
    if not m or not 1 <= int(m[3]) <= 65535:
        raise ValueError(f"not an address: {text!r}")
    return {"kind": "tcp", "host": m[1] or m[2], "port": int(m[3])}

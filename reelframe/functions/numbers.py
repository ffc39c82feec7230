"""Numbers: unsigned 64-bit values, parsing with ranges, sizes for people.

All are column expressions.  Unsigned 64-bit values are decimal(20,0); what does not
parse, or lies outside the range, is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = "decimal(20,0)"
U64_MAX = 2**64 - 1
I64_MAX = 2**63 - 1


def big(n: int) -> Column:
    """A literal of any unsigned 64-bit value."""
    return F.lit(str(n)).cast(U64)


def little_endian(data: Column, offset: int, width: int) -> Column:
    """The unsigned value of ``width`` bytes at ``offset`` (from 0), least byte first."""
    bytes_ = [F.hex(F.substring(data, offset + i + 1, 1)) for i in reversed(range(width))]
    return F.conv(F.concat(*bytes_), 16, 10).cast(U64)


def little_endian_bytes(n: Column, width: int) -> Column:
    """The inverse of little_endian for values below 2 ** 63."""
    digits = F.lpad(F.hex(n.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width)))))


def unsigned(text: Column, least: int = 0, most: int = U64_MAX) -> Column:
    """Digits alone: no sign, blank or suffix."""
    core = F.regexp_replace(text, "^0+(?=[0-9])", "")
    value = F.when(text.rlike("^[0-9]+$") & (F.length(core) <= 20), core).try_cast(U64)
    return F.when(value.between(big(least), big(most)), value)


def signed(text: Column) -> Column:
    """Digits with at most a leading minus, within 64 bits."""
    return F.when(text.rlike("^-?[0-9]+$"), text).try_cast("bigint")


def size(text: Column, most: int = U64_MAX) -> Column:
    """A positive number of bytes with an optional K, M, G or T (powers of 1024)."""
    power = F.instr(F.lit("KMGT"), F.upper(F.regexp_extract(text, "([kKmMgGtT])$", 1)))
    power = F.when(text.rlike("[kKmMgGtT]$"), power).otherwise(0)
    wide = "decimal(38,0)"
    scale = F.pow(F.lit(1024.0), power).cast("decimal(14,0)")
    whole = unsigned(F.regexp_extract(text, "^([0-9]*)[kKmMgGtT]?$", 1), 1) * scale
    return F.when(whole <= F.lit(str(most)).cast(wide), whole.cast(U64))


def humanize(n: Column) -> Column:
    """Powers of 1024 with a letter: one decimal below ten, whole numbers above."""
    v = n.cast("double")
    out = F.when(v < 1024, n.cast("string"))
    for i, letter in enumerate("KMGTPE", start=1):
        x = v / F.lit(1024.0**i)
        shown = F.when(x < 10, F.format_string("%.1f", F.bround(x, 1))).otherwise(F.format_string("%.0f", F.round(x)))
        own = F.concat(shown, F.lit(letter))
        out = out.when(x < 1024, own) if letter != "E" else out.otherwise(own)
    return out


def count_rate(n: Column) -> Column:
    """Powers of 1000: 999, 1.5k, 2.0M."""
    v = n.cast("double")
    return F.when(v < 1000, n.cast("string")).when(v < 1_000_000, F.format_string("%.1fk", v / 1000)).otherwise(F.format_string("%.1fM", v / 1_000_000))


def buffer_percent(used: Column, capacity: Column) -> Column:
    """Whole percent in use, 100 at most; 0 where there is no capacity."""
    whole = F.floor(F.least(F.lit(100.0), used * 100.0 / F.nullif(capacity, F.lit(0))))
    return F.when(capacity == 0, 0).otherwise(whole).cast("int")


def per_second(now: Column, before: Column, seconds: Column) -> Column:
    """A counter's rate; 0 where it fell or no time went by."""
    return F.when((seconds > 0) & (now >= before), (now - before) / seconds).otherwise(0.0)

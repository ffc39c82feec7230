"""Public keys: text files of a comment line and one base64 line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the key format.
COMMENT, ALGORITHM = "untrusted comment: ", b"Ed"


def parse_keys(texts: DataFrame, text: str = "value", keep: list[str] | None = None) -> DataFrame:
    """(comment, key_id, public_key, error) of key files, one a row, after the columns ``keep``."""
    t = F.col(text)
    lines = F.split(t, "\n")
    coded = F.get(lines, F.lit(1))
    raw = F.try_to_binary(coded, F.lit("base64"))
    trailing = F.exists(F.slice(lines, 3, F.greatest(F.lit(0), F.size(lines) - 2)), lambda x: F.regexp_replace(x, "\r", "") != "")
    error = (
        F.when(~t.startswith(COMMENT) | (F.size(lines) < 2), "no comment line")
        .when(coded == "", "no base64 line")
        .when(F.length(coded) > 2048, "base64 line too long")
        .when(trailing, "text after the base64 line")
        .when(F.coalesce(F.octet_length(raw) != 42, F.lit(True)), "invalid base64")
        .when(F.substring(raw, 1, 2) != F.lit(ALGORITHM), "unknown algorithm")
    )
    good = error.isNull()
    return texts.select(*(keep or []), F.when(good, F.substr(F.get(lines, F.lit(0)), F.lit(len(COMMENT) + 1))).alias("comment"), F.when(good, F.substring(raw, 3, 8)).alias("key_id"), F.when(good, F.substring(raw, 11, 32)).alias("public_key"), error.alias("error"))


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    return parse_keys(spark.read.text(path, wholetext=True))


def parse_secret_key(text: str) -> tuple[bytes, bytes]:
    """(key id, seed) of a secret key file without a passphrase; one with a passphrase is an error.

    The payload: algorithm, key derivation, rounds, salt, checksum, key id, seed and public key.
    """
    import base64
    import hashlib

    lines = text.split("\n")
    if not lines[0].startswith(COMMENT) or len(lines) < 2:
        raise ValueError("no comment line")
    raw = base64.b64decode(lines[1], validate=True)
    if len(raw) != 104 or raw[:2] != ALGORITHM or raw[2:4] != b"BK":
        raise ValueError("not a secret key")
    if int.from_bytes(raw[4:8], "big"):
        raise ValueError("the key has a passphrase")
    if hashlib.sha512(raw[40:]).digest()[:8] != raw[24:32]:
        raise ValueError("the key's checksum is wrong")
    return raw[32:40], raw[40:72]

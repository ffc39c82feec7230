import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelframe.functions import ed25519, names, numbers
from reelframe.functions.blake3 import blake3, blake3_many


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,value", [("0", 0), ("18446744073709551615", 2**64 - 1), ("007", 7), ("18446744073709551616", None), ("", None), ("-1", None), ("+1", None), (" 1", None), ("1x", None), ("9" * 30, None), (None, None)])
def test_unsigned(spark, text, value):
    assert one(spark, text, numbers.unsigned) == value


@pytest.mark.parametrize("text,value", [("4k", 4096), ("2T", 2 << 40), ("1", 1), ("0", None), ("K", None), ("-1K", None), ("1KB", None), ("16777216T", None), ("16777215T", 16777215 << 40)])
def test_size(spark, text, value):
    assert one(spark, text, numbers.size) == value


@pytest.mark.parametrize("text,value", [("-9223372036854775808", -(2**63)), ("9223372036854775807", 2**63 - 1), ("9223372036854775808", None), ("--1", None), ("", None)])
def test_signed(spark, text, value):
    assert one(spark, text, numbers.signed) == value


@pytest.mark.parametrize("n,text", [(0, "0"), (1023, "1023"), (1024, "1.0K"), (1280, "1.2K"), (10 * 1024, "10K"), (1024**2 - 1, "1024K"), (5 << 30, "5.0G"), (2**62, "4.0E")])
def test_humanize(spark, n, text):
    assert spark.range(1).select(numbers.humanize(F.lit(n)).alias("y")).first()["y"] == text


def test_little_endian_is_exact(spark):
    values = [0, 1, 2**63 + 5, 2**64 - 1]
    rows = spark.createDataFrame([(bytes(3) + v.to_bytes(8, "little"),) for v in values], "b binary")
    assert [int(r[0]) for r in rows.select(numbers.little_endian(F.col("b"), 3, 8)).collect()] == values
    back = spark.range(5).select(numbers.little_endian_bytes(F.col("id") * 1000, 8).alias("b")).collect()
    assert [int.from_bytes(r["b"], "little") for r in back] == [0, 1000, 2000, 3000, 4000]


def test_rates(spark):
    row = spark.range(1).select(numbers.count_rate(F.lit(999)), numbers.count_rate(F.lit(1500)), numbers.count_rate(F.lit(2_000_000)), numbers.buffer_percent(F.lit(5), F.lit(0)), numbers.buffer_percent(F.lit(9), F.lit(4)), numbers.per_second(F.lit(5), F.lit(9), F.lit(1)), numbers.per_second(F.lit(9), F.lit(5), F.lit(2))).first()
    assert list(row) == ["999", "1.5k", "2.0M", 0, 100, 0.0, 2.0]


# public test vectors: bytes 0, 1, 2, ... 250, 0, ...
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1023: "10108970eeda3eb932baac1428c7a2163b0e924c9a9e25b35bba72b28f70bd11",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
    31744: "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47",
    102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
}


def test_blake3_vectors(spark):
    data = [bytes(i % 251 for i in range(n)) for n in VECTORS]
    assert [d.hex() for d in blake3_many(data)] == list(VECTORS.values())
    rows = spark.createDataFrame([(1, b"\0"), (2, None)], "i int, b binary").select("i", blake3("b").alias("h")).orderBy("i").collect()
    assert bytes(rows[0]["h"]).hex() == VECTORS[1] and rows[1]["h"] is None


def test_ed25519_rfc_vectors():
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    public = ed25519.public_key(seed)
    assert public.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    signature = ed25519.sign(seed, b"")
    assert signature.hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46b")
    assert ed25519.verify(public, b"", signature)
    assert not ed25519.verify(public, b"x", signature)
    assert not ed25519.verify(public, b"", signature[:-1] + bytes([signature[-1] ^ 1]))
    assert not ed25519.verify(b"short", b"", signature)


@pytest.mark.parametrize(
    "raw,shown",
    [(b"plain", "plain"), (b"a\\b", "a\\\\b"), (b"\n\x7f", "\\x0a\\x7f"), (b"\xff", "\\xff"), ("é".encode(), "é"), (b"\xc0\x80", "\\xc0\\x80"), (b"\xed\xa0\x80", "\\xed\\xa0\\x80"), ("‮".encode(), "\\xe2\\x80\\xae"), ("​".encode(), "\\xe2\\x80\\x8b"), ("\U000e0001".encode(), "\\xf3\\xa0\\x80\\x81"), (b"\xc2\x85", "\\xc2\\x85"), ("😀".encode(), "😀")],
)
def test_escape(raw, shown):
    assert names.escape_bytes(raw) == shown


@given(st.binary(max_size=40))
def test_escape_is_printable(raw):
    shown = names.escape_bytes(raw)
    assert all(c >= " " and c != "\x7f" for c in shown)
    assert shown.encode("utf-8").decode("utf-8") == shown


def test_names(spark):
    rows = spark.createDataFrame([("NT000012.NTS",), ("nt12.nts",), ("NT1.TMP",), ("NT.NTS",), ("NT1234567.NTS",), ("NTabc.NTS",), ("RECOVERY.TAR",)], "n string")
    assert [r[0] for r in rows.select(names.spool_number(F.col("n"))).collect()] == [12, 12, None, None, None, None, None]
    row = spark.range(1).select(names.flags_text(F.lit(True), F.lit(True), F.lit(True)), names.flags_text(F.lit(False), F.lit(False), F.lit(False)), names.message_name(F.lit(9)), names.kind_of_mode(F.lit(0o100644)), names.apparent_bytes(F.lit(0o040755), F.lit(9)), names.minute(F.lit(3600), "Asia/Tokyo")).first()
    assert list(row) == ["EC!", ".", "UNKNOWN(9)", "f", 0, "1970-01-01 10:00"]


def test_addresses():
    assert names.media_address("host:80") == {"kind": "tcp", "host": "host", "port": 80}
    assert names.media_address("[::1]:9") == {"kind": "tcp", "host": "::1", "port": 9}
    assert names.media_address("unix:/s") == {"kind": "unix", "path": "/s"}
    for bad in ("host", "host:0", "host:70000", "unix:", "::1:9"):
        with pytest.raises(ValueError):
            names.media_address(bad)


def test_hash_stand_in_is_not_blake3():
    assert blake3_many([b"x"])[0] != hashlib.sha256(b"x").digest()

import pytest
from pyspark.sql import functions as F

from reelframe.operators import reports
from reelframe.sources import keys, records, spool, walk, wire
from tests.test_frames import archive


def plan(spark, raw):
    return records.parse_plan(records.split_records(spark.createDataFrame([("p", raw)], "name string, bytes binary"))).orderBy("ord").collect()


def line(*fields):
    return b"/" + b"/".join(f if isinstance(f, bytes) else str(f).encode() for f in fields) + b"\0\n"


def test_plan_paths_and_torn_end(spark):
    rows = plan(spark, line(0, 0, "f", 5, 7, 1, b"u", 2, b"g", b"a/\xff\nb") + b"/chdir/x")
    assert bytes(rows[0]["path"]) == b"a/\xff\nb" and rows[0]["error"] is None
    assert rows[1]["error"] == "unterminated record" and len(rows) == 2


@pytest.mark.parametrize("fields", [(0, 0, "f", 1, 2**63, 1, "", 1, "", "p"), (0, 0, "f", 1, 0, 2**32, "", 1, "", "p"), (0, 0, "f", 1, 0, 1, "", -1, "", "p"), (0, 0, "f", 2**64, 0, 1, "", 1, "", "p"), (0, 0, "x", 1, 0, 1, "", 1, "", "p"), (0, 1, "f", 1, 0, 1, "", 1, "", "p"), (1, 0, "f", 1, 0, 1, "", 1, "", "p"), (0, 0, "h", 1, 0, 1, "", 1, "", "p"), (0, 0, "f", 1, 0, 1, "", 1, "", ""), (0, 0, "f", 1, 0, 1, "", 1, "", "/p"), (0, 0, "f")])
def test_bad_plan_records(spark, fields):
    rows = plan(spark, line(*fields) + line(0, 0, "f", 1, 0, 1, "", 1, "", "p"))
    assert rows[0]["error"] and len(rows) == 1


def test_plan_contiguity(spark):
    e = lambda s, f: line(s, f, "f", 1, -(2**63), 1, "", 1, "", "p")
    assert [r["error"] for r in plan(spark, line("chdir", "d") + e(0, 0) + e(0, 1) + e(1, 0))] == [None] * 4
    for bad in (e(0, 2), e(1, 1), e(2, 0), line("chdir", "d")):
        assert plan(spark, e(0, 0) + bad)[1]["error"]
    assert plan(spark, b"") == []


HEAD = {"archive_uuid": "u-1", "block_size_kib": 4, "sign_key_id": "", "plan_blake3": "", "archive_name": b"a/ b\nc"}


def resume(spark, raw):
    return records.parse_resume(records.split_records(spark.createDataFrame([("r", raw)], "name string, bytes binary"))).orderBy("ord").collect()


def test_resume(spark):
    raw = records.encode_resume("/tool-resume/1", HEAD, [(1, 10, 1), (2, 20, 2), (3, 30, 3), (2, 25, 4)], None)
    rows = resume(spark, raw + b"/slice/4/torn")
    assert all(r["error"] is None for r in rows) and len(rows) == 10
    assert bytes(rows[5]["value"]) == b"a/ b\nc"
    points = spark.createDataFrame([(r["ord"], int(r["slice"]), int(r["global_seq"]), int(r["volume"])) for r in rows if r["slice"]], "ord long, slice long, global_seq long, volume long").withColumn("f", F.lit(1))
    left = reports.superseded(points, ["f"])
    assert [(r["slice"], r["volume"]) for r in left.orderBy("ord").collect()] == [(1, 1), (2, 4)]
    assert reports.point_errors(left, ["f"]).count() == 0
    assert reports.point_errors(points, ["f"]).count() == 1


@pytest.mark.parametrize("raw", [b"/other/1\0\n", records.encode_resume("/tool-resume/1", HEAD | {"block_size_kib": 0}, []), records.encode_resume("/tool-resume/1", HEAD | {"sign_key_id": "XYZ"}, []), records.encode_resume("/tool-resume/1", HEAD, [(0, 1, 1)]), records.encode_resume("/tool-resume/1", HEAD, []) + b"/archive_name/x\0\n", records.encode_resume("/tool-resume/1", HEAD, [], 5) + b"/slice/1/2/3\0\n", b"/tool-resume/1\0\n/slice/1/2/3\0\n", b"/tool-resume/1\0x"])
def test_bad_resume(spark, raw):
    assert any(r["error"] for r in resume(spark, raw))


def test_messages(spark):
    rows = spark.createDataFrame([(t, b"" if t < 7 else b"x" * 300) for t in range(1, 8)], "type int, payload binary")
    log = b"".join(bytes(r["message"]) for r in wire.encode_messages(rows).orderBy("type").collect())
    assert log[:9] == bytes([1]) + bytes(8)
    got = wire.decode_messages(spark.createDataFrame([("l", log)], "name string, bytes binary")).orderBy("ord").collect()
    assert [r["type"] for r in got] == list(range(1, 8)) and len(got[-1]["payload"]) == 300
    for bad in (b"\0" + bytes(8), b"\x08" + bytes(8), b"\x01\0", b"\x01" + b"\xff" * 8, b"\x01" + (5).to_bytes(8, "little") + b"abc"):
        assert list(wire.decode_log(bad))[0][4]
    assert list(wire.decode_log(b"")) == []


def test_keys(spark):
    import base64

    good = keys.COMMENT + "me\n" + base64.b64encode(b"Ed" + b"12345678" + bytes(32)).decode() + "\n"
    rows = keys.parse_keys(spark.createDataFrame([(good,), ("x\ny",), (keys.COMMENT + "c\n",), (keys.COMMENT + "c\nAAAA\n",), (good + "more",)], "value string")).collect()
    assert rows[0]["error"] is None and bytes(rows[0]["key_id"]) == b"12345678" and rows[0]["comment"] == "me"
    assert all(r["error"] for r in rows[1:])


def test_spool_round_trip(spark, tmp_path):
    media = archive(spark, [b"a" * 9000, b"b" * 20000])
    root = str(tmp_path / "v")
    spool.write_spool(media.withColumn("file_num", F.col("file_num") * 8 + 2), root)
    assert [(n, name) for n, name, _ in spool.spool_files(root)][:2] == [(2, "NT000002.NTS"), (10, "NT000010.NTS")]
    assert spool.spool_gaps(root)[0] == (2, 10)
    back = spool.read_spool(spark, root)
    assert back.select("record").exceptAll(media.select("record")).count() == 0 and back.count() == media.count()
    assert spool.read_spool(spark, root, "first_record").count() == len(spool.spool_files(root))
    with open(f"{root}/NT000010.NTS", "ab") as f:
        f.write(b"torn")
    assert spool.read_spool(spark, root).count() == media.count()
    assert spool.copy_spool(spark, root, str(tmp_path / "w"))["records"] == media.count()
    (tmp_path / "v" / "NT2.NTS").write_bytes(b"")
    with pytest.raises(ValueError):
        spool.spool_files(root)


def test_walk(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "b").write_bytes(b"12")
    (tmp_path / "d" / "x").write_bytes(b"123")
    (tmp_path / "a").hardlink_to(tmp_path / "b")
    (tmp_path / "l").symlink_to("b")
    rows = [(r["path"].decode().split("/")[-1], r["kind"], r["size"]) for r in walk.scan_tree(spark, [str(tmp_path)]).orderBy("ord").collect()]
    assert rows[1:] == [("a", "f", 2), ("b", "h", 0), ("d", "d", 0), ("l", "l", 1), ("x", "f", 3)]


def test_records_by_ranges(spark, tmp_path):
    """Files read by ranges of a few bytes give what whole files give."""
    whole = b"".join(line(0, i, "f", i, 0, 1, "u", 1, "g", b"p%d\n\xff" % i) for i in range(40))
    tails = [b"", b"/0/40", b"/0/40\0", b"/0/40\0x" + whole, b"\0\0\n" + whole, b"\0\n\0\n" + whole, b"/a\0\0", b"\0", b"\0x", b"/a\n\0\n/b\0\0\n"]
    files = {f"f{i}": whole + t for i, t in enumerate(tails)} | {f"g{i}": t for i, t in enumerate(tails)} | {"mark": b"\xef\xbb\xbf" + whole, "torn-mark": b"\xef\xbb\xbf" + whole + b"/0"}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    want = records.split_records(spark.createDataFrame([(n, bytearray(r)) for n, r in files.items()], "name string, bytes binary")).collect()
    small = {"spark.sql.files.maxPartitionBytes": "61", "spark.sql.files.openCostInBytes": "1"}
    for settings in ({}, small):
        for k, v in settings.items():
            spark.conf.set(k, v)
        try:
            got = records.read_records(spark, str(tmp_path)).collect()
        finally:
            for k in settings:
                spark.conf.unset(k)
        plain = lambda rows: sorted((r["name"].split("/")[-1], r["ord"], r["state"], bytes(r["record"])) for r in rows)
        assert plain(got) == plain(want)


def test_records_of_a_stream(spark):
    raw = line(0, 0, "f", 1, 0, 1, "", 1, "", "p") + line(0, 1, "f", 1, 0, 1, "", 1, "", "q")
    for tail in (b"", b"/0", b"/0\0", b"\0x", b"\0\0\n"):
        parts = spark.createDataFrame([(i, bytearray((raw + tail)[i : i + 1])) for i in range(len(raw + tail))], "o long, d binary")
        got = records.split_stream(parts, "o", "d", "s").orderBy("ord").collect()
        want = records.split_records(spark.createDataFrame([("s", bytearray(raw + tail))], "name string, bytes binary")).orderBy("ord").collect()
        assert got == want


@pytest.mark.parametrize("at", [0, 2, 3, 4, 11])
def test_plan_spans(spark, monkeypatch, at):
    """An error, and an entry that does not follow, next to and away from the ends of spans."""
    e = lambda s, f: line(s, f, "f", 1, 0, 1, "", 1, "", "p")
    rows = [line("chdir", "d"), *(e(i // 5, i % 5) for i in range(11))]
    monkeypatch.setattr(records, "SPAN", 4)
    got = plan(spark, b"".join(rows))
    assert len(got) == 12 and not any(r["error"] for r in got)
    for bad in (e(9, 9), b"x\0\n"):
        got = plan(spark, b"".join(rows[: at + 1] + [bad] + rows[at + 1 :]))
        assert [r["error"] is None for r in got] == [True] * (at + 1) + [False]

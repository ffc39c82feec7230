import base64
import hashlib
import io
import tarfile

import pytest

from reelframe.functions import ed25519
from reelframe.operators import pax
from reelframe.plans import commands
from reelframe.sources import keys, records, spool

UUID = "00000000-0000-4000-8000-000000000123"


def test_raw_store_inspect_and_extract(spark, tmp_path):
    data = bytes((i * 29 + 7) % 251 for i in range(3 * 3584 + 100))
    a = commands.Archive(UUID, b"raw", 4096)
    assert commands.raw_store(spark, data, a, str(tmp_path / "v")) == 5
    _, summary, issues = commands.inspect(spark, [str(tmp_path / "v")])
    s = summary.first()
    assert s["complete"] and s["content_frames"] == 4 and s["payload_bytes"] == len(data) and issues.count() == 0
    commands.extract(spark, [str(tmp_path / "v")], str(tmp_path / "out"))
    assert (tmp_path / "out").read_bytes() == data
    raw = (tmp_path / "v" / "NT000001.NTS").read_bytes()
    (tmp_path / "v" / "NT000001.NTS").write_bytes(raw[:5000] + bytes([raw[5000] ^ 1]) + raw[5001:])
    report = commands.extract(spark, [str(tmp_path / "v")], str(tmp_path / "out"), salvage=True)
    assert (tmp_path / "out").read_bytes() == data[:3584] + data[2 * 3584 :]
    assert [r["status"] for r in report.orderBy("rec_idx").collect()] == ["ok", "error", "ok", "ok", "ok"]


def test_plan_catalog_volumes_and_resume(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for i in range(5):
        (tmp_path / "t" / f"f{i}").write_bytes(bytes([i]) * 3000)
    plan = commands.plan_tree(spark, [str(tmp_path / "t")], slice_size=6000).cache()
    assert commands.write_plan(plan, str(tmp_path / "plan")) == 6
    again = records.parse_plan(records.read_records(spark, str(tmp_path / "plan")))
    assert again.where("error IS NOT NULL").count() == 0 and again.agg({"slice": "max"}).first()[0] == plan.agg({"slice": "max"}).first()[0]
    assert len(commands.plan_hash(str(tmp_path / "plan"))) == 64
    seed = bytes(range(32))
    a = commands.Archive(UUID, b"tree", 4096, 3 * 4096, seed, b"keyid..8")
    streams = spark.createDataFrame([(0, bytearray(b"a" * 5000)), (1, bytearray(b"b" * 9000))], "slice_seq_num long, data binary")
    made = commands.archive_streams(streams, a, (tmp_path / "plan").read_bytes()).cache()
    paths = []
    for v in sorted(r[0] for r in made.select("volume_seq_num").distinct().collect()):
        commands.store(made, str(tmp_path / f"v{v}"), v)
        paths.append(str(tmp_path / f"v{v}"))
    assert len(paths) > 1
    public = spark.createDataFrame([(b"keyid..8", bytearray(ed25519.public_key(seed)))], "key_id binary, public_key binary")
    _, summary, _ = commands.inspect(spark, paths, public, True)
    s = summary.first()
    assert s["complete"] and s["signatures_verified"] == s["total_frames"] and s["metadata_frames"] >= 1
    assert commands.catalog(spark, paths).where("error IS NULL").count() == 6
    commands.extract(spark, paths, str(tmp_path / "out"))
    assert (tmp_path / "out").read_bytes() == b"a" * 5000 + b"b" * 9000
    text = commands.resume_file(spark, paths[0], "/tool-resume/1")
    assert b"/archive_name/tree\0\n" in text and b"/sign_key_id/" + b"keyid..8".hex().encode() in text
    assert commands.dump(spark, paths[0], str(tmp_path / "copy"))["records"] == spool.read_spool(spark, paths[0]).count()
    # a missing volume is found
    _, summary, _ = commands.inspect(spark, [paths[0], *paths[2:]])
    assert not summary.first()["complete"]


def test_options(spark):
    for block in (1000, 2048, 16 << 20):
        with pytest.raises(commands.UsageError):
            commands.Archive(UUID, block=block)


def test_pax_members(spark):
    rows = [(b"d/\xff", "f", bytearray(b"x" * 700), 5, 1, 2, "u", "g", None), (b"l", "l", None, 5, 1, 2, "u", "g", b"d"), (b"d", "d", None, None, None, None, None, None, None), (b"s", "s", None, 5, 1, 2, "u", "g", None)]
    entries = spark.createDataFrame(rows, "path binary, kind string, data binary, mtime long, uid long, gid long, uname string, gname string, link binary").coalesce(1)
    stream = b"".join(bytes(r["member"]) for r in pax.pax_members(entries).collect()) + pax.CLOSING
    with tarfile.open(fileobj=io.BytesIO(stream)) as t:
        names = [m.name.encode("utf-8", "surrogateescape") for m in t.getmembers()]
        assert names == [b"d/\xff", b"l", b"d"] and t.extractfile(t.getmembers()[0]).read() == b"x" * 700


def test_secret_keys():
    seed = bytes(range(32))
    body = seed + ed25519.public_key(seed)
    raw = b"EdBK" + bytes(4) + bytes(16) + hashlib.sha512(body).digest()[:8] + b"keyid..8" + body
    text = keys.COMMENT + "me\n" + base64.b64encode(raw).decode() + "\n"
    assert keys.parse_secret_key(text) == (b"keyid..8", seed)
    with pytest.raises(ValueError):
        keys.parse_secret_key(keys.COMMENT + "me\n" + base64.b64encode(raw[:4] + b"\0\0\0\1" + raw[8:]).decode())

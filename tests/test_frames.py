import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelframe.functions import ed25519
from reelframe.operators import packing, reports
from reelframe.operators.build import build_records, with_archive_end
from reelframe.operators.lookups import signatures
from reelframe.operators.packing import Packer
from reelframe.operators.validate import Validator
from reelframe.sources import frames as fr

UUID = "00000000-0000-4000-8000-000000000123"
BASE = {"channel_type": 1, "volume_block_size_kib": 4, "archive_uuid": UUID, "archive_label": b"unit-test", "volume_seq_num": 7, "global_frame_seq_num": 9, "slice_seq_num": 2, "channel_frame_seq_num": 0, "frame_payload_size": 123, "is_end": True}
LAST = BASE | {"channel_type": 255, "global_frame_seq_num": 10, "slice_seq_num": 0, "frame_payload_size": 0, "is_clean_end": True}


def record(payload=b"x" * 123, **change):
    return fr.finish(fr.build_header(BASE | change) + payload.ljust(3584, b"\0"), change.get("volume_seq_num", 7))


def checked(spark, *raw):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, record binary")
    return fr.check_frames(fr.parse_headers(rows)).orderBy("i").collect()


def test_offsets_and_round_trip(spark):
    raw = record()
    assert raw[114:122] == (7).to_bytes(8, "little") and raw[122] == 9 and raw[130] == 2 and raw[146] == 123 and raw[150] == 1
    r = checked(spark, raw)[0]
    assert r["header_error"] is None and (r["archive_uuid"], bytes(r["archive_label"])) == (UUID, b"unit-test")
    assert [int(r[c]) for c in ("volume_seq_num", "global_frame_seq_num", "slice_seq_num", "channel_frame_seq_num", "frame_payload_size")] == [7, 9, 2, 0, 123]
    assert (r["is_end"], r["is_signed"], r["is_clean_end"], r["size_ok"], r["hash_ok"], r["padding_ok"]) == (True, False, False, True, True, True)


def test_integrity_cases(spark):
    good = record()
    dirty = fr.finish(good[:-1] + b"\1", 7)
    flipped = good[:600] + bytes([good[600] ^ 1]) + good[601:]
    got = [(r["size_ok"], r["hash_ok"], r["padding_ok"]) for r in checked(spark, good, dirty, good + b"\0", flipped)]
    assert got == [(True, True, True), (True, True, False), (False, False, False), (True, False, True)]


def patched(offset, value):
    raw = bytearray(record())
    raw[offset] = value
    return bytes(raw)


@pytest.mark.parametrize("raw", [patched(0, 0), patched(8, 2), patched(9, 3), patched(158, 1), patched(150, 9), patched(157, 1), patched(60, 65), patched(280, 1), patched(10, 3), patched(408, 1), b"short", b""])
def test_bad_headers(spark, raw):
    r = checked(spark, raw)[0]
    assert r["header_error"] and r["global_frame_seq_num"] is None and r["hash_ok"] is None


def test_archive_end_rules(spark):
    ok = fr.build_header(LAST) + bytes(3584)
    bad = [fr.build_header(LAST | c) + bytes(3584) for c in ({"is_end": False}, {"is_clean_end": False}, {"slice_seq_num": 1}, {"channel_frame_seq_num": 1}, {"frame_payload_size": 1})]
    got = [r["header_error"] for r in checked(spark, ok, *bad, fr.build_header(BASE | {"is_clean_end": True}) + bytes(3584), fr.build_header(BASE | {"is_end": False}) + bytes(3584))]
    assert got[0] is None and all(got[1:])


def test_labels():
    assert fr.build_header(BASE | {"archive_label": b"x" * 64})
    for change in ({"archive_label": b"x" * 65}, {"archive_label": b"a\0b"}, {"archive_uuid": "x" * 37}):
        with pytest.raises(ValueError):
            fr.build_header(BASE | change)


def test_norm_hash_ignores_only_the_volume(spark):
    a, b, c = checked(spark, record(volume_seq_num=1), record(volume_seq_num=2), record(payload=b"y" * 123))
    assert a["norm_hash"] == b["norm_hash"] != c["norm_hash"] and a["frame_hash"] != b["frame_hash"]


def frame(seq, slice_=0, channel=1, c=0, end=False, **more):
    return {"channel_type": channel, "volume_block_size_kib": 4, "archive_uuid": "u", "archive_label": b"", "global_frame_seq_num": seq, "slice_seq_num": slice_, "channel_frame_seq_num": c, "is_end": end, "size_ok": True, "hash_ok": True, "padding_ok": True, "norm_hash": str((seq, slice_, channel, c)).encode(), "header_error": None} | more


def last(seq):
    return frame(seq, 0, 255, 0, True)


def judged(frames, mode="inspect", seeded=False):
    v = Validator(mode, seeded)
    return [v.judge(f)[0] for f in frames]


WHOLE = [frame(0, c=0), frame(1, channel=2, c=0), frame(2, c=1, end=True), frame(3, channel=2, c=1, end=True), frame(4, 1, c=0), frame(5, 1, c=1, end=True), last(6)]


def test_whole_stream_and_every_start():
    for start in range(len(WHOLE)):
        assert set(judged(WHOLE[start:], seeded=start > 0)) == {"ok"}


@pytest.mark.parametrize(
    "frames,want",
    [
        ([frame(0, channel=2, hash_ok=False, end=True), frame(1, end=True), last(2)], ["warning", "ok", "ok"]),
        ([frame(0), frame(1, channel=2, archive_uuid="v")], ["ok", "error"]),
        ([frame(0, c=1)], ["error"]),
        ([frame(0, c=0, end=True), frame(1, 1, c=1)], ["ok", "error"]),
        ([frame(0), last(1)], ["ok", "error"]),
        ([frame(0, end=True), frame(1, c=1)], ["ok", "error"]),
        ([frame(0), frame(1, c=1, volume_block_size_kib=8)], ["ok", "error"]),
        ([frame(0, padding_ok=False)], ["error"]),
        ([last(0)], ["ok"]),
        ([frame(0, 1)], ["error"]),
        ([frame(0, end=True), last(1), frame(2, 1)], ["ok", "ok", "error"]),
    ],
)
def test_rules_in_restore(frames, want):
    assert judged(frames, "restore") == want


def test_seeded_gap():
    assert judged([frame(42, 3, c=7), frame(44, 3, c=9)], seeded=True) == ["ok", "error"]


def test_cascades():
    # a gap leaves the expected number: all later frames fail
    assert judged([frame(0), frame(2, c=1), frame(3, c=2)]) == ["ok", "error", "error"]
    # a bad slice number moves the expected number but not the slice
    assert judged([frame(0, end=True), frame(1, 2), frame(2, 2, c=1)]) == ["ok", "error", "error"]
    # a bad channel number blocks its channel until the next slice, which its missing end blocks too
    assert judged([frame(0), frame(1, c=5), frame(2, c=2), frame(3, 1)]) == ["ok", "error", "error", "error"]


def test_replays():
    a, b, c = frame(0), frame(1, c=1), frame(2, c=2)
    assert judged([a, b, c, b, c, frame(3, c=3)]) == ["ok", "ok", "ok", "replay", "replay", "ok"]
    assert judged([a, b, c, b, frame(3, c=3)])[-1] == "error"
    assert judged([a, b, c, b | {"norm_hash": b"other"}])[-1] == "error"
    assert judged([a, b, c, b | {"hash_ok": False}])[-1] == "error"
    assert judged([a, b, c, a, c])[-1] == "error"
    assert judged([frame(5), frame(6, c=1), frame(4)], seeded=True)[-1] == "error"
    v = Validator(seeded=False)
    assert [v.judge(f)[0] for f in (a, b, c, b)][-1] == "replay"
    v.connect()
    assert v.judge(a)[0] == "replay"


def test_history_is_bounded():
    frames = [frame(i, c=i) for i in range(8195)]
    v = Validator(seeded=False)
    for f in frames:
        assert v.judge(f)[0] == "ok"
    assert v.judge(frames[0])[0] == "error"
    assert v.judge(frames[3])[0] == "replay"


def test_salvage():
    assert judged([frame(0), frame(5, hash_ok=False), frame(9, 4, c=3), frame(9, 4, c=3), frame(0, archive_uuid="w")], "salvage") == ["ok", "error", "ok", "replay", "ok"]


def test_pack_rule():
    p = Packer(100)
    assert [p.place(s) for s in (40, 40, 60, 80, 10, 500, 0, 0)] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (3, 0), (3, 1)]
    assert [Packer(100, memory=2).place(0, 2), Packer(1).place(7)] == [(0, 0), (0, 0)]


@given(st.lists(st.integers(0, 300), max_size=60))
def test_pack_keeps_order_and_bounds(sizes):
    p = Packer(100)
    places = [p.place(s) for s in sizes]
    assert places == sorted(places)
    total = {}
    for (s, _), size in zip(places, sizes, strict=True):
        total.setdefault(s, []).append(size)
    for held in total.values():
        assert sum(held) <= 150 or len(held) == 1


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 3 * 3584 + 1))
def test_cut_and_join(spark, n):
    data = bytes((i * 29 + 7) % 251 for i in range(n))
    cut = packing.cut_frames(spark.createDataFrame([(1, data)], "s int, data binary"), 4096)
    rows = cut.orderBy("channel_frame_seq_num").collect()
    assert b"".join(bytes(r["payload"]) for r in rows) == data
    assert len(rows) == -(-n // 3584) and [r["is_end"] for r in rows] == [i == len(rows) - 1 for i in range(len(rows))]


def archive(spark, texts, seed=None, key_id=bytes(8)):
    docs = spark.createDataFrame(list(enumerate(texts)), "slice_seq_num long, data binary")
    numbered = packing.number_frames(packing.cut_frames(docs, 4096), ["slice_seq_num", "channel_frame_seq_num"])
    frames = numbered.withColumn("volume_seq_num", packing.volume_of(F.col("global_frame_seq_num"), 4096, 4 * 4096)).withColumn("channel_type", F.lit(1))
    return build_records(with_archive_end(frames), 4096, UUID, b"t", seed, key_id).selectExpr("volume_seq_num AS file_num", "global_frame_seq_num AS rec_idx", "record")


def test_archive_report_and_restore(spark, tmp_path):
    texts = [bytes([65 + i]) * (5000 * i + 1) for i in range(4)]
    media = archive(spark, texts)
    foreign = spark.createDataFrame([(-1, 0, b"boot block")], media.schema)
    report = reports.frame_report(media.unionByName(foreign)).cache()
    s = reports.inspect_summary(report).first()
    assert s["complete"] and s["compliant"] and s["errors"] == 0 and s["total_frames"] == media.count()
    payloads = reports.restorable(media, report)
    assert reports.restore_to(payloads, str(tmp_path / "out")) == sum(map(len, texts))
    assert (tmp_path / "out").read_bytes() == b"".join(texts)
    # a damaged record: restore stops there, salvage goes on
    hit = media.withColumn("record", F.when(F.col("rec_idx") == 1, F.expr("concat(substring(record, 1, 600), x'FF', substring(record, 602))")).otherwise(F.col("record")))
    restore = [r["status"] for r in reports.frame_report(hit, mode="restore").orderBy("rec_idx").collect()]
    assert restore[:3] == ["ok", "error", "unread"]
    salvage = [r["status"] for r in reports.frame_report(hit, mode="salvage").orderBy("rec_idx").collect()]
    assert salvage[1] == "error" and set(salvage[:1] + salvage[2:]) == {"ok"}
    # a record that is not there
    assert "error" in [r["status"] for r in reports.frame_report(media.where("rec_idx <> 1")).collect()]


def test_two_archives_on_a_medium(spark):
    a = archive(spark, [b"one"])
    b = build_records(with_archive_end(spark.createDataFrame([(0, 0, 1, 0, 0, 3, True, b"two")], "volume_seq_num long, global_frame_seq_num long, channel_type int, slice_seq_num long, channel_frame_seq_num long, frame_payload_size long, is_end boolean, payload binary")), 4096, "other", b"t")
    both = a.unionByName(b.selectExpr("9 AS file_num", "global_frame_seq_num AS rec_idx", "record"))
    assert {r["status"] for r in reports.frame_report(both, per_archive=True).collect()} == {"ok"}
    assert [r["status"] for r in reports.frame_report(both).orderBy("file_num", "rec_idx").collect()][2:] == ["error", "error"]


def test_signatures(spark):
    seed, key_id = bytes(range(32)), b"keyid..8"
    media = archive(spark, [b"abc"], seed, key_id)
    keys = spark.createDataFrame([(key_id, ed25519.public_key(seed))], "key_id binary, public_key binary")
    other = spark.createDataFrame([(b"otherkey", ed25519.public_key(seed))], "key_id binary, public_key binary")
    wrong = spark.createDataFrame([(key_id, ed25519.public_key(bytes(32)))], "key_id binary, public_key binary")
    rows = fr.parse_headers(media)
    status = lambda *a: {r["signature_status"] for r in signatures(rows, *a).collect()}
    assert status(keys) == {"verified"} and status(other) == {"invalid"} and status(wrong) == {"invalid"}
    assert status() == {"signed_unverified"} and status(None, True) == {"invalid"}
    plain = fr.parse_headers(archive(spark, [b"abc"]))
    assert {r["signature_status"] for r in signatures(plain, keys).collect()} == {"unsigned"}
    assert {r["signature_status"] for r in signatures(plain, keys, True).collect()} == {"invalid"}

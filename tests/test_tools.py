import random
import tarfile

import pytest
from pyspark.sql import functions as F

from reelframe.functions import ed25519, names
from reelframe.functions.blake3 import Blake3, blake3_many
from reelframe.operators import lookups, packing, pax
from reelframe.plans import commands
from reelframe.sources import frames as fr
from reelframe.sources import records, spool
from reelframe.streaming import frames as stream
from reelframe.streaming import pull
from tests.test_frames import UUID, archive


@pytest.mark.parametrize("n", [0, 1, 1024, 1025, 5000, 1 << 20, (1 << 20) + 1, 3 * (1 << 20) + 77, 4 << 20, (5 << 20) + 1024])
def test_hash_of_a_stream(n):
    data, h, at, rng = random.Random(n).randbytes(n), Blake3(), 0, random.Random(1)
    while at < n:
        step = rng.randint(1, 700_000)
        h.update(data[at : at + step])
        at += step
    assert h.digest() == blake3_many([data])[0] == h.digest()


def entry_tree(tmp_path):
    (tmp_path / "t").mkdir()
    for i in range(6):
        (tmp_path / "t" / f"f{i}").write_bytes(bytes([65 + i]) * (1500 + 700 * i))
    (tmp_path / "t" / "z").hardlink_to(tmp_path / "t" / "f0")
    (tmp_path / "t" / "y").symlink_to("f1")
    return str(tmp_path / "t")


def test_pax_from_files(spark, tmp_path):
    plan = commands.plan_tree(spark, [entry_tree(tmp_path)], slice_size=4000).cache()
    total, digest = commands.mt_pax(plan, str(tmp_path / "s"))
    files = sorted(tmp_path.glob("s*.pax"))
    assert [f.name for f in files] == [f"s{i:06d}.pax" for i in range(total["slices"])] and total["slices"] > 2
    whole = b"".join(f.read_bytes() for f in files)
    assert digest == blake3_many([whole])[0].hex() and total["output_bytes"] == len(whole)
    assert total["entries"] == plan.count() and total["input_bytes"] == sum(1500 + 700 * i for i in range(6))
    kinds = {}
    for f in files:
        with tarfile.open(f) as t:
            for m in t.getmembers():
                kinds[m.name.split("/")[-1]] = (m.type, m.linkname.split("/")[-1], t.extractfile(m).read() if m.isreg() else None)
    assert kinds["f3"][2] == b"D" * 3600 and kinds["y"][0] == tarfile.SYMTYPE and kinds["z"][:2] == (tarfile.LNKTYPE, "f0")
    # from a later slice on: the link to a file of a slice before is still a link
    total, _ = commands.mt_pax(plan, str(tmp_path / "r"), first_slice=2)
    assert [f.name for f in sorted(tmp_path.glob("r*.pax"))] == [f"r{i:06d}.pax" for i in range(2, 2 + total["slices"])]
    with tarfile.open(sorted(tmp_path.glob("r*.pax"))[-1]) as t:
        assert [(m.name.split("/")[-1], m.type) for m in t.getmembers()][-1] == ("z", tarfile.LNKTYPE)
    late = lookups.resolve_links(plan, 2)
    assert late.agg({"slice": "min"}).first()[0] == 2


def test_archive_of_files(spark, tmp_path, monkeypatch):
    """A tree is planned, written as slices, archived from these files by ranges, put on volumes and restored."""
    monkeypatch.setattr(packing, "PIECE", 8000)
    monkeypatch.setattr(packing, "HELD", 4096)
    plan = commands.plan_tree(spark, [entry_tree(tmp_path)], slice_size=4000).cache()
    commands.write_plan(plan, str(tmp_path / "plan"))
    written = pax.write_slices(lookups.resolve_links(plan), str(tmp_path / "s")).cache()
    a = commands.Archive(UUID, b"tree", 4096, 5 * 4096)
    made = commands.archive_files(written, a, str(tmp_path / "plan")).cache()
    slices = [(r["slice"], bytearray(open(r["name"], "rb").read())) for r in written.orderBy("slice").collect()]  # noqa: SIM115
    want = commands.archive_streams(spark.createDataFrame(slices, "slice_seq_num long, data binary"), a, (tmp_path / "plan").read_bytes())
    rows = lambda df: df.orderBy("global_frame_seq_num").collect()
    assert rows(made) == rows(want) and made.agg({"volume_seq_num": "max"}).first()[0] > 1
    paths = [str(tmp_path / f"v{i}") for i in range(1 + made.agg({"volume_seq_num": "max"}).first()[0])]
    assert commands.write_volumes(made, paths) == 0
    commands.extract(spark, paths, str(tmp_path / "out"))
    assert (tmp_path / "out").read_bytes() == b"".join(s for _, s in slices)
    assert commands.catalog(spark, paths).where("error IS NULL").count() == plan.count()
    (tmp_path / "s000000.pax").write_bytes(b"short")
    with pytest.raises(Exception, match="is shorter than"):
        commands.archive_files(written, a).count()


def test_volumes_written_in_one_go(spark, tmp_path):
    made = archive(spark, [b"a" * 9000, b"b" * 20000]).selectExpr("file_num AS volume_seq_num", "rec_idx AS global_frame_seq_num", "record")
    paths = [str(tmp_path / f"v{i}") for i in range(3)]
    (tmp_path / "bundle").write_bytes(b"tools")
    assert commands.write_volumes(made, paths[:2], per_file=2, bundle=str(tmp_path / "bundle")) == 1
    assert (tmp_path / "v1" / "RECOVERY.TAR").read_bytes() == b"tools" and commands.install_bundle(str(tmp_path / "bundle"), paths[0], 4096) == 4096
    assert [n for n, _, _ in spool.spool_files(paths[0])] == [1, 2]
    with pytest.raises(commands.UsageError):
        commands.write_volumes(made, paths)
    assert commands.write_volumes(made, paths, overwrite=True) == 0
    _, summary, _ = commands.inspect(spark, paths)
    assert summary.first()["complete"]
    assert not list(tmp_path.glob("v*/*.TMP"))
    late = commands.resumed(made, 5, 7)
    assert late.agg(F.min("global_frame_seq_num"), F.min("volume_seq_num")).first()[:] == (5, 7)


def test_reader_forwards_what_parses(spark):
    media = archive(spark, [b"a" * 9000])
    bad = media.withColumn("record", F.when(F.col("rec_idx") == 1, F.expr("concat(substring(record, 1, 8), x'07', substring(record, 10))")).otherwise(F.col("record")))
    noise = spark.createDataFrame([(-1, 0, b"boot"), (-1, 1, b"boot")], media.schema)
    sent, counts = commands.forwarded(bad.unionByName(noise))
    assert counts["forwarded_frames"] == media.count() - 1 == sent.count() and counts["skipped_prefix"] == 2 and counts["unavailable"] == 1
    first = media.withColumn("record", F.when(F.col("rec_idx") == 0, F.expr("concat(substring(record, 1, 8), x'07', substring(record, 10))")).otherwise(F.col("record")))
    with pytest.raises(ValueError):
        commands.forwarded(first)
    assert commands.forwarded(noise)[1]["forwarded_frames"] == 0


def test_catalog_bytes_and_counts(spark, tmp_path):
    plan = b"/chdir/x\0\n/0/0/f/3/0/1/u/1/g/p\0\n" * 500
    streams = spark.createDataFrame([(0, bytearray(b"abc" * 3000))], "slice_seq_num long, data binary")
    made = commands.archive_streams(streams, commands.Archive(UUID, b"c", 4096), plan)
    commands.write_volumes(made, [str(tmp_path / "v")])
    assert commands.catalog_to(spark, [str(tmp_path / "v")], str(tmp_path / "plan")) == len(plan)
    assert (tmp_path / "plan").read_bytes() == plan
    report = commands.extract(spark, [str(tmp_path / "v")], str(tmp_path / "out"))
    assert commands.processed_frames(report) == report.count() and (tmp_path / "out").read_bytes() == b"abc" * 3000


def test_spool_framing(spark, tmp_path):
    def end(block):
        header = {"channel_type": 255, "volume_block_size_kib": block, "archive_uuid": "u", "is_end": True, "is_clean_end": True}
        return fr.finish(fr.build_header(header) + bytes(block * 1024 - 512), 0)

    root = tmp_path / "v"
    root.mkdir()
    (root / "NT000001.NTS").write_bytes(end(4) + end(8) + end(4) + b"tail")
    (root / "NT000002.NTS").write_bytes(end(8))
    (root / "NT000007.NTS").write_bytes(b"foreign" * 1000)
    with pytest.warns(UserWarning, match="short tail"):
        list(spool.SpoolReader({"path": str(root), "framing": "sequential", "skip_foreign": "true"}).framed("NT000001.NTS", None))
    got = spool.read_spool(spark, str(root), framing="sequential", skip_foreign="true").orderBy("file_num", "rec_idx").collect()
    assert [(r["file_num"], r["rec_idx"], r["rec_size"]) for r in got] == [(1, 0, 4096), (1, 1, 8192), (1, 2, 4096), (2, 0, 8192)]
    with pytest.raises(Exception, match="sequential"):
        spool.read_spool(spark, str(root), skip_foreign="true").collect()
    assert [r["file_num"] for r in spool.read_spool(spark, str(root), skip_files="1,7").collect()] == [2]
    assert not spool.is_end(end(4)[:-1] + b"x")


def test_resume_log(spark, tmp_path):
    head = {"archive_uuid": "u-1", "block_size_kib": 4, "sign_key_id": "", "plan_blake3": "", "archive_name": b"n"}
    log = records.ResumeLog.create(str(tmp_path / "r"), "/tool-resume/1", head)
    log.slice_started(1, 5)
    log.slice_started(2, 9)
    log.frame_acked(6, 0)
    log.close()
    with open(tmp_path / "r", "ab") as f:
        f.write(b"/slice/2/to")
    with pytest.raises(FileExistsError):
        records.ResumeLog.create(str(tmp_path / "r"), "/tool-resume/1", head)
    log = records.ResumeLog.reopen(str(tmp_path / "r"), (1, 5, 1))
    log.slice_started(1, 5)
    log.slice_started(2, 9)
    log.frame_acked(12, 1)
    log.completed()
    log.close()
    log.append(b"not any more")
    assert (tmp_path / "r").read_bytes().endswith(b"/slice/1/5/0\0\n/slice/1/5/1\0\n/slice/2/9/1\0\n/archive_end/12\0\n")
    rows = records.parse_resume(records.read_records(spark, str(tmp_path / "r"))).collect()
    assert all(r["error"] is None for r in rows) and len(rows) == 10


def test_ledgers(spark, tmp_path):
    for v in (1, 2):
        (tmp_path / f"volume-{v}").mkdir()
        (tmp_path / f"volume-{v}" / "records.tsv").write_text("event\tfile\tglobal\tbytes\n" + "".join(f"record\t1\t{10 * v + i}\t4096\n" for i in range(3)) + "filemark\t1\t\t\n")
    got = records.read_ledger(spark, str(tmp_path / "volume-*" / "records.tsv"))
    assert sorted(map(tuple, got.collect())) == [(v, 1, 10 * v + i, 4096) for v in (1, 2) for i in range(3)]


def test_nonces_and_uuids(spark):
    seed, nonce = bytes(range(32)), bytes(32)
    signature = ed25519.sign_nonce(seed, nonce, b"auth\0")
    assert ed25519.verify_nonce(ed25519.public_key(seed), nonce, signature, b"auth\0")
    assert not ed25519.verify_nonce(ed25519.public_key(seed), nonce, signature, b"frame\0")
    ids = [r[0] for r in spark.range(50).select(names.new_uuid()).collect()]
    assert len(set(ids)) == 50 and all(i[14] == "4" and i[19] in "89ab" for i in ids)


def test_retention():
    held = pull.Retention(3)
    for i in range(5):
        held.add(i, bytes([i]))
    assert held.get(1) is None and held.get(2) == b"\2"
    held.ack(2)
    held.ack(9)
    assert held.get(2) is None and len(held.frames) == 2


def test_pulled_frames_in_windows(spark, tmp_path):
    media = archive(spark, [b"a" * 9000, b"b" * 20000])
    spool.write_spool(media.withColumn("file_num", F.col("file_num") + 1), str(tmp_path / "v"))
    n = media.count()
    reader = pull.PullReader({"path": str(tmp_path / "v"), "window": "4"})
    assert reader.latestOffset() == {"next": 4}
    spans = reader.partitions({"next": 2}, {"next": 7})
    assert [s for p in spans for s, _ in reader.read(p)] == [2, 3, 4, 5, 6]
    source = stream.fold_stream(stream.frame_stream(pull.pull_stream(spark, str(tmp_path / "v"), 4)), seeded=False)
    query = source.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    out = spark.read.parquet(str(tmp_path / "o"))
    assert out.count() == n and {r["status"] for r in out.collect()} == {"ok"}


def test_pulled_windows_in_one_batch(spark, tmp_path, monkeypatch):
    """Many windows a micro-batch, dealt to tasks by bytes: every frame once, few batches."""
    media = archive(spark, [b"a" * 9000, b"b" * 20000])
    spool.write_spool(media.withColumn("file_num", F.col("rec_idx") / 3 + 1).selectExpr("cast(file_num as long) file_num", "rec_idx", "record"), str(tmp_path / "v"))
    n = media.count()
    monkeypatch.setattr(pull, "TASK", 4 * 4096)
    reader = pull.PullReader({"path": str(tmp_path / "v"), "window": "2", "windows": "1000"})
    assert reader.latestOffset() == {"next": n}
    parts = reader.partitions({"next": 1}, {"next": n})
    want = [(r["rec_idx"], bytes(r["record"])) for r in media.orderBy("rec_idx").collect()][1:]
    assert [x for p in parts for x in reader.read(p)] == want
    assert [sum(s.count for s in p.spans) for p in parts] == [4] * ((n - 1) // 4) + [(n - 1) % 4] * ((n - 1) % 4 > 0)
    assert reader.partitions({"next": n}, {"next": n}) == []
    heads = pull.pull_stream(spark, str(tmp_path / "v"), 2, 1000).select("ord")
    query = heads.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == list(range(n))
    assert len(list((tmp_path / "c" / "commits").glob("[0-9]*"))) == 1


def test_number_streams_like_frames(spark):
    docs = spark.createDataFrame([(i, b"x" * (i * 3000)) for i in (5, 1, 0, 7)], "slice_seq_num long, data binary")
    got = packing.number_streams(docs, 4096, ["slice_seq_num"]).orderBy("global_frame_seq_num").select("slice_seq_num", "channel_frame_seq_num", "global_frame_seq_num").collect()
    want = packing.number_frames(packing.cut_frames(docs, 4096), ["slice_seq_num", "channel_frame_seq_num"]).orderBy("global_frame_seq_num").select("slice_seq_num", "channel_frame_seq_num", "global_frame_seq_num").collect()
    assert got == want

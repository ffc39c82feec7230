from pyspark.sql import functions as F

from reelframe.sources import frames as fr
from reelframe.streaming import frames as stream
from tests.test_frames import archive


def test_stream_keeps_state_and_ends(spark, tmp_path):
    media = archive(spark, [b"a" * 9000, b"b" * 20000]).withColumnRenamed("rec_idx", "ord").drop("file_num").cache()
    root, sink, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    half = media.count() // 2
    # the second file repeats two records of the first
    media.where(F.col("ord") < half).coalesce(1).write.mode("append").parquet(root)
    source = stream.frame_stream(stream.table_stream(spark, root, "ord long, record binary"))
    stream.run_to_end(stream.fold_stream(source, seeded=False), sink, check)
    assert spark.read.parquet(sink).count() == half
    media.where(F.col("ord") >= half - 2).withColumn("ord", F.col("ord") + 2).coalesce(1).write.mode("append").parquet(root)
    stream.run_to_end(stream.fold_stream(source, seeded=False), sink, check)
    out = spark.read.parquet(sink)
    assert {r["status"]: r["count"] for r in out.groupBy("status").count().collect()} == {"ok": media.count(), "replay": 2}
    assert int(stream.high_water(out).first()["next_seq"]) == media.count()
    assert [int(r["global_seq"]) for r in stream.resume_log(out.where("slice_seq_num > 0")).collect()] == [3]


def test_conflict_in_a_stream_is_reported(spark, tmp_path):
    a = fr.finish(fr.build_header({"channel_type": 1, "volume_block_size_kib": 4, "archive_uuid": "u", "frame_payload_size": 1, "is_end": True}) + b"a".ljust(3584, b"\0"), 0)
    b = fr.finish(a[:512] + b"b".ljust(3584, b"\0"), 0)
    spark.createDataFrame([(0, a), (1, b)], "ord long, record binary").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = stream.frame_stream(stream.table_stream(spark, str(tmp_path / "in"), "ord long, record binary"))
    stream.run_to_end(stream.fold_stream(source, seeded=False), str(tmp_path / "out"), str(tmp_path / "check"))
    assert [r["status"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ord").collect()] == ["ok", "error"]

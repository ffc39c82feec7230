"""Queries over input that breaks rules, over written media, and over streams, with the same result in SQL.

Damage is put in by a rule on the rows' numbers, so that SQL can tell what it must lead to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.functions import names, numbers
from reelframe.operators import lookups, pax, reports
from reelframe.operators.scratch import Scratch
from reelframe.operators.validate import validate_frames
from reelframe.plans.catalogue import BLOCK, CAPACITY, FRAMES, _archive, query, table
from reelframe.sources import frames as fr
from reelframe.sources import keys, records, spool
from reelframe.streaming import frames as stream
from reelframe.streaming import pull

# -- the validator over faults of twelve kinds ------------------------------------------

TRIAL = """
b AS (SELECT l_orderkey AS k, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::BIGINT AS j, ((l_partkey * 7 + l_suppkey * 3 + l_linenumber * 11) % 40)::BIGINT AS f0 FROM lineitem),
c AS (SELECT k, j, CASE WHEN j = 0 AND f0 IN (4, 5) THEN 39 ELSE f0 END AS f FROM b),
d AS (SELECT *, (sum(CASE WHEN f IN (4, 5) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY j))::BIGINT AS r, (sum(CASE WHEN f IN (4, 5) THEN 1 ELSE 0 END) OVER (PARTITION BY k))::BIGINT AS rr, count(*) OVER (PARTITION BY k) AS n FROM c),
e AS (SELECT k, j, f, j - r AS e, n - 1 - rr AS m FROM d),
h AS (SELECT *, e = m AND m >= 1 AND f <> 8 AS fin FROM e),
i AS (SELECT k, j, f, CASE WHEN f = 10 THEN 'no magic' END AS header_error, CASE WHEN f = 8 THEN 2 WHEN fin THEN 255 ELSE 1 END AS ch, e + CASE WHEN f = 3 THEN 1 ELSE 0 END AS g,
        CASE WHEN fin THEN 0 ELSE e // 3 + CASE WHEN f = 6 THEN 1 ELSE 0 END END AS slice, CASE WHEN fin OR f = 8 THEN 0 ELSE e % 3 + CASE WHEN f = 7 THEN 1 ELSE 0 END END AS cseq,
        f = 8 OR fin OR e % 3 = 2 OR e = m - 1 AS is_end, f <> 1 AS size_ok, f NOT IN (0, 8) AS hash_ok, f <> 2 AS padding_ok, CASE WHEN f = 9 THEN 'v' ELSE 'u' END AS uuid, CASE WHEN f = 11 THEN 8 ELSE 4 END AS block FROM h),
l AS (SELECT *, g || '/' || slice || '/' || ch || '/' || cseq || CASE WHEN f = 5 THEN 'x' ELSE '' END AS digest FROM i)"""


def _trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is an archive, each of its lines a frame; some lines are damaged or repeat the frame before."""
    own = W.partitionBy("l_orderkey")
    at = F.row_number().over(own.orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long") - 1
    f0 = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 3 + F.col("l_linenumber") * 11) % 40
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", at.alias("j"), f0.alias("f0"))
    rows = rows.withColumn("f", F.when((F.col("j") == 0) & F.col("f0").isin(4, 5), 39).otherwise(F.col("f0")))
    f, again = F.col("f"), F.col("f").isin(4, 5).cast("long")
    rows = rows.withColumns({"e": F.col("j") - F.sum(again).over(own.orderBy("j")), "m": F.count("*").over(own) - 1 - F.sum(again).over(own)})
    e, m = F.col("e"), F.col("m")
    fin = (e == m) & (m >= 1) & (f != 8)
    third = F.floor(e / 3)
    rows = rows.select(
        "l_orderkey", "j", "f", F.when(f == 10, "no magic").alias("header_error"), F.when(f == 8, 2).when(fin, 255).otherwise(1).alias("channel_type"), (e + (f == 3).cast("long")).alias("global_frame_seq_num"),
        F.when(fin, 0).otherwise(third + (f == 6).cast("long")).cast("long").alias("slice_seq_num"), F.when(fin | (f == 8), 0).otherwise(e % 3 + (f == 7).cast("long")).cast("long").alias("channel_frame_seq_num"),
        ((f == 8) | fin | (e % 3 == 2) | (e == m - 1)).alias("is_end"), (f != 1).alias("size_ok"), (~f.isin(0, 8)).alias("hash_ok"), (f != 2).alias("padding_ok"), F.when(f == 9, "v").otherwise("u").alias("archive_uuid"),
        F.when(f == 11, 8).otherwise(4).alias("volume_block_size_kib"), F.lit(b"").alias("archive_label"),
    )
    text = F.concat_ws("/", *(F.col(c).cast("string") for c in ("global_frame_seq_num", "slice_seq_num", "channel_type", "channel_frame_seq_num")))
    return rows.withColumn("norm_hash", F.concat(text, F.when(f == 5, "x").otherwise("")).cast("binary"))


def _whole_sql(mode: str) -> str:
    """The state machine, a frame of every archive at each turn."""
    lax = "ch = 2" if mode == "restore" else "false"
    return f"""WITH RECURSIVE {TRIAL},
r AS (
  SELECT k, -1::BIGINT AS j, NULL::VARCHAR AS status, NULL::VARCHAR AS message, true AS fresh, false AS stopped, 0::BIGINT AS exp, 0::BIGINT AS cur, false AS started, false AS ended, NULL::BIGINT AS repl,
    0::BIGINT AS f1, false AS s1, false AS e1, 0::BIGINT AS f2, false AS s2, false AS e2, NULL::INTEGER AS blk, NULL::VARCHAR AS uid, []::STRUCT(seq BIGINT, d VARCHAR)[] AS hist FROM (SELECT DISTINCT k FROM l)
  UNION ALL
  SELECT k, j, CASE WHEN stopped THEN 'unread' WHEN code = 'R' THEN 'replay' WHEN code IS NOT NULL THEN 'error' WHEN NOT hash_ok THEN 'warning' ELSE 'ok' END,
    CASE WHEN stopped OR code = 'R' THEN NULL WHEN code IS NULL AND NOT hash_ok THEN 'metadata hash mismatch' ELSE code END,
    fresh AND (stopped OR header_error IS NOT NULL), stopped OR ({'true' if mode == 'restore' else 'false'} AND code IS NOT NULL AND code <> 'R'),
    CASE WHEN far THEN exp + 1 ELSE exp END, CASE WHEN far AND ch <> 255 AND NOT started THEN slice WHEN entered AND slice = cur + 1 THEN slice ELSE cur END, started OR (far AND ch <> 255), ended OR (code IS NULL AND NOT stopped AND ch = 255),
    CASE WHEN stopped THEN repl WHEN code = 'R' THEN CASE WHEN g + 1 < exp THEN g + 1 END ELSE repl END,
    CASE WHEN kept AND ch = 1 THEN cseq + 1 WHEN cleared THEN 0 ELSE f1 END, CASE WHEN kept AND ch = 1 THEN true WHEN cleared THEN false ELSE s1 END, CASE WHEN kept AND ch = 1 THEN is_end WHEN cleared THEN false ELSE e1 END,
    CASE WHEN kept AND ch = 2 THEN cseq + 1 WHEN cleared THEN 0 ELSE f2 END, CASE WHEN kept AND ch = 2 THEN true WHEN cleared THEN false ELSE s2 END, CASE WHEN kept AND ch = 2 THEN is_end WHEN cleared THEN false ELSE e2 END,
    CASE WHEN intact THEN coalesce(blk, block) ELSE blk END, CASE WHEN intact AND coalesce(blk, block) = block THEN coalesce(uid, uuid) ELSE uid END,
    CASE WHEN code IS NULL AND NOT stopped AND hash_ok AND len(hit) = 0 THEN list_append(hist, {{'seq': g, 'd': digest}}) ELSE hist END
  FROM (
    SELECT *, code IS NULL AND NOT stopped AND ch <> 255 AS kept,
      intact AND coalesce(blk, block) = block AND coalesce(uid, uuid) = uuid AND g = exp AS far,
      code IS NULL AND NOT stopped AND ch <> 255 AND started AND slice = cur + 1 OR (NOT stopped AND started AND ch <> 255 AND slice = cur + 1 AND done AND intact AND coalesce(blk, block) = block AND coalesce(uid, uuid) = uuid AND g = exp) AS entered,
      NOT stopped AND started AND ch <> 255 AND slice = cur + 1 AND done AND intact AND coalesce(blk, block) = block AND coalesce(uid, uuid) = uuid AND g = exp AS cleared
    FROM (
      SELECT *, CASE
        WHEN header_error IS NOT NULL THEN 'header: ' || header_error
        WHEN g < exp AND NOT hash_ok THEN 'replay with a bad hash' WHEN g < exp AND len(hit) = 0 THEN 'replay of a record that is not remembered' WHEN g < exp AND hit[1].d <> digest THEN 'replay differs from the accepted record'
        WHEN g < exp AND repl <> g THEN 'replay out of order' WHEN g < exp THEN 'R' WHEN repl IS NOT NULL THEN 'new frame before the replay is complete' WHEN ended THEN 'frame after the archive end'
        WHEN NOT size_ok THEN 'record size' WHEN NOT hash_ok AND NOT {lax} THEN 'hash mismatch' WHEN NOT padding_ok THEN 'bytes in the padding'
        WHEN blk <> block THEN 'block size changed' WHEN uid <> uuid THEN 'archive uuid mismatch' WHEN g <> exp THEN 'global number ' || g || ', expected ' || exp
        WHEN ch = 255 AND started AND NOT done THEN 'archive end before the channels'' ends' WHEN ch = 255 THEN NULL
        WHEN started AND slice <> cur AND slice <> cur + 1 THEN 'slice ' || slice || ' after ' || cur WHEN started AND slice = cur + 1 AND NOT done THEN 'new slice before the channels'' ends'
        WHEN NOT (started AND slice = cur + 1) AND mye THEN 'frame after its channel''s end'
        WHEN (CASE WHEN started AND slice = cur + 1 THEN 0 ELSE coalesce(myf, cseq) END) <> cseq THEN 'channel number ' || cseq || ', expected ' || (CASE WHEN started AND slice = cur + 1 THEN 0 ELSE myf END)
        END AS code,
        NOT stopped AND header_error IS NULL AND g >= exp AND repl IS NULL AND NOT ended AND size_ok AND (hash_ok OR {lax}) AND padding_ok AS intact
      FROM (
        SELECT l.*, r.* EXCLUDE (k, j, status, message, exp, cur, f1, f2), CASE WHEN fr THEN l.g ELSE r.exp END AS exp, CASE WHEN fr THEN l.slice ELSE r.cur END AS cur, CASE WHEN fr THEN NULL ELSE r.f1 END AS f1, CASE WHEN fr THEN NULL ELSE r.f2 END AS f2,
          (r.e1 OR NOT r.s1) AND (r.e2 OR NOT r.s2) AS done, CASE WHEN l.ch = 1 THEN r.e1 ELSE r.e2 END AS mye, CASE WHEN fr THEN NULL WHEN l.ch = 1 THEN r.f1 ELSE r.f2 END AS myf, list_filter(r.hist, lambda x: x.seq = l.g) AS hit
        FROM r JOIN l ON l.k = r.k AND l.j = r.j + 1, LATERAL (SELECT r.fresh AND NOT r.stopped AND l.header_error IS NULL AS fr)))))
SELECT k AS l_orderkey, j, status, message FROM r WHERE j >= 0"""


SALVAGE = f"""WITH RECURSIVE {TRIAL},
r AS (
  SELECT k, -1::BIGINT AS j, NULL::VARCHAR AS status, NULL::VARCHAR AS message, 0::BIGINT AS exp, NULL::BIGINT AS repl, NULL::VARCHAR AS uid, []::STRUCT(seq BIGINT, d VARCHAR)[] AS hist FROM (SELECT DISTINCT k FROM l)
  UNION ALL
  SELECT k, j, CASE WHEN code = 'R' THEN 'replay' WHEN code IS NOT NULL THEN 'error' ELSE 'ok' END, nullif(code, 'R'), CASE WHEN code IS NULL THEN g + 1 ELSE exp END,
    CASE WHEN code = 'R' THEN CASE WHEN g + 1 < exp THEN g + 1 END ELSE repl END, uid, CASE WHEN code IS NULL AND len(hit) = 0 THEN list_append(hist, {{'seq': g, 'd': digest}}) ELSE hist END
  FROM (
    SELECT *, CASE WHEN header_error IS NOT NULL THEN 'header: ' || header_error WHEN NOT size_ok THEN 'record size' WHEN NOT hash_ok THEN 'hash mismatch' WHEN NOT padding_ok THEN 'bytes in the padding'
      WHEN g < exp AND len(hit) = 0 THEN 'replay of a record that is not remembered' WHEN g < exp AND hit[1].d <> digest THEN 'replay differs from the accepted record' WHEN g < exp AND repl <> g THEN 'replay out of order' WHEN g < exp THEN 'R'
      WHEN repl IS NOT NULL THEN 'new frame before the replay is complete' END AS code
    FROM (
      SELECT *, list_filter(hist, lambda x: x.seq = g) AS hit FROM (
        SELECT l.*, CASE WHEN other THEN 0 ELSE r.exp END AS exp, CASE WHEN other THEN NULL ELSE r.repl END AS repl, CASE WHEN other THEN l.uuid ELSE r.uid END AS uid, CASE WHEN other THEN [] ELSE r.hist END AS hist
        FROM r JOIN l ON l.k = r.k AND l.j = r.j + 1, LATERAL (SELECT l.header_error IS NULL AND l.size_ok AND l.hash_ok AND l.padding_ok AND r.uid IS DISTINCT FROM l.uuid AS other)))))
SELECT k AS l_orderkey, j, status, message FROM r WHERE j >= 0"""


def _judged(spark, sf_dir, mode):
    return validate_frames(_trial(spark, sf_dir), ["l_orderkey"], ["j"], mode).select("l_orderkey", "j", "status", "message")


@query(_whole_sql("inspect"))
def validate_inspect(spark, sf_dir):
    return _judged(spark, sf_dir, "inspect")


@query(_whole_sql("restore"))
def validate_restore(spark, sf_dir):
    return _judged(spark, sf_dir, "restore")


@query(SALVAGE)
def validate_salvage(spark, sf_dir):
    return _judged(spark, sf_dir, "salvage")


# -- records with damaged bytes ---------------------------------------------------------

#: Where a record of each kind is patched, and the rule that this breaks.
PATCHES = {1: (0, "00", "no magic"), 2: (8, "02", "unknown header version"), 3: (9, "07", "unknown channel"), 4: (48, "01", "text field not closed by zeros"), 5: (158, "01", "reserved bytes in use"), 6: (10, "0100", "block size out of range"), 7: (146, "FFFF0000", "payload larger than the block"), 8: (151, "01", "reserved flags in use"), 9: (280, "01", "sideband in use"), 10: (157, "80", "CLEAN_END before the archive end"), 11: (408, "01", "signature on an unsigned frame"), 12: (600, "FF", None), 13: (BLOCK - 1, "01", None)}
DAMAGED = FRAMES + f""", w AS (SELECT global_frame_seq_num AS g, frame_payload_size AS n, false AS fin FROM v UNION ALL SELECT max(global_frame_seq_num) + 1, 0, true FROM v),
q AS (SELECT *, g % 16 AS kind FROM w),
x AS (SELECT g, n, kind, CASE {" ".join(f"WHEN kind = {k}{' AND NOT fin' if k == 10 else ''} THEN '{why}'" for k, (_, _, why) in PATCHES.items() if why)} WHEN kind = 15 THEN 'record shorter than the header' END AS header_error FROM q),
y AS (SELECT g, header_error, CASE WHEN header_error IS NULL THEN kind <> 14 END AS size_ok, CASE WHEN header_error IS NULL THEN kind NOT IN (12, 13, 14) END AS hash_ok,
  CASE WHEN header_error IS NULL THEN kind NOT IN (12, 13, 14) OR (kind = 12 AND n > 88) OR (kind = 13 AND n = {CAPACITY}) END AS padding_ok FROM x)"""


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' archive, its records patched, cut or left as they are by their number."""
    r, kind = F.col("record"), F.col("rec_idx") % 16

    def patched(at: int, data: str) -> Column:
        raw = bytes.fromhex(data)
        return F.concat(F.substring(r, 1, at), F.lit(raw), F.substring(r, at + len(raw) + 1, BLOCK))

    out = F.when(kind == 14, F.substring(r, 1, BLOCK - 1)).when(kind == 15, F.substring(r, 1, 100))
    for k, (at, data, _) in PATCHES.items():
        out = out.when(kind == k, patched(at, data))
    return _archive(spark, sf_dir).withColumn("record", out.otherwise(r))


@query(DAMAGED + " SELECT g, header_error, size_ok, hash_ok, padding_ok FROM y")
def header_errors(spark, sf_dir):
    return fr.check_frames(fr.parse_headers(_damaged(spark, sf_dir))).select(F.col("rec_idx").alias("g"), "header_error", "size_ok", "hash_ok", "padding_ok")


@query(DAMAGED + " SELECT g, CASE WHEN header_error IS NULL AND size_ok AND hash_ok AND padding_ok THEN 'ok' ELSE 'error' END AS status FROM y")
def salvage_frames(spark, sf_dir):
    return reports.frame_report(_damaged(spark, sf_dir), mode="salvage").select(F.col("rec_idx").alias("g"), "status")


@query(FRAMES + "SELECT slice_seq_num, sha256(text) AS digest FROM documents JOIN (SELECT DISTINCT slice_seq_num FROM f) ON doc_id = slice_seq_num")
def restored_slices(spark, sf_dir):
    """Every document comes back from its archive, in restore mode, slice by slice."""
    media = _archive(spark, sf_dir)
    payloads = reports.restorable(media, reports.frame_report(media, mode="salvage"))
    return reports.stream_digests(payloads, ["slice_seq_num"], "global_frame_seq_num", "payload").select(F.col("slice_seq_num").cast("long").alias("slice_seq_num"), "digest")


# -- signatures -------------------------------------------------------------------------

SEED, KEY, DOMAIN = bytes(range(32)), b"keyid..8", b"trial\0"


@F.pandas_udf(T.BinaryType())
def _signed(message):
    from reelframe.functions.ed25519 import sign

    return message.map(lambda m: sign(SEED, bytes(m)))


@query("SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 'unsigned' WHEN 1 THEN 'verified' ELSE 'invalid' END AS with_keys, CASE WHEN s_suppkey % 7 = 0 THEN 'unsigned' WHEN s_suppkey % 7 IN (4, 5) THEN 'invalid' ELSE 'signed_unverified' END AS without_keys, CASE WHEN s_suppkey % 7 = 1 THEN 'verified' ELSE 'invalid' END AS required FROM supplier")
def signature_status(spark, sf_dir):
    """Unsigned, signed well, by an unknown key, tampered with, without a signature, with one too many, under another domain."""
    from reelframe.functions.ed25519 import public_key

    kind, digest = F.col("s_suppkey") % 7, F.sha2("s_name", 256)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.unhex(digest).alias("frame_hash"), kind.alias("kind"))
    good = _signed(F.concat(F.when(F.col("kind") == 6, F.lit(b"other\0")).otherwise(F.lit(DOMAIN)), F.col("frame_hash")))
    torn = F.concat(F.substring("s", 1, 63), F.unhex(F.when(F.hex(F.substring("s", 64, 1)) == "00", "01").otherwise("00")))
    rows = rows.withColumn("s", good)
    whole = F.when(F.col("kind").isin(0, 4), F.lit(bytes(72))).otherwise(F.concat(F.when(F.col("kind") == 2, F.lit(b"unknown!")).otherwise(F.lit(KEY)), F.when(F.col("kind") == 3, torn).otherwise(F.col("s"))))
    rows = rows.select("s_suppkey", "frame_hash", whole.alias("signature"), (~F.col("kind").isin(0, 5)).alias("is_signed"))
    known = spark.createDataFrame([(bytearray(KEY), bytearray(public_key(SEED)))], "key_id binary, public_key binary")
    out = lookups.signatures(rows, known, domain=DOMAIN).withColumnRenamed("signature_status", "with_keys")
    out = lookups.signatures(out, None).withColumnRenamed("signature_status", "without_keys")
    return lookups.signatures(out, known, True, DOMAIN).select("s_suppkey", "with_keys", "without_keys", F.col("signature_status").alias("required"))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 1 THEN 'no comment line' WHEN 2 THEN 'no base64 line' WHEN 3 THEN 'unknown algorithm' WHEN 4 THEN 'text after the base64 line' WHEN 5 THEN 'invalid base64' END AS error, CASE WHEN c_custkey % 6 = 0 THEN c_name END AS comment, CASE WHEN c_custkey % 6 = 0 THEN lower(hex(lpad(c_custkey::VARCHAR, 8, '0'))) END AS key_id FROM customer")
def key_files(spark, sf_dir):
    kind = F.col("c_custkey") % 6
    raw = F.concat(F.when(kind == 3, "Xx").otherwise("Ed"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.lit("k" * 32))
    coded = F.when(kind == 2, "").when(kind == 5, "AAAA").otherwise(F.base64(raw.cast("binary")))
    text = F.concat(F.when(kind == 1, "").otherwise(keys.COMMENT), F.col("c_name"), F.lit("\n"), coded, F.lit("\n"), F.when(kind == 4, "more").otherwise(""))
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.alias("value"))
    ids = rows.select(F.struct("c_custkey", "value").alias("value"))
    return keys.parse_keys(ids.select("value.value", "value.c_custkey"), "value", ["c_custkey"]).select("c_custkey", "error", "comment", names.hex_lower(F.col("key_id")).alias("key_id"))


# -- media written and read back --------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of plain files that all executors share."""
    root = Scratch(spark, name).root
    return root.removeprefix("file://").replace("file:", "", 1) if root.startswith("file:") else root


def _volume(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = _folder(spark, name)
    spool.write_spool(_archive(spark, sf_dir).withColumn("file_num", F.col("file_num") * 2 + 1), path)
    return path


VOLUMES = FRAMES + ", w AS (SELECT global_frame_seq_num AS g, volume_seq_num AS vol, slice_seq_num AS s FROM v UNION ALL SELECT max(global_frame_seq_num) + 1, max(volume_seq_num), 0 FROM v)"


@query(VOLUMES + f" SELECT vol * 2 + 1 AS file_num, printf('NT%06d.NTS', vol * 2 + 1) AS file_name, count(*) AS records, (count(*) * {BLOCK})::BIGINT AS bytes, count(*) - 1 AS last_idx FROM w GROUP BY vol")
def spool_dump(spark, sf_dir):
    """An archive written as a spool directory, dumped to another, and read back in ranges."""
    path = _volume(spark, sf_dir, "spool")
    spool.copy_spool(spark, path, f"{path}-copy")
    return spool.read_spool(spark, f"{path}-copy").groupBy("file_num", "file_name").agg(F.count("*").alias("records"), F.sum("rec_size").alias("bytes"), F.max("rec_idx").alias("last_idx"))


@query(VOLUMES + " SELECT vol * 2 + 1 AS file_num, min(g) AS first_global, arg_min(s, g) AS slice FROM w GROUP BY vol")
def spool_first_records(spark, sf_dir):
    heads = fr.parse_headers(spool.read_spool(spark, _volume(spark, sf_dir, "heads"), "first_record"))
    return heads.select("file_num", F.col("global_frame_seq_num").cast("long").alias("first_global"), F.col("slice_seq_num").cast("long").alias("slice"))


@query(VOLUMES + " SELECT (vol * 2 + 1)::BIGINT AS before, (vol * 2 + 3)::BIGINT AS after FROM (SELECT DISTINCT vol FROM w) WHERE vol < (SELECT max(vol) FROM w)")
def spool_number_gaps(spark, sf_dir):
    return spark.createDataFrame(spool.spool_gaps(_volume(spark, sf_dir, "gaps")), "before long, after long")


@query(VOLUMES + " SELECT g AS ord, s AS slice FROM w")
def pulled_frames(spark, sf_dir):
    """The same volume as a stream, 1,024 windows of 256 frames a micro-batch at most."""
    path, to = _volume(spark, sf_dir, "pull"), Scratch(spark, "pulled").root
    heads = fr.parse_headers(pull.pull_stream(spark, path, windows=pull.WINDOWS)).select("ord", F.col("slice_seq_num").cast("long").alias("slice"))
    running = heads.writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/state").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.parquet(f"{to}/out")


# -- streams ----------------------------------------------------------------------------

EVENTS = """
WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS j FROM events),
b AS (SELECT *, j > 0 AND event_id % 10 = 3 AS again FROM a),
c AS (SELECT *, j - (sum(again::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS g FROM b)"""


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each user as an archive, some sent twice, judged in two micro-batches and more; the sink's rows."""
    own = W.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(own) - 1).cast("long").alias("j"))
    rows = rows.withColumn("again", (F.col("j") > 0) & (F.col("event_id") % 10 == 3))
    g = F.col("j") - F.sum(F.col("again").cast("long")).over(own)
    frames = rows.select(F.col("user_id").cast("string").alias("archive_uuid"), F.col("event_id").alias("ord"), F.lit(1).alias("channel_type"), F.lit(4).alias("volume_block_size_kib"), F.lit(b"").alias("archive_label"), g.cast("decimal(20,0)").alias("global_frame_seq_num"), F.lit(0).cast("decimal(20,0)").alias("slice_seq_num"), g.cast("decimal(20,0)").alias("channel_frame_seq_num"), F.lit(False).alias("is_end"), *(F.lit(True).alias(c) for c in ("size_ok", "hash_ok", "padding_ok")), g.cast("string").cast("binary").alias("norm_hash"), F.lit(None).cast("string").alias("header_error"))
    to = Scratch(spark, "stream").root
    half = frames.agg(F.floor((F.min("ord") + F.max("ord")) / 2)).first()[0] or 0
    for part in (frames.where(F.col("ord") <= half), frames.where(F.col("ord") > half)):
        # a run for each part: the state of the first comes back from the checkpoint
        part.write.mode("append").parquet(f"{to}/in")
        source = stream.table_stream(spark, f"{to}/in", frames.schema.simpleString()[7:-1].replace(":", " "), None)
        stream.run_to_end(stream.fold_stream(source, seeded=False), f"{to}/out", f"{to}/state")
    return spark.read.parquet(f"{to}/out")


@query(EVENTS + " SELECT user_id::VARCHAR AS archive_uuid, event_id AS ord, CASE WHEN again THEN 'replay' ELSE 'ok' END AS status FROM c")
def stream_replays(spark, sf_dir):
    return _stream(spark, sf_dir).select("archive_uuid", "ord", "status")


@query(EVENTS + " SELECT user_id::VARCHAR AS archive_uuid, (max(g) + 1)::BIGINT AS next_seq FROM c GROUP BY user_id")
def stream_high_water(spark, sf_dir):
    return stream.high_water(_stream(spark, sf_dir)).select("archive_uuid", F.col("next_seq").cast("long").alias("next_seq"))


# -- record files -----------------------------------------------------------------------


@query("SELECT n_nationkey AS k, 1::BIGINT AS ord, 'record' AS state, n_name AS record FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT n_nationkey, 1, 'record', n_name FROM nation WHERE n_nationkey % 4 <> 0 UNION ALL SELECT n_nationkey, 2, CASE n_nationkey % 4 WHEN 3 THEN 'malformed' ELSE 'truncated' END, 'x' FROM nation WHERE n_nationkey % 4 <> 0")
def record_states(spark, sf_dir):
    """Files of NUL-LF records, whole, without an end, without the LF, and with another byte in its place."""
    tail = F.get(F.array(F.lit(b""), F.lit(b"x"), F.lit(b"x\0"), F.lit(b"x\0y")), (F.col("n_nationkey") % 4).cast("int"))
    files = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.concat(F.col("n_name").cast("binary"), F.lit(b"\0\n"), tail).alias("bytes"))
    return records.split_records(files).select(F.col("name").cast("long").alias("k"), "ord", "state", F.decode("record", "UTF-8").alias("record"))


OPENING = "/trial-resume/1"


@query("""WITH p AS (SELECT n_nationkey + 1 AS s, n_nationkey // 5 AS v FROM nation),
h(ord, key, value) AS (VALUES (1, NULL, NULL), (2, 'archive_uuid', 'u-1'), (3, 'block_size_kib', '4'), (4, 'sign_key_id', ''), (5, 'plan_blake3', ''), (6, 'archive_name', 'trial'))
SELECT ord::BIGINT AS ord, key, value, NULL::BIGINT AS slice, NULL::BIGINT AS global_seq, NULL::BIGINT AS volume, NULL::VARCHAR AS error FROM h
UNION ALL SELECT 6 + s, 'slice', NULL, s, s * 10, v, NULL FROM p UNION ALL SELECT (SELECT max(s) FROM p) + 7, 'archive_end', NULL, NULL, 999, NULL, NULL""")
def resume_records(spark, sf_dir):
    """A resume file written and parsed; its last record is torn."""
    points = [(r[0] + 1, (r[0] + 1) * 10, r[0] // 5) for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # a nation each
    header = {"archive_uuid": "u-1", "block_size_kib": 4, "sign_key_id": "", "plan_blake3": "", "archive_name": b"trial"}
    raw = records.encode_resume(OPENING, header, points, 999) + b"/slice/9"
    rows = records.parse_resume(records.split_records(spark.createDataFrame([("r", bytearray(raw))], "name string, bytes binary")), OPENING)
    value = F.when(F.col("key").isin(*records.RESUME), F.decode("value", "UTF-8"))
    return rows.select("ord", "key", value.alias("value"), *(F.col(c).cast("long").alias(c) for c in ("slice", "global_seq", "volume")), "error")


# -- functions of names and numbers ------------------------------------------------------

MODES = [0o100644, 0o040755, 0o120777, 0o020666, 0o060660, 0o010600, 0o140755, 0]


@query("SELECT p_partkey, substr('fdlcbps?', (p_partkey % 8)::INTEGER + 1, 1) AS kind, CASE WHEN p_partkey % 8 IN (0, 2) THEN p_size::BIGINT ELSE 0 END AS apparent, p_size * 512::BIGINT AS disk FROM part")
def file_kinds(spark, sf_dir):
    mode = F.get(F.array(*map(F.lit, MODES)), (F.col("p_partkey") % 8).cast("int"))
    size = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", names.kind_of_mode(mode).alias("kind"), names.apparent_bytes(mode, size).cast("long").alias("apparent"), names.disk_bytes(size).cast("long").alias("disk"))


@query("SELECT o_orderkey, CASE WHEN n < 1000 THEN n::VARCHAR WHEN n < 1000000 THEN printf('%.1fk', n / 1000.0) ELSE printf('%.1fM', n / 1000000.0) END AS rate FROM (SELECT o_orderkey, o_orderkey * 100 + 7 AS n FROM orders)")
def count_rates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.count_rate(F.col("o_orderkey") * 100 + 7).alias("rate"))


@query("SELECT p_partkey, printf('-rw-r--r-- %3d %10s %10s %6s [%s] %s', p_size, 'u' || p_size, 'users', p_size || 'K', '2001-02-03 04:05', 'd/' || p_partkey) AS line FROM part")
def pax_lines(spark, sf_dir):
    size = F.col("p_size")
    line = pax.verbose_line(F.lit("-rw-r--r--"), size, F.concat(F.lit("u"), size.cast("string")), F.lit("users"), F.concat(size.cast("string"), F.lit("K")), F.lit("2001-02-03 04:05"), F.concat(F.lit("d/"), F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))


@query("SELECT o_orderkey AS ord, CASE o_orderkey % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'malformed' WHEN 2 THEN 'wrong' ELSE 'ok' END AS ack_state FROM orders")
def ack_answers(spark, sf_dir):
    """Frames sent and their acknowledgements, of which some are missing, short, or of another frame."""
    sent = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("seq"))
    kind = F.col("ord") % 5
    acks = sent.where(kind != 0).select("ord", (F.col("seq") + (kind == 2).cast("long")).alias("seq"), F.when(kind == 1, 4).otherwise(8).alias("length"))
    return lookups.answered(sent, acks).select("ord", "ack_state")


@query("SELECT k, CASE WHEN n = 1 THEN 'f' ELSE 'h' END AS kind, CASE WHEN n = 1 THEN NULL ELSE 'p' || f END AS link FROM (SELECT doc_id AS k, doc_id % 7 AS slice, row_number() OVER w AS n, first_value(doc_id) OVER w AS f FROM documents WINDOW w AS (PARTITION BY lang, n_chars ORDER BY doc_id)) WHERE slice >= 3")
def links_from_slice(spark, sf_dir):
    """Hard links from a slice on, whose first names may be in slices before it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), (F.col("doc_id") % 7).alias("slice"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.lit("f").alias("kind"), F.col("n_chars").alias("size"), F.col("lang").alias("dev"), F.col("n_chars").alias("inode"))
    return lookups.resolve_links(docs, 3).select(F.col("ord").alias("k"), "kind", "link")

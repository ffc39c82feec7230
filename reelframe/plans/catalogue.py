"""Every query of the archive operators, with the same result in SQL.

The tables hold no archive media, so the queries map them: documents in the order of
doc_id are a tree's entries (size: bytes of the text) and, cut into frames, an
archive's content; orders, lineitem and events stand for logs of numbered records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelframe.functions import names, numbers
from reelframe.operators import lookups, packing, reports
from reelframe.operators.build import build_records, with_archive_end
from reelframe.operators.folds import ordered_fold
from reelframe.sources import frames as fr
from reelframe.sources import records, wire

SLICE, BLOCK, VOLUME, TAKEN = 65_536, 4096, 1 << 20, 10_240
CAPACITY = BLOCK - fr.HEADER
UUID, LABEL = "00000000-0000-4000-8000-000000000123", b"tables"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_slices(entries(spark, sf_dir), SLICE, order=["ord"])


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the documents; each document is a slice with one content channel."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slice_seq_num"), F.col("text").alias("data"))
    numbered = packing.number_streams(docs, BLOCK, ["slice_seq_num"])
    return numbered.withColumn("volume_seq_num", packing.volume_of(F.col("global_frame_seq_num"), BLOCK, VOLUME, TAKEN)).withColumn("channel_type", F.lit(fr.CONTENT))


PACK = f"""
WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id AS ord, coalesce(strlen(text), 0)::BIGINT AS size FROM documents),
r(n, slice, file_num, s, k, b) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT
  UNION ALL
  SELECT n, s0, k0, CASE WHEN b0 + size >= {SLICE} THEN s0 + 1 ELSE s0 END, CASE WHEN b0 + size >= {SLICE} THEN 0 ELSE k0 + 1 END, CASE WHEN b0 + size >= {SLICE} THEN 0 ELSE b0 + size END
  FROM (SELECT e.n, e.size, CASE WHEN full_ THEN r.s + 1 ELSE r.s END AS s0, CASE WHEN full_ THEN 0 ELSE r.k END AS k0, CASE WHEN full_ THEN 0 ELSE r.b END AS b0
        FROM (SELECT *, n + 1 AS m FROM r) r JOIN e ON e.n = r.m, LATERAL (SELECT r.k > 0 AND r.b + e.size > {SLICE + SLICE // 2} AS full_))),
p AS (SELECT e.ord, e.size, r.slice, r.file_num FROM e JOIN r USING (n))
"""
FRAMES = f"""
WITH d AS (SELECT doc_id AS slice_seq_num, strlen(text)::BIGINT AS length FROM documents WHERE strlen(text) > 0),
c AS (SELECT slice_seq_num, length, unnest(range(0, (length + {CAPACITY - 1}) // {CAPACITY})) AS channel_frame_seq_num FROM d),
f AS (SELECT slice_seq_num, channel_frame_seq_num, least({CAPACITY}, length - channel_frame_seq_num * {CAPACITY})::BIGINT AS frame_payload_size,
        (channel_frame_seq_num + 1) * {CAPACITY} >= length AS is_end, row_number() OVER (ORDER BY slice_seq_num, channel_frame_seq_num) - 1 AS global_frame_seq_num FROM c),
v AS (SELECT *, (CASE WHEN global_frame_seq_num < {(VOLUME - TAKEN) // BLOCK} THEN 0 ELSE (global_frame_seq_num - {(VOLUME - TAKEN) // BLOCK}) // {VOLUME // BLOCK} + 1 END)::BIGINT AS volume_seq_num FROM f)
"""


@query(PACK + "SELECT ord, size, slice, file_num FROM p")
def slice_pack(spark, sf_dir):
    return packed(spark, sf_dir)


HELD, COST = 7000, 300


@query(PACK.replace("b0 + size >= " + str(SLICE), f"(b0 + size >= {SLICE} OR m0 + cost >= {HELD})").replace("::BIGINT AS size FROM", "::BIGINT AS size, doc_id % 7 * 100 + {COST} AS cost FROM".replace("{COST}", str(COST))).replace("r(n, slice, file_num, s, k, b)", "r(n, slice, file_num, s, k, b, m)").replace("0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT", "0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT").replace("THEN 0 ELSE b0 + size END\n", f"THEN 0 ELSE b0 + size END, CASE WHEN (b0 + size >= {SLICE} OR m0 + cost >= {HELD}) THEN 0 ELSE m0 + cost END\n").replace("e.n, e.size, CASE", "e.n, e.size, e.cost, CASE").replace("ELSE r.b END AS b0", "ELSE r.b END AS b0, CASE WHEN full_ THEN 0 ELSE r.m END AS m0").replace("n + 1 AS m FROM r", "n + 1 AS nn FROM r").replace("e.n = r.m", "e.n = r.nn") + "SELECT ord, size, slice, file_num FROM p")
def slice_pack_memory(spark, sf_dir):
    """Slices that close at their size or at what their entries take in memory."""
    own = entries(spark, sf_dir).withColumn("cost", F.col("ord") % 7 * 100 + COST)
    return packing.pack_slices(own, SLICE, order=["ord"], memory=HELD, cost="cost").drop("cost")


@query(PACK + "SELECT slice, count(*) AS entries, sum(size)::BIGINT AS bytes FROM p GROUP BY slice")
def slice_summary(spark, sf_dir):
    return packing.slice_summary(packed(spark, sf_dir))


@query(PACK + ", t AS (SELECT slice, sum(size)::BIGINT AS bytes FROM p GROUP BY slice) SELECT min(bytes) AS min_bytes, floor(avg(bytes))::BIGINT AS avg_bytes, max(bytes) AS max_bytes, floor(stddev_pop(bytes))::BIGINT AS stddev_bytes FROM t")
def slice_stats(spark, sf_dir):
    return packing.slice_stats(packing.slice_summary(packed(spark, sf_dir)))


@query("SELECT count(*) AS entries, sum(coalesce(strlen(text), 0))::BIGINT AS bytes FROM documents")
def scan_totals(spark, sf_dir):
    return entries(spark, sf_dir).agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


@query(FRAMES + "SELECT slice_seq_num, channel_frame_seq_num, frame_payload_size, is_end FROM f")
def frame_chunk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("slice_seq_num"), F.col("text").alias("data"))
    return packing.cut_frames(docs, BLOCK).drop("payload")


@query(FRAMES + "SELECT slice_seq_num, channel_frame_seq_num, global_frame_seq_num FROM f")
def frame_number(spark, sf_dir):
    return content(spark, sf_dir).select("slice_seq_num", "channel_frame_seq_num", "global_frame_seq_num")


@query(FRAMES + "SELECT global_frame_seq_num, volume_seq_num FROM v")
def volume_assign(spark, sf_dir):
    return content(spark, sf_dir).select("global_frame_seq_num", "volume_seq_num")


@query(FRAMES + "SELECT global_frame_seq_num, CASE WHEN is_end THEN 'E' ELSE '.' END AS flags, 'CH_CONTENT' AS channel, 'content ' AS short FROM f")
def frame_flags(spark, sf_dir):
    f = content(spark, sf_dir)
    none = F.lit(False)
    return f.select("global_frame_seq_num", names.flags_text(F.col("is_end"), none, none).alias("flags"), names.channel_name(F.col("channel_type")).alias("channel"), names.channel_short(F.col("channel_type")).alias("short"))


@query("SELECT l_returnflag AS channel, count(*) AS frames, count(*) FILTER (l_linestatus = 'O') AS signed_frames, count(*) FILTER (l_linestatus <> 'O') AS unsigned_frames, sum(l_quantity::BIGINT)::BIGINT AS payload_bytes FROM lineitem GROUP BY l_returnflag")
def channel_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    signed = F.col("l_linestatus") == "O"
    return rows.groupBy(F.col("l_returnflag").alias("channel")).agg(F.count("*").alias("frames"), F.count_if(signed).alias("signed_frames"), F.count_if(~signed).alias("unsigned_frames"), F.sum(F.col("l_quantity").cast("long")).alias("payload_bytes"))


@query(FRAMES + "SELECT volume_seq_num AS file_num, min(global_frame_seq_num) AS rec_idx, arg_min(slice_seq_num, global_frame_seq_num) AS slice_seq_num, arg_min(channel_frame_seq_num, global_frame_seq_num) AS channel_frame_seq_num FROM v GROUP BY volume_seq_num")
def first_per_file(spark, sf_dir):
    f = content(spark, sf_dir).select(F.col("volume_seq_num").alias("file_num"), F.col("global_frame_seq_num").alias("rec_idx"), "slice_seq_num", "channel_frame_seq_num")
    return reports.first_frames(f)


@query(FRAMES + ", o AS (SELECT volume_seq_num AS file_num, arg_min(slice_seq_num, global_frame_seq_num) AS slice, arg_min(channel_frame_seq_num, global_frame_seq_num) AS c, min(global_frame_seq_num) AS global_seq FROM v GROUP BY volume_seq_num) SELECT file_num, 'slice' AS kind, slice, global_seq, file_num AS volume FROM o WHERE slice > 0 AND c = 0")
def resume_points(spark, sf_dir):
    f = content(spark, sf_dir).select(F.col("volume_seq_num").alias("file_num"), F.col("global_frame_seq_num").alias("rec_idx"), "slice_seq_num", "channel_frame_seq_num", "global_frame_seq_num", "volume_seq_num", "channel_type")
    return reports.resume_points(reports.first_frames(f))


@query("SELECT doc_id AS file_num, lang AS archive_uuid, source AS archive_label, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) = 1 AS new_archive FROM documents")
def archive_distinct(spark, sf_dir):
    first = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_num"), F.col("lang").alias("archive_uuid"), F.col("source").alias("archive_label"))
    return reports.scan_archives(first)


@query("SELECT count(*) AS tape_files, count(DISTINCT (lang, source)) AS archives FROM documents")
def scan_counts(spark, sf_dir):
    first = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_num"), F.col("lang").alias("archive_uuid"), F.col("source").alias("archive_label"))
    return reports.scan_counts(first)


@query("SELECT * FROM (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS gap FROM events) WHERE gap > 0")
def seq_gap_local(spark, sf_dir):
    own = W.partitionBy("user_id").orderBy("event_id")
    gap = F.col("event_id") - F.lag("event_id").over(own) - 1
    return table(spark, sf_dir, "events").select("user_id", "event_id", gap.alias("gap")).where("gap > 0")


@query("""
WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS n FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, n, seq = 0 AS ok, CASE WHEN seq = 0 THEN 1 ELSE 0 END AS expected FROM l WHERE n = 1
  UNION ALL
  SELECT l.l_orderkey, l.l_linenumber, l.n, l.seq = r.expected, CASE WHEN l.seq = r.expected THEN r.expected + 1 ELSE r.expected END FROM r JOIN l ON l.l_orderkey = r.l_orderkey AND l.n = r.n + 1)
SELECT l_orderkey, l_linenumber, ok FROM r
""")
def seq_fold(spark, sf_dir):
    """The cascade: a number that is not the expected one leaves the expectation where it is."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber")

    def step(state: list, row: dict) -> tuple:
        ok = row["l_linenumber"] - 1 == state[0]
        state[0] += ok
        return (ok,)

    adds = T.StructType([T.StructField("ok", T.BooleanType())])
    return ordered_fold(rows, ["l_orderkey"], ["l_shipdate", "l_linenumber"], lambda _: [0], step, adds).drop("l_shipdate")


REPLAY = "WITH e AS (SELECT event_id, user_id, event_type, sha256(props) AS digest, row_number() OVER w > 1 AS later, first_value(sha256(props)) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))"


def _replays(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.sha2("props", 256).alias("digest"))
    return lookups.replays(rows, ["user_id", "event_type"], ["event_id"], "digest")


@query(REPLAY + " SELECT event_id, digest FROM e WHERE NOT later OR digest <> f")
def replay_suppress(spark, sf_dir):
    return _replays(spark, sf_dir).where("NOT replay").select("event_id", "digest")


@query(REPLAY + " SELECT event_id, user_id, event_type FROM e WHERE later AND digest <> f")
def replay_conflict(spark, sf_dir):
    return _replays(spark, sf_dir).where("conflict").select("event_id", "user_id", "event_type")


@query("SELECT * EXCLUDE (l) FROM (SELECT o_custkey, o_orderkey AS ord, month(o_orderdate)::INTEGER AS slice, min(month(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS l FROM orders) WHERE l IS NULL OR l > slice")
def resume_supersede(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("ord"), F.month("o_orderdate").alias("slice"))
    return reports.superseded(points, ["o_custkey"])


@query("SELECT doc_id AS ord, CASE WHEN row_number() OVER w > 1 THEN 'h' ELSE 'f' END AS kind, CASE WHEN row_number() OVER w > 1 THEN 0 ELSE n_chars END AS size FROM documents WINDOW w AS (PARTITION BY lang, n_chars ORDER BY doc_id)")
def hardlink_first(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.lit("f").alias("kind"), F.col("n_chars").alias("size"), F.col("lang").alias("dev"), F.col("n_chars").alias("inode"))
    return lookups.hard_links(own).select("ord", "kind", "size")


@query("SELECT c_custkey, c_nationkey, coalesce(r_name, '') AS owner FROM customer LEFT JOIN region ON c_nationkey = r_regionkey")
def name_lookup(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return lookups.named(customers, table(spark, sf_dir, "region"), "c_nationkey", "owner", "r_regionkey", "r_name").select("c_custkey", "c_nationkey", "owner")


@query("SELECT event_id, CASE WHEN c_custkey IS NULL THEN 'invalid' ELSE 'verified' END AS status FROM events LEFT JOIN (SELECT DISTINCT c_nationkey AS c_custkey FROM customer) ON user_id = c_custkey")
def key_lookup(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("user_id"), F.lit("known").alias("key")).dropDuplicates(["user_id"])
    found = lookups.named(table(spark, sf_dir, "events").select("event_id", "user_id"), keys, "user_id", "found", "user_id", "key")
    return found.select("event_id", F.when(F.col("found") == "", "invalid").otherwise("verified").alias("status"))


@query("SELECT source, sha256(string_agg(text, '' ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def restore_digest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("text").cast("binary").alias("payload"))
    return reports.stream_digests(docs, ["source"], "doc_id", "payload")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 45 AND l_returnflag <> 'R' AND l_linestatus = 'O'")
def salvage_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"size_ok": F.col("l_quantity") <= 45, "hash_ok": F.col("l_returnflag") != "R", "padding_ok": F.col("l_linestatus") == "O"})
    return rows.where("size_ok AND hash_ok AND padding_ok").select("l_orderkey", "l_linenumber")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, max(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events) WHERE seen")
def prefix_skip(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("magic"))
    return reports.after_prefix(rows, F.col("magic"), ["event_id"], ["user_id"]).select("user_id", "event_id")


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' ELSE 'differs' END AS difference FROM (SELECT c_custkey AS k, c_nationkey AS n FROM customer) a FULL JOIN (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.n <> b.n")
def manifest_diff(spark, sf_dir):
    a = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_nationkey AS n")
    b = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS k", "s_nationkey AS n")
    return reports.differences(a, b, "k", ["n"])


@query("SELECT k, 'left' AS side FROM (SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer) UNION ALL SELECT k, 'right' FROM (SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders)")
def ack_audit(spark, sf_dir):
    return reports.unequal_rows(table(spark, sf_dir, "orders").selectExpr("o_custkey AS k"), table(spark, sf_dir, "customer").selectExpr("c_custkey AS k"))


@query("SELECT user_id, event_id, coalesce(event_id = lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1, true) AS in_order FROM events")
def ack_order(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return lookups.acks_in_order(rows.withColumn("at", F.struct("ts", "event_id")), "at", "event_id", ["user_id"]).select("user_id", "event_id", "in_order")


HUMAN = "CASE WHEN v < 1024 THEN n::VARCHAR " + " ".join(f"WHEN v < 1024.0 ** {i + 1} THEN CASE WHEN v / 1024.0 ** {i} < 10 THEN printf('%.1f', v / 1024.0 ** {i}) ELSE printf('%.0f', round(v / 1024.0 ** {i})) END || '{c}'" for i, c in enumerate("KMGTP", 1)) + " END"


@query(f"SELECT l_orderkey, l_linenumber, {HUMAN} AS human FROM (SELECT l_orderkey, l_linenumber, n, n::DOUBLE AS v FROM (SELECT l_orderkey, l_linenumber, (floor(l_extendedprice)::BIGINT * l_quantity::BIGINT * (l_linenumber ** 6)::BIGINT) AS n FROM lineitem))")
def humanize_sizes(spark, sf_dir):
    n = F.floor("l_extendedprice").cast("long") * F.col("l_quantity").cast("long") * F.pow("l_linenumber", F.lit(6)).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.humanize(n).alias("human"))


SUFFIX = ["", "K", "m", "G", "T", "KB", "-", " "]


@query("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_size::BIGINT WHEN 1 THEN p_size * 1024::BIGINT WHEN 2 THEN p_size * 1048576::BIGINT WHEN 3 THEN p_size * 1073741824::BIGINT WHEN 4 THEN p_size * 1099511627776::BIGINT END AS bytes FROM part")
def parse_sizes(spark, sf_dir):
    text = F.concat(F.col("p_size").cast("string"), F.get(F.array(*map(F.lit, SUFFIX)), (F.col("p_partkey") % 8).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.size(text).cast("long").alias("bytes"))


@query("SELECT o_orderkey, o_orderkey::VARCHAR AS digits, CASE WHEN o_orderkey BETWEEN 10 AND 9999 THEN o_orderkey END AS ranged, -o_orderkey AS mtime FROM orders")
def parse_numbers(spark, sf_dir):
    text = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.unsigned(text).cast("string").alias("digits"), numbers.unsigned(F.concat(F.lit("00"), text), 10, 9999).cast("long").alias("ranged"), numbers.signed(F.concat(F.lit("-"), text)).alias("mtime"))


@query("SELECT c_custkey, lower(hex(c_name)) AS hexed, regexp_full_match(lower(hex(c_name)), '[0-9a-f]{36}') AS whole FROM customer")
def hex_names(spark, sf_dir):
    hexed = names.hex_lower(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", hexed.alias("hexed"), names.is_lower_hex(hexed, 36).alias("whole"))


@query("SELECT doc_id, replace(replace(replace(text, '\\', '\\\\'), chr(10), '\\x0a'), chr(9), '\\x09') AS shown FROM documents")
def escape_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", names.escape_display(F.col("text").cast("binary")).alias("shown"))


@query("SELECT o_orderkey, printf('NT%06d.NTS', o_orderkey) AS name, CASE WHEN o_orderkey < 1000000 THEN o_orderkey END AS number, printf('NT%06d.TMP', o_orderkey) AS temporary, printf('s%06d.pax', o_orderkey) AS pax FROM orders")
def spool_names(spark, sf_dir):
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", names.spool_name(n).alias("name"), names.spool_number(F.lower(names.spool_name(n))).alias("number"), names.spool_name(n, "TMP").alias("temporary"), names.slice_file_name(F.lit("s"), n).alias("pax"))


@query("SELECT user_id, event_id, CASE WHEN dt > 0 AND d >= 0 THEN round(d / dt, 6) ELSE 0 END AS rate FROM (SELECT user_id, event_id, value - lag(value) OVER w AS d, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000.0::DOUBLE AS dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))")
def rate_sample(spark, sf_dir):
    own = W.partitionBy("user_id").orderBy("event_id")
    micros = F.unix_micros("ts")
    seconds = (micros - F.lag(micros).over(own)) / F.lit(1_000_000.0)
    rate = numbers.per_second(F.col("value"), F.lag("value").over(own), seconds)
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_id", F.round(rate, 6).alias("rate"))


@query("SELECT p_partkey, CASE WHEN p_size = 0 THEN 0 ELSE least(100, p_partkey * 100 // p_size) END::INTEGER AS percent FROM part")
def buffer_use(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", numbers.buffer_percent(F.col("p_partkey"), F.col("p_size")).alias("percent"))


def _listing(spark, sf_dir):
    placed = packed(spark, sf_dir).withColumns({"kind": F.lit("f"), "mtime": F.col("ord") * 3600, "uid": F.col("ord"), "uname": F.lit(b"u/x"), "gid": F.col("ord") + 1, "gname": F.lit(b"users"), "path": F.concat(F.lit("d/"), F.col("ord").cast("string")).cast("binary")})
    plan = records.encode_plan(placed).select(F.lit("plan").alias("name"), F.col("ord"), F.lit("record").alias("state"), F.expr("substring(record, 1, octet_length(record) - 2)").alias("record"))
    # contiguity is checked by looking back one record in the file's order
    return records.parse_plan(plan)


LISTED = PACK + ", l AS (SELECT ord, slice, file_num, size FROM p)"


@query(LISTED + " SELECT ord, printf('%6d f %14d %s %d/users d/%d', slice, size, strftime(make_timestamp(ord * 3600000000), '%Y-%m-%d %H:%M'), ord, ord) AS line FROM l")
def catalog_listing(spark, sf_dir):
    e = _listing(spark, sf_dir)
    user, group = (names.owner(F.decode(n, "UTF-8"), F.col(i)) for n, i in (("uname", "uid"), ("gname", "gid")))
    line = names.listing_line(F.col("slice").cast("long"), F.col("kind"), F.col("size").cast("long"), names.minute(F.col("mtime")), user, group, names.escape_display("path"))
    return e.where("error IS NULL").select("ord", line.alias("line"))


@query(LISTED + " SELECT slice, count(*) AS entries, sum(size)::BIGINT AS bytes FROM l GROUP BY ROLLUP (slice)")
def catalog_summary(spark, sf_dir):
    s = reports.catalog_summary(_listing(spark, sf_dir))
    return s.select(F.col("slice").cast("long").alias("slice"), "entries", F.col("bytes").cast("long").alias("bytes"))


def _archive(spark, sf_dir):
    frames = with_archive_end(content(spark, sf_dir))
    return build_records(frames, BLOCK, UUID, LABEL).select(F.col("volume_seq_num").alias("file_num"), F.col("global_frame_seq_num").alias("rec_idx"), "record")


@query(FRAMES + """, w AS (SELECT global_frame_seq_num, volume_seq_num, slice_seq_num, channel_frame_seq_num, frame_payload_size, is_end, 1 AS channel_type FROM v
  UNION ALL SELECT max(global_frame_seq_num) + 1, max(volume_seq_num), 0, 0, 0, true, 255 FROM v)
SELECT global_frame_seq_num, volume_seq_num, slice_seq_num, channel_frame_seq_num, frame_payload_size, is_end, channel_type::SMALLINT AS channel_type, true AS size_ok, true AS hash_ok, true AS padding_ok, NULL::VARCHAR AS header_error FROM w""")
def frame_headers(spark, sf_dir):
    """Records built from the documents, hashed, parsed and checked again."""
    checked = fr.check_frames(fr.parse_headers(_archive(spark, sf_dir)))
    wide = ["global_frame_seq_num", "volume_seq_num", "slice_seq_num", "channel_frame_seq_num"]
    return checked.select(*(F.col(c).cast("long").alias(c) for c in wide), "frame_payload_size", "is_end", "channel_type", "size_ok", "hash_ok", "padding_ok", "header_error")


@query(FRAMES + """, t AS (SELECT count(*) AS c, sum(frame_payload_size)::BIGINT AS b, count(DISTINCT volume_seq_num) AS m FROM v), g AS (SELECT count(*) AS gaps FROM (SELECT slice_seq_num, lag(slice_seq_num) OVER (ORDER BY slice_seq_num) AS before FROM (SELECT DISTINCT slice_seq_num FROM f)) WHERE slice_seq_num <> before + 1)
SELECT c + 1 AS total_frames, c AS content_frames, 0::BIGINT AS metadata_frames, 1::BIGINT AS archive_end_frames, m AS tape_files, 0::BIGINT AS signed_frames, c + 1 AS unsigned_frames, 0::BIGINT AS signed_unverified, 0::BIGINT AS signatures_verified, 0::BIGINT AS signature_errors, 0::BIGINT AS replays, 0::BIGINT AS errors, b AS payload_bytes, gaps = 0 AS compliant, gaps = 0 AS complete FROM t, g""")
def inspect_archive(spark, sf_dir):
    """The whole validator over an archive of the documents, which breaks no rule."""
    return reports.inspect_summary(reports.frame_report(_archive(spark, sf_dir)))


@query("SELECT event_id, event_id % 7 + 1 AS type, strlen(props)::BIGINT AS length, props AS payload FROM events")
def message_log(spark, sf_dir):
    """Messages to bytes and back, a log for each event."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 7 + 1).alias("type"), F.col("props").cast("binary").alias("payload"))
    logs = wire.encode_messages(rows).select(F.col("event_id").cast("string").alias("name"), F.col("message").alias("bytes"))
    back = wire.decode_messages(logs).where("error IS NULL")
    return back.select(F.col("name").cast("long").alias("event_id"), F.col("type").cast("long").alias("type"), F.col("length").cast("long").alias("length"), F.decode("payload", "UTF-8").alias("payload"))


@query("SELECT event_type, count(*) AS messages, CASE event_type WHEN 'click' THEN 'NEXT_FRAME' WHEN 'view' THEN 'FRAME_RECORD' WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'ACK_FRAME' ELSE 'UNKNOWN(9)' END AS name FROM events GROUP BY event_type")
def message_names(spark, sf_dir):
    code = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "error", 4).when(F.col("event_type") == "signup", 5).otherwise(9)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("messages")).withColumn("name", names.message_name(code))


@query("WITH c AS (SELECT user_id AS connection, count(*) FILTER (event_type = 'purchase') AS acked FROM events GROUP BY user_id) SELECT sum(acked)::BIGINT AS committed_frames, count(*) AS connections, count(*) FILTER (acked > 0) AS volumes, count(*) FILTER (acked = 0) AS empty_connections FROM c")
def connection_summary(spark, sf_dir):
    log = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("connection")).agg(F.count_if(F.col("event_type") == "purchase").alias("acked"))
    return reports.connection_summary(log)


@query("WITH c AS (SELECT user_id AS connection, count(*) FILTER (event_type = 'purchase' AND value > 20) AS acked FROM events GROUP BY user_id) SELECT connection, acked, coalesce(count(*) FILTER (acked > 0) OVER (ORDER BY connection ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS volume FROM c")
def volume_ordinals(spark, sf_dir):
    log = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("connection")).agg(F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 20)).alias("acked"))
    return reports.volume_ordinals(log)


@query("SELECT l_suppkey AS volume, count(*) AS records, min(l_orderkey) AS first_global, max(l_orderkey) AS last_global, sum(l_quantity::BIGINT)::BIGINT AS bytes FROM lineitem GROUP BY l_suppkey")
def volume_ledger(spark, sf_dir):
    return reports.volume_ledger(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("volume"), F.col("l_orderkey").alias("global"), F.col("l_quantity").cast("long").alias("bytes")))


@query('SELECT l_orderkey AS "global", count(*) AS written FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1')
def retried_records(spark, sf_dir):
    return reports.retried(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("global")))


@query("SELECT s_suppkey AS key, 0 AS source_ord FROM supplier UNION ALL SELECT c_custkey, 1 FROM customer")
def source_concat(spark, sf_dir):
    """Sources in the order of the arguments, each row with its source's number."""
    parts = [table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))]
    return parts[0].withColumn("source_ord", F.lit(0)).unionByName(parts[1].withColumn("source_ord", F.lit(1)))


def queries() -> dict:
    from reelframe.plans import trials  # noqa: F401  its queries join those above

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)

"""URL filters: a sort-merge range join of urls with host and path rules.

A host, its labels turned round and each closed by a dot (``m.example.net`` ->
``net.example.m.``), is a canonical key under which a rule's host and all its
subdomains form one interval of the sorted order; intervals nest or are apart.
Urls and rules are merged into one order and swept once.  The sweep keeps a stack
with one slot for each depth (number of labels): the last rule host passed at that
depth.  A slot is active while its key is a prefix of the row's key; a later rule
host at the same depth replaces it.  Of the active rules whose path starts the
url's path, the longest wins: the longest rule string (host and path together), then
the longest host, then block before allow.

Only DataFrame functions are used.  The sweep is a running window, so a task holds
one row and the stack.  Rows are dealt to sweeps by their place in the input, so a
host, or one url repeated, with a third of all rows is spread evenly; each sweep passes all rule hosts,
which are few next to the pages (``sweeps`` copies of them are made).

Nulls and odd input: a null url, or one without ``://``, has empty host and path and
gets the default verdict; repeated rows are judged one by one; an empty table of
pages gives no rows, an empty table of rules gives all rows the default; rules whose
host or verdict is null are left out, a null path counts as ``/``; other columns of
the inputs are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelframe.llm.common import read

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (host, path, verdict) of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(_part(url, 1), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return _part(url, 2)


def host_key(host: Column) -> Column:
    """Labels in reverse, each closed by a dot: prefixes become intervals."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT, sweeps: int | None = None) -> DataFrame:
    """Judge every row of ``pages``: id, host, path, rule and verdict.

    ``rules`` has host, path and verdict.  ``sweeps``: into how many sorted runs the
    urls are dealt; the session's number of shuffle partitions if not given.
    """
    spark = pages.sparkSession
    n = sweeps or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hosts = (
        rules.where(F.col("host").isNotNull() & F.col("verdict").isNotNull())
        .select(F.translate("host", UPPER, UPPER.lower()).alias("h"), F.coalesce("path", F.lit("/")).alias("p"), F.col("verdict").alias("v"))
        .select(host_key(F.col("h")).alias("key"), F.struct((F.length("h") + F.length("p")).alias("n"), F.length("h").alias("host"), (F.col("v") == "block").alias("blocks"), "p", F.concat("h", "p").alias("rule"), F.col("v").alias("verdict")).alias("r"))
        .groupBy("key")
        .agg(F.sort_array(F.collect_set("r"), asc=False).alias("rs"))
        .withColumn("depth", F.size(F.split("key", r"\.")))
    )
    depths = [r[0] for r in hosts.select("depth").distinct().orderBy("depth").collect()]  # as many as the longest rule host has labels

    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"), F.pmod(F.monotonically_increasing_id(), F.lit(n)).alias("sweep")).withColumn("key", host_key(F.col("host")))
    if not depths:
        return rows.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    spread = hosts.select("key", "rs", "depth", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("sweep"))
    merged = rows.withColumn("is_url", F.lit(True)).unionByName(spread.withColumn("is_url", F.lit(False)), allowMissingColumns=True)
    # a rule host comes before the urls with the same key
    sweep = W.partitionBy("sweep").orderBy("key", "is_url").rowsBetween(W.unboundedPreceding, W.currentRow)
    slots = {f"slot{d}": F.last(F.when(F.col("depth") == d, F.struct("key", "rs")), ignorenulls=True).over(sweep) for d in depths}

    def best(d: int) -> Column:
        slot = F.col(f"slot{d}")
        fits = F.filter(slot["rs"], lambda r: F.col("path").startswith(r["p"]))
        return F.when(F.col("key").startswith(slot["key"]), F.get(fits, F.lit(0)))

    return (
        merged.withColumns(slots)
        .where("is_url")
        .withColumn("won", F.greatest(*(best(d) for d in depths)) if len(depths) > 1 else best(depths[0]))
        .select(F.col("id").alias(id_col), "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES))))
    return judge_urls(read(spark, sf_dir, "pages"), rules)


SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT u.page_id, u.host, u.path, r.h || r.p AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.h || r.p) DESC, length(r.h) DESC, r.verdict = 'block' DESC) AS n
  FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN (SELECT * FROM m WHERE n = 1) m ON u.page_id = m.page_id AND u.host = m.host AND u.path = m.path
"""

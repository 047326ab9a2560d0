"""URL filters as a sort-merge range join, with DataFrame functions only.

A canonical key is a host, with its labels reversed, and a path. What a rule fits on its host is the interval of keys that
begin with the rule's, and on a subdomain the same under the rule's host; so a url is probed under its host and each parent
domain. Rules open and close where their intervals begin and end, and the sweep over the sorted keys keeps the stack of
those that are open: its height is the running sum of openings and closings, and the entry at a height is the rule that
last opened to it. A probe gets the innermost rule, the entry at the height that the sweep has there; prefixes nest, so
that no other entry can be longer. Hot hosts are dealt over several sweeps in proportion to their share of the probes; each
sweep gets the host's rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frozen, heavy_keys, salted_join, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path) of the rules that the registered query applies.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))  # null: neither
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """``www.example.org`` as ``org.example.www``."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as a DataFrame of verdict, host and path."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def intervals(rules: DataFrame) -> DataFrame:
    """(host_key, key, step, entry): where each rule opens (step 1) and closes (step -1) among the paths of its host.

    A key is a path in UTF-8; a rule closes behind all paths that begin with its own, where a byte 0xFF would follow, which
    is in no text. Of rules with equal host and path a blocking one stands.
    """
    host, path = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER), F.coalesce("path", F.lit(""))
    rules = rules.select(reversed_host(host).alias("host_key"), path.alias("path"), "verdict", F.concat(host, path).alias("rule"))
    rules = rules.groupBy("host_key", "path").agg(F.max("verdict").alias("verdict"), F.first("rule").alias("rule"))  # block > allow
    begin = F.encode("path", "UTF-8")
    opens = F.struct(begin.alias("key"), F.lit(1).alias("step"), F.struct("rule", "verdict").alias("entry"))
    closes = F.struct(F.concat(begin, F.unhex(F.lit("FF"))).alias("key"), F.lit(-1).alias("step"), F.lit(None).cast("struct<rule:string,verdict:string>").alias("entry"))
    return rules.select("host_key", F.explode(F.array(opens, closes)).alias("e")).select("host_key", "e.*")


def judged(urls: DataFrame, total: int, rules: DataFrame, spread: int) -> DataFrame:
    """(host, path, rule, verdict) of the distinct (host, path, n) that a rule fits: the longest rule, the longer host at a tie.

    ``total`` is the number of rows of ``urls``.
    """
    events = frozen(intervals(rules))
    hosts = events.select("host_key").distinct()
    depth = hosts.agg(F.max(F.size(F.split("host_key", r"\.")))).first()[0] or 0
    labels = F.reverse(F.split("host", r"\."))
    levels = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, depth))))
    keys = F.transform(levels, lambda n: F.array_join(F.slice(labels, 1, n), "."))
    probes = urls.select("host", "path", F.explode(keys).alias("host_key"))

    share = probes.groupBy("host_key").agg(F.count("*").alias("n")).join(hosts, "host_key", "left_semi")
    sweeps = F.greatest(F.lit(1), F.ceil(F.col("n") * spread / F.lit(max(1, total)))).cast("int")
    dealt = frozen(share.select("host_key", sweeps.alias("sweeps")))
    hot = F.broadcast(dealt.where("sweeps > 1"))  # fewer than ``spread`` for each label of the longest rule's host
    sweep = F.pmod(F.xxhash64("host", "path"), F.coalesce("sweeps", F.lit(1)).cast("long")).cast("int")
    probes = probes.join(hot, "host_key", "left").select("host_key", sweep.alias("sweep"), "host", "path")
    begun = events.join(dealt, "host_key").withColumn("sweep", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1))).drop("sweeps")
    probes = probes.join(begun.select("host_key", "sweep").distinct(), ["host_key", "sweep"], "left_semi")
    probes = probes.select("host_key", "sweep", F.encode("path", "UTF-8").alias("key"), F.lit(0).alias("step"), F.lit(None).cast("struct<rule:string,verdict:string>").alias("entry"), "host", "path")
    swept = begun.unionByName(probes, allowMissingColumns=True).repartition("host_key", "sweep")
    order = [F.col("key"), F.col("step") == 0]  # what opens at a key is open for the probes there
    one, height = Window.partitionBy("host_key", "sweep").orderBy(*order), Window.partitionBy("host_key", "sweep", "height").orderBy(*order)
    swept = swept.withColumn("height", F.sum("step").over(one.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inner = F.last(F.when(F.col("step") == 1, F.col("entry")), ignorenulls=True).over(height.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = swept.withColumn("r", inner).where("step = 0 AND height > 0")
    best = found.groupBy("host", "path").agg(F.max(F.struct(F.length("r.rule").alias("len"), F.length("host_key").alias("host_len"), "r")).alias("best"))
    return best.select("host", "path", F.col("best.r.rule").alias("rule"), F.col("best.r.verdict").alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row, rows that repeat a page_id or a url too.

    A rule fits its host and all subdomains where the url's path starts with the rule's; the longest fitting rule (host
    and path together) decides, else ``otherwise``. Null and empty urls and urls without ``://`` have an empty host and path.
    Urls are taken apart once; distinct hosts with paths are judged and joined back.
    """
    host, path = host_and_path(F.col("url"))
    pages = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    spread = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = frozen(pages)
    urls = frozen(rows.groupBy("host", "path").agg(F.count("*").alias("n")))
    distinct, total = urls.agg(F.count("*"), F.sum("n")).first()
    found = judged(urls, distinct, rules, spread)
    joined = salted_join(rows, found, ["host", "path"], heavy_keys(urls, ["host", "path"], total or 0), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every url of ``pages``."""
    return filter_urls(table(spark, sf_dir, "pages"), rule_frame(spark, RULES))


OP3_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS n
  FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""

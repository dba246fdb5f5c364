"""URL filters by a sort-merge range join over reversed hosts. DataFrame functions only.

A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's path; the longest
rule wins. A host's canonical key is the host reversed with a closing dot, so the hosts under a rule are one interval of
keys, and intervals nest or are disjoint. Distinct hosts and the intervals' ends are sorted together and swept once:
slot d of the stack is the rule host opened last at depth d, and the slots up to the current depth are active. Hosts
are cut into key ranges by the first letters of the key and, within a range, salted by their number; a range's rules go
to each of its salts. Pages then take their host's stack by an equi-join on the host.

Edge cases: a null url or one without "://" has an empty host and path and meets no rule; an empty table gives an empty
one; repeated pages and null ids are judged one by one; ties cannot be, as rules of one length that fit one url are the same
rule; very long urls are judged whole; a column of the pages that is named like an output column is not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from countloom.llm.common import values

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url, both empty if it is null or has no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.reverse(host), F.lit("."))


def active_rules(hosts: DataFrame, rules: DataFrame, prefix: int = 6, per_salt: int = 250_000) -> DataFrame:
    """(host, stack): for each host of `hosts` (column host, distinct) under at least one rule host, the rule hosts
    that hold it, from the shortest to the longest."""
    points = hosts.select("host", host_key(F.col("host")).alias("key")).withColumn("range", F.substring("key", 1, prefix))
    ranges = points.groupBy("range").agg(F.ceil(F.count("*") / per_salt).cast("int").alias("salts"))
    points = points.join(ranges, "range").withColumn("salt", F.pmod(F.xxhash64("host"), F.col("salts")).cast("int"))
    names = rules.select("rule_host").distinct().withColumn("open", host_key(F.col("rule_host")))
    depth = F.length("rule_host") - F.length(F.translate("rule_host", ".", "")) + 1
    names = names.withColumn("close", F.concat(F.reverse("rule_host"), F.lit("/")))  # "/" follows "." in code points
    within = names.withColumn("range", F.substring("open", 1, prefix))
    long = within.where(F.length("open") >= prefix).join(ranges, "range")
    lengths = ranges.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(prefix - 1)))).where(F.length("range") >= F.col("n"))
    short = lengths.withColumn("start", F.substring("range", F.lit(1), F.col("n"))).join(names.where(F.length("open") < prefix), F.col("start") == F.col("open"))
    spread = long.select("range", "salts", "rule_host", "open", "close").unionByName(short.select("range", "salts", "rule_host", "open", "close"))
    spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    nothing = F.lit(None).cast("string")
    closes = spread.select("range", "salt", F.col("close").alias("key"), F.lit(0).alias("kind"), nothing.alias("host"), F.col("rule_host"), F.lit(-1).alias("step"))
    opens = spread.select("range", "salt", F.col("open").alias("key"), F.lit(1).alias("kind"), nothing.alias("host"), F.col("rule_host"), F.lit(1).alias("step"))
    stops = points.select("range", "salt", "key", F.lit(2).alias("kind"), "host", nothing.alias("rule_host"), F.lit(0).alias("step"))
    sweep = Window.partitionBy("range", "salt").orderBy("key", "kind", F.length("rule_host"), "host").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = closes.unionByName(opens).unionByName(stops).withColumn("height", F.sum("step").over(sweep))
    deepest = rules.agg(F.max(depth)).first()[0] or 0  # labels of the longest rule host: the stack's slots
    slots = [F.last(F.when((F.col("kind") == 1) & (F.col("height") == d), F.col("rule_host")), ignorenulls=True).over(sweep).alias(f"slot{d}") for d in range(1, deepest + 1)]
    if not slots:
        return points.select("host", F.array().cast("array<string>").alias("stack")).where("false")
    swept = events.select("*", *slots).where((F.col("kind") == 2) & (F.col("height") > 0))
    return swept.select("host", F.slice(F.array(*[f"slot{d}" for d in range(1, deepest + 1)]), F.lit(1), F.col("height").cast("int")).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", **sizes: int) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page; rules: rule_host, rule_path, rule_verdict. A url under no rule
    gets `default`. `sizes` go to active_rules()."""
    host, path = host_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    stacks = active_rules(seen.select("host").where("host <> ''").distinct(), rules, **sizes)
    # the rules of a stack, with their paths: explode a host's stack, not its pages
    known = rules.groupBy("rule_host").agg(F.collect_set(F.struct(F.length("rule_path").alias("n"), "rule_path", "rule_verdict")).alias("paths"))
    offers = stacks.select("host", F.posexplode("stack").alias("level", "rule_host")).join(known, "rule_host")
    offers = offers.groupBy("host").agg(F.collect_list(F.struct("level", "rule_host", "paths")).alias("offers"))
    fits = F.flatten(F.transform("offers", lambda o: F.transform(
        F.filter(o["paths"], lambda p: F.startswith(F.col("path"), p["rule_path"])),
        lambda p: F.struct((F.length(o["rule_host"]) + p["n"]).alias("n"), o["rule_host"].alias("h"), F.concat(o["rule_host"], p["rule_path"]).alias("rule"), p["rule_verdict"].alias("verdict")))))
    best = F.array_max(fits)
    joined = seen.join(offers, "host", "left").withColumn("best", best)
    return joined.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op7_urls(spark, sf_dir: str) -> DataFrame:
    rules = values(spark, RULES, "rule_host string, rule_path string, rule_verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
    ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), best AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM (SELECT DISTINCT * FROM parts) p JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  GROUP BY ALL
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.page_id IS NOT DISTINCT FROM b.page_id AND p.host = b.host AND p.path = b.path
"""

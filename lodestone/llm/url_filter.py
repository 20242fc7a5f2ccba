"""Operator 6 [native]: URL filters by a sort-merge range join on reversed-host canonical keys.

The key of a rule is its host with the labels reversed, a separator, and its path. All keys that the rule covers on one
host level form the interval from that key to the key followed by the highest character. A url gets one key per
suffix of its host, so a fitting rule's interval holds one of its keys. Rules and keys are sorted together; a sweep
takes the last rule that opened at or before a key, with the stack of rules that enclose that one. Intervals of prefixes
nest or are disjoint, so the first rule of that stack that still holds the key is the longest that fits on this level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.plans.session import table

#: The query's rules: host, path, verdict (fixed values).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path by the contract; both are empty for a null url or one without ``://``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", "url", rest.alias("rest")).select("page_id", "url", host.alias("host"), path.alias("path"))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Each distinct rule with the rules of its host that enclose it, innermost first and itself included: host, path, stack.

    A rule meets its enclosing rules by the prefixes of its path, an equi-join of as many rows as the paths have characters.
    Of equal rules with different verdicts, block stays.
    """
    r = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    prefixes = r.select("host", "path", F.explode(F.expr("transform(sequence(0, length(path)), n -> left(path, n))")).alias("outer_path"))
    outer = r.select("host", F.col("path").alias("outer_path"), F.col("verdict").alias("outer_verdict"))
    entry = F.struct(F.length("outer_path").alias("len"), F.col("outer_path").alias("path"), F.col("outer_verdict").alias("verdict"))
    return prefixes.join(outer, ["host", "outer_path"]).groupBy("host", "path").agg(F.sort_array(F.collect_list(entry), asc=False).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", salts: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``; without a fitting rule, null and ``default``.

    A rule fits its host and the hosts below it, where the path starts with the rule's. The longest host wins, then the
    longest path. Repeated rows give repeated results. Hosts of a third of all rows are dealt over ``salts`` parts
    (the session's shuffle partitions unless given), to each of which the rules go.
    """
    spark = pages.sparkSession
    salts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a url that many rows share is judged once; its rows come back at the end
    urls = with_host_and_path(pages).groupBy("page_id", "url", "host", "path").agg(F.count("*").alias("n"))
    labels = F.split("host", r"\.", -1)
    keys = urls.withColumn("labels", labels).select("page_id", "url", "host", "path", "n", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("level"), "labels")
    keys = keys.withColumn("suffix", F.array_join(F.slice("labels", F.size("labels") - F.col("level") + 1, F.col("level")), ".")).drop("labels")
    back = lambda c: F.array_join(F.reverse(F.split(c, r"\.", -1)), ".")
    points = keys.select(back("suffix").alias("at"), F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int").alias("salt"), F.col("path").alias("sort_path"), F.lit(1).alias("kind"), F.lit(None).cast("array<struct<len:int,path:string,verdict:string>>").alias("stack"), "page_id", "url", "host", "path", "n", "level", "suffix")
    opens = rule_stacks(rules).select(back("host").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("path").alias("sort_path"), F.lit(0).alias("kind"), "stack")
    sweep = Window.partitionBy("at", "salt").orderBy("sort_path", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = points.unionByName(opens, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fit = F.filter("stack", lambda r: F.col("path").startswith(r["path"]))
    hit = swept.withColumn("hit", F.try_element_at(fit, F.lit(1)))
    won = F.when(F.col("hit").isNotNull(), F.struct("level", F.concat("suffix", "hit.path").alias("rule"), F.col("hit.verdict").alias("verdict")))
    best = hit.groupBy("page_id", "url", "host", "path", "n").agg(F.max(won).alias("won"))
    # every copy of a row again
    rows = best.select("*", F.explode(F.expr("sequence(1L, n)")))
    return rows.select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


SQL = """
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""

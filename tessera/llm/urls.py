"""URL filters by host-suffix and path-prefix expressions, with DataFrame functions only.

Each different URL is expanded into every host suffix joined to every path prefix that a rule could have.
Expressions meet rules on a short prefix of their digest; the full digests confirm the match, and the longest
rule decides.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of the digest that URLs and rules are joined on.
PREFIX_DIGITS = 8
#: Rules that are broadcast at most (each under 300 bytes unless paths are longer); more are joined by shuffle.
BROADCAST_RULES = 100_000
#: The rules of the query: (action, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end. Both empty without ://."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (action, host, path) as a table; hosts are given in lower case."""
    return spark.createDataFrame(rules, "action string, host string, path string")


def judged(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id_col, host, path, rule and verdict.

    A rule fits a URL if its host is the URL's host or a parent domain and its path starts the URL's path. The
    rule of most characters wins; of equal ones the longer host, then block, then the greater text. Without a
    rule the verdict is `otherwise`. Null and malformed URLs have empty host and path; repeated rows are kept;
    rules with a null field are ignored; empty tables give empty ones. Other columns of pages are not read.

    Different URLs are expanded once, so a hot URL costs no more than any other, and only into as many labels and path
    characters as rules have, so a long one neither. Rules are broadcast up to BROADCAST_RULES of them. The driver
    holds the different numbers of labels and of path characters of rules.
    """
    rules = rules.dropna().select("action", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    rules = rules.withColumn("digest", F.sha2(F.concat("rule_host", "rule_path").cast("binary"), 256))
    rules = rules.withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    sizes = rules.select(F.length("rule_path").alias("path"), F.size(F.split("rule_host", r"\.")).alias("labels"))
    told = sizes.agg(F.collect_set("path").alias("path"), F.collect_set("labels").alias("labels")).first()
    lengths, depths = sorted(told.path), sorted(told.labels)
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES

    urls = pages.select(F.col(url_col).alias("url")).filter(F.col(url_col).isNotNull()).distinct()
    host, path = host_and_path(F.col("url"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.filter(F.array(*map(F.lit, depths)), lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    expanded = urls.select("url", host.alias("host"), path.alias("path")).select("url", F.explode(pairs).alias("expression")) if lengths else None
    here = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    here = here.select(id_col, "url", host.alias("host"), path.alias("path"))
    if expanded is None:
        return here.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    expanded = expanded.withColumn("own", F.sha2(F.col("expression").cast("binary"), 256)).withColumn("short", F.substring("own", 1, PREFIX_DIGITS))
    matched = expanded.join(F.broadcast(rules) if few else rules, "short").filter("own = digest")
    order = F.struct(F.length("expression").alias("size"), F.length("rule_host").alias("host_size"), (F.col("action") == "block").alias("blocks"), F.concat("rule_host", "rule_path").alias("rule"), "action")
    best = matched.groupBy("url").agg(F.max(order).alias("best"))
    return here.join(best, "url", "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(otherwise)).alias("verdict"))


def rules_query(pages: DataFrame) -> DataFrame:
    """The columns of the query, over its fixed rules."""
    return judged(pages, rule_table(pages.sparkSession, RULES))


ORACLE = """
WITH rules(action, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
parts AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT row_number() OVER () AS rn, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
best AS (SELECT rn, max_by(rh || rp, length(rh || rp)) AS rule, max_by(action, length(rh || rp)) AS action
  FROM cut JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rn)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM cut LEFT JOIN best USING (rn)
"""

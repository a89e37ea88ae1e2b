r"""Operator 13, URL filters, with DataFrame functions alone.

A rule is a host and the start of a path. It fits its host and every subdomain, where the url's path starts with the
rule's. Each url is expanded into expressions, host suffix by path prefix: the suffixes cut at its dots, the prefixes
cut after its slashes and, if rules end inside a segment, at their lengths. The hash prefixes of the expressions, 32
bits of SHA-256, are joined with those of the rules; the full digests confirm what meets. Of the rules that fit, the
longest wins (host and path together), then the one with the longer host, then block before allow. A url that none fits gets the default, allow.

Equal urls are one row while they are expanded and joined, so a page that is listed a million times costs one. The
join is an equi-join that Spark broadcasts only if the rules are small by its own measure, and splits where an
expression such as a whole top-level domain is that of a third of the urls. The best rule of a url is a maximum, combined before
the shuffle. From the rules one row reaches the driver: their most labels, most folders and the lengths of what follows the
last slash; longer expressions fit no rule and are not made, so an url of any length costs what the rules' shape allows. Only the id and
the url of a page are read, never its html.

Defined results: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case, a
user, a port or a dot at its end included; the path goes on to ``?``, ``#`` or the end and may be empty, which no rule with a slash fits. A null url
or one without ``://`` has an empty host and path, fits no rule and gets the default. Rules are lower-cased likewise; a
rule with a null or empty host or another action than allow or block is ignored, a null path is empty, repeated rules
count once. Null and repeated ids and repeated rows are kept, a verdict each; other columns of either table are not
read, whatever their names; no pages give none, and without rules all get the default.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import table

#: Host, path and action of the rules that ``op13_url_filters`` applies.
RULES = "VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')"
ACTIONS, DEFAULT, PREFIX_HEX = ("allow", "block"), "allow", 8
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lowered(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(lowered(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def count_of(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def cut(c: Column, mark: str, n: Column) -> Column:
    """``c`` up to its n-th ``mark``; after it, counted from the end, if n is negative."""
    return F.call_function("substring_index", c, F.lit(mark), n)


def shape(rules: DataFrame) -> tuple[int, int, list[int]]:
    """The most labels of a host and the most slashes of a path, and all lengths of what follows a path's last slash."""
    tail = F.length(cut(F.col("path"), "/", F.lit(-1)))
    row = rules.agg(F.max(count_of(F.col("host"), ".") + 1), F.max(count_of(F.col("path"), "/")), F.sort_array(F.collect_set(tail))).first()
    return row[0] or 0, row[1] or 0, row[2]


def expressions(host: Column, path: Column, labels: int, folders: int, tails: list[int]) -> Column:
    """All host suffixes with all path prefixes that rules of this shape could be, as texts."""
    suffixes = F.transform(F.sequence(F.lit(1), F.least(count_of(host, ".") + 1, F.lit(labels))), lambda i: cut(host, ".", -i))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(count_of(path, "/"), F.lit(folders))), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(cut(path, "/", i), F.lit("/"))))
    if tails != [0]:
        lengths = F.array(*map(F.lit, tails))
        prefixes = F.flatten(F.transform(prefixes, lambda p: F.transform(F.filter(lengths, lambda n: F.length(p) + n <= F.length(path)), lambda n: F.substring(path, F.lit(1), F.length(p) + n))))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", host_col: str = "host", path_col: str = "path", action_col: str = "action", default: str = DEFAULT) -> DataFrame:
    """``(id, host, path, rule, verdict)`` of every page; ``rule`` is null and ``verdict`` the default where none fits."""
    sound = rules.select(lowered(F.col(host_col)).alias("host"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.col(action_col).alias("action")).where((F.col("host") != "") & F.col("action").isin(*ACTIONS)).distinct()
    labels, folders, tails = shape(sound)
    rule = F.concat("host", "path")
    order = F.struct(F.length(rule).alias("length"), F.length("host").alias("host_length"), (F.col("action") == "block").alias("blocks"), rule.alias("rule"), "action")
    listed = sound.select(F.sha2(rule, 256).alias("rule_digest"), order.alias("found")).withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX))
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    each = urls.select("host", "path").distinct().select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), labels, folders, tails)).alias("e"))
    hashed = each.select("host", "path", F.sha2("e", 256).alias("digest")).withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    best = hashed.join(listed, "short").where("digest = rule_digest").groupBy("host", "path").agg(F.max("found").alias("found"))
    return urls.join(best, ["host", "path"], "left").select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.action", F.lit(default)).alias("verdict"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return judge(table(spark, sf_dir, "pages"), spark.sql(RULES).toDF("host", "path", "action"))


OP13_SQL = f"""
WITH rules(rule_host, rule_path, action) AS ({RULES}),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{ascii_uppercase}', '{ascii_lowercase}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
urls AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT host, path, rule_host || rule_path AS rule, action FROM urls
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, action DESC) = 1)
SELECT page_id, host, path, rule, coalesce(action, '{DEFAULT}') AS verdict FROM parts LEFT JOIN best USING (host, path)
"""

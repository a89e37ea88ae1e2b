"""Publishing: package diffs, visible text, text lint, links and their closure, verification, patches."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Lint patterns by name.
LINT = [("mail", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]+"), ("todo", r"\bTODO\b"), ("symbols", r"[*$%#]{3}"), ("bangs", r"!!"), ("long_number", r"[0-9]{12,}")]


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def strip_tags(c: Column) -> Column:
    """Visible text with entities as they are: scripts, styles, comments and images go, tags become spaces."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))


def visible(c: Column) -> Column:
    """Visible text with entities resolved."""
    return unescape(strip_tags(c))


def links(c: Column) -> Column:
    """Relative targets of href and src attributes, without fragments and queries, in order and each once."""
    found = F.regexp_extract_all(c, F.lit(r'(?:href|src)="([^"#?]+)'), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: ~x.rlike(r"^(?:[a-z]+:|//)")))


def diff(base: DataFrame, new: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    """Rows that were added, removed or changed; doubles are compared after rounding."""
    kinds = dict(base.dtypes)
    b = base.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("__b"))
    n = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("__n"))
    at = lambda c, v: F.round(c, digits) if kinds[v] in ("double", "float") else c
    differs = F.lit(False)
    for v in values:
        differs = differs | ~at(F.col(f"old_{v}"), v).eqNullSafe(at(F.col(f"new_{v}"), v))
    change = F.when(F.col("__b").isNull(), "added").when(F.col("__n").isNull(), "removed").when(differs, "changed")
    return b.join(n, keys, "full").withColumn("change", change).where("change is not null").drop("__b", "__n")


def lint(texts: DataFrame, key: str, text: str, patterns: list[tuple[str, str]] = LINT) -> DataFrame:
    """``(key, pattern, match)`` for every match of every pattern."""
    found = F.array(*[F.struct(F.lit(n).alias("pattern"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("m")) for n, p in patterns])
    return texts.select(key, F.explode(found).alias("f")).select(key, "f.pattern", F.explode("f.m").alias("match"))


def verify(manifest: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Manifest against what is live, by size and digest: ok, missing, size or digest."""
    seen = live.select(key, F.col("bytes").alias("live_bytes"), F.col("sha256").alias("live_sha256"))
    state = F.when(F.col("live_sha256").isNull(), "missing").when(F.col("bytes") != F.col("live_bytes"), "size").when(F.col("sha256") != F.col("live_sha256"), "digest").otherwise("ok")
    return manifest.join(seen, key, "left").select(key, state.alias("state"))


def patch(text: Column, find: Column, put: Column) -> Column:
    """``text`` with ``find`` replaced, which must occur exactly once; else an error is raised."""
    n = (F.length(text) - F.length(F.replace(text, find, F.lit("")))) / F.length(find)
    return F.when(n == 1, F.replace(text, find, put)).otherwise(F.raise_error(F.concat(F.lit("FIND must occur once, occurs "), n.cast("int").cast("string"))))

"""Queries of publishing, over raw pages and two derived versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import graphs as G
from ferrule.operators import publish as P
from ferrule.plans import query, table

VISIBLE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
  '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"""


@query(f"SELECT page_id, length({VISIBLE}) AS n_chars, sha256({VISIBLE}) AS digest FROM pages")
def html_visible_text(spark: SparkSession, d: str) -> DataFrame:
    """Visible text of raw pages, entities as they are (C23); the test resolves them too."""
    v = table(spark, d, "pages").select("page_id", P.strip_tags(F.col("html")).alias("t"))
    return v.select("page_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("digest"))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src)="([^"#?]+)', 1)) AS link FROM pages)
SELECT DISTINCT page_id, link FROM l WHERE NOT regexp_matches(link, '^(?:[a-z]+:|//)')""")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    """Relative links, each once."""
    return table(spark, d, "pages").select("page_id", F.explode(P.links(F.col("html"))).alias("link"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, (p_partkey * 7 + p_size) % (SELECT count(*) FROM part) AS dst FROM part WHERE p_size > 5),
c(node, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, depth + 1 FROM c JOIN e ON node = src WHERE depth < 200)
SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM c GROUP BY node""")
def link_closure(spark: SparkSession, d: str) -> DataFrame:
    """What a page reaches over links, breadth first."""
    part = table(spark, d, "part")
    one = part.agg(F.count("*").alias("n"))
    e = part.where("p_size > 5").crossJoin(F.broadcast(one)).select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + F.col("p_size")) % F.col("n")).alias("dst"))
    return G.closure(e, spark.range(1).select(F.col("id").alias("node")))


@query("WITH " + r"""t AS (SELECT page_id, """ + VISIBLE + r""" AS t FROM pages),
m AS (SELECT page_id, 'mail' AS pattern, unnest(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]+')) AS match FROM t
UNION ALL SELECT page_id, 'todo', unnest(regexp_extract_all(t, '\bTODO\b')) FROM t UNION ALL SELECT page_id, 'symbols', unnest(regexp_extract_all(t, '[*$%#]{3}')) FROM t
UNION ALL SELECT page_id, 'bangs', unnest(regexp_extract_all(t, '!!')) FROM t UNION ALL SELECT page_id, 'long_number', unnest(regexp_extract_all(t, '[0-9]{12,}')) FROM t)
SELECT page_id, pattern, count(*) AS n, min(match) AS first FROM m GROUP BY ALL""")
def text_lint(spark: SparkSession, d: str) -> DataFrame:
    """Named patterns over visible text."""
    t = table(spark, d, "pages").select("page_id", P.strip_tags(F.col("html")).alias("t"))
    return P.lint(t, "page_id", "t").groupBy("page_id", "pattern").agg(F.count("*").alias("n"), F.min("match").alias("first"))


@query("""WITH b AS (SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_orderkey % 10 <> 3 GROUP BY 1),
n AS (SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice * CASE WHEN l_partkey % 50 = 0 THEN 1.1 ELSE 1 END), 2) AS total FROM lineitem WHERE l_orderkey % 10 <> 4 GROUP BY 1)
SELECT coalesce(b.l_orderkey, n.l_orderkey) AS l_orderkey, CASE WHEN b.l_orderkey IS NULL THEN 'added' WHEN n.l_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change,
  round(b.total, 1) AS old_total, round(n.total, 1) AS new_total FROM b FULL JOIN n ON b.l_orderkey = n.l_orderkey
WHERE b.l_orderkey IS NULL OR n.l_orderkey IS NULL OR b.n <> n.n OR abs(b.total - n.total) > 0.05""")
def package_diff(spark: SparkSession, d: str) -> DataFrame:
    """A keyed diff of two versions."""
    x = table(spark, d, "lineitem")
    b = x.where("l_orderkey % 10 <> 3").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    more = F.when(F.col("l_partkey") % 50 == 0, 1.1).otherwise(1.0)
    n = x.where("l_orderkey % 10 <> 4").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * more), 2).alias("total"))
    got = P.diff(b, n, ["l_orderkey"], ["n", "total"], digits=1)
    return got.select("l_orderkey", "change", F.round("old_total", 1).alias("old_total"), F.round("new_total", 1).alias("new_total"))


@query("""WITH m AS (SELECT page_id, strlen(html) AS bytes, sha256(html) AS sha256 FROM pages),
l AS (SELECT page_id, strlen(h) AS bytes, sha256(h) AS sha256 FROM (SELECT page_id, CASE WHEN page_id % 9 = 1 THEN html || ' ' WHEN page_id % 9 = 2 THEN upper(left(html, 1)) || 'x' || substr(html, 3) ELSE html END AS h FROM pages WHERE page_id % 9 <> 0))
SELECT page_id, CASE WHEN l.page_id IS NULL THEN 'missing' WHEN m.bytes <> l.bytes THEN 'size' WHEN m.sha256 <> l.sha256 THEN 'digest' ELSE 'ok' END AS state FROM m LEFT JOIN l USING (page_id)""")
def verify_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of sizes and digests against what is live."""
    entry = lambda df, c: df.select("page_id", F.octet_length(c).alias("bytes"), F.sha2(c, 256).alias("sha256"))
    pages = table(spark, d, "pages")
    other = F.when(F.col("page_id") % 9 == 1, F.concat("html", F.lit(" "))).when(F.col("page_id") % 9 == 2, F.concat(F.upper(F.substring("html", 1, 1)), F.lit("x"), F.expr("substr(html, 3)"))).otherwise(F.col("html"))
    live = pages.where("page_id % 9 <> 0").select("page_id", other.alias("html"))
    return P.verify(entry(pages, "html"), entry(live, "html"), "page_id")


NEEDS_SQL = """n AS (SELECT count(*) AS n FROM part),
e AS (SELECT p_partkey AS node, (p_partkey * 7 + p_size) % n AS needs FROM part, n WHERE p_size > 12 AND (p_partkey * 7 + p_size) % n < p_partkey
  UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_size % 3 = 0 AND p_partkey > 0 UNION SELECT p_partkey, p_partkey + 1 FROM part, n WHERE p_partkey % 97 = 5 AND p_partkey + 1 < n
  UNION SELECT p_partkey + 1, p_partkey FROM part, n WHERE p_partkey % 97 = 5 AND p_partkey + 1 < n)"""


def needs(part: DataFrame) -> DataFrame:
    """What parts need: earlier ones, and some pairs each other."""
    one = part.agg(F.count("*").alias("n"))
    k, rows = F.col("p_partkey"), part.crossJoin(F.broadcast(one))
    to = F.pmod(k * 7 + F.col("p_size"), F.col("n"))
    pairs = rows.where((k % 97 == 5) & (k + 1 < F.col("n")))
    each = [rows.where((F.col("p_size") > 12) & (to < k)).select(k.alias("node"), to.alias("needs")), rows.where((F.col("p_size") % 3 == 0) & (k > 0)).select(k.alias("node"), F.floor(k / 2).alias("needs"))]
    each += [pairs.select(k.alias("node"), (k + 1).alias("needs")), pairs.select((k + 1).alias("node"), k.alias("needs"))]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3]).distinct()


@query(f"""WITH RECURSIVE {NEEDS_SQL}, c(node) AS (SELECT node FROM e a WHERE EXISTS (FROM e b WHERE b.node = a.needs AND b.needs = a.node AND abs(a.node - a.needs) = 1) UNION SELECT e.node FROM e JOIN c ON e.needs = c.node),
l(node, layer) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey NOT IN (SELECT node FROM e) UNION SELECT e.node, layer + 1 FROM l JOIN e ON e.needs = l.node WHERE e.node NOT IN (FROM c))
SELECT node, CAST(max(layer) AS BIGINT) AS layer FROM l WHERE node NOT IN (FROM c) GROUP BY node""")
def dependency_layers(spark: SparkSession, d: str) -> DataFrame:
    """The order of parts after what they need, in layers; those in or behind a cycle have none."""
    part = table(spark, d, "part")
    return G.layers(part.select(F.col("p_partkey").alias("node")), needs(part))[0]


@query()
def dependency_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Parts that cannot come: in a cycle, named by its least part, or waiting for one (E10); tests hold it against a plain search."""
    part = table(spark, d, "part")
    return G.layers(part.select(F.col("p_partkey").alias("node")), needs(part))[1]

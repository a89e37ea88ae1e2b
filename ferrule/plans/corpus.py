"""Queries of corpus assembly: records from several places, text assembly, predicates over ids and titles, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.operators import ordered as O
from ferrule.operators import search as S
from ferrule.operators.retrieval import prefer
from ferrule.plans import query, table


def first_line(c: str = "text"):
    return F.regexp_extract(c, r"^([^\n]*)", 1)


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '([a-z])-\n([a-z])', '\1\2', 'g'), '([0-9]) +([.,]) *([0-9])', '\1\2\3', 'g'), '[ \t\r\n]+', ' ', 'g') AS norm FROM documents""")
def fts_text_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts in lower case, with the words and numbers joined that line breaks and spaces split; for all rules of X9 see ``fts_normalise``."""
    c = F.lower("text")
    for pattern, put in ((r"([a-z])-\n([a-z])", "$1$2"), (r"([0-9]) +([.,]) *([0-9])", "$1$2$3"), (r"[ \t\r\n]+", " ")):
        c = F.regexp_replace(c, pattern, put)
    return table(spark, d, "documents").select("doc_id", c.alias("norm"))


@query()
def fts_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with NFKC and the ordered join and split rules before indexing."""
    return table(spark, d, "documents").select("doc_id", X.fts_normal("text").alias("norm"))


@query(r"""WITH t AS (SELECT doc_id, list_distinct(
  list_transform(regexp_extract_all(text, '(\d(?:\.\d+)?)([A-Za-z]{1,2})(\d+(?:\.\d+)?)'), lambda m: regexp_replace(m, '(\d(?:\.\d+)?)([A-Za-z]{1,2})(\d+(?:\.\d+)?)', '\1 \2 \3'))
  || list_transform(regexp_extract_all(text, '\b(E|Fe)\s+(\d{3})\b'), lambda m: regexp_replace(m, '(E|Fe)\s+(\d{3})', '\1\2')) || list_transform(regexp_extract_all(text, '\b[kK]\s*([1-4])\b'), lambda m: 'k' || m[-1])) AS x FROM documents)
SELECT doc_id, array_to_string(list_sort(x), ' ') AS extra FROM t WHERE len(x) > 0""")
def fts_extra_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Extra tokens of glued and spaced forms, each once."""
    x = table(spark, d, "documents").select("doc_id", S.extra_tokens(F.col("text")).alias("x")).where(F.size("x") > 0)
    return x.select("doc_id", F.array_join(F.array_sort("x"), " ").alias("extra"))


@query(r"""SELECT 'doc:' || doc_id AS rec_id, 'page' AS kind, coalesce(source, '') AS collection, length(text) AS n FROM documents WHERE length(text) >= 40
UNION ALL SELECT 'item:' || item_id, 'question', '', length(text) FROM benchmark
UNION ALL SELECT 'conv:' || conv_id || ':' || turn, 'turn', role, length(text) FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) = 1""")
def fts_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the full-text index: a union of kinds with admission filters and deduplication."""
    n = F.length("text").cast("long").alias("n")
    a = table(spark, d, "documents").where(F.length("text") >= 40).select(F.concat(F.lit("doc:"), "doc_id").alias("rec_id"), F.lit("page").alias("kind"), F.coalesce("source", F.lit("")).alias("collection"), n)
    b = table(spark, d, "benchmark").select(F.concat(F.lit("item:"), "item_id").alias("rec_id"), F.lit("question").alias("kind"), F.lit("").alias("collection"), n)
    c = table(spark, d, "conversations").withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "text").orderBy("turn"))).where("r = 1")
    c = c.select(F.concat(F.lit("conv:"), "conv_id", F.lit(":"), "turn").alias("rec_id"), F.lit("turn").alias("kind"), F.col("role").alias("collection"), n)
    return a.unionByName(b).unionByName(c)


@query(r"""WITH l AS (SELECT doc_id, regexp_extract(text, '^([^\n]*)', 1) AS t FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(t, '^[A-Z][^|]*\.$') AND length(t) <= 200 THEN 'title' WHEN regexp_matches(t, '^[0-9]') THEN 'numbered' WHEN regexp_matches(t, '\|') THEN 'table' WHEN length(trim(t)) = 0 THEN 'blank' ELSE 'text' END AS kind,
  CAST(len(regexp_extract_all(t, '[A-Z]')) AS DOUBLE) / greatest(len(regexp_extract_all(t, '[A-Za-z]')), 1) > 0.5 AS shouting FROM l""")
def title_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Whether a first line is a title, a row or a running head."""
    t = F.col("t")
    kind = F.when(t.rlike(r"^[A-Z][^|]*\.$") & (F.length(t) <= 200), "title").when(t.rlike("^[0-9]"), "numbered").when(t.contains("|"), "table").when(F.length(F.trim(t)) == 0, "blank").otherwise("text")
    share = F.regexp_count(t, F.lit("[A-Z]")) / F.greatest(F.regexp_count(t, F.lit("[A-Za-z]")), F.lit(1))
    return table(spark, d, "documents").select("doc_id", first_line().alias("t")).select("doc_id", kind.alias("kind"), (share > 0.5).alias("shouting"))


@query(r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '[*$%#]{3}') THEN 'symbols' END, CASE WHEN regexp_matches(text, '!!') THEN 'bangs' END,
  CASE WHEN length(text) < 20 THEN 'husk' END, CASE WHEN contains(text, ' | ') THEN 'cells' END], lambda x: x IS NOT NULL), ',') AS issues FROM documents""")
def issue_tags(spark: SparkSession, d: str) -> DataFrame:
    """Issue tags of a record, and husks."""
    tags = F.array_compact(F.array(F.when(F.col("text").rlike(r"[*$%#]{3}"), "symbols"), F.when(F.col("text").contains("!!"), "bangs"), F.when(F.length("text") < 20, "husk"), F.when(F.col("text").contains(" | "), "cells")))
    return table(spark, d, "documents").select("doc_id", F.array_join(tags, ",").alias("issues"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
c AS (SELECT doc_id, pos, line, list(line) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS nxt FROM l)
SELECT doc_id, pos, sha256(array_to_string([line] || coalesce(nxt, []), ' ')) AS caption FROM c WHERE regexp_matches(line, '^(The|Die|Le|La) ')""")
def caption_lookahead(spark: SparkSession, d: str) -> DataFrame:
    """A line with the six that follow it, whole (C8); ``table_captions`` has the rule."""
    l = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))  # noqa: E741
    ahead = F.collect_list("line").over(Window.partitionBy("doc_id").orderBy("p").rowsBetween(1, 6))
    c = l.withColumn("next", ahead).where(F.col("line").rlike("^(The|Die|Le|La) "))
    return c.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), F.sha2(F.array_join(F.concat(F.array("line"), "next"), " "), 256).alias("caption"))


@query("""WITH s AS (SELECT source, doc_id, lang, n_chars FROM documents),
w AS (SELECT source, doc_id, lang, list(lang) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS nxt,
  min(CASE WHEN n_chars > 5000 THEN doc_id END) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ends FROM s)
SELECT doc_id, array_to_string(coalesce(nxt, []), ',') AS terminators, ends FROM w""")
def clause_windows(spark: SparkSession, d: str) -> DataFrame:
    """The ids that may end a clause, and the first later page that does."""
    rows = table(spark, d, "documents").select("source", "doc_id", "lang", "n_chars")
    got = O.following(rows, ["source"], "doc_id", "lang", 6, F.col("n_chars") > 5000)
    return got.select("doc_id", F.array_join("after", ",").alias("terminators"), "ends")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber AS page, CASE WHEN l_quantity > 25 THEN l_partkey END AS id FROM lineitem GROUP BY ALL),
b AS (SELECT l_orderkey, id, min(page) AS lo, max(page) AS hi FROM t WHERE id IS NOT NULL GROUP BY ALL)
SELECT b.l_orderkey, b.id, count(*) AS n_between FROM b JOIN t ON t.l_orderkey = b.l_orderkey AND t.id IS NULL AND t.page > lo AND t.page < hi GROUP BY ALL""")
def adjacent_null_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables without an id between the first and last page of one."""
    t = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page"), F.when(F.col("l_quantity") > 25, F.col("l_partkey")).alias("id")).distinct()
    b = t.where("id is not null").groupBy("l_orderkey", "id").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    return b.join(t.where("id is null").select("l_orderkey", "page"), "l_orderkey").where("page > lo and page < hi").groupBy("l_orderkey", "id").agg(F.count("*").alias("n_between"))


@query("""WITH a AS (SELECT p_partkey, p_size, p_type FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey, p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS p_size, upper(p_brand) AS p_type FROM part WHERE p_partkey % 3 <> 0)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, coalesce(b.p_size, a.p_size) AS p_size, coalesce(b.p_type, a.p_type) AS p_type, a.p_type AS converted_type,
  CASE WHEN a.p_partkey IS NULL THEN 'second' WHEN b.p_partkey IS NULL THEN 'first' WHEN a.p_size = b.p_size THEN 'both' ELSE 'differs' END AS origin FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""")
def recovered_overlay(spark: SparkSession, d: str) -> DataFrame:
    """A second reading laid over the first, both kept where they differ."""
    p = table(spark, d, "part")
    a = p.where("p_partkey % 5 <> 0").select("p_partkey", F.col("p_size").alias("s1"), F.col("p_type").alias("converted_type"), F.lit(1).alias("a"))
    b = p.where("p_partkey % 3 <> 0").select("p_partkey", (F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)).alias("s2"), F.upper("p_brand").alias("t2"), F.lit(1).alias("b"))
    origin = F.when(F.col("a").isNull(), "second").when(F.col("b").isNull(), "first").when(F.col("s1") == F.col("s2"), "both").otherwise("differs")
    return a.join(b, "p_partkey", "full").select("p_partkey", F.coalesce("s2", "s1").alias("p_size"), F.coalesce("t2", "converted_type").alias("p_type"), "converted_type", origin.alias("origin"))


@query("""WITH f AS (SELECT url, CASE WHEN contains(url, '..') THEN 'unsafe' WHEN regexp_matches(url, '#') THEN 'ignored' WHEN regexp_matches(url, '^https://') THEN 'take' ELSE 'plain' END AS verdict,
  regexp_extract(url, '^https?://([^/]+)', 1) AS prefix FROM pages)
SELECT prefix, verdict, count(*) AS n, min(url) AS first FROM f GROUP BY ALL""")
def import_plan(spark: SparkSession, d: str) -> DataFrame:
    """Which members of an import are taken, ignored or refused."""
    u = F.col("url")
    verdict = F.when(u.contains(".."), "unsafe").when(u.contains("#"), "ignored").when(u.startswith("https://"), "take").otherwise("plain")
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("prefix"), verdict.alias("verdict")).agg(F.count("*").alias("n"), F.min("url").alias("first"))


@query("""WITH s(prefix) AS (VALUES ('http://'), ('https://'), ('http://t'), ('https://m.'), ('https://t'))
SELECT page_id, url, arg_max(prefix, length(prefix)) AS source FROM pages JOIN s ON starts_with(url, prefix) GROUP BY page_id, url""")
def longest_prefix_source(spark: SparkSession, d: str) -> DataFrame:
    """The longest source root that a path begins with."""
    roots = sorted(["http://", "https://", "http://t", "https://m.", "https://t"], key=len, reverse=True)
    found = F.coalesce(*[F.when(F.col("url").startswith(r), F.lit(r)) for r in roots])
    return table(spark, d, "pages").select("page_id", "url", found.alias("source")).where("source is not null")


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"#?]+)', 1)) AS link FROM pages), k AS (SELECT DISTINCT '/' || regexp_extract(text, '^(\S+)', 1) AS link FROM documents)
SELECT DISTINCT page_id, link FROM l WHERE link NOT IN (SELECT link FROM k)""")
def dangling_links(spark: SparkSession, d: str) -> DataFrame:
    """Links to what is not there."""
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="(/[^"#?]+)'), F.lit(1))).alias("link")).distinct()
    known = table(spark, d, "documents").select(F.concat(F.lit("/"), F.regexp_extract("text", r"^(\S+)", 1)).alias("link")).distinct()
    return links.join(known, "link", "left_anti").select("page_id", "link")


@query("""WITH q AS (SELECT p_partkey, p_name, p_type, p_size, p_brand IN ('Brand#3', 'Brand#4') AS in_chapter, count(*) FILTER (p_brand IN ('Brand#3', 'Brand#4')) OVER (PARTITION BY p_type, p_size) AS n FROM part)
SELECT p_type, p_size, p_partkey FROM q WHERE n = 0 OR in_chapter""")
def chapter_post_filter(spark: SparkSession, d: str) -> DataFrame:
    """A filter that applies only where something survives it."""
    return prefer(table(spark, d, "part"), ["p_type", "p_size"], F.col("p_brand").isin("Brand#3", "Brand#4")).select("p_type", "p_size", "p_partkey")


@query("""WITH u AS (SELECT 1 AS src, row_number() OVER (ORDER BY p_partkey) AS pos, p_partkey AS id FROM part WHERE p_name LIKE '%bolt%'
UNION ALL SELECT 2, row_number() OVER (ORDER BY s_suppkey), s_suppkey FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 3, row_number() OVER (ORDER BY c_custkey), c_custkey FROM customer WHERE c_acctbal < 0),
r AS (SELECT *, row_number() OVER (ORDER BY src, pos) AS rank FROM u) SELECT src, id, rank FROM r WHERE rank <= 400""")
def early_exit_scans(spark: SparkSession, d: str) -> DataFrame:
    """Three sources in order up to a limit; each gives no more than the limit before they meet."""
    part = table(spark, d, "part").where(F.col("p_name").contains("bolt")).select(F.lit(1).alias("src"), F.col("p_partkey").alias("id"))
    sup = table(spark, d, "supplier").where("s_acctbal < 0").select(F.lit(2).alias("src"), F.col("s_suppkey").alias("id"))
    cus = table(spark, d, "customer").where("c_acctbal < 0").select(F.lit(3).alias("src"), F.col("c_custkey").alias("id"))
    few = part.orderBy("id").limit(400).unionByName(sup.orderBy("id").limit(400)).unionByName(cus.orderBy("id").limit(400))
    return few.withColumn("rank", F.row_number().over(Window.orderBy("src", "id")).cast("long")).where("rank <= 400")


@query(r"""WITH b AS (SELECT source, doc_id, text, n_chars FROM documents WHERE n_chars BETWEEN 20 AND 200)
SELECT source, arg_max(text, (n_chars, -doc_id)) AS chosen, count(*) AS n FROM b GROUP BY source""")
def candidate_choice(spark: SparkSession, d: str) -> DataFrame:
    """The longest candidate of 200 characters at most, then the first."""
    b = table(spark, d, "documents").where("n_chars between 20 and 200")
    return b.groupBy("source").agg(F.max_by("text", F.struct("n_chars", -F.col("doc_id"))).alias("chosen"), F.count("*").alias("n"))


@query(r"""SELECT doc_id, coalesce(nullif(trim(left(regexp_replace(trim(regexp_extract(text, '^([^\n]*)', 1)), '[^A-Za-z0-9_-]+', '_', 'g'), 80), '_-'), ''), 'Project') AS safe_name FROM documents""")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of jobs out of titles, 80 characters at most, which is the feature; one without a letter has the default (C20)."""
    c = F.trim(F.substring(F.regexp_replace(F.trim(first_line()), "[^A-Za-z0-9_-]+", "_"), 1, 80), F.lit("_-"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.nullif(c, F.lit("")), F.lit("Project")).alias("safe_name"))


@query(r"""SELECT item_id, left(concat_ws('; ', CASE WHEN regexp_matches(text, '[0-9]') THEN 'numbers' END, CASE WHEN length(text) > 300 THEN 'long question' END,
  'asked: ' || regexp_extract(text, '^(\S+)', 1)), 400) AS note FROM benchmark""")
def miss_notes(spark: SparkSession, d: str) -> DataFrame:
    """A note on a miss, from what applies (F32)."""
    note = F.concat_ws("; ", F.when(F.col("text").rlike("[0-9]"), "numbers"), F.when(F.length("text") > 300, "long question"), F.concat(F.lit("asked: "), F.regexp_extract("text", r"^(\S+)", 1)))
    return table(spark, d, "benchmark").select("item_id", F.substring(note, 1, 400).alias("note"))


@query(r"""WITH t(town, ord) AS (VALUES ('est', 1), ('hand', 2), ('schein', 3)),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
h AS (SELECT town, doc_id, pos, line, row_number() OVER (PARTITION BY town ORDER BY doc_id, pos) AS rank FROM t JOIN l ON contains(' ' || regexp_replace(lower(line), '[^\p{L}]', ' ', 'g') || ' ', ' ' || town || ' '))
SELECT town, rank, doc_id, line AS snippet FROM h WHERE rank <= 20""")
def town_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Lines that name a town as a whole word."""
    l = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))  # noqa: E741
    towns = F.array(*[F.when(F.lower("line").rlike(rf"(?<!\p{{L}}){t}(?!\p{{L}})"), t) for t in ("est", "hand", "schein")])
    h = l.select("doc_id", "p", "line", F.explode(F.array_compact(towns)).alias("town"))
    rank = F.row_number().over(Window.partitionBy("town").orderBy("doc_id", "p")).cast("long")
    return h.withColumn("rank", rank).where("rank <= 20").select("town", "rank", "doc_id", F.col("line").alias("snippet"))


@query("""WITH d AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1), l AS (SELECT source, count(*) AS labelled, count(*) FILTER (quality = 0) AS bad FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, docs, coalesce(labelled, 0) AS labelled, coalesce(bad, 0) AS bad, CASE WHEN coalesce(bad, 0) * 5 > coalesce(labelled, 0) THEN 'WARN' WHEN labelled IS NULL THEN 'SKIP' ELSE 'PASS' END AS verdict FROM d LEFT JOIN l USING (source)""")
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts joined per document set, and a verdict."""
    docs, labels = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels")
    a = docs.groupBy("source").agg(F.count("*").alias("docs"))
    b = docs.join(labels, "doc_id").groupBy("source").agg(F.count("*").alias("labelled"), F.count_if(F.col("quality") == 0).alias("bad"))
    verdict = F.when(F.coalesce("bad", F.lit(0)) * 5 > F.coalesce("labelled", F.lit(0)), "WARN").when(F.col("labelled").isNull(), "SKIP").otherwise("PASS")
    return a.join(b, "source", "left").select("source", "docs", F.coalesce("labelled", F.lit(0)).alias("labelled"), F.coalesce("bad", F.lit(0)).alias("bad"), verdict.alias("verdict"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\n]+')) AS BIGINT) AS n_lines, regexp_replace(regexp_replace(text, '\n{2,}', chr(10), 'g'), '(?m)^(\S+)$', '## \1', 'g') AS body FROM documents""")
def body_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Whole body text with one-word lines promoted to headings."""
    body = F.regexp_replace(F.regexp_replace("text", r"\n{2,}", "\n"), r"(?md)^(\S+)$", "## $1")
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[^\n]+")).cast("long").alias("n_lines"), body.alias("body"))


@query(r"""SELECT doc_id, concat_ws(chr(10) || chr(10), left(nullif(trim(lang), ''), 10), nullif(regexp_extract(text, '([0-9]{4,})', 1), ''), 'src ' || source) AS eq_text FROM documents""")
def equation_text(spark: SparkSession, d: str) -> DataFrame:
    """A record's text out of the parts it has."""
    out = F.concat_ws("\n\n", F.substring(F.nullif(F.trim("lang"), F.lit("")), 1, 10), F.nullif(F.regexp_extract("text", "([0-9]{4,})", 1), F.lit("")), F.concat(F.lit("src "), "source"))
    return table(spark, d, "documents").select("doc_id", out.alias("eq_text"))

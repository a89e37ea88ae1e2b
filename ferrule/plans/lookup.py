"""Queries of exact lookup: parts are filed records, brands, types and names what is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.operators import lookup as L
from ferrule.operators import retrieval as R
from ferrule.operators.retrieval import cascade
from ferrule.plans import query, table


@query("""WITH q AS (SELECT DISTINCT lower(replace(p_brand, '#', ' ')) AS asked, p_type AS scope FROM part),
h AS (SELECT q.asked, q.scope, p.p_partkey, p.p_size FROM q JOIN part p ON regexp_replace(lower(p.p_brand), '[ _#-]+', '', 'g') = regexp_replace(q.asked, '[ _#-]+', '', 'g')
  AND p.p_type = q.scope AND p.p_size IS DISTINCT FROM 1),
r AS (SELECT *, row_number() OVER (PARTITION BY asked, scope ORDER BY p_size DESC, p_partkey) AS rank FROM h)
SELECT asked, scope, rank, p_partkey FROM r WHERE rank <= 3""")
def exact_id_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Normalised id within a scope, a part left out, the first three."""
    part = table(spark, d, "part")
    q = part.select(F.lower(F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("asked"), F.col("p_type").alias("scope")).distinct().withColumn("k", L.squash("asked"))
    kept = part.where(~F.col("p_size").eqNullSafe(1)).select("p_partkey", "p_size", F.col("p_type").alias("scope"), L.squash("p_brand").alias("k"))
    rank = F.row_number().over(Window.partitionBy("asked", "scope").orderBy(F.desc("p_size"), "p_partkey")).cast("long")
    return q.join(kept, ["k", "scope"]).withColumn("rank", rank).where("rank <= 3").select("asked", "scope", "rank", "p_partkey")


@query("""WITH c AS (SELECT s_suppkey, unnest(list_distinct([lower(s_name), regexp_replace(lower(s_name), '[ _#-]+', '', 'g'), regexp_extract(s_name, '(\\d+)', 1)])) AS id FROM supplier),
k AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id FROM part)
SELECT DISTINCT s_suppkey, p_partkey FROM c JOIN k USING (id)""")
def candidate_id_lookup(spark: SparkSession, d: str) -> DataFrame:
    """An equi join on the set of ids a query may mean."""
    c = table(spark, d, "supplier").select("s_suppkey", F.explode(L.candidate_ids(F.col("s_name"))).alias("id"))
    k = table(spark, d, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"))
    return c.join(k, "id").select("s_suppkey", "p_partkey").distinct()


ASKED = [("t1", "Brand#1"), ("t2", "brand 12"), ("t3", "BRAND-2"), ("t4", "Brand#99"), ("t5", "25")]


@query(f"""WITH q(qid, asked) AS (VALUES {", ".join(str(x) for x in ASKED)}),
s AS (SELECT qid, asked, p.*, regexp_replace(lower(p_brand), '[ _#-]+', '', 'g') AS a, regexp_replace(lower(asked), '[ _#-]+', '', 'g') AS b FROM q, part p),
m AS (SELECT *, CASE WHEN p_brand = asked THEN 1 WHEN a = b THEN 2 WHEN starts_with(a, b) THEN 3 WHEN contains(a, b) THEN 4 END AS how FROM s),
n1 AS (SELECT *, bool_or(how <= 2) OVER (PARTITION BY qid) AS f FROM m WHERE how IS NOT NULL),
n2 AS (SELECT *, bool_or(p_type <> 'PROMO') OVER (PARTITION BY qid) AS g FROM n1 WHERE NOT f OR how <= 2),
n3 AS (SELECT *, bool_or(p_size >= 40) OVER (PARTITION BY qid) AS h FROM n2 WHERE NOT g OR p_type <> 'PROMO'),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY how, p_size DESC, p_retailprice, p_partkey) AS rank FROM n3 WHERE NOT h OR p_size >= 40)
SELECT qid, rank, p_partkey, p_brand, how FROM r WHERE rank <= 5""")
def theta_lookup_prefer(spark: SparkSession, d: str) -> DataFrame:
    """A match by rules, narrowed by conditions that apply only where they leave something, and sorted by many keys."""
    q = spark.createDataFrame(ASKED, "qid string, asked string")
    # Five literal questions: the theta join runs against a table of that size.
    rows = table(spark, d, "part").crossJoin(F.broadcast(q)).withColumn("how", L.match_rank(F.col("p_brand"), F.col("asked"))).where("how is not null")
    rows = L.narrow(rows, ["qid"], [F.col("how") <= 2, F.col("p_type") != "PROMO", F.col("p_size") >= 40])
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("how", F.desc("p_size"), "p_retailprice", "p_partkey")).cast("long")
    return rows.withColumn("rank", rank).where("rank <= 5").select("qid", "rank", "p_partkey", "p_brand", "how")


@query("""WITH q AS (SELECT DISTINCT c_acctbal AS v, c_custkey AS qid FROM customer),
a AS (SELECT qid, s_suppkey AS key, 1 AS stage FROM q JOIN supplier ON floor(s_acctbal) = floor(v)),
b AS (SELECT qid, p_partkey AS key, 2 AS stage FROM q JOIN part ON floor(p_retailprice) = floor(v) WHERE qid NOT IN (SELECT qid FROM a)),
c AS (SELECT qid, min(n_nationkey) AS key, 3 AS stage FROM q JOIN nation ON n_nationkey = qid % 100 WHERE qid NOT IN (SELECT qid FROM a) AND qid NOT IN (SELECT qid FROM b) GROUP BY qid)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def lookup_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Stages in order; each sees only what the ones before left open."""
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), F.floor("c_acctbal").alias("v"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.floor("s_acctbal").alias("v"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.floor("p_retailprice").alias("v"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"))
    third = lambda left: left.join(n, F.col("qid") % 100 == F.col("key")).groupBy("qid").agg(F.min("key").alias("key"))
    return cascade(q, "qid", [lambda left: left.join(s, "v").select("qid", "key"), lambda left: left.join(p, "v").select("qid", "key"), third]).select("qid", "key", "stage")


@query()
def lookup_misses(spark: SparkSession, d: str) -> DataFrame:
    """What is not known, and the eight most similar of all known names."""
    first = F.regexp_extract("text", r"^(\S+)", 1)
    known = table(spark, d, "documents").select(first.alias("name")).where("name <> ''").distinct()
    asked = table(spark, d, "benchmark").select("item_id", first.alias("asked")).where("asked <> ''")
    misses = asked.join(known.select(F.lower("name").alias("k")), F.lower("asked") == F.col("k"), "left_anti")
    return L.suggest(misses, "item_id", "asked", known, "name")


@query("""WITH h AS (SELECT p_type, p_partkey, p_size, p_brand = 'Brand#1' AS preferred, p_brand = 'Brand#2' AS superseded FROM part)
SELECT p_type, p_partkey, superseded AS flagged, row_number() OVER (PARTITION BY p_type ORDER BY preferred DESC, p_size DESC, p_partkey) AS rank FROM h""")
def conflict_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The preferred record first, the superseded one flagged."""
    h = table(spark, d, "part").withColumns({"preferred": F.col("p_brand") == "Brand#1", "flagged": F.col("p_brand") == "Brand#2"})
    rank = F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("preferred"), F.desc("p_size"), "p_partkey")).cast("long")
    return h.select("p_type", "p_partkey", "flagged", rank.alias("rank"))


@query("""SELECT source, count(*) AS n_docs, count(*) FILTER (n_chars >= 40) AS n_bodies, count(*) FILTER (l.quality = 1) AS n_good, count(*) FILTER (l.doc_id IS NULL) AS n_unlabelled,
  count(DISTINCT lang) AS n_langs, max(n_chars) AS longest FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def build_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a corpus build (A1)."""
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, d, "labels").withColumn("l", F.lit(True)), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("n_chars") >= 40).alias("n_bodies"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("l").isNull()).alias("n_unlabelled"), F.countDistinct("lang").alias("n_langs"), F.max("n_chars").alias("longest"))


@query("""SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'restricted' END, CASE WHEN l.quality = 0 THEN 'draft' END, d.lang) AS edition,
  CASE WHEN l.toxic = 1 THEN 'override' WHEN l.quality = 0 THEN 'title' ELSE 'old' END AS origin FROM documents d LEFT JOIN labels l USING (doc_id)""")
def metadata_override(spark: SparkSession, d: str) -> DataFrame:
    """The first source that has a value, and which it was."""
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    a, b = F.when(F.col("toxic") == 1, "restricted"), F.when(F.col("quality") == 0, "draft")
    return rows.select("doc_id", F.coalesce(a, b, "lang").alias("edition"), F.when(a.isNotNull(), "override").when(b.isNotNull(), "title").otherwise("old").alias("origin"))


@query("""SELECT DISTINCT o_custkey, 'resume' AS why FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT o_custkey, 'both' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""")
def set_ops_resume(spark: SparkSession, d: str) -> DataFrame:
    """What is planned and not done, and what is in two sets."""
    o, x = table(spark, d, "orders"), table(spark, d, "lineitem")
    keys = lambda flag: x.where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("o_orderkey"))
    left = o.join(x, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_custkey").distinct().withColumn("why", F.lit("resume"))
    both = o.join(keys("R").intersect(keys("A")), "o_orderkey", "left_semi").select("o_custkey").distinct().withColumn("why", F.lit("both"))
    return left.unionByName(both)


@query("""SELECT c_custkey, o.n, coalesce(o.status, 'pending') AS status, sha1(c_name || chr(10) || c_mktsegment) AS stamp FROM customer LEFT JOIN
  (SELECT o_custkey, count(*) AS n, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'done' ELSE 'running' END AS status FROM orders GROUP BY 1) o ON c_custkey = o_custkey""")
def plan_left_results(spark: SparkSession, d: str) -> DataFrame:
    """A plan with the results there are, defaults for the others."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.when(F.bool_or(F.col("o_orderstatus") == "F"), "done").otherwise("running").alias("status"))
    rows = table(spark, d, "customer").join(o, "c_custkey", "left")
    return rows.select("c_custkey", "n", F.coalesce("status", F.lit("pending")).alias("status"), F.sha1(F.concat_ws("\n", "c_name", "c_mktsegment").cast("binary")).alias("stamp"))


@query("""WITH h AS (SELECT p_type, p_partkey, p_brand, row_number() OVER (PARTITION BY p_type, p_size ORDER BY p_retailprice DESC, p_partkey) AS rank, p_size FROM part QUALIFY rank <= 3),
f AS (SELECT p_type, min(p_partkey) AS p_partkey FROM part WHERE p_brand = 'Brand#1' GROUP BY 1),
u AS (SELECT p_type, p_size, p_partkey, p_brand, rank, p_brand = 'Brand#1' AS pref FROM h UNION ALL
  SELECT p_type, p_size, f.p_partkey, 'Brand#1', 1, true FROM (SELECT p_type, p_size FROM h GROUP BY ALL HAVING NOT bool_or(p_brand = 'Brand#1')) JOIN f USING (p_type))
SELECT p_type, p_size, p_partkey, NOT pref AND p_brand = 'Brand#2' AS flagged, row_number() OVER (PARTITION BY p_type, p_size ORDER BY pref DESC, rank) AS rank FROM u""")
def conflict_fetch(spark: SparkSession, d: str) -> DataFrame:
    """The preferred record first, fetched where no hit is one, and the superseded flagged."""
    part = table(spark, d, "part")
    rank = F.row_number().over(Window.partitionBy("p_type", "p_size").orderBy(F.desc("p_retailprice"), "p_partkey")).cast("long")
    hits = part.withColumn("rank", rank).where("rank <= 3").select("p_type", "p_size", "p_partkey", "p_brand", "rank")
    first = part.where("p_brand = 'Brand#1'").groupBy("p_type").agg(F.min("p_partkey").alias("p_partkey"))
    source = hits.select("p_type", "p_size").distinct().join(first, "p_type").select("p_type", "p_size", "p_partkey", F.lit("Brand#1").alias("p_brand"), F.lit(1).cast("long").alias("rank"))
    got = R.govern(hits, ["p_type", "p_size"], "rank", F.col("p_brand") == "Brand#1", F.col("p_brand") == "Brand#2", source)
    return got.select("p_type", "p_size", "p_partkey", "flagged", "rank")


#: Tables asked for, as data.
ASKED_TABLES = [("t1", "Table 9", False), ("t2", "20", False), ("t3", "30(b)", False), ("t4", "Table 7", True), ("t5", "brand#1", False), ("t6", "Fig. 4", False), ("t7", "Table 77", False), ("t8", "rod", False)]


@query(f"""WITH q(qid, asked, want) AS (VALUES {", ".join(f"('{a}', '{b}', {c})" for a, b, c in ASKED_TABLES)}),
n AS (SELECT qid, want, lower(replace(regexp_replace(asked, '(?i)^\\s*table\\s+', ''), ' ', '')) AS q FROM q),
t AS (SELECT p_type AS doc, CASE p_partkey % 4 WHEN 0 THEN p_size || '' WHEN 1 THEN p_size || '(' || chr(CAST(97 + p_partkey % 3 AS INTEGER)) || ')' WHEN 3 THEN p_size || 'x' END AS table_id, CASE WHEN p_partkey % 2 = 0 THEN 'Table ' || p_size || ' ' || p_name ELSE 'Fig. ' || p_size || ' ' || p_name END AS title, p_brand AS excerpt,
  CASE WHEN p_partkey % 7 = 0 THEN 'commentary' WHEN p_partkey % 7 < 6 THEN 'standard' END AS part, CASE WHEN p_partkey % 5 = 0 THEN 'opensees' ELSE 'specification' END AS coll, p_partkey % 6 = 0 AS old, p_retailprice > 1500 AS ver, p_partkey % 9 = 0 AS cont, p_partkey % 8 = 0 AS one, p_brand = 'Brand#2' AS toc, nullif(p_partkey % 10, 0) AS n_rows, p_partkey AS page FROM part),
m AS (SELECT *, lower(coalesce(table_id, '')) AS rid FROM t, n WHERE lower(coalesce(table_id, '')) = q OR CASE WHEN starts_with(q, 'fig.') THEN regexp_matches(lower(replace(title || ' ' || excerpt, ' ', '')) || 'z', 'fig\\.4[^0-9]') ELSE contains(lower(replace(title || ' ' || excerpt, ' ', '')), q) END),
a AS (SELECT * FROM m WHERE NOT want OR coll <> 'specification' OR part = 'commentary'),
b AS (SELECT * FROM a QUALIFY (want OR coll <> 'specification' OR part IS DISTINCT FROM 'commentary') OR NOT bool_or(want OR coll <> 'specification' OR part IS DISTINCT FROM 'commentary') OVER (PARTITION BY qid)),
c AS (SELECT * FROM b QUALIFY rid <> '' OR NOT bool_or(rid <> '') OVER (PARTITION BY qid)), e AS (SELECT * FROM c QUALIFY rid = q OR NOT bool_or(rid = q) OVER (PARTITION BY qid)),
f AS (SELECT * FROM e QUALIFY NOT old OR bool_and(old) OVER (PARTITION BY qid)), g AS (SELECT * FROM f QUALIFY ver OR cont OR NOT bool_or(ver) OVER (PARTITION BY qid)), h AS (SELECT * FROM g QUALIFY NOT one OR bool_and(one) OVER (PARTITION BY qid)),
i AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rid = q THEN 0 ELSE 1 END, coll = 'opensees', rid = '', toc, cont, n_rows IS NULL, -coalesce(n_rows, 0), page) AS r FROM h WHERE rid = q OR NOT regexp_full_match(q, '[0-9]+[a-z]?') OR regexp_full_match(rid, q || '\\([a-z]\\)')),
k AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY qid, doc, coalesce(table_id, 'title:' || left(title, 40)), part ORDER BY r) = 1)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY r) AS rank, doc, table_id, part, page AS pdf_page FROM k QUALIFY rank <= 20""")
def exact_tables(spark: SparkSession, d: str) -> DataFrame:
    """The tables that are asked for, narrowed in the whole order of the lookup."""
    from ferrule.operators.tables import exact_tables as find

    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    ids = F.when(k % 4 == 0, size).when(k % 4 == 1, F.concat(size, F.lit("("), F.chr(97 + k % 3), F.lit(")"))).when(k % 4 == 3, F.concat(size, F.lit("x")))
    tables = table(spark, d, "part").select(
        F.col("p_type").alias("doc"), ids.alias("table_id"), F.lit(None).cast("string").alias("label"), F.concat(F.when(k % 2 == 0, "Table ").otherwise("Fig. "), size, F.lit(" "), "p_name").alias("title"), F.col("p_brand").alias("excerpt"),
        F.when(k % 7 == 0, "commentary").when(k % 7 < 6, "standard").alias("part"), F.when(k % 5 == 0, "opensees").otherwise("specification").alias("collection"), (k % 6 == 0).alias("superseded"), (F.col("p_retailprice") > 1500).alias("caption_verified"),
        F.lit(None).cast("boolean").alias("structured_row"), (k % 9 == 0).alias("continued"), (k % 8 == 0).alias("row_of_table"), (F.col("p_brand") == "Brand#2").alias("toc"), F.nullif(k % 10, F.lit(0)).alias("num_rows"), k.alias("pdf_page"),
    )
    return find(spark.createDataFrame(ASKED_TABLES, "qid string, asked string, want_commentary boolean"), tables)

"""Queries over records: identifiers, aliases, merges by precedence, text assembly, clamps and small tables as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.plans import query, table


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || 'The ')) AS body, generate_subscripts(string_split(text, chr(10) || 'The '), 1) AS page, len(string_split(text, chr(10) || 'The ')) AS n FROM documents)
SELECT doc_id, page, length(trim(replace(body, '!!', ''))) AS n_chars FROM p WHERE NOT (page = n AND trim(body) = '')""")
def layout_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a text layer at a separator, the empty last one dropped, marks taken off."""
    b = F.split("text", "\nThe ")
    p = table(spark, d, "documents").select("doc_id", F.posexplode(b).alias("k", "body"), F.size(b).alias("n"))
    p = p.where(~((F.col("k") + 1 == F.col("n")) & (F.trim("body") == "")))
    return p.select("doc_id", (F.col("k") + 1).cast("long").alias("page"), F.length(F.trim(F.replace("body", F.lit("!!"), F.lit("")))).cast("long").alias("n_chars"))


@query(r"""WITH j AS (SELECT conv_id, list(struct_pack(turn := turn, n := length(text)) ORDER BY turn) AS prov FROM conversations GROUP BY 1)
SELECT conv_id, prov[1].turn AS first_page, len(prov) AS n_pages, list_max(list_transform(prov, lambda p: p.n)) AS longest, (prov[1].n + prov[-1].n) / 2.0 AS centre FROM j""")
def provenance_fields(spark: SparkSession, d: str) -> DataFrame:
    """First page, number of pages and a centre out of nested provenance."""
    j = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("n")))).alias("p"))
    first, last = F.get("p", F.lit(0)), F.element_at("p", -1)
    return j.select("conv_id", first["turn"].alias("first_page"), F.size("p").cast("long").alias("n_pages"), F.array_max(F.transform("p", lambda x: x["n"])).alias("longest"), ((first["n"] + last["n"]) / 2.0).alias("centre"))


@query(r"""SELECT s_suppkey, translate(replace(upper(s_name), 'SUPPLIER#', ''), '015', 'OIS') AS confused, CAST(translate(translate(replace(upper(s_name), 'SUPPLIER#', ''), '015', 'OIS'), 'OIS', '015') AS BIGINT) AS repaired FROM supplier""")
def ocr_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Confusable characters mapped there and back."""
    c = F.translate(F.replace(F.upper("s_name"), F.lit("SUPPLIER#"), F.lit("")), "015", "OIS")
    return table(spark, d, "supplier").select("s_suppkey", c.alias("confused"), F.translate(c, "OIS", "015").cast("long").alias("repaired"))


@query("""WITH a(alias, stem) AS (VALUES ('brand2', 'second'), ('brand12', 'twelfth'))
SELECT p_partkey, coalesce(stem, p_brand) AS doc, CASE WHEN stem IS NULL THEN 'collection' ELSE 'document' END AS kind FROM part LEFT JOIN a ON alias = regexp_replace(lower(p_brand), '[#_ -]', '', 'g')""")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    """An alias without case, spaces and dashes, else the name as it is."""
    a = spark.createDataFrame([("brand2", "second"), ("brand12", "twelfth")], "alias string, stem string")  # two rows
    r = table(spark, d, "part").withColumn("k", F.regexp_replace(F.lower("p_brand"), "[#_ -]", "")).join(F.broadcast(a), F.col("k") == F.col("alias"), "left")
    return r.select("p_partkey", F.coalesce("stem", "p_brand").alias("doc"), F.when(F.col("stem").isNull(), "collection").otherwise("document").alias("kind"))


@query(r"""SELECT url, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent, len(regexp_extract_all(regexp_extract(url, '^https?://[^/]+(/.*)$', 1), '/')) AS depth, starts_with(url, 'https://m.') AS mobile FROM pages""")
def parents_and_depth(spark: SparkSession, d: str) -> DataFrame:
    """The parent of an id, and how deep it lies."""
    depth = F.regexp_count(F.regexp_extract("url", "^https?://[^/]+(/.*)$", 1), F.lit("/")).cast("long")
    return table(spark, d, "pages").select("url", F.regexp_extract("url", "^(.*)/[^/]*$", 1).alias("parent"), depth.alias("depth"), F.col("url").startswith("https://m.").alias("mobile"))


@query(r"""SELECT doc_id, list_max(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: length(x))) AS longest_number, CASE WHEN contains(text, 'icense') THEN 'licensed' WHEN lang = 'en' THEN 'plain' ELSE 'foreign' END AS kind FROM documents""")
def kind_applicability(spark: SparkSession, d: str) -> DataFrame:
    """A kind by rules, and the largest of what a pattern finds."""
    n = F.array_max(F.transform(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x).cast("long")))
    return table(spark, d, "documents").select("doc_id", n.alias("longest_number"), F.when(F.col("text").contains("icense"), "licensed").when(F.col("lang") == "en", "plain").otherwise("foreign").alias("kind"))


@query("""SELECT user_id, CAST(abs(hash_rc) AS BIGINT) AS rc, CASE hash_rc WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' WHEN 2 THEN 'usage' WHEN 137 THEN 'killed' ELSE 'exit ' || hash_rc END AS why, hash_rc IN (1, 137) AS retry
FROM (SELECT user_id, CASE WHEN max(event_id) % 5 = 4 THEN 137 ELSE max(event_id) % 5 END AS hash_rc FROM events GROUP BY 1)""")
def exit_codes(spark: SparkSession, d: str) -> DataFrame:
    """Exit codes explained, and whether to try again."""
    last = F.max("event_id") % 5
    r = table(spark, d, "events").groupBy("user_id").agg(F.when(last == 4, F.lit(137).cast("long")).otherwise(last).alias("rc"))
    known = F.create_map(*[F.lit(x) for kv in ((0, "ok"), (1, "failed"), (2, "usage"), (137, "killed")) for x in kv])
    return r.select("user_id", "rc", F.coalesce(F.try_element_at(known, F.col("rc").cast("int")), F.concat(F.lit("exit "), F.col("rc").cast("string"))).alias("why"), F.col("rc").isin(1, 137).alias("retry"))


@query("""WITH d AS (SELECT min(p_partkey) AS p_partkey, lower(p_name) AS title, lower(p_type) AS change FROM part GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS n FROM d)
SELECT 'M' || lpad(CAST(n AS VARCHAR), 3, '0') AS id, title, change FROM k WHERE n <= 200""")
def plan_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates out by title and change, then numbered up to a limit."""
    g = table(spark, d, "part").groupBy(F.lower("p_name").alias("title"), F.lower("p_type").alias("change")).agg(F.min("p_partkey").alias("p")).orderBy("p").limit(200)
    return g.select(F.format_string("M%03d", F.row_number().over(Window.orderBy("p"))).alias("id"), "title", "change")


@query("""SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r FROM customer WHERE contains(lower(c_name), '77') AND c_mktsegment IN ('BUILDING', 'MACHINERY')) WHERE r <= 8""")
def command_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A substring in a scope, the first eight."""
    return table(spark, d, "customer").where(F.lower("c_name").contains("77") & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).orderBy("c_custkey").limit(8).select("c_custkey", "c_name")


@query("""SELECT l_orderkey, l_partkey, max(p_name) AS section, min(l_linenumber) AS first_line FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 GROUP BY ALL""")
def parent_section(spark: SparkSession, d: str) -> DataFrame:
    """The section a record belongs to, if it is there."""
    p = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return table(spark, d, "lineitem").join(p, "l_partkey", "left").groupBy("l_orderkey", "l_partkey").agg(F.max("p_name").alias("section"), F.min("l_linenumber").alias("first_line"))


@query("""WITH u AS (SELECT p_partkey AS id, 'a' || p_size AS title, 1 AS ord FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'b' || p_size, 2 FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'c' || p_size, 3 FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS r FROM u) SELECT id, title, ord FROM r WHERE r = 1""")
def heading_precedence(spark: SparkSession, d: str) -> DataFrame:
    """Headings from three sources, the first by precedence."""
    p = table(spark, d, "part")
    one = lambda where, tag, ord_: p.where(where).select(F.col("p_partkey").alias("id"), F.concat(F.lit(tag), "p_size").alias("title"), F.lit(ord_).alias("ord"))
    u = one("p_partkey % 2 = 0", "a", 1).unionByName(one("p_partkey % 3 = 0", "b", 2)).unionByName(one("true", "c", 3))
    return u.groupBy("id").agg(F.min_by("title", "ord").alias("title"), F.min("ord").alias("ord"))


@query("""SELECT n_nationkey, r_regionkey, n_nationkey * 10 + r_regionkey AS code FROM nation, region""")
def realisation_cross(spark: SparkSession, d: str) -> DataFrame:
    """Every member with every realisation, where both are few."""
    return table(spark, d, "nation").crossJoin(F.broadcast(table(spark, d, "region"))).select("n_nationkey", "r_regionkey", (F.col("n_nationkey") * 10 + F.col("r_regionkey")).alias("code"))


@query("""WITH t AS (SELECT DISTINCT source, lang, doc_id % 7 AS page, max(text) OVER (PARTITION BY source, lang, doc_id % 7) AS piece FROM documents)
SELECT source, lang, string_agg(piece, ' / ' ORDER BY page) AS stitched, count(*) AS n FROM t GROUP BY ALL""")
def table_stitching(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of a table, once a page, in order."""
    t = table(spark, d, "documents").groupBy("source", "lang", (F.col("doc_id") % 7).alias("page")).agg(F.max("text").alias("piece"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "piece"))), lambda x: x["piece"]), " / ")
    return t.groupBy("source", "lang").agg(text.alias("stitched"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT o_custkey, sum(o_totalprice / 1e6) AS sx, sum((o_orderkey % 13 - 6) / 10.0) AS sy, max(greatest(abs(o_totalprice / 1e6), abs((o_orderkey % 13 - 6) / 10.0))) AS mx, count(*) AS n FROM orders GROUP BY 1)
SELECT o_custkey, round(sqrt(sx * sx + sy * sy) / n, 7) AS lean, round(mx, 7) AS worst FROM s""")
def sample_summary(spark: SparkSession, d: str) -> DataFrame:
    """The resultant lean and the largest part of a sample."""
    x, y = F.col("o_totalprice") / 1e6, (F.col("o_orderkey") % 13 - 6) / 10.0
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.max(F.greatest(F.abs(x), F.abs(y))).alias("mx"), F.count("*").alias("n"))
    return s.select("o_custkey", F.round(F.hypot("sx", "sy") / F.col("n"), 7).alias("lean"), F.round("mx", 7).alias("worst"))


@query("""WITH c AS (SELECT o_custkey % 50 AS top, count(DISTINCT o_orderpriority || o_orderstatus) AS subs FROM orders GROUP BY 1) SELECT max(top) FILTER (subs >= 5) AS max_top, count(*) FILTER (subs >= 5) AS n FROM c""")
def heading_census(spark: SparkSession, d: str) -> DataFrame:
    """Top-level numbers with enough sub-clauses."""
    c = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("top")).agg(F.countDistinct(F.concat("o_orderpriority", "o_orderstatus")).alias("subs"))
    return c.agg(F.max(F.when(F.col("subs") >= 5, F.col("top"))).alias("max_top"), F.count_if(F.col("subs") >= 5).alias("n"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos, len(string_split(text, chr(10))) AS n FROM documents),
f AS (SELECT doc_id, pos, n, line FROM l WHERE pos IN (1, n)),
g AS (SELECT doc_id, array_to_string(list(line ORDER BY pos) FILTER (NOT (pos > 1 OR contains(lower(line), 'copyright'))), '|') AS headers, array_to_string(list(line ORDER BY pos) FILTER (pos > 1 OR contains(lower(line), 'copyright')), '|') AS footers,
  list(trim(regexp_replace(line, '\s+', ' ', 'g')) ORDER BY pos > 1 OR contains(lower(line), 'copyright'), pos) AS t FROM f GROUP BY doc_id),
r AS (SELECT *, list_filter(list_transform(t, lambda x: regexp_extract(x, '(?i)^([A-Z]-\d+|\d+-\d+|\d{1,4}|[ivxlcdm]+)$', 1)), lambda x: x NOT IN ('', 'c', 'C'))[1] AS a, list_filter(list_transform(t, lambda x: regexp_extract(x, '(?i)16\s*\.\s*1\s*[-–—]\s*([ivxlcdm]+|\d+)\b', 1)), lambda x: x <> '')[1] AS b,
  list_filter(list_transform(list_filter(t, lambda x: NOT regexp_matches(x, '(?i)S400|S100|S240|Supplement')), lambda x: regexp_extract(x, '(\d{1,4})\s*$', 1)), lambda x: x <> '')[1] AS c FROM g)
SELECT doc_id, coalesce(headers, '') AS headers, coalesce(footers, '') AS footers, coalesce(CASE WHEN regexp_matches(a, '(?i)^[ivxlcdm]+$') THEN lower(a) ELSE a END, '16.1-' || lower(b), c) AS printed_label FROM r""")
def furniture_lists(spark: SparkSession, d: str) -> DataFrame:
    """Headers and footers of pages and the label they print (W19); a document is a page, its first line a header, its last a footer."""
    from ferrule.operators.furniture import furniture_by_page

    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"), (F.size(F.split("text", "\n")) - 1).alias("last")).where("seq = 0 or seq = last")
    label = F.when(F.col("seq") == 0, "page_header").otherwise("page_footer")
    texts = lines.select("doc_id", "seq", label.alias("label"), F.lit("furniture").alias("layer"), F.col("line").alias("text"))
    return furniture_by_page(texts, ["doc_id"]).select("doc_id", F.array_join("headers", "|").alias("headers"), F.array_join("footers", "|").alias("footers"), "printed_label")


@query("""SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS pos FROM orders QUALIFY pos <= 30""")
def newest_first(spark: SparkSession, d: str) -> DataFrame:
    """The newest thirty."""
    few = table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(30)
    return few.select("o_orderkey", "o_orderdate", F.row_number().over(Window.orderBy(F.desc("o_orderdate"), "o_orderkey")).cast("long").alias("pos"))


@query("""SELECT l_orderkey, CASE WHEN o_orderkey IS NULL THEN 'new' ELSE 'replaced' END AS fate FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey""")
def rollback_split(spark: SparkSession, d: str) -> DataFrame:
    """What a publication replaces, and what is new (E5)."""
    old = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("old"))
    return table(spark, d, "lineitem").select("l_orderkey").distinct().join(old, "l_orderkey", "left").select("l_orderkey", F.when(F.col("old").isNull(), "new").otherwise("replaced").alias("fate"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS id, (n_nationkey * 3 + 1) % 25 AS needs FROM nation WHERE n_nationkey % 4 <> 0), c AS (SELECT id, needs FROM e UNION SELECT c.id, e.needs FROM c JOIN e ON c.needs = e.id)
SELECT id, count(*) AS n_needed, CASE WHEN bool_or(id = needs) THEN 'cycle' ELSE 'ok' END AS verdict FROM c GROUP BY id""")
def dependency_closure(spark: SparkSession, d: str) -> DataFrame:
    """What a module needs, with a guard for cycles; a recursive query over a table of 25 rows."""
    table(spark, d, "nation").createOrReplaceTempView("ferrule_nation")
    return spark.sql("""WITH RECURSIVE e AS (SELECT n_nationkey AS id, (n_nationkey * 3 + 1) % 25 AS needs FROM ferrule_nation WHERE n_nationkey % 4 <> 0),
      c(id, needs, depth) AS (SELECT id, needs, 1 FROM e UNION ALL SELECT c.id, e.needs, depth + 1 FROM c JOIN e ON c.needs = e.id WHERE depth < 26)
      SELECT id, count(DISTINCT needs) AS n_needed, CASE WHEN bool_or(id = needs) THEN 'cycle' ELSE 'ok' END AS verdict FROM c GROUP BY id""")


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+\.[0-9]+') || regexp_extract_all(text, '[A-Z][0-9]+'))), ' ') AS ids, CASE WHEN regexp_matches(text, '[0-9]+\.[0-9]+') THEN regexp_extract(text, '([^\n]*?)[0-9]+\.[0-9]+', 1) END AS context
FROM documents WHERE regexp_matches(text, '[0-9]+\.[0-9]+|[A-Z][0-9]+')""")
def ids_in_text(spark: SparkSession, d: str) -> DataFrame:
    """All ids a text names, each once, and what stands before the first in its line."""
    x = F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+"), F.lit(0)), F.regexp_extract_all("text", F.lit("[A-Z][0-9]+"), F.lit(0)))))
    context = F.when(F.col("text").rlike(r"[0-9]+\.[0-9]+"), F.regexp_extract("text", r"([^\n]*?)[0-9]+\.[0-9]+", 1))
    return table(spark, d, "documents").where(F.col("text").rlike(r"[0-9]+\.[0-9]+|[A-Z][0-9]+")).select("doc_id", F.array_join(x, " ").alias("ids"), context.alias("context"))


HEADINGS = ("Design basis", "Structural system", "Lateral system", "Governing lateral load", "Plan and vertical irregularit", "Storey drift", "Wind", "NOT PERMITTED", "Table 9 Note 1", "Earthquake detailing", "Connections", "design_status")


@query(f"""WITH h AS (SELECT unnest({list(HEADINGS)}) AS h, unnest(range({len(HEADINGS)})) AS i), d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS (SELECT doc_id, string_agg(substr(text, position(h IN text), 2200), chr(10) || '---' || chr(10) ORDER BY i) AS found FROM d JOIN h ON position(h IN text) > 0 GROUP BY doc_id)
SELECT doc_id, left(coalesce(found, text), 14000) AS excerpt FROM d LEFT JOIN k USING (doc_id)""")
def report_excerpt(spark: SparkSession, d: str) -> DataFrame:
    """2,200 characters from each of a report's headings that is found, or else its start; 14,000 in all."""
    parts = [F.when(F.col("text").contains(h), F.substring("text", F.instr("text", h), F.lit(2200))) for h in HEADINGS]
    found = F.nullif(F.concat_ws("\n---\n", *parts), F.lit(""))
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", F.substring(F.coalesce(found, "text"), 1, 14000).alias("excerpt"))


@query(r"""SELECT p_partkey, replace(upper(p_name), ' ', '') || 'x' || p_size AS label, CASE WHEN p_size < 10 THEN ['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine'][p_size + 1] ELSE CAST(p_size AS VARCHAR) END AS words,
  regexp_extract(p_brand, '#(\d+)', 1) || CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END AS family_id FROM part""")
def labels_and_words(spark: SparkSession, d: str) -> DataFrame:
    """Labels out of designations, small numbers in words, family ids."""
    words = F.array(*map(F.lit, ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")))
    said = F.when(F.col("p_size") < 10, F.get(words, F.col("p_size"))).otherwise(F.col("p_size").cast("string"))
    label = F.concat(F.replace(F.upper("p_name"), F.lit(" "), F.lit("")), F.lit("x"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", label.alias("label"), said.alias("words"), F.concat(F.regexp_extract("p_brand", r"#(\d+)", 1), F.when(F.col("p_size") % 2 == 0, "a").otherwise("b")).alias("family_id"))


@query(r"""SELECT event_id, TRY_CAST(json_extract_string(regexp_extract('answer: ' || props || ' end', '(\{.*\})', 1), '$.k') AS BIGINT) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events""")
def json_out_of_prose(spark: SparkSession, d: str) -> DataFrame:
    """JSON found in prose, and numbers that are none."""
    body = F.regexp_extract(F.concat(F.lit("answer: "), "props", F.lit(" end")), r"(\{.*\})", 1)
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json(body), "$.k", "bigint").alias("k"), F.expr("try_cast(event_type AS double)").alias("bad"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, '- ' || array_to_string(l, chr(10) || '- ') AS toc, CAST(len(l) AS BIGINT) AS n FROM l WHERE len(l) > 0""")
def markdown_toc(spark: SparkSession, d: str) -> DataFrame:
    """A list in markdown out of all lines of all texts."""
    l = table(spark, d, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: x != "").alias("l")).where(F.size("l") > 0)  # noqa: E741
    return l.select("doc_id", F.concat(F.lit("- "), F.array_join("l", "\n- ")).alias("toc"), F.size("l").cast("long").alias("n"))


@query("""WITH t AS (SELECT source, lang, count(*) AS n, sum(n_chars) AS chars, count(*) FILTER (n_chars > 12000) AS long, min(doc_id) FILTER (n_chars > 12000) AS first FROM documents GROUP BY ALL)
SELECT source || ' · ' || lang || ' · ' || n || ' documents' || CASE WHEN long > 0 THEN ' · ' || long || ' too long, see ' || first ELSE '' END AS entry, chars FROM t""")
def index_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entry texts of an index with a note on problems (K17, S21, K16); a count and the first, so a group of any size is one short row."""
    long_ = F.col("n_chars") > 12000
    g = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_if(long_).alias("long"), F.min(F.when(long_, F.col("doc_id"))).alias("first"))
    see = F.when(F.col("long") > 0, F.concat(F.col("long").cast("string"), F.lit(" too long, see "), F.col("first").cast("string")))
    entry = F.concat(F.concat("source", F.lit(" · "), "lang", F.lit(" · "), F.col("n").cast("string"), F.lit(" documents")), F.coalesce(F.concat(F.lit(" · "), see), F.lit("")))
    return g.select(entry.alias("entry"), "chars")


@query(r"""SELECT doc_id, CASE WHEN lang = 'de' THEN text ELSE concat_ws(chr(10), source, lang, text) END AS shown FROM documents""")
def json_text(spark: SparkSession, d: str) -> DataFrame:
    """Every string of a JSON text but ids and links, at any depth; what is not JSON stays as it is."""
    from ferrule.functions.keys import json_strings

    inner = F.struct(F.col("lang").alias("title"), F.concat(F.lit("/r/"), "source").alias("viewer"), F.array(F.struct(F.col("text").alias("body"))).alias("parts"))
    nested = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.array("source").alias("names"), F.array(F.lit("a"), F.lit("b")).alias("bom"), F.col("doc_id").alias("n"), inner.alias("x")))
    return table(spark, d, "documents").select("doc_id", json_strings(F.when(F.col("lang") == "de", F.col("text")).otherwise(nested)).alias("shown"))


@query(r"""WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
l AS (SELECT doc_id, pos, CASE WHEN starts_with(line, 'The ') THEN '## ANNEX ' || chr(CAST(65 + pos % 3 AS INTEGER)) || ' ' || line WHEN regexp_matches(line, '^[A-M]') THEN chr(CAST(65 + pos % 3 AS INTEGER)) || '-' || (pos % 2 + 1) || CASE WHEN pos % 4 = 0 THEN '.1' ELSE '' END || ' ' || line ELSE line END AS line FROM x),
k AS (SELECT *, regexp_extract(line, '^## ANNEX ([A-H])', 1) AS ann, regexp_extract(line, '^([A-H]-\d+(?:\.\d+)*) ', 1) AS id FROM l),
t(sid) AS (VALUES ('Annex B'), ('B-1')),
s AS (SELECT doc_id, sid, min(pos) AS a FROM k, t WHERE CASE WHEN sid = 'Annex B' THEN ann = 'B' ELSE id = sid END GROUP BY ALL),
e AS (SELECT doc_id, sid, a, min(pos) AS b FROM s JOIN k USING (doc_id) WHERE pos > a AND (ann <> '' OR (sid <> 'Annex B' AND id <> '' AND id <> sid AND NOT starts_with(id, sid || '.'))) GROUP BY ALL)
SELECT doc_id, sid, left(string_agg(CASE WHEN pos = a THEN trim(line) ELSE line END, chr(10) ORDER BY pos), 12000) AS body FROM s LEFT JOIN e USING (doc_id, sid, a) JOIN k USING (doc_id) WHERE pos >= a AND (b IS NULL OR pos < b) GROUP BY ALL""")
def annex_slices(spark: SparkSession, d: str) -> DataFrame:
    """An annex, and a clause of one, up to the next that does not belong to it."""
    from ferrule.operators.sections import annex_slice

    lines = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("pos", F.col("p") + 1)
    letter = F.chr(65 + F.col("pos") % 3)
    clause = F.concat(letter, F.lit("-"), (F.col("pos") % 2 + 1).cast("string"), F.when(F.col("pos") % 4 == 0, ".1").otherwise(""), F.lit(" "), "line")
    line = F.when(F.col("line").startswith("The "), F.concat(F.lit("## ANNEX "), letter, F.lit(" "), "line")).when(F.col("line").rlike("^[A-M]"), clause).otherwise(F.col("line"))
    targets = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.array(F.lit("Annex B"), F.lit("B-1"))).alias("sid"), F.lit(1).alias("start"))
    return annex_slice(lines.select("doc", "page", "pos", line.alias("line")), targets).select(F.col("doc").alias("doc_id"), "sid", "body")


#: A line that each publication prints.
TITLES = {"aisc_358": "9.2-xii", "aisc_341": "American Institute of Steel Construction", "asce": "STANDARD ASCE/SEI 7-22", "aisi_s100": "12 Chapter A, General", "aisi_s240": "ii AISI S240-20-C", "aisi_s230": "AISI S230-19"}


@query(r"""SELECT doc_id, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT (doc_id % 6 = 3 AND regexp_full_match(trim(x), '(?i)[A-Z]-\d+|\d+-\d+|\d{1,4}|[ivxlcdm]+') AND lower(trim(x)) <> 'c')), chr(10)) AS body FROM documents""")
def running_titles(spark: SparkSession, d: str) -> DataFrame:
    """Texts between the titles that six publications print on their pages, which leave again."""
    from ferrule.operators.furniture import strip_running_titles

    k = F.col("doc_id") % len(TITLES)
    case = lambda f: F.coalesce(*[F.when(k == i, f(p)) for i, p in enumerate(TITLES)])
    printed = table(spark, d, "documents").withColumn("printed", F.concat_ws("\n", case(lambda p: F.lit(TITLES[p])), F.coalesce("text", F.lit("")), case(lambda p: F.lit("  " + TITLES[p] + " "))))
    return printed.select("doc_id", case(lambda p: strip_running_titles(F.col("printed"), p)).alias("body"))

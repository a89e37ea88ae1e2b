"""Queries over clause headings and sections; the lines of ``documents`` are given numbers, and slips, by document and place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import headings as H
from ferrule.operators import lookup as L
from ferrule.plans import query, table

PAGE_LINES = 12
NUMBERED_SQL = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
k AS (SELECT doc_id, pos, pos // {PAGE_LINES} + 1 AS page, line, CASE WHEN pos % 2 = 0 THEN pos // 2 END AS i, (doc_id * 7 + pos * 3) % 23 AS slip FROM l),
c AS (SELECT *, i // 8 + 1 + CASE WHEN slip = 5 THEN 6 ELSE 0 END AS chapter, i % 8 AS clause FROM k),
n AS (SELECT doc_id, pos, page, line, CASE WHEN i IS NULL THEN NULL WHEN clause = 0 THEN chapter::VARCHAR WHEN slip % 5 = 1 THEN chapter || '.' || clause || '.1' WHEN slip = 7 THEN chapter || '.' || clause || 'a' ELSE chapter || '.' || clause END AS sid FROM c)"""
BELOW_SQL = "(starts_with({0}, {1} || '.') OR (starts_with({0}, {1}) AND regexp_matches(substr({0}, length({1}) + 1), '^[A-Za-z]$')))"


def numbered(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_id, at, page, line, sid)``: every second line has a number of up to three levels, some of them far off."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    i, slip = F.floor(F.col("at") / 2), F.pmod(F.col("doc_id") * 7 + F.col("at") * 3, F.lit(23))
    chapter, clause = (F.floor(i / 8) + 1 + F.when(slip == 5, 6).otherwise(0)).cast("string"), F.pmod(i, F.lit(8))
    own = F.concat(chapter, F.lit("."), clause.cast("string"))
    sid = F.when(clause == 0, chapter).when(slip % 5 == 1, F.concat(own, F.lit(".1"))).when(slip == 7, F.concat(own, F.lit("a"))).otherwise(own)
    return lines.select("doc_id", F.col("at").cast("long").alias("at"), (F.floor(F.col("at") / PAGE_LINES) + 1).cast("long").alias("page"), "line", F.when(F.pmod("at", F.lit(2)) == 0, sid).alias("sid"))


def paged(spark: SparkSession, d: str) -> DataFrame:
    """``(doc, page, text)``: numbered lines as pages; titles of chapters are in capitals, and some pages are tables of contents."""
    rows = numbered(spark, d)
    title = F.regexp_replace("line", r"[^\p{L} ].*$", "")
    said = F.when(F.col("sid").isNull(), F.col("line")).when(F.col("sid").contains("."), F.concat_ws(" ", "sid", "line")).otherwise(F.concat_ws(" ", "sid", F.upper(title)))
    shown = F.when(F.pmod(F.col("doc_id") + F.col("page"), F.lit(9)) == 0, F.concat(said, F.lit(" ........ 12"))).otherwise(said)
    lines = F.array_sort(F.collect_list(F.struct("at", shown.alias("line"))))  # a page is a dozen lines
    return rows.groupBy(F.col("doc_id").alias("doc"), "page").agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("text"))


@query()
def numbered_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings that carry the numbering of a document on, over its pages (W9, C5, C9, C10, F11, F13, A25); tests hold it against a plain loop."""
    return H.headings(paged(spark, d)).select("doc", "page", F.col("line").cast("long").alias("line"), "sid", "title")


@query(f"""{NUMBERED_SQL}, s AS (SELECT * FROM n WHERE sid IS NOT NULL),
e AS (SELECT a.doc_id, a.pos, arg_min(b.page, b.pos) AS stop_page, arg_min(b.sid, b.pos) AS stop FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.page > a.page
  AND b.sid <> a.sid AND NOT {BELOW_SQL.format('b.sid', 'a.sid')} GROUP BY ALL),
m AS (SELECT doc_id, max(page) AS last_page FROM s GROUP BY 1)
SELECT s.doc_id, s.pos, s.sid, s.page, coalesce(stop_page, greatest(s.page + 8, last_page)) AS end_page, stop FROM s JOIN m USING (doc_id) LEFT JOIN e USING (doc_id, pos)""")
def section_page_windows(spark: SparkSession, d: str) -> DataFrame:
    """The pages that each section spans: to the first later page with one that is not below it, or eight pages on."""
    return H.section_windows(numbered(spark, d).where("sid IS NOT NULL"), ["doc_id"], ["at"]).withColumnsRenamed({"at": "pos", "end": "end_page"})


@query(f"""{NUMBERED_SQL}, s AS (SELECT * FROM n WHERE sid IS NOT NULL),
e AS (SELECT a.doc_id, a.pos, min(b.pos) AS stop FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.pos > a.pos AND NOT {BELOW_SQL.format('b.sid', 'a.sid')} GROUP BY ALL),
o AS (SELECT s.doc_id, s.pos AS section, s.sid, n.pos, n.line, coalesce(sum(length(n.line) + 1) OVER (PARTITION BY s.doc_id, s.pos ORDER BY n.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s LEFT JOIN e USING (doc_id, pos) JOIN n ON n.doc_id = s.doc_id AND n.pos >= s.pos AND n.pos < coalesce(stop, 1000000000) AND n.page < s.page + 4)
SELECT doc_id, section, sid, count(*) AS n_lines, sha256(left(string_agg(line, chr(10) ORDER BY pos), 12000)) AS digest FROM o WHERE before < 12000 GROUP BY ALL""")
def section_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each section's text up to the next heading that is not below it, four pages and 12,000 characters at most."""
    lines = numbered(spark, d)
    got = H.section_bodies(lines.select("doc_id", "at", "page", "line"), lines.where("sid IS NOT NULL").select("doc_id", "at", "page", "sid"), ["doc_id"])
    return got.select("doc_id", "section", "sid", "n_lines", F.sha2("body", 256).alias("digest"))


@query()
def table_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions of tables with what follows them; mentions are none (C7, C8, F15); tests hold it against a plain loop."""
    return H.captions(captioned(spark, d))


def captioned(spark: SparkSession, d: str) -> DataFrame:
    """``(doc, page, text)``: each page has a line that begins with a table's number, on some a clause below it."""
    rows, at = numbered(spark, d), F.pmod("at", F.lit(PAGE_LINES))
    k = F.pmod(F.col("doc_id") + F.col("page"), F.lit(40)).cast("string")
    mark = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.lit(" (Continued)")).when(F.pmod("doc_id", F.lit(5)) == 1, F.lit(" of")).otherwise(F.lit(""))
    said = F.when(at == 3, F.concat(F.lit("Table "), k, mark, F.lit(" "), "line")).when((at == 5) & (F.pmod("doc_id", F.lit(3)) == 0), F.concat(F.lit("(Clause 7."), k, F.lit(")"))).otherwise(F.col("line"))
    lines = F.array_sort(F.collect_list(F.struct("at", said.alias("line"))))  # a page is a dozen lines
    return rows.groupBy(F.col("doc_id").alias("doc"), "page").agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("text"))


EXACT_SQL = NUMBERED_SQL + """,
s AS (SELECT n.doc_id * 1000 + n.pos AS ord, 'k' || n.doc_id || '-' || n.pos AS id, source AS doc, CASE WHEN n.doc_id % 3 = 0 THEN 'commentary' ELSE 'standard' END AS part, CASE WHEN n.doc_id % 4 <> 1 THEN 'specification' ELSE 'notes' END AS collection,
  sid AS section_id, n.doc_id % 7 = 0 AS children, n.doc_id % 5 = 0 AS synthetic, n.page, line AS title FROM n JOIN documents USING (doc_id) WHERE sid IS NOT NULL),
q AS (SELECT item_id AS qid, CASE WHEN item_id % 4 = 3 THEN 'k' || item_id || '-2' ELSE (item_id % 9 + 1) || '.' || (item_id % 5 + 1) END AS sid, CASE WHEN item_id % 2 = 1 THEN 'src' || item_id % 20 END AS scope, item_id % 6 = 0 AS commentary FROM benchmark),
hits AS (SELECT q.qid, s.*, collection = 'specification' AS spec, CASE WHEN collection <> 'specification' OR (part = 'commentary') = commentary THEN 0 WHEN NOT commentary THEN 1 END AS level FROM q JOIN s ON (q.sid = section_id OR q.sid = id) AND (scope IS NULL OR scope = doc)),
kept AS (SELECT * FROM hits WHERE level IS NOT NULL QUALIFY level = min(level) OVER (PARTITION BY qid)),
owned AS (SELECT *, CASE WHEN spec THEN doc || part || section_id ELSE ord::VARCHAR END AS own FROM kept),
best AS (SELECT *, row_number() OVER (PARTITION BY qid, spec, own ORDER BY children DESC, synthetic DESC, page DESC, length(title) DESC, ord DESC) AS r, min(ord) OVER (PARTITION BY qid, spec, own) AS first FROM owned),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY spec DESC, first) AS rank FROM best WHERE r = 1)
SELECT qid, rank, doc, part, section_id, id, page FROM placed WHERE rank <= 20"""


@query(EXACT_SQL)
def exact_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections by id: contents and body as one, the commentary where nothing else answers, the specification first."""
    doc, item = F.col("doc_id"), F.col("item_id")
    text = lambda c: c.cast("string")
    sections = numbered(spark, d).where("sid IS NOT NULL").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select(
        (doc * 1000 + F.col("at")).alias("ord"), F.concat(F.lit("k"), text(doc), F.lit("-"), text(F.col("at"))).alias("id"), F.col("source").alias("doc"), F.when(doc % 3 == 0, "commentary").otherwise("standard").alias("part"),
        F.when(doc % 4 != 1, "specification").otherwise("notes").alias("collection"), F.col("sid").alias("section_id"), (doc % 7 == 0).alias("children"), (doc % 5 == 0).alias("synthetic"), "page", F.col("line").alias("title"),
    )
    said = F.when(item % 4 == 3, F.concat(F.lit("k"), text(item), F.lit("-2"))).otherwise(F.concat(F.lit("Clause "), text(item % 9 + 1), F.lit("."), text(item % 5 + 1), F.lit(".")))
    questions = table(spark, d, "benchmark").select(item.alias("qid"), said.alias("text"), F.when(item % 2 == 1, F.concat(F.lit("src"), text(item % 20))).alias("doc"), (item % 6 == 0).alias("commentary"))
    return L.exact_sections(questions, sections)

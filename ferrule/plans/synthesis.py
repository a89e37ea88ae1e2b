"""Queries over sections that no heading prints; the lines of ``documents`` are the blocks, each document numbered in the way of one family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import synthesis as S
from ferrule.plans import query, table
from ferrule.plans.headings import NUMBERED_SQL, numbered


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every line as a block; every second one is numbered, a chapter in capitals or, on some, as in a table of contents; list items may have lost their number."""
    at, sid, doc = F.col("at"), F.col("sid"), F.col("doc_id")
    family = F.element_at(F.array(*map(F.lit, ("implied", "implied decimal", "dotted", "lettered", "numeric"))), F.pmod(doc, F.lit(5)).cast("int") + 1)
    label = F.element_at(F.array(*map(F.lit, ("section_header", "text", "list_item", "paragraph", "title", "table"))), F.pmod(at + doc, F.lit(6)).cast("int") + 1)
    chapter, last = ~sid.contains("."), F.substring_index(sid, ".", -1)
    title = F.when(chapter & (F.pmod(at, F.lit(32)) != 0), F.upper("line")).otherwise(F.col("line"))
    own = (
        F.when(family == "implied", F.when(chapter, F.concat(F.lit("D"), sid)).otherwise(F.concat(last, F.lit("."))))
        .when(family == "implied decimal", F.when(last.rlike(r"^\d$") & (at % 8 == 4), sid).otherwise(F.concat(last, F.lit("."))))
        .when(family == "lettered", F.concat(F.lit("D"), sid))
        .when((family == "numeric") & chapter, F.concat(F.lit("SECTION "), sid))
        .otherwise(F.when(doc % 2 == 0, sid).otherwise(F.concat(F.lit("C"), sid)))
    )
    rows = numbered(spark, d).select("doc_id", "at", "page", "line", family.alias("family"), label.alias("label"), F.when(sid.isNotNull(), F.concat_ws(" ", own, title)).otherwise(F.col("line")).alias("orig"))
    text = F.when(F.col("label") == "list_item", F.col("line")).otherwise(F.col("orig"))
    part = F.when(doc % 11 == 3, "commentary").when(doc % 11 != 4, "standard")
    return rows.select(doc.alias("doc"), "family", "page", at.alias("pos"), (800.0 - F.pmod(at * 61, F.lit(700))).alias("y"), part.alias("part"), "label", F.when(at % 29 == 7, "furniture").otherwise("body").alias("layer"), text.alias("text"), F.when(at % 3 != 1, F.col("orig")).alias("orig"))


def served(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the numeric documents in two editions; the first is undecoded on every second document."""
    rows = numbered(spark, d).where("doc_id % 5 = 4")
    said = F.when(F.col("sid").isNull(), F.col("line")).when(F.col("at") % 6 == 0, F.concat_ws(" ", F.lit("##"), "sid", "line")).otherwise(F.concat(F.lit("- "), "sid", F.lit(". "), "line"))
    lines = F.array_sort(F.collect_list(F.struct("at", said.alias("line"))))  # a page is a dozen lines
    text = F.array_join(F.transform(lines, lambda r: r["line"]), "\n")
    pages = rows.groupBy(F.col("doc_id").alias("doc"), "page").agg(text.alias("text")).select("*", F.when(F.col("doc") % 11 == 3, "commentary").otherwise("standard").alias("part"), F.explode(F.array(F.lit(1), F.lit(2))).alias("edition"))
    return pages.withColumn("text", F.when((F.col("edition") == 1) & (F.col("doc") % 2 == 0), F.concat(F.repeat(F.lit("G61 "), 21), "text")).otherwise(F.col("text")))


@query()
def synthesised_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections raised out of body text in five ways of numbering, previews left out, with children (C13); tests hold it against a plain loop."""
    got = S.sections(blocks(spark, d))
    return got.select("doc", "part", "sid", "title", "page", "parent", "synthetic", F.col("place.pos").alias("pos"), F.array_join("children", ",").alias("children"))


@query()
def sections_from_pages(spark: SparkSession, d: str) -> DataFrame:
    """Sections that only the served pages have, of the first edition that has any (C13); tests hold it against a plain loop."""
    return S.from_pages(S.synthesised(blocks(spark, d)), served(spark, d)).select("doc", "part", "sid", "title", "page", "parent", F.col("place.pos").alias("pos"))


@query(f"""{NUMBERED_SQL.replace('WITH l', 'WITH RECURSIVE l')},
v AS (SELECT doc_id AS doc, pos, page, line, sid, pos % 7 AS k, (doc_id + page) % 4 = 0 AS sheet FROM n WHERE sid IS NOT NULL AND NOT regexp_matches(sid, '[a-z]$')),
t AS (SELECT *, CASE WHEN k < 3 THEN 'layout' ELSE 'served' END AS origin, (CASE WHEN sheet THEN 2 ELSE 0 END) + CASE WHEN k < 3 THEN 0 ELSE 1 END AS rank FROM v WHERE k < 5),
f AS (SELECT * FROM t QUALIFY origin = 'served' OR pos = min(pos) OVER (PARTITION BY doc, sid, origin)),
x AS (SELECT *, count_if(origin = 'layout') OVER (PARTITION BY doc, sid) > 0 AS laid, min(CASE WHEN sheet THEN pos END) OVER (PARTITION BY doc, sid) AS any_sheet,
  min(CASE WHEN sheet AND origin = 'layout' THEN pos END) OVER (PARTITION BY doc, sid) AS layout_sheet, row_number() OVER (PARTITION BY doc, sid ORDER BY rank, pos) AS r FROM f),
b AS (SELECT *, origin = 'served' AND NOT sheet AND coalesce(layout_sheet IS NOT NULL OR (NOT laid AND any_sheet < pos), false) AS over FROM x WHERE r = 1),
hand AS (SELECT doc, sid, max(pos) AS pos FROM v WHERE k = 5 GROUP BY ALL),
base AS (SELECT doc, sid, line AS title, page, CASE WHEN over THEN 'served, amendment consolidated' ELSE origin END AS source, CASE WHEN over THEN coalesce(layout_sheet, any_sheet) // 12 + 1 END AS sheet_page FROM b ANTI JOIN hand USING (doc, sid)
  UNION ALL SELECT doc, sid, line, page, 'manual', NULL FROM v SEMI JOIN hand USING (doc, sid, pos)),
tops AS (SELECT DISTINCT doc, string_split(sid, '.')[1]::INT AS top FROM base WHERE string_split(sid, '.')[1]::INT > 0),
o AS (SELECT doc, sid, line, page, pos, len(string_split(sid, '.')) AS level, regexp_replace(sid, '\\.[^.]*$', '') AS parent FROM v JOIN tops USING (doc) WHERE k = 6 AND top = string_split(sid, '.')[1]::INT AND NOT EXISTS (FROM base WHERE base.doc = v.doc AND base.sid = v.sid)),
g AS (SELECT doc, sid, min(pos) AS pos, 1 AS level FROM o WHERE level = 1 GROUP BY ALL UNION ALL SELECT doc, sid, min(pos), 2 FROM o WHERE level = 2 AND EXISTS (FROM base WHERE base.doc = o.doc AND base.sid = o.parent) GROUP BY ALL
  UNION ALL SELECT o.doc, o.sid, min(o.pos), 2 FROM o WHERE o.level = 2 AND NOT EXISTS (FROM base WHERE base.doc = o.doc AND base.sid = o.parent) AND o.pos > (SELECT min(p.pos) FROM o p WHERE p.level = 1 AND p.doc = o.doc AND p.sid = o.parent) GROUP BY ALL),
h AS (FROM g UNION ALL SELECT o.doc, o.sid, min(o.pos), 3 FROM o WHERE o.level = 3 AND (EXISTS (FROM base WHERE base.doc = o.doc AND base.sid = o.parent) OR o.pos > (SELECT min(g.pos) FROM g WHERE g.doc = o.doc AND g.sid = o.parent)) GROUP BY ALL)
FROM base UNION ALL SELECT h.doc, h.sid, line, page, 'old', NULL FROM h JOIN v ON v.doc = h.doc AND v.pos = h.pos""")
def merged_headings(spark: SparkSession, d: str) -> DataFrame:
    """One heading an id out of layout, served text, entries by hand and an old list, amendments put behind the consolidated text."""
    rows = numbered(spark, d).where("sid IS NOT NULL AND NOT sid RLIKE '[a-z]$'")
    origin = F.element_at(F.array(*map(F.lit, ("layout", "layout", "layout", "served", "served", "manual", "old"))), F.pmod("at", F.lit(7)).cast("int") + 1)
    heads = rows.select(F.col("doc_id").alias("doc"), origin.alias("origin"), F.col("at").alias("pos"), "sid", F.col("line").alias("title"), "page")
    amended = heads.select("doc", "page").where((F.col("doc") + F.col("page")) % 4 == 0)
    return S.merged(heads, amended)

"""Queries over names: a dictionary of the longer words and pairs of words of ``benchmark``, sought in ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import names as N
from ferrule.plans import query, table

NAMES_SQL = r"""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM benchmark),
i AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM b),
names AS (SELECT DISTINCT w[i] AS name, left(w[i], 5) AS grp FROM i WHERE length(w[i]) >= 7 UNION SELECT DISTINCT w[i] || ' ' || w[i + 1], left(w[i], 5) FROM i WHERE length(w[i]) >= 7 AND i < len(w)),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
lw AS (SELECT doc_id, source, n, line, regexp_extract_all(lower(line), '[\p{L}\p{M}\p{N}]+') AS w FROM l),
p AS (SELECT doc_id, source, n, line, w, unnest(range(1, len(w) + 1)) AS i FROM lw),
m AS (SELECT doc_id, source, n, line, i - 1 AS pos, name, grp, 1 AS words FROM p JOIN names ON w[i] = name UNION ALL SELECT doc_id, source, n, line, i - 1, name, grp, 2 FROM p JOIN names ON w[i] || ' ' || w[i + 1] = name)"""


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Words of seven letters and more, and each with the word after it; those with the same first five letters are one group."""
    w = table(spark, d, "benchmark").select(N.words(F.col("text")).alias("w"))
    at = w.select(F.posexplode("w").alias("i", "name"), "w").where(F.length("name") >= 7)
    after = F.get("w", F.col("i") + 1)
    both = at.select(F.explode(F.array_compact(F.array("name", F.when(after.isNotNull(), F.concat_ws(" ", "name", after))))).alias("name"), F.substring("name", 1, 5).alias("group"))
    return N.dictionary(both.distinct())


@query(f"""{NAMES_SQL} SELECT name, grp AS "group", count(*) AS n, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM m GROUP BY ALL""")
def name_mentions(spark: SparkSession, d: str) -> DataFrame:
    """All names of a dictionary in all texts in one pass."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\\n")).alias("text"))
    found = N.mentions(lines, dictionary(spark, d))
    return found.groupBy("name", "group").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first"))


def _asked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Hits and misses of questions for the last long word of each item, in listings of every fourth document and the next."""
    long = F.filter(N.words(F.col("text")), lambda x: F.length(x) >= 7)
    said = F.when(F.col("item_id") % 5 == 0, F.lit("seismic zone factor for ")).when(F.col("item_id") % 5 == 1, F.lit("who lives in ")).otherwise(F.lit("wind speed at "))
    name = F.when(F.col("item_id") % 5 == 4, F.lit("Atlantis")).otherwise(F.element_at(long, -1))
    questions = table(spark, d, "benchmark").where(F.size(long) > 0).select(F.col("item_id").alias("qid"), F.concat(said, name).alias("text"))
    known = dictionary(spark, d).unionByName(N.dictionary(spark.sql("SELECT 'Atlantis' AS name, 'none' AS `group`")))
    pages = table(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    return N.name_answers(questions, known, N.listing_pages(pages, F.col("page") % 4 == 0, F.col("page") % 3 == 0))


ASKED_SQL = NAMES_SQL + r""",
q AS (SELECT item_id AS qid, item_id % 5 AS kind, list_filter(w, lambda x: length(x) >= 7) AS long FROM b),
a AS (SELECT qid, CASE WHEN kind = 4 THEN 'Atlantis' ELSE long[-1] END AS asked, CASE WHEN kind = 4 THEN 'none' ELSE left(long[-1], 5) END AS grp FROM q WHERE len(long) > 0 AND kind <> 1),
pg AS (SELECT DISTINCT source, doc_id FROM documents e WHERE doc_id % 4 = 0 OR (doc_id % 3 <> 0 AND EXISTS (FROM documents o WHERE o.source = e.source AND o.doc_id = e.doc_id - 1 AND o.doc_id % 4 = 0))),
h AS (SELECT qid, asked, source, m.doc_id, n, name, line, row_number() OVER (PARTITION BY qid, source ORDER BY m.doc_id, n, pos, words DESC, name) AS r FROM a JOIN m USING (grp) JOIN pg USING (source, doc_id)),
hits AS (SELECT qid, asked, source AS doc, doc_id AS page, n AS line, name, trim(line) AS snippet FROM h WHERE r = 1)"""


@query(f"{ASKED_SQL} SELECT qid, asked, doc, page, line, name, sha256(snippet) AS snippet FROM hits")
def name_answers(spark: SparkSession, d: str) -> DataFrame:
    """Questions that ask for a name, and the first line of each listing that has it or a variant."""
    hits, _ = _asked(spark, d)
    return hits.select("qid", "asked", "doc", "page", F.col("line").cast("long").alias("line"), "name", F.sha2("snippet", 256).alias("snippet"))


@query(f"""{ASKED_SQL}, e AS (SELECT qid, asked, source AS doc FROM a, (SELECT DISTINCT source FROM pg) WHERE qid IN (SELECT qid FROM hits))
SELECT qid, asked, doc FROM e WHERE (qid, doc) NOT IN (SELECT qid, doc FROM hits) UNION ALL SELECT qid, asked, NULL FROM a WHERE qid NOT IN (SELECT qid FROM hits)""")
def names_not_tabulated(spark: SparkSession, d: str) -> DataFrame:
    """Listings that do not have a name, and names that none has."""
    return _asked(spark, d)[1]

"""Queries that edit pages; each document is a page of its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import edits as E
from ferrule.plans import query, table


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Two transcriptions for every third page: after its second line, and after a line that some pages have; lines of symbols are superseded on every sixth."""
    third = pages(spark, d).where("page % 3 = 0")
    second = F.regexp_extract("text", r"^[^\n]*\n([^\n ]+)", 1)
    noise = F.when(F.col("page") % 6 == 0, F.array(F.lit(r"[*$%#]{3}"))).otherwise(F.array().cast("array<string>"))
    kinds = F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("T1").alias("id"), F.concat(F.lit("^\\Q"), second, F.lit("\\E")).alias("anchor"), noise.alias("supersede")),
        F.struct(F.lit(2).alias("ord"), F.lit("T2").alias("id"), F.lit("^(The|Die|Le|La) ").alias("anchor"), F.array().cast("array<string>").alias("supersede")),
    )
    rows = third.select("doc", "page", F.explode(kinds).alias("e"))
    return rows.select("doc", "page", "e.ord", F.concat_ws(":", F.lit("FIGURE"), "doc", "page", "e.id").alias("tag"), F.concat(F.lit("| a | b |\n| "), F.col("page").cast("string"), F.lit(" | 2 |")).alias("body"), "e.anchor", "e.supersede", F.lit(True).alias("after_image"))


@query()
def inserted_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Tagged blocks after their anchors, superseded lines put aside, missing anchors named (C33); tests hold it against a plain loop."""
    got = E.insert_blocks(pages(spark, d), entries(spark, d))
    return got.select("doc", "page", F.sha2("text", 256).alias("digest"), F.array_join("missing", ",").alias("missing"))


@query(r"""WITH w AS (SELECT source AS doc, doc_id AS page, text, unnest([1, 2, 3]) AS ord, unnest(['(' || doc_id || ')', '7.' || doc_id, substr(coalesce(text, ''), 1, 4)]) AS id FROM documents WHERE doc_id % 2 = 0),
t AS (SELECT doc, page, min(ord) AS ord, CASE WHEN starts_with(id, '(') THEN id ELSE '(' || id || ')' END AS token FROM w WHERE id <> '' AND NOT contains(coalesce(text, ''), id) AND NOT contains(coalesce(text, ''), CASE WHEN starts_with(id, '(') THEN id ELSE '(' || id || ')' END) GROUP BY ALL),
s AS (SELECT doc, page, string_agg(token, ' ' ORDER BY ord) AS line, count(*) AS n FROM t GROUP BY ALL)
SELECT source AS doc, doc_id AS page, sha256(CASE WHEN n > 0 THEN regexp_replace(coalesce(text, ''), '\s+$', '') || chr(10) || line || chr(10) ELSE text END) AS digest, coalesce(n, 0) AS spliced
FROM documents LEFT JOIN s ON source IS NOT DISTINCT FROM doc AND doc_id = page""")
def spliced_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Ids that a page lacks, appended to it."""
    p = pages(spark, d)
    ids = F.array(F.concat(F.lit("("), F.col("page").cast("string"), F.lit(")")), F.concat(F.lit("7."), F.col("page").cast("string")), F.substring(F.coalesce("text", F.lit("")), 1, 4))
    census = p.where("page % 2 = 0").select("doc", "page", F.posexplode(ids).alias("pos", "id")).select("doc", "page", F.col("pos").cast("long").alias("ord"), "id", F.when(F.col("id").startswith("("), F.col("id")).alias("verbatim"))
    return E.splice_tokens(p, census).select("doc", "page", F.sha2("text", 256).alias("digest"), "spliced")

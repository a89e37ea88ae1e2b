"""Exact lookup of tables by id: what matches, which matches are narrowed away, and the order of what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.text import table_id
from ferrule.operators.lookup import narrow, not_part
from ferrule.operators.retrieval import top

#: Collections in the order of their answers.
COLLECTIONS = ("specification", "opensees", "examples")
KEYS = ("own", "collection", "unnamed", "toc", "continued", "empty", "rows", "page", "unverified")


def squeezed(c: Column) -> Column:
    return F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("")))


def exact_tables(questions: DataFrame, tables: DataFrame, limit: int = 20) -> DataFrame:
    """``(qid, rank, doc, table_id, part, pdf_page)``: the tables that ``questions(qid, asked, want_commentary)`` ask for.

    ``tables`` holds ``doc, table_id, label, title, excerpt, part, collection, superseded, caption_verified, structured_row, continued,
    row_of_table, toc, num_rows, pdf_page``; any may be null. A table matches by its id, its label, or by naming the id in its title or
    excerpt; figures only as a whole number. Of a question's matches, in this order and each only where it leaves any: not of a
    commentary, with an id, with the very id, not superseded, verified (and what continues them), no single row of a table. A
    bare number that is no table's id asks for its parts ``9(a)``, or for nothing. The questions are a stated set, asked in blocks.
    """
    q = questions.select("qid", squeezed(table_id(F.col("asked"))).alias("__q"), F.coalesce("want_commentary", F.lit(False)).alias("__want")).where("__q <> ''")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = tables.withColumns({"__rid": squeezed(F.col("table_id")), "__lab": squeezed(F.col("label")), "__blob": squeezed(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("excerpt", F.lit(""))))})
    rows = rows.crossJoin(F.broadcast(q))
    own = (F.col("__rid") == F.col("__q")) | (F.col("__lab") == F.col("__q"))
    figure = F.col("__q").startswith("fig.")
    named = F.when(figure, F.rlike("__blob", F.concat(F.lit("\\Q"), "__q", F.lit("\\E(?!\\d)")))).otherwise(F.contains("__blob", "__q"))
    specification, commentary = F.coalesce(F.col("collection") == "specification", F.lit(False)), F.coalesce(F.col("part") == "commentary", F.lit(False))
    rows = rows.where(own | named).withColumn("__own", own).where(~F.col("__want") | ~specification | commentary)
    verified = flag("caption_verified") | flag("structured_row")
    rows = narrow(rows, ["qid"], [F.col("__want") | ~specification | not_part(F.col("part"), "commentary"), F.col("__rid") != "", F.col("__own"), ~flag("superseded")])
    any_ = rows.groupBy("qid").agg(F.max(verified).alias("__any"))
    rows = rows.join(any_, "qid").where(~F.col("__any") | verified | flag("continued"))
    rows = narrow(rows, ["qid"], [~flag("row_of_table")])
    part_of = F.rlike("__rid", F.concat(F.lit("\\A\\Q"), "__q", F.lit("\\E\\([a-z]\\)\\z")))
    rows = rows.where(F.col("__own") | ~F.col("__q").rlike(r"\A\d+[a-z]?\z") | part_of)
    place = F.coalesce(*[F.when(F.col("collection") == c, i) for i, c in enumerate(COLLECTIONS)], F.lit(9))
    n = F.coalesce(F.col("num_rows"), F.lit(0))
    order = F.struct(
        *[c.cast("long").alias(k) for k, c in zip(KEYS, (F.when(F.col("__rid") == F.col("__q"), 0).otherwise(1), place, F.when(F.col("__rid") == "", 1).otherwise(0), flag("toc"), flag("continued"), n == 0, -n, F.coalesce("pdf_page", F.lit(0)), ~verified))],
        "doc", "table_id", "part", "pdf_page",
    )
    key = F.when(F.col("__rid") != "", F.col("table_id")).otherwise(F.concat(F.lit("title:"), F.substring(F.coalesce("title", F.lit("")), 1, 40)))
    best = rows.groupBy("qid", F.col("doc").alias("__doc"), key.alias("__key"), F.col("part").alias("__part")).agg(F.min(order).alias("m"))
    return top(best, ["qid"], [F.col("m")], limit).select("qid", "rank", "m.doc", "m.table_id", "m.part", "m.pdf_page")

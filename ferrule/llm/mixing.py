r"""Operator 8, mixing sources to target weights, with DataFrame functions alone.

Every document gets a hash-random key. Within its source it falls into a range of keys, and each range holds about
``RANGE_ROWS`` documents, so a source with a third of all rows is spread like any other. Token counts are summed by
range, the sums are added up over the ranges of a source, and a window inside one range finishes the prefix sum: a
distributed prefix sum with one shuffle of (id, source, size, key), never of a text. A source is then cut at its exact
budget: every document as often as the budget holds whole epochs, and the rest in key order, the last document in part.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share the total by weight; a target
stops at ``EPOCHS`` times its source's size and the excess is shared again by weight. Sorted by the level at which they
fill up, that is one pass of running sums over the sources.

Defined results: a null or empty text has size 0 and is taken 0 times; a null source is a source of its own; a null id
hashes like an empty one; repeated rows are cut in turn, in the order (key, size), so which of two equal rows comes
first cannot be told apart; other columns are not read; an empty table gives none; a very long text is counted whole. One task sorts
the sources, a name and a size for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.llm.common import kept, table

WEIGHTS, EPOCHS, SEED, RANGE_ROWS = (5, 2, 1), 3, 17, 4096
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``sources(source, source_size)``, one row a source -> also ``target`` double and ``budget`` long, the words to take."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("weight", F.array(*map(F.lit, weights))[F.pmod(turn, F.lit(len(weights)))].cast("long"))
    up = Window.orderBy((F.col("source_size").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    cap = F.col("source_size") * epochs
    run = weighed.withColumns({"cap": cap, "left": F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)), "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    # With the sources that fill up earlier at their caps, this one fills up too if its share of what is left reaches
    # its cap; what is left to the first that does not, shared by weight, is the level of all that do not.
    full = run.withColumn("full", F.col("left") * F.col("weight") >= F.col("cap") * F.col("weight_left"))
    left = F.max(F.when(~F.col("full"), F.col("left"))).over(everything)
    shares = F.max(F.when(~F.col("full"), F.col("weight_left"))).over(everything)
    share = left.cast("double") * F.col("weight") / shares
    return full.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)).select("source", "source_size", "target", F.round("target").cast("long").alias("budget"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """``(id, source, size, source_size, target, taken)`` of every row: how many of its words the mix takes, repeats counted."""
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    rows = kept(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key")))
    sources = kept(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / RANGE_ROWS).alias("ranges")))
    budgets = targets(sources.select("source", "source_size"), weights, epochs)
    about = sources.select(F.col("source").alias("s"), "ranges").join(budgets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    place = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(float(1 << 32)))
    dealt = rows.join(about, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("range", place)
    sums = dealt.groupBy(F.col("source").alias("s"), F.col("range").alias("r")).agg(F.sum("size").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("s", "r", earlier.alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = dealt.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).withColumn("start", start)
    whole, rest = F.expr("coalesce(try_divide(budget - budget % nullif(source_size, 0), source_size), 0)").cast("long"), F.expr("coalesce(budget % nullif(source_size, 0), 0)")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return placed.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}') AS key FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source),
total AS (SELECT sum(source_size) AS t FROM src),
fill(n, level, fixed) AS (
  SELECT 0, (SELECT t FROM total) / (SELECT sum(w) FROM src)::DOUBLE, -1::BIGINT
  UNION ALL
  SELECT n + 1,
    ((SELECT t FROM total) - (SELECT coalesce(sum(3 * source_size), 0) FROM src WHERE 3 * source_size <= f.level * w))::DOUBLE
      / (SELECT sum(w) FROM src WHERE 3 * source_size > f.level * w),
    (SELECT count(*) FROM src WHERE 3 * source_size <= f.level * w)
  FROM fill f WHERE f.fixed <> (SELECT count(*) FROM src WHERE 3 * source_size <= f.level * w)),
lvl AS (SELECT max(level) AS level FROM fill),
tgt AS (SELECT source, source_size, least(3.0 * source_size, level * w)::DOUBLE AS target FROM src, lvl),
placed AS (
  SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(0, least(size, budget % source_size - start)) END AS BIGINT) AS taken
FROM placed
"""

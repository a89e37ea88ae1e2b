"""Sinks: index tables, JSON, CSV with a fixed column list, ordered text. Writes are Spark's own, so they replace a result whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators.retrieval import tokens
from ferrule.shared import new_path


#: Postings a bucket of the index holds, about.
BUCKET_ROWS = 5_000_000


def write_index(docs: DataFrame, path: str, doc: str, text: str, words=tokens) -> None:
    """The full-text index: ``fts_docs``, ``doc_len``, and ``postings`` with the places of a term in a document, in buckets by a hash
    of the term, as many as the number of postings asks for, so a query reads few files. ``words`` cuts a text column into terms."""
    spark, at = docs.sparkSession, new_path(docs.sparkSession, "terms-")
    docs.select(F.col(doc).alias("doc"), words(F.col(text)).alias("w")).write.parquet(at)
    cut = spark.read.parquet(at)  # texts are cut into terms once
    docs.select(F.col(doc).alias("doc"), F.col(text).alias("body")).write.mode("overwrite").parquet(f"{path}/fts_docs")
    cut.select("doc", F.coalesce(F.size("w"), F.lit(0)).alias("dl"), F.coalesce(F.size(F.array_distinct("w")), F.lit(0)).alias("kinds")).write.mode("overwrite").parquet(f"{path}/doc_len")
    total = spark.read.parquet(f"{path}/doc_len").agg(F.sum("kinds")).first()[0] or 0
    buckets = max(16, -(-total // BUCKET_ROWS))
    posts = cut.select("doc", F.posexplode("w").alias("pos", "term")).groupBy("term", "doc").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    posts = posts.select("term", "doc", F.size("at").alias("tf"), "at", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("part"))
    # Rebalanced, so that the files of a term that very many documents hold are shared out.
    posts.hint("rebalance", F.col("part")).sortWithinPartitions("part", "term", "doc").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.mode("overwrite").json(f"{path}/layout")


def read_postings(spark, path: str, terms: list[str]) -> DataFrame:
    """Postings of a few terms; partitions and row groups without them are not read."""
    buckets = spark.read.json(f"{path}/layout").first().buckets
    parts = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(buckets))).distinct().collect()]
    return spark.read.parquet(f"{path}/postings").where(F.col("part").isin(parts) & F.col("term").isin(terms)).select("term", "doc", "tf", "at")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns in order, nothing for null; a column that is not there is empty."""
    have = set(df.columns)
    df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_text(df: DataFrame, path: str, by: str, order: str, line: str) -> None:
    """One text row a group, its lines in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n")
    df.groupBy(by).agg(body.alias("value")).select("value").write.mode("overwrite").text(path)

"""A queue of plans: files of questions that arrive in a folder are answered once each and archived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLAN = "plan_id string, submitted string, queries array<struct<type:string,query:string,limit:int>>"
HITS = "array<struct<rank:long,doc:string>>"
ANSWERS = f"file string, n long, type string, query string, `limit` int, key string, fingerprint string, found boolean, cached boolean, stage string, hits {HITS}, batch long, plan string"


def plans(files: DataFrame) -> DataFrame:
    """``(plan, file, n, type, query, limit, key)`` of ``files(value, file)``: a row for each question, numbered from 1.

    A plan goes by its ``plan_id``, or the name of its file; of files with one id the last by name counts. A plan without questions, or a
    file that is no plan, is a row without a number, so that none is lost.
    """
    p = F.from_json("value", PLAN)
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    own = files.select(F.coalesce(F.nullif(p["plan_id"], F.lit("")), stem).alias("plan"), "file", F.coalesce(p["queries"], F.array().cast("array<struct<type:string,query:string,limit:int>>")).alias("queries"))
    last = own.groupBy("plan").agg(F.max(F.struct("file", "queries")).alias("m")).select("plan", "m.*")
    rows = last.select("plan", "file", F.posexplode_outer("queries").alias("pos", "q"))
    kind, text, limit = F.coalesce("q.type", F.lit("auto")), F.coalesce("q.query", F.lit("")), F.coalesce("q.limit", F.lit(5))
    key = F.sha2(F.to_json(F.struct(limit.alias("limit"), text.alias("query"), kind.alias("type"))), 256)
    given = F.col("pos").isNotNull()
    return rows.select("plan", "file", (F.col("pos") + 1).cast("long").alias("n"), *[F.when(given, c).alias(k) for k, c in (("type", kind), ("query", text), ("limit", limit), ("key", key))])


def answered(spark: SparkSession, out: str) -> DataFrame:
    """All answers so far; none before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ANSWERS)
    return spark.read.schema(ANSWERS).parquet(out)


def answer_batch(files: DataFrame, batch: int, out: str, answer: Callable[[DataFrame], DataFrame], fingerprint: str) -> None:
    """Answers the plans of one batch into a folder for each plan, which a second run of the batch overwrites with the same.

    A question that an earlier plan has asked of the same corpus, by its key and the ``fingerprint``, is taken from there; those of the batch
    are asked once however many plans ask them. ``answer(qid, text)`` gives ``(qid, doc, rank, stage)``.
    """
    spark = files.sparkSession
    asked = plans(files).persist()
    try:
        own = asked.select("plan").distinct()
        known = answered(spark, out).where(F.col("fingerprint") == fingerprint).join(own, "plan", "left_anti").groupBy("key").agg(F.max(F.struct("found", "stage", "hits")).alias("old"))
        keys = asked.where("n IS NOT NULL").groupBy("key").agg(F.first("query").alias("text"), F.max("limit").alias("limit")).join(known, "key", "left")
        got = answer(keys.where("old IS NULL").select(F.col("key").alias("qid"), "text")).select(F.col("qid").alias("key"), F.col("doc").cast("string").alias("doc"), F.col("rank").cast("long").alias("rank"), "stage")
        near = got.join(keys.select("key", "limit"), "key").where(F.col("rank") <= F.col("limit"))
        fresh = near.groupBy("key").agg(F.max("stage").alias("stage"), F.array_sort(F.collect_list(F.struct("rank", "doc"))).alias("hits"))  # a question's limit bounds its hits
        by_key = keys.join(fresh, "key", "left").select("key", F.col("old").isNotNull().alias("cached"), F.coalesce("old.stage", "stage").alias("stage"), F.coalesce("old.hits", "hits", F.array().cast(HITS)).alias("hits"))
        rows = asked.join(by_key, "key", "left").withColumns({"found": F.coalesce(F.size("hits") > 0, F.lit(False)), "cached": F.coalesce("cached", F.lit(False)), "fingerprint": F.lit(fingerprint), "batch": F.lit(batch).cast("long")})
        names = [f.name for f in spark.createDataFrame([], ANSWERS).schema]
        rows.select(*names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("plan").parquet(out)
    finally:
        asked.unpersist()


def drain(spark: SparkSession, inbox: str, out: str, done: str, checkpoint: str, answer: Callable[[DataFrame], DataFrame], fingerprint: str, pattern: str = "*.json"):
    """Answers all plans in ``inbox`` as one stream that ends when none is left; what has been answered moves to ``done`` as the stream goes on.

    The checkpoint names the files of each batch before it is answered, so one that was cut off is answered again into the same folders, and
    one that was committed is never taken up again. Readers order answers by batch and file name.
    """
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("cleanSource", "archive").option("sourceArchiveDir", done).load(inbox)
    named = files.select("value", F.col("_metadata.file_name").alias("file"))
    put = lambda rows, batch: answer_batch(rows, batch, out, answer, fingerprint)
    return named.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def summary(answers: DataFrame) -> DataFrame:
    """``(batch, file, plan, n_queries, n_found, n_cached)``, as an answer file begins."""
    return answers.groupBy("batch", "file", "plan").agg(F.count("n").alias("n_queries"), F.count_if("found").alias("n_found"), F.count_if("cached").alias("n_cached"))

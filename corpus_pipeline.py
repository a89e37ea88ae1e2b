"""The corpus pipeline: five stages over ``documents``, each one operator, each over all its predecessor kept.

Every stage but the last returns the columns of documents; the last returns how many words the mix takes of each.

Defined results, stage by stage, for input that is not as it should be: columns beyond those of documents are handed on whatever
their names; an empty table gives none. Quality: a null or empty text weighs 0 and is sampled like any other weight; rows that
repeat stay or go together. Near-duplicates: null and empty texts are one group; of rows that repeat an id one stays, and rows
without an id all stay. Decontamination: a null or empty text is clean. Personal data: a null text stays null. Mixing: a null
or empty text has size 0. Very long texts are read whole by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import kept, table
from ferrule.llm.decontamination import drop_contaminated
from ferrule.llm.mixing import mix
from ferrule.llm.pii import sanitise
from ferrule.llm.quality import keep_sample
from ferrule.llm.simhash import keep_one


#: Rows of an Arrow batch: a document's whole text and columns pass through Python in the filtering stages.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker and its executor hold at once; a session that asks for less keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    _small_batches(spark)
    return keep_sample(docs, table(spark, sf_dir, "labels"), tempered=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    _small_batches(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold enough of the benchmark go."""
    _small_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it leave the texts; ``n_chars`` counts what is left."""
    return sanitise(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, repeats counted."""
    return mix(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("mixing", mixing)]

#: SQL cannot express the classifier, the fingerprints or the sanitisation; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what a stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

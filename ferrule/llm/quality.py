"""Operator 2, quality classifier: importance resampling with hashed n-gram models.

Two generative models over hashed unigrams and bigrams, one of the target text (documents labelled good) and one of the
raw text (every document), give each document a log importance weight: the sum of log ratios over its n-grams. A pair
of equal words is one feature, whatever the word. Gumbel noise, fixed by id and seed, is added to the weight, and the ``k``
largest keys are the sample: a draw without replacement in proportion to target over raw probability. Unless given, ``k``
is the share of good documents among the labels times the number of documents. What falls out of the sample is rejected.

``tempered`` is an option for filters that have to reject little. N-grams of a text are not independent, so the weight is
then the mean times the root of the number of n-grams, of which ``EVIDENCE`` at most count, divided by ``TEMPERATURE``;
noise decides between documents near the cut and leaves the others alone. Unless given, ``k`` is then the number of
documents whose tempered weight does not speak against the target: it is at least ``CUT``.

Raw counts cover all documents: a task sums its documents into one vector of ``BUCKETS`` counts, and the vectors are
added by bucket. The target model uses at most ``TARGET_ROWS`` labelled documents, the first by a hash of the id, a
documented bound; that id set alone is broadcast. The k-th key is found by a range partition, its sizes, and a ranking
of the one partition that holds it; a text is never shuffled.

Defined results: a null or empty text has no n-grams and weight 0; a null id draws its noise like an empty one; repeated
rows have equal keys and are kept or rejected together, so ties with the last key all stay; repeated labels of an id
count once, as good only if all say so; null labels are ignored; without labels every document is in the sample, without
good ones every weight is 0 and, untempered, none is drawn; columns other
than the id and the text are handed on or ignored, never read; an empty table gives none; a very long text is weighed whole, in
memory in proportion to it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import kept, table, tidy

BUCKETS, TARGET_ROWS, CUT, TEMPERATURE, EVIDENCE, SEED = 1 << 14, 20_000, math.log(0.05), 0.25, 256, 5
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x00-\x20\x7f]+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def ngrams(raw: bytes | None) -> np.ndarray:
    """Buckets of a text's unigrams and bigrams, repeats included."""
    tokens = TOKEN.findall(raw.lower()) if raw else []
    h = np.fromiter(map(crc32, tokens), np.uint64, len(tokens))
    two = np.where(h[1:] == h[:-1], np.uint64(1), h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:] * MIX)
    return ((np.concatenate([h, two]) * MIX) >> np.uint64(50)).astype(np.int64)


def _labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("g")).agg(F.min(label_col).alias("q"))


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", target_rows: int = TARGET_ROWS) -> np.ndarray:
    """log(target / raw) by bucket; the target model is smoothed towards the raw one."""
    good = _labelled(labels, id_col, label_col).where("q > 0").orderBy(F.xxhash64("g"), "g").limit(target_rows).select("g")
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(good), F.col("id") == F.col("g"), "left").select(F.col("g").isNotNull().alias("good"), "text")

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for good, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                c = np.bincount(ngrams(raw), minlength=BUCKETS)
                n[0] += c
                if good:
                    n[1] += c
        at = np.flatnonzero(n[0])
        yield pa.record_batch([pa.array(at), pa.array(n[0][at]), pa.array(n[1][at])], names=["b", "raw", "target"])

    total = marked.mapInArrow(count, "b long, raw long, target long").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = total.column("b").to_numpy()
    raw[at], target[at] = total.column("raw").to_numpy(), total.column("target").to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS)
    p = (raw + 1) / (raw.sum() + BUCKETS)
    return np.log((target + BUCKETS * p) / (target.sum() + BUCKETS)) - np.log(p)


def weigh(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, log_weight double, tempered double)`` of every whole text; ``id_col`` may be any column, a struct of a whole row too."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for b in batches:
            found = [ngrams(x) for x in b.column(1).cast(pa.binary()).to_pylist()]
            w = [float(r[x].sum()) for x in found]
            tempered = [v / max(1, len(x)) * math.sqrt(min(len(x), EVIDENCE)) for v, x in zip(w, found, strict=True)]
            yield pa.record_batch([b.column(0), pa.array(w, pa.float64()), pa.array(tempered, pa.float64())], names=["id", "log_weight", "tempered"])

    shape = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("log_weight", T.DoubleType()), T.StructField("tempered", T.DoubleType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, shape).withColumnRenamed("id", id_col)


def gumbel(id_col: str | Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise, fixed by id and seed."""
    own = F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))
    u = (F.shiftrightunsigned(F.xxhash64(own, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def kth_key(keys: DataFrame, k: int) -> float | None:
    """The k-th largest value of ``keys(key double)``; None if there are no more than ``k`` rows."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(keys.repartitionByRange(n, F.desc("key")).select("key", F.spark_partition_id().alias("part")))
    sizes = {r.part: r.n for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    if k >= sum(sizes.values()) or k < 1:
        return None if k >= 1 else math.inf
    for part in sorted(sizes):
        if k <= sizes[part]:
            ranked = ranged.where(F.col("part") == part).withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("key"))))
            return ranked.where(F.col("rank") == k).first().key
        k -= sizes[part]


def sample_key(tempered: bool, id_col: str | Column, seed: int = SEED) -> Column:
    """The key whose largest values are the sample."""
    return (F.col("tempered") / TEMPERATURE if tempered else F.col("log_weight")) + gumbel(id_col, seed)


def sample_size(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> int:
    """The share of good documents among all labels times the number of documents, rounded; all of them if there are no labels."""
    n = _labelled(labels, id_col, label_col).agg(F.count("*").alias("all"), F.count_if(F.col("q") > 0).alias("good")).first()
    rows = docs.count()
    return rows if not n["all"] else (2 * rows * n.good + n["all"]) // (2 * n["all"])


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", k: int | None = None, seed: int = SEED, tempered: bool = False) -> tuple[np.ndarray, float | None, DataFrame]:
    """The log ratios, the least key of the sample (None: all rows), and ``(id, log_weight, tempered, sample_key)`` of every row."""
    ratios = log_ratios(docs, labels, id_col, text_col, label_col)
    weighed = kept(weigh(docs, ratios, id_col, text_col).withColumn("sample_key", sample_key(tempered, id_col, seed)))
    if k is None and tempered:
        k = weighed.where(F.col("tempered") >= CUT).count()
    elif k is None:
        k = sample_size(weighed, labels, id_col, label_col)
    return ratios, kth_key(weighed.select(F.col("sample_key").alias("key")), k), weighed


def selected(least: float | None, key: str = "sample_key") -> Column:
    return F.lit(True) if least is None else F.col(key) >= F.lit(least)


def keep_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", k: int | None = None, tempered: bool = False) -> DataFrame:
    """The rows of ``docs``, all columns, that the sample of ``k`` keeps; weighed once more in place, so no text is shuffled."""
    ratios, least, _ = resample(docs, labels, id_col, text_col, label_col, k, tempered=tempered)
    again = weigh(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")), ratios, "row")
    return again.withColumn("sample_key", sample_key(tempered, F.col("row")[id_col])).where(selected(least)).select("row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, log_weight, tempered, sample_key, selected, draw_key, drawn of every document: the pipeline's tempered filter, and the untempered draw."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    _, least, weighed = resample(documents, labels, tempered=True)
    both = weighed.withColumn("draw_key", sample_key(False, "doc_id"))
    last = kth_key(both.select(F.col("draw_key").alias("key")), sample_size(weighed, labels))
    return both.select("doc_id", "log_weight", "tempered", "sample_key", selected(least).alias("selected"), "draw_key", selected(last, "draw_key").alias("drawn"))

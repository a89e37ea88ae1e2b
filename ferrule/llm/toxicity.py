"""Operator 4, toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the hashed character n-grams of 4 to 8 code points that a lower-cased text holds at least once. From
labelled texts come smoothed log-count ratios; the ``FEATURES`` n-grams that tell the classes apart best are kept, each
scaled by its ratio, and a logistic regression is fitted on them by gradient descent.

Training uses at most ``TRAIN_ROWS`` labelled rows, the first by a hash of the id, a documented bound; they are joined
by a broadcast of that bounded set. Counts are summed over tasks, and the driver gets the kept features of that many
rows at most. Scoring covers every whole text: an Arrow map with one table of weights, no shuffle.

Only the text reaches a score. Rows whose crc32(id as text) mod 5 is 0 are held out and never train.

Defined results: a null or empty text has no features and scores the base rate; rows are independent, so repeated rows
repeat; repeated labels of an id count once, as toxic if any says so; null labels are ignored; without labels of both
kinds every score is the base rate (a half if there are none); a null id is held out like an empty one; other columns
are not read; an empty table gives none; a very long text is cut into blocks of ``CHUNK`` code points that overlap by an n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import kept, table

ORDERS, BITS, FEATURES, TRAIN_ROWS, LEAST, CHUNK = (4, 5, 6, 7, 8), 22, 8_000, 12_000, 3, 1 << 18


def buckets(text: str | None, keep: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of a text's n-grams, those in ``keep`` (a mask over buckets) alone if given."""
    code = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    found = []
    for at in range(0, len(code), CHUNK):
        c = code[at : at + CHUNK + max(ORDERS) - 1]
        h = c * np.uint64(0x9E3779B97F4A7C15)
        for n in range(2, max(ORDERS) + 1):
            if len(c) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[n - 1 :]
            if n in ORDERS:
                b = ((h * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS)).astype(np.int64)
                found.append(b if keep is None else b[keep[b]])
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """The kept buckets, their weights (ratio times coefficient) and the intercept."""
    spark = docs.sparkSession
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = kept(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", F.col("y").cast("int").alias("y"), "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[int(y > 0)][buckets(text)] += 1
        at = np.flatnonzero(n.any(axis=0))
        for k in range(0, len(at), 1 << 16):
            b = at[k : k + (1 << 16)]
            yield pa.record_batch([pa.array(b), pa.array(n[0][b].astype(np.int64)), pa.array(n[1][b].astype(np.int64))], names=["b", "n0", "n1"])

    size = {bool(r.t): r.n for r in texts.groupBy((F.col("y") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = size.get(False, 0), size.get(True, 0)
    base = np.log((n1 + 0.5) / (n0 + 0.5))
    if not n0 or not n1:
        return np.zeros(0, np.int64), np.zeros(0), float(base)
    ratio = F.log((F.col("n1") + 1) / (n1 + 2)) - F.log((F.col("n0") + 1) / (n0 + 2))
    gain = F.abs(ratio) * F.abs(F.col("n1") / n1 - F.col("n0") / n0)
    counts = texts.select("y", "text").mapInArrow(count, "b long, n0 long, n1 long").groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # There are 2 ** BITS buckets at most, so a few tasks hold them all, and each hands on its best.
    best = counts.coalesce(12).where(F.col("n0") + F.col("n1") >= LEAST).select("b", ratio.alias("r"), gain.alias("g")).orderBy(F.desc("g"), "b").limit(FEATURES).toArrow()
    order = np.argsort(best.column("b").to_numpy())
    kept_buckets, r = best.column("b").to_numpy()[order], best.column("r").to_numpy()[order]
    shared = spark.sparkContext.broadcast(kept_buckets)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(1 << BITS, bool)
        keep[shared.value] = True
        for b in batches:
            x = [np.searchsorted(shared.value, buckets(t, keep)).astype(np.int32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(x, pa.binary())], names=["y", "x"])

    got = texts.select("y", "text").mapInArrow(features, "y int, x binary").toArrow()
    y = (got.column("y").to_numpy() > 0).astype(np.float64)
    x = [np.frombuffer(v, np.int32) for v in got.column("x").to_pylist()]
    return kept_buckets, *_regression(x, y, r, base)


def _regression(x: list[np.ndarray], y: np.ndarray, r: np.ndarray, base: float, steps: int = 400, l2: float = 2e-2, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch Adam over rows of feature numbers, scaled by ``r`` and the row's length."""
    row, col = np.repeat(np.arange(len(x)), list(map(len, x))), np.concatenate(x) if x else np.zeros(0, np.int32)
    value = r[col]
    w, c = np.zeros(len(r) + 1), np.zeros(len(r) + 1)
    w[-1], m = base, np.zeros(len(r) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, value * w[col], len(x)) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(x)
        g = np.append(np.bincount(col, value * e[row], len(r)) + l2 * w[:-1] / len(r) ** 0.5, e.sum())
        m, c = 0.9 * m + 0.1 * g, 0.999 * c + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.999**t)) + 1e-9)
    return w[:-1] * r, float(w[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score double)`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which, weight, base = shared.value
        keep = np.zeros(1 << BITS, bool)
        keep[which] = True
        for b in batches:
            z = np.array([base + weight[np.searchsorted(which, buckets(t, keep))].sum() for t in b.column(1).to_pylist()])
            yield pa.record_batch([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

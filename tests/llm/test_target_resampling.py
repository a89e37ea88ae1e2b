"""Resampling towards a target against plain loops, over several orders, and on odd input."""

import hashlib
import math
import re
import zlib
from collections import Counter
from string import ascii_lowercase, ascii_uppercase

import pytest
from pyspark.sql import functions as F

from ferrule.llm import target_resampling
from ferrule.llm.common import table

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets(text, orders, n):
    own = words(text)
    return [zlib.crc32(" ".join(own[i : i + k]).encode()) % n for k in range(1, orders + 1) for i in range(len(own) - k + 1)]


def brute(docs, target, orders, n, percent=10, least=20):
    """Rows (id, n_features, weight, score, rank) by plain loops; docs are (id, text)."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text, orders, n))
    for _, text in target:
        t.update(buckets(text, orders, n))
    big_s, big_t, out = s.total(), t.total(), []
    for id_, text in docs:
        found = buckets(text, orders, n)
        gain = [math.floor(1000 * math.log((t[b] + 1) * float(big_s + n) / ((s[b] + 1) * float(big_t + n)))) for b in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([id_, len(found), weight, score, None, len(words(text)) >= least, hashlib.md5((text or "").encode()).hexdigest()])
    drawn = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[6]))
    for rank, r in enumerate(drawn[: percent * len(drawn) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def got(df, id_col="doc_id"):
    return sorted((tuple(r) for r in df.select(id_col, "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize(("orders", "n"), [(1, 10_000), (2, 10_000), (3, 97)])
def test_against_loops(spark, orders, n):
    docs, target = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "benchmark")
    plain = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in target.collect()]
    assert got(target_resampling.resample(docs, target, orders, n)) == brute(*plain, orders, n)


def test_one_order_needs_no_window_and_shuffles_no_word(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    plan = target_resampling.features(docs, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan
    more = target_resampling.features(docs, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in more and more.count("Exchange hashpartitioning") == 1  # texts by document, once


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    plain = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()], [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert got(target_resampling.op12_target_resampling(spark, sf)) == brute(*plain, 1, 10_000)


@pytest.mark.parametrize("orders", [1, 2])
def test_odd_input(spark, orders):
    """Nulls, empty and very long texts, repeated ids and rows, ties, clashing columns, empty tables."""
    some = "The quick brown fox jumps over the lazy dog again and again " * 3
    data = [(1, None), (2, ""), (3, "...!"), (4, some), (4, some), (4, some + "x"), (None, some), (None, some), (5, "Größe 🙂 ÄÖ 7 " * 40_000), (6, "one"), *((n, some) for n in range(7, 40))]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "digest", "copies", "pos", "word", "bucket", "gain", "score", "total", "copy", "order")})
    target = spark.createDataFrame([(1, "the dog"), (1, "the dog"), (None, None), (2, "")], "item_id long, text string").withColumn("id", F.lit("clash"))
    items = [(1, "the dog"), (1, "the dog"), (None, None), (2, "")]
    assert got(target_resampling.resample(docs, target, orders)) == brute(data, items, orders, 10_000)
    assert got(target_resampling.resample(docs, target.limit(0), orders)) == brute(data, [], orders, 10_000)
    assert target_resampling.resample(docs.limit(0), target, orders).count() == 0


def test_bound_of_buckets(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="buckets"):
        target_resampling.resample(docs, docs.withColumnRenamed("doc_id", "item_id"), buckets=10_000_000)

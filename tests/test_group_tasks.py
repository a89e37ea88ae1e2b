"""Statistics by group whose tasks keep their size when the table grows."""

from pyspark.sql import functions as F

from ferrule.operators import ordered
from ferrule.operators import statistics as S


def test_small_groups_are_sorted_by_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    monkeypatch.setattr(ordered, "GROUP_ROWS", 100)
    df = spark.range(1200).select((F.col("id") % 40).alias("g"), F.pmod(F.col("id") * 7919, F.lit(1201)).cast("double").alias("x"))
    got = ordered.ranks(df, ["g"], "x", [], "r")
    assert got.rdd.getNumPartitions() >= 12  # a shuffle of this session has 4
    want = df.toPandas()
    want["r"] = want.groupby("g").x.rank(method="first").astype(int)
    assert sorted(map(tuple, got.collect())) == sorted(want.itertuples(index=False, name=None))


def test_a_fit_meets_rows_after_they_are_ranked(spark):
    df = spark.createDataFrame([(g, float(1 + (i * 37) % 101)) for g, n in (("a", 60), ("b", 5), ("none", 9)) for i in range(n)], "g string, x double")
    fits = df.where("g <> 'none'").groupBy("g").agg(F.avg("x").alias("mu"), F.stddev_samp("x").alias("sigma"))
    z = (F.col("x") - F.col("mu")) / F.col("sigma")
    got = S.ks(df, ["g"], "x", S.normal_cdf(z), fits)
    before = S.ks(df.join(fits, "g").withColumn("z", z), ["g"], "z", S.normal_cdf("z"))
    rows = lambda q: [(r.g, r.n, round(r.d, 12), round(r.p, 12)) for r in q.orderBy("g").collect()]
    assert rows(got) == rows(before) and [r[:2] for r in rows(got)] == [("a", 60), ("b", 5)]


def test_a_histogram_of_few_groups_brings_no_group_to_one_task(spark, monkeypatch):
    df = spark.createDataFrame([(g, float((i * 37) % 101)) for g, n in (("a", 60), ("b", 12)) for i in range(n)], "g string, x double")
    few = S.histogram(df, ["g"], "x", [F.lit(-5.0)])
    assert "strategy=broadcast" in few._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(ordered, "FEW_GROUPS", 1)
    many = S.histogram(df, ["g"], "x", [F.lit(-5.0)])
    assert "strategy=broadcast" not in many._jdf.queryExecution().analyzed().toString()
    rows = few.orderBy("g", "bin").collect()
    assert rows == many.orderBy("g", "bin").collect() and sum(r.n for r in rows) == 72

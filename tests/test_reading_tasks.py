"""Work that is dear for each row of a small file is dealt to all tasks, and done once."""

from zlib import crc32

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrule.operators import readings
from ferrule.plans import readings as plan

SF = "/root/testdata/sf0.01"


def test_lines_and_resolved_rows_are_made_by_more_tasks_than_the_file_has_splits(spark):
    assert spark.read.parquet(f"{SF}/part.parquet").rdd.getNumPartitions() == 1
    lines = plan.lines(spark, SF)
    assert lines.rdd.getNumPartitions() >= 8
    rows = readings.resolve(readings.paired(readings.parse(lines), "layer", "scan"), {})
    assert rows.rdd.getNumPartitions() >= 8


def test_a_line_is_read_once(spark):
    df = spark.createDataFrame([("6", 1, "a", "100 x 50 x 15 x 2.00 4.30")], "table string, page long, source string, line string")
    read = readings.parse(df)._jdf.queryExecution().optimizedPlan().toString()
    assert read.count("regexp_extract") == 5


def test_pairs_read_their_lines_once(spark):
    pairs = readings.paired(readings.parse(plan.lines(spark, SF)), "layer", "scan")
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # the match


def test_rows_are_resolved_once_to_be_settled(spark):
    pairs = spark.createDataFrame([("6", 1, 1, 100.0, 50.0, 15.0, 2.0, ["4.30"], None)], "table string, page long, row long, h double, b double, c double, t double, first array<string>, second array<string>")
    assert "MapInArrow" not in readings.settled(readings.resolve(pairs, {}))._jdf.queryExecution().optimizedPlan().toString()


def test_two_readings_of_one_row_settle_alike_in_any_order(spark):
    rows = [("6", 1, 7, "A", [1.0] * 17, [s], [], [r]) for s, r in (("scan", "t"), ("layer", ""), ("layer", "z"))]
    for own in (rows, rows[::-1]):
        df = spark.createDataFrame(own, "table string, page long, row long, designation string, values array<double>, sources array<string>, notes array<string>, repairs array<string>").coalesce(1)
        assert [(r.sources, r.repairs) for r in readings.settled(df).collect()] == [(["layer"], [""])]


def test_calibration_counts_equal_ratios(spark):
    """Medians over counted ratios are the medians over each: four cells that agree, three of them alike."""
    cells = lambda a: ["100", "15", "2.00", "3.00", a, "4.00"]
    df = spark.createDataFrame([("5", 100.0, 100.0, 15.0, 2.0, x, x) for x in map(cells, ("3.00", "3.00", "3.00", "4.00"))], "table string, h double, b double, c double, t double, first array<string>, second array<string>")
    wide = lambda c: [*c, *["1.00"] * 10]
    df = df.rdd.map(lambda r: (*r[:5], wide(r[5]), wide(r[6]))).toDF(df.schema)
    fits = readings.calibrate(df)["5"]
    one = readings.calibrate(df.where("first[4] = '3.00'"))["5"]
    assert fits["M"] == pytest.approx(one["M"]) and fits["M"][1] > 0


def test_calibration_writes_equal_ratios_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(readings, "stored", lambda df, kind: seen.append(df) or df)
    row = ("5", 100.0, 100.0, 15.0, 2.0, *[["100", "15", "2.00", "3.00", *["1.00"] * 12]] * 2)
    readings.calibrate(spark.createDataFrame([row] * 50, "table string, h double, b double, c double, t double, first array<string>, second array<string>"))
    assert {r.n for r in seen[0].collect()} == {50}


def test_the_query_prints_and_reads_its_lines_once(spark):
    plan_of = plan.two_source_rows(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan_of.count("MapInArrow") == 1 and "regexp_extract" not in plan_of


def test_fates_are_checksums_of_row_and_cell():
    rows = [0, 7, 123456, 7200000]
    want = [[crc32(f"scan:{r}:{j}".encode()) % 240 for j in range(19)] for r in rows]
    assert plan.fates(rows, "scan", 19).tolist() == want


def test_cells_of_equal_profiles_are_made_once_a_task(spark, monkeypatch):
    """As many rows as a batch holds have two profiles, so two are computed; what is kept is bounded and does not change a line."""
    made, of = [], plan.true_cells
    monkeypatch.setattr(plan, "true_cells", lambda kind, dims: made.append(len(dims["h"])) or of(kind, dims))
    df = spark.range(200).select(F.col("id").alias("row"), F.lit("6").alias("table"), F.lit(1).alias("page"), *[F.lit(x).alias(k) for k, x in (("h", 100.0), ("b", 50.0), ("c", 15.0))], F.when(F.col("id") % 2 == 0, 2.0).otherwise(2.5).alias("t"))
    batch = pa.RecordBatch.from_pandas(df.toPandas(), preserve_index=False)

    def lines():
        frame = type("Frame", (), {"mapInArrow": lambda self, run, schema: [x for b in run(iter([batch, batch])) for x in b.to_pylist()]})()
        monkeypatch.setattr(plan, "dealt", lambda *a: frame)
        return plan.printed(df)

    kept = lines()
    assert made == [2]
    monkeypatch.setattr(plan, "KNOWN", 0)
    assert lines() == kept and len(kept) == 800


def test_ratios_are_counted_in_a_batch(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(readings, "stored", lambda df, kind: seen.append(df) or df)
    row = ("5", 100.0, 100.0, 15.0, 2.0, *[["100", "15", "2.00", "3.00", *["1.00"] * 12]] * 2)
    readings.calibrate(spark.createDataFrame([row] * 50, "table string, h double, b double, c double, t double, first array<string>, second array<string>"))
    plan_of = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(n" in plan_of and "count(1)" not in plan_of

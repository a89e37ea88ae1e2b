"""What headings are read from is made once, however often it is read."""

from ferrule.functions import text as X
from ferrule.operators import headings as H
from ferrule.operators import synthesis as S


def test_lines_are_cut_and_read_once(spark):
    pages = spark.createDataFrame([("a", 1, "1 SCOPE\n1.1 First clause\n1.2 Second clause"), ("a", 2, "2 TERMS\n2.1 General")], "doc string, page long, text string")
    got = H.headings(pages)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "linearised" not in plan and "Generate" not in plan
    assert [r.sid for r in got.orderBy("page", "line").collect()] == ["1", "1.1", "1.2", "2", "2.1"]


def test_a_gutter_is_found_without_going_through_all_cells():
    class Line(str):
        def ljust(self, *_):
            raise AssertionError("a line is filled up to the widest")

    assert X.gutter_of([Line("left one      right one"), Line("left two"), Line(""), Line("l             \U0001f600\udc80ght")]) == 11
    assert X.gutter_of([Line("   "), Line("")]) is None and X.gutter_of([]) is None


def test_merged_headings_read_every_source_once(spark):
    rows = [("d", "layout", 1, "1", "a", 1), ("d", "old", 2, "1.2", "b", 1), ("d", "old", 3, "1.2.1", "c", 1), ("d", "old", 4, "3", "e", 1)]
    heads = spark.createDataFrame(rows, "doc string, origin string, pos long, sid string, title string, page long")
    got = S.merged(heads, spark.createDataFrame([("d", 2)], "doc string, page long"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "LogicalRDD" not in plan and "LocalRelation" not in plan
    assert sorted((r.sid, r.source) for r in got.collect()) == [("1", "layout"), ("1.2", "old"), ("1.2.1", "old")]

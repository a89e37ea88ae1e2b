"""Overlaps of intervals and boxes against all pairs, running sums and integrals against loops, over ranges of any cut."""

import random

import pytest

from ferrule.operators import intervals, ordered


def spans(draw, n, group):
    """Short ones, long ones, ones without length, ends that touch, negative places, nulls and bounds the wrong way round."""
    rows = []
    for k in range(n):
        lo = draw.choice([draw.randrange(-50, 200), draw.uniform(-50, 200)])
        hi = lo + draw.choice([0, 0, 1, 2, draw.uniform(0, 3), draw.uniform(0, 0.01), 300, draw.uniform(50, 3000)])
        rows.append((draw.choice(group), k, *draw.choice([(lo, hi)] * 15 + [(hi, lo), (None, hi), (lo, None)])))
    return [(g, k, None if a is None else float(a), None if b is None else float(b)) for g, k, a, b in rows]


@pytest.mark.parametrize("touching", [True, False])
def test_intervals_against_all_pairs(spark, touching):
    draw = random.Random(23)
    left, right = spans(draw, 250, ["p", "p", "p", "q", None]), spans(draw, 250, ["p", "p", "q", "r", None])
    want = set()
    for g, i, a, b in left:
        for h, j, c, d in right:
            if g is None or g != h or None in (a, b, c, d) or a > b or c > d:
                continue
            lo, hi = max(a, c), min(b, d)
            inner = hi > lo or (hi == lo and (a == b or c == d) and min(a, c) < lo and hi < max(b, d))
            if (hi >= lo) if touching else inner:
                want.add((i, j, round(hi - lo, 9)))
    shape = "g string, k long, lo double, hi double"
    got = intervals.overlaps(spark.createDataFrame(left, shape), spark.createDataFrame(right, shape), ["g"], [("lo", "hi")], touching).collect()
    assert {(r.left.k, r.right.k, round(r.overlap, 9)) for r in got} == want and len(got) == len(want) > 500


def test_boxes_against_all_pairs(spark):
    draw = random.Random(24)
    side = lambda: draw.choice([1, 1, 2, 5, 80, 0])
    boxes = [(k % 2, k, x := draw.randrange(100), x + side(), y := draw.randrange(100), y + side()) for k in range(300)]
    want = set()
    for g, i, a, b, c, d in boxes:
        for h, j, e, f, p, q in boxes:
            if g == h and a <= f and e <= b and c <= q and p <= d:
                want.add((i, j, (min(b, f) - max(a, e)) * (min(d, q) - max(c, p))))
    df = spark.createDataFrame(boxes, "page long, k long, x0 long, x1 long, y0 long, y1 long")
    got = intervals.overlaps(df, df, ["page"], [("x0", "x1"), ("y0", "y1")]).collect()
    assert {(r.left.k, r.right.k, r.overlap) for r in got} == want and len(got) == len(want)


def test_a_long_interval_among_short_ones_costs_each_a_row(spark):
    """Candidates do not grow with the square of the short ones, wherever the long one lies."""
    short = spark.range(4000).selectExpr("0 AS g", "id AS k", "id * 1.0D AS lo", "id + 0.5D AS hi")
    long = spark.createDataFrame([(0, -1, 0.0, 4000.0)], "g int, k long, lo double, hi double")
    got = intervals.overlaps(short.unionByName(long), short.unionByName(long), ["g"], [("lo", "hi")])
    assert got.count() == 4000 + 4000 * 2 + 1
    metrics = {}

    def walk(p):
        if p.nodeName().endswith("Join"):
            metrics["rows"] = max(metrics.get("rows", 0), p.metrics().apply("numOutputRows").value())
        kids = p.children()
        for i in range(kids.size()):
            walk(kids.apply(i))
        if p.nodeName() in ("AdaptiveSparkPlan",):
            walk(p.executedPlan())
        if "QueryStage" in p.nodeName():
            walk(p.plan())

    rows = got.select("overlap")
    rows.collect()
    walk(rows._jdf.queryExecution().executedPlan())
    assert metrics["rows"] < 60_000


def test_no_rows_overlap_nothing(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 1.0)], "g long, k long, lo double, hi double")
    assert intervals.overlaps(df.limit(0), df, ["g"], [("lo", "hi")]).count() == intervals.overlaps(df, df.limit(0), ["g"], [("lo", "hi")]).count() == 0


def test_integrals_against_loops(spark):
    draw = random.Random(25)
    pieces = [(draw.choice(["a", "a", "b", None]), lo := draw.uniform(-5, 20), lo + draw.choice([0, 1, 3, 30]), draw.choice([draw.uniform(-1, 1)] * 8 + [None])) for _ in range(120)]
    levels = [(draw.choice(["a", "b", "c", None]), draw.choice([draw.uniform(-8, 60), pieces[draw.randrange(120)][1]]), k) for k in range(150)]
    want = {k: sum(s * (min(z, hi) - lo) for h, lo, hi, s in pieces if h == g and s is not None and z > lo) for g, z, k in levels}
    got = intervals.integral_up_to(spark.createDataFrame(levels, "g string, z double, k long"), spark.createDataFrame(pieces, "g string, lo double, hi double, slope double"), ["g"], "z", "lo", "hi", "slope").collect()
    assert len(got) == 150 and {r.k: r.integral for r in got} == pytest.approx(want, abs=1e-9)


def test_running_sums_over_ranges(spark):
    """One group holds nearly all rows, so ranges cut it; groups without a value, nulls and a group that is null."""
    draw = random.Random(26)
    rows = [(draw.choice(["hot"] * 20 + ["b", None]), n, draw.choice([1, 2, 3, None])) for n in range(900)]
    want, total = {}, {}
    for g, n, v in rows:
        want[n] = total.get(g, 0)
        total[g] = total.get(g, 0) + (v or 0)
    got = ordered.running_sums(spark.createDataFrame(rows, "g string, n long, v long").repartition(7), ["g"], ["n"], ["v"]).collect()
    assert {r.n: r.v_before for r in got} == want and len(got) == 900


def test_same_line(spark):
    boxes = [(1, k, float(low), float(high)) for k, (low, high) in enumerate([(100, 110), (112, 118), (113, 114), (128, 140), (0, 300), (90, 92)])]
    want = {(i, j) for _, i, a, b in boxes for _, j, c, d in boxes if i != j and (abs((a + b) / 2 - (c + d) / 2) < 14 or (d >= a - 2 and c <= b + 2))}
    df = spark.createDataFrame(boxes, "page long, key long, low double, high double")
    got = intervals.same_line(df, df, ["page"]).collect()
    assert {(r.key, r.other) for r in got} == want and len(got) == len(want)


def test_rows_of_small_groups_are_not_copied_into_bins(spark):
    """A row of a group of a few is shuffled once for each side; of one group above the limit, by bins; both ways give the same."""
    draw = random.Random(5)
    rows = [(k % 40, k, float(lo := draw.randrange(60)), float(lo + draw.randrange(1, 30))) for k in range(800)]
    df = spark.createDataFrame(rows, "g long, k long, lo double, hi double")
    met = intervals.overlaps(df, df, ["g"], [("lo", "hi")])
    assert "Generate" not in met._jdf.queryExecution().optimizedPlan().toString()
    pairs = lambda m: sorted((r.g, r.left.k, r.right.k, r.overlap) for r in m.collect())
    assert pairs(met) == pairs(intervals._binned(df, df, ["g"], [("lo", "hi")], True))

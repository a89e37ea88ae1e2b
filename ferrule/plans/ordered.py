"""Queries over rows in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.operators import intervals as I
from ferrule.operators import ordered as O
from ferrule.plans import query, table


@query("""SELECT o_custkey, o_orderkey, before, after FROM (SELECT o_custkey, o_orderkey,
  array_to_string(coalesce(list(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []), ',') AS before,
  array_to_string(coalesce(list(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []), ',') AS after
  FROM orders)""")
def neighbors_pm_n(spark: SparkSession, d: str) -> DataFrame:
    """Two rows before and after within a document."""
    rows = O.neighbours(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", 2)
    return rows.select("o_custkey", "o_orderkey", F.array_join(F.col("before").cast("array<string>"), ",").alias("before"), F.array_join(F.col("after").cast("array<string>"), ",").alias("after"))


@query("""SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey
  ORDER BY (l_returnflag = 'R') DESC, l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS r FROM lineitem) WHERE r = 1""")
def best_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """The best row of each id by a lexicographic order."""
    order = [(F.col("l_returnflag") == "R").desc(), F.desc("l_quantity"), F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    return O.best_occurrence(table(spark, d, "lineitem"), ["l_partkey"], order).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")


ASOF = """p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'),
s AS (SELECT user_id, ts, event_id AS signup_id, value AS signup_value FROM events WHERE event_type = 'signup')"""


@query(f"""WITH {ASOF} SELECT p.event_id, s.signup_id, s.signup_value FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts""")
def asof_section(spark: SparkSession, d: str) -> DataFrame:
    """What was in force at a row: the latest earlier row of another kind."""
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"), F.col("value").alias("signup_value"))
    return O.asof_backward(left, right, ["user_id"], "ts", ["signup_id", "signup_value"], ["signup_id"]).select("event_id", "signup_id", "signup_value")


@query(f"""WITH {ASOF}, j AS (SELECT p.event_id, p.ts, s.signup_id, s.ts AS sts FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts)
SELECT event_id, CASE WHEN date_diff('microsecond', sts, ts) <= 43200000000 THEN signup_id END AS signup_id FROM j""")
def asof_gap_limited(spark: SparkSession, d: str) -> DataFrame:
    """An as-of join that holds for a limited gap only."""
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup_id"), F.col("ts").alias("since"))
    rows = O.asof_backward(left, right, ["user_id"], "ts", ["signup_id", "since"], ["signup_id"])
    near = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp")) <= 43_200_000_000
    return rows.select("event_id", F.when(near, F.col("signup_id")).alias("signup_id"))


@query("""WITH e AS (SELECT *, CASE WHEN event_type = 'view' THEN value END AS v FROM events),
g AS (SELECT *, count(v) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM e)
SELECT event_id, max(v) OVER (PARTITION BY user_id, grp) AS last_view, row_number() OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) - 1 AS since FROM g""")
def forward_fill_gap(spark: SparkSession, d: str) -> DataFrame:
    """The last known value, and how many rows ago it was."""
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") == "view", F.col("value")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = O.forward_fill(e, ["user_id"], ["ts", "event_id"], "v", "last_view").withColumn("grp", F.count("v").over(w))
    since = F.row_number().over(Window.partitionBy("user_id", "grp").orderBy("ts", "event_id")) - 1
    return rows.select("event_id", "last_view", since.cast("long").alias("since"))


@query("""WITH m AS (SELECT *, min(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END) OVER (PARTITION BY o_custkey) AS first FROM orders)
SELECT o_orderkey FROM m WHERE first IS NULL OR o_orderdate >= first""")
def preview_drop(spark: SparkSession, d: str) -> DataFrame:
    """Rows before the first real one of their root are previews and go."""
    first = F.min(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate"))).over(Window.partitionBy("o_custkey"))
    return table(spark, d, "orders").withColumn("first", first).where("first IS NULL OR o_orderdate >= first").select("o_orderkey")


@query("""WITH b AS (SELECT *, min(CASE WHEN n_chars <= 200 AND doc_id >= 20 THEN doc_id END) OVER (PARTITION BY source) AS cut FROM documents)
SELECT doc_id, CASE WHEN doc_id >= cut THEN 'commentary' ELSE 'specification' END AS part FROM b""")
def boundary_part(spark: SparkSession, d: str) -> DataFrame:
    """All pages from the first that matches, beyond a least page, are of the second part."""
    cut = F.min(F.when((F.col("n_chars") <= 200) & (F.col("doc_id") >= 20), F.col("doc_id"))).over(Window.partitionBy("source"))
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") >= cut, "commentary").otherwise("specification").alias("part"))


@query("""WITH r AS (SELECT o_orderstatus, o_orderpriority, o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_custkey) AS pos,
  count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n FROM r)
SELECT o_orderstatus, o_orderpriority, pos, o_custkey, last_order, greatest(n - 400, 0) AS more FROM k WHERE pos <= 400""")
def toc_unique_last_400(spark: SparkSession, d: str) -> DataFrame:
    """Unique entries, the last of each, the first 400 of a part, and how many more there are."""
    rows = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority", "o_custkey").agg(F.max("o_orderkey").alias("last_order"))
    w = Window.partitionBy("o_orderstatus", "o_orderpriority")
    k = rows.withColumns({"pos": F.row_number().over(w.orderBy("o_custkey")).cast("long"), "more": F.greatest(F.count("*").over(w) - 400, F.lit(0))}).where("pos <= 400")
    return k.select("o_orderstatus", "o_orderpriority", "pos", "o_custkey", "last_order", "more")


@query("""SELECT r_regionkey, r_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS children, count(n_nationkey) AS n FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY ALL""")
def children_lists(spark: SparkSession, d: str) -> DataFrame:
    """The ordered children of each parent."""
    kids = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("k"))
    rows = table(spark, d, "region").join(kids, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    names = F.when(F.col("k").isNotNull(), F.array_join(F.transform("k", lambda x: x["n_name"]), ","))
    return rows.select("r_regionkey", "r_name", names.alias("children"), F.coalesce(F.array_size("k"), F.lit(0)).cast("long").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey || '-eq' || row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS synthetic_id FROM lineitem""")
def synthetic_ids(spark: SparkSession, d: str) -> DataFrame:
    """Running numbers per section make ids."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.col("l_orderkey").cast("string"), F.lit("-eq"), n.cast("string")).alias("synthetic_id"))


@query("""WITH x AS (SELECT DISTINCT l_partkey, l_orderkey, l_extendedprice FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_partkey, l_orderkey) = 1),
p AS (SELECT a.l_partkey, a.l_orderkey AS key, b.l_orderkey AS other, row_number() OVER (PARTITION BY a.l_partkey, a.l_orderkey
  ORDER BY abs(a.l_extendedprice - b.l_extendedprice), b.l_orderkey) AS rank FROM x a JOIN x b
  ON a.l_partkey = b.l_partkey AND a.l_orderkey <> b.l_orderkey AND abs(a.l_extendedprice - b.l_extendedprice) < 2000)
SELECT l_partkey, key, other, rank FROM p WHERE rank <= 6""")
def nearest_in_band(spark: SparkSession, d: str) -> DataFrame:
    """The six nearest values of the same page within a band."""
    x = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_extendedprice").distinct()
    x = x.withColumn("n", F.count("*").over(Window.partitionBy("l_partkey", "l_orderkey"))).where("n = 1").drop("n")
    return O.nearest_in_band(x, ["l_partkey"], "l_extendedprice", "l_orderkey", 2000.0, 6)


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
b AS (SELECT o_custkey, (k - 1) * 3.0 AS lo, k * 3.0 AS hi, o_totalprice / 1e6 AS slope FROM s)
SELECT o_custkey, z, round(sum((least(z, hi) - lo) * slope), 9) AS lean FROM b JOIN (VALUES (4.0), (10.0), (25.0)) v(z) ON z > lo GROUP BY ALL""")
def range_overlap_sum(spark: SparkSession, d: str) -> DataFrame:
    """A piecewise integral up to a level: a range join and a weighted sum."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    b = table(spark, d, "orders").select("o_custkey", ((k - 1) * 3.0).alias("lo"), (k * 3.0).alias("hi"), (F.col("o_totalprice") / 1e6).alias("slope"))
    # The levels are three literals, so the range join is an explode.
    rows = b.select("*", F.explode(F.array(*map(F.lit, (4.0, 10.0, 25.0)))).alias("z")).where("z > lo")
    return rows.groupBy("o_custkey", F.col("z").cast("decimal(3,1)").alias("z")).agg(F.round(F.sum((F.least("z", "hi") - F.col("lo")) * F.col("slope")), 9).alias("lean"))


@query()
def greedy_match_one_to_one(spark: SparkSession, d: str) -> DataFrame:
    """Captions take unused grids of their page in order (J12, J16); tests hold it against a plain loop."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity").distinct()
    a = rows.where("l_quantity <= 25").select("l_orderkey", F.col("l_partkey").alias("caption"), F.col("l_quantity").alias("qa"))
    b = rows.where("l_quantity > 25").select("l_orderkey", F.col("l_partkey").alias("grid"), F.col("l_quantity").alias("qb"))
    pairs = a.join(b, "l_orderkey").withColumn("gap", F.col("qb") - F.col("qa"))
    return O.greedy_match(pairs, ["l_orderkey"], "caption", "grid", ["gap", "caption", "grid"])


@query()
def monotone_heading_fold(spark: SparkSession, d: str) -> DataFrame:
    """Headings whose number moves on plausibly from the last kept one (W9); tests hold it against a plain loop."""
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") / 400 + F.pmod(F.xxhash64("event_id"), F.lit(4))).cast("long").alias("number"))
    return O.monotone(rows, ["user_id"], "event_id", "number")


@query("""WITH e AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT user_id, event_id, event_type FROM e WHERE prev IS NULL OR prev <> event_type""")
def dedupe_consecutive(spark: SparkSession, d: str) -> DataFrame:
    """Repeats of the step before are dropped."""
    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("prev", prev).where("prev IS NULL OR prev <> event_type").select("user_id", "event_id", "event_type")


@query(r"""WITH p AS (SELECT page_id, unnest(string_split(html, '<p>')) AS body, generate_subscripts(string_split(html, '<p>'), 1) AS page FROM pages),
o AS (SELECT doc_id % 250 AS page_id, 2 AS page, max(text) AS body FROM documents GROUP BY 1)
SELECT coalesce(p.page_id, o.page_id) AS page_id, coalesce(p.page, o.page) AS page, CAST(length(CASE WHEN coalesce(length(o.body), -1) > coalesce(length(p.body), -1) THEN o.body ELSE p.body END) AS BIGINT) AS n_chars,
  sha256(CASE WHEN coalesce(length(o.body), -1) > coalesce(length(p.body), -1) THEN o.body ELSE p.body END) AS digest
FROM p FULL JOIN o ON p.page_id = o.page_id AND p.page = o.page""")
def page_split_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a text at markers, overlaid by page files where those are longer or the page is missing."""
    p = table(spark, d, "pages").select("page_id", F.posexplode(F.split("html", "<p>")).alias("k", "body")).select("page_id", (F.col("k") + 1).alias("page"), "body")
    o = table(spark, d, "documents").groupBy((F.col("doc_id") % 250).alias("page_id")).agg(F.max("text").alias("other")).withColumn("page", F.lit(2))
    body = F.when(F.coalesce(F.length("other"), F.lit(-1)) > F.coalesce(F.length("body"), F.lit(-1)), F.col("other")).otherwise(F.col("body"))
    return p.join(o, ["page_id", "page"], "full").select("page_id", F.col("page").cast("long").alias("page"), F.length(body).cast("long").alias("n_chars"), F.sha2(body, 256).alias("digest"))


@query("""WITH s AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
b AS (SELECT o_custkey, (k - 1) * 3.0 AS lo, k * 3.0 AS hi, o_totalprice / 1e6 AS slope FROM s), z AS (SELECT o_custkey, o_orderkey, (o_orderkey * 7 % 50 + 0.5)::DOUBLE AS z FROM orders)
SELECT z.o_custkey, o_orderkey, z, round(coalesce(sum((least(z, hi) - lo) * slope) FILTER (z > lo), 0), 9) AS lean FROM z JOIN b ON z.o_custkey = b.o_custkey GROUP BY ALL""")
def lean_at_levels(spark: SparkSession, d: str) -> DataFrame:
    """The integral of a customer's pieces up to each of many levels, by running sums."""
    orders = table(spark, d, "orders")
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    pieces = orders.select("o_custkey", ((k - 1) * 3.0).alias("lo"), (k * 3.0).alias("hi"), (F.col("o_totalprice") / 1e6).alias("slope"))
    levels = orders.select("o_custkey", "o_orderkey", (F.pmod(F.col("o_orderkey") * 7, F.lit(50)) + 0.5).cast("double").alias("z"))
    return I.integral_up_to(levels, pieces, ["o_custkey"], "z", "lo", "hi", "slope", "lean").withColumn("lean", F.round("lean", 9))


SPANS_SQL = """WITH t AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_shipdate::DATE - DATE '1990-01-01' AS lo, l_shipdate::DATE - DATE '1990-01-01' + CASE WHEN l_orderkey % 50 = 0 THEN 400 ELSE l_quantity::INT % 7 END AS hi FROM lineitem),
a AS (SELECT * FROM t WHERE l_orderkey % 2 = 0), b AS (SELECT * FROM t WHERE l_orderkey % 2 = 1)"""


@query(f"""{SPANS_SQL} SELECT a.l_suppkey, a.l_orderkey, a.l_linenumber, count(*) AS n, CAST(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS BIGINT) AS days
FROM a JOIN b ON a.l_suppkey = b.l_suppkey AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY ALL""")
def overlapping_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of days of a supplier that overlap others, long ones among short ones, with the days in common."""
    lo = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    hi = lo + F.when(F.col("l_orderkey") % 50 == 0, 400).otherwise(F.col("l_quantity").cast("int") % 7)
    t = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", lo.alias("lo"), hi.alias("hi"))
    met = I.overlaps(t.where("l_orderkey % 2 = 0"), t.where("l_orderkey % 2 = 1"), ["l_suppkey"], [("lo", "hi")])
    return met.groupBy("l_suppkey", F.col("left.l_orderkey").alias("l_orderkey"), F.col("left.l_linenumber").alias("l_linenumber")).agg(F.count("*").alias("n"), F.sum("overlap").cast("long").alias("days"))


BOX_SQL = """WITH t AS (SELECT l_partkey AS page, l_orderkey * 10 + l_linenumber AS key, (l_extendedprice * 100)::BIGINT % 700 AS low, (l_extendedprice * 100)::BIGINT % 700 + 8 + l_quantity::BIGINT % 30 AS high,
  l_suppkey * 37 % 500 AS x0, l_suppkey * 37 % 500 + 20 + l_orderkey % 90 AS x1 FROM lineitem)"""


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    low, x0 = F.pmod(F.round(F.col("l_extendedprice") * 100).cast("long"), F.lit(700)), F.pmod(F.col("l_suppkey") * 37, F.lit(500))
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), low.alias("low"), (low + 8 + F.col("l_quantity").cast("long") % 30).alias("high"),
        x0.alias("x0"), (x0 + 20 + F.col("l_orderkey") % 90).alias("x1"),
    )


@query(f"""{BOX_SQL}, p AS (SELECT a.page, a.key, b.key AS other, abs((a.low + a.high) / 2.0 - (b.low + b.high) / 2.0) AS gap FROM t a JOIN t b ON a.page = b.page AND a.key <> b.key
  AND (abs((a.low + a.high) / 2.0 - (b.low + b.high) / 2.0) < 14 OR (b.high >= a.low - 2 AND b.low <= a.high + 2)))
SELECT page, key, other, CAST(gap AS DOUBLE) AS gap FROM p""")
def same_line_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a page on one line: middles near, or heights that overlap."""
    t = _boxes(spark, d)
    return I.same_line(t, t, ["page"])


@query(f"""{BOX_SQL} SELECT a.page, a.key, b.key AS other, CAST((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.high, b.high) - greatest(a.low, b.low)) AS DOUBLE) AS area FROM t a JOIN t b ON a.page = b.page AND a.key < b.key
  AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.low < b.high AND b.low < a.high""")
def overlapping_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a page that overlap in both dimensions, and the area in common."""
    t = _boxes(spark, d)
    met = I.overlaps(t, t, ["page"], [("x0", "x1"), ("low", "high")], touching=False)
    return met.where("left.key < right.key").select("page", F.col("left.key").alias("key"), F.col("right.key").alias("other"), F.col("overlap").alias("area"))

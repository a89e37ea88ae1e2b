"""Queries of scoring: parts are variations with metrics, orders carry flags for eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.operators import scoring as S
from ferrule.operators.ordered import ranks
from ferrule.plans import query, table


def variations(spark: SparkSession, d: str) -> DataFrame:
    """A part with its steel, its drift and its number of connections, from its line items."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("n_conn"), F.max("l_discount").alias("drift"))
    return table(spark, d, "part").join(x, "p_partkey", "left").select("p_partkey", "p_type", "p_size", F.round("p_retailprice", 2).alias("steel"), "n_conn", "drift")


VARIATIONS = """x AS (SELECT l_partkey, sum(l_quantity) AS n_conn, max(l_discount) AS drift FROM lineitem GROUP BY 1),
v AS (SELECT p_partkey, p_type, p_size, round(p_retailprice, 2) AS steel, n_conn, drift FROM part LEFT JOIN x ON l_partkey = p_partkey),
m AS (SELECT max(steel) FILTER (p_size >= 10) AS steel_max, max(n_conn) FILTER (p_size >= 10) AS n_conn_max FROM v)"""
#: A user's expression, as typed.
EXPRESSION = "S = 100 × (1 − steel / steel_max) + 10*max(0, drift*5 if n_conn > 700 else 1 - n_conn/n_conn_max) + (p_size >= 10 and p_size < 40)"


@query("WITH " + VARIATIONS + """, s AS (SELECT p_partkey, CASE WHEN steel IS NULL OR n_conn IS NULL OR drift IS NULL THEN NULL ELSE
  100 * (1 - steel / steel_max) + 10 * greatest(0, CASE WHEN n_conn > 700 THEN drift * 5 ELSE 1 - n_conn / n_conn_max END) + CASE WHEN p_size >= 10 AND p_size < 40 THEN 1 ELSE 0 END END AS score FROM v, m)
SELECT p_partkey, round(score, 6) AS score, CASE WHEN score IS NOT NULL THEN row_number() OVER (ORDER BY round(score, 6) DESC NULLS LAST, p_partkey) END AS rank FROM s""")
def score_expression(spark: SparkSession, d: str) -> DataFrame:
    """A typed expression over metrics and their extremes among eligible rows, scored and ranked."""
    v = S.with_extremes(variations(spark, d), ["steel", "n_conn"], F.col("p_size") >= 10)
    value, _ = S.compile_expression(EXPRESSION, {"steel", "steel_max", "drift", "n_conn", "n_conn_max", "p_size"})
    return S.ranked(v.withColumn("score", F.round(value, 6)), "score", "p_partkey").select("p_partkey", "score", "rank")


@query("WITH " + VARIATIONS + """, u AS (SELECT p_type, p_partkey, unnest(['steel', 'n_conn', 'drift']) AS metric, unnest([-steel, n_conn, drift]) AS k FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY p_type, metric ORDER BY k DESC, p_partkey) AS r FROM u WHERE k IS NOT NULL)
SELECT p_type, metric, r AS place, p_partkey FROM r""")
def metric_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Independent rankings of all ids that have the metric, up or down (W12): a row for each place, so that no list grows with a group."""
    v = variations(spark, d).select("p_type", "p_partkey", (-F.col("steel")).alias("steel"), "n_conn", "drift")
    u = v.unpivot(["p_type", "p_partkey"], ["steel", "n_conn", "drift"], "metric", "k").where("k is not null").withColumn("down", -F.col("k"))
    return ranks(u, ["p_type", "metric"], "down", ["p_partkey"], "place").select("p_type", "metric", "place", "p_partkey")


@query("""WITH j AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, c_acctbal, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderstatus = 'P' THEN 'not complete' END, CASE WHEN o_totalprice > 400000 THEN 'too heavy' END,
  CASE WHEN c_acctbal < 0 THEN 'drift over limit' END, CASE WHEN o_orderpriority LIKE '5%' AND c_mktsegment = 'BUILDING' THEN 'mixed system' END) AS reasons,
  NOT coalesce(o_orderstatus = 'P' OR o_totalprice > 400000 OR c_acctbal < 0 OR (o_orderpriority LIKE '5%' AND c_mktsegment = 'BUILDING'), false) AS eligible FROM j""")
def eligibility_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Rules with reasons; a missing value fails none."""
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rules = [("not complete", F.col("o_orderstatus") == "P"), ("too heavy", F.col("o_totalprice") > 400000), ("drift over limit", F.col("c_acctbal") < 0), ("mixed system", F.col("o_orderpriority").startswith("5") & (F.col("c_mktsegment") == "BUILDING"))]
    r = j.select("o_orderkey", S.eligibility(rules).alias("r"))
    return r.select("o_orderkey", F.array_join("r", "; ").alias("reasons"), (F.size("r") == 0).alias("eligible"))


@query("""WITH t AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS turn FROM part),
r AS (SELECT *, row_number() OVER (ORDER BY turn, p_type) AS position FROM t)
SELECT 'M' || lpad(CAST(position AS VARCHAR), 3, '0') AS plan_id, position, p_partkey, p_type, (position - 1) % 4 AS lane FROM r WHERE position <= 40""")
def round_robin_plan(spark: SparkSession, d: str) -> DataFrame:
    """A plan of forty in turn over categories, dealt to four lanes."""
    p = S.round_robin(table(spark, d, "part"), "p_type", [F.col("p_size"), F.col("p_partkey")], 40)
    return p.select("plan_id", "position", "p_partkey", "p_type", ((F.col("position") - 1) % 4).alias("lane"))


@query("""WITH m AS (SELECT p_partkey, p_type, CASE WHEN p_size % 4 = 0 THEN p_size * 10.0 END AS mass_kg, CASE p_type WHEN 'SMALL' THEN 1.5 WHEN 'LARGE' THEN 7.25 WHEN 'MEDIUM' THEN 4.0 END AS unit FROM part)
SELECT l_suppkey, round(sum(coalesce(mass_kg, unit * l_quantity)) / 1000, 6) AS steel_t, count(*) AS n,
  array_to_string(list_sort(list(DISTINCT p_type) FILTER (mass_kg IS NULL AND unit IS NULL))[1:10], ',') AS unknown
FROM lineitem JOIN m ON l_partkey = p_partkey GROUP BY l_suppkey""")
def tonnage_mass_or_length(spark: SparkSession, d: str) -> DataFrame:
    """Mass where it is given, else unit mass times length; sections without either are listed."""
    unit = F.when(F.col("p_type") == "SMALL", 1.5).when(F.col("p_type") == "LARGE", 7.25).when(F.col("p_type") == "MEDIUM", 4.0)
    m = table(spark, d, "part").select("p_partkey", "p_type", F.when(F.col("p_size") % 4 == 0, F.col("p_size") * 10.0).alias("mass_kg"), unit.alias("unit"))
    rows = table(spark, d, "lineitem").join(m, F.col("l_partkey") == F.col("p_partkey"))
    unknown = F.when(F.col("mass_kg").isNull() & F.col("unit").isNull(), F.col("p_type"))
    g = rows.groupBy("l_suppkey").agg(F.round(F.sum(F.coalesce("mass_kg", F.col("unit") * F.col("l_quantity"))) / 1000, 6).alias("steel_t"), F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set(unknown)), 1, 10), ",").alias("unknown"))
    return g.withColumn("unknown", F.when(F.col("unknown") != "", F.col("unknown")))


@query("""WITH r AS (SELECT p_partkey, CAST(round(p_retailprice, 1) AS DECIMAL(12, 1)) AS printed, CASE WHEN p_partkey % 7 = 0 THEN 10 WHEN p_partkey % 11 = 0 THEN 1.5 ELSE 1 END * p_retailprice AS expected FROM part),
t AS (SELECT p_partkey, printed::DOUBLE AS v, expected, 0.01 + 0.1 / 2 / abs(printed::DOUBLE) AS tol FROM r)
SELECT p_partkey, round(CASE WHEN abs(v - expected) / abs(expected) <= tol THEN v WHEN abs(v * 10 - expected) / abs(expected) <= tol THEN v * 10 WHEN abs(v * 0.1 - expected) / abs(expected) <= tol THEN v * 0.1 END, 4) AS value,
  CASE WHEN abs(v - expected) / abs(expected) <= tol THEN 'PASS' WHEN abs(v * 10 - expected) / abs(expected) <= tol OR abs(v * 0.1 - expected) / abs(expected) <= tol THEN 'REPAIRED' ELSE 'FAIL' END AS verdict FROM t""")
def halfulp_compare(spark: SparkSession, d: str) -> DataFrame:
    """A printed number against the computed one, with repair of a slipped decimal point (M6, M7)."""
    factor = F.when(F.col("p_partkey") % 7 == 0, 10.0).when(F.col("p_partkey") % 11 == 0, 1.5).otherwise(1.0)
    rows = table(spark, d, "part").select("p_partkey", F.round("p_retailprice", 1).cast("decimal(12,1)").cast("string").alias("printed"), (factor * F.col("p_retailprice")).alias("expected"))
    value, verdict = S.compare_printed(F.col("printed"), F.col("expected"))
    return rows.select("p_partkey", F.round(value, 4).alias("value"), verdict.alias("verdict"))


@query("""SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_sum, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_max,
  count(*) FILTER (json_extract(props, '$.missing.path') IS NULL) AS n_missing FROM events GROUP BY event_type""")
def json_path_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics by path out of nested text, null where the path or the text is not there."""
    v = table(spark, d, "events").select("event_type", F.try_parse_json("props").alias("v"))
    k = F.try_variant_get("v", "$.k", "bigint")
    return v.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"), F.count_if(F.try_variant_get("v", "$.missing.path", "double").isNull()).alias("n_missing"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 12 AS k, 60 + p_size * 5 AS a, 40 + p_size * 3 AS b, 4 + p_size % 9 AS t, round(20 + p_size * 1.25, 2) AS m FROM part)
SELECT p_partkey, round(CASE k WHEN 0 THEN m WHEN 1 THEN m WHEN 2 THEN 0.00785 * (2 * b * (t + 2) + (a - 2 * (t + 2)) * t) WHEN 3 THEN 0.00785 * (2 * b * (t + 2) + (a + 50 - 2 * (t + 2)) * t) WHEN 4 THEN 0.00785 * (a * b - (a - 2 * t) * (b - 2 * t))
  WHEN 5 THEN 0.00785 * pi() * (a - t) * t WHEN 6 THEN 0.00785 * (a * b - (a - 2 * t) * (b - 2 * t)) WHEN 7 THEN 0.00785 * t * (a + b - t) WHEN 8 THEN 2 * 0.00785 * t * (a + b - t) WHEN 9 THEN 2 * 0.00785 * t * (a + b - t) END, 6) AS kg_m FROM p""")
def section_masses(spark: SparkSession, d: str) -> DataFrame:
    """Unit mass out of designations of ten shapes; without one for a bare name and for unknown shapes."""
    text = lambda c: c.cast("string")
    size = F.col("p_size")
    a, b, t, m = text(60 + size * 5), text(40 + size * 3), text(4 + size % 9), F.format_string("%.2f", 20 + size * 1.25)
    thick = text(6 + size % 9)
    of = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    names = [
        of("ISWPB", a, " x ", b, "×", m), of("hb", a, "X", m), of("WI", a, "X", b, "X", thick, "X", t), of("TI", a, "-", text(160 + size * 5), "X", b, "X", thick, "X", t),
        of("BOX ", a, "X", b, "X", t), of("PIPE", a, "X", t), of("RHS", a, "X", b, "X", t), of("ISA", a, "X", b, "X", t), of("2L", a, "X", b, "X", t), of("Twin ISA ", a, "x", b, "x", t), of("MB", a), of("ZZ", a, "X", b),
    ]
    name = F.element_at(F.array(*names), (F.pmod("p_partkey", F.lit(12)) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.round(S.section_mass(name), 6).alias("kg_m"))

"""Queries of studies: calibration, voting, connections, costs, pivots, merges of results and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.operators import geometry
from ferrule.operators import scoring as S
from ferrule.operators.capacity import connection_ratio
from ferrule.plans import query, table


@query("""PIVOT (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS dc FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL) ON l_linenumber IN (1, 2, 3, 4) USING max(dc) GROUP BY l_orderkey""")
def wide_pivot(spark: SparkSession, d: str) -> DataFrame:
    """One column for each group (K7)."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").pivot("l_linenumber", [1, 2, 3, 4]).agg(F.max("l_extendedprice")).where("coalesce(`1`, `2`, `3`, `4`) is not null")


@query("""WITH r AS (SELECT l_suppkey, unnest(['price', 'taxed', 'net']) AS conv, unnest([l_extendedprice, l_extendedprice * (1 + l_tax), l_extendedprice * (1 - l_discount)]) / (l_quantity * 2000) AS ratio FROM lineitem),
m AS (SELECT l_suppkey, conv, quantile_cont(ratio, 0.5) AS scale, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 3),
a AS (SELECT l_suppkey, conv, scale, quantile_cont(abs(ratio / scale - 1), 0.5) AS mad FROM r JOIN m USING (l_suppkey, conv) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(mad, 9), conv) AS r FROM a)
SELECT l_suppkey, conv, round(scale, 7) AS scale, round(mad, 7) AS mad, round(greatest(0.025, 5 * mad), 7) AS tolerance FROM b WHERE r = 1""")
def calibration_mad(spark: SparkSession, d: str) -> DataFrame:
    """The convention with the least median deviation, its scale and tolerance."""
    p = F.col("l_extendedprice")
    kinds = F.array(*[F.struct(F.lit(n).alias("conv"), v.alias("v")) for n, v in (("price", p), ("taxed", p * (1 + F.col("l_tax"))), ("net", p * (1 - F.col("l_discount"))))])
    r = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", F.explode(kinds).alias("k")).select("l_suppkey", "k.conv", (F.col("k.v") / (F.col("l_quantity") * 2000)).alias("ratio"))
    m = r.groupBy("l_suppkey", "conv").agg(F.median("ratio").alias("scale"), F.count("*").alias("n")).where("n >= 3")
    a = r.join(m, ["l_suppkey", "conv"]).groupBy("l_suppkey", "conv", "scale").agg(F.median(F.abs(F.col("ratio") / F.col("scale") - 1)).alias("mad"))
    b = a.withColumn("r", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.round("mad", 9), "conv"))).where("r = 1")
    return b.select("l_suppkey", "conv", F.round("scale", 7).alias("scale"), F.round("mad", 7).alias("mad"), F.round(F.greatest(F.lit(0.025), 5 * F.col("mad")), 7).alias("tolerance"))


@query("""WITH c AS (SELECT unnest([5.0, 10.0, 20.0, 30.0, 40.0, 50.0]) AS standard),
v AS (SELECT l_partkey, standard, count(*) AS votes FROM lineitem JOIN c ON abs(l_quantity - standard) <= 1.5 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY votes DESC, standard) AS r FROM v)
SELECT l_partkey, CAST(standard AS DOUBLE) AS standard, votes FROM b WHERE r = 1 AND votes >= 2""")
def reading_votes(spark: SparkSession, d: str) -> DataFrame:
    """The standard value with most readings near it, two at least."""
    near = F.filter(F.array(*map(F.lit, (5.0, 10.0, 20.0, 30.0, 40.0, 50.0))), lambda s: F.abs(F.col("l_quantity") - s) <= 1.5)
    v = table(spark, d, "lineitem").select("l_partkey", F.explode(near).alias("standard")).groupBy("l_partkey", "standard").agg(F.count("*").alias("votes"))
    return v.withColumn("r", F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.desc("votes"), "standard"))).where("r = 1 and votes >= 2").select("l_partkey", "standard", "votes")


@query("""SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name, p_size) AS n, p_name || CASE WHEN count(*) OVER (PARTITION BY p_name, p_size) > 1
  THEN '#' || row_number() OVER (PARTITION BY p_name, p_size ORDER BY p_partkey) ELSE '' END AS designation FROM part""")
def duplicate_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Designations that occur more than once are numbered."""
    w = Window.partitionBy("p_name", "p_size")
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_name", n.alias("n"), F.concat("p_name", F.when(n > 1, F.concat(F.lit("#"), k.cast("string"))).otherwise("")).alias("designation"))


@query("""WITH w AS (SELECT l_suppkey, l_orderkey, l_extendedprice / 60000 AS dc, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey) AS r, count(*) FILTER (l_extendedprice > 60000) OVER (PARTITION BY l_suppkey) AS n_over FROM lineitem)
SELECT l_suppkey, l_orderkey AS worst, round(dc, 9) AS dc, n_over, CASE WHEN n_over = 0 THEN 'all within' ELSE n_over || ' over the limit' END AS headline FROM w WHERE r = 1""")
def worst_member(spark: SparkSession, d: str) -> DataFrame:
    """The worst member and a headline."""
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max(F.struct("l_extendedprice", (-F.col("l_orderkey")).alias("o"))).alias("m"), F.count_if(F.col("l_extendedprice") > 60000).alias("n_over"))
    head = F.when(F.col("n_over") == 0, "all within").otherwise(F.concat(F.col("n_over").cast("string"), F.lit(" over the limit")))
    return g.select("l_suppkey", (-F.col("m.o")).alias("worst"), F.round(F.col("m.l_extendedprice") / 60000, 9).alias("dc"), "n_over", head.alias("headline"))


@query("""WITH h AS (SELECT l_partkey, l_returnflag AS f, max(l_quantity) AS p, max(l_discount) AS v, max(l_tax) AS g, max(l_extendedprice) AS m FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
c AS (SELECT p_partkey, p_size, p_retailprice / 2000 AS rec, p_size % 2 = 1 AS base, CASE p_size % 4 WHEN 3 THEN 1.5 WHEN 2 THEN 1.25 ELSE 1.1 END AS gamma FROM part),
w AS (SELECT c.*, a.l_partkey IS NULL AS none, CASE WHEN a.p > 1e-9 THEN coalesce(r.p, 0) / a.p END AS up, CASE WHEN base THEN CASE WHEN a.v > 1e-9 THEN coalesce(r.v, 0) / a.v END ELSE CASE WHEN a.g > 1e-9 THEN coalesce(r.g, 0) / a.g END END AS uv,
  CASE WHEN a.m > 1e-9 THEN coalesce(r.m, 0) / a.m END AS um FROM c LEFT JOIN h a ON a.l_partkey = p_partkey AND a.f = 'A' LEFT JOIN h r ON r.l_partkey = p_partkey AND r.f = 'R')
SELECT p_partkey, gamma::DOUBLE AS gamma, round(rec / gamma, 6) AS dc_base, round(rec / gamma * CASE p_size % 3 WHEN 0 THEN greatest(1.0, uv) WHEN 1 THEN greatest(1.0, up, uv) ELSE greatest(1.0, um) END, 6) AS dc,
  concat_ws(',', CASE WHEN p_size % 3 = 1 AND up IS NOT NULL THEN 'P_N=col_P' END, CASE WHEN p_size % 3 < 2 AND uv IS NOT NULL THEN CASE WHEN base THEN 'V_N=V_base' ELSE 'V_N=gravity_beam_V' END END,
    CASE WHEN p_size % 3 = 2 AND um IS NOT NULL THEN CASE WHEN base THEN 'M_Nmm=col_M' ELSE 'M_Nmm=beam_M' END END, CASE WHEN p_size % 3 = 2 THEN 'M_1_2Mp_Nmm=fixed' END) AS mapped FROM w""")
def connection_scaling(spark: SparkSession, d: str) -> DataFrame:
    """Connections scaled by the growth of the handles that their demands follow; capacity-designed demands do not grow."""
    top = lambda flag, tag: table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("p"), F.max("l_discount").alias("v"), F.max("l_tax").alias("g"), F.max("l_extendedprice").alias("m")).select("p_partkey", F.create_map(*[x for n, c in (("col_P", "p"), ("V_base", "v"), ("gravity_beam_V", "g"), ("col_M", "m"), ("beam_M", "m")) for x in (F.lit(n), F.col(c))]).alias(tag))
    r = table(spark, d, "part").join(top("A", "was"), "p_partkey", "left").join(top("R", "now"), "p_partkey", "left")
    size = F.col("p_size")
    what = F.when(size % 2 == 1, "column base plate").otherwise("gravity beam")
    state = F.when(size % 4 == 3, "site weld 10.5").when(size % 4 == 2, "bolts_10_3 10.3.2").otherwise("panel-zone shear (yield)")
    demands = F.when(size % 3 == 0, F.array(F.lit("V_N"))).when(size % 3 == 1, F.array(F.lit("P_N"), F.lit("V_N"))).otherwise(F.array(F.lit("M_Nmm"), F.lit("M_1_2Mp_Nmm")))
    c = connection_ratio(F.lit("c"), what, state, F.lit(None).cast("string"), F.col("p_retailprice") / 2000, demands, F.col("was"), F.col("now"))
    got = r.select("p_partkey", c.alias("c"))
    mapped = F.array_join(F.transform("c.mapped", lambda m: F.concat_ws("=", m["key"], m["handle"])), ",")
    return got.select("p_partkey", F.col("c.factor").alias("gamma"), F.round("c.dc_base", 6).alias("dc_base"), F.round("c.dc", 6).alias("dc"), mapped.alias("mapped"))


@query("""WITH n AS (SELECT l_partkey, count(*) FILTER (l_quantity > 45) AS conn, count(*) FILTER (l_quantity < 5) AS braces FROM lineitem GROUP BY 1),
m AS (SELECT p_partkey, CASE WHEN p_size % 6 <> 0 THEN p_size / 4.0 END AS t, nullif(conn, 0) AS conn, nullif(braces, 0) AS braces, CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS area FROM part LEFT JOIN n ON l_partkey = p_partkey),
c AS (SELECT p_partkey, t * 110000 + coalesce(conn, 0) * 50000 + coalesce(braces, 0) * 25000 AS cost, area * 45000 AS revenue FROM m)
SELECT p_partkey, round(cost, 3) AS modelled_cost, round(revenue, 3) AS revenue_proxy, round(revenue - cost, 3) AS net_value FROM c""")
def cost_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Cost and revenue from rates, one of them not the default: a missing tonnage gives null, a missing count nothing (M4)."""
    q = F.col("l_quantity")
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.nullif(F.count_if(q > 45), F.lit(0)).alias("conn"), F.nullif(F.count_if(q < 5), F.lit(0)).alias("braces"))
    r = table(spark, d, "part").join(n, "p_partkey", "left")
    t, area = F.when(F.col("p_size") % 6 != 0, F.col("p_size") / 4.0), F.when(F.col("p_size") % 5 != 0, F.col("p_retailprice"))
    out = S.cost_metrics(t, F.col("conn"), F.col("braces"), area, {"per_moment_conn": 50000.0})
    return r.select("p_partkey", *[F.round(c, 3).alias(k) for k, c in out.items()])


@query("""WITH r AS (SELECT p_partkey, ['beam I', 'Channel', 'equal angle'][p_partkey % 3 + 1] AS kind, 200.0 + p_size AS d, 100.0 AS b, 6.5 AS tw, 8.0 + p_size % 5 AS tf, CASE WHEN p_size % 4 > 0 THEN p_size % 4 * 3.0 END AS r1,
  CASE WHEN p_partkey % 11 = 0 THEN 'QUARANTINED: by hand' ELSE 'PASS' END AS was FROM part),
a AS (SELECT *, CASE WHEN kind NOT LIKE '%angle%' THEN 2 * b * tf + (d - 2 * tf) * tw + CASE WHEN kind = 'Channel' THEN 2 ELSE 4 END * (1 - pi() / 4) * coalesce(r1, 0) ** 2 END AS area FROM r),
p AS (SELECT *, CASE WHEN p_partkey % 13 = 0 THEN 0.0 ELSE 3000.0 END AS printed FROM a)
SELECT p_partkey, round(area, 6) AS area, CASE WHEN printed <> 0 AND abs(printed / area - 1) > 0.05 AND NOT starts_with(was, 'QUARANTINED') THEN 'QUARANTINED: area is ' || printf('%.2f', printed / area) || ' of the plates'' (was: ' || was || ')' ELSE was END AS verdict FROM p""")
def plate_area_check(spark: SparkSession, d: str) -> DataFrame:
    """A printed area against that of plates and fillets, with quarantine."""
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.get(F.array(*map(F.lit, ("beam I", "Channel", "equal angle"))), (k % 3).cast("int"))
    area = geometry.plate_area(kind, 200.0 + size, F.lit(100.0), F.lit(6.5), 8.0 + size % 5, F.when(size % 4 > 0, size % 4 * 3.0))
    was = F.when(k % 11 == 0, "QUARANTINED: by hand").otherwise("PASS")
    verdict = geometry.plate_verdict(F.when(k % 13 == 0, 0.0).otherwise(3000.0), F.col("area"), was)
    return table(spark, d, "part").withColumn("area", area).select("p_partkey", F.round("area", 6).alias("area"), verdict.alias("verdict"))


@query("""SELECT p_partkey, round(p_size * f, 6) AS a, round(p_retailprice * f, 6) AS ix, round(p_retailprice / 3 * f, 6) AS iy, round(p_size * 0.5 * f * f * f, 6) AS j FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE 0.9 + p_size / 250.0 END AS f FROM part)""")
def stiffness_factors(spark: SparkSession, d: str) -> DataFrame:
    """Section stiffness under a factor of plate thickness, one where there is none."""
    size, i = F.col("p_size"), F.col("p_retailprice")
    s = geometry.thickened(size.cast("double"), i, i / 3, size * 0.5, F.when(size % 3 != 0, 0.9 + size / 250.0))
    return table(spark, d, "part").select("p_partkey", s.alias("s")).select("p_partkey", *[F.round(F.col("s")[k], 6).alias(k) for k in ("a", "ix", "iy", "j")])


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'I' ELSE 'C' END AS k, 100 + p_size AS d, 80 AS b, CASE WHEN p_partkey % 4 = 1 THEN 22.5 WHEN p_partkey % 4 = 3 THEN 0 END AS cy, 20.0 + p_size AS a, 900.0 + p_retailprice AS ix, 100.0 + p_size AS iy, CASE WHEN p_size % 10 = 0 THEN 250 ELSE 100 END AS size FROM part),
e AS (SELECT *, 0.785 * a AS mass, sqrt(ix * 1e4 / (a * 100)) AS rx, ix * 10 / (d / 2.0) AS zx, sqrt(iy * 1e4 / (a * 100)) AS ry, iy * 10 / (CASE WHEN k = 'I' THEN b / 2.0 ELSE b - cy END) AS zy FROM r),
w AS (SELECT *, CAST(round(mass * CASE p_partkey % 5 WHEN 1 THEN 1.5 WHEN 2 THEN 10 ELSE 1 END, 1) AS DECIMAL(12, 1))::DOUBLE AS pm, CAST(round(rx * CASE p_partkey % 7 WHEN 1 THEN 1.2 ELSE 1 END, 1) AS DECIMAL(12, 1))::DOUBLE AS px,
  CAST(round(zx * CASE p_partkey % 3 WHEN 1 THEN 0.1 WHEN 2 THEN 0.8 ELSE 1 END, 1) AS DECIMAL(12, 1))::DOUBLE AS pzx, CASE WHEN p_partkey % 6 > 0 THEN CAST(round(ry, 1) AS DECIMAL(12, 1))::DOUBLE END AS py, CAST(round(zy * CASE p_partkey % 8 WHEN 3 THEN 2 ELSE 1 END, 1) AS DECIMAL(12, 1))::DOUBLE AS pzy FROM e),
t AS (SELECT *, 0.01 + 0.05 / pm + 0.05 / a AS tm, 0.01 + 0.05 / px + 0.5 * (0.005 / ix + 0.05 / a) AS tx, 0.01 + 0.05 / pzx + 0.005 / ix + 0.5 / d AS tzx, 0.01 + 0.05 / py + 0.5 * (0.05 / iy + 0.05 / a) AS ty,
  0.01 + 0.05 / pzy + 0.05 / iy + 0.5 / b + CASE WHEN k = 'C' THEN 0.05 / greatest(cy, 1e-12) ELSE 0 END AS tzy FROM w)
SELECT p_partkey, concat_ws(',', CASE WHEN least(abs(pm / mass - 1), abs(pm * 10 / mass - 1), abs(pm / 10 / mass - 1)) > tm THEN 'mass' END, CASE WHEN least(abs(px / rx - 1), abs(px * 10 / rx - 1), abs(px / 10 / rx - 1)) > tx THEN 'rxx' END,
  CASE WHEN least(abs(pzx / zx - 1), abs(pzx * 10 / zx - 1), abs(pzx / 10 / zx - 1)) > tzx THEN 'Zex' END, CASE WHEN least(abs(py / ry - 1), abs(py * 10 / ry - 1), abs(py / 10 / ry - 1)) > ty THEN 'ryy' END,
  CASE WHEN least(abs(pzy / zy - 1), abs(pzy * 10 / zy - 1), abs(pzy / 10 / zy - 1)) > tzy THEN 'Zey' END, CASE WHEN d / size::DOUBLE NOT BETWEEN 0.85 AND 1.25 THEN 'designation' END) AS issues FROM t""")
def section_checks(spark: SparkSession, d: str) -> DataFrame:
    """Printed values of a section that its other values contradict (M7)."""
    k, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    put = lambda c, n=1: F.round(c, n).cast(f"decimal(12,{n})").cast("string")
    schema = F.when(k % 2 == 0, "I").otherwise("C")
    r = table(spark, d, "part").select("p_partkey", schema.alias("schema"), (100 + size).alias("d"), F.when(k % 4 == 1, 22.5).when(k % 4 == 3, 0.0).alias("cy"), (20.0 + size).alias("a"), (900.0 + price).alias("ix"), (100.0 + size).alias("iy"), F.when(size % 10 == 0, "XB 250").otherwise("XB 100").alias("designation"))
    wrong = lambda m, f: F.coalesce(*[F.when(k % m == i, x) for i, x in f.items()], F.lit(1.0))
    half = F.when(F.col("schema") == "I", 40.0).otherwise(80 - F.col("cy"))
    printed = {
        "A_cm2": put(F.col("a")), "D": F.col("d").cast("string"), "B": F.lit("80"), "Cy": put(F.col("cy")), "Ixx_cm4": put(F.col("ix"), 2), "Iyy_cm4": put(F.col("iy")),
        "mass_kg_m": put(0.785 * F.col("a") * wrong(5, {1: 1.5, 2: 10.0})), "rxx": put(F.sqrt(F.col("ix") * 1e4 / (F.col("a") * 100)) * wrong(7, {1: 1.2})),
        "Zex_cm3": put(F.col("ix") * 10 / (F.col("d") / 2) * wrong(3, {1: 0.1, 2: 0.8})), "ryy": F.when(k % 6 > 0, put(F.sqrt(F.col("iy") * 1e4 / (F.col("a") * 100)))), "Zey_cm3": put(F.col("iy") * 10 / half * wrong(8, {3: 2.0})),
    }
    return r.select("p_partkey", F.array_join(S.section_issues(F.col("schema"), F.col("designation"), printed), ",").alias("issues"))


@query("""WITH k(pattern, ord) AS (VALUES ('bolt', 1), ('ring', 2), ('widget', 3))
SELECT p_partkey, arg_min(pattern, ord) AS key FROM part JOIN k ON contains(p_name, pattern) GROUP BY p_partkey""")
def capacity_key_search(spark: SparkSession, d: str) -> DataFrame:
    """The first pattern in order that matches."""
    found = F.coalesce(*[F.when(F.col("p_name").contains(p), F.lit(p)) for p in ("bolt", "ring", "widget")])
    return table(spark, d, "part").select("p_partkey", found.alias("key")).where("key is not null")


@query("""SELECT c_custkey, coalesce(a.t, b.t, c_acctbal) AS value, CASE WHEN a.t IS NOT NULL THEN 'package' WHEN b.t IS NOT NULL THEN 'read' ELSE 'estimate' END AS origin FROM customer
LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS t FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%' GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS t FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '2%' GROUP BY 1) b ON b.o_custkey = c_custkey""")
def metric_fill(spark: SparkSession, d: str) -> DataFrame:
    """A metric from the package, else as read, else estimated, and which."""
    best = lambda s, p, tag: table(spark, d, "orders").where((F.col("o_orderstatus") == s) & F.col("o_orderpriority").startswith(p)).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias(tag))
    r = table(spark, d, "customer").join(best("F", "1", "a"), "c_custkey", "left").join(best("P", "2", "b"), "c_custkey", "left")
    return r.select("c_custkey", F.coalesce("a", "b", "c_acctbal").alias("value"), F.when(F.col("a").isNotNull(), "package").when(F.col("b").isNotNull(), "read").otherwise("estimate").alias("origin"))


@query("""SELECT c_custkey, arg_max(v, ord) AS title FROM (SELECT c_custkey, c_name AS v, 0 AS ord FROM customer UNION ALL SELECT o_custkey, o_orderpriority, o_orderkey + 1 FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def later_file_wins(spark: SparkSession, d: str) -> DataFrame:
    """Of keyed titles in several files the last counts."""
    a = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("v"), F.lit(0).cast("long").alias("ord"))
    b = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("v"), (F.col("o_orderkey") + 1).alias("ord"))
    return a.unionByName(b).groupBy("c_custkey").agg(F.max_by("v", "ord").alias("title"))


@query("""SELECT p_type, p_size % 5 AS role, count(*) AS n, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS sections FROM part GROUP BY ALL""")
def probe_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by role and section, with the sorted sections."""
    return table(spark, d, "part").groupBy("p_type", (F.col("p_size") % 5).alias("role")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("sections"))


@query("""WITH u AS (SELECT p_partkey AS id, p_name AS title, p_size AS size, NULL::DOUBLE AS balance FROM part UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier)
SELECT id, title, count(size) AS n_size, count(balance) AS n_balance FROM u GROUP BY ALL""")
def contract_union(spark: SparkSession, d: str) -> DataFrame:
    """Two generations of a shape as one."""
    a = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("size"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("id", "title").agg(F.count("size").alias("n_size"), F.count("balance").alias("n_balance"))


@query("""SELECT event_type, count(*) FILTER (ts > TIMESTAMP '2024-01-20') AS newer, max(ts) AS last, bool_or(ts > TIMESTAMP '2024-01-29 23:00:00') AS stale FROM events GROUP BY 1""")
def staleness(spark: SparkSession, d: str) -> DataFrame:
    """What is newer than a time, and whether that makes a result stale."""
    after = lambda t: F.col("ts") > F.lit(t).cast("timestamp_ntz")
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(after("2024-01-20 00:00:00")).alias("newer"), F.max("ts").alias("last"), F.bool_or(after("2024-01-29 23:00:00")).alias("stale"))


@query("""WITH s AS (SELECT user_id, event_id FROM events WHERE event_type = 'signup'), e AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT s.user_id, max(s.event_id) AS started, count(*) AS n FROM s LEFT JOIN e USING (user_id) WHERE e.last IS NULL OR s.event_id > e.last GROUP BY 1""")
def live_runs(spark: SparkSession, d: str) -> DataFrame:
    """Starts without an end after them."""
    e = table(spark, d, "events")
    ends = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("last"))
    s = e.where("event_type = 'signup'").join(ends, "user_id", "left").where("last is null or event_id > last")
    return s.groupBy("user_id").agg(F.max("event_id").alias("started"), F.count("*").alias("n"))


@query("""SELECT o_custkey AS plan, count(*) AS n_queries, count(*) FILTER (l.k IS NOT NULL) AS n_found, count(*) FILTER (o_orderstatus = 'F') AS n_cached,
  string_agg(o_orderkey || ':' || CASE WHEN l.k IS NULL THEN 'missing' WHEN o_orderstatus = 'F' THEN 'cached' ELSE 'found' END, ',' ORDER BY o_orderkey) AS results
  FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON k = o_orderkey GROUP BY 1""")
def batch_answers(spark: SparkSession, d: str) -> DataFrame:
    """The answer of each plan: asked, found, cached, and every result in order (K13, X23). A plan is a customer, so an answer is a short list."""
    k = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("k", F.lit(True))
    how = F.when(F.col("k").isNull(), "missing").when(F.col("o_orderstatus") == "F", "cached").otherwise("found")
    g = table(spark, d, "orders").join(k, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("plan"))
    results = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", how.alias("how")))), lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["how"]))
    return g.agg(F.count("*").alias("n_queries"), F.count_if(F.col("k").isNotNull()).alias("n_found"), F.count_if(F.col("o_orderstatus") == "F").alias("n_cached"), F.array_join(results, ",").alias("results"))


@query("""SELECT p_partkey, 'size' AS metric, p_size::DOUBLE AS v FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part WHERE p_retailprice < 1000""")
def selection_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The metrics of a selection that are not null, as rows of a map."""
    m = F.create_map(F.lit("size"), F.when(F.col("p_size") > 10, F.col("p_size").cast("double")), F.lit("price"), F.when(F.col("p_retailprice") < 1000, F.col("p_retailprice")))
    return table(spark, d, "part").select("p_partkey", F.explode(F.map_filter(m, lambda k, v: v.isNotNull())).alias("metric", "v"))

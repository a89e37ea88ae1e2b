"""Queries of study statistics over ``lineitem``: a supplier is a group, an order a realisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.operators import capacity as C
from ferrule.operators import statistics as S
from ferrule.operators.ordered import quantiles
from ferrule.plans import query, table


def rounded(df: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    return df.select(*keys, *[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


@query("""WITH v AS (SELECT l_suppkey, l_extendedprice / 1000 AS x FROM lineitem),
b AS (SELECT l_suppkey, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS s, stddev_pop(x) AS sp, quantile_cont(x, 0.5) AS median, min(x) AS min, max(x) AS max,
  quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.95) AS p95, avg(CASE WHEN x > 80 THEN 1.0 ELSE 0.0 END) AS p_over, avg(CASE WHEN x > 40 THEN 1.0 ELSE 0.0 END) AS p_over_base,
  avg(ln(x)) AS mu, stddev_samp(ln(x)) AS sigma FROM v GROUP BY l_suppkey),
t AS (SELECT l_suppkey, avg(power(x - mean, 3)) AS m3 FROM v JOIN b USING (l_suppkey) GROUP BY l_suppkey),
f AS (SELECT *, CASE WHEN sp <= 1e-7 * abs(mean) THEN 0 ELSE s END AS std FROM b JOIN t USING (l_suppkey))
SELECT l_suppkey, n, round(mean, 9) AS mean, round(std, 9) AS std, round(std / mean, 9) AS cov, round(median, 9) AS median, round(min, 9) AS min,
  round(max, 9) AS max, round(p5, 9) AS p5, round(p95, 9) AS p95, round(CASE WHEN n <= 2 OR std = 0 THEN 0 ELSE m3 / power(std, 3) END, 9) AS skewness,
  round(CASE WHEN n > 1 THEN mean - 1.96 * std / sqrt(n) END, 9) AS ci_low, round(CASE WHEN n > 1 THEN mean + 1.96 * std / sqrt(n) END, 9) AS ci_high,
  round(p_over, 9) AS p_over, round(CASE WHEN std > 0 THEN exp(mu + 1.645 * sigma) END, 9) AS p95_lognormal, sp <= 1e-7 * abs(mean) AS invariant,
  40.0::DOUBLE AS base, round(mean / 40, 9) AS ratio_mean, round(p_over_base, 9) AS p_over_base, round(p95 / 40, 9) AS p95_over_base FROM f""")
def describe_stats(spark: SparkSession, d: str) -> DataFrame:
    """Descriptive statistics by group (A10); the lognormal exceedance needs erf, which SQL lacks, so tests hold it."""
    v = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / 1000).alias("x"), F.lit(40.0).alias("base"))
    return rounded(S.describe(v, ["l_suppkey"], "x", 80.0, "base").drop("p_over_lognormal"), ["l_suppkey"], 9)


@query("""WITH f AS (SELECT l_suppkey, avg(ln(l_extendedprice)) AS mu, stddev_samp(ln(l_extendedprice)) AS sigma FROM lineitem GROUP BY 1 HAVING min(l_extendedprice) > 0)
SELECT l_suppkey, round(mu, 5) AS mu, round(sigma, 5) AS sigma, round(exp(mu), 3) AS median, round(exp(mu + sigma * sigma / 2), 3) AS mean, round(sqrt(exp(sigma * sigma) - 1), 5) AS cov FROM f""")
def lognormal_fit(spark: SparkSession, d: str) -> DataFrame:
    """A lognormal fit by group."""
    f = S.lognormal_fit(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return f.select("l_suppkey", F.round("mu", 5).alias("mu"), F.round("sigma", 5).alias("sigma"), F.round("median", 3).alias("median"), F.round("mean", 3).alias("mean"), F.round("cov", 5).alias("cov"))


@query()
def ks_lognormal(spark: SparkSession, d: str) -> DataFrame:
    """Kolmogorov-Smirnov against the fitted lognormal (A17, A18); neither engine has erf, so tests hold it against math.erf."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_extendedprice")
    fit = S.lognormal_fit(rows, ["l_suppkey"], "l_extendedprice").select("l_suppkey", "mu", "sigma")
    z = (F.log("l_extendedprice") - F.col("mu")) / F.col("sigma")  # grows with the price, so ranks by price are ranks by z
    return rounded(S.ks(rows, ["l_suppkey"], "l_extendedprice", S.normal_cdf(z), fit), ["l_suppkey"], 4)


@query("""WITH a AS (SELECT l_returnflag, count(*) AS c, min(l_extendedprice) AS least, max(l_extendedprice) AS most, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS iqr FROM lineitem GROUP BY 1),
m AS (SELECT *, least(least, 500) AS lo, greatest(most, 120000) AS hi FROM a),
k AS (SELECT l_returnflag, CAST(least(greatest(CASE WHEN iqr > 0 AND c >= 8 THEN ceil((most - least) / (2 * iqr / power(c, 1.0 / 3))) ELSE ceil(sqrt(c)) END, 6), 24) AS BIGINT) AS k,
  lo - 0.04 * CASE WHEN hi > lo THEN hi - lo ELSE 0.1 END AS lo, hi + 0.04 * CASE WHEN hi > lo THEN hi - lo ELSE 0.1 END AS hi FROM m),
n AS (SELECT l_returnflag, least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / k)) AS BIGINT), k - 1) AS bin, count(*) AS n FROM lineitem JOIN k USING (l_returnflag) GROUP BY ALL),
b AS (SELECT *, unnest(range(0, k)) AS bin FROM k)
SELECT l_returnflag, bin, round(lo + bin * ((hi - lo) / k), 3) AS low, round(lo + (bin + 1) * ((hi - lo) / k), 3) AS high, coalesce(n, 0) AS n FROM b LEFT JOIN n USING (l_returnflag, bin)""")
def histogram_fd(spark: SparkSession, d: str) -> DataFrame:
    """A histogram with Freedman-Diaconis bins, widened to two marks."""
    return rounded(S.histogram(table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", [F.lit(500.0), F.lit(120000.0)]), ["l_returnflag", "bin"], 3)


@query("""WITH x AS (SELECT l_orderkey, sum(l_extendedprice) AS response, sum(l_quantity) AS quantity, sum(l_discount) AS discount, sum(l_tax) AS tax FROM lineitem GROUP BY 1),
u AS (SELECT l_orderkey, round(response, 4) AS response, unnest(['quantity', 'discount', 'tax']) AS driver, unnest([round(quantity, 4), round(discount, 4), round(tax, 4)]) AS v FROM x),
r AS (SELECT driver, row_number() OVER (PARTITION BY driver ORDER BY v, l_orderkey) AS a, row_number() OVER (PARTITION BY driver ORDER BY response, l_orderkey) AS b FROM u)
SELECT driver, count(*) AS n, round(corr(a, b), 6) AS rho, row_number() OVER (ORDER BY abs(corr(a, b)) DESC) AS rank FROM r GROUP BY driver""")
def spearman_drivers(spark: SparkSession, d: str) -> DataFrame:
    """Drivers ranked by rank correlation with the response."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 4).alias("response"), F.round(F.sum("l_quantity"), 4).alias("quantity"), F.round(F.sum("l_discount"), 4).alias("discount"), F.round(F.sum("l_tax"), 4).alias("tax"))
    u = x.unpivot(["l_orderkey", "response"], ["quantity", "discount", "tax"], "driver", "v")
    r = S.spearman(u, ["driver"], "v", "response", ["l_orderkey"])
    return r.select("driver", "n", F.round("rho", 6).alias("rho"), F.row_number().over(Window.orderBy(F.abs("rho").desc())).cast("long").alias("rank"))


@query("""WITH m AS (SELECT l_suppkey, count(*) AS n, max(l_quantity) AS max_quantity, max(l_extendedprice) AS max_price, max(l_discount) AS max_discount FROM lineitem GROUP BY 1),
a AS (SELECT l_suppkey, l_orderkey AS governing_order, l_linenumber AS governing_line FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey
  ORDER BY round(l_extendedprice * (1 - l_discount), 4) DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1)
SELECT * FROM m JOIN a USING (l_suppkey)""")
def group_envelope_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The envelope of a group's quantities and which case governs (A3, A4)."""
    at = F.struct(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("s"), (-F.col("l_orderkey")).alias("o"), (-F.col("l_linenumber")).alias("l"))
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("max_quantity"), F.max("l_extendedprice").alias("max_price"), F.max("l_discount").alias("max_discount"), F.max(at).alias("at"))
    return rows.select("l_suppkey", "n", "max_quantity", "max_price", "max_discount", (-F.col("at.o")).alias("governing_order"), (-F.col("at.l")).cast("int").alias("governing_line"))


@query("""WITH g AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_suppkey, l_linenumber) AS r FROM lineitem),
n AS (SELECT l_suppkey, count(*) AS n FROM g WHERE r = 1 GROUP BY 1)
SELECT l_suppkey, n, round(n / (SELECT sum(n) FROM n), 6) AS share FROM n""")
def governing_shift(spark: SparkSession, d: str) -> DataFrame:
    """Which group governs each realisation, counted."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.struct("l_extendedprice", (-F.col("l_suppkey")).alias("s"))).alias("m")).select((-F.col("m.s")).alias("l_suppkey"))
    n = g.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("l_suppkey", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("""WITH v AS (SELECT l_linenumber, l_extendedprice / 60000 AS dc, l_quantity / 30 AS base FROM lineitem)
SELECT l_linenumber, round(avg(dc), 5) AS mean, round(max(dc), 5) AS max, round(min(dc), 5) AS min, round(quantile_cont(dc, 0.95), 5) AS p95,
  round(avg(CASE WHEN dc > 1 THEN 1.0 ELSE 0.0 END), 5) AS p_over_1, round(avg(CASE WHEN dc > base THEN 1.0 ELSE 0.0 END), 5) AS p_over_base, round(avg(dc - base), 5) AS mean_change FROM v GROUP BY 1""")
def group_range_table(spark: SparkSession, d: str) -> DataFrame:
    """Range and exceedance of every group."""
    v = table(spark, d, "lineitem").select("l_linenumber", (F.col("l_extendedprice") / 60000).alias("dc"), (F.col("l_quantity") / 30).alias("base"))
    share = lambda c: F.avg(c.cast("double"))
    g = v.groupBy("l_linenumber").agg(F.avg("dc").alias("mean"), F.max("dc").alias("max"), F.min("dc").alias("min"), share(F.col("dc") > 1).alias("p_over_1"), share(F.col("dc") > F.col("base")).alias("p_over_base"), F.avg(F.col("dc") - F.col("base")).alias("mean_change"))
    return rounded(g.join(quantiles(v, ["l_linenumber"], "dc", {"p95": 0.95}), "l_linenumber"), ["l_linenumber"])


@query("""WITH v AS (SELECT l_suppkey, l_shipdate, l_returnflag AS dir, l_linenumber AS storey, l_discount * 10 AS drift FROM lineitem),
s AS (SELECT l_suppkey, dir, storey, max(drift) AS drift FROM v GROUP BY ALL),
g AS (SELECT l_suppkey, dir, max(drift) AS mx, avg(drift) AS mean, string_agg(CAST(CAST(round(drift * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY storey) AS profile, bool_and(drift <= 1.0) AS ok FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY mx DESC, dir) AS r, bool_and(ok) OVER (PARTITION BY l_suppkey) AS all_ok FROM g)
SELECT l_suppkey, dir AS worst, round(mx, 5) AS utilisation, round(1 - mx, 5) AS margin, round(mx / mean, 5) AS concentration, profile, all_ok FROM r WHERE r = 1""")
def drift_profile(spark: SparkSession, d: str) -> DataFrame:
    """The worst direction of each model, its profile and concentration."""
    s = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("dir"), F.col("l_linenumber").alias("storey")).agg(F.max(F.col("l_discount") * 10).alias("drift"))
    profile = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("storey", F.round(F.col("drift") * 100).cast("long").cast("string").alias("v")))), lambda x: x["v"]), ",")
    g = s.groupBy("l_suppkey", "dir").agg(F.max("drift").alias("mx"), F.avg("drift").alias("mean"), profile.alias("profile"), F.bool_and(F.col("drift") <= 1.0).alias("ok"))
    w = Window.partitionBy("l_suppkey")
    r = g.withColumns({"r": F.row_number().over(w.orderBy(F.desc("mx"), "dir")), "all_ok": F.bool_and("ok").over(w)}).where("r = 1")
    return r.select("l_suppkey", F.col("dir").alias("worst"), F.round("mx", 5).alias("utilisation"), F.round(1 - F.col("mx"), 5).alias("margin"), F.round(F.col("mx") / F.col("mean"), 5).alias("concentration"), "profile", "all_ok")


DEMANDS = """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE l_returnflag WHEN 'A' THEN 'beam' WHEN 'N' THEN 'brace' ELSE 'column' END AS kind,
  l_quantity AS Mz, l_discount * 100 AS V, CASE WHEN l_linestatus = 'F' THEN l_tax * 100 ELSE 1e-7 END AS My0, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END AS comp,
  CASE WHEN l_linenumber % 3 = 0 THEN l_quantity / 2 ELSE 0 END AS tens, CASE WHEN p_size <> 7 THEN p_size * 2.0 END AS Mdz, p_size * 1.0 AS Vd, CASE WHEN p_size > 10 THEN p_size * 0.5 END AS Mdy,
  CASE WHEN p_size > 3 THEN p_size * 3.0 END AS Pd, CASE WHEN p_size > 5 THEN p_size * 4.0 END AS Td FROM lineitem JOIN part ON l_partkey = p_partkey),
y AS (SELECT *, CASE WHEN My0 < 1e-6 * greatest(Mz, V, My0, comp, tens) THEN 0 ELSE My0 END AS My FROM x),
t AS (SELECT *, CASE WHEN Mz <> 0 THEN Mz / Mdz END AS b, CASE WHEN My <> 0 THEN My / Mdy END AS w, CASE WHEN V <> 0 THEN V / Vd END AS s FROM y)"""


@query(DEMANDS + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, kind, round(CASE kind
  WHEN 'beam' THEN CASE WHEN My = 0 OR Mdy IS NOT NULL THEN greatest(b, s, w, CASE WHEN comp <> 0 AND Mdz IS NOT NULL THEN comp / Pd + coalesce(b, 0) + coalesce(w, 0) END) END
  WHEN 'brace' THEN greatest(CASE WHEN comp <> 0 THEN comp / Pd END, CASE WHEN tens <> 0 AND Td IS NOT NULL THEN tens / Td WHEN tens <> 0 AND comp = 0 THEN tens / Pd END)
  ELSE CASE WHEN Pd IS NOT NULL AND (Mz = 0 OR b IS NOT NULL) AND (My = 0 OR w IS NOT NULL) THEN
    greatest(comp / Pd + coalesce(b, 0) + coalesce(w, 0), CASE WHEN tens <> 0 THEN tens / Td + coalesce(b, 0) + coalesce(w, 0) END, s) END END, 9) AS dc FROM t""")
def dc_exact_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Demand over capacity, exact by kind of member (M1)."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    q, size, line = F.col("l_quantity"), F.col("p_size"), F.col("l_linenumber")
    demand = {"Mz": q, "V": F.col("l_discount") * 100, "My": F.when(F.col("l_linestatus") == "F", F.col("l_tax") * 100).otherwise(1e-7), "comp": F.when(line % 2 == 0, q).otherwise(0.0), "tens": F.when(line % 3 == 0, q / 2).otherwise(0.0)}
    strength = {"Mdz": F.when(size != 7, size * 2.0), "Vd": size * 1.0, "Mdy": F.when(size > 10, size * 0.5), "Pd": F.when(size > 3, size * 3.0), "Td": F.when(size > 5, size * 4.0)}
    kind = F.when(F.col("l_returnflag") == "A", "beam").when(F.col("l_returnflag") == "N", "brace").otherwise("column")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", kind.alias("kind"), F.round(C.capacity_ratio(kind, demand, strength), 9).alias("dc"))


@query("""WITH b AS (SELECT l_suppkey, max(l_quantity) AS q, max(l_discount) AS v, max(l_tax) AS t FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 11 <> 0 GROUP BY 1),
n AS (SELECT l_suppkey, max(l_quantity) AS q, max(l_discount) AS v, max(l_tax) AS t FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
r AS (SELECT l_suppkey, max(l_extendedprice) / 90000 AS rec, CASE l_suppkey % 3 WHEN 0 THEN 'beam' WHEN 1 THEN 'col' ELSE 'brace' END AS kind,
  CASE WHEN l_suppkey % 7 = 0 THEN 1.25 ELSE 1.1 END AS gamma FROM lineitem GROUP BY l_suppkey),
g AS (SELECT n.l_suppkey, r.kind, rec, gamma, b.l_suppkey IS NULL AS none, n.q / b.q AS up, CASE WHEN b.q > 1e-9 THEN n.q / b.q END AS f1,
  CASE WHEN kind = 'beam' AND b.v > 1e-9 THEN n.v / b.v WHEN kind <> 'beam' AND b.t > 1e-9 THEN n.t / b.t END AS f2, rec / (1 + 0.01 * (n.l_suppkey % 5)) AS e0
  FROM n LEFT JOIN b USING (l_suppkey) JOIN r ON n.l_suppkey = r.l_suppkey),
e AS (SELECT *, NOT none AND abs(e0 - rec) <= greatest(0.02, 0.03 * rec) AS exact, greatest(1.0, f1, f2) AS best FROM g)
SELECT l_suppkey, CASE WHEN exact THEN 'exact' ELSE 'scaled' END AS method, round(CASE WHEN exact THEN up * rec / 1.1 WHEN none THEN rec / gamma ELSE rec / gamma * best END, 6) AS dc,
  round(CASE WHEN exact THEN rec / 1.1 ELSE rec / gamma END, 6) AS dc_base,
  CASE WHEN exact THEN 'recorded strengths' WHEN none THEN 'no base' WHEN best = 1 THEN 'unchanged' WHEN f1 = best THEN CASE kind WHEN 'beam' THEN 'Mz' ELSE 'comp' END ELSE CASE kind WHEN 'beam' THEN 'V' ELSE 'tens' END END AS driver FROM e""")
def dc_scaled_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Members by the exact check where it meets what was recorded, else scaled by the growth of their demands."""
    x = table(spark, d, "lineitem").withColumn("id", F.col("l_suppkey").cast("string"))
    beam, none = F.col("l_suppkey") % 3 == 0, F.lit(0.0)
    of = lambda rows: rows.groupBy("id", "l_suppkey").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("v"), F.max("l_tax").alias("t")).select("id", "l_suppkey", "q", F.when(beam, none).otherwise(F.col("q")).alias("comp"), F.when(beam, none).otherwise(F.col("t")).alias("tens"), F.when(beam, F.col("q")).otherwise(none).alias("Mz"), none.alias("My"), F.col("v").alias("V"))
    base, new = of(x.where("l_returnflag = 'A' and l_suppkey % 11 <> 0")), of(x.where("l_returnflag = 'N'"))
    kind = F.when(beam, "beam").when(F.col("l_suppkey") % 3 == 1, "col").otherwise("brace")
    recorded = x.groupBy("id", "l_suppkey").agg((F.max("l_extendedprice") / 90000).alias("dc")).join(base.select("id", "q"), "id", "left")
    strength = F.create_map(F.when(beam, "Mdz").otherwise("compression"), F.create_map(F.when(beam, "Md_Nmm").otherwise("Pd_N"), F.col("q") / F.col("dc") * (1 + 0.01 * (F.col("l_suppkey") % 5))))
    members = recorded.select("id", kind.alias("kind"), F.when(F.col("l_suppkey") % 7 == 0, "net section rupture 6.3.1").otherwise("member check").alias("limit_state"), "dc", C.flat(strength).alias("capacity"))
    r = C.member_ratios(members, base, new)
    return r.select(F.col("id").cast("long").alias("l_suppkey"), "method", F.round("dc", 6).alias("dc"), F.round("dc_base", 6).alias("dc_base"), "driver")

"""Study statistics: description, fits, goodness of fit, histograms and rank correlation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.operators.ordered import quantiles, ranks, with_group
from ferrule.shared import stored

#: Fixed value: below this share of the mean a spread counts as none.
INVARIANT = 1e-7


def describe(df: DataFrame, by: list[str], x: str, limit: float, base: str | None = None) -> DataFrame:
    """n, mean, sample std, cov (std over mean), median, min, max, p5, p95, skewness (third moment over the cubed sample std), the
    95 % interval of the mean (null for one value), the share over ``limit`` and whether the values do not vary, by group; where all
    are above zero and vary, also the share over ``limit`` and p95 of the fitted lognormal. Nulls and NaN are left out.

    ``base``, a column that is the same in a group, adds itself, mean and p95 over it, and the share of values over it.
    """
    v = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select(*by, F.col(x).cast("double").alias("x"), *([F.col(base).cast("double").alias("base")] if base else []))
    extra = [F.max("base").alias("base"), F.avg((F.col("x") > F.col("base")).cast("double")).alias("p_over_base")] if base else []
    basic = v.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("s"), F.stddev_pop("x").alias("sp"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.avg((F.col("x") > limit).cast("double")).alias("p_over"), F.avg(F.when(F.col("x") > 0, F.log("x"))).alias("mu"), F.stddev_samp(F.when(F.col("x") > 0, F.log("x"))).alias("sigma"), *extra,
    )
    third = v.join(basic.select(*by, "mean"), by).groupBy(*by).agg(F.avg(F.pow(F.col("x") - F.col("mean"), 3)).alias("m3"))
    still = F.coalesce(F.col("sp") <= INVARIANT * F.greatest(F.abs("mean"), F.lit(1e-12)), F.lit(True))
    std = F.when(still, F.lit(0.0)).otherwise(F.col("s"))
    skew = F.when((F.col("n") <= 2) | (std == 0), F.lit(0.0)).otherwise(F.col("m3") / F.pow(std, 3))
    half = F.when(F.col("n") > 1, 1.96 * std / F.sqrt("n"))
    fits = (F.col("min") > 0) & (std > 0)
    beyond = 1 - normal_cdf(F.try_divide(F.lit(math.log(limit)) - F.col("mu"), F.col("sigma"))) if limit > 0 else F.lit(1.0)
    marks = quantiles(v, by, "x", {"median": 0.5, "p5": 0.05, "p95": 0.95})
    against = [F.col("base"), F.when(F.col("base") != 0, F.col("mean") / F.col("base")).alias("ratio_mean"), F.col("p_over_base"), F.when(F.col("base") != 0, F.col("p95") / F.col("base")).alias("p95_over_base")] if base else []
    return basic.join(third, by).join(marks, by).select(
        *by, "n", "mean", std.alias("std"), F.when(F.col("mean") != 0, std / F.col("mean")).alias("cov"), "median", "min", "max", "p5", "p95", skew.alias("skewness"), (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"),
        "p_over", F.when(fits, beyond).alias("p_over_lognormal"), F.when(fits, F.exp(F.col("mu") + 1.645 * F.col("sigma"))).alias("p95_lognormal"), still.alias("invariant"), *against,
    )


def lognormal_fit(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """mu and sigma of ln x, and the median, mean and cov they imply; groups with a value of 0 or less have none."""
    fit = df.groupBy(*by).agg(F.min(x).alias("least"), F.avg(F.when(F.col(x) > 0, F.log(x))).alias("mu"), F.stddev_samp(F.when(F.col(x) > 0, F.log(x))).alias("sigma")).where("least > 0")
    s2 = F.pow("sigma", 2)
    return fit.select(*by, "mu", "sigma", F.exp("mu").alias("median"), F.exp(F.col("mu") + s2 / 2).alias("mean"), F.sqrt(F.exp(s2) - 1).alias("cov"))


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), na_action="ignore")


def ks(df: DataFrame, by: list[str], x: str, cdf: Column, fits: DataFrame | None = None) -> DataFrame:
    """Kolmogorov-Smirnov distance of ``x`` from ``cdf`` and its asymptotic p by group; null under three values.

    ``fits`` has one row a group with what else ``cdf`` reads; groups without one are left out. It meets the rows after they are
    ranked, in the order that this has given them, so they are sorted once.
    """
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n"))
    rows = ranks(df, by, x, [], "__i").join(sizes if fits is None else fits.join(sizes, by), by).withColumn("__f", cdf)
    d = F.max(F.greatest(F.col("__i") / F.col("__n") - F.col("__f"), F.col("__f") - (F.col("__i") - 1) / F.col("__n")))
    got = rows.groupBy(*by).agg(F.count("*").alias("n"), d.alias("d"))
    lam = (F.sqrt("n") + 0.12 + 0.11 / F.sqrt("n")) * F.col("d")
    term = lambda k, v: F.when(k % 2 == 1, 1).otherwise(-1) * F.exp(-2.0 * k * k * v * v)
    p = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + term(k, F.col("lam")))
    out = got.withColumn("lam", lam).withColumn("p", F.when(F.col("lam") < 1e-9, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * p))))
    return out.select(*by, "n", F.when(F.col("n") >= 3, F.col("d")).alias("d"), F.when(F.col("n") >= 3, F.col("p")).alias("p"))


def histogram(df: DataFrame, by: list[str], x: str, marks: list[Column] | None = None) -> DataFrame:
    """``(*by, bin, low, high, n)``, empty bins included: Freedman-Diaconis width where the quartiles differ and there
    are eight values, else the root of n; 6 to 24 bins. The range is widened to ``marks``, which are the same in a group, and then
    by 4 %, of 0.1 where it is nothing."""
    seen = F.count("*").alias("c"), F.min(x).alias("least"), F.max(x).alias("most"), *[F.max(m.cast("double")).alias(f"__m{i}") for i, m in enumerate(marks or [])]
    a = df.groupBy(*by).agg(*seen).join(quantiles(df, by, x, {"q1": 0.25, "q3": 0.75}), by).withColumn("iqr", F.col("q3") - F.col("q1"))
    fd = F.ceil((F.col("most") - F.col("least")) / (2 * F.col("iqr") / F.pow(F.col("c").cast("double"), 1 / 3)))
    k = F.when((F.col("iqr") > 0) & (F.col("c") >= 8), fd).otherwise(F.ceil(F.sqrt("c")))
    own = [F.col(f"__m{i}") for i in range(len(marks or []))]
    a = a.withColumns({"lo": F.least("least", "least", *own), "hi": F.greatest("most", "most", *own)})
    pad = 0.04 * F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(0.1)
    a = stored(a.select(*by, F.least(F.greatest(k, F.lit(6)), F.lit(24)).cast("long").alias("k"), (F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi")), "bins-")
    width = (F.col("hi") - F.col("lo")) / F.col("k")
    at = F.least(F.floor((F.col(x) - F.col("lo")) / width), F.col("k") - 1)
    counts = with_group(df, a, by).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))
    bins = a.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("bin"))
    return bins.join(counts, [*by, "bin"], "left").select(*by, "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def spearman(df: DataFrame, by: list[str], a: str, b: str, ties: list[str]) -> DataFrame:
    """Rank correlation over ordinal ranks, ties settled by ``ties``; null under four rows or where a side is constant."""
    rows = ranks(ranks(df, by, a, ties, "__a"), by, b, ties, "__b")
    got = rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr("__a", "__b").alias("r"), (F.min(a) < F.max(a)).alias("va"), (F.min(b) < F.max(b)).alias("vb"))
    return got.select(*by, "n", F.when((F.col("n") >= 4) & F.col("va") & F.col("vb"), F.col("r")).alias("rho"))

"""Study operators held against fixture values: a small design with recorded strengths, and plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.operators import capacity, ordered, statistics

#: Four members (kind, comp, tens, Mz, My, V), their recorded strengths and ratios, and three connections.
MEMBERS = [
    ("floor", "beam", (0.0, 0.0, 303750000.0, 0.0, 218962.9), {"Mdz_section": {"Md_Nmm": 338636363.6}, "shear_z": {"Vd_N": 445766.9}}, 0.897),
    ("gravity_col", "col", (1100000.0, 0.0, 22000000.0, 6000000.0, 5000.0), {"compression": {"Pd_N": 2085792.8}, "Mdz_section": {"Md_Nmm": 284090909.1}, "Mdy": {"Md_Nmm": 95454545.5}}, 0.668),
    ("lateral_col", "col", (593800.0, 236600.0, 190000000.0, 77000000.0, 197500.0), {"compression": {"Pd_N": 3244222.4}}, 0.183),
    ("brace", "brace", (422114.0, 600000.0, 0.0, 0.0, 0.0), {"compression": {"Pd_N": 844228.0}, "tension": {"Td_N": 2115909.1}}, 0.5),
]
STATE = "IS 800:2007 7-9 (member_check_is800)"
CONNECTIONS = [
    ("conn-gravity-beam-col", "beam-to-column", ["V_N"], "beam-end shear connection: bolts_10_3 (IS 800:2007 10.3.2)", 0.9),
    ("conn-SMF-joint", "moment connection (IS 800 12.11.2) + panel zone", ["M_1_2Mp_Nmm", "V_overstrength_N"], "panel-zone shear 12.11.2.3 (yield, gamma_m0)", 0.792),
    ("conn-SMF-col-base", "column base plate (fixed)", ["P_N", "V_N"], "base plate bending 8.2 / anchor bolts 10.3", 0.89),
]
HANDLES = {"beam_V": 218962.9, "beam_M": 303750000.0, "gravity_beam_V": 218962.9, "col_P": 1100000.0, "col_T": 236600.0, "col_M": 190000000.0, "col_V": 197500.0, "brace_P": 600000.0, "V_base": 1657800.0}
Q = ["comp", "tens", "Mz", "My", "V"]


def design(spark):
    rows = [(i, k, STATE, dc, {a: {b: float(v) for b, v in m.items()} for a, m in c.items()}) for i, k, _, c, dc in MEMBERS]
    members = spark.createDataFrame(rows, "id string, kind string, limit_state string, dc double, c map<string,map<string,double>>").withColumn("capacity", capacity.flat(F.col("c"))).drop("c")
    return members, spark.createDataFrame([(i, *d) for i, _, d, _, _ in MEMBERS], "id string, comp double, tens double, Mz double, My double, V double")


def test_members_exact_scaled_and_bases(spark):
    members, base = design(spark)
    one = {r.id: r for r in capacity.member_ratios(members, base, base, "design").collect()}
    assert [one[k].method for k in ("floor", "gravity_col", "lateral_col", "brace")] == ["exact", "exact", "scaled", "exact"]
    assert {k: r.dc for k, r in one.items()} == pytest.approx({"floor": 0.897, "gravity_col": 0.668, "lateral_col": 0.183, "brace": 0.5})
    nominal = {r.id: r for r in capacity.member_ratios(members, base, base).collect()}
    assert nominal["floor"].dc == pytest.approx(0.897 / 1.1) and nominal["floor"].dc_recorded == 0.897
    assert nominal["lateral_col"].dc == pytest.approx(0.183 / 1.1) and nominal["lateral_col"].factor == 1.1
    up = base.select("id", *[(F.col(c) * k).alias(c) for c, k in (("comp", 1.1), ("tens", 1.0), ("Mz", 1.1), ("My", 1.1), ("V", 1.05))])
    more = {r.id: r for r in capacity.member_ratios(members, base, up, "design").collect()}
    assert more["floor"].dc == pytest.approx(0.897 * 1.1, rel=1e-3) and more["lateral_col"].dc == pytest.approx(0.183 * 1.1, rel=1e-3) and more["gravity_col"].dc > 0.668 * 1.09
    assert more["lateral_col"].driver == "comp"
    less = {r.id: r.dc for r in capacity.member_ratios(members, base.limit(0), up, "design").collect()}
    assert less == pytest.approx({i: dc for i, _, _, _, dc in MEMBERS})  # no base: as recorded


def test_capacity_ratio(spark):
    cases = [
        ("col", dict(tens=50, Mz=80), dict(Pd=100, Td=100, Mdz=100), 1.3),  # bending counts with tension
        ("col", dict(comp=50), dict(Pd=100), 0.5),  # no bending, so its strength is not needed
        ("col", dict(comp=50, Mz=1), dict(Pd=100), None),
        ("col", dict(comp=50), dict(), None),
        ("beam", dict(Mz=50, My=1e-7), dict(Mdz=100), 0.5),  # dust
        ("beam", dict(Mz=50, My=1), dict(Mdz=100), None),
        ("beam", dict(Mz=50, My=10, comp=20), dict(Mdz=100, Mdy=50, Pd=40), 1.2),
        ("beam", dict(), dict(Mdz=100), None),
        ("brace", dict(comp=50, tens=80), dict(Pd=100), 0.5),
        ("brace", dict(tens=80), dict(Pd=100), 0.8),
        ("brace", dict(comp=50, tens=80), dict(Pd=100, Td=100), 0.8),
        ("beam", dict(V=5, Mz=50), dict(Vd=5, Mdz=0), 1.0),  # a strength of zero is none
    ]
    rows = [(i, k, {a: float(v) for a, v in d.items()}, {a: float(v) for a, v in c.items()}) for i, (k, d, c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, kind string, d map<string,double>, c map<string,double>")
    r = capacity.capacity_ratio(F.col("kind"), {q: F.col("d")[q] for q in Q}, {q: F.col("c")[q] for q in capacity.STRENGTHS})
    got = [x.r for x in df.select("i", r.alias("r")).orderBy("i").collect()]
    assert got == [None if w is None else pytest.approx(w) for *_, w in cases]
    beam, cc = MEMBERS[0], MEMBERS[1]
    df = spark.createDataFrame([(k, *d, {a: {b: float(v) for b, v in m.items()} for a, m in c.items()}) for _, k, d, c, _ in (beam, cc)], "kind string, comp double, tens double, Mz double, My double, V double, c map<string,map<string,double>>").withColumn("e", capacity.flat(F.col("c")))
    of, have = {q: F.col(q) for q in Q}, capacity.strengths(F.col("e"))
    got = df.select(capacity.capacity_ratio(F.col("kind"), of, have).alias("a"), capacity.capacity_ratio(F.col("kind"), of, capacity.in_basis(have, "nominal")).alias("b")).collect()
    assert got[0].a == pytest.approx(0.897, abs=0.001) and got[0].b == pytest.approx(0.897 / 1.1, abs=0.001) and got[1].a == pytest.approx(0.668, abs=0.005)


def test_partial_factors(spark):
    df = spark.createDataFrame([(STATE, None), ("net section rupture 6.3.1", None), ("site weld 10.5", "moment"), (None, None)], "s string, k string")
    assert [tuple(r) for r in df.select(capacity.gamma_member(F.col("s")), capacity.gamma_connection(F.col("s"), F.col("k"))).collect()] == [(1.1, 1.25), (1.25, 1.25), (1.1, 1.5), (1.1, 1.25)]


def test_connections_follow_their_handles(spark):
    def ratios(now, basis):
        df = spark.createDataFrame([(*c, HANDLES, now) for c in CONNECTIONS], "id string, type string, demands array<string>, state string, dc double, was map<string,double>, now map<string,double>")
        c = capacity.connection_ratio(F.col("id"), F.col("type"), F.col("state"), F.lit(None).cast("string"), F.col("dc"), F.col("demands"), F.col("was"), F.col("now"), basis)
        return {r.id: r.c for r in df.select("id", c.alias("c")).collect()}

    d = ratios(HANDLES, "design")
    assert [(m.key, m.handle) for k in ("conn-gravity-beam-col", "conn-SMF-joint", "conn-SMF-col-base") for m in d[k].mapped] == [("V_N", "gravity_beam_V"), ("M_1_2Mp_Nmm", "fixed"), ("V_overstrength_N", "fixed"), ("P_N", "col_P"), ("V_N", "V_base")]
    n = ratios(HANDLES, "nominal")
    assert {k: v.factor for k, v in n.items()} == {"conn-gravity-beam-col": 1.25, "conn-SMF-joint": 1.1, "conn-SMF-col-base": 1.25}
    assert n["conn-gravity-beam-col"].dc == pytest.approx(0.9 / 1.25)
    u = ratios(HANDLES | {"V_base": HANDLES["V_base"] * 1.2, "gravity_beam_V": HANDLES["gravity_beam_V"] * 1.05}, "design")
    assert {k: v.dc for k, v in u.items()} == pytest.approx({"conn-gravity-beam-col": 0.9 * 1.05, "conn-SMF-joint": 0.792, "conn-SMF-col-base": 0.89 * 1.2})


def samples():
    rng = np.random.default_rng(7)
    return {"ln": rng.lognormal(0.0, 0.2, 40), "neg": rng.normal(-3, 1, 30), "same": np.full(9, 2.5), "one": np.array([4.0]), "two": np.array([1.0, 2.0])}


def test_describe_against_numpy(spark):
    data = samples()
    df = spark.createDataFrame([(k, float(v), 1.1) for k, x in data.items() for v in x], "g string, x double, b double")
    got = {r.g: r for r in statistics.describe(df, ["g"], "x", 1.0, "b").collect()}
    for k, x in data.items():
        still = x.std() <= 1e-7 * abs(x.mean())
        mean, std = x.mean(), 0.0 if still or len(x) < 2 else x.std(ddof=1)
        want = {"n": len(x), "mean": mean, "std": std, "cov": std / mean, "median": np.median(x), "min": x.min(), "max": x.max(), "p5": np.percentile(x, 5), "p95": np.percentile(x, 95), "p_over": (x > 1).mean(), "base": 1.1, "ratio_mean": mean / 1.1, "p_over_base": (x > 1.1).mean(), "p95_over_base": np.percentile(x, 95) / 1.1}
        want["skewness"] = ((x - mean) ** 3).mean() / std**3 if std > 0 and len(x) > 2 else 0.0
        if len(x) > 1:
            want |= {"ci_low": mean - 1.96 * std / math.sqrt(len(x)), "ci_high": mean + 1.96 * std / math.sqrt(len(x))}
        if x.min() > 0 and std > 0:
            mu, s = np.log(x).mean(), np.log(x).std(ddof=1)
            want |= {"p_over_lognormal": 1 - 0.5 * math.erfc(mu / s / math.sqrt(2)), "p95_lognormal": math.exp(mu + 1.645 * s)}
        row = got[k].asDict()
        assert row.pop("g") == k and row.pop("invariant") == (std == 0)
        assert {a: v for a, v in row.items() if v is not None} == pytest.approx(want), k


def test_histogram_against_numpy(spark):
    data = samples()
    for marks in ([], [0.2, 9.0]):
        df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x], "g string, x double")
        got = statistics.histogram(df, ["g"], "x", [F.lit(m) for m in marks]).orderBy("g", "bin").collect()
        for k, x in data.items():
            iqr = np.subtract(*np.percentile(x, [75, 25]))
            n = math.ceil((x.max() - x.min()) / (2 * iqr / len(x) ** (1 / 3))) if iqr > 0 and len(x) >= 8 else math.ceil(math.sqrt(len(x)))
            lo, hi = min([x.min(), *marks]), max([x.max(), *marks])
            pad = 0.04 * (hi - lo or 0.1)
            edges = np.linspace(lo - pad, hi + pad, max(6, min(24, n)) + 1)
            own = [r for r in got if r.g == k]
            assert [r.n for r in own] == np.histogram(x, edges)[0].tolist(), (k, marks)
            assert [r.low for r in own] + [own[-1].high] == pytest.approx(edges.tolist())


def test_large_groups_give_what_small_ones_do(spark, monkeypatch):
    rows = [(g, (i * 7919) % 1009 / 3 if i % 50 else None, i) for g, n in (("a", 900), ("b", 7), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, x double, i int")
    shares = {"q1": 0.25, "m": 0.5, "p": 0.95}
    small = (sorted(map(str, ordered.ranks(df, ["g"], "x", ["i"], "r").collect())), sorted(map(str, ordered.quantiles(df, ["g"], "x", shares).select("g", *[F.round(k, 9).alias(k) for k in shares]).collect())))
    monkeypatch.setattr(ordered, "GROUP_ROWS", 100)
    large = (sorted(map(str, ordered.ranks(df, ["g"], "x", ["i"], "r").collect())), sorted(map(str, ordered.quantiles(df, ["g"], "x", shares).select("g", *[F.round(k, 9).alias(k) for k in shares]).collect())))
    assert small == large
    for by in ([], ["g"]):
        a = ordered.quantiles(df.where("g = 'a'"), by, "x", shares).first()
        monkeypatch.setattr(ordered, "GROUP_ROWS", 1 << 20)
        b = ordered.quantiles(df.where("g = 'a'"), by, "x", shares).first()
        assert [a[k] for k in shares] == pytest.approx([b[k] for k in shares])
        monkeypatch.setattr(ordered, "GROUP_ROWS", 100)


def test_nearest_in_band_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(g, k, float(v)) for g in range(3) for k, v in enumerate(rng.integers(0, 60, 80 if g else 200) / 4)]
    got = sorted(tuple(r) for r in ordered.nearest_in_band(spark.createDataFrame(rows, "g int, k int, y double"), ["g"], "y", "k", 1.5, 4).collect())
    want = []
    for g, k, y in rows:
        near = sorted((abs(y - v), o) for h, o, v in rows if h == g and o != k and abs(y - v) < 1.5)[:4]
        want += [(g, k, o, i + 1) for i, (_, o) in enumerate(near)]
    assert got == sorted(want)


def test_lines_that_cross_the_gutter_stay_whole():
    page = "A title that runs across the whole of the page\nleft one           right one\nleft two           right two\nleft three         right three\n" + "\n".join(f"left {i}             right {i}" for i in range(9))
    got = X.linear_of(page).split("\n")
    assert got[0] == "A title that runs across the whole of the page" and got[1:4] == ["left one", "left two", "left three"] and got[13:16] == ["right one", "right two", "right three"]

"""Demand over capacity of members and connections: partial factors, exact checks, scaling by growth of demand, and which applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators.retrieval import bound

#: Partial factors by what a limit state or a connection names, the first that matches; and the one for the rest.
GAMMA_RUPTURE, GAMMA_YIELD = 1.25, 1.10
RUPTURE, NO_RUPTURE = r"rupture|net section|6\.3\.1", r"7\.1|8\.2|9\.3|interaction|buckl"
GAMMA_CONNECTION = [
    (r"site weld|field weld|welded on site", 1.50),
    (r"bolt|weld|block shear|rupture|bearing|anchor|net section|fillet|fin plate|shear tab|single-plate|10\.3|10\.4|10\.5|6\.3|6\.4", 1.25),
    (r"panel|yield|cjp|complete penetration|base plate|plate bending|develops|8\.2|8\.4|12\.11", 1.10),
]
#: Strength -> the names under which a package records it, in order.
STRENGTHS = {
    "Pd": [r"compression\.Pd_N", r"Pd_N", r"compression\.Pd(y|z)_N"],
    "Td": [r"tension\.Td_N", r"Td_N", r"tension\.Tdg_N"],
    "Mdz": [r"Mdz\.Md_Nmm", r"Mdz_ltb\.Md_Nmm", r"Mdz_section\.Md_Nmm", r"Mdz_Nmm"],
    "Mdy": [r"Mdy\.Md_Nmm", r"Mdy_section\.Md_Nmm", r"Mdy_Nmm"],
    "Vd": [r"shear_z\.Vd_N", r"Vd_N", r"shear\.Vd_N"],
}
#: The demands that size a kind of member, in order, and those of any other kind.
SIZED_BY, SIZED_ELSE = {"beam": ["Mz", "V", "My"], "col": ["comp", "Mz", "My", "tens"], "brace": ["comp", "tens"]}, ["comp", "Mz"]
#: Demands that capacity design fixes, which do not grow.
FIXED_DEMAND = r"mpr|^vh(_|$)|expected|^ry|omega|om0|1p2mp|1[._]2\s*_?mp|capacity_design|overstrength|12_2_3|12\.2\.3|18168|_basis$"
COLUMN_LIKE = r"base|anchor|splice|^(?!.*beam).*col"
#: The handle that a demand follows, by what the connection is and what the demand is called; the first that matches.
HANDLES = [
    (r"brace|gusset", r"", "brace_P"),
    (r"collector|drag", r"", "V_base"),
    (r"", r"fpx", "V_base"),
    (COLUMN_LIKE, r"^(?=p|.*axial).*tens", "col_T"),
    (COLUMN_LIKE, r"^p|axial", "col_P"),
    (r"base", r"^v", "V_base"),
    (COLUMN_LIKE, r"^v", "col_V"),
    (COLUMN_LIKE, r"^m", "col_M"),
    (COLUMN_LIKE, r"", None),
    (r"gravity|shear|simple", r"^v", "gravity_beam_V"),
    (r"", r"^v", "beam_V"),
    (r"", r"^m", "beam_M"),
    (r"", r"^p|axial", "col_P"),
]
DUST, BASE_LEAST, MEETS = 1e-6, 1e-9, (0.02, 0.03)


def _text(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def gamma_member(limit_state: Column) -> Column:
    """The partial factor behind a member's recorded ratio."""
    t = F.coalesce(F.lower(limit_state), F.lit(""))
    return F.when(t.rlike(RUPTURE) & ~t.rlike(NO_RUPTURE), GAMMA_RUPTURE).otherwise(GAMMA_YIELD)


def gamma_connection(limit_state: Column, kind: Column) -> Column:
    """The partial factor behind a connection's recorded ratio."""
    t = _text(limit_state, kind)
    return F.coalesce(*[F.when(t.rlike(p), F.lit(g)) for p, g in GAMMA_CONNECTION], F.lit(GAMMA_RUPTURE))


def flat(nested: Column) -> Column:
    """``map<string, map<string, v>>`` as entries named ``outer.inner``."""
    return F.flatten(F.transform(F.map_entries(nested), lambda o: F.transform(F.map_entries(o["value"]), lambda i: F.struct(F.concat_ws(".", o["key"], i["key"]).alias("key"), i["value"].alias("value")))))


def strengths(capacity: Column) -> dict[str, Column]:
    """The recorded strengths, null where there is none above zero, from entries (key, value)."""
    named = lambda p: F.get(F.filter(capacity, lambda e: F.replace(e["key"], F.lit(" ")).rlike(f"(?i)^(?:{p})$") & (e["value"] > 0)), F.lit(0))["value"]
    return {k: F.coalesce(*map(named, patterns)) for k, patterns in STRENGTHS.items()}


def in_basis(c: dict[str, Column], basis: str) -> dict[str, Column]:
    """Design strengths as recorded, or nominal ones with the partial factor taken out (M1)."""
    return {k: v * GAMMA_YIELD for k, v in c.items()} if basis == "nominal" else c


def capacity_ratio(kind: Column, d: dict[str, Column], c: dict[str, Column]) -> Column:
    """Demand over capacity by kind of member (M1).

    Demands under a millionth of the largest are dust and count as zero. A beam takes the largest of bending, shear, weak
    bending and, with axial force, the interaction; a brace compression or tension, which falls back to the compressive
    strength only without compression; any other member is a column: the interaction in compression, in tension, and shear.
    Null where a strength that is needed is missing, or nothing is demanded of a beam or brace.
    """
    q = {k: F.coalesce(d[k].cast("double"), F.lit(0.0)) for k in ("comp", "tens", "Mz", "My", "V")}
    have = {k: F.nullif(v.cast("double"), F.lit(0.0)) for k, v in c.items()}
    whole = F.struct(*[v.alias(k) for k, v in q.items()], *[v.alias(k) for k, v in have.items()])

    def clean(x: Column) -> Column:
        least = DUST * F.greatest(*[x[k] for k in q], F.lit(BASE_LEAST))
        return F.struct(*[F.when(F.abs(x[k]) < least, 0.0).otherwise(x[k]).alias(k) for k in q], *[x[k].alias(k) for k in have])

    def ratio(x: Column) -> Column:
        part = lambda a, b: F.when(x[a] != 0, x[a] / x[b])  # noqa: E731  null where nothing is demanded or no strength is known
        needed = lambda a, b: F.when(x[a] != 0, x[a] / x[b]).otherwise(F.lit(0.0))  # noqa: E731  null only where the strength is missing
        bending = needed("Mz", "Mdz") + needed("My", "Mdy")
        sure = F.coalesce(part("Mz", "Mdz"), F.lit(0.0)) + F.coalesce(part("My", "Mdy"), F.lit(0.0))
        beam = F.when((x["My"] == 0) | x["Mdy"].isNotNull(), F.greatest(part("Mz", "Mdz"), part("V", "Vd"), part("My", "Mdy"), F.when(x["Mdz"].isNotNull(), part("comp", "Pd") + sure)))
        brace = F.greatest(part("comp", "Pd"), F.when(x["Td"].isNotNull(), part("tens", "Td")).when(x["comp"] == 0, part("tens", "Pd")), F.lit(None).cast("double"))
        total = F.when(x["Pd"].isNotNull(), x["comp"] / x["Pd"] + bending)
        column = F.when(total.isNotNull(), F.greatest(total, part("tens", "Td") + sure, part("V", "Vd")))
        return F.when(kind == "beam", beam).when(kind == "brace", brace).otherwise(column)

    return bound(bound(whole, clean), ratio)


def growth(kind: Column, base: dict[str, Column], new: dict[str, Column]) -> Column:
    """``struct(factor, driver)``: the largest growth among the demands that size the kind, 1 at least, and the first that has it;
    demands that were nothing do not count (M2)."""
    grown = {k: F.when(F.coalesce(base[k], F.lit(0.0)) > BASE_LEAST, F.coalesce(new[k], F.lit(0.0)) / base[k]) for k in base}

    def largest(keys: list[str]) -> Column:
        best = F.struct(F.lit(1.0).alias("factor"), F.lit("unchanged").alias("driver"))
        for k in [k for k in keys if k in grown]:
            best = F.when(grown[k] > best["factor"], F.struct(grown[k].cast("double").alias("factor"), F.lit(k).alias("driver"))).otherwise(best)
        return best

    out = largest(SIZED_ELSE)
    for name, keys in SIZED_BY.items():
        out = F.when(kind == name, largest(keys)).otherwise(out)
    return out


QUANTITIES = ["comp", "tens", "Mz", "My", "V"]


def member_ratios(members: DataFrame, base: DataFrame, new: DataFrame, basis: str = "nominal", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """``(*keys of new, dc, dc_base, dc_recorded, method, driver, factor)`` of every member that ``new`` has demands for.

    ``members(id, kind, limit_state, dc, capacity array<struct<key,value>>)``; ``base(id, demands)``, those the recorded ratio
    stands for; ``new(*keys, demands)``, with ``id`` among the keys. The exact check counts where it meets the recorded ratio
    on the base demands within 0.02 or 3 %; else the recorded ratio grows with the demands; without base demands it stays.
    """
    m = members.where(F.col("dc").isNotNull()).select("id", "kind", "limit_state", F.col("dc").alias("dc_recorded"), F.struct(*[v.alias(k) for k, v in strengths(F.col("capacity")).items()]).alias("c"))
    b = base.select("id", F.struct(*QUANTITIES).alias("b"))
    rows = new.select(*keys, F.struct(*QUANTITIES).alias("n")).join(m, "id").join(b, "id", "left")
    c = {k: F.col("c")[k] for k in STRENGTHS}
    of = lambda s: {k: F.col(s)[k] for k in QUANTITIES}
    kind = F.col("kind")
    rows = rows.withColumns({"e0": capacity_ratio(kind, of("b"), c), "e0b": capacity_ratio(kind, of("b"), in_basis(c, basis)), "e1b": capacity_ratio(kind, of("n"), in_basis(c, basis)), "g": growth(kind, of("b"), of("n"))})
    near = F.col("b").isNotNull() & (F.abs(F.col("e0") - F.col("dc_recorded")) <= F.greatest(F.lit(MEETS[0]), MEETS[1] * F.col("dc_recorded"))) & F.col("e0b").isNotNull() & F.col("e1b").isNotNull()
    rows = rows.withColumn("exact", F.coalesce(near, F.lit(False)))
    scale = F.col("dc_recorded") / F.col("e0")
    plain = F.col("dc_recorded") / (gamma_member(F.col("limit_state")) if basis == "nominal" else F.lit(1.0))
    dc = F.when(F.col("exact"), F.col("e1b") * scale).when(F.col("b").isNull(), plain).otherwise(plain * F.col("g.factor"))
    driver = F.when(F.col("exact"), "recorded strengths").when(F.col("b").isNull(), "no base").otherwise(F.col("g.driver"))
    return rows.select(*keys, dc.alias("dc"), F.when(F.col("exact"), F.col("e0b") * scale).otherwise(plain).alias("dc_base"), "dc_recorded", F.when(F.col("exact"), "exact").otherwise("scaled").alias("method"), driver.alias("driver"), F.when(~F.col("exact"), gamma_member(F.col("limit_state"))).alias("factor"))


def handle_of(text: Column, key: Column) -> Column:
    """The handle that a demand of a connection follows, ``fixed`` where capacity design fixes it, null if none."""
    k = F.lower(key)
    out = F.when(k.rlike(FIXED_DEMAND), "fixed")
    for what, called, handle in HANDLES:
        out = out.when(text.rlike(what) & k.rlike(called), F.lit(handle).cast("string"))
    return out


def connection_ratio(ident: Column, kind: Column, limit_state: Column, section: Column, dc: Column, demands: Column, base: Column, new: Column, basis: str = "nominal") -> Column:
    """``struct(dc, dc_base, factor, growth, mapped array<struct<key,handle>>)`` of a connection.

    ``demands`` is the array of its demands' names, ``base`` and ``new`` map handles to values. The recorded ratio grows with the
    handle that grows most, 1 at least; fixed demands stay, and a handle that was nothing does not count.
    """
    text = _text(ident, kind, limit_state, section)
    was = lambda h: F.coalesce(F.try_element_at(base, h), F.lit(0.0))
    all_ = F.transform(demands, lambda k: F.struct(k.alias("key"), handle_of(text, k).alias("handle")))
    mapped = F.filter(all_, lambda m: (m["handle"] == "fixed") | (was(m["handle"]) > BASE_LEAST))
    grew = F.array_max(F.transform(F.filter(mapped, lambda m: m["handle"] != "fixed"), lambda m: F.coalesce(F.try_element_at(new, m["handle"]), F.lit(0.0)) / was(m["handle"])))
    factor = gamma_connection(limit_state, kind)
    own = dc / (factor if basis == "nominal" else F.lit(1.0))
    up = F.greatest(F.lit(1.0), grew)
    return F.struct((own * up).alias("dc"), own.alias("dc_base"), factor.alias("factor"), up.alias("growth"), mapped.alias("mapped"))

"""Scoring: a user-typed expression compiled to a Column, eligibility with reasons, rankings and round-robin plans.

The expression is parsed by Python's own parser and walked over a fixed list of node kinds; nothing is evaluated as code.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators.ordered import ranks

#: Functions that an expression may call.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "min": lambda *x: F.least(*x), "max": lambda *x: F.greatest(*x), "abs": F.abs, "exp": F.exp,
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "log": lambda x: F.when(x > 0, F.log(x)),
}


class Rejected(ValueError):
    """An expression outside the grammar, or with a name that is no metric."""


def compile_expression(text: str, metrics: set[str], column: Callable[[str], Column] = F.col) -> tuple[Column, list[str]]:
    """The expression as a double Column, and the metrics it reads.

    Names, numbers, + - * / **, comparisons (chained too), and, or, not, if-else and the listed functions. Division by
    zero and a missing metric give null; comparisons and logic give 0 or 1.
    """
    text = text.replace("−", "-").replace("×", "*").replace("÷", "/").replace("^", "**")
    body = text.split("=", 1)[1] if text.strip().startswith(("S =", "S=")) and "==" not in text else text
    try:
        tree = ast.parse(body.strip(), mode="eval").body
    except SyntaxError as e:
        raise Rejected(str(e)) from e
    names: list[str] = []
    truth = lambda c: F.when(c, 1.0).otherwise(0.0)

    def walk(n: ast.AST) -> Column:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name):
            if n.id not in metrics:
                raise Rejected(f"unknown metric {n.id}")
            if n.id not in names:
                names.append(n.id)
            return column(n.id).cast("double")
        if isinstance(n, ast.BinOp):
            a, b = walk(n.left), walk(n.right)
            kinds = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: F.try_divide(a, b), ast.Pow: lambda: F.pow(a, b)}
            if type(n.op) in kinds:
                return kinds[type(n.op)]()
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd, ast.Not)):
            a = walk(n.operand)
            return -a if isinstance(n.op, ast.USub) else truth(a == 0) if isinstance(n.op, ast.Not) else a
        if isinstance(n, ast.BoolOp):
            parts = [walk(v) != 0 for v in n.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(n.op, ast.And) else out | p
            return truth(out)
        if isinstance(n, ast.Compare):
            sides = [walk(x) for x in (n.left, *n.comparators)]
            kinds = {ast.Lt: Column.__lt__, ast.LtE: Column.__le__, ast.Gt: Column.__gt__, ast.GtE: Column.__ge__, ast.Eq: Column.__eq__, ast.NotEq: Column.__ne__}
            if all(type(o) in kinds for o in n.ops):
                out = F.lit(True)
                for o, a, b in zip(n.ops, sides, sides[1:], strict=False):
                    out = out & kinds[type(o)](a, b)
                return truth(out)
        if isinstance(n, ast.IfExp):
            return F.when(walk(n.test) != 0, walk(n.body)).otherwise(walk(n.orelse))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in FUNCTIONS and not n.keywords and n.args:
            return FUNCTIONS[n.func.id](*map(walk, n.args))
        raise Rejected(f"not allowed: {ast.dump(n)[:60]}")

    value = walk(tree)
    some_missing = F.lit(False)
    for m in names:
        some_missing = some_missing | column(m).isNull()
    return F.when(~some_missing & ~F.isnan(value), value), names


def eligibility(rules: list[tuple[str, Column]]) -> Column:
    """The reasons that hold, in order; none means eligible. A rule whose value is missing does not hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(reason)) for reason, c in rules]))


def with_extremes(df: DataFrame, metrics: list[str], eligible: Column) -> DataFrame:
    """``<metric>_max`` and ``<metric>_min`` over the eligible rows, beside every row."""
    pick = lambda m: F.when(eligible, F.col(m))
    one = df.agg(*[F.max(pick(m)).alias(f"{m}_max") for m in metrics], *[F.min(pick(m)).alias(f"{m}_min") for m in metrics])
    return df.crossJoin(F.broadcast(one))  # one row


def ranked(df: DataFrame, score: str, position: str) -> DataFrame:
    """``rank`` from 1 for rows with a score, ties by position."""
    r = ranks(df.withColumn("__less", -F.col(score)), [], "__less", [position], "rank").drop("__less")
    return r.withColumn("rank", F.when(F.col(score).isNotNull(), F.col("rank")).cast("long"))


def round_robin(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows, one of each category in turn, numbered from 1 with ids M001 and on."""
    turn = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    first = df.withColumn("turn", turn.cast("long")).orderBy("turn", by).limit(n)
    at = F.row_number().over(Window.orderBy("turn", by))
    return first.withColumn("position", at.cast("long")).withColumn("plan_id", F.format_string("M%03d", F.col("position").cast("int")))


def relative_error(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-12))


def half_ulp(printed: Column) -> Column:
    """Half a unit in the last printed place, relative to the value."""
    places = F.length(F.regexp_extract(printed, r"\.(\d+)$", 1))
    return F.pow(F.lit(10.0), -places) / 2 / F.greatest(F.abs(printed.cast("double")), F.lit(1e-12))


def compare_printed(printed: Column, expected: Column, slack: Column | float = 0.0) -> tuple[Column, Column]:
    """A printed value against what it should be: the value that fits (as printed, ten times or a tenth of it; else null)
    and a verdict."""
    v, tol = printed.cast("double"), 0.01 + half_ulp(printed) + slack
    fits = lambda f: relative_error(v * f, expected) <= tol
    value = F.when(fits(1.0), v).when(fits(10.0), v * 10).when(fits(0.1), v * 0.1)
    return value, F.when(fits(1.0), "PASS").when(fits(10.0) | fits(0.1), "REPAIRED").otherwise("FAIL")


#: What a unit costs or earns unless a study says otherwise.
RATES = {"steel_per_t": 110000.0, "per_moment_conn": 60000.0, "per_brace": 25000.0, "revenue_per_m2": 45000.0}


def cost_metrics(steel_t: Column, n_moment_conn: Column, n_braces: Column, floor_area_m2: Column, rates: dict[str, float] | None = None) -> dict[str, Column]:
    """Cost, revenue and what is left: a missing tonnage or area gives null, a missing count nothing."""
    r = RATES | (rates or {})
    count = lambda c: F.coalesce(c, F.lit(0))
    cost = steel_t * r["steel_per_t"] + count(n_moment_conn) * r["per_moment_conn"] + count(n_braces) * r["per_brace"]
    revenue = floor_area_m2 * r["revenue_per_m2"]
    return {"modelled_cost": cost, "revenue_proxy": revenue, "net_value": revenue - cost}


def section_issues(schema: Column, designation: Column, printed: dict[str, Column]) -> Column:
    """Labels of printed values of an I or C section that its other values contradict; those off by a decimal point are no issue.

    The tolerance is that of ``compare_printed`` and the rounding of the inputs, half of it under a root. A missing value contradicts nothing.
    """
    v = {k: c.cast("double") for k, c in printed.items()}
    mass = 0.785 * v["A_cm2"]
    half = F.when(schema == "I", v["B"] / 2).otherwise(v["B"] - F.coalesce(v["Cy"], F.lit(0.0)))
    radius = lambda i: F.sqrt(v[i] * 1e4 / (v["A_cm2"] * 100))
    checks = [
        ("mass", "mass_kg_m", mass, ["A_cm2"], 1.0),
        ("rxx", "rxx", radius("Ixx_cm4"), ["Ixx_cm4", "A_cm2"], 0.5),
        ("Zex", "Zex_cm3", v["Ixx_cm4"] * 10 / (v["D"] / 2), ["Ixx_cm4", "D"], 1.0),
        ("ryy", "ryy", radius("Iyy_cm4"), ["Iyy_cm4", "A_cm2"], 0.5),
        ("Zey", "Zey_cm3", v["Iyy_cm4"] * 10 / half, ["Iyy_cm4", "B"], 1.0),
    ]
    found = []
    for label, key, expected, inputs, power in checks:
        slack = sum((power * F.coalesce(half_ulp(printed[i]), F.lit(0.0)) for i in inputs), F.lit(0.0))
        if label == "Zey":
            slack = slack + F.when(schema == "C", F.coalesce(half_ulp(printed["Cy"]), F.lit(0.0))).otherwise(0.0)
        _, verdict = compare_printed(printed[key], expected, slack)
        found.append(F.when(v[key].isNotNull() & (expected != 0) & (verdict == "FAIL"), label))
    size = F.nullif(F.regexp_extract(designation, r"(\d{2,4})", 1), F.lit("")).cast("double")
    found.append(F.when(~(v["D"] / size).between(0.85, 1.25), "designation"))
    return F.array_compact(F.array(*found))


#: Rolled sections whose name ends with their mass, after two sizes or after one, and kilograms a metre of a square millimetre of steel.
ROLLED, ROLLED_SHORT = ("WPB", "NPB", "HB", "MB", "LB", "SC", "MC", "WB", "JB", "JC", "LC", "PBP", "SB"), ("WPB", "NPB", "HB", "MB", "LB", "SC", "MC", "WB")
STEEL = 0.00785


def section_mass(designation: Column) -> Column:
    """Kilograms a metre of a section by its designation; null for one without its mass and for unknown shapes.

    Rolled sections carry the mass in the name (``WPB300X300X88.34``, ``HB300X88.34``). Welded I (``WI``) and tapered ones of mean depth (``TI``), boxes, round and
    rectangular tubes and angles, single or twin, follow from their plates.
    """
    s = F.translate(F.replace(F.upper(F.trim(designation)), F.lit(" "), F.lit("")), "×", "X")
    twin, body = s.rlike("^(2|TWIN)"), F.regexp_replace(s, "^(2|TWIN)", "")
    number = r"\d+(?:\.\d+)?"
    head, tail = F.regexp_extract(body, "^([A-Z]+)", 1), F.regexp_replace(body, "^[A-Z]+", "")
    sizes = F.when(tail.rlike(rf"^{number}(?:[X-]{number})*\z"), F.split(tail, "[X-]"))
    dashes, n = F.length(tail) - F.length(F.replace(tail, F.lit("-"), F.lit(""))), F.size(sizes)
    d = lambda k: F.get(sizes, F.lit(k)).cast("double")
    rolled = F.regexp_replace(head, "^IS", "")
    plain = ~twin & (dashes == 0)
    web = lambda depth, bf, tf, tw: STEEL * (2 * bf * tf + F.greatest(depth - 2 * tf, F.lit(0.0)) * tw)
    inner = lambda t: F.greatest(d(0) - 2 * t, F.lit(0.0)) * F.greatest(d(1) - 2 * t, F.lit(0.0))
    angle = STEEL * d(2) * (d(0) + d(1) - d(2))
    return (
        F.when(plain & rolled.isin(*ROLLED) & (n == 3), d(2))
        .when(plain & rolled.isin(*ROLLED_SHORT) & (n == 2) & F.get(sizes, F.lit(1)).contains("."), d(1))
        .when(plain & (head == "WI") & (n == 4), web(d(0), d(1), d(2), d(3)))
        .when(~twin & (head == "TI") & (n == 5) & (dashes == 1) & tail.rlike(rf"^{number}-"), web((d(0) + d(1)) / 2, d(2), d(3), d(4)))
        .when(plain & (head == "BOX") & (n == 3), STEEL * (d(0) * d(1) - inner(d(2))))
        .when(plain & head.isin("CHS", "PIPE", "TUBE") & (n == 2), STEEL * F.pi() * (d(0) - d(1)) * d(1))
        .when(plain & head.isin("RHS", "SHS") & (n == 3), STEEL * (d(0) * d(1) - (d(0) - 2 * d(2)) * (d(1) - 2 * d(2))))
        .when((dashes == 0) & head.isin("ISA", "L") & (n == 3), F.when(twin, 2.0).otherwise(1.0) * angle)
    )

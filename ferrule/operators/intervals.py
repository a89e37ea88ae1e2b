"""Joins of intervals and boxes that overlap, same-line neighbours, and integrals up to a level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators.ordered import running_sums

#: Ratio of the widths of two levels of bins.
BASE = 4
#: Rows of a group that every row of the other side may be held against; larger groups meet in bins.
FEW = 128


def _level(lo: Column, hi: Column) -> Column:
    """The first level whose bins are as wide as an interval; null for one without length."""
    return F.when(hi > lo, F.ceil(F.log((hi - lo).cast("double")) / F.log(F.lit(float(BASE)))).cast("int"))


def _bin(x: Column, level: Column) -> Column:
    return F.floor(x.cast("double") / F.pow(F.lit(float(BASE)), level)).cast("long")


def _levels(df: DataFrame, names: list[str]) -> list[list[int]]:
    """The levels that occur, by dimension: one row to the driver, of as many levels as lengths have orders of magnitude."""
    row = df.agg(*[F.sort_array(F.collect_set(n)).alias(n) for n in names]).first()
    return [list(row[n]) for n in names]


def _overlap(met: DataFrame, dims: list[tuple[str, str]], touching: bool) -> tuple[DataFrame, Column, list[Column]]:
    """Pairs that overlap in all of ``dims``, the length or area in common, and where it begins in each."""
    common, begins = F.lit(1.0), []
    for low, high in dims:
        llo, lhi, rlo, rhi = (F.col(f"{side}.{c}").cast("double") for side in ("left", "right") for c in (low, high))
        lo, hi = F.greatest(llo, rlo), F.least(lhi, rhi)
        inside = (hi > lo) | ((llo == lhi) | (rlo == rhi)) & (F.least(llo, rlo) < lo) & (hi < F.greatest(lhi, rhi))
        met = met.where((hi >= lo) if touching else inside & (hi >= lo))
        common = common * (hi - lo)
        begins.append(lo)
    return met, common, begins


def _sound(df: DataFrame, dims: list[tuple[str, str]], by: list[str], side: str) -> DataFrame:
    return df.where(" AND ".join(f"{lo} <= {hi}" for lo, hi in dims)).select(*by, F.struct(*[c for c in df.columns if c not in by]).alias(side))


def overlaps(left: DataFrame, right: DataFrame, by: list[str], dims: list[tuple[str, str]], touching: bool = True) -> DataFrame:
    """Pairs of rows of equal ``by`` whose intervals overlap in every one of ``dims``, each once: ``by, left, right, overlap``.

    ``dims`` names the low and high column of each dimension, one for intervals and two for boxes; ``left`` and ``right`` are structs of the other columns,
    ``overlap`` is the length or area in common. Intervals that touch overlap unless ``touching`` is off; then one without length overlaps what holds it inside.
    Groups with ``FEW`` rows or fewer on the right meet as they are, a row a row; larger ones meet in bins (``_binned``). Rows with a null bound or a high
    bound below the low one overlap nothing.
    """
    sizes = right.groupBy(*by).agg(F.count("*").alias("__n"))
    groups, above = sizes.agg(F.count("*"), F.count_if(F.col("__n") > FEW)).first() if by else (1, 1)
    if above and above == groups:
        return _binned(left, right, by, dims, touching)
    large = sizes.where(F.col("__n") > FEW).select(*by)
    few = [df.join(large, by, "left_anti") if above else df for df in (left, right)]
    met, common, _ = _overlap(_sound(few[0], dims, by, "left").join(_sound(few[1], dims, by, "right"), by), dims, touching)
    met = met.select(*by, "left", "right", common.alias("overlap"))
    return met.unionByName(_binned(*[df.join(large, by, "left_semi") for df in (left, right)], by, dims, touching)) if above else met


def _binned(left: DataFrame, right: DataFrame, by: list[str], dims: list[tuple[str, str]], touching: bool) -> DataFrame:
    """``overlaps`` by bins.

    An interval is put into the two bins at most that it meets on the level of its own length, and, to meet longer ones, on the levels above
    that occur on the other side. Pairs meet on the level of the longer one, in the bin in which what they have in common begins, so short ones never meet in wide bins and a
    long one among many short ones costs each of them a row.
    """
    names = [f"__k{i}" for i in range(len(dims))]

    def ready(df: DataFrame, side: str) -> DataFrame:
        sound = df.where(" AND ".join(f"{lo} <= {hi}" for lo, hi in dims))
        bounds = [F.col(c).cast("double").alias(f"__{side}{k}{i}") for i, d in enumerate(dims) for k, c in zip(("lo", "hi"), d, strict=True)]
        rest = [c for c in df.columns if c not in by]
        return sound.select(*by, F.struct(*rest).alias(side), *bounds, *[_level(F.col(lo), F.col(hi)).alias(n) for n, (lo, hi) in zip(names, dims, strict=True)])

    a, b = ready(left, "left"), ready(right, "right")
    found = list(zip(_levels(a, names), _levels(b, names), strict=True))
    least = [min([*x, *y], default=0) for x, y in found]
    a, b = (df.fillna(dict(zip(names, least, strict=True))) for df in (a, b))
    own = [(sorted({*x, k}), sorted({*y, k})) for (x, y), k in zip(found, least, strict=True)]

    def spread(i: int, side: str, level: Column, kind: str) -> Column:
        """The bins of one level that an interval meets, for pairs in which the one of that side is the longer."""
        ends = (_bin(F.col(f"__{side}{k}{i}"), level) for k in ("lo", "hi"))
        return F.transform(F.sequence(*ends), lambda x: F.struct(level.alias("level"), x.alias("bin"), F.lit(kind).alias("kind")))

    def dealt(df: DataFrame, side: str) -> DataFrame:
        for i, name in enumerate(names):
            other = "right" if side == "left" else "left"
            above = F.filter(F.array(*map(F.lit, own[i][side == "left"])), lambda k: k > F.col(name))  # noqa: B023
            higher = F.flatten(F.transform(above, lambda k: spread(i, side, k, other)))  # noqa: B023
            here = [spread(i, side, F.col(name), kind) for kind in ("left", "right")[: 1 if side == "left" else 2]]
            df = df.withColumn(f"__at{i}", F.explode(F.concat(*here, higher)))
        return df.drop(*names)

    at = [f"__at{i}" for i in range(len(dims))]
    met = dealt(a, "left").join(dealt(b, "right"), [*by, *at])
    met, common, begins = _overlap(met, dims, touching)
    for i, lo in enumerate(begins):
        met = met.where(_bin(lo, F.col(f"__at{i}.level")) == F.col(f"__at{i}.bin"))
    return met.select(*by, "left", "right", common.alias("overlap"))


def same_line(boxes: DataFrame, others: DataFrame, by: list[str], near: float = 14.0, slack: float = 2.0) -> DataFrame:
    """For ``boxes(by, key, low, high)`` the ``others`` of their page on the same line: ``by, key, other, gap``.

    Two are on one line if their middles are nearer than ``near``, or if their heights overlap within ``slack``; a box is not its own neighbour.
    """
    middle = (F.col("low") + F.col("high")) / 2
    reach = boxes.select(*by, "key", "low", "high", F.least(F.col("low") - slack, middle - near).alias("lo"), F.greatest(F.col("high") + slack, middle + near).alias("hi"))
    met = overlaps(reach, others.select(*by, "key", "low", "high", F.col("low").alias("lo"), F.col("high").alias("hi")), by, [("lo", "hi")])
    mid = lambda s: (F.col(f"{s}.low") + F.col(f"{s}.high")) / 2
    gap = F.abs(mid("left") - mid("right"))
    heights = (F.col("right.high") >= F.col("left.low") - slack) & (F.col("right.low") <= F.col("left.high") + slack)
    return met.where((F.col("left.key") != F.col("right.key")) & ((gap < near) | heights)).select(*by, F.col("left.key").alias("key"), F.col("right.key").alias("other"), gap.alias("gap"))


def integral_up_to(levels: DataFrame, pieces: DataFrame, by: list[str], at: str, lo: str, hi: str, slope: str, out: str = "integral") -> DataFrame:
    """``levels`` with the integral up to each of them of the slopes of ``pieces`` of their group; 0 below all pieces and without any.

    Up to z a piece adds slope x (min(z, hi) - lo). That is z times the slopes that have begun less those that have ended, and a sum of slope x place of the
    same, so running sums over the ends of pieces in order give it: no level meets a piece, and a group of any size is summed by ranges.
    """
    s, x = F.col(slope).cast("double"), lambda c: F.col(c).cast("double")
    ends = pieces.where((x(hi) > x(lo)) & s.isNotNull()).select(*by, F.explode(F.array(F.struct(x(lo).alias("x"), s.alias("s")), F.struct(x(hi).alias("x"), (-s).alias("s")))).alias("e"))
    marks = ends.select(*by, F.col("e.x").alias("__x"), F.lit(1).alias("__side"), F.col("e.s").alias("__slope"), (F.col("e.s") * F.col("e.x")).alias("__moment"))
    asked = levels.withColumns({"__x": x(at), "__side": F.lit(0), "__slope": F.lit(0.0), "__moment": F.lit(0.0)})
    both = running_sums(asked.unionByName(marks, allowMissingColumns=True), by, ["__x", "__side"], ["__slope", "__moment"])
    return both.where("__side = 0").select(*levels.columns, (F.col("__x") * F.col("__slope_before") - F.col("__moment_before")).alias(out))

"""Thin-walled section properties from a polyline, as Columns: area, centroid, second moments, torsion, principal axes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(points: Column) -> Column:
    """Pairs of points that follow each other in ``array<struct<x,y>>``."""
    n = F.size(points)
    ends = F.arrays_zip(F.slice(points, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(points, 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    return F.transform(ends, lambda s: F.struct(s["a"]["x"].alias("x1"), s["a"]["y"].alias("y1"), s["b"]["x"].alias("x2"), s["b"]["y"].alias("y2"), F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]).alias("l")))


def total(parts: Column, f) -> Column:
    return F.aggregate(F.transform(parts, f), F.lit(0.0), lambda s, v: s + v)


def properties(points: Column, thickness: Column) -> Column:
    """A struct of ``area, x, y, ixx, iyy, ixy, j, i1, i2, angle`` about the centroid; null without two points."""
    t = thickness.cast("double")

    def of(parts: Column) -> Column:
        length = total(parts, lambda s: s["l"])
        x = total(parts, lambda s: s["l"] * (s["x1"] + s["x2"]) / 2) / length
        y = total(parts, lambda s: s["l"] * (s["y1"] + s["y2"]) / 2) / length
        square = lambda a, b: (a * a + a * b + b * b) / 3
        ixx = t * (total(parts, lambda s: s["l"] * square(s["y1"], s["y2"])) - length * y * y)
        iyy = t * (total(parts, lambda s: s["l"] * square(s["x1"], s["x2"])) - length * x * x)
        both = lambda s: (2 * s["x1"] * s["y1"] + 2 * s["x2"] * s["y2"] + s["x1"] * s["y2"] + s["x2"] * s["y1"]) / 6
        ixy = t * (total(parts, lambda s: s["l"] * both(s)) - length * x * y)
        mean, half = (ixx + iyy) / 2, F.sqrt(F.pow((ixx - iyy) / 2, 2) + F.pow(ixy, 2))
        return F.struct((t * length).alias("area"), x.alias("x"), y.alias("y"), ixx.alias("ixx"), iyy.alias("iyy"), ixy.alias("ixy"), (length * F.pow(t, 3) / 3).alias("j"), (mean + half).alias("i1"), (mean - half).alias("i2"), (F.atan2(-2 * ixy, ixx - iyy) / 2).alias("angle"))

    bound = F.transform(F.array(segments(points)), of)[0]
    return F.when(F.size(points) >= 2, bound)


def plate_area(kind: Column, d: Column, b: Column, tw: Column, tf: Column, r1: Column) -> Column:
    """The area of an I or channel section out of its plates and root fillets; null for angles and without a dimension."""
    fillets = F.when(F.lower(kind).contains("channel"), 2).otherwise(4) * (1 - F.pi() / 4) * F.pow(F.coalesce(r1, F.lit(0.0)), 2)
    return F.when(~F.lower(F.coalesce(kind, F.lit(""))).contains("angle"), 2 * b * tf + (d - 2 * tf) * tw + fillets)


def plate_verdict(printed: Column, area: Column, check: Column, tolerance: float = 0.05) -> Column:
    """``check``, or a quarantine where the printed area is off that of the plates by more than ``tolerance``."""
    ratio = printed / F.nullif(area, F.lit(0.0))
    off = (printed != 0) & (F.abs(ratio - 1) > tolerance) & ~F.coalesce(check, F.lit("")).startswith("QUARANTINED")
    note = F.concat(F.lit("QUARANTINED: area is "), F.format_number(ratio, 2), F.lit(" of the plates' (was: "), F.coalesce(check, F.lit("")), F.lit(")"))
    return F.when(off, note).otherwise(check)


def thickened(a: Column, ix: Column, iy: Column, j: Column, factor: Column) -> Column:
    """Stiffness under a factor of plate thickness: areas and second moments go with it, torsion with its cube."""
    f = F.coalesce(factor, F.lit(1.0))
    return F.struct((a * f).alias("a"), (ix * f).alias("ix"), (iy * f).alias("iy"), (j * f * f * f).alias("j"))

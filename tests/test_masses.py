"""Unit masses of designations: what a name says, and plates by hand."""

import math

import pytest

from ferrule.operators.scoring import section_mass


def test_designations_of_every_shape(spark):
    steel = 0.00785
    want = {
        "WPB300X300X88.34": 88.34, "ISNPB 400 x 180 x 57.38": 57.38, "hb300x88.34": 88.34, "HB300X88": None, "MB300": None, "JB150X7.1": None, "JB150X50X7.1": 7.1,
        "WI500X200X16X8": steel * (2 * 200 * 16 + 468 * 8), "WI20X200X16X8": steel * 2 * 200 * 16, "TI400-600X200X16X8": steel * (2 * 200 * 16 + 468 * 8), "TI400X600X200X16X8": None,
        "BOX600X600X36": steel * (600**2 - 528**2), "BOX60X60X36": steel * 3600, "CHS165.1X5.9": steel * math.pi * (165.1 - 5.9) * 5.9, "TUBE100×4": steel * math.pi * 96 * 4, "RHS100X50X4": steel * (5000 - 92 * 42),
        "ISA100X100X10": steel * 10 * 190, "L100X75X8": steel * 8 * 167, "2ISA100X100X10": 2 * steel * 10 * 190, "TWINL100X75X8": 2 * steel * 8 * 167, "2BOX600X600X36": None, "UB300X100X10": None, "": None, "X": None, "BOX600X600X36X": None,
    }
    rows = spark.createDataFrame([(k,) for k in want] + [(None,)], "s string")
    got = {r.s: r.m for r in rows.select("s", section_mass(rows.s).alias("m")).collect()}
    assert got.pop(None) is None and {k for k, v in got.items() if v is None} == {k for k, v in want.items() if v is None}
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx({k: v for k, v in want.items() if v is not None})

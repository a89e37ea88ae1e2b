"""Profiles against closed forms, alignment against all combinations, pairing and cells against planted misreadings."""

from itertools import combinations

import numpy as np
import pytest

from ferrule.operators import profiles, readings
from ferrule.plans import readings as plan

SF = "/root/testdata/sf0.01"


def test_sharp_channel_and_i_have_their_closed_forms():
    h, b, t = np.array([200.0, 90.0]), np.array([80.0, 35.0]), np.array([2.0, 1.6])
    g = profiles.properties(*profiles.centreline("channel", h, b, 0, t), t)
    hh, bb = h - t, b - t / 2
    assert g["Cw"] == pytest.approx(t * hh**2 * bb**3 / 12 * (2 * hh + 3 * bb) / (6 * bb + hh), rel=1e-6)
    assert -g["xs"] == pytest.approx(3 * bb**2 / (6 * bb + hh), rel=1e-6)
    assert g["Ix"] == pytest.approx(t * (hh**3 / 12 + bb * hh**2 / 2), rel=1e-6)
    # An I as a path that goes back over itself with no thickness
    depth, width, tf, tw = 200.0, 100.0, 10.0, 6.0
    x = np.array([[-width / 2, width / 2, 0, 0, -width / 2, width / 2]])
    y = np.array([[depth / 2] * 3 + [-depth / 2] * 3])
    g = profiles.properties(x, y, np.array([[tf, 0, tw, 0, tf]]))
    assert g["Cw"] == pytest.approx(tf * width**3 / 12 * depth**2 / 2, rel=1e-6)
    assert g["J"] == pytest.approx((2 * width * tf**3 + depth * tw**3) / 3, rel=1e-6)
    assert abs(g["xs"][0]) < 1e-6 and abs(g["ys"][0]) < 1e-6


def test_sharp_lipped_channel_has_its_closed_form():
    """Shear centre and warping constant from the shear flow and the sectorial coordinate, integrated piece by piece by hand."""
    h, b, c, t = 152.0, 64.0, 18.5, 2.0
    a, w, d = h - t, b - t, c - t / 2  # centre-line web, flange, lip
    g = profiles.properties(*profiles.centreline("lipped_channel", h, b, c, t), np.array([t]))
    ix = t * (a**3 / 12 + w * a**2 / 2 + 2 * (d**3 / 12 + d * (a / 2 - d / 2) ** 2))
    assert g["Ix"] == pytest.approx(ix, rel=1e-6)
    e = w * t / ix * (w * a**2 / 4 + d * a**2 / 2 - 2 * d**3 / 3)
    assert -g["xs"] == pytest.approx(e, rel=1e-6)
    # sectorial coordinate from the middle of the web about the shear centre: web, flange, lip, upper half
    s = np.linspace(0, 1, 200_001)
    web = -e * a / 2 * s
    flange = web[-1] + a / 2 * w * s
    lip = flange[-1] + (w + e) * d * s
    integral = lambda f, length: np.trapezoid(f**2, s) * length
    cw = 2 * t * (integral(web, a / 2) + integral(flange, w) + integral(lip, d))
    assert g["Cw"] == pytest.approx(cw, rel=1e-6)


def test_arcs_touch_their_legs_and_close_in_on_the_true_arc():
    x, y = np.array([[50.0, 0, 0]]), np.array([[0.0, 0, 40]])
    px, py = profiles.rounded(x, y, np.array([6.0]), 2000)
    assert np.hypot(np.diff(px), np.diff(py)).sum() == pytest.approx(50 + 40 - 12 + 3 * np.pi, rel=1e-7)
    px, py = profiles.rounded(x, y, np.array([6.0]))
    assert px.shape == (1, 11) and (px[0, 1], py[0, 1]) == pytest.approx((6, 0)) and (px[0, -2], py[0, -2]) == pytest.approx((0, 6))
    assert np.hypot(px[0, 1:-1] - 6, py[0, 1:-1] - 6) == pytest.approx(np.full(9, 6.0))
    straight = profiles.rounded(np.array([[0.0, 10, 30]]), np.zeros((1, 3)), np.array([5.0]))
    assert set(straight[0][0]) == {0, 10, 30}


def every_way(cells, joined, length, n):
    """The best gain over all combinations of joins, junk and empty columns, enumerated."""
    best = -np.inf
    joins = [k for k in range(length - 1) if joined[k].max() > -np.inf]
    for m in range(3):
        for chosen in combinations(joins, m):
            if any(b - a < 2 for a, b in zip(chosen, chosen[1:], strict=False)):
                continue
            seq, k = [], 0
            while k < length:
                seq.append(joined[k] if k in chosen else cells[k])
                k += 2 if k in chosen else 1
            for junk, gaps in readings.LEFT_OUT:
                if len(seq) - junk + gaps != n:
                    continue
                for drop in combinations(range(len(seq)), junk):
                    rest = [s for k, s in enumerate(seq) if k not in drop]
                    for empty in combinations(range(n), gaps):
                        at = [j for j in range(n) if j not in empty]
                        best = max(best, sum(s[j] for s, j in zip(rest, at, strict=True)) - 0.3 * m)
    return best


def test_alignment_against_every_combination():
    draw = np.random.default_rng(9)
    for n in (3, 5, 6):
        rows, width = 60, 9
        lengths = draw.integers(0, 9, rows)
        cells = draw.choice([0.0, 0.6, 1.0], (rows, width, n))
        joined = np.where(draw.random((rows, width - 1, 1)) < 0.3, draw.choice([0.0, 0.6, 1.0], (rows, width - 1, n)), -np.inf)
        for r, k in enumerate(lengths):
            cells[r, k:], joined[r, max(k - 1, 0) :] = -np.inf, -np.inf
        put, gain = readings.align(cells, joined, lengths)
        for r, k in enumerate(lengths):
            best = every_way(cells[r], joined[r], k, n)
            assert gain[r] == pytest.approx(max(best, 0.0) if best > -np.inf else 0.0)
            used = [(p // 2, p % 2, j) for j, p in enumerate(put[r]) if p >= 0]
            assert all(a[0] + a[1] < b[0] for a, b in zip(used, used[1:], strict=False))  # in order, none used twice
            lost = sum((joined if m else cells)[r, i, j] - 0.3 * m for i, m, j in used) - gain[r]
            assert any(lost == pytest.approx(0.3 * k, abs=1e-9) for k in range(3))  # a joined pair may be left out as junk, which costs its join


def test_parse_takes_lines_with_a_whole_designation(spark):
    said = ["100 x 50 x l5 x 2.OO 4.3O | 3,38 abc 7", "| 80 × 80 x 2.00 - 1 49 x.5", "80 x 80 x 10 x 2.00 5", "no designation 1.0", "", None, "60x40x15x1.60. 9.9"]
    df = spark.createDataFrame([(n, "1" if n in (1, 2) else "6", n, s) for n, s in enumerate(said)], "row long, table string, page long, line string")
    got = {r.row: (r.h, r.b, r.c, r.t, r.tokens) for r in readings.parse(df).collect()}
    assert got == {0: (100, 50, 15, 2, ["4.30", "1", "3.38", "7"]), 1: (80, 80, 0, 2, ["1", "49"]), 6: (60, 40, 15, 1.6, ["9.9"])}


def test_pairs_meet_within_a_slip_and_once(spark):
    rows = [("a", 1, 2.00), ("a", 2, 2.50), ("a", 3, 1.25), ("b", 4, 2.00), ("b", 5, 2.90), ("b", 6, 1.95), ("b", 7, 3.25), ("a", 8, 2.00)]
    df = spark.createDataFrame([(s, "6", 1, n, 100.0, 50.0, 15.0, t, [str(n)]) for s, n, t in rows], "source string, table string, page long, row long, h double, b double, c double, t double, tokens array<string>")
    got = {(tuple(r.first or ()), tuple(r.second or ()), r.t) for r in readings.paired(df, "a", "b").select("first", "second", "t").collect()}
    assert got == {(("1",), ("4",), 2.0), (("2",), ("6",), 2.5), (("3",), (), 1.25), ((), ("5",), 2.9), ((), ("7",), 3.25)}


def test_resolved_rows_give_back_what_was_printed(spark):
    """The query's rows against the cells before they were misread: those without notes have to be right, and they have to be most."""
    dims = {r.row: r for r in plan.dimensions(spark.read.parquet(f"{SF}/part.parquet")).collect()}
    truth = {}
    for r in dims.values():
        own = {k: np.array([getattr(r, k)]) for k in "hbct"}
        truth[r.row] = [float(x) for x in plan.true_cells(r.table, own)[0]]
    got = plan.resolved_rows(spark, SF).collect()
    sizes = {}
    for r in dims.values():
        sizes.setdefault((r.table, r.h, r.b, r.c, r.t), []).append(r.row)
    assert 0.97 * len(sizes) <= len(got) <= len(sizes) * 1.01
    clean = [r for r in got if not r.notes]
    assert len(clean) > 0.9 * len(got)
    cells = wrong = 0
    for r in clean:
        for said, true in zip(r.cells.split(" "), truth[r.row], strict=True):
            cells += 1
            wrong += said == "-" or abs(float(said) - true) > 1e-6 + 0.004 * abs(true)
    assert wrong <= 0.002 * cells
    assert any(r.repairs for r in got) and any("layer" in r.used or "scan" in r.used for r in got)


def test_settled_keeps_the_row_without_notes_and_drops_phantoms(spark):
    cols = profiles.columns("6")
    values = lambda m, a: [float(m) if c == "M" else float(a) if c == "A" else 1.0 for c in cols]
    rows = [
        ("6", 1, 1, "A", values(3, 4), ["a", "b"], ["bad"]), ("6", 2, 2, "A", values(3, 4), ["a", "b"], []),
        ("6", 2, 3, "B", values(3, 4), ["a"], ["bad"]), ("6", 2, 4, "C", values(3, 5), ["a"], ["bad"]), ("6", 2, 5, "D", values(3, 4), ["a"], []), ("6", 3, 6, "E", values(3, 4), ["a"], ["bad"]),
    ]
    df = spark.createDataFrame(rows, "table string, page long, row long, designation string, values array<double>, sources array<string>, notes array<string>")
    assert {(r.designation, r.row) for r in readings.settled(df).collect()} == {("A", 2), ("C", 4), ("D", 5), ("E", 6)}

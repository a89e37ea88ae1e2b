"""Retries, resumed plans, keys, JSON text, annexes, sections, passages and conflicts, by hand and by plain loops."""

import math
import re

from pyspark.sql import functions as F

from ferrule.functions import keys
from ferrule.operators import events, geometry, retrieval, scoring, sections


def test_retries_stop_at_the_same_line(spark):
    logs = {"a": [("c", "x"), ("c", "y"), ("c", "y"), ("o", "z")], "b": [("c", "x"), ("o", "x"), ("c", "x")], "c": [("c", str(i)) for i in range(12)], "d": [("c", None), ("c", None)], "e": [("o", "")]}
    df = spark.createDataFrame([(r, i + 1, k, t) for r, x in logs.items() for i, (k, t) in enumerate(x)], "run string, n int, kind string, line string")

    def plain(log, most):
        out, prev = [], None
        for i, (kind, line) in enumerate(log):
            n = i + 1
            verdict = "ended" if kind != "c" else "limit" if n >= most else "unmoved" if prev == (line or "") else "retry"
            out.append((n, verdict, n >= 3))
            if verdict != "retry":
                break
            prev = line or ""
        return out

    for most, limit in ((4, 4), (1, 1), (50, 10)):
        got = events.retried(df, ["run"], "n", F.col("kind") == "c", "line", most).orderBy("run", "n").collect()
        assert {r: [(x.n, x.verdict, x.overridden) for x in got if x.run == r] for r in logs} == {r: plain(x, limit) for r, x in logs.items()}


def test_plans_by_a_plain_loop(spark):
    import random

    rng = random.Random(5)
    rows = [(p, rng.choice("AB"), n, rng.random() < 0.4, rng.choice(["stop", "skip_project", "continue"]), rng.choice(["pending", "pending", "done", "failed"])) for p in range(60) for n in range(7)]
    df = spark.createDataFrame(rows, "plan int, project string, n int, fails boolean, on_fail string, was string")

    def plain(steps, resumed):
        out, skip, stop = {}, set(), False
        for _, project, n, fails, on_fail, was in steps:
            if resumed and was != "pending":
                out[n] = was
            elif stop:
                out[n] = "not_run"
            elif project in skip:
                out[n] = "skipped"
            else:
                out[n] = "failed" if fails else "done"
                stop = fails and on_fail == "stop"
                skip |= {project} if fails and on_fail == "skip_project" else set()
        return out

    for resumed in (False, True):
        got = events.plan_outcome(df, "plan", "project", "n", F.col("fails"), "on_fail", "was" if resumed else None).collect()
        assert {(r.plan, r.n): r.status for r in got} == {(p, n): s for p in range(60) for n, s in plain([r for r in rows if r[0] == p], resumed).items()}
    left = spark.createDataFrame([("running",), ("done",), (None,)], "s string").select(events.recovered(F.col("s"), "stopped")).collect()
    assert [r[0] for r in left] == ["stopped", "done", None]


def test_keys_and_json_text(spark):
    df = spark.createDataFrame([("Table", " 12.8 - 2", "A", None, None, None), ("exact_table", "12.8-2", "alpha ", "", 0, False), ("exact_table", "12.8-2", "alpha", "", 1, False), (None, "ﬁre\n  Wall", None, None, None, None), ("auto", "FIRE wall ", "", "", 0, False)], "t string, q string, d string, c string, n int, w boolean")
    k = [r[0] for r in df.select(keys.canonical_key({"a": "alpha"})("t", "q", "d", "c", "n", "w")).collect()]
    assert k[0] == k[1] != k[2] and k[3] == k[4] and len(set(k)) == 3
    import hashlib

    assert k[3] == hashlib.sha256(b'{"collection":"","doc":"","neighbors":0,"query":"fire wall","type":"auto","want_commentary":false}').hexdigest()
    deep = '[' * 100000
    texts = ['{"id": "i", "a": {"b": ["x", {"viewer": "v", "c": "y"}], "std": ["s"]}, "n": 1}', '"one"', "no json", "", deep, None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(keys.json_strings("t")).collect()
    assert [r[0] for r in got] == ["x\ny", "one", "no json", "", deep, None]


def test_annex_slices_by_a_plain_loop(spark):
    pages = {1: "x\nANNEX A Scope\nA-1 one\ntext", 2: "  ## ANNEX B  Wind \nB-1 first\n B-1.1 sub\nB-10 ten\nmore\nB-2 second", 3: "B-1 again\nANNEX C", 4: "ANNEX B twice", 6: "B-9 late"}
    lines = spark.createDataFrame([("d", p, i, x) for p, t in pages.items() for i, x in enumerate(t.split("\n"))] + [("e", 1, 0, None)], "doc string, page int, pos int, line string")
    asked = [("d", s, at) for s in ("Annex A", "Annex B", "Annex C", "Annex H", "B-1", "B-10", "B-9", "A-1") for at in (1, 2, 3)] + [("e", "B-1", 1)]

    def plain(sid, at):
        out, own = [], None
        for p in range(at, at + 4):
            for x in pages.get(p, "").split("\n"):
                a, c = re.match(sections.ANNEX, x), re.match(sections.CLAUSE, x)
                a, c = a and a[1], c and c[1]
                if own is None:
                    if (a == sid[-1]) if sid.startswith("Annex") else (c == sid):
                        own, out = True, [x.strip()]
                elif a or (c and not sid.startswith("Annex") and c != sid and not c.startswith(sid + ".")):
                    return "\n".join(out)
                elif p in pages:
                    out.append(x)
        return "\n".join(out) if own else None

    got = sections.annex_slice(lines, spark.createDataFrame(asked, "doc string, sid string, start int")).collect()
    assert {(r.doc, r.sid, r.start): r.body for r in got} == {(d, s, at): plain(s, at) for d, s, at in asked if d == "d" and plain(s, at) is not None}
    cut = sections.annex_slice(lines, spark.createDataFrame([("d", "Annex B", 2)], "doc string, sid string, start int"), max_chars=11).first()
    assert cut.body == "## ANNEX B "


def test_plates_costs_and_issues(spark):
    df = spark.createDataFrame([("I", 300.0, 140.0, 7.5, 12.4, 14.0, 5626.0, "PASS"), ("channel", 300.0, 90.0, 7.6, 13.6, None, 9999.0, "PASS"), ("angle", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, None), ("I", None, 1.0, 1.0, 1.0, 1.0, 5.0, "PASS")], "k string, d double, b double, tw double, tf double, r double, a double, was string")
    area = geometry.plate_area(*[F.col(c) for c in ("k", "d", "b", "tw", "tf", "r")])
    got = df.select(area.alias("p"), geometry.plate_verdict(F.col("a"), area, F.col("was")).alias("v")).collect()
    i = 2 * 140 * 12.4 + (300 - 24.8) * 7.5 + 4 * (1 - math.pi / 4) * 14**2
    c = 2 * 90 * 13.6 + (300 - 27.2) * 7.6
    assert abs(got[0].p - i) < 1e-9 and abs(got[1].p - c) < 1e-9 and got[2].p is None and got[3].p is None
    assert [r.v for r in got] == ["PASS", f"QUARANTINED: area is {9999 / c:.2f} of the plates' (was: PASS)", None, "PASS"]
    m = spark.createDataFrame([(2.0, 3, None, 10.0), (None, 1, 1, 10.0), (1.0, None, None, None)], "t double, c int, b int, a double")
    got = m.select(*[v.alias(k) for k, v in scoring.cost_metrics(*[F.col(x) for x in "tcba"]).items()]).collect()
    assert [tuple(r) for r in got] == [(400000.0, 450000.0, 50000.0), (None, 450000.0, None), (110000.0, None, None)]
    names = ["A_cm2", "D", "B", "Cy", "Ixx_cm4", "Iyy_cm4", "mass_kg_m", "rxx", "Zex_cm3", "ryy", "Zey_cm3"]
    good = ["58.6", "300", "140", None, "8985", "486", "46.0", "12.4", "599", "2.88", "69.4"]
    rows = [good, [*good[:6], "60.0", *good[7:]], [*good[:7], "124", *good[8:]], [*good[:8], "700", None, "80"], [None] * 11]
    df = spark.createDataFrame([("I", d, *r) for d, r in zip(["XB 300", "XB 300", "XB 300", "XB 450", "none"], rows)], "schema string, designation string, " + ", ".join(f"{n} string" for n in names))
    got = df.select(scoring.section_issues(F.col("schema"), F.col("designation"), {n: F.col(n) for n in names}).alias("x")).collect()
    assert [r.x for r in got] == [[], ["mass"], [], ["Zex", "Zey", "designation"], []]


def test_passages_by_a_plain_loop(spark):
    rows = [("a", 0, "Steel beam steel", "docs/beam.md"), ("a", 1, "nothing", "docs/beam.md"), ("b", 0, "beams and Beam", "src/x.py"), ("c", 0, None, "beam.py"), ("d", 0, "other", None)]
    terms = [("q", "steel"), ("q", "beam"), ("r", "zzz"), ("s", "nothing")]
    n, count = len(rows), lambda t, x: (x or "").lower().count(t)
    df = {t: sum(count(t, r[2]) > 0 for r in rows) for _, t in terms}
    want = {}
    for q in {q for q, _ in terms}:
        ts = [t for k, t in terms if k == q]
        for doc, i, text, label in rows:
            s = sum((1 + math.log(count(t, text))) * math.log(1 + n / (1 + df[t])) for t in ts if count(t, text)) + sum(2 for t in ts if t in (label or "").lower())
            if s > 0:
                want[q, doc, i] = s * math.sqrt(sum(count(t, text) > 0 for t in ts) / len(ts)) * (1.25 if (label or "").endswith(".md") else 1)
    got = retrieval.passage_search(spark.createDataFrame(rows, "doc string, i int, text string, label string"), ["doc", "i"], "text", "label", spark.createDataFrame(terms, "qid string, term string")).collect()
    assert {(r.qid, r.doc, r.i) for r in got} == set(want) and all(abs(r.score - want[r.qid, r.doc, r.i]) < 1e-9 for r in got)


def test_conflicts_fetch_what_governs(spark):
    schema = "q string, id string, rank long"
    hits = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "old", 1), ("b", "x", 2), ("c", "x", 1)], schema)
    source = spark.createDataFrame([("a", "fetched", 1), ("b", "new", 1), ("z", "new", 1)], schema)
    got = retrieval.govern(hits, ["q"], "rank", F.col("id") == "new", F.col("id") == "old", source).orderBy("q", "rank").collect()
    assert [(r.q, r.id, r.rank, r.flagged) for r in got] == [("a", "new", 1, False), ("a", "old", 2, True), ("b", "new", 1, False), ("b", "old", 2, True), ("b", "x", 3, False), ("c", "x", 1, False)]

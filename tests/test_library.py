"""Operators of the library: against the oracle SQL on the small tables, and on fixtures of their own."""

import glob
import math
import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from ferrule import plans
from ferrule.functions import text as X
from ferrule.operators import events, ordered, publish, retrieval, sampling, scoring, statistics
from ferrule.sources import files

SF = "/root/testdata/sf0.001"
plans.load()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, oracle, name):
    df = plans.QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    want = oracle.sql(plans.SQL[name])
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(df.columns) == sorted(want.columns)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_ks_against_erf(spark):
    rows = statistics.ks(spark.createDataFrame([(1, i / 7 - 2) for i in range(30)] + [(2, 0.0)], "g int, z double"), ["g"], "z", statistics.normal_cdf("z")).collect()
    z = sorted(i / 7 - 2 for i in range(30))
    phi = [0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z]
    d = max(max((i + 1) / 30 - f, f - i / 30) for i, f in enumerate(phi))
    lam = (math.sqrt(30) + 0.12 + 0.11 / math.sqrt(30)) * d
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    by = {r.g: r for r in rows}
    assert by[1].d == pytest.approx(d) and by[1].p == pytest.approx(min(1, max(0, p))) and by[2].d is None


def test_folds_against_loops(spark):
    pairs = [(g, a, b, (a * 7 + b * 3 + g) % 11) for g in range(3) for a in range(5) for b in range(4)]
    got = {tuple(r) for r in ordered.greedy_match(spark.createDataFrame(pairs, "g int, a int, b int, k int"), ["g"], "a", "b", ["k", "a", "b"]).collect()}
    want = set()
    for g in range(3):
        ua, ub = set(), set()
        for _, a, b, k in sorted((p for p in pairs if p[0] == g), key=lambda p: (p[3], p[1], p[2])):
            if a not in ua and b not in ub:
                ua.add(a), ub.add(b), want.add((g, a, b))
    assert got == want
    rows = [(g, i, (i * 5 + g) % 7 + i // 3) for g in range(3) for i in range(40)]
    got = sorted(tuple(r) for r in ordered.monotone(spark.createDataFrame(rows, "g int, i int, v int"), ["g"], "i", "v").collect())
    want, last = [], {}
    for g, i, v in sorted(rows):
        if g not in last or -1 <= v - last[g] <= 2:
            last[g] = v
            want.append((g, i, v))
    assert got == want
    assert spark.range(1).select(ordered.drop_repeats(F.array(*map(F.lit, [1, 1, 2, 2, 1]))).alias("x")).first().x == [1, 2, 1]


def test_expression(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (4.0, 0.0, 1.0)], "a double, b double, c double")
    ok = [("a / b", [0.5, None]), ("S = max(a, b) + abs(-a)", [3.0, 8.0]), ("1 if 0 < a < 2 else sqrt(a)", [1.0, 2.0]), ("a + c", [None, 5.0]), ("not b or a > 3", [0.0, 1.0]), ("log(b)", [math.log(2), None]), ("a ^ 2 − b", [-1.0, 16.0])]
    for text, want in ok:
        value, _ = scoring.compile_expression(text, {"a", "b", "c"})
        assert [r[0] for r in df.select(value).collect()] == pytest.approx(want), text
    for text in ("__import__('os')", "a.real", "unknown + 1", "a if", "steel is light", "[a]", "open('x')", "'a'", "max()", "lambda: 1"):
        with pytest.raises(scoring.Rejected):
            scoring.compile_expression(text, {"a", "b", "c"})


def test_text_functions(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v"))).first()[0]
    assert one(X.nfkc, "ﬁ①") == "fi1" and one(X.casefold, "Straße") == "strasse" and one(X.squeeze, " a \n b ") == "a b"
    assert one(X.section_id, "Clause 7.6.2.") == "7.6.2" and one(X.table_id, "Table 9 (a)") == "9(a)" and one(X.equation_id, "Eq. (7.1-2)") == "7.1-2" and one(X.parent_id, "7.6.2") == "7.6"
    assert one(X.heading, "## 7.6 Beams") == ("7.6", "Beams") and one(X.heading, "plain") is None
    assert one(X.numeric, "1e3") == 1000 and one(X.numeric, "x") is None and one(X.numeric, "true") is None
    assert [X.stem(w) for w in ("caresses", "ponies", "relational", "hopping", "agreed", "probate", "controlling", "sky", "generalizations", "adoption")] == ["caress", "poni", "relat", "hop", "agre", "probat", "control", "sky", "gener", "adopt"]
    ids = spark.createDataFrame([("7.6.1", "7.6"), ("7.60", "7.6"), ("7.6A", "7.6"), ("7.6", "7.6")], "c string, p string")
    assert [r[0] for r in ids.select(X.is_descendant(F.col("c"), F.col("p"))).collect()] == [True, False, True, False]
    assert X.snippet_of("a b c steel d beam e", ["steel", "beam"], 3) == ">>steel<< d >>beam<<"
    r = spark.createDataFrame([("abcd", "bcde"), (None, "a")], "a string, b string").select(X.ratio("a", "b")).collect()
    assert r[0][0] == 0.75 and r[1][0] is None


def test_fts_normalise(spark):
    cases = {"k 4": "k4", "K d": "Kd", "V z": "Vz", "p d": "pd", "C pe": "Cpe", "γ m 0": "γm0", "γ f": "γf", "A h": "Ah", "T a": "Ta", "S a / g": "Sa/g", "Fe 250": "Fe250", "f y": "fy", "M p": "Mp", "0.12h0.34": "0.12 h 0.34", "h0.34": "h 0.34", "ﬁ①": "fi1", "K 5": "K 5"}
    cases |= {"wort " * 200 + a: "wort " * 200 + b for a, b in cases.items()}
    got = spark.createDataFrame([*cases.items(), (None, "")], "a string, b string").select(X.fts_normal("a"), "b").collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    whole = {r.doc_id: X.fts_normal_of(r.text) for r in plans.table(spark, SF, "documents").collect()}
    assert {r.doc_id: r.norm for r in plans.QUERIES["fts_normalise"](spark, SF).collect()} == whole


def test_bodies_and_lists_are_whole(spark, tmp_path):
    text = {1: "SCOPE\n\n" + "one two " * 500 + "\nEND", 2: "a\n" * 2000 + "long line " * 20, 3: None}
    spark.createDataFrame([(i, t, None) for i, t in text.items()], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    body = {r.doc_id: r.body for r in plans.QUERIES["body_markdown"](spark, str(tmp_path)).collect()}
    assert body == {1: "## SCOPE\n" + "one two " * 500 + "\n## END", 2: "## a\n" * 2000 + "long line " * 20, 3: None}
    toc = {r.doc_id: (r.toc, r.n) for r in plans.QUERIES["markdown_toc"](spark, str(tmp_path)).collect()}
    assert toc == {i: ("\n".join("- " + x for x in text[i].split("\n") if x), n) for i, n in ((1, 3), (2, 2001))}


def test_sections_and_excerpts_have_the_references_limits(spark, tmp_path):
    text = {1: "no\nThe one\n\n\n\n" + "a b " * 2000 + "\n \nThe two " + "c" * 13000, 2: "x" * 100 + "Wind" + "w" * 3000 + "Design basis" + "d" * 3000, 3: "y" * 15000, 4: None}
    spark.createDataFrame(list(text.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    body = {(r.doc_id, r.section): r.body for r in plans.QUERIES["section_slice"](spark, str(tmp_path)).collect()}
    assert body == {(1, 1): "The one\n\n" + "a b " * 1999 + "a b", (1, 2): ("The two " + "c" * 13000)[:12000]}
    got = {r.doc_id: r.excerpt for r in plans.QUERIES["report_excerpt"](spark, str(tmp_path)).collect()}
    assert got == {1: text[1][:14000], 2: ("Design basis" + "d" * 3000)[:2200] + "\n---\n" + ("Wind" + "w" * 3000)[:2200], 3: "y" * 14000, 4: ""}


def test_suggestions_against_difflib(spark, tmp_path):
    import difflib
    import re
    import unicodedata

    names = [f"Name{i:03d}" for i in range(40)] + ["Überzug", "Éclair", "ABCDEF", "kettle", "Straße"]
    asked = ["Oberzug", "eclair", "abcdeg", "nettle", "Name0399", "zzzz", "strasse"]
    spark.createDataFrame([(f"{n} text",) for n in names * 2], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, f"{a} text") for i, a in enumerate(asked + asked[:2] + ["KETTLE"])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for d in (str(tmp_path), SF):
        first = lambda t: re.match(r"[^ \t\n\x0b\f\r]*", t or "")[0]
        known = {first(r.text) for r in plans.table(spark, d, "documents").collect()} - {""}
        lower, want = {n.lower() for n in known}, []
        for r in plans.table(spark, d, "benchmark").collect():
            a = first(r.text)
            if a and a.lower() not in lower:
                near = difflib.get_close_matches(a, known, 8, 0.5) or difflib.get_close_matches(unicodedata.normalize("NFKC", a).casefold(), [n.lower() for n in known], 8, 0.5)
                want += [(r.item_id, a, n, i + 1) for i, n in enumerate(near)]
        assert want and sorted(tuple(r)[:4] for r in plans.QUERIES["lookup_misses"](spark, d).collect()) == sorted(want)


def test_phrases_and_chunks(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b"],), (["a"],), ([],)], "w array<string>")
    got = df.select(retrieval.occurrences(F.col("w"), ["a", "b"]), retrieval.chunks(F.col("w"), 3, 2)).collect()
    assert [tuple(r) for r in got] == [(2, [["a", "b", "a"], ["a", "b"]]), (0, [["a"]]), (0, [])]


def test_publish(spark):
    page = spark.createDataFrame([("<p>a &amp; b<script>x('<p>')</script><!-- n --><img src=\"i.png\"> <a href=\"/q?x#y\">c</a><a href=\"http://z\">d</a>",)], "h string")
    r = page.select(publish.visible(F.col("h")).alias("v"), publish.links(F.col("h")).alias("l")).first()
    assert r.v == "a & b c d" and r.l == ["i.png", "/q"]
    t = spark.createDataFrame([("one two", "two", "2")], "t string, f string, p string")
    assert t.select(publish.patch(F.col("t"), F.col("f"), F.col("p"))).first()[0] == "one 2"
    with pytest.raises(Exception, match="must occur once"):
        t.select(publish.patch(F.col("t"), F.lit("o"), F.col("p"))).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "std.md").write_text("<!-- pdf_page=1 printed_label=i part=front -->\n## 1 SCOPE\n<!-- x -->text\n<!-- pdf_page=2 part=specification -->\n2.1 more")
    got = files.paged_markdown(spark, str(tmp_path / "md"))
    assert [tuple(r) for r in got.orderBy("pdf_page").collect()] == [("std", 1, "i", None, "front", "## 1 SCOPE\ntext"), ("std", 2, None, None, "specification", "2.1 more")]
    over = files.overlay(got.select("doc", "pdf_page", "body"), spark.createDataFrame([("std", 2, "x"), ("std", 3, "new")], "doc string, pdf_page int, body string"), ["doc", "pdf_page"])
    assert [r.body for r in over.orderBy("pdf_page").collect()] == ["## 1 SCOPE\ntext", "2.1 more", "new"]
    (tmp_path / "zip").mkdir()
    for name, members in {"a.zip": {"top/x.json": "{}", "top/d/y.md": "y"}, "bad.zip": {"../evil": "x"}}.items():
        with zipfile.ZipFile(tmp_path / "zip" / name, "w") as z:
            for m, c in members.items():
                z.writestr(m, c)
    (tmp_path / "zip" / "no.zip").write_text("no zip")
    assert sorted((r.package, r.path) for r in files.packages(spark, str(tmp_path / "zip")).collect()) == [("a.zip", "d/y.md"), ("a.zip", "x.json")]
    (tmp_path / "e.jsonl").write_text('{"seq": 1, "type": "log"}\nnot json\n{"seq": 2, "type": "done"}\n')
    schema = spark.createDataFrame([], "seq long, type string").schema
    rows = files.json_rows(spark, str(tmp_path / "e.jsonl"), schema, lines=True)
    assert [r.seq for r in files.tail(rows, ["seq"], 1).collect()] == [2]
    (tmp_path / "t.csv").write_text("name,A\nx,1.5\ny,bad\n")
    assert [r.A for r in files.property_table(spark, str(tmp_path / "t.csv"), ["A"]).orderBy("name").collect()] == [1.5, None]
    lines = spark.createDataFrame(list(enumerate(["| g | v |", "|---|---|", "| a | 1 |", "|  | 2 |", "no"])), "pos int, line string").withColumn("doc", F.lit("d"))
    assert [(r.cells[1], r.group) for r in files.pipe_table(lines, ["doc"], "pos", "line").orderBy("pos").collect()] == [("v", "g"), ("1", "a"), ("2", "a")]
    assert spark.range(1).select(files.number_runs(F.lit("12 345  6.7   8"))).first()[0] == ["12345", "6.7", "8"]
    assert files.jobs(files.listing(spark, str(tmp_path / "zip"))).collect()[0].files == 3
    assert files.manifest(spark, str(tmp_path / "md")).first().bytes > 0
    sse = 'data: {"type": "token", "text": "a"}\n\n: keep\n\ndata: plain\ndata: two\n\n'
    blocks = spark.range(1).select(files.server_events(F.lit(sse)).alias("b")).first().b
    assert blocks == ['{"type": "token", "text": "a"}', "plain\ntwo"]
    r = spark.createDataFrame([(b,) for b in blocks], "b string").select(files.event_row(F.col("b"), ["token"]).alias("e")).collect()
    assert [tuple(x.e) for x in r] == [("token", "a"), ("log", "plain\ntwo")]


def test_stream_equals_batch(spark):
    from ferrule.streaming.events import replay

    batch = plans.table(spark, SF, "events")
    assert sorted(map(str, replay(spark, batch).collect())) == sorted(map(str, batch.collect()))


def test_stream_keeps_events_of_any_age(spark):
    from ferrule.streaming.events import replay

    batch = spark.range(1, 201).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(cast(id * 37 % 400 as int))").alias("ts"), F.lit("log").alias("event_type"), F.lit(1.0).alias("value")).repartition(20)
    assert sorted(map(str, replay(spark, batch).collect())) == sorted(map(str, batch.collect()))


def test_sampling_and_outcomes(spark):
    a = sorted(map(tuple, sampling.realisations(spark, 30, ["s1", "s2"], 2, seed=4).collect()))
    assert a == sorted(map(tuple, sampling.realisations(spark, 30, ["s1", "s2"], 2, seed=4, block=7).collect()))
    assert len(a) == 30 * 8 and all(-0.01 <= v <= 1.5 for _, _, v in a)
    got = spark.createDataFrame([("crash in purchase",), ("crash",), ("x",)], "t string").select(events.classify(F.col("t"))).collect()
    assert [r[0] for r in got] == ["final", "retryable", "other"]


def test_shared_folder(spark, tmp_path):
    from ferrule import shared
    from ferrule.operators import graphs

    path = shared.new_path(spark)
    spark.range(3).write.parquet(path)
    assert path.startswith(shared.shared_dir(spark)) and os.path.exists(path.removeprefix("file:"))
    assert shared.release(spark) >= 1 and not os.path.exists(path.removeprefix("file:")) and shared.release(spark) == 0
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)], "src long, dst long")
    with pytest.raises(RuntimeError, match="goes on"):
        graphs.closure(edges, spark.createDataFrame([(0,)], "node long"), most=2)


def test_everything_is_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(e.oracle_sql()) <= names and set(plans.QUERIES) <= names


def test_sinks_and_columns(spark, tmp_path):
    from ferrule.sources import sinks

    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "id long, body string")
    sinks.write_index(docs, str(tmp_path / "index"), "id", "body")
    assert sorted(map(tuple, sinks.read_postings(spark, str(tmp_path / "index"), ["a", "c"]).collect())) == [("a", 1, 2, [0, 2]), ("c", 2, 1, [1])]
    sinks.write_csv(docs, str(tmp_path / "csv"), ["body", "no", "id"])
    assert sorted(tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True).where("body is not null").collect()) == [("a b a", None, "1"), ("b c", None, "2")]
    sinks.write_text(spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "g int, o int, l string"), str(tmp_path / "text"), "g", "o", "l")
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["x", "y"]
    sinks.write_json(docs, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    page = "left one      right one\nleft two      right two"
    assert X.linear_of(page) == "left one\nleft two\nright one\nright two" and X.gutter_of(["abc def"]) is None


def test_section_geometry(spark):
    import numpy as np

    from ferrule.operators import geometry

    channel = [(50.0, 0.0), (0.0, 0.0), (0.0, 120.0), (40.0, 120.0), (40.0, 105.0)]
    df = spark.createDataFrame([([dict(zip("xy", p, strict=True)) for p in channel], 2.0), ([], 2.0)], "p array<struct<x:double,y:double>>, t double")
    got = [r[0] for r in df.select(geometry.properties(F.col("p"), F.col("t"))).collect()]
    fine = []
    for (x1, y1), (x2, y2) in zip(channel, channel[1:], strict=False):
        n, length = 4000, math.hypot(x2 - x1, y2 - y1)
        u = (np.arange(n) + 0.5) / n
        fine.append(np.stack([x1 + u * (x2 - x1), y1 + u * (y2 - y1), np.full(n, 2.0 * length / n)]))
    x, y, a = np.concatenate(fine, axis=1)
    cx, cy = (x * a).sum() / a.sum(), (y * a).sum() / a.sum()
    ixx, iyy, ixy = ((y - cy) ** 2 * a).sum(), ((x - cx) ** 2 * a).sum(), ((x - cx) * (y - cy) * a).sum()
    low, high = np.linalg.eigvalsh([[ixx, -ixy], [-ixy, iyy]])
    assert [got[0].area, got[0].x, got[0].y, got[0].ixx, got[0].iyy, got[0].ixy, got[0].i1, got[0].i2] == pytest.approx([a.sum(), cx, cy, ixx, iyy, ixy, high, low], rel=1e-4)
    assert got[1] is None

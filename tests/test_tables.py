"""Exact tables: the answers that are known, and every narrowing by a plain loop."""

import random
import re

from pyspark.sql import functions as F

from ferrule.operators import lookup, tables

SCHEMA = "doc string, table_id string, label string, title string, excerpt string, part string, collection string, superseded boolean, caption_verified boolean, structured_row boolean, continued boolean, row_of_table boolean, toc boolean, num_rows int, pdf_page int"


def test_only_the_table_asked_for(spark):
    def tab(tid, title, excerpt, **kw):
        r = dict.fromkeys(x.split()[0] for x in SCHEMA.split(", ")) | {"doc": "d", "table_id": tid, "title": title, "excerpt": excerpt, "part": "standard", "collection": "specification", "num_rows": 3, "pdf_page": 2} | kw
        return tuple(r.values())

    rows = [
        tab("9(a)", "Table 9(a) Zebra class a", "| 1 | 2 |"), tab("9(b)", "Table 9(b) Zebra class b", "| 1 | 2 |"), tab("39", "Table 39 Lengths", "see Table 9 and Table 6 for values"), tab("6", "Table 6 Channels", "| a | b |"),
        tab("20x6", "20 x 6 section properties (Table 6)", "| 6 | 6 |", structured_row=True, caption_verified=True, label="QK20X6"), tab("C-1", "only here", "", part="commentary"), tab(None, "Fig. 10 thing", ""), tab(None, "Fig. 1 thing", None),
    ]
    asked = [(q, q, False) for q in ("Table 9", "Table 20", "Table 6", "QK20X6", "C-1", "Fig. 1", "")] + [("want 9", "9", True), ("want c", "c-1", True), ("none", None, None)]
    got = tables.exact_tables(spark.createDataFrame(asked, "qid string, asked string, want_commentary boolean"), spark.createDataFrame(rows, SCHEMA)).orderBy("qid", "rank").collect()
    found = {q: [r.table_id for r in got if r.qid == q] for q in {r.qid for r in got}}
    assert found == {"Table 9": ["9(a)", "9(b)"], "Table 6": ["6"], "QK20X6": ["20x6"], "C-1": ["C-1"], "want c": ["C-1"], "Fig. 1": [None]}


def test_narrowing_by_a_plain_loop(spark):
    rng = random.Random(3)
    maybe = lambda *x: rng.choice(x)
    rows = [
        (maybe("d", "e"), maybe(None, "9", "9(a)", "9(b)", "10", "1 0", "x9"), maybe(None, None, "L9"), maybe("Table 9", "Fig. 9", "Fig. 91", None, "L9 and 10"), maybe(None, "9", "z"), maybe(None, "commentary", "standard"), maybe("specification", "opensees", None),
         maybe(None, False, True), maybe(None, True), maybe(None, False, True), maybe(None, True), maybe(None, True, False), maybe(None, True), maybe(None, 0, 3, 9), i)
        for i in range(90)
    ]
    asked = [("a", "Table 9", False), ("b", "9", True), ("c", "10", False), ("d", "L9", False), ("e", "Fig. 9", False), ("f", "table 9 (A)", False), ("g", "91", False), ("h", "x", True)]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def plain(sample, q, want):
        q = re.sub(r"(?i)^\s*table\s+", "", q).replace(" ", "").lower()
        flat = lambda s: (s or "").replace(" ", "").lower()
        spec = lambda r: r["collection"] == "specification"
        own = lambda r: q in (flat(r["table_id"]), flat(r["label"]))
        blob = lambda r: flat((r["title"] or "") + " " + (r["excerpt"] or ""))
        hit = [r for r in sample if own(r) or (re.search(re.escape(q) + r"(?!\d)", blob(r)) if q.startswith("fig.") else q in blob(r))]
        right = lambda r: not spec(r) or (r["part"] == "commentary") == want
        hit = [r for r in hit if right(r)] or ([] if want else hit)
        for keep in (lambda r: flat(r["table_id"]), own, lambda r: not r["superseded"]):
            hit = [r for r in hit if keep(r)] or hit
        sure = lambda r: r["caption_verified"] or r["structured_row"]
        if any(map(sure, hit)):
            hit = [r for r in hit if sure(r)] + [r for r in hit if not sure(r) and r["continued"]]
        hit = [r for r in hit if not r["row_of_table"]] or hit
        if not any(map(own, hit)) and re.fullmatch(r"\d+[a-z]?", q):
            hit = [r for r in hit if re.fullmatch(re.escape(q) + r"\([a-z]\)", flat(r["table_id"]))]
        rank = {"specification": 0, "opensees": 1}
        hit.sort(key=lambda r: (flat(r["table_id"]) != q, rank.get(r["collection"], 9), not r["table_id"], bool(r["toc"]), bool(r["continued"]), not r["num_rows"], -(r["num_rows"] or 0), r["pdf_page"]))
        seen, out = set(), []
        for r in hit:
            key = (r["doc"], r["table_id"] or "title:" + (r["title"] or "")[:40], r["part"])
            if key not in seen:
                seen.add(key)
                out.append(r["pdf_page"])
        return out[:5]

    questions = spark.createDataFrame(asked, "qid string, asked string, want_commentary boolean")
    for size in (90, 25, 8, 0):
        sample = rows[:size]
        got = tables.exact_tables(questions, spark.createDataFrame(sample, SCHEMA), 5).orderBy("qid", "rank").collect()
        want = {i: plain([dict(zip(names, r)) for r in sample], q, w) for i, q, w in asked}
        assert {i: [r.pdf_page for r in got if r.qid == i] for i, _, _ in asked} == want, size


def test_narrow_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1, True), (None, 2, None), ("a", 3, None), ("a", 4, False), ("b", 5, True)], "k string, v int, c boolean")
    assert sorted(r.v for r in lookup.narrow(df, ["k"], [F.col("v") > 0, F.col("c")]).collect()) == [1, 3, 4, 5]

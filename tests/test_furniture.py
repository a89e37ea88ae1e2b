"""Running titles and page furniture by a plain loop, and the way a question takes until something answers it."""

import re

from pyspark.sql import functions as F

from ferrule.operators import furniture, search


def test_running_titles_by_a_plain_loop(spark):
    texts = [
        "9.2-15\nPrequalified Connections for Special and Intermediate Steel\nMoment Frames for Seismic Applications, and more\nbody\n[Sect. 2.1 short\n[Sect. 2.1 " + "long " * 20,
        "Moment Frames for Seismic Applications, and more\n\n Comm. 3 x\nComm. A x\n[Comm. B\n",
        "see Seismic Provisions for Structural Steel Buildings, September 26, 2022 here\nSeismic Provisions for Structural Steel Buildings\r\nSeptember 26, 2022 page 3\r\nSeptember 26, 2022",
        "Downloaded from ascelibrary.org by x\nASCE/SEI 7-22\nthe ASCE/SEI 7-22\nCopyright ASCE; all rights reserved. y\ncopyright asce\nc",
        "12 Chapter A\n12\nA-3\nC\nmix\nAISI S100-16 (R2020) w/S3-22\nStructural Members With Supplement 3 1-1\n12 Chapter " + "long " * 30,
        "ii AISI S240-20-C\nThis document is copyrighted by x\nAISI S230-19\n78 aisi s230-19-C\nNorth American Standard for Cold-Formed Steel Structural Framing, 2020 Edition 12\nStandard for Cold-Formed Steel Framing—Prescriptive Method for One- and Two-Family Dwellings, 2019 Edition",
        "a\x0bb c\x85d", "", None,
    ]

    def plain(text, p):
        out, before = [], ""
        text = text or ""
        for phrase in p.phrases:
            text = re.sub(phrase, "", text, flags=re.I)
        hit = lambda pattern, t: re.fullmatch(pattern, t, re.I) is not None
        for line in text.splitlines():
            t = line.strip()
            goes = any(hit(x, t) for x in p.lines) and t.lower() not in p.kept
            goes |= any(hit(x, t) and len(t) < n for x, n in p.short)
            goes |= any(hit(a, before) and hit(b, t) for a, b in p.after)
            before = t
            if not goes:
                out.append(line)
        return "\n".join(out)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for name, profile in furniture.PROFILES.items():
        got = df.select("i", furniture.strip_running_titles(F.col("t"), name).alias("x")).orderBy("i").collect()
        assert [r.x for r in got] == [plain(t, profile) for t in texts], name
    two = df.where("i < 2").orderBy("i").select(furniture.strip_running_titles(F.col("t"), "aisc_358")).collect()
    assert [r[0] for r in two] == ["body\n[Sect. 2.1 " + "long " * 20, "Moment Frames for Seismic Applications, and more\n\nComm. A x"]


def test_labels_and_furniture(spark):
    cases = {
        ("x With Supplement 3 B-5",): "B-5", ("IV Chapter A",): "iv", ("C Chapter A", "7"): "7", ("78 AISI S240-20",): "78", ("XII",): "xii", ("c", "16.1 -VIII"): "16.1-viii", ("9.2 - 15 of 9.1-4",): "9.2-15",
        ("9.1–45",): "9.1-45", ("16.1 Comm. F2.]", "-377"): "16.1-377", ("9.1 x", "-ii"): "9.1-ii", ("9.1 and 9.2", "-12"): "2", ("Edition S400 3", "x, August 18, 2022", "chapter 9"): "9", ("Seismic Design, 2020 Edition 59",): "59", ("none",): None, (): None,
    }
    got = spark.createDataFrame([(list(k),) for k in cases], "t array<string>").select(furniture.printed_label(F.col("t"))).collect()
    assert [r[0] for r in got] == list(cases.values())
    rows = [(1, 2, "page_header", "body", "Copyright 2020"), (1, 1, "page_footer", "body", "9.1-4"), (1, 0, "text", "furniture", "Title"), (1, 3, "text", "body", "no"), (2, 0, "text", "body", "no"), (3, 0, "page_header", None, None)]
    got = furniture.furniture_by_page(spark.createDataFrame(rows, "page int, seq int, label string, layer string, text string"), ["page"]).orderBy("page").collect()
    assert [tuple(r) for r in got] == [(1, ["Title"], ["9.1-4", "Copyright 2020"], "9.1-4"), (3, [None], [], None)]


def test_questions_go_on_until_something_answers(spark):
    world = {"id": {"1": [10]}, "fts": {"1": [20], "steel": [21, 22], "beam": [23]}, "keyword": {"ste": [30], "steel": [31]}}
    seen = []

    def way(name):
        def find(q):
            rows = [tuple(r) for r in q.select("qid", "text").collect()]
            seen.append((name, sorted(t for _, t in rows)))
            hits = [(i, d, n + 1) for i, t in rows for n, d in enumerate(world[name].get(t, []))]
            return spark.createDataFrame(hits, "qid string, doc long, rank int")

        return find

    questions = spark.createDataFrame([("a", "1"), ("b", "steel"), ("c", "ste"), ("d", "none"), ("e", "void"), ("f", "1"), ("g", "void")], "qid string, text string")
    aliases = spark.createDataFrame([("d", 0, "none"), ("d", 1, "zz"), ("d", 2, "beam"), ("d", 3, "steel"), ("e", 6, "steel"), ("b", 0, "beam")], "qid string, ord int, text string")
    got = search.answer(questions, questions.where("qid = 'f'"), way("id"), way("fts"), way("keyword"), aliases)
    assert sorted(map(tuple, got.select("qid", "doc", "rank", "stage", "alias").collect())) == [("a", 10, 1, "id", None), ("b", 21, 1, "fts", None), ("b", 22, 2, "fts", None), ("c", 30, 1, "keyword", None), ("d", 23, 1, "alias", "beam")]
    assert seen == [("id", ["1", "none", "ste", "steel", "void", "void"]), ("fts", ["none", "ste", "steel", "void", "void"]), ("keyword", ["none", "ste", "void", "void"]), ("fts", ["beam", "steel", "zz"])]

"""Full-text search held against plain loops over every document."""

import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from ferrule import plans
from ferrule.functions import text as X
from ferrule.operators import search
from ferrule.operators.retrieval import tokens
from ferrule.plans.retrieval import ALIASES, ASKED, QUESTIONS

SF = "/root/testdata/sf0.001"
plans.load()


def terms_of(text):
    return [X.stem(w) for w in re.findall(r"[^\W_]+", X.fts_normal_of(text).lower())]


def clauses_of(question, terms=terms_of):
    out = []
    for part in re.findall(r'"[^"]+"|\S+', X.fts_normal_of(question)):
        if len(part) > 2 and part[0] == part[-1] == '"':
            out.append([part])
            continue
        for bit in re.split(r"[-–—/]+", part):
            bit = re.sub(rf"[^\w.{search.KEEP}]", "", bit)
            if bit:
                out.append([bit, " ".join(bit)] if re.fullmatch(r"\d+\.\d+", bit) else [bit])
    return [c for c in ([p for p in (terms(f) for f in forms) if p] for forms in out) if c]


def test_stemmed_search_against_a_loop(spark):
    docs = {r.doc_id: terms_of(r.text or "") for r in plans.table(spark, SF, "documents").collect()}
    average = sum(map(len, docs.values())) / len(docs)
    count = lambda w, p: sum(w[i : i + len(p)] == p for i in range(len(w) - len(p) + 1))
    want = {}
    for qid, question in QUESTIONS:
        asked = clauses_of(question)
        tf = {tuple(p): {d: n for d, w in docs.items() if (n := count(w, p))} for c in asked for p in c}
        for d, w in docs.items():
            if asked and all(any(d in tf[tuple(p)] for p in c) for c in asked):
                score = 0.0
                for hits in tf.values():
                    odds = math.log((len(docs) - len(hits) + 0.5) / (len(hits) + 0.5))
                    n = hits.get(d, 0)
                    score -= (odds if odds > 0 else 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / average))
                want[qid, d] = score
    got = {(r.qid, r.doc_id): r.score for r in plans.QUERIES["fts_search_stemmed"](spark, SF).collect()}
    assert want and got == pytest.approx(want, abs=1e-5)


def test_clauses_and_variants(spark):
    cases = {"a": 'lateral-torsional "bolt group" (1.50)', "b": "Ψ v2.1 a_b --- !", "c": "", "d": '"" "x"', "e": "relational — databases/hopping"}
    df = spark.createDataFrame([*cases.items(), ("f", None)], "qid string, text string")
    got = {}
    for r in search.clauses(df, "qid", "text").collect():
        got.setdefault(r.qid, {}).setdefault(r.clause, []).append(r.phrase)
    assert {q: [sorted(c) for _, c in sorted(v.items())] for q, v in got.items()} == {q: w for q, t in cases.items() if (w := [sorted(map(list, set(map(tuple, c)))) for c in clauses_of(t)])}
    asked = search.variants(spark.createDataFrame(QUESTIONS, "qid string, text string"), "qid", "text", ALIASES, tokens)
    assert sorted(tuple(r) for r in asked.collect()) == sorted(ASKED)


def test_alias_and_extra_tokens(spark):
    groups = [["E250", "grade 250"], ["of the", "des"], ["Z", "zone"], ["Straße", "road"], ["SBC", "bearing"]]
    texts = ["e250 E250.", "GRADE 2500", "out of\n\ntheir", "z Zones zone-", "STRASSE", "Sbc sbc SBC/x", "sbc (BEARING)", "", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(search.alias_tokens(F.col("t"), groups)).collect()]

    def loop(t):
        blob = unicodedata.normalize("NFKC", t)
        low = " " + re.sub(r"\s+", " ", blob.casefold()) + " "
        words = set(re.findall(r"[\w/∆.\-]+", blob))
        words |= {w.strip(".-") for w in words}
        out = []
        for g in groups:
            ok = lambda x: f" {x.casefold()}" in low if " " in x else x in words if len(x) <= 4 else x.casefold() in {w.casefold() for w in words}
            if any(len(x) >= 2 and ok(x) for x in g):
                out += [x for x in g if len(x) >= 2]
        return list(dict.fromkeys(out))

    assert [g or [] for g in got] == [loop(t or "") for t in texts]
    r = spark.createDataFrame([("0.12h0.34 Fe  250 k 3 K4 k3 ﬁ 1.5kN2 E 99",)], "t string").select(search.extra_tokens(F.col("t"))).first()[0]
    assert r == ["0.12 h 0.34", "1.5 kN 2", "Fe250", "k3", "k4"]


def test_one_hit_a_page_and_first_variant(spark):
    rows = [("q", "p1", -5.0, 1, 3), ("q", "p1", -4.5, 2, 1), ("q", "p1", -3.6, 3, 0), ("q", "p1", -3.0, 4, 0), ("q", "p2", -1.0, 5, 0), ("r", "p1", 2.0, 6, 2)]
    df = spark.createDataFrame(rows, "qid string, page string, score double, doc long, kind int")
    got = sorted(tuple(r) for r in search.one_a_page(df, ["page"], F.col("kind")).select("qid", "page", "doc", "collapsed").collect())
    assert got == [("q", "p1", 3, 3), ("q", "p2", 5, 0), ("r", "p1", 6, 0)]  # 2 takes the place of 1, and 3 that of 2
    scored = spark.createDataFrame([("q", v, d, float(s)) for v, d, s in [(0, 1, -1), (1, 1, -9), (1, 2, -3)] + [(0, 100 + i, -50 + i / 2) for i in range(70)]], "qid string, variant int, doc long, score double")
    got = {r.doc: (r.score, r.variant) for r in search.first_variant(scored, 2).collect()}
    assert got[2] == (-3.0, 1) and got[1] == (-9.0, 1) and len(got) == 62  # 1 is beyond the first sixty of variant 0
    last = search.ranked(spark.createDataFrame([("q", -9.0, 1, True), ("q", -1.0, 2, False), ("q", 3.0, 3, None)], "qid string, score double, doc long, b boolean"), F.col("b"), 2)
    assert sorted((r.rank, r.doc) for r in last.collect()) == [(1, 2), (2, 3)]


def test_alias_words_are_looked_for_once_a_text(spark):
    df = spark.createDataFrame([("..License-- of the. the -y- .Clown",), ("...",), (None,)], "t string").select(search.alias_tokens(F.col("t"), [["the"], ["license"], ["of the"], ["clown"], ["y", "et"]]).alias("a"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2
    assert [r.a for r in df.collect()] == [["the", "license", "of the", "clown"], [], []]

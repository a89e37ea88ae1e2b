"""Texts that are their own normal form do not pass through Python workers, and come out as they would from there."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from ferrule import plans
from ferrule.functions import text as X

plans.load()
PLAIN = "Die Straße – «Ärger» of you, 12 V. k5 v2"
HARD = "ﬁne ΣΑΣ f y"
OF = {
    "nfkc": lambda x: None if x is None else unicodedata.normalize("NFKC", x),
    "casefold": lambda x: None if x is None else x.casefold(),
    "nfkc_folded": lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold(),
    "fts_normal": X.fts_normal_of,
}


def texts():
    """Every character alone and among others, and the parts of the rules' forms in any order."""
    chars = [chr(k) for low, high in X.SCRIPTS for k in range(low, high + 1)]
    out = [None, "", PLAIN, HARD, *chars, *[f"aZ{c}y k{c}2 f{c}y f y{c} {c}f y K{c}d" for c in chars], "".join(c for c in chars if not re.match(r"[\x00-\x1f\x85]", c))]
    bits = ["k", "K", "V", "p", "C", "pe", "γ", "m", "f", "A", "h", "T", "a", "S", "/", "g", "E", "Fe", "250", "600", "y", "M", "d", "0", "1", "4", ".", "0.12", "x", " ", "\n", "\t", "\x1c", "\x85", "é", "_", "-", "ﬁ", "́", " ", " ", "٣"]
    rng = random.Random(7)
    return out + ["".join(rng.choice(bits) for _ in range(rng.randint(2, 9))) for _ in range(6000)]


@pytest.mark.parametrize("name", OF)
def test_as_python_has_it(spark, name):
    rows = list(enumerate(texts()))
    got = {r.i: r.x for r in spark.createDataFrame(rows, "i int, t string").select("i", getattr(X, name)("t").alias("x")).collect()}
    assert [(t, got[i]) for i, t in rows if got[i] != OF[name](t)] == []


@pytest.mark.parametrize("name", OF)
def test_plain_texts_stay_out_of_python(spark, monkeypatch, name):
    """What reaches the function is null for a plain text and the text for another."""
    monkeypatch.setattr(X, f"_{name}", lambda c: F.coalesce(F.concat(F.lit("python: "), c), F.lit(None).cast("string")))
    got = [r[0] for r in spark.createDataFrame([(PLAIN,), (HARD,), (None,)], "t string").select(getattr(X, name)("t")).collect()]
    assert got == [OF[name](PLAIN), f"python: {HARD}", OF[name](None)]


def test_keywords_send_no_plain_text_to_python(spark):
    plan = plans.QUERIES["keyword_all_terms_any_alias"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "RLIKE" in plan

"""Names in texts by brute force over ten thousand of them, the name a question asks for, and misses."""

import random
import re

from pyspark.sql import functions as F

from ferrule.operators import names as N


def test_ten_thousand_names_in_one_pass_by_brute_force(spark):
    draw = random.Random(12)
    syllables = ["pra", "lo", "mi", "ten", "gu", "sha", "é", "8", "vo", "kan"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randrange(1, 4)))
    names = {" ".join(word() for _ in range(draw.choice([1, 1, 2, 3]))) for _ in range(14_000)}
    names = sorted(names)[:10_000]
    texts = [(k, draw.choice([" ", "-", ", ", "\n"]).join(draw.choice([word(), draw.choice(names).title()]) for _ in range(draw.randrange(0, 40)))) for k in range(120)] + [(997, None), (998, ""), (999, "!?")]
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    known, want = {tuple(split(n)): n for n in names}, set()
    for k, text in texts:
        own = split(text)
        want |= {(k, i, known[tuple(own[i : i + n])]) for i in range(len(own)) for n in (1, 2, 3) if i + n <= len(own) and tuple(own[i : i + n]) in known}
    listed = N.dictionary(spark.createDataFrame([(n, n[:2]) for n in [*names, "--", names[0]]], "name string, group string"))
    got = N.mentions(spark.createDataFrame(texts, "k long, text string").withColumn("extra", F.lit(1)), listed).collect()
    assert {(r.k, r.pos, r.name) for r in got} == want and len(got) == len(want) > 1000


def test_a_question_asks_for_its_longest_name_and_nothing_else(spark):
    names = N.dictionary(spark.createDataFrame([("Delhi", "d"), ("New Delhi", "d"), ("Port Blair", "p"), ("Pune", "u"), ("Poona", "u")], "name string, group string"))
    asked = ["seismic zone of New Delhi", "Basic wind speed at PORT-BLAIR?", "wind in Pune and who lives there", "delhi", "zone of nowhere", "Pune or Poona", "zone in Pune, Pune, the city of Pune", None, "", "Puneet zone", "wind speed in the city of the town of the zone at Pune"]
    got = {r.qid: r.name for r in N.asked_name(spark.createDataFrame(list(enumerate(asked)), "qid int, text string"), names).collect()}
    assert got == {0: "New Delhi", 1: "Port Blair", 3: "Delhi", 6: "Pune"}


def test_answers_variants_following_pages_and_misses(spark):
    names = N.dictionary(spark.createDataFrame([("Pune", "u"), ("Poona", "u"), ("Leh", "l"), ("Agra", "a"), ("Goa", "g")], "name string, group string"))
    pages = [("A", 1, "intro Agra", ""), ("A", 5, "Annex\n Agra 47 \nAgra again", "annex"), ("A", 6, "Poona 39", ""), ("A", 7, "Leh 33", ""), ("B", 2, "Pune x", "annex"), ("B", 3, "Leh", "committee"), ("C", 1, "none", "annex")]
    df = spark.createDataFrame(pages, "doc string, page long, text string, flags string")
    listing = N.listing_pages(df, F.col("flags") == "annex", F.col("flags") == "committee")
    assert sorted((r.doc, r.page) for r in listing.collect()) == [("A", 5), ("A", 6), ("B", 2), ("C", 1)]
    hits, misses = N.name_answers(spark.createDataFrame([(1, "zone Agra"), (2, "wind speed Pune"), (3, "zone Leh"), (4, "tell me of Goa")], "qid int, text string"), names, listing)
    assert sorted(tuple(r) for r in hits.collect()) == [(1, "Agra", "A", 5, 1, "Agra", "Agra 47"), (2, "Pune", "A", 6, 0, "Poona", "Poona 39"), (2, "Pune", "B", 2, 0, "Pune", "Pune x")]
    assert sorted((tuple(r) for r in misses.collect()), key=str) == sorted([(1, "Agra", "B"), (1, "Agra", "C"), (2, "Pune", "C"), (3, "Leh", None)], key=str)

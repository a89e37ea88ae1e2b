"""URL filters against plain loops over all rules, and on odd input."""

import random
import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from ferrule.llm import url_filters
from ferrule.llm.common import table

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
SOUND = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def verdict(url, rules, default="allow"):
    host, path = parts(url)
    fits = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3] if fits else None, max(fits)[4] if fits else default)


def test_query_against_all_rules(spark):
    got = {r.page_id: tuple(r)[1:] for r in url_filters.op13_url_filters(spark, "/root/testdata/sf0.01").collect()}
    pages = table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url").collect()
    assert got == {r.page_id: verdict(r.url, SOUND) for r in pages}
    assert {v[3] for v in got.values()} == {"allow", "block"} and len({v[2] for v in got.values()}) >= 4


def test_any_rules_against_loops(spark):
    """Rules that end inside a segment, hosts of many labels, ties of length, both actions for one rule."""
    draw = random.Random(13)
    label, step = lambda: draw.choice(["a", "b", "ab", "ba"]), lambda: draw.choice(["/a", "/b", "/ab", "/", "/abc"])
    urls = [f"{draw.choice(['http', 'HTTPS', ''])}://{'.'.join(label() for _ in range(draw.randrange(1, 5)))}{''.join(step() for _ in range(draw.randrange(5)))}{draw.choice(['', '?a=/b', '#/a'])}" for _ in range(1500)]
    rules = [(".".join(label() for _ in range(draw.randrange(1, 4))), "".join(step() for _ in range(draw.randrange(4))), draw.choice(["allow", "block"])) for _ in range(150)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filters.judge(pages, spark.createDataFrame(rules, "host string, path string, action string"), default="block").collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {i: verdict(u, rules, "block") for i, u in enumerate(urls)}


def test_odd_input(spark):
    deep = "http://" + "x." * 30_000 + "com/" + "y/" * 30_000
    urls = [None, "", "no scheme.com/en/", "http://", "://com/", "http://COM/", "http://com", "http://com?/", "http://com#://net/es/", "http://user@example.com:80/en/", "http://a.NET/es/x", "http://com./", "http://notcom/", "http://ünï.com/ü", "x\ny://net/fr/\nz", deep]
    pages = spark.createDataFrame([(n % 5 or None, u) for n, u in enumerate(urls)] * 2, "page_id long, url string").withColumns({"host": F.lit("clash"), "path": F.lit(1), "rule": F.lit(None), "verdict": F.lit("x"), "e": F.lit(2)})
    rules = spark.createDataFrame([*SOUND, ("EXAMPLE.com", "/EN/", "block"), (None, "/", "block"), ("", None, "block"), ("net", None, "delete"), ("org", None, "block"), ("com", "/", "allow")], "host string, path string, action string")
    sound = [*SOUND, ("example.com", "/EN/", "block"), ("org", "", "block")]
    got = url_filters.judge(pages, rules.withColumn("short", F.lit("clash"))).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((n % 5 or None, *verdict(u, sound))) for n, u in enumerate(urls) for _ in range(2))
    assert url_filters.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.judge(pages, rules.limit(0)).collect()} == {"allow"}

"""Names of a dictionary in texts and questions: whole words, longest first, variants of one thing, and what is not listed.

A dictionary is a table of any size. A run of words is joined with the names as a key, after the first word has shown that a name may begin there, so
one pass finds all names and no text meets a name that it does not hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that a question about a town may hold beside its name, and how many of them.
BESIDE = ("zone", "seismic", "factor", "basic", "wind", "speed", "vb", "z", "earthquake", "for", "of", "in", "at", "the", "city", "town", "is", "1893", "875", "part", "3", "annex", "a", "e", "value", "what", "m", "s", "ms", "velocity", "design", "and")
MOST_BESIDE = 6


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case; none of null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def dictionary(names: DataFrame, name: str = "name", group: str = "group") -> DataFrame:
    """``(name, group, key, first, n)``: names by their words; one without a word is none, and a name listed twice for a group counts once."""
    own = words(F.col(name))
    return names.select(F.col(name).alias("name"), F.col(group).alias("group"), own.alias("w")).where(F.size("w") > 0).select("name", "group", F.array_join("w", " ").alias("key"), F.get("w", F.lit(0)).alias("first"), F.size("w").alias("n")).distinct()


def mentions(texts: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """Every mention of a name of ``dictionary`` in ``texts``: their other columns and ``pos`` (of its first word, from 0), ``n``, ``name``, ``group``, ``key``.

    A name is found wherever its words follow each other, whatever stands between them; overlapping names are all found. The longest name bounds the run
    that goes with a position. A first word that very many texts hold is a hot key only if it begins a name, and then AQE splits it.
    """
    most = names.agg(F.max("n")).first()[0] or 1
    rest = [c for c in texts.columns if c != text]
    w = words(F.col(text))
    runs = F.transform(F.array(w), lambda a: F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.slice(a, i, most))).otherwise(F.array().cast("array<array<string>>")))[0]
    begun = texts.select(*rest, F.posexplode(runs).alias("pos", "run")).withColumn("first", F.get("run", F.lit(0))).join(names.select("first").distinct(), "first", "left_semi")
    grams = F.transform(F.sequence(F.lit(1), F.size("run")), lambda k: F.array_join(F.slice("run", 1, k), " "))
    return begun.select(*rest, "pos", F.explode(grams).alias("key")).join(names.drop("first"), "key").select(*rest, "pos", "n", "name", "group", "key")


def asked_name(questions: DataFrame, names: DataFrame, beside: tuple[str, ...] = BESIDE, most: int = MOST_BESIDE) -> DataFrame:
    """``(qid, name, group)`` of ``questions(qid, text)`` that ask for a name: the longest one they hold, then the first in order; what is
    left without its mentions is ``most`` words at most, all of them among ``beside``. Other questions have no row."""
    found = mentions(questions.select("qid", "text"), names)
    best = found.withColumn("__r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.length("name")), "name", "group"))).where("__r = 1").select("qid", "name", "group", "key")
    apart = F.split(F.concat(F.lit(" "), F.array_join(words(F.col("text")), "  "), F.lit(" ")), F.concat(F.lit(" \\Q"), F.replace("key", F.lit(" "), F.lit("  ")), F.lit("\\E ")))
    left = F.filter(F.split(F.array_join(apart, " "), " +"), lambda x: x != "")
    kept = best.join(questions.select("qid", "text"), "qid").withColumn("left", left)
    return kept.where((F.size("left") <= most) & F.forall("left", lambda x: x.isin(*beside))).select("qid", "name", "group")


def listing_pages(pages: DataFrame, listed: Column, excluded: Column) -> DataFrame:
    """Pages of ``pages(doc, page, ...)`` that ``listed`` marks, and the one that follows each, on which a table goes on, unless it is ``excluded``."""
    marked = pages.where(F.coalesce(listed, F.lit(False)))
    after = pages.where(~F.coalesce(excluded, F.lit(False))).join(marked.select("doc", (F.col("page") + 1).alias("page")).distinct(), ["doc", "page"], "left_semi")
    return marked.unionByName(after.join(marked.select("doc", "page").distinct(), ["doc", "page"], "left_anti"))


def name_answers(questions: DataFrame, names: DataFrame, pages: DataFrame, beside: tuple[str, ...] = BESIDE) -> tuple[DataFrame, DataFrame]:
    """What the listing ``pages(doc, page, text)`` say of the names that are asked for.

    First ``(qid, asked, doc, page, line, name, snippet)``: for each document the first line, by page, that has the name or another of its
    group, and that line. Then ``(qid, asked, doc)``: documents that do not list it; ``doc`` is null if none does, which is an explicit miss.
    """
    asked = asked_name(questions, names, beside).withColumnRenamed("name", "asked")
    wanted = names.join(asked.select("group").distinct(), "group", "left_semi")
    lines = pages.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("line", "snippet"))
    found = mentions(lines.withColumn("text", F.col("snippet")), wanted)
    first = found.groupBy("group", "doc").agg(F.min(F.struct("page", "line", "pos", (-F.col("n")).alias("short"), "name", "snippet")).alias("m")).select("group", "doc", "m.page", "m.line", "m.name", F.trim("m.snippet").alias("snippet"))
    hits = asked.join(first, "group").select("qid", "asked", "doc", "page", "line", "name", "snippet")
    every = asked.select("qid", "asked").crossJoin(F.broadcast(pages.select("doc").distinct()))  # a stated question and the few documents that hold listings
    misses = every.join(hits.select("qid", "doc"), ["qid", "doc"], "left_anti")
    none = asked.join(hits.select("qid").distinct(), "qid", "left_anti").select("qid", "asked", F.lit(None).cast(pages.schema["doc"].dataType).alias("doc"))
    return hits, misses.join(none.select("qid"), "qid", "left_anti").select("qid", "asked", "doc").unionByName(none)

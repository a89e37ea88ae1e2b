"""Exact lookups: normalised ids, theta matches with narrowing, candidate ids, conflicts and misses."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import nfkc_folded, ratio, section_id
from ferrule.operators.retrieval import prefer


def squash(c: Column | str) -> Column:
    """An id without case, spaces, dashes and underscores."""
    return F.regexp_replace(F.lower(F.col(c) if isinstance(c, str) else c), r"[ _#-]+", "")


def candidate_ids(c: Column) -> Column:
    """The forms under which an id may be filed, in order and each once: as it is, squashed, its digits alone."""
    return F.array_distinct(F.filter(F.array(F.lower(c), squash(c), F.regexp_extract(c, r"(\d+)", 1)), lambda x: x != ""))


def match_rank(label: Column, asked: Column) -> Column:
    """How an id matches: 1 the same, 2 the same when squashed, 3 a prefix, 4 contained; null if it does not."""
    a, b = squash(label), squash(asked)
    return F.when(label == asked, 1).when(a == b, 2).when(a.startswith(b), 3).when(a.contains(b), 4)


def narrow(df: DataFrame, by: list[str], conditions: list[Column]) -> DataFrame:
    """Conditions in order, each applied only where it leaves the group any row.

    What is left are the rows whose conditions, as a tuple, are the greatest of their group: one maximum that is combined
    before the shuffle, so a group of any size is never sorted or held by one task.
    """
    met = F.struct(*[F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, c in enumerate(conditions)])
    rows = df.withColumn("__met", met)
    best = rows.groupBy(*[F.col(b).alias(f"__{b}") for b in by]).agg(F.max("__met").alias("__best"))
    same = functools.reduce(lambda a, b: a & b, [rows[b].eqNullSafe(best[f"__{b}"]) for b in by])
    return rows.join(best, same & (rows["__met"] == best["__best"])).select(*df.columns)


def not_part(part: Column, other: str) -> Column:
    """Whether a row is not of a part; rows without a part are not."""
    return ~part.eqNullSafe(F.lit(other))


def suggest(misses: DataFrame, qid: str, asked: str, known: DataFrame, name: str, k: int = 8, cutoff: float = 0.5) -> DataFrame:
    """Up to ``k`` of all known names by similarity for each miss, of ``cutoff`` or more, and again in lower case where none is.

    Every name is compared, but for those whose length alone keeps them below the cutoff; each form asked for, once. Of
    equally similar names the greater comes first, as with ``difflib.get_close_matches``.
    """
    w = Window.partitionBy("__a").orderBy(F.desc("similarity"), F.desc(name))
    a, b = F.length("__a"), F.length(name)

    def best(forms: DataFrame, names: DataFrame) -> DataFrame:
        near = forms.crossJoin(names).where(2 * F.least(a, b) >= cutoff * (a + b)).withColumn("similarity", ratio(name, "__a")).where(F.col("similarity") >= cutoff)
        return near.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)

    names = known.select(name).where(F.col(name).isNotNull()).distinct()
    asked_for = misses.select(qid, F.col(asked), F.col(asked).alias("__a")).where(F.col(asked).isNotNull())
    first = asked_for.join(best(asked_for.select("__a").distinct(), names), "__a")
    left = asked_for.join(first.select("__a").distinct(), "__a", "left_anti").withColumn("__a", nfkc_folded("__a"))
    again = left.join(best(left.select("__a").distinct(), names.select(F.lower(name).alias(name))), "__a")
    return first.unionByName(again).select(qid, asked, name, "rank", "similarity")


def exact_sections(questions: DataFrame, sections: DataFrame, limit: int = 20) -> DataFrame:
    """``(qid, rank, doc, part, section_id, id, page)`` of ``questions(qid, text, doc, commentary)`` in ``sections(ord, id, doc, part, collection, section_id, children, synthetic, page, title)``.

    A section answers by its id, without the word before it and a last dot, or by its own key, within the document if one is named. Of the specification
    the part asked for counts, commentary or not; where nothing answers, its commentary does. Of entries of one section (contents, body) that with
    children counts, then a synthetic one, the later page, the longer title, the later row. The specification comes before other collections.
    """
    asked = questions.select("qid", "text", F.col("doc").alias("scope"), F.coalesce("commentary", F.lit(False)).alias("commentary"), section_id(F.col("text")).alias("sid"))
    found = asked.join(sections, F.col("sid") == F.col("section_id")).unionByName(asked.join(sections, F.col("text") == F.col("id"))).where("scope IS NULL OR scope = doc")
    spec, notes = F.coalesce(F.col("collection") == "specification", F.lit(False)), F.coalesce(F.col("part") == "commentary", F.lit(False))
    level = F.when(~spec | (notes == F.col("commentary")), 0).when(~F.col("commentary"), 1)
    met = found.withColumns({"spec": spec, "level": level}).where("level IS NOT NULL")
    first = met.groupBy("qid").agg(F.min("level").alias("level"))
    own = F.when(F.col("spec"), F.concat_ws("\x1f", "doc", "part", "section_id")).otherwise(F.col("ord").cast("string"))
    better = F.struct(F.coalesce("children", F.lit(False)).alias("a"), F.coalesce("synthetic", F.lit(False)).alias("b"), F.coalesce("page", F.lit(0)).alias("c"), F.coalesce(F.length("title"), F.lit(0)).alias("d"), "ord", "doc", "part", "section_id", "id", "page")
    best = met.join(first, ["qid", "level"]).groupBy("qid", "spec", own.alias("own")).agg(F.max(better).alias("m"), F.min("ord").alias("at"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("spec"), "at")).cast("long")
    return best.withColumn("rank", rank).where(F.col("rank") <= limit).select("qid", "rank", "m.doc", "m.part", "m.section_id", "m.id", "m.page")

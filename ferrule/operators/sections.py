"""Slices of paged text: an annex, or a clause of one, from its heading to the next that does not belong to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators.retrieval import bound

#: Fixed patterns: headings of annexes and of their clauses.
ANNEX = r"^\s*(?:#{1,4}\s*)?ANNEX\s*([A-H])\b"
CLAUSE = r"^\s*(?:[-*•]\s+)?(?:#{1,4}\s*)?(?:\*\*)?([A-H]-\d+(?:\.\d+)*)\.?(?:\*\*)?(?:\s|$)"


def between(rows: Column, starts, ends) -> Column:
    """The rows from the first that starts a slice to the one before the next that ends it; null where none starts."""

    def cut(r: Column) -> Column:
        first = F.array_position(F.transform(r, starts), True)
        tail = F.slice(r, F.greatest(first, F.lit(1)).cast("int") + 1, F.size(r))
        stop = F.array_position(F.transform(tail, ends), True)
        body = F.when(stop > 0, F.slice(tail, 1, (stop - 1).cast("int"))).otherwise(tail)
        return F.when(first > 0, F.concat(F.slice(r, F.greatest(first, F.lit(1)).cast("int"), 1), body))

    return bound(rows, cut)


def annex_slice(lines: DataFrame, targets: DataFrame, max_pages: int = 4, max_chars: int = 12000) -> DataFrame:
    """``(doc, sid, start, body)`` of ``targets(doc, sid, start)`` in ``lines(doc, page, pos, line)``.

    ``sid`` is ``Annex X`` or a clause ``X-1.2``; a slice begins at its heading on the pages ``start`` to ``start + max_pages - 1`` and
    ends before the next annex, or, of a clause, before a clause that is not below it. One target's lines are those of
    ``max_pages`` pages, so a group is bounded by the size of pages. A target without its heading has no row.
    """
    t = targets.select("doc", "sid", "start", F.regexp_extract("sid", r"^Annex ([A-H])$", 1).alias("letter"))
    near = lines.join(t, "doc").where((F.col("page") >= F.col("start")) & (F.col("page") < F.col("start") + max_pages))
    annex, clause = F.regexp_extract("line", ANNEX, 1), F.regexp_extract("line", CLAUSE, 1)
    whole = F.col("letter") != ""
    below = (clause == F.col("sid")) | clause.startswith(F.concat("sid", F.lit(".")))
    starts = F.when(whole, annex == F.col("letter")).otherwise(clause == F.col("sid"))
    ends = (annex != "") | (~whole & (clause != "") & ~below)
    rows = F.array_sort(F.collect_list(F.struct("page", "pos", "line", starts.alias("starts"), ends.alias("ends"))))
    got = near.groupBy("doc", "sid", "start").agg(between(rows, lambda x: x["starts"], lambda x: x["ends"]).alias("r")).where("r is not null")
    head = F.regexp_replace(F.get("r", F.lit(0))["line"], r"^\s+|\s+$", "")
    rest = F.transform(F.slice("r", 2, F.size("r")), lambda x: x["line"])
    return got.select("doc", "sid", "start", F.substring(F.array_join(F.concat(F.array(head), rest), "\n"), 1, max_chars).alias("body"))

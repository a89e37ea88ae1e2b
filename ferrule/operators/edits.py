"""Edits of pages that may be applied again and again: tagged blocks after an anchor, superseded lines put aside, missing tokens appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators.retrieval import bound

#: The line that opens what is put aside, and an image's place holder.
ASIDE = "<!-- SUPERSEDED TEXT (replaced by a transcription; kept for audit):"
IMAGE, NEAR = "<!-- image -->", 5


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("\\Q"), c, F.lit("\\E"))


def without_block(text: Column, tag: Column) -> Column:
    """``text`` without its block of that tag and the blank lines around it, for which one stays."""
    mark = lambda end: F.concat(F.lit("<!-- "), _quoted(tag), F.lit(f":{end} -->"))
    return F.regexp_replace(text, F.concat(F.lit("(?s)\n*"), mark("start"), F.lit(".*?"), mark("end"), F.lit("\n*")), F.lit("\n\n"))


def put_aside(lines: Column, patterns: Column) -> Column:
    """Lines that match one of ``patterns`` go to a comment at the end of the page, once for a page; dashes in them are kept apart."""
    hit = lambda x: F.exists(patterns, lambda p: F.regexp(x, p))
    moved = F.concat(F.filter(lines, lambda x: ~hit(x)), F.array(F.lit(ASIDE)), F.transform(F.filter(lines, hit), lambda x: F.replace(x, F.lit("--"), F.lit("- -"))), F.array(F.lit("-->")))
    return F.when(F.exists(lines, hit) & ~F.array_contains(lines, ASIDE), moved).otherwise(lines)


def _edited(state: Column, e: Column) -> Column:
    """One entry's edits of a page: ``state(text, missing)``."""

    def insert(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, lambda x: F.regexp(F.trim(x), e["anchor"])), True)
        image = F.array_position(F.slice(lines, (at + 1).cast("int"), NEAR), IMAGE)
        after = F.when(e["after_image"] & (at > 0) & (image > 0), at + image).otherwise(at).cast("int")

        def put(k: Column) -> Column:
            rest = F.slice(lines, k + 1, F.size(lines))
            filled = F.array_position(F.transform(rest, lambda x: F.trim(x) != ""), True)
            tail = F.when(filled > 0, F.slice(rest, F.greatest(filled, F.lit(1)).cast("int"), F.size(rest))).otherwise(F.array().cast("array<string>"))
            block = F.concat(F.lit("<!-- "), e["tag"], F.lit(":start -->\n"), F.trim(e["body"]), F.lit("\n<!-- "), e["tag"], F.lit(":end -->"))
            whole = F.concat(F.slice(lines, 1, F.greatest(k, F.lit(1))), F.array(F.lit(""), block, F.lit("")), tail)
            found = F.struct(F.array_join(whole, "\n").alias("text"), state["missing"].alias("missing"))
            lost = F.struct(F.array_join(lines, "\n").alias("text"), F.concat(state["missing"], F.array(e["tag"])).alias("missing"))
            return F.when(k > 0, found).otherwise(lost)

        return bound(after, put)

    return bound(put_aside(F.split(without_block(state["text"], e["tag"]), "\n"), F.coalesce(e["supersede"], F.array().cast("array<string>"))), insert)


def insert_blocks(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """``pages(doc, page, text)`` with the blocks of ``entries(doc, page, ord, tag, body, anchor, supersede, after_image)`` put in: ``doc, page, text, missing``.

    For each entry, by ``ord``: its former block goes; lines that ``supersede`` matches are put aside; the block stands after the first line that matches ``anchor``, or
    after the image within five lines of it if ``after_image``, with one blank line before and after. Entries whose anchor a page lacks are named in ``missing``, and
    their block is not on it. Applied to its own result it changes nothing. A page's entries are an array, so a page meets only its own.
    """
    own = F.struct("ord", "tag", "body", "anchor", "supersede", F.coalesce("after_image", F.lit(False)).alias("after_image"))
    todo = entries.groupBy("doc", "page").agg(F.array_sort(F.collect_list(own)).alias("__todo"))
    start = F.struct(F.col("text"), F.array().cast("array<string>").alias("missing"))
    done = pages.join(todo, ["doc", "page"], "left").withColumn("__done", F.when(F.col("__todo").isNotNull() & F.col("text").isNotNull(), F.aggregate("__todo", start, _edited)).otherwise(start))
    return done.select("doc", "page", "__done.text", "__done.missing")


def splice_tokens(pages: DataFrame, census: DataFrame) -> DataFrame:
    """``(doc, page, text, spliced)``: pages with the tokens of ``census(doc, page, ord, id, verbatim)`` that they lack, in one line at the end.

    A token is the id as it is printed, or else in brackets; a page has it if it holds the id or the token. A page that is not there is made.
    """
    said = F.trim(F.regexp_replace(F.coalesce("verbatim", F.lit("")), r"\s+", " "))
    token = F.when(said.startswith("("), said).otherwise(F.concat(F.lit("("), "id", F.lit(")")))
    wanted = census.where(F.coalesce("id", F.lit("")) != "").groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("ord", "id", token.alias("token")))).alias("__want"))
    body = F.coalesce("text", F.lit(""))
    lacks = F.filter(F.coalesce("__want", F.array().cast("array<struct<ord:long,id:string,token:string>>")), lambda w: ~(F.contains(body, w["id"]) | F.contains(body, w["token"])))
    tokens = F.array_distinct(F.transform(lacks, lambda w: w["token"]))
    both = pages.join(wanted, ["doc", "page"], "full").withColumn("__t", tokens)
    kept = F.regexp_replace(body, r"(?<!\s)\s+\z", "")
    added = F.concat(F.when(F.trim(kept) == "", F.lit("")).otherwise(kept), F.lit("\n"), F.array_join("__t", " "), F.lit("\n"))
    return both.select("doc", "page", F.when(F.size("__t") > 0, added).otherwise(F.col("text")).alias("text"), F.size("__t").cast("long").alias("spliced"))

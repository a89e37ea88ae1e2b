"""Sections that are not printed as headings: raised out of body text, filled in from served pages, merged over sources.

``blocks(doc, family, page, pos, y, part, label, layer, text, orig)`` are the pieces of a converted document; ``family`` says how it numbers
its clauses: ``implied`` (``2a. Title`` below ``D1`` is ``D1.2a``), ``implied decimal`` (also below ``5.3``), ``dotted`` (``12.4.3``, ``C1.1``), ``lettered``
(``D5.1.2``) or ``numeric`` (``7``, ``7.1``, ``SECTION 5``). All rules are Columns; keys are (doc, part, id), so a long document is spread over tasks, but for the
implied parents, which one sorted window carries forward over the few blocks that have or need one. What is read several times is written to the shared folder once.

Defined results: a null text or original is no heading; a null part is the standard; a null page sorts last, is never a preview and is in no amendment;
an unknown or null family raises nothing; of repeated ids the first block counts; columns beyond those named are not read; empty tables give none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import squeeze
from ferrule.operators.retrieval import bound
from ferrule.shared import stored

# Fixed patterns: headings in the order they are tried, and what begins like one and is none.
HEADINGS = (
    r"^([A-Z])\.\s+(.+)$",
    r"^((?:C-)?[A-Z]\d+(?:\.\d+)*[a-z]?)(?:\.|\b)(?:\s+|$)(.*)$",
    r"^(\d+(?:\.\d+)+[a-z]?)\.\s+(\S.*)$",
    r"(?i)^CHAPTER\s+(C?\d+)\b(?:\s+(.*))?$",
    r"^(C?\d+(?:\.\d+)+[a-z]?)\s+(\S.*)$",
    r"(?i)^SECTION\s+(\d+)\b(?:\s+(.*))?$",
    r"^(\d+(?:\.\d+)*)\.\s+(\S.*)$",
    r"^(\d+(?:\.\d+)*)\s+((?=.*[A-Za-z]{2})[A-Z][A-Za-z0-9][A-Za-z0-9 ,/\-]{0,100})$",
)
NO_HEADING = (
    "table ", "user note", "disclaimer", "preface", "symbols", "table of contents", "this page is intentionally left blank", "aisi standard", "aisi committee",
    "lateral design subcommittee", "north american standard", "commentary on north american", "language is added", "references in section",
)
SUBHEAD = r"^(\d+[a-z]?)\.\s+(\S.*)$"
CHAPTER, CHAPTER_ABOVE, DECIMAL = r"^[A-Z]\d+[a-z]?$", r"^([A-Z]\d+[a-z]?)", r"^\d+\.\d+"
SHAPES = {"dotted": r"^C?\d+", "lettered": r"^[A-Z]\d+(?:\.\d+)+[a-z]?$", "numeric": r"^\d+(?:\.\d+)*$"}
LOOSE = (r"^SECTION\s+(\d+)\b(?:\s+(.*))?$", r"^(\d+(?:\.\d+)*)\.\s+(\S.*)$", r"^(\d+(?:\.\d+)*)\s+((?=.*[A-Za-z]{2})[A-Z][A-Za-z0-9][A-Za-z0-9 ,/\-]{0,100})$")
IMPLIED_LABELS, LABELS = ("section_header", "title", "text"), ("section_header", "title", "text", "list_item", "paragraph")
ROOT, OLD_ID, GARBLED = r"^([A-Z]\d+[a-z]?|C?\d+)", r"^\d{1,2}(\.\d{1,3}){0,5}$", r"G6|G4|cid:"
#: Lengths of titles, implied and others; sections from which a numeric document is read no further; words of a title found in pages; the highest clause of an old list.
IMPLIED_TITLE, TITLE, ENOUGH, TITLE_BLANKS, HIGHEST_OLD, GARBLED_MARKS, LEVELS = 140, 200, 5, 18, 40, 20, 6
LAST_PAGE = 10**9


def _first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), F.struct(F.regexp_extract(text, p, 1).alias("sid"), F.trim(F.regexp_extract(text, p, 2)).alias("title"))) for p in patterns])


def parsed_heading(text: Column) -> Column:
    """``(sid, title)`` of a piece of text that reads as a heading of any family, else null."""
    none = lambda t: reduce(lambda a, b: a | b, [F.lower(t).startswith(p) for p in NO_HEADING])
    return bound(squeeze(text), lambda t: F.when(~none(t), bound(F.trim(F.regexp_replace(t, r"^#{1,6}\s*", "")), lambda md: _first_match(md, HEADINGS))))


def _once(c: Column) -> Column:
    """A column that conditions on it do not compute again: nothing is pushed below a generator."""
    return F.explode(F.array(c))


def parent_of(sid: Column) -> Column:
    """``12.4.3`` -> ``12.4``, ``E3`` -> ``E``, ``12`` -> null."""
    return F.when(sid.contains("."), F.regexp_extract(sid, r"^(.*)\.[^.]*$", 1)).otherwise(F.nullif(F.regexp_extract(sid, r"^((?:C-)?[A-Z])\d", 1), F.lit("")))


def _letters(title: Column) -> tuple[Column, Column]:
    """How many letters a title has, and the share of capitals."""
    n = F.length(F.regexp_replace(title, r"\P{L}", ""))
    return n, F.length(F.regexp_replace(title, r"\P{Lu}", "")) / F.greatest(n, F.lit(1))


def _without_bullet(text: Column) -> Column:
    return F.regexp_replace(squeeze(text), r"^[-*•]\s*", "")


def _cut(title: Column) -> Column:
    return F.rtrim(F.substring(title, 1, TITLE))


def _place(synthetic: bool, phase: Column, page: Column, down: Column) -> Column:
    return F.struct(F.lit(synthetic).alias("synthetic"), phase.cast("int").alias("phase"), page.cast("long").alias("page"), down.cast("double").alias("down"), F.col("pos").cast("long").alias("pos"))


def _body(blocks: DataFrame) -> DataFrame:
    return blocks.where("layer = 'body'").select("doc", "family", "page", "pos", "y", F.coalesce("part", F.lit("standard")).alias("part"), "label", "text", "orig")


def printed(blocks: DataFrame) -> DataFrame:
    """Sections that stand as headings, repeats included: ``(doc, part, sid, title, page, parent, synthetic, place)``."""
    heads = _body(blocks).where("label = 'section_header'").withColumn("h", _once(parsed_heading(F.col("text")))).where("h IS NOT NULL")
    return heads.select("doc", "part", "h.sid", "h.title", F.col("page").cast("long").alias("page"), parent_of(F.col("h.sid")).alias("parent"), F.lit(False).alias("synthetic"), _place(False, F.lit(1), F.lit(0), F.lit(0)).alias("place"))


def implied(blocks: DataFrame) -> DataFrame:
    """Candidates of the implied families: a numbered subheading below the last chapter or clause in full, by page and from top to bottom.

    A chapter in lower case is a line of contents and changes nothing; a clause in full (``D1.2``) leaves its chapter (``D1``) in charge. Bare numbers are subheadings here.
    """
    own = _body(blocks).where(F.col("family").isin("implied", "implied decimal") & F.col("label").isin(*IMPLIED_LABELS))
    rows = own.select("doc", "family", "page", "pos", "y", "part", squeeze(F.col("text")).alias("t"), _once(parsed_heading(F.col("text"))).alias("h"))
    sid, (n, share) = F.col("h.sid"), _letters(F.col("h.title"))
    scope = (
        F.when(sid.rlike(CHAPTER), F.when((n < 4) | (share >= 0.75), sid))
        .when(sid.rlike(r"^[A-Z]\d"), F.regexp_extract(sid, CHAPTER_ABOVE, 1))
        .when((F.col("family") == "implied decimal") & sid.rlike(DECIMAL), sid)
    )
    number = F.when(F.col("h").isNull() | sid.rlike(r"^\d+$"), F.regexp_extract("t", SUBHEAD, 1))
    marked = rows.select("doc", "part", F.col("page").cast("long").alias("page"), _place(True, F.lit(1), F.coalesce("page", F.lit(LAST_PAGE)), -F.coalesce("y", F.lit(0.0))).alias("place"), scope.alias("scope"), number.alias("number"), F.trim(F.regexp_extract("t", SUBHEAD, 2)).alias("title"))
    so_far = Window.partitionBy("doc", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    below = marked.where("scope IS NOT NULL OR number <> ''").withColumn("parent", F.last("scope", ignorenulls=True).over(so_far))
    return below.where(F.col("number").isNotNull() & (F.col("number") != "") & F.col("parent").isNotNull() & F.length("title").between(1, IMPLIED_TITLE)).select("doc", "part", F.concat_ws(".", "parent", "number").alias("sid"), "title", "page", "parent", "place")


def inline(blocks: DataFrame) -> DataFrame:
    """Candidates of the families whose ids are in full, in any kind of block; the original is asked before the text, which may have lost its number.

    Headings of a numeric document are phase 1, other blocks phase 2.
    """
    shape = reduce(lambda c, kv: c.when(F.col("family") == kv[0], F.col("h.sid").rlike(kv[1])), SHAPES.items(), F.when(F.lit(False), F.lit(False)))
    rows = _body(blocks).where(F.col("family").isin(*SHAPES) & F.col("label").isin(*LABELS))
    found = rows.withColumn("h", _once(F.coalesce(parsed_heading(_without_bullet(F.col("orig"))), parsed_heading(_without_bullet(F.col("text")))))).where(shape)
    dots = (F.col("family") == "lettered") & F.coalesce(F.col("text").rlike(r"\.{4}|…"), F.lit(False))
    bare = (F.col("family") == "numeric") & (F.col("h.title") == "") & F.col("h.sid").rlike(r"\..*\.")
    phase = F.when((F.col("family") == "numeric") & (F.col("label") != "section_header"), 2).otherwise(1)
    return found.where(~dots & ~bare).select("doc", "part", "h.sid", _cut(F.col("h.title")).alias("title"), F.col("page").cast("long").alias("page"), parent_of(F.col("h.sid")).alias("parent"), _place(True, phase, F.lit(0), F.lit(0)).alias("place"))


def _first_new(found: DataFrame, known: DataFrame) -> DataFrame:
    """The first candidate of each id that is not known, combined before the shuffle."""
    first = found.groupBy("doc", "part", "sid").agg(F.min_by(F.struct("title", "page", "parent", "place"), "place").alias("m"))
    return first.join(known.select("doc", "part", "sid").distinct(), ["doc", "part", "sid"], "left_anti").select("doc", "part", "sid", "m.title", "m.page", "m.parent", F.lit(True).alias("synthetic"), "m.place")


def synthesised(blocks: DataFrame) -> DataFrame:
    """Printed sections and those raised out of body text, no id of a part twice among the raised and none that is printed.

    A numeric document is read beyond its headings only if they give fewer than five sections.
    """
    heads = stored(printed(blocks), "sections-")
    new = stored(_first_new(implied(blocks).unionByName(inline(blocks)), heads), "sections-")
    early = new.where("place.phase = 1").select("doc").unionByName(heads.select("doc")).groupBy("doc").agg(F.count("*").alias("n"))
    kept = new.where("place.phase = 1").unionByName(new.where("place.phase = 2").join(early.where(F.col("n") >= ENOUGH), "doc", "left_anti").select(*new.columns))
    return heads.unionByName(kept)


def without_previews(sections: DataFrame) -> DataFrame:
    """Leaves out clauses of the standard that stand on a page before the body of their chapter: listings ahead and ids quoted from elsewhere.

    A chapter's body is its first heading in capitals, or its first heading at all.
    """
    n, share = _letters(F.col("title"))
    root = F.nullif(F.regexp_extract("sid", ROOT, 1), F.lit(""))
    standard = sections.withColumn("root", F.when((F.col("part") == "standard") & F.col("page").isNotNull(), root))
    tops = standard.where("sid = root").groupBy("doc", "root").agg(F.coalesce(F.min(F.when((n >= 3) & (share >= 0.75), F.col("page"))), F.min("page")).alias("body_page"))
    seen = standard.join(tops, ["doc", "root"], "left")
    return seen.where(F.coalesce((F.col("sid") == F.col("root")) | (F.col("page") >= F.col("body_page")), F.lit(True))).select(*sections.columns)


def linked(sections: DataFrame) -> DataFrame:
    """Adds ``children``, the ids one level down in order of their first place; where an id repeats its last section has them, the others none."""
    first = sections.where("parent IS NOT NULL").groupBy("doc", "part", "parent", F.col("sid").alias("child")).agg(F.min("place").alias("at"))
    below = first.groupBy("doc", "part", F.col("parent").alias("sid")).agg(F.array_sort(F.collect_list(F.struct("at", "child"))).alias("c"))  # the clauses of one section
    last = sections.groupBy("doc", "part", "sid").agg(F.max("place").alias("place")).join(below, ["doc", "part", "sid"])
    mine = last.select("doc", "part", "sid", "place", F.transform("c", lambda x: x["child"]).alias("children"))
    return sections.join(mine, ["doc", "part", "sid", "place"], "left").select(*sections.columns, F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def sections(blocks: DataFrame) -> DataFrame:
    """The sections of documents: printed and raised, without previews, with their children."""
    return linked(stored(without_previews(synthesised(blocks)), "sections-"))


def from_pages(known: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections that ``pages(doc, edition, page, part, text)`` of numeric documents have and ``known`` has not; of a document's editions the least that has any.

    Pages whose first 2,000 characters hold over twenty marks of undecoded glyphs are not read, nor comments. Rows are like those of ``synthesised``.
    """
    legible = pages.where(F.coalesce(F.regexp_count(F.substring("text", 1, 2000), F.lit(GARBLED)) <= GARBLED_MARKS, F.lit(False)))
    lines = legible.select("doc", "edition", "page", F.coalesce("part", F.lit("standard")).alias("part"), F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    t = _without_bullet(F.col("line"))
    read = lines.where(~squeeze(F.col("line")).startswith("<!--")).withColumn("h", _once(F.coalesce(parsed_heading(t), bound(F.regexp_replace(t, r"^#{1,3}\s*", ""), lambda x: _first_match(x, LOOSE)))))
    found = read.where(F.col("h.sid").rlike(SHAPES["numeric"])).withColumn("title", _cut(F.col("h.title"))).where(F.regexp_count("title", F.lit(" ")) <= TITLE_BLANKS)
    place = _place(True, F.lit(3), F.col("page"), F.lit(0))
    new = found.select("doc", "edition", "part", "h.sid", "title", F.col("page").cast("long").alias("page"), parent_of(F.col("h.sid")).alias("parent"), place.alias("place")).join(known.select("doc", "part", "sid").distinct(), ["doc", "part", "sid"], "left_anti")
    least = F.min_by(F.struct("edition", "title", "page", "parent", "place"), F.struct("edition", "place"))
    first = stored(new.groupBy("doc", "part", "sid", "edition").agg(least.alias("m")), "sections-")
    chosen = first.groupBy("doc").agg(F.min("edition").alias("edition"))
    return first.join(chosen, ["doc", "edition"]).select("doc", "part", "sid", "m.title", "m.page", "m.parent", F.lit(True).alias("synthetic"), "m.place")


def merged(heads: DataFrame, amended: DataFrame) -> DataFrame:
    """One heading an id out of ``heads(doc, origin, pos, sid, title, page)``: ``(doc, sid, title, page, source, sheet_page)``.

    Origins are ``layout``, ``served``, ``manual`` and ``old``. The layout comes before the served text, unless it stands on a page of ``amended(doc, page)`` and the
    served text does not: then that is the consolidated wording, and ``sheet_page`` is the page of the amendment. What was entered by hand stands above both, the
    last entry if there are several. An old heading fills a gap if its chapter is known and, below a chapter, if its parent is there before it, from wherever, and its number is 40 at
    most. As ids have six levels at most, old ones are admitted level by level, each by one join on the parent.
    """
    sheets = amended.where("page IS NOT NULL").select("doc", "page", F.lit(True).alias("sheet")).distinct()
    placed = heads.where("sid IS NOT NULL").select("doc", "origin", "pos", "sid", "title", "page").join(sheets, ["doc", "page"], "left")
    rows = stored(placed.withColumn("sheet", F.coalesce("sheet", F.lit(False))), "headings-")
    first = rows.where("origin IN ('layout', 'served')").groupBy("doc", "sid", "origin", (F.col("sheet") & (F.col("origin") == "served")).alias("own")).agg(F.min_by(F.struct("title", "page", "sheet", "pos"), "pos").alias("m"))
    rank = F.when(F.col("m.sheet"), 2).otherwise(0) + F.when(F.col("origin") == "served", 1).otherwise(0)
    by_text = first.groupBy("doc", "sid").agg(F.min_by(F.struct("origin", "m", "own"), rank).alias("w"), F.min_by(F.when(F.col("m.sheet"), F.struct("m.page", "m.pos")), F.when(F.col("m.sheet"), F.struct("origin", "m.pos"))).alias("s"), F.min(F.when(F.col("origin") == "layout", True)).alias("laid"))
    # Served text on a sheet counts as replaced only if it came first and the layout has nothing.
    over = (F.col("w.origin") == "served") & ~F.col("w.m.sheet") & F.col("s").isNotNull() & (F.coalesce("laid", F.lit(False)) | (F.col("s.pos") < F.col("w.m.pos")))
    source = F.when(over, "served, amendment consolidated").otherwise(F.col("w.origin"))
    texts = by_text.select("doc", "sid", "w.m.title", "w.m.page", source.alias("source"), F.when(over, F.col("s.page")).alias("sheet_page"))
    manual = rows.where("origin = 'manual'").groupBy("doc", "sid").agg(F.max_by(F.struct("title", "page"), "pos").alias("m")).select("doc", "sid", "m.title", "m.page", F.lit("manual").alias("source"), F.lit(None).cast(heads.schema["page"].dataType).alias("sheet_page"))
    base = stored(texts.join(manual, ["doc", "sid"], "left_anti").unionByName(manual), "headings-")
    return base.unionByName(_old(rows.where("origin = 'old'"), base).select(*base.columns))


def _old(old: DataFrame, base: DataFrame) -> DataFrame:
    top, levels = F.expr("try_cast(substring_index(sid, '.', 1) AS INT)"), F.size(F.split("sid", r"\."))
    tops = base.select("doc", top.alias("top")).where("top > 0").distinct()
    shaped = old.where(F.col("sid").rlike(OLD_ID)).withColumn("top", top).join(tops, ["doc", "top"], "left_semi").join(base.select("doc", "sid"), ["doc", "sid"], "left_anti")
    ready = shaped.select("doc", "sid", "title", "page", "pos", levels.alias("level"), parent_of(F.col("sid")).alias("parent"))
    near = stored(ready.where((F.col("level") == 1) | (F.substring_index("sid", ".", -1).cast("int") <= HIGHEST_OLD)), "headings-")
    known = base.select("doc", F.col("sid").alias("parent"), F.lit(None).cast("long").alias("after"), levels.alias("level"))
    earliest = lambda df: df.groupBy("doc", "sid", "level").agg(F.min_by(F.struct("title", "page", "pos"), "pos").alias("m"))
    got = [stored(earliest(near.where("level = 1")), "headings-")]  # each level is read by the next one and at the end
    for level in range(2, LEVELS + 1):
        before = known.where(F.col("level") == level - 1).drop("level").unionByName(got[-1].select("doc", F.col("sid").alias("parent"), F.col("m.pos").cast("long").alias("after")))
        got.append(stored(earliest(near.where(F.col("level") == level).join(before, ["doc", "parent"]).where("after IS NULL OR after < pos")), "headings-"))
    return reduce(DataFrame.unionByName, got).select("doc", "sid", "m.title", "m.page", F.lit("old").alias("source"), F.lit(None).cast(old.schema["page"].dataType).alias("sheet_page"))

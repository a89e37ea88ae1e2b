"""Clause headings of paged text: which lines could be one, which carry the numbering on, and what each section spans.

Line rules are Columns. What depends on all lines before is a fold that streams through sorted partitions: a document takes the
memory of its state, the ids kept or the sections still open, not of its lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ferrule.functions import text as X
from ferrule.operators.ordered import folded
from ferrule.shared import stored

# Fixed patterns and words: heading lines, lines of contents, words that begin a value and not a title.
NUMBERED = r"^\s{0,6}(?:#{1,4}\s*)?(?:\*\*)?[‘']?(\d{1,2}(?:\.\d{1,3}){0,5})(?:\*\*)?\.?\s+(\S.*)$"
SECTION_WORD = r"^\s{0,6}SECTION\s+(\d{1,2})\s+([A-Z].*)$"
CONTENTS = r"(?m)^\s*(CONTENTS|Contents|C O N T E N T S)\s*$"
CONTENTS_LINE = r"^\s*(\d+(?:[.,]\d+)*|SECTION\s+\d+|ANNEX\s+[A-Z])\s+[A-Za-z].*?(\s{5,}|\.{4,}\s*)\d{1,3}\s*$"
AMENDED = r"^\[[^\]]{0,120}\]\s*"
SYMBOLS = ("DL", "LL", "EL", "WL", "IL", "SL", "CL", "ER", "TL", "EQ", "IS", "BIS", "MPa", "kN", "mm", "Hz", "per")
#: How far a number may go: chapters ahead and back, siblings ahead, and a first child; clauses that prove a chapter; the highest chapter if none shows.
AHEAD, BACK, SIBLINGS, PROOF, HIGHEST, UNKNOWN_TOP = 2, 1, 3, 5, 40, 30
#: Ids that begin with 0 belong to a foreword, which is on the first pages.
FOREWORD_PAGES, TITLE_CHARS, MOST_NUMBERS = 6, 160, 3


def contents_page(text: Column) -> Column:
    """Whether a page is a table of contents: it says so, or three lines in ten, of ten at least, end in dots or a gap and a page number."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    listed = F.size(F.filter(lines, lambda x: x.rlike(CONTENTS_LINE)))
    return F.substring(text, 1, 3000).rlike(CONTENTS) | ((F.size(lines) >= 10) & (listed >= 0.3 * F.size(lines)))


def plausible_title(title: Column, chapter: Column) -> Column:
    """Whether a text can be the title of a clause, or of a chapter, whose title begins with a word in capitals and has no long number."""
    t = F.trim(F.replace(F.regexp_replace(F.trim(title), AMENDED, ""), F.lit("**"), F.lit("")))
    word = F.regexp_extract(t, r"^([A-Za-z][A-Za-z'’]*(?:-[A-Za-z∆Δ]*)?)", 1)
    capitals = word.rlike("^[A-Z][A-Z]{2,}") & ~F.substring(t, 1, 20).rlike(r"\d{3,}")
    short = (F.length(word) == 1) & (word != "A")
    symbol = (F.length(word) <= 3) & word.rlike("^[A-Z][A-Z'’-]*$") & ~F.substring(t, F.length(word) + 1, F.lit(40)).rlike("[A-Za-z]{3,}")
    clause = word.rlike("^[A-Z]") & ~short & ~symbol & ~t.rlike(r"^(kN|mm|MPa|Nos?)\b")
    return (word != "") & ~word.isin(*SYMBOLS) & F.when(chapter, capitals).otherwise(clause)


def candidates(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """``(doc, page, line, part, sid, title, chapter)`` of lines that could be headings, those of columns and of tables of contents apart.

    Columns of a page are read one after the other; a line of a page without columns is cut at gaps of six blanks.
    """
    kept = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.col(text).alias("text")).where(~contents_page(F.col("text")))
    flat = kept.withColumn("flat", X.linearised("text")).withColumn("one", F.col("flat") == F.col("text"))
    lines = flat.select("doc", "page", "one", F.posexplode(F.split("flat", "\n")).alias("line", "raw"))
    parts = lines.select("doc", "page", "line", F.posexplode(F.when(F.col("one"), F.split("raw", r"\s{6,}")).otherwise(F.array("raw"))).alias("part", "raw"))
    word = F.col("raw").rlike(SECTION_WORD)
    pattern = lambda n: F.when(word, F.regexp_extract("raw", SECTION_WORD, n)).otherwise(F.regexp_extract("raw", NUMBERED, n))
    found = parts.select("doc", "page", "line", "part", pattern(1).alias("sid"), F.trim(pattern(2)).alias("title"), word.alias("chapter")).where("sid <> ''")
    return found.where(F.col("chapter") | plausible_title(F.col("title"), ~F.col("sid").contains(".")))


def top_numbers(found: DataFrame) -> DataFrame:
    """``(doc, top)``: the highest chapter, by headings of chapters or by clauses, five at least, that begin with its number."""
    first = F.substring_index("sid", ".", 1).cast("int")
    clauses = found.groupBy("doc", first.alias("n")).agg(F.count_if(~F.col("sid").contains(".")).alias("own"), F.count_if(F.col("sid").contains(".")).alias("below"))
    proved = (F.col("own") > 0) | ((F.col("below") >= PROOF) & (F.col("n") <= HIGHEST))
    return clauses.groupBy("doc").agg(F.coalesce(F.max(F.when(proved, F.col("n"))), F.lit(UNKNOWN_TOP)).alias("top"))


def carries_on(state: dict, row: dict) -> bool:
    """Whether a heading carries the numbering on from what ``state`` has kept; if so the state takes it in.

    A chapter may be ahead of the last by two or back by one; a clause may be three ahead of its last sibling, or among the
    first three of a parent that was kept; a third level without its parent among the first three. No id comes twice.
    """
    sid, top = row["sid"], row["top"]
    seen, last, now = state["seen"], state["last"], state["now"]
    if sid in seen:
        return False
    if row["chapter"]:
        if int(sid) > top:
            return False
        seen.add(sid)
        state["now"] = max(now, int(sid))
        return True
    *above, own = (int(x) for x in sid.split("."))
    first = above[0] if above else own
    if first == 0:
        if row["page"] > FOREWORD_PAGES or not above:
            return False
    elif first > top or not now - BACK <= first <= now + AHEAD:
        return False
    parent = sid.rpartition(".")[0]
    if above:
        if own > last.get(parent, 0) + SIBLINGS and not (parent in seen and own <= SIBLINGS):
            return False
        if len(above) > 1 and parent not in seen and own > SIBLINGS:
            return False
    if row["numbers"] > MOST_NUMBERS:
        return False
    seen.add(sid)
    if first:
        state["now"] = max(now, first)
    if above:
        last[parent] = max(last.get(parent, 0), own)
    return True


def headings(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """``(doc, page, line, part, sid, title)`` of the headings that carry the numbering on, in reading order.

    A title that runs on into its clause ends at a dash. A title of more than three numbers is a row of values.
    """
    found = stored(candidates(pages, doc, page, text), "headings-")  # read for the highest chapters and for the fold
    numbers = F.regexp_count(F.substring(F.regexp_replace("title", AMENDED, ""), 1, 60), F.lit(r"\d+(?:\.\d+)?"))
    ready = found.join(top_numbers(found), "doc").withColumn("numbers", numbers)
    kept = folded(ready, ["doc"], ["page", "line", "part"], ["doc", "page", "line", "part", "sid", "title", "chapter", "top", "numbers"], lambda: {"seen": set(), "last": {}, "now": 0}, carries_on)
    squeezed = F.regexp_replace("title", r"\s{2,}", " ")
    cut = F.when(F.col("chapter"), F.col("title")).otherwise(F.trim(F.get(F.split(squeezed, r"\s+[—–-]\s+|(?<=[a-z)])\s*—"), F.lit(0))))
    return kept.select("doc", "page", "line", "part", "sid", F.substring(cut, 1, TITLE_CHARS).alias("title"))


def below(child: str, parent: str) -> bool:
    """Whether an id lies under another: a further level, or one letter more."""
    rest = child[len(parent) :]
    return child != parent and child.startswith(parent) and (rest.startswith(".") or (len(rest) == 1 and rest.isascii() and rest.isalpha()))


def streamed(df: DataFrame, by: list[str], order: list[str], columns: list[str], shape: T.StructType, start: Callable[[], object], step: Callable[[object, dict], Iterator[dict]], end: Callable[[object], Iterator[dict]]) -> DataFrame:
    """Rows that a fold gives out: ``step(state, row)`` for each row of a group in order, ``end(state)`` after the last."""

    kinds = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, rows = None, None, []

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_pylist(rows, schema=kinds)
            rows.clear()
            return got

        for b in batches:
            for row in b.to_pylist():
                own = tuple(row[c] for c in by)
                if state is None or own != group:
                    if state is not None:
                        rows.extend(end(state))
                    group, state = own, start()
                rows.extend(step(state, row))
                if len(rows) >= 10_000:
                    yield out()
            yield out()
        if state is not None:
            rows.extend(end(state))
            yield out()

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = df.select(*dict.fromkeys([*by, *order, *columns])).repartition(n, *by).sortWithinPartitions(*by, *order)
    return ready.mapInArrow(run, shape)


def _shape(df: DataFrame, *names: str) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def section_windows(sections: DataFrame, by: list[str], order: list[str], sid: str = "sid", page: str = "page", span: int = 8) -> DataFrame:
    """``(by, order, sid, page, end, stop)``: the pages of each section end where the first later page has one that is not below it, ``stop``.

    Sections on its own page do not end it, nor do those below it or of its own id, which extend it. Where nothing ends it, it goes on to the last page below
    it and ``span`` pages on at least. One pass: sections that are open wait by their id, and as whatever stays open on a later page is above
    the row that comes, there are as many ids as levels. Rows without an id or a page end nothing and have no window.
    """
    keys = [c for c in dict.fromkeys([*by, *order]) if c not in (sid, page)]
    longs = [T.StructField(n, T.LongType()) for n in ("page", "end")]
    shape = T.StructType([*_shape(sections, *keys), T.StructField("sid", T.StringType()), *longs, T.StructField("stop", T.StringType())])

    def step(state: dict, row: dict) -> Iterator[dict]:
        own, at = row["sid"], row["page"]
        if not own or at is None:
            return
        if at > state["page"]:
            for k, rows in state["here"].items():
                state["open"].setdefault(k, []).extend(rows)
            state["here"], state["page"] = {}, at
        for k in [k for k in state["open"] if k != own and not below(own, k)]:
            for r in state["open"].pop(k):
                yield {**r, "end": at, "stop": own}
        state["here"].setdefault(own, []).append({**{k: row[k] for k in keys}, "sid": own, "page": at})

    def end(state: dict) -> Iterator[dict]:
        for rows in (*state["open"].values(), *state["here"].values()):
            for r in rows:
                yield {**r, "end": max(state["page"], r["page"] + span), "stop": None}

    ready = sections.select(*keys, F.col(sid).alias("sid"), F.col(page).cast("long").alias("page"))
    return streamed(ready, by, [{sid: "sid", page: "page"}.get(c, c) for c in order], ["sid", "page"], shape, lambda: {"page": -(1 << 62), "open": {}, "here": {}}, step, end)


def open_sections(sections: DataFrame, by: list[str], order: str, sid: str = "sid") -> DataFrame:
    """``(by, section, at)``: for every heading, by its ``order``, itself and the headings above it that it does not end.

    A heading ends those that it is not below, its own id among them, so a heading has as many rows as its id has levels.
    """
    shape = T.StructType([*_shape(sections, *by), *[T.StructField(n, sections.schema[order].dataType) for n in ("section", "at")]])

    def step(state: list, row: dict) -> Iterator[dict]:
        while state and not below(row["sid"], state[-1][0]):
            state.pop()
        state.append((row["sid"], row["at"]))
        for _, section in state:
            yield {**{k: row[k] for k in by}, "section": section, "at": row["at"]}

    ready = sections.select(*by, F.col(sid).alias("sid"), F.col(order).alias("at")).where(F.coalesce("sid", F.lit("")) != "")
    return streamed(ready, by, ["at"], ["sid"], shape, list, step, lambda state: iter(()))


def section_bodies(lines: DataFrame, sections: DataFrame, by: list[str], pages: int = 4, chars: int = 12_000) -> DataFrame:
    """``(by, section, sid, body, n_lines)``: each section's lines from its heading to the one before the next heading that is not below it.

    ``lines(by, at, page, line)`` and ``sections(by, at, page, sid)`` share the place ``at``. A body goes over ``pages`` pages and ``chars`` characters at
    most, which is the feature. A line stands in as many sections as its heading has levels; lines past the limit of characters go before they are collected.
    """
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marks = sections.select(*by, "at", F.lit(True).alias("mark")).distinct()
    placed = lines.join(marks, [*by, "at"], "left").withColumn("heading", F.last(F.when(F.col("mark"), F.col("at")), ignorenulls=True).over(order)).where("heading IS NOT NULL")
    owners = open_sections(sections, by, "at").withColumnRenamed("at", "heading")
    starts = sections.select(*by, F.col("at").alias("section"), F.col("page").alias("first_page"), "sid")
    owned = placed.join(owners, [*by, "heading"]).join(starts, [*by, "section"]).where(F.col("page") < F.col("first_page") + pages)
    so_far = Window.partitionBy(*by, "section").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    near = owned.withColumn("before", F.coalesce(F.sum(F.length("line") + 1).over(so_far), F.lit(0))).where(F.col("before") < chars)
    rows = F.array_sort(F.collect_list(F.struct("at", "line")))
    body = F.substring(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), 1, chars)
    return near.groupBy(*by, "section", "sid").agg(body.alias("body"), F.count("*").alias("n_lines"))


# Fixed patterns: captions of tables, and what follows them.
CAPTION = r"^\s*(?:TABLE|Table)\s+(\d{1,2}[A-Z]?(?:\s?\([a-z]\))?)(?![\w.])\s*(.*)$"
CONTINUED = r"(?i)^[\(\[]?\s*(Continued|Concluded|Contd)|[-—–]\s*Cont(d|inued)\.?\s*$"
CLAUSE_NAMED, CLAUSE_OF = r"(?i)\(\s*(Clauses?|Clause|Foreword|Section|see)\b", r"(?i)\(\s*Clauses?\s+([^)]*)\)"
TITLE_LIKE, MENTION = r"^[—–-]?\s*[A-Z][A-Za-z]", r"^(of|and|as|to|for|shall|may|is|are|in|gives?|with)\b"
HEADER_ROW, TITLE_ENDS = r"(^|\n)\s*(Sl|SI|S1|s\}|Sl\.)\s*(No|$)|\(1\)\s+\(2\)", r"(?i)^\(\s*(Clauses?|Foreword)"


def captions(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """``(doc, page, line, table_id, title, continued, clause_ref)`` of the captions of tables; sentences that mention a table are none.

    A caption says that it continues, or it has a title and within six lines a clause in brackets, within nine a header row, or two capitalised words. The title
    goes on over three lines at most, up to a blank or long one, a clause or a header row; ``clause_ref`` is the clause of the caption or of those six lines.
    """
    lines = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.split(X.linearised(F.col(text)), "\n").alias("l"))
    after = F.transform("l", lambda x, i: F.when(x.rlike(CAPTION), F.struct(x.alias("line"), F.slice("l", i + 2, F.lit(9)).alias("next"))))
    found = lines.select("doc", "page", F.posexplode(after).alias("line", "c")).where("c IS NOT NULL").select("doc", "page", F.col("line").cast("long").alias("line"), F.col("c.line").alias("raw"), "c.next")
    rest = F.trim(F.regexp_extract("raw", CAPTION, 2))
    rows = found.select("doc", "page", "line", F.replace(F.regexp_extract("raw", CAPTION, 1), F.lit(" "), F.lit("")).alias("table_id"), rest.alias("rest"), F.transform("next", F.trim).alias("near"), "next")
    window = F.concat_ws(" ", "rest", F.array_join(F.slice("near", 1, 6), " "))
    continued = F.col("rest").rlike(CONTINUED)
    header = F.array_join("next", "\n").rlike(HEADER_ROW)
    capitals = (F.regexp_count("rest", F.lit(r"\b[A-Z][a-z]{2,}")) >= 2) | ((F.col("rest") == F.upper("rest")) & F.col("rest").rlike(r"\p{L}"))
    title_like = F.col("rest").rlike(TITLE_LIKE) & ~F.col("rest").rlike(MENTION)
    kept = rows.withColumns({"continued": continued, "window": window}).where(continued | (title_like & (F.col("window").rlike(CLAUSE_NAMED) | header | capitals)))
    three = F.slice("near", 1, 3)
    stop = F.array_position(F.transform(three, lambda x: (x == "") | x.rlike(TITLE_ENDS) | (F.length(x) > 90) | x.rlike(r"^(Sl|SI)\b")), True)
    more = F.when(stop > 0, F.slice(three, 1, F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(three)
    title = F.trim(F.regexp_replace(F.array_join(F.concat(F.array("rest"), more), " "), r"\s{2,}", " "))
    clause = F.nullif(F.trim(F.regexp_extract("window", CLAUSE_OF, 1)), F.lit(""))
    return kept.select("doc", "page", "line", "table_id", F.substring(F.trim(F.concat(F.lit("Table "), "table_id", F.lit(" "), title)), 1, 200).alias("title"), "continued", clause.alias("clause_ref"))

"""Running titles, headers and footers of printed pages: what leaves a text before it is indexed, and the label a page prints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.operators.retrieval import bound

#: Every line end that a text may hold.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


@dataclass(frozen=True)
class Profile:
    """What a publisher prints on each page: phrases taken out wherever they stand, lines dropped whole, lines dropped if shorter
    than a length, and pairs of lines of which the second goes after the first. Case does not count."""

    phrases: tuple[str, ...] = ()
    lines: tuple[str, ...] = ()
    short: tuple[tuple[str, int], ...] = ()
    after: tuple[tuple[str, str], ...] = ()
    kept: tuple[str, ...] = ()


#: Running titles and labels of six publications.
SECTION_HEADS = ((r"\[?Sect\.\s+.*", 48),)
COPYRIGHTED = r"this document is copyrighted.*"
ROMAN_OR_NUMBER = r"(?:[ivxlcdm]+|\d{1,4})"
PROFILES = {
    "aisc_358": Profile(
        phrases=(r"Prequalified Connections for Special and Intermediate Steel[ \t]+Moment Frames for Seismic Applications[ \t]*,?[ \t]*August 18,[ \t]*2022",),
        lines=(r"Prequalified Connections for Special and Intermediate Steel", r"Moment Frames for Seismic Applications,?\s*August 18,\s*2022", r"9\.2\s*[-–—]\s*[ivxlcdm0-9]+", r"\[Comm\..*"),
        short=(*SECTION_HEADS, (r"Comm\.\s+\d.*", 56)),
        after=((r"Prequalified Connections for Special and Intermediate Steel", r"Moment Frames for Seismic Applications.*"),),
    ),
    "aisc_341": Profile(
        phrases=(r"Seismic Provisions for Structural Steel Buildings[ \t]*,?[ \t]*September 26,[ \t]*2022",),
        lines=(r"Seismic Provisions for Structural Steel Buildings(?:,\s*September 26,\s*2022)?", r"American Institute of Steel Construction", r"9\.1\s*[-–—]\s*[ivxlcdm0-9]+", r"\[Comm\..*"),
        short=(*SECTION_HEADS, (r"Comm\.\s+[A-Z].*", 56)),
        after=((r"Seismic Provisions for Structural Steel Buildings", r"September 26,\s*2022.*"),),
    ),
    "asce": Profile(
        phrases=(r"Downloaded from ascelibrary\.org by[^\n]*", r"Copyright ASCE; all rights reserved[^\n]*"),
        lines=(r"STANDARD\s+ASCE/SEI\s+7-22", r"ASCE/SEI\s+7-22", r"COMMENTARY TO STANDARD ASCE/SEI 7-22", r"STANDARD\s+ASCE/SEI\s+41-23", r"ASCE/SEI\s+41-23", r"Seismic Evaluation and Retrofit of Existing Buildings", r"Commentary to Standard ASCE/SEI 41-23", r"downloaded from ascelibrary.*", r"copyright asce.*"),
    ),
    "aisi_s100": Profile(
        lines=(
            r"The 2016 Edition \(Reaffirmed 2020\) of the North American Specification for the Design of Cold-Formed Steel",
            r"Commentary on the 2016 Edition \(Reaffirmed 2020\) of the North American Cold-Formed Steel",
            r"Structural Members With Supplement 3\b.*", r"Specification With Supplement 3\b.*",
            r"(?:[ivxlcdm]+\s+)?AISI\s*S100-16(?:-C)?(?:\s*\(R?2020\))?(?:\s*w/S3-22)?", r"(?:[A-Z]-\d+|\d+-\d+|\d{1,4}|[ivxlcdm]+)",
        ),
        short=((r"(?:(?:[A-Z]-)?\d+(?:-\d+)?|[ivxlcdm]+)\s+(?:Chapter|Appendix|AISI|Introduction|Disclaimer)\b.*", 120),),
        kept=("c",),
    ),
    "aisi_s240": Profile(
        lines=(COPYRIGHTED, r"(?:Commentary on the )?North American Standard for Cold-Formed Steel Structural Framing, 2020 Edition\s*\d*", rf"(?:{ROMAN_OR_NUMBER}\s+)?AISI\s*S240-20(?:-C)?"),
    ),
    "aisi_s230": Profile(
        lines=(COPYRIGHTED, r"Standard for Cold-Formed Steel Framing[—\-]Prescriptive Method for One- and Two-Family Dwellings, 2019 Edition\s*\d*", r"Commentary on the Standard for Cold-Formed Steel Framing[—\-]?Prescriptive Method for One- and Two-Family Dwellings, 2019 Edition\s*\d*", rf"(?:{ROMAN_OR_NUMBER}\s+)?AISI\s*S230-19(?:-C)?"),
    ),
}

#: Patterns of printed page labels in order, each with what stands before the label, and texts that it passes over;
#: then titles whose number at the end is no page.
TITLED = r"S400|S100|S240|S230|Supplement|ASCE/SEI\s+\d|(?:August|September)\s+\d+,\s*2022"
LABELS = (
    (r"With\s+Supplement\s+3\s+((?:[A-Z]-)?\d+(?:-\d+)?|[ivxlcdm]+)\s*$", "", ""),
    (r"^((?:[A-Z]-)?\d+(?:-\d+)?|[ivxlcdm]+)\s+(?:Chapter|Appendix|AISI|Introduction|Disclaimer)\b", "", "^c "),
    (r"^([ivxlcdm]+|\d{1,4})\s+AISI\s*S240-20(?:-C)?\s*$", "", ""),
    (r"^([A-Z]-\d+|\d+-\d+|\d{1,4}|[ivxlcdm]+)$", "", "^c$"),
    (r"9\s*\.\s*2\s*[-–—]\s*([ivxlcdm]+|\d+)\b", "9.2-", ""),
    (r"9\s*\.\s*1\s*[-–—]\s*([ivxlcdm]+|\d+)\b", "9.1-", ""),
    (r"16\s*\.\s*1\s*[-–—]\s*([ivxlcdm]+|\d+)\b", "16.1-", ""),
)
#: A number or a numeral of more than one letter alone after a dash, whose family another text of the page names.
SPLIT_LABEL = r"^-(\d{1,4}|[ivxlcdm]{2,})$"
FAMILIES = ((r"16\s*\.\s*1\b", "16.1-", None), (r"9\s*\.\s*1\b", "9.1-", r"9\s*\.\s*2\b"))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines_of(text: Column) -> Column:
    """The lines of a text; none after its last line end, and none of an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, rf"(?:{LINE_END})\z", ""), LINE_END))


def whole(c: Column, *patterns: str) -> Column:
    return c.rlike(r"(?i)\A(?:" + "|".join(patterns) + r")\z") if patterns else F.lit(False)


def strip_running_titles(text: Column, profile: str) -> Column:
    """A text without what its publisher prints on every page (C12); an empty text for null."""
    p = PROFILES[profile]
    out = F.coalesce(text, F.lit(""))
    for phrase in p.phrases:
        out = F.regexp_replace(out, "(?i)" + phrase, "")

    def keep(lines: Column) -> Column:
        def stays(line: Column, i: Column) -> Column:
            t = trimmed(line)
            goes = whole(t, *p.lines) & ~F.lower(t).isin(*p.kept) if p.kept else whole(t, *p.lines)
            for pattern, length in p.short:
                goes = goes | (whole(t, pattern) & (F.length(t) < length))
            for title, next_ in p.after:
                before = trimmed(F.coalesce(F.get(lines, i - 1), F.lit("")))
                goes = goes | (whole(before, title) & whole(t, next_))
            return ~goes

        return F.filter(lines, stays)

    return F.array_join(bound(lines_of(out), keep), "\n")


def printed_label(texts: Column) -> Column:
    """The label that a page prints, from its header and footer texts: the first pattern in order that one of them has, in the
    first text that has it; numerals in lower case. Last, the number at a text's end."""

    def find(all_: Column) -> Column:
        ts = F.transform(all_, lambda t: trimmed(F.regexp_replace(t, r"\s+", " ")))
        first = lambda pattern, passed: F.get(F.filter(F.transform(F.filter(ts, lambda t: ~t.rlike(f"(?i){passed}")) if passed else ts, lambda t: F.regexp_extract(t, f"(?i){pattern}", 1)), lambda x: x != ""), F.lit(0))
        said = lambda c: F.when(c.rlike(r"(?i)^[ivxlcdm]+$"), F.lower(c)).otherwise(c)
        has = lambda pattern: F.exists(ts, lambda t: t.rlike(f"(?i){pattern}"))
        found = [F.concat(F.lit(prefix), said(first(pattern, passed))) for pattern, prefix, passed in LABELS]
        for family, prefix, other in FAMILIES:
            named = has(family) if other is None else has(family) & ~has(other)
            found.append(F.when(named, F.concat(F.lit(prefix), said(first(SPLIT_LABEL, "")))))
        return F.coalesce(*found, first(r"(\d{1,4})\s*$", TITLED))

    return bound(texts, find)


def furniture_by_page(texts: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """``(*by, headers, footers, printed_label)`` of pages out of ``texts(*by, seq, label, layer, text)``.

    Of the furniture, footers and what names a copyright are footers, the rest headers, each in order; pages without any have no row.
    """
    rows = texts.where(F.col("label").isin("page_header", "page_footer") | (F.col("layer") == "furniture"))
    foot = (F.col("label") == "page_footer") | F.lower("text").contains("copyright")
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct(seq, "text")))), lambda x: x["text"])
    g = rows.groupBy(*by).agg(pick(~F.coalesce(foot, F.lit(False))).alias("headers"), pick(F.coalesce(foot, F.lit(False))).alias("footers"))
    return g.withColumn("printed_label", printed_label(F.concat("headers", "footers")))

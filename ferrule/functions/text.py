"""Text functions that Spark has no built-in for, as Arrow-backed functions, and id normalisers as Columns."""

from __future__ import annotations

import difflib
import functools
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Texts that a Python worker holds as objects at once, whatever a batch holds.
HELD = 256


def _few_at_once(values: pa.Array, f: Callable[[pa.Array], pa.Array], kind: pa.DataType) -> pa.Array:
    """``f`` of a batch, a few rows after the other, so memory does not go with the texts of a batch."""
    return pa.concat_arrays([f(values.slice(i, HELD)) for i in range(0, len(values), HELD)] or [pa.array([], kind)])


def _mapped(texts: pa.Array, f: Callable[[str | None], str | None]) -> pa.Array:
    return _few_at_once(texts, lambda few: pa.array([f(x) for x in few.to_pylist()], pa.string()), pa.string())


def _class(keeps: Callable[[str], bool]) -> str:
    """What is neither ASCII nor one of the characters of ``SCRIPTS`` that ``keeps`` holds for, as a pattern; ASCII is passed over at once."""
    out = ""
    for low, high in SCRIPTS:
        at = [k for k in range(low, high + 1) if keeps(chr(k))]
        firsts = [k for k in at if k - 1 not in at]
        lasts = [k for k in at if k + 1 not in at]
        out += "".join(rf"\x{{{a:X}}}-\x{{{z:X}}}" for a, z in zip(firsts, lasts, strict=True))
    return rf"[\x{{80}}-\x{{10FFFF}}&&[^{out}]]"


#: Latin, Greek, Cyrillic, dashes and quotes, currency: without letters that compose with the one before but for marks, and with ASCII digits alone.
SCRIPTS = ((0x00, 0x24F), (0x370, 0x52F), (0x2010, 0x2027), (0x20A0, 0x20BF))
_stable = lambda c: unicodedata.is_normalized("NFKC", c) and not unicodedata.combining(c) and unicodedata.category(c) not in ("Cn", "Mn")
#: What Python has to normalise, and what it has to fold: any other text is its own normal form, and folds as Spark's lower case but for the sharp s.
UNSTABLE, UNFOLDED = _class(_stable), _class(lambda c: _stable(c) and c not in "Σς" and c.casefold() == c.lower().replace("ß", "ss") and len(c.lower()) == 1)


def _but_for(text: Column | str, hard: Callable[[Column], Column], python: Callable[[Column], Column], else_: Callable[[Column], Column]) -> Column:
    """``python`` of the texts that are ``hard``, ``else_`` of the others: these do not pass through a worker, so its memory does not go with them."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(python(F.when(hard(c), c)), else_(c))


@F.arrow_udf(T.StringType())
def _nfkc(s: pa.Array) -> pa.Array:
    return _mapped(s, lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column | str) -> Column:
    """Compatibility-composed text."""
    return _but_for(text, lambda c: c.rlike(UNSTABLE), _nfkc, lambda c: c)


#: Joins and splits of formula symbols before full-text indexing, in order.
FTS_RULES = [
    (re.compile(p), put)
    for p, put in (
        (r"\b([kK])\s+([1-4])\b", r"\1\2"),
        (r"\bK\s+([dacDAC])\b", r"K\1"),
        (r"\bV\s+([zbBZ])\b", r"V\1"),
        (r"\bp\s+([dz])\b", r"p\1"),
        (r"\bC\s+(pe|pi|f|p|t)\b", r"C\1"),
        (r"γ\s*m\s*([01])\b", r"γm\1"),
        (r"γ\s+f\b", "γf"),
        (r"\bA\s+h\b", "Ah"),
        (r"\bT\s+a\b", "Ta"),
        (r"\bS\s*a\s*/\s*g\b", "Sa/g"),
        (r"\b(E|Fe)\s+(165|250|275|300|330|350|410|450|550|600|650)\b", r"\1\2"),
        (r"\bf\s+([ycu])\b", r"f\1"),
        (r"\bM\s+([dp])\b", r"M\1"),
        (r"(\d(?:\.\d+)?)([a-z]{1,2})(\d+\.\d+)", r"\1 \2 \3"),
        (r"(?<![A-Za-z0-9])([a-z])(\d+\.\d+)\b", r"\1 \2"),
    )
]


def fts_normal_of(text: str | None) -> str:
    s = unicodedata.normalize("NFKC", text or "")
    for pattern, put in FTS_RULES:
        s = pattern.sub(put, s)
    return s


_SPACE = r"[\x09-\x0D\x1C-\x20\x{85}]"
#: Where a rule of ``FTS_RULES`` may do something to a text without ``UNSTABLE``: wider than the rules, as it knows the words of ASCII alone.
FTS_MAY = (
    r"(?=[kKVpCATSEFfM])(?<![A-Za-z0-9_])(?:[kK]_+[1-4]|K_+[dacDAC]|V_+[zbBZ]|p_+[dz]|C_+(?:pe|pi|f|p|t)|A_+h|T_+a|S_*a_*/_*g|(?:E|Fe)_+[1-6][0-9]{2}|f_+[ycu]|M_+[dp])(?![A-Za-z0-9_])"
    r"|γ(?:_*m_*[01]|_+f)|[a-z][0-9]+\.[0-9]"
).replace("_+", f"{_SPACE}+").replace("_*", f"{_SPACE}*")


@F.arrow_udf(T.StringType())
def _fts_normal(s: pa.Array) -> pa.Array:
    return _mapped(s, lambda x: None if x is None else fts_normal_of(x))


def fts_normal(text: Column | str) -> Column:
    """Text as it is indexed: NFKC and ``FTS_RULES``; a null is empty. In Python, whose word limits are not Java's, where a rule may apply."""
    return _but_for(text, lambda c: c.rlike(UNSTABLE) | c.rlike(FTS_MAY), _fts_normal, lambda c: F.coalesce(c, F.lit("")))


@F.arrow_udf(T.StringType())
def _casefold(s: pa.Array) -> pa.Array:
    return _mapped(s, lambda x: None if x is None else x.casefold())


@F.arrow_udf(T.StringType())
def _nfkc_folded(s: pa.Array) -> pa.Array:
    return _mapped(s, lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def _lower(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def casefold(text: Column | str) -> Column:
    return _but_for(text, lambda c: c.rlike(UNFOLDED), _casefold, _lower)


def nfkc_folded(text: Column | str) -> Column:
    """Compatibility-composed text, then folded."""
    return _but_for(text, lambda c: c.rlike(UNFOLDED), _nfkc_folded, _lower)


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two strings: twice the matched characters over both lengths."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def squeeze(c: Column) -> Column:
    """White space runs become one space."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def section_id(c: Column) -> Column:
    """``Clause 7.6.2.`` -> ``7.6.2``: the id without its word and a last dot."""
    return F.regexp_replace(F.regexp_extract(c, r"(?i)^\s*(?:(?:clause|section|annex|cl|sec)\.?\s+)?([A-Z]?[0-9]*(?:\.[0-9]+)*[A-Za-z]?)", 1), r"\.$", "")


def table_id(c: Column) -> Column:
    """``Table 9 (a)`` -> ``9(a)``."""
    return F.regexp_replace(F.regexp_replace(c, r"(?i)^\s*table\s+", ""), r"\s+", "")


def equation_id(c: Column) -> Column:
    """``Eq. (7.1-2)`` -> ``7.1-2``."""
    return F.regexp_replace(F.regexp_replace(c, r"(?i)^\s*eq(?:uation|n)?\.?\s*", ""), r"[()\s]", "")


def parent_id(c: Column) -> Column:
    """The id one level up, empty at the top."""
    return F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)


def is_descendant(child: Column, parent: Column) -> Column:
    """Whether an id lies under another: a further level, or one letter more."""
    rest = F.substring(child, F.length(parent) + 1, F.length(child))
    return child.startswith(parent) & (rest.startswith(".") | rest.rlike("^[A-Za-z]$"))


def heading(line: Column) -> Column:
    """``(id, title)`` of a heading line, null if it is none: numbers with dots, then a title that starts with a capital."""
    pattern = r"^(?:#+\s*)?([0-9]+(?:\.[0-9]+)*)\.?\s+([\p{Lu}].*)$"
    return F.when(line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, 1).alias("id"), F.regexp_extract(line, pattern, 2).alias("title")))


def numeric(c: Column) -> Column:
    """A number, null for bad text; a truth value is not a number."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.cast("double"))


VOWELS = "aeiou"


@functools.lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """A word's stem by Porter's published algorithm."""
    if len(word) <= 2:
        return word

    def consonant(w: str, i: int) -> bool:
        return w[i] not in VOWELS and (w[i] != "y" or i == 0 or not consonant(w, i - 1))

    def measure(w: str) -> int:
        kinds = "".join("c" if consonant(w, i) else "v" for i in range(len(w)))
        return len(re.findall("v+c+", kinds))

    vowel = lambda w: any(not consonant(w, i) for i in range(len(w)))
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and consonant(w, len(w) - 1)
    cvc = lambda w: len(w) > 2 and consonant(w, len(w) - 3) and not consonant(w, len(w) - 2) and consonant(w, len(w) - 1) and w[-1] not in "wxy"

    def swap(w: str, rules: list[tuple[str, str]], least: int) -> str:
        for end, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(end):
                return w[: len(w) - len(end)] + new if measure(w[: len(w) - len(end)]) > least else w
        return w

    w = word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    # The suffix tables of the published algorithm.
    w = swap(w, [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")], 0)
    w = swap(w, [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")], 0)
    ends = [(e, "") for e in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")]
    if w.endswith("ion") and w[:-3].endswith(("s", "t")):
        w = w[:-3] if measure(w[:-3]) > 1 else w
    else:
        w = swap(w, ends, 1)
    if w.endswith("e"):
        base = w[:-1]
        if measure(base) > 1 or (measure(base) == 1 and not cvc(base)):
            w = base
    if double(w) and w.endswith("l") and measure(w) > 1:
        w = w[:-1]
    return w


def stems_of(lists: pa.Array) -> pa.Array:
    """Stems of the words of arrays; each different word of them is an object once."""
    flat = lists.flatten().dictionary_encode()
    known = pa.array([None if w is None else stem(w) for w in flat.dictionary.to_pylist()], pa.string())
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[np.int32(0), ends], pa.int32()), known.take(flat.indices), mask=pc.is_null(lists))


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems(words: pa.Array) -> pa.Array:
    """Stems of the words of an array."""
    return _few_at_once(words, stems_of, pa.list_(pa.string()))


def snippet_of(text: str, terms: list[str], width: int = 40) -> str:
    """The window of ``width`` words with most different terms, the first of the best, terms marked >> <<."""
    words = text.split()
    low = [re.sub(r"^\W+|\W+$", "", w.lower()) for w in words]
    asked, count, kinds = set(terms), {}, 0
    best, at = -1, 0
    for i, w in enumerate(low):
        if w in asked:
            count[w] = count.get(w, 0) + 1
            kinds += count[w] == 1
        if i >= width and low[i - width] in asked:
            count[low[i - width]] -= 1
            kinds -= count[low[i - width]] == 0
        if kinds > best:
            best, at = kinds, max(0, i - width + 1)
    return " ".join(f">>{w}<<" if k in asked else w for w, k in zip(words[at : at + width], low[at : at + width], strict=True))


@F.pandas_udf(T.StringType())
def snippet(text: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else snippet_of(t, list(q)) for t, q in zip(text, terms, strict=True)], dtype="object")


def gutter_of(lines: list[str], least: int = 4) -> int | None:
    """The column of the widest blank strip inside a page of text that nearly all lines leave free; none if there is none."""
    wide = max(map(len, lines), default=0)
    rows = [x for x in lines if x.strip()]
    if not rows:
        return None
    taken = np.zeros(wide, dtype=np.int64)  # beyond its end a line is blank
    for x in rows:
        taken[: len(x)] += np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype="<u4") != ord(" ")
    free = len(rows) - taken >= 0.9 * len(rows)
    edges = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
    start, end = edges[::2], edges[1::2]
    size = np.where((start > 0.2 * wide) & (end < 0.8 * wide) & (end - start >= least), end - start, 0)
    at = int(size.argmax()) if len(size) else 0
    return int(start[at] + end[at]) // 2 if len(size) and size[at] else None


def linear_of(page: str) -> str:
    """A page of two columns as one: the left column, then the right. A line that has text at the gutter crosses it, as titles and
    wide rows do, and stays whole where it is, with the left column; a common indent of the left column goes."""
    lines = page.split("\n")
    at = gutter_of(lines)
    if at is None:
        return page
    crosses = [len(x) <= at or x[max(0, at - 1) : at + 2].strip() != "" for x in lines]
    left = [(x if c else x[:at]).rstrip() for x, c in zip(lines, crosses, strict=True)]
    indent = min((len(x) - len(x.lstrip()) for x in left if x), default=0)
    return "\n".join([x[indent:] for x in left] + [x[at:].strip() for x, c in zip(lines, crosses, strict=True) if not c])


@F.pandas_udf(T.StringType())
def linearised(pages: pd.Series) -> pd.Series:
    return pages.map(linear_of, na_action="ignore")

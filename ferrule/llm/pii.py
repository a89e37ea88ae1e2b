r"""Operator 7, personal data: pattern spans, and information-theoretic sanitisation of the terms around them.

Everything is DataFrame functions. Four kinds of personal data are found by patterns whose start and repetition are
written so that no text, however long or odd, makes them backtrack: a match begins where a run begins or the last match
ended, and repetitions are possessive, which leaves the leftmost greedy matches as they are. Positions are code points,
from the lengths of what ``split`` leaves between the matches of ``regexp_extract_all``.

Then the corpus tells which terms give a protected value away. For every protected value c and every term t that is a
whole word of a document with it, however far away, n(c, t) is the number of documents that hold both, n(c) and n(t) those
that hold either, and N all. Words that lie in or touch an address are parts of it and no terms beside it. A term discloses
c by PMI(c; t) / IC(c), with PMI = log(n(c,t) N / (n(c) n(t))) and IC = log(N / n(c)): 1 if the term never occurs without c,
0 if they are independent. Terms that meet c in ``SUPPORT`` different texts or more and
reach ``DISCLOSURE`` are spans of kind ``term`` wherever they occur in the corpus. In the sanitised text those that disclose a
value wholly are removed and the others generalised to a placeholder.

All counts are over all documents, and pre-aggregated. A value that fewer than ``SUPPORT`` texts hold has no pairs to count, so
only the words of texts with other values are paired. Equal texts are recognised by their SHA-256, which also carries spans
back to every row that has the text. The words of all texts pass a bitmap of the candidate terms, of fixed size, and are counted by a
pre-aggregated sum, so neither words nor texts are shuffled; only texts that hold a disclosing term are.

Defined results: a null text counts as empty and has no spans; repeated rows give repeated rows; ids are never read, so
null or repeated ids do no harm; other columns are not read; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import bitmap, bits_for, kept, may_hold, table

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Kind -> the pattern of its spans.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD, SUPPORT, DISCLOSURE, HIDDEN, FOLD = r"\p{L}{2,}+", 2, 0.8, 1.0, 256
#: An address by its first and last character, and what is left of it where words are sought: a mark that no word may touch.
ENDS, MARK = PATTERNS["email"].replace("))[A", "))(?=(.))[A", 1) + "(?<=(.))", "\uffff"
SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """Whether 13 to 19 digits pass Luhn's test."""
    return F.transform(F.array(_digits(v)), _luhn_digits)[0]  # bound, so that the digits are taken out once


def _luhn_digits(d: Column) -> Column:
    n = F.length(d)
    even = lambda i: (n - i) % 2 == 1  # noqa: E731  doubled: every second digit from the right
    digit = lambda i: F.substring(d, i, 1).cast("int")
    twice = lambda i: F.when(digit(i) > 4, 2 * digit(i) - 9).otherwise(2 * digit(i))
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(even(i), twice(i)).otherwise(digit(i)))
    return F.when((n >= 13) & (n <= 19), total % 10 == 0).otherwise(F.lit(False))


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def placed(text: Column, pattern: str | Column, kind: int, valid=lambda v: F.lit(True)) -> Column:
    """Spans of the leftmost matches of ``pattern`` that pass ``valid``; offsets in code points, end exclusive."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.arrays_zip(F.split(text, p, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("match"))
    none = F.array().cast(SPAN)
    state = lambda at, spans: F.struct(at.cast("int").alias("at"), spans.alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        end = at + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), at.alias("start"), end.alias("end"), x["match"].alias("value"))
        return state(end, F.when(x["match"].isNotNull() & valid(x["match"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]))

    def block(acc: Column, own: Column) -> Column:
        """Matches are folded a block at a time, so that a text with very many does not copy all its spans for each."""
        folded = F.array(F.aggregate(own, state(acc["at"], none), step))
        return F.transform(folded, lambda o: state(o["at"], F.concat(acc["spans"], o["spans"])))[0]

    # Bound as a lambda's variable, the matches are found once and not for every block.
    blocks = F.flatten(F.transform(F.array(both), lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / FOLD)), lambda i: F.slice(z, (i * FOLD + 1).cast("int"), F.lit(FOLD)))))
    return F.aggregate(blocks, state(F.lit(0), none), block, lambda acc: acc["spans"])


def base_spans(text: Column) -> Column:
    """The spans of the four kinds, by kind and start. A kind is searched only in texts with a character it needs."""
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}
    none = F.array().cast(SPAN)
    return F.concat(*[F.when(may[k], placed(text, p, i, VALID[k])).otherwise(none) for i, (k, p) in enumerate(PATTERNS.items())])


def folded(text: Column) -> Column:
    """The text in lower case, code point by code point, so that a place in it is that place in the text; terms are counted and placed in it alone.

    Only a capital I with a dot would become two code points, and a last sigma is written like any other.
    """
    return F.translate(F.lower(F.translate(text, "İ", "i")), "ς", "σ")


def _may(values: DataFrame, col: str) -> Column:
    """Whether ``values`` may hold the value of ``col``, by a bitmap in proportion to their number."""
    bits = bits_for(values.count())
    return may_hold(bitmap(values, col, bits), col, bits)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, hidden: float = HIDDEN, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """``(id, digest, base)`` of every row, and ``(digest, terms)`` of the texts with disclosing terms.

    ``base`` and ``terms`` are arrays of spans (kind, start, end, value); for terms, ``value`` is ``removed`` or ``generalised``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", F.sha2("text", 256))
    found = kept(source.select("id", "digest", base_spans(F.col("text")).alias("base")))

    total = float(max(found.count(), 1))
    # A row has a value once, however often it repeats; equal texts count together, so a pair's texts are different ones.
    values = found.where(F.size("base") > 0).select("digest", F.explode(F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))).alias("c"))
    values = kept(values.groupBy("digest", "c").agg(F.count("*").alias("copies")))
    n_c = values.groupBy("c").agg(F.sum("copies").alias("n_c"), F.count("*").alias("texts")).where(F.col("texts") >= support).drop("texts")
    shared = kept(values.join(n_c, "c"))
    # Only addresses hold letters, so that the words beside the values are those beside addresses.
    apart = folded(F.regexp_replace(F.translate("text", MARK, "\n"), F.lit(ENDS), F.lit(f"$1{MARK}$2")))
    beside = F.array_distinct(F.regexp_extract_all(apart, F.lit(rf"(?<![\p{{L}}{MARK}]){WORD}(?!{MARK})"), F.lit(0)))
    beside = source.where(_may(shared, "digest")).select("digest", beside.alias("beside")).dropDuplicates(["digest"])
    pairs = shared.join(beside, "digest").select("c", "n_c", "copies", F.explode("beside").alias("t"))
    pairs = kept(pairs.groupBy("c", "n_c", "t").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_ct")).where(F.col("texts") >= support))
    candidates = kept(pairs.select("t").distinct())
    words = source.select("digest", F.explode(F.array_distinct(F.regexp_extract_all(folded(F.col("text")), F.lit(WORD), F.lit(0)))).alias("t"))
    n_t = words.where(_may(candidates, "t")).groupBy("t").agg(F.count("*").alias("n_t"))
    ic, pmi = F.log2(F.lit(total) / F.col("n_c")), F.log2(F.col("n_ct") * F.lit(total) / (F.col("n_c") * F.col("n_t")))
    tells = (pmi > 0) & (pmi >= disclosure * ic) & (ic - pmi <= hidden)
    revealing = kept(pairs.join(n_t, "t").where(tells).groupBy("t").agg(F.bool_or(F.col("n_ct") == F.col("n_t")).alias("wholly")))
    holds = words.where(_may(revealing, "t")).join(revealing, "t").distinct()
    by_text = kept(holds.groupBy("digest").agg(F.sort_array(F.collect_list(F.when(F.col("wholly"), F.col("t")))).alias("whole"), F.sort_array(F.collect_list(F.when(~F.col("wholly"), F.col("t")))).alias("part")))
    alternatives = lambda c: F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(c, "|"), F.lit(r")(?!\p{L})"))
    none = F.array().cast(SPAN)
    spans = lambda c, how: F.when(F.size(c) > 0, F.transform(placed(F.col("folded"), alternatives(c), 4), lambda s: s.withField("value", F.lit(how)))).otherwise(none)
    holders = source.where(_may(by_text, "digest")).select("digest", folded(F.col("text")).alias("folded")).dropDuplicates(["digest"]).join(by_text, "digest")  # copies meet before they are shuffled
    terms = holders.select("digest", F.array_sort(F.concat(spans("whole", "removed"), spans("part", "generalised"))).alias("terms"))
    return found.select("id", "digest", "base").withColumnRenamed("id", id_col), kept(terms)


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def _written(spans: str) -> Column:
    name = F.array(*map(F.lit, [*PATTERNS, "term"]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


#: Kind -> what stands for it in a sanitised text.
PLACEHOLDERS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with every span replaced in the text: base spans and generalised terms by a
    placeholder, terms that disclose wholly by nothing. Of overlapping spans the first counts, the longer if they start
    together. A null text stays null."""
    found, terms = find_personal_data(docs, id_col, text_col)
    spans = found.where(F.size("base") > 0).select("digest", "base").dropDuplicates(["digest"])
    spans = spans.join(terms, "digest", "full").select("digest", F.concat(F.coalesce("base", F.array().cast(SPAN)), F.coalesce("terms", F.array().cast(SPAN))).alias("spans"))
    ordered = F.array_sort(F.col("spans"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    stands = lambda s: F.when(s["kind"] < 4, F.get(F.array(*map(F.lit, PLACEHOLDERS)), s["kind"])).when(s["value"] == "removed", F.lit("")).otherwise(F.lit("[TERM]"))
    text = F.col("row")[text_col]
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        parts = F.concat(acc["parts"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), stands(s)))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), parts.alias("parts")))

    clean = F.aggregate(ordered, start, step, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    spans = kept(spans)
    rows = docs.select(F.struct("*").alias("row"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))
    named = [F.col("row")[c].alias(c) for c in docs.columns]
    # Only rows that may have spans are shuffled; the others pass as they are.
    may = _may(spans, "digest")
    touched = rows.where(may).join(spans, "digest", "left")
    cleaned = [F.when(F.col("spans").isNotNull() & text.isNotNull(), clean).otherwise(text).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return touched.select(*cleaned).unionByName(rows.where(~may).select(*named))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    found, terms = find_personal_data(table(spark, sf_dir, "documents"))
    none, may = F.array().cast(SPAN), _may(terms, "digest")
    # Only rows whose text may hold a term are shuffled.
    out = found.where(may).join(terms, "digest", "left").select("doc_id", "base", F.concat("base", F.coalesce("terms", none)).alias("all"))
    out = out.unionByName(found.where(~may).select("doc_id", "base", F.col("base").alias("all")))
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    return out.select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("all").alias("spans"))

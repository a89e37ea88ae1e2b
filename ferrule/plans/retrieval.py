"""Queries of full-text retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions.text import nfkc_folded
from ferrule.operators import retrieval as R
from ferrule.operators import search as Q
from ferrule.plans import query, table

#: Alias groups, as data.
ALIASES = [["the", "der", "le", "el"], ["and", "und", "et", "y"], ["trash", "scum", "moron"], ["idiot", "clown"], ["license", "licensed"], ["of the", "des"]]

POSTINGS = r"""
d AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
q AS (SELECT item_id AS qid, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
terms AS (SELECT DISTINCT qid, unnest(w) AS term FROM q),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY ALL),
"""
BM25 = POSTINGS + r"""
size AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_dl FROM d),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
scored AS (SELECT qid, doc_id, -sum((CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END)
    * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl))) AS score
  FROM terms JOIN post USING (term) JOIN df USING (term), size GROUP BY qid, doc_id)
"""


@query("WITH " + BM25 + """, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 8), doc_id) AS rank FROM scored)
SELECT qid AS item_id, rank, doc_id, round(round(score, 8), 6) AS score FROM r WHERE rank <= 5""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Inverted index, BM25, top k."""
    words = table(spark, d, "documents").select("doc_id", R.tokens("text").alias("w"))
    terms = R.query_terms(table(spark, d, "benchmark"), "item_id", "text")
    scored = R.bm25(words, "w", terms, 5, None, ["doc_id"]).withColumn("score", F.round("score", 8))
    best = R.top(scored, ["qid"], [F.col("score"), F.col("doc_id")], 5)
    return best.select(F.col("qid").alias("item_id"), "rank", "doc_id", F.round("score", 6).alias("score"))


@query("WITH " + BM25 + """,
a AS (SELECT s.qid, s.doc_id, d.source, coalesce(l.quality, 1) = 0 AS back,
        round(round(s.score, 8) + CASE WHEN l.toxic = 1 THEN 20 ELSE 0 END + CASE WHEN coalesce(l.quality, 1) = 0 THEN 40 ELSE 0 END
          + CASE WHEN d.n_chars <= 100 THEN 4 ELSE 0 END, 8) AS adjusted
      FROM scored s JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id)),
c AS (SELECT *, count(*) OVER (PARTITION BY qid, source) AS collapsed, row_number() OVER (PARTITION BY qid, source ORDER BY adjusted, doc_id) AS r FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY back, adjusted, doc_id) AS rank FROM c WHERE r = 1)
SELECT qid AS item_id, rank, doc_id, source, collapsed, back AS backmatter, round(adjusted, 6) AS adjusted FROM f WHERE rank <= 5""")
def bm25_adjusted_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Score adjustments, collapse to one hit a page, back matter last."""
    back = F.coalesce("quality", F.lit(1)) == 0
    plus = F.when(F.col("toxic") == 1, 20.0).otherwise(0.0) + F.when(back, 40.0).otherwise(0.0) + F.when(F.col("n_chars") <= 100, 4.0).otherwise(0.0)
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "source", back.alias("backmatter"), plus.alias("plus"), R.tokens("text").alias("w"))
    terms = R.query_terms(table(spark, d, "benchmark"), "item_id", "text")
    scored = R.bm25(docs, "w", terms, 1, "source", ["doc_id"], "plus")
    rows = scored.select("qid", "doc_id", "source", "backmatter", F.round(F.round("score", 8) + F.col("plus"), 8).alias("adjusted"), "matched")
    one = R.collapse(rows, ["qid", "source"], ["adjusted", "doc_id"])
    best = R.top(one, ["qid"], [F.col("backmatter"), F.col("adjusted"), F.col("doc_id")], 5)
    return best.select(F.col("qid").alias("item_id"), "rank", "doc_id", "source", "collapsed", "backmatter", F.round("adjusted", 6).alias("adjusted"))


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)
SELECT doc_id, CAST(len(list_filter(w, lambda x: x IN ('the', 'and'))) AS BIGINT) AS n_all FROM d
WHERE list_contains(w, 'the') AND list_contains(w, 'and') AND (list_contains(w, 'idiot') OR list_contains(w, 'trash') OR list_contains(w, 'licensed'))
  AND NOT list_contains(w, 'stupid')""")
def bm25_boolean_and_or(spark: SparkSession, d: str) -> DataFrame:
    """A MATCH expression: all of, any of, none of."""
    w = table(spark, d, "documents").select("doc_id", R.tokens("text").alias("w"))
    has = lambda t: F.array_contains("w", t)
    found = w.where(has("the") & has("and") & (has("idiot") | has("trash") | has("licensed")) & ~has("stupid"))
    return found.select("doc_id", F.size(F.filter("w", lambda x: x.isin("the", "and"))).cast("long").alias("n_all"))


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
n AS (SELECT doc_id, CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS BIGINT) AS n FROM d)
SELECT doc_id, n FROM n WHERE n > 0""")
def phrase_match(spark: SparkSession, d: str) -> DataFrame:
    """A quoted phrase: adjacent positions."""
    may = F.lower("text").rlike(r"of[^\p{L}\p{N}]+the")  # cheaper than cutting every text into words
    w = table(spark, d, "documents").where(may).select("doc_id", R.tokens("text").alias("w"))
    return w.select("doc_id", R.occurrences(F.col("w"), ["of", "the"]).cast("long").alias("n")).where("n > 0")


@query("WITH " + POSTINGS + r"""
ch AS (SELECT doc_id, source, unnest(range(0, greatest(0, CAST(ceil((len(w) - 60) / 50.0) AS BIGINT)) + 1)) AS i, w FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, source, i, w[i * 50 + 1 : i * 50 + 60] AS w FROM ch),
h AS (SELECT doc_id, source, i, term, count(*) AS tf FROM (SELECT doc_id, source, i, unnest(w) AS term FROM p) GROUP BY ALL),
pdf AS (SELECT term, count(*) AS df FROM h GROUP BY term),
asked AS (SELECT qid, count(*) AS asked FROM terms GROUP BY qid),
s AS (SELECT qid, doc_id, source, i, sum((1 + ln(tf)) * ln(1 + (SELECT count(*) FROM p) / (1 + df))) AS s, count(*) AS found
      FROM terms JOIN h USING (term) JOIN pdf USING (term) GROUP BY ALL),
f AS (SELECT qid, doc_id, source, i, round(s * sqrt(found / asked), 8) AS score FROM s JOIN asked USING (qid)),
c AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, doc_id, i) AS r FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, i) AS rank FROM c WHERE r <= 3)
SELECT qid AS item_id, rank, doc_id, i AS chunk, round(score, 6) AS score FROM k WHERE rank <= 10""")
def tfidf_passages_cap3(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping chunks, TF-IDF with coverage, three passages a source, top ten."""
    words = table(spark, d, "documents").select("doc_id", "source", R.tokens("text").alias("w"))
    passages = words.select("doc_id", "source", F.posexplode(R.chunks(F.col("w"), 60, 50)).alias("i", "w"))
    terms = R.query_terms(table(spark, d, "benchmark"), "item_id", "text")
    s = R.tf_idf(passages, "w", terms, 3, "source", ["doc_id", "i"]).withColumn("score", F.round("score", 8))
    order = [F.desc("score"), F.col("doc_id"), F.col("i")]
    best = R.top(R.top(s, ["qid", "source"], order, 3, "of_source"), ["qid"], order, 10)
    return best.select(F.col("qid").alias("item_id"), "rank", "doc_id", F.col("i").cast("long").alias("chunk"), F.round("score", 6).alias("score"))


#: Keyword queries, as data.
KEYWORDS = [("k1", ["the", "idiot"]), ("k2", ["license"]), ("k3", ["und", "trash"]), ("k4", ["xyzzy"])]
SQL_ALIASES = "g(terms) AS (VALUES " + ", ".join(f"({a})" for a in ALIASES) + ")"


@query(f"""WITH {SQL_ALIASES},
q(qid, terms) AS (VALUES {", ".join(f"('{q}', {t})" for q, t in KEYWORDS)}),
e AS (SELECT qid, term, list_distinct(flatten(list([term]) || coalesce(list(g.terms) FILTER (g.terms IS NOT NULL), []))) AS alts
      FROM (SELECT qid, unnest(terms) AS term FROM q) t LEFT JOIN g ON list_contains(g.terms, t.term) GROUP BY qid, term),
hit AS (SELECT qid, doc_id, count(*) AS n FROM e, documents WHERE len(list_filter(alts, lambda a: contains(lower(text), a))) > 0 GROUP BY qid, doc_id)
SELECT h.qid, h.doc_id FROM hit h JOIN q USING (qid) WHERE h.n = len(q.terms)""")
def keyword_all_terms_any_alias(spark: SparkSession, d: str) -> DataFrame:
    """Every term, or one of its aliases, is part of the text."""
    groups = spark.createDataFrame([(a,) for a in ALIASES], "terms array<string>")
    q = spark.createDataFrame(KEYWORDS, "qid string, terms array<string>")
    each = q.select("qid", F.explode("terms").alias("term"))
    alts = each.join(groups, F.array_contains(groups.terms, each.term), "left").groupBy("qid", "term").agg(F.array_distinct(F.concat(F.array("term"), F.flatten(F.collect_list("terms")))).alias("alts"))
    asked = alts.groupBy("qid").agg(F.collect_list("alts").alias("all"))
    # The keyword queries are a handful of rows by construction.
    low = table(spark, d, "documents").select("doc_id", nfkc_folded("text").alias("low"))
    ok = F.forall("all", lambda g: F.exists(g, lambda a: F.col("low").contains(a)))
    return low.join(F.broadcast(asked), ok).select("qid", "doc_id")


@query(rf"""WITH {SQL_ALIASES}, q AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda x: true) AS w FROM benchmark),
t AS (SELECT item_id, unnest(list_distinct(w)) AS term FROM q),
v AS (SELECT item_id, term, unnest(g.terms) AS alias FROM t JOIN g ON list_contains(g.terms, t.term))
SELECT item_id, term, alias FROM v WHERE alias <> term""")
def query_expansion_variants(spark: SparkSession, d: str) -> DataFrame:
    """A query's terms with the aliases that may stand for them, each once."""
    pairs = spark.createDataFrame([(t, a) for g in ALIASES for t in g for a in g if a != t], "term string, alias string")
    terms = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(R.tokens("text"))).alias("term"))
    return terms.join(F.broadcast(pairs), "term").select("item_id", "term", "alias")


@query(rf"""WITH {SQL_ALIASES}, d AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '\s+', ' ', 'g') || ' ' AS low, regexp_extract_all(text, '[\p{{L}}\p{{N}}_/∆.\-]+') AS w FROM documents),
e AS (SELECT doc_id, low, list_concat(w, list_transform(w, lambda x: regexp_replace(x, '^[.\-]+|[.\-]+$', '', 'g'))) AS w FROM d),
l AS (SELECT doc_id, low, w, list_transform(w, lambda x: lower(x)) AS lw FROM e),
f AS (SELECT doc_id, unnest(list_filter(g.terms, lambda t: length(t) >= 2)) AS term FROM l, g
      WHERE len(list_filter(g.terms, lambda t: length(t) >= 2 AND CASE WHEN contains(t, ' ') THEN contains(low, ' ' || t) WHEN length(t) <= 4 THEN list_contains(w, t) ELSE list_contains(lw, t) END)) > 0)
SELECT doc_id, array_to_string(list_sort(list(DISTINCT term)), ' ') AS alias_tokens FROM f GROUP BY doc_id""")
def alias_tokens(spark: SparkSession, d: str) -> DataFrame:
    """All terms of the alias groups that fire on a text (X11)."""
    found = table(spark, d, "documents").select("doc_id", Q.alias_tokens(F.col("text"), ALIASES).alias("t"))
    return found.select("doc_id", F.array_join(F.array_sort("t"), " ").alias("alias_tokens")).where("alias_tokens <> ''")


#: Questions, as data, and the clauses that they and their aliases ask for.
QUESTIONS = [("q1", "the license"), ("q2", '"of the" idiot'), ("q3", "und trash"), ("q4", "1.50"), ("q5", "trash-scum!"), ("q6", "license")]
LAST = 1 << 20
ASKED = [
    ("q1", 0, 1, ["the"]), ("q1", 0, 2, ["license"]), *[("q1", LAST, 0, [t]) for t in ALIASES[0]], ("q1", LAST, 1, ["license"]),
    ("q2", 0, 1, ["of", "the"]), ("q2", 0, 2, ["idiot"]), ("q2", LAST, 0, ["of"]), *[("q2", LAST, 1, [t]) for t in ALIASES[0]], ("q2", LAST, 2, ["idiot"]),
    ("q3", 0, 1, ["und"]), ("q3", 0, 2, ["trash"]), *[("q3", LAST, 0, [t]) for t in ALIASES[1]], ("q3", LAST, 1, ["trash"]),
    ("q4", 0, 1, ["1", "50"]), ("q4", 0, 1, ["1", "5", "0"]), ("q5", 0, 1, ["trash"]), ("q5", 0, 2, ["scum"]), ("q6", 0, 1, ["license"]), ("q6", 1, 1, ["licensed"]),
]
SEARCH = r"""ph(qid, variant, clause, p) AS (VALUES """ + ", ".join(f"('{q}', {v}, {c}, {p})" for q, v, c, p in ASKED) + r"""),
d AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), []) AS w FROM documents),
tf AS (SELECT * FROM (SELECT p, doc_id, CAST(len(list_filter(range(1, len(w) - len(p) + 2), lambda i: w[i : i + len(p) - 1] = p)) AS BIGINT) AS tf, len(w) AS dl FROM (SELECT DISTINCT p FROM ph), d WHERE list_has_all(w, p)) WHERE tf > 0),
df AS (SELECT p, count(*) AS df FROM tf GROUP BY p), size AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_dl FROM d),
met AS (SELECT qid, variant, doc_id, count(DISTINCT clause) AS met FROM ph JOIN tf USING (p) GROUP BY ALL),
want AS (SELECT qid, variant, count(DISTINCT clause) AS met FROM ph GROUP BY ALL),
ok AS (SELECT qid, variant, doc_id FROM met JOIN want USING (qid, variant, met)),
s AS (SELECT qid, variant, doc_id, round(-sum((CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl))), 8) AS score
  FROM ok JOIN (SELECT DISTINCT qid, variant, p FROM ph) USING (qid, variant) JOIN tf USING (p, doc_id) JOIN df USING (p), size GROUP BY ALL)
"""


def asked_and_found(spark: SparkSession, d: str) -> DataFrame:
    asked = Q.stored(Q.variants(spark.createDataFrame(QUESTIONS, "qid string, text string"), "qid", "text", ALIASES, R.tokens), "asked-")
    postings, lengths = Q.positions(table(spark, d, "documents"), "doc_id", "text", asked, R.tokens)
    return Q.evaluate(asked, postings, lengths).withColumn("score", F.round("score", 8))


@query("WITH " + SEARCH + "SELECT qid, variant, doc_id, round(score, 6) AS score FROM s")
def match_clauses(spark: SparkSession, d: str) -> DataFrame:
    """Questions as clauses of phrases, with their variants by alias, and the BM25 score of each document that meets one."""
    return asked_and_found(spark, d).select("qid", F.col("variant").cast("int").alias("variant"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query("WITH " + SEARCH + """,
o AS (SELECT qid, doc_id, arg_min(score, variant) AS score, min(variant) AS variant FROM (SELECT *, row_number() OVER (PARTITION BY qid, variant ORDER BY score, doc_id) AS r FROM s) WHERE r <= 60 GROUP BY ALL),
a AS (SELECT o.qid, o.doc_id, o.variant, d.source, o.doc_id % 4 AS k, o.doc_id // 3 AS page, coalesce(l.quality, 1) = 0 AS back,
  round(o.score + CASE WHEN l.toxic = 1 THEN 20 ELSE 0 END + CASE WHEN coalesce(l.quality, 1) = 0 THEN 40 ELSE 0 END + CASE WHEN d.n_chars <= 100 THEN 4 ELSE 0 END + CASE WHEN o.doc_id % 4 < 2 THEN -1.5 ELSE 0 END, 8) AS score
  FROM o JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id)),
g AS (SELECT qid, page, list({'score': score, 'doc': doc_id, 'k': k, 'variant': variant, 'back': back} ORDER BY score, doc_id) AS x FROM a GROUP BY ALL),
b AS (SELECT qid, len(x) - 1 AS collapsed, list_reduce(x, lambda p, n: CASE WHEN n.k < p.k AND n.score <= p.score + 1.0 THEN n ELSE p END) AS y FROM g),
f AS (SELECT qid, y.doc AS doc_id, y.variant AS variant, y.score AS score, collapsed, y.back AS back, row_number() OVER (PARTITION BY qid ORDER BY y.back, y.score, y.doc) AS rank FROM b)
SELECT qid, rank, doc_id, variant, collapsed, back AS backmatter, round(score, 6) AS score FROM f WHERE rank <= 5""")
def fts_search(spark: SparkSession, d: str) -> DataFrame:
    """A search from question to ranked hits (L1, X7, W13, L4): over-fetch, first variant, adjustments, one hit a page, back matter last."""
    docs, labels = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels")
    hits = Q.first_variant(asked_and_found(spark, d), 5).withColumnRenamed("doc", "doc_id").join(docs, "doc_id").join(labels, "doc_id", "left")
    back = F.coalesce("quality", F.lit(1)) == 0
    rules = [(F.col("toxic") == 1, 20), (back, 40), (F.col("n_chars") <= 100, 4), (F.col("doc_id") % 4 < 2, -1.5)]
    rows = Q.adjusted(hits.withColumn("backmatter", back), rules).withColumn("score", F.round("score", 8))
    rows = rows.select("qid", F.col("doc_id").alias("doc"), "variant", "backmatter", "score", F.floor(F.col("doc_id") / 3).alias("page"))
    one = Q.one_a_page(rows, ["page"], F.col("doc") % 4)
    best = Q.ranked(one, F.col("backmatter"), 5)
    return best.select("qid", "rank", F.col("doc").alias("doc_id"), F.col("variant").cast("int").alias("variant"), "collapsed", "backmatter", F.round("score", 6).alias("score"))


@query()
def fts_search_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """Questions asked of a stored index of stems with places (X1, K2); SQL has no stems, so tests hold it against a plain loop."""
    from ferrule.shared import new_path
    from ferrule.sources import sinks

    path = new_path(spark, "index-")
    sinks.write_index(table(spark, d, "documents"), path, "doc_id", "text", Q.index_terms)
    asked = Q.stored(Q.clauses(spark.createDataFrame(QUESTIONS, "qid string, text string"), "qid", "text").withColumn("variant", F.lit(0)), "asked-")
    terms = [r[0] for r in asked.select(F.explode("phrase")).distinct().collect()]  # of a few literal questions
    found = Q.evaluate(asked, sinks.read_postings(spark, path, terms), spark.read.parquet(f"{path}/doc_len"))
    return found.select("qid", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query(r"""SELECT item_id, regexp_extract(text, '\b([A-Z][a-z]+)\.', 1) AS hint,
  trim(regexp_replace(text, '\b[A-Z][a-z]+\.', '')) AS rest FROM benchmark""")
def doc_hint_extraction(spark: SparkSession, d: str) -> DataFrame:
    """A hint is taken out of the question, the rest is asked."""
    hint = r"\b([A-Z][a-z]+)\."
    first = F.concat(F.expr(r"coalesce(split(text, '\\b[A-Z][a-z]+\\.', 2)[0], '')"), F.expr(r"coalesce(try_element_at(split(text, '\\b[A-Z][a-z]+\\.', 2), 2), '')"))
    return table(spark, d, "benchmark").select("item_id", F.regexp_extract("text", hint, 1).alias("hint"), F.trim(first).alias("rest"))


@query(r"""WITH t(term, ord) AS (VALUES ('trash', 1), ('worthless', 2), ('loser', 3), ('clown', 4), ('scum', 5)),
h AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY length(term) DESC, ord) AS r FROM documents, t
      WHERE contains(' ' || regexp_replace(lower(text), '[^\p{L}\p{N}]', ' ', 'g') || ' ', ' ' || term || ' '))
SELECT doc_id, term FROM h WHERE r = 1""")
def term_trap_longest_first(spark: SparkSession, d: str) -> DataFrame:
    """The longest dictionary term that occurs as a whole word, if any."""
    terms = sorted(["trash", "worthless", "loser", "clown", "scum"], key=len, reverse=True)
    whole = lambda t: F.lower("text").rlike(rf"(?<![\p{{L}}\p{{N}}]){t}(?![\p{{L}}\p{{N}}])")
    found = F.coalesce(*[F.when(whole(t), F.lit(t)) for t in terms])
    return table(spark, d, "documents").select("doc_id", found.alias("term")).where("term is not null")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
SELECT doc_id, pos, length(line) AS n_chars, regexp_extract(line, '^(\S+)', 1) AS head FROM l
WHERE length(trim(line)) > 0 AND length(line) <= 30 AND regexp_matches(line, '^[A-Z]')""")
def line_explode_headings(spark: SparkSession, d: str) -> DataFrame:
    """Lines that could be headings: short, not blank, with a capital first."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    ok = (F.length(F.trim("line")) > 0) & (F.length("line") <= 30) & F.col("line").rlike("^[A-Z]")
    return lines.where(ok).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), F.length("line").cast("long").alias("n_chars"), F.regexp_extract("line", r"^(\S+)", 1).alias("head"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
m AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^The ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM l)
SELECT doc_id, CAST(sec AS BIGINT) AS section, min(pos) AS first_line, count(*) AS n_lines,
  left(regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g'), 12000) AS body FROM m WHERE sec > 0 GROUP BY doc_id, sec""")
def section_slice(spark: SparkSession, d: str) -> DataFrame:
    """A section from its heading line to the line before the next, 12,000 characters at most (X18). A document is one page, so the limit of four is met."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    sec = F.sum(F.col("line").startswith("The ").cast("int")).over(Window.partitionBy("doc_id").orderBy("p"))
    rows = lines.withColumn("section", sec).where("section > 0").groupBy("doc_id", "section")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda x: x["line"]), "\n")
    body = F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), r"\A[ \t\n\f\r]+|(?<![ \t\n\f\r])[ \t\n\f\r]+\z", "")
    return rows.agg((F.min("p") + 1).cast("long").alias("first_line"), F.count("*").alias("n_lines"), F.substring(body, 1, 12000).alias("body"))


@query(r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
c AS (SELECT doc_id, l, unnest(range(0, greatest(0, CAST(ceil((len(l) - 6) / 5.0) AS BIGINT)) + 1)) AS i FROM d WHERE len(l) > 0)
SELECT doc_id, i AS chunk, CAST(len(l[i * 5 + 1 : i * 5 + 6]) AS BIGINT) AS n_lines, sha256(array_to_string(l[i * 5 + 1 : i * 5 + 6], chr(10))) AS digest FROM c""")
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of six lines, a stride of five."""
    lines = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    return lines.select("doc_id", F.posexplode(R.chunks(F.col("l"), 6, 5)).alias("i", "c")).select("doc_id", F.col("i").cast("long").alias("chunk"), F.size("c").cast("long").alias("n_lines"), F.sha2(F.array_join("c", "\n"), 256).alias("digest"))


@query(r"""SELECT doc_id,
  concat_ws(' ', CASE WHEN len(regexp_extract_all(lower(text), 'licen[sc]e')) >= 1 THEN 'license' END,
    CASE WHEN len(regexp_extract_all(text, '[0-9]{4}')) >= 3 THEN 'numbers' END,
    CASE WHEN length(text) <= 40 THEN 'cover' END, CASE WHEN contains(text, ' | ') THEN 'table' END) AS flags
FROM documents""")
def page_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of a page, from patterns and counts."""
    n = lambda c, p: F.regexp_count(c, F.lit(p))
    flags = F.concat_ws(" ", F.when(n(F.lower("text"), "licen[sc]e") >= 1, "license"), F.when(n("text", "[0-9]{4}") >= 3, "numbers"), F.when(F.length("text") <= 40, "cover"), F.when(F.col("text").contains(" | "), "table"))
    return table(spark, d, "documents").select("doc_id", flags.alias("flags"))


@query(r"""SELECT doc_id, sha256(text) AS digest, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]+', '', 'g') AS clean
FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]+')""")
def email_watermark_clean(spark: SparkSession, d: str) -> DataFrame:
    """Mail addresses of licensees leave the text."""
    p = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]+"
    return table(spark, d, "documents").where(F.col("text").contains("@") & F.col("text").rlike(p)).select("doc_id", F.sha2("text", 256).alias("digest"), F.regexp_replace("text", p, "").alias("clean"))


@query(r"""WITH y AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '[0-9]{4}'), lambda x: true), lambda x: CAST(x AS INTEGER)) AS y FROM documents)
SELECT doc_id, list_max(list_filter(y, lambda x: x BETWEEN 1900 AND 2099)) AS edition FROM y WHERE list_max(list_filter(y, lambda x: x BETWEEN 1900 AND 2099)) IS NOT NULL""")
def edition_max_year(spark: SparkSession, d: str) -> DataFrame:
    """The latest year on the first pages (N8); a document is a page."""
    years = F.transform(F.regexp_extract_all("text", F.lit("[0-9]{4}"), F.lit(0)), lambda x: x.cast("int"))
    return table(spark, d, "documents").select("doc_id", F.array_max(F.filter(years, lambda y: y.between(1900, 2099))).alias("edition")).where("edition is not null")


#: Questions of passages, as data.
ASKED_PASSAGES = {"p1": ["license", "web"], "p2": ["ing", "thed", "code"], "p3": ["trash", "forum"], "p4": ["xyzzy", "news"]}


@query(f"""WITH terms(qid, term) AS (VALUES {", ".join(f"('{q}', '{t}')" for q, ts in ASKED_PASSAGES.items() for t in ts)}),
d AS (SELECT doc_id, source || '/' || doc_id || CASE WHEN lang = 'en' THEN '.md' ELSE '.py' END AS label, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, label, l, unnest(range(0, greatest(0, CAST(ceil((len(l) - 40) / 32.0) AS BIGINT)) + 1)) AS i FROM d),
p AS (SELECT doc_id, label, i, lower(array_to_string(l[i * 32 + 1 : i * 32 + 40], chr(10))) AS low FROM c WHERE trim(array_to_string(l[i * 32 + 1 : i * 32 + 40], '')) <> ''),
h AS (SELECT doc_id, label, i, term, (length(low) - length(replace(low, term, ''))) / length(term) AS tf, contains(lower(label), term) AS named FROM p, (SELECT DISTINCT term FROM terms)),
f AS (SELECT term, count(*) AS df FROM h WHERE tf > 0 GROUP BY 1), asked AS (SELECT qid, count(*) AS asked FROM terms GROUP BY 1),
s AS (SELECT qid, doc_id, label, i, sum(CASE WHEN tf > 0 THEN (1 + ln(tf)) * ln(1 + (SELECT count(*) FROM p) / (1 + df)) ELSE 0 END + CASE WHEN named THEN 2 ELSE 0 END) AS s, count(*) FILTER (tf > 0) AS found FROM terms JOIN h USING (term) LEFT JOIN f USING (term) WHERE tf > 0 OR named GROUP BY ALL),
o AS (SELECT qid, doc_id, i, round(s * sqrt(found / asked) * CASE WHEN label LIKE '%.md' THEN 1.25 ELSE 1 END, 8) AS score FROM s JOIN asked USING (qid)),
k AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY score DESC, i) AS r FROM o),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, i) AS rank FROM k WHERE r <= 3)
SELECT qid, rank, doc_id, i AS chunk, round(score, 6) AS score FROM b WHERE rank <= 10""")
def passage_search(spark: SparkSession, d: str) -> DataFrame:
    """Passages of forty lines by literal terms, their label and coverage; prose first, three of a file, top ten."""
    label = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".md").otherwise(".py"))
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", label.alias("label"), F.split("text", "\n").alias("l"))
    chunks = lines.select("doc_id", "label", F.posexplode(R.chunks(F.col("l"), 40, 32)).alias("i", "c"))
    passages = chunks.select("doc_id", "label", "i", F.array_join("c", "\n").alias("text")).where(F.trim(F.array_join("c", "")) != "")
    terms = spark.createDataFrame([(q, t) for q, ts in ASKED_PASSAGES.items() for t in ts], "qid string, term string")
    s = R.passage_search(passages, ["doc_id", "i"], "text", "label", terms).withColumn("score", F.round("score", 8))
    best = R.top(R.top(s, ["qid", "doc_id"], [F.desc("score"), F.col("i")], 3, "of_file"), ["qid"], [F.desc("score"), F.col("doc_id"), F.col("i")], 10)
    return best.select("qid", "rank", "doc_id", F.col("i").cast("long").alias("chunk"), F.round("score", 6).alias("score"))


#: Questions for the whole pipeline, what stops one, and what others may be called, as data.
AUTO = [("a1", "7"), ("a2", "license"), ("a3", "icens"), ("a4", "permitx"), ("a5", "rafter"), ("a6", "nothingatall"), ("a7", "thed")]
AUTO_ALIASES = [("a4", 0, "zzzz"), ("a4", 1, "license"), ("a4", 2, "the"), ("a6", 0, "yyyy"), ("a6", 7, "license"), ("a2", 0, "the")]


def _ways(docs: DataFrame) -> tuple:
    """Answers by the id of a document, and by full text, 12 at most."""

    def by_id(q: DataFrame) -> DataFrame:
        return q.join(docs.select(F.col("doc_id").alias("doc")), F.col("doc").cast("string") == q.text).withColumn("rank", F.lit(1).cast("long"))

    def full_text(q: DataFrame) -> DataFrame:
        asked = Q.stored(Q.clauses(q, "qid", "text", R.tokens).withColumn("variant", F.lit(0)), "asked-")
        postings, lengths = Q.positions(docs, "doc_id", "text", asked, R.tokens)
        return R.top(Q.evaluate(asked, postings, lengths).withColumn("score", F.round("score", 8)), ["qid"], [F.col("score"), F.col("doc")], 12)

    return by_id, full_text


@query(rf"""WITH q(qid, text) AS (VALUES {", ".join(str(x) for x in AUTO if x[0] != "a5")}), al(qid, ord, text) AS (VALUES {", ".join(str(x) for x in AUTO_ALIASES)}),
a AS (SELECT qid, doc_id AS doc, 1 AS rank, 'id' AS stage, NULL AS alias FROM q JOIN documents ON CAST(doc_id AS VARCHAR) = q.text),
d AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), []) AS w FROM documents),
asked AS (SELECT qid, 0 AS ord, text, false AS alias FROM q UNION ALL SELECT qid, ord, text, true FROM al WHERE ord < 6),
tf AS (SELECT qid, ord, alias, text, doc_id AS doc, len(list_filter(w, lambda x: x = text)) AS tf, len(w) AS dl FROM asked, d WHERE list_contains(w, text)),
df AS (SELECT text, count(DISTINCT doc) AS df FROM tf GROUP BY 1), size AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
s AS (SELECT qid, ord, alias, text, doc, row_number() OVER (PARTITION BY qid, ord, alias ORDER BY round(-(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)), 8), doc) AS rank FROM tf JOIN df USING (text), size),
f AS (SELECT qid, doc, rank, 'fts', NULL FROM s WHERE NOT alias AND rank <= 12 AND qid NOT IN (SELECT qid FROM a)),
k AS (SELECT qid, doc_id AS doc, row_number() OVER (PARTITION BY qid ORDER BY doc_id) AS rank FROM q JOIN documents ON contains(lower(documents.text), q.text) WHERE qid NOT IN (SELECT qid FROM a UNION SELECT qid FROM f)),
o AS (SELECT qid FROM q WHERE qid NOT IN (SELECT qid FROM a UNION SELECT qid FROM f UNION SELECT qid FROM k)),
x AS (SELECT qid, min(ord) AS ord FROM s WHERE alias AND qid IN (FROM o) GROUP BY 1)
SELECT * FROM a UNION ALL SELECT * FROM f UNION ALL SELECT qid, doc, rank, 'keyword', NULL FROM k WHERE rank <= 12 UNION ALL SELECT qid, doc, rank, 'alias', text FROM s JOIN x USING (qid, ord) WHERE alias AND rank <= 12""")
def auto_answers(spark: SparkSession, d: str) -> DataFrame:
    """Questions answered by the first of id, full text, keywords and aliases that finds something; one is stopped by a guard."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    questions = spark.createDataFrame(AUTO, "qid string, text string")
    by_id, full_text = _ways(docs)

    def keyword(q: DataFrame) -> DataFrame:
        # A handful of questions by construction.
        low = docs.select(F.col("doc_id").alias("doc"), nfkc_folded("text").alias("low"))
        return R.top(low.join(F.broadcast(q), F.col("low").contains(F.lower("text"))), ["qid"], [F.col("doc")], 12)

    aliases = spark.createDataFrame(AUTO_ALIASES, "qid string, ord int, text string")
    return Q.answer(questions, questions.where("text = 'rafter'"), by_id, full_text, keyword, aliases)


@query(r"""WITH q AS (SELECT 'plan' || item_id AS plan, unnest([1, 2]) AS n, unnest([coalesce(regexp_extract(lower(text), '[a-z]+', 0), ''), CAST(item_id * 3 AS VARCHAR)]) AS text FROM benchmark),
a AS (SELECT DISTINCT q.text, doc_id AS doc, 1 AS rank, 'id' AS stage FROM q JOIN documents ON CAST(doc_id AS VARCHAR) = q.text),
d AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), []) AS w FROM documents),
asked AS (SELECT DISTINCT text FROM q WHERE text NOT IN (SELECT text FROM a)),
tf AS (SELECT text, doc_id AS doc, len(list_filter(w, lambda x: x = text)) AS tf, len(w) AS dl FROM asked, d WHERE list_contains(w, text)),
df AS (SELECT text, count(*) AS df FROM tf GROUP BY 1), size AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
f AS (SELECT text, doc, row_number() OVER (PARTITION BY text ORDER BY round(-(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)), 8), doc) AS rank FROM tf JOIN df USING (text), size),
h AS (SELECT * FROM a UNION ALL SELECT text, doc, rank, 'fts' FROM f WHERE rank <= 5)
SELECT plan, CAST(n AS BIGINT) AS n, q.text AS query, stage, CAST(doc AS VARCHAR) AS doc, rank FROM q LEFT JOIN h USING (text)""")
def queue_answers(spark: SparkSession, d: str) -> DataFrame:
    """Plans of questions, a file each, drained from a queue and answered by id or full text."""
    from ferrule.shared import new_path
    from ferrule.streaming import queue

    at = new_path(spark, "queue-")
    word = F.coalesce(F.regexp_extract(F.lower("text"), "[a-z]+", 0), F.lit(""))
    asked = F.array(*[F.struct(F.lit("auto").alias("type"), t.alias("query"), F.lit(5).alias("limit")) for t in (word, (F.col("item_id") * 3).cast("string"))])
    plans = table(spark, d, "benchmark").select(F.concat(F.lit("plan"), F.col("item_id").cast("string")).alias("plan_id"), asked.alias("queries"))
    plans.select(F.to_json(F.struct("plan_id", "queries")).alias("value"), F.col("plan_id").alias("file")).write.partitionBy("file").text(f"{at}/in")
    docs = table(spark, d, "documents").select("doc_id", "text")
    by_id, full_text = _ways(docs)
    none = spark.createDataFrame([], "qid string, ord int, text string")

    def answer(q: DataFrame) -> DataFrame:
        return Q.answer(q, none, by_id, full_text, lambda left: left.select("qid", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("rank")).limit(0), none)

    queue.drain(spark, f"{at}/in", f"{at}/out", f"{at}/done", f"{at}/checkpoint", answer, "corpus", "*.txt").awaitTermination()
    rows = queue.answered(spark, f"{at}/out").where("n IS NOT NULL").select("plan", "n", "query", "stage", F.explode_outer("hits").alias("h"))
    return rows.select("plan", "n", "query", "stage", "h.doc", "h.rank")

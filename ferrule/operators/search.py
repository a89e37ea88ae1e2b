"""Questions over a positional index: clauses of phrases, BM25 over phrases, variants by alias, adjustments, one hit a page.

A question is rows, not an expression: all of its clauses have to match, a clause by any of its phrases, a phrase by adjacent terms.
Evaluation is joins over postings, so a thousand questions are one plan. Nothing here depends on the number of documents a
term has: postings are filtered to the questions' terms, and phrases meet inside one row for each question and document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import fts_normal, nfkc, nfkc_folded, stems
from ferrule.operators.retrieval import B, IDF_FLOOR, K1, tokens
from ferrule.shared import stored

#: Characters that a bare word of a question keeps beside letters, digits, underscores and dots.
KEEP = "ΩωφΦλΛαΑβγδεΔπΠσΣμΜ°"
#: What belongs to an alias's word: letters, digits, and some marks.
ALIAS_WORD = r"[\p{L}\p{N}_/∆.\-]+"
OVERFETCH, OVERFETCH_LEAST = 8, 60


def index_terms(text: Column) -> Column:
    """Terms of a text as they are indexed and asked for: normalised, cut into words, stemmed."""
    return stems(tokens(fts_normal(text)))


def extra_tokens(text: Column) -> Column:
    """Forms that glued or spaced formula symbols may be asked by, in order and each once."""
    c = nfkc(text)
    found = lambda pattern, put: F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda m: F.regexp_replace(m, pattern, put))
    return F.array_distinct(F.concat(found(r"(\d(?:\.\d+)?)([A-Za-z]{1,2})(\d+(?:\.\d+)?)", "$1 $2 $3"), found(r"(?U)\b(E|Fe)\s+(\d{3})\b", "$1$2"), found(r"(?U)\b[kK]\s*([1-4])\b", "k$1")))


def alias_tokens(text: Column, groups: list[list[str]]) -> Column:
    """The terms of every alias group that fires on a text, in order and each once (X11).

    A term of one character never fires and is never given. A phrase fires where it begins a word, the end of its last word may go on;
    a term of up to four characters as a whole word in its own case; a longer one as a whole word in any case.
    """
    whole = F.struct(nfkc(text).alias("blob"), nfkc_folded(text).alias("low"))

    def of(x: Column) -> Column:
        low = F.concat(F.lit(" "), F.regexp_replace(x["low"], r"(?U)\s+", " "), F.lit(" "))
        words = lambda c: F.regexp_extract_all(c, F.lit(ALIAS_WORD), F.lit(0))
        bare = lambda w: F.transform(w, lambda x: F.btrim(x, F.lit(".-")))
        both = lambda c: F.transform(F.array(F.array_distinct(words(c))), lambda w: F.concat(w, bare(w)))[0]  # noqa: E731  each different word once
        return F.struct(low.alias("low"), both(x["blob"]).alias("words"), both(x["low"]).alias("folded"))

    def fired(x: Column, group: list[str]) -> Column:
        out = F.lit(False)
        for t in (t for t in group if len(t) >= 2):
            if " " in t:
                out = out | x["low"].contains(" " + t.casefold())
            elif len(t) <= 4:
                out = out | F.array_contains(x["words"], t)
            else:
                out = out | F.array_contains(x["folded"], t.casefold())
        return out

    none = F.array().cast("array<string>")
    all_ = lambda x: F.array_distinct(F.concat(*[F.when(fired(x, g), F.array(*[F.lit(t) for t in g if len(t) >= 2])).otherwise(none) for g in groups]))
    return F.transform(F.transform(F.array(whole), of), all_)[0]


def clauses(questions: DataFrame, qid: str, text: str, terms: Callable[[Column], Column] = index_terms) -> DataFrame:
    """``(qid, clause, phrase array<string>)`` of free text (X3): all clauses are asked for, and of a clause's phrases any.

    A quoted part is one phrase. Other words are split at hyphens, dashes and slashes, lose punctuation, and are a clause each; a
    decimal number is found as it is written or with its digits apart; a word with dots is a phrase.
    """
    parts = F.regexp_extract_all(fts_normal(F.col(text)), F.lit(r'"[^"]+"|\S+'), F.lit(0))
    rows = questions.select(F.col(qid).alias("qid"), F.posexplode(parts).alias("p", "part"))
    quoted = F.col("part").rlike(r'^".+"$')
    bits = F.when(quoted, F.array("part")).otherwise(F.filter(F.transform(F.split("part", r"[-–—/]+"), lambda b: F.regexp_replace(b, rf"(?U)[^\w.{KEEP}]", "")), lambda b: b != ""))
    rows = rows.select("qid", "p", F.posexplode(bits).alias("b", "bit"))
    apart = F.trim(F.regexp_replace("bit", r"(.)", "$1 "))
    forms = F.when(F.col("bit").rlike(r"^\d+\.\d+$"), F.array("bit", apart)).otherwise(F.array("bit"))
    rows = rows.select("qid", F.dense_rank().over(Window.partitionBy("qid").orderBy("p", "b")).alias("clause"), F.explode(forms).alias("form"))
    return rows.select("qid", "clause", terms(F.col("form")).alias("phrase")).where(F.size("phrase") > 0).distinct()


def variants(questions: DataFrame, qid: str, text: str, groups: list[list[str]], terms: Callable[[Column], Column] = index_terms) -> DataFrame:
    """``(qid, variant, clause, phrase)`` (X5): 0 the question; then each alias of the whole of it; then its words with their aliases
    beside them, where a word is an abbreviation: four characters or fewer, up to six capitals, or letters with digits."""
    spark = questions.sparkSession
    key = lambda c: F.trim(F.regexp_replace(nfkc_folded(c), r"\s+", " "))
    pairs = spark.createDataFrame([(t.casefold(), a, i) for g in groups for t in g for i, a in enumerate(g) if a != t], "key string, alias string, i int").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "alias"))).alias("a"))
    pairs = F.broadcast(pairs.select("key", F.array_distinct(F.col("a.alias")).alias("aliases")))  # the groups are a literal
    q = questions.select(F.col(qid).alias("qid"), F.col(text).alias("text"))
    first = clauses(q, "qid", "text", terms).withColumn("variant", F.lit(0))
    whole = q.withColumn("key", key(F.col("text"))).join(pairs, "key").select("qid", F.posexplode("aliases").alias("v", "text"))
    named = clauses(whole.withColumn("id", F.struct("qid", "v")), "id", "text", terms).select("qid.qid", "clause", "phrase", (F.col("qid.v") + 1).cast("int").alias("variant"))
    word = F.posexplode(F.regexp_extract_all("text", F.lit(r"[A-Za-zΩωφΦλΛ0-9._\-]+"), F.lit(0))).alias("clause", "word")
    short = (F.length("word") <= 4) | ((F.length("word") <= 6) & (F.upper("word") == F.col("word"))) | (F.col("word").rlike(r"\d") & F.col("word").rlike("[A-Za-z]") & (F.length("word") <= 12)) | F.col("word").rlike(r"[^\x00-\x7F]")
    each = q.select("qid", word).withColumn("key", key(F.col("word"))).join(pairs, "key", "left").withColumn("aliases", F.when(short, F.col("aliases")))
    changed = each.where("aliases is not null").select("qid").distinct()
    forms = F.explode(F.concat(F.array("word"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form")
    each = each.join(changed, "qid", "left_semi").select("qid", "clause", forms).select("qid", "clause", terms(F.col("form")).alias("phrase")).where(F.size("phrase") > 0)
    last = each.distinct().withColumn("variant", F.lit(1 << 20))
    return first.unionByName(named).unionByName(last).select("qid", "variant", "clause", "phrase")


def positions(docs: DataFrame, doc: str, text: str, asked: DataFrame, terms: Callable[[Column], Column] = index_terms) -> tuple[DataFrame, DataFrame]:
    """``(doc, term, at array<int>)`` for the terms of ``asked(phrase)``, and ``(doc, dl)``: in one pass over a table that has no stored
    index; see ``sources.sinks.write_index``. Each document also has a row for the term of no characters, which tells its length."""
    cut = docs.select(F.col(doc).alias("doc"), F.coalesce(terms(F.col(text)), F.array().cast("array<string>")).alias("w"))
    every = cut.select("doc", F.size("w").alias("dl"), F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "term"))
    wanted = asked.select(F.explode("phrase").alias("term")).unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    found = every.join(wanted, "term", "left_semi").groupBy("doc", "term", "dl").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    found = stored(found, "positions-")
    return found.where("term <> ''").select("doc", "term", "at"), found.where("term = ''").select("doc", "dl")


def phrase_hits(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """``(phrase, doc, tf)``: how often each phrase of ``asked(phrase)`` stands in each document that holds all its terms."""
    phrases = asked.select("phrase").distinct().select("phrase", F.posexplode("phrase").alias("i", "term"))
    met = postings.select("doc", "term", "at").join(phrases, "term")
    one = met.where(F.size("phrase") == 1).select("phrase", "doc", F.size("at").alias("tf"))
    many = met.where(F.size("phrase") > 1).groupBy("phrase", "doc").agg(F.collect_list(F.transform("at", lambda p: p - F.col("i"))).alias("starts")).where(F.size("starts") == F.size("phrase"))
    together = F.aggregate(F.slice("starts", 2, F.size("phrase")), F.col("starts")[0], lambda a, x: F.array_intersect(a, x))
    return one.unionByName(many.select("phrase", "doc", F.size(together).alias("tf"))).where("tf > 0")


def evaluate(asked: DataFrame, postings: DataFrame, lengths: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``(qid, variant, doc, score)`` of every document that meets all clauses of ``asked(qid, variant, clause, phrase)``; less is better.

    BM25 with a phrase as the unit, over all phrases asked for (X2, X4)."""
    hits = stored(phrase_hits(asked, postings), "hits-")
    df = hits.groupBy("phrase").agg(F.count("*").alias("df"))
    size = lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
    odds = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(odds <= 0, F.lit(IDF_FLOOR)).otherwise(odds)
    gain = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    wanted = asked.groupBy("qid", "variant").agg(F.countDistinct("clause").alias("clauses"))
    found = asked.join(hits, "phrase").groupBy("qid", "variant", "doc").agg(F.countDistinct("clause").alias("met"), F.collect_set(F.struct("phrase", "tf")).alias("p"))
    whole = found.join(wanted, ["qid", "variant"]).where("met = clauses").select("qid", "variant", "doc", F.explode("p").alias("p")).select("qid", "variant", "doc", "p.phrase", "p.tf")
    # ``size`` is one row.
    return whole.join(df, "phrase").join(lengths, "doc").crossJoin(F.broadcast(size)).groupBy("qid", "variant", "doc").agg((-F.sum(gain)).alias("score"))


def first_variant(scored: DataFrame, limit: int) -> DataFrame:
    """``(qid, doc, score, variant)``: of each variant's best ``max(8 limit, 60)`` documents, each with the score of the first variant
    that has it, not the best (L1)."""
    w = Window.partitionBy("qid", "variant").orderBy("score", "doc")
    best = scored.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max(OVERFETCH * limit, OVERFETCH_LEAST))
    return best.groupBy("qid", "doc").agg(F.min(F.struct("variant", "score")).alias("m")).select("qid", "doc", "m.score", "m.variant")


def adjusted(rows: DataFrame, rules: list[tuple[Column, float]], score: str = "score") -> DataFrame:
    """``score`` with the amount of every rule added that holds; a null condition does not."""
    out = F.col(score)
    for condition, amount in rules:
        out = out + F.when(condition, F.lit(float(amount))).otherwise(0.0)
    return rows.withColumn(score, out)


def one_a_page(rows: DataFrame, page: list[str], kind_rank: Column, nearer: float = 1.0) -> DataFrame:
    """One row for each question and page: the best by score, or one of a better kind that comes within ``nearer`` of the one that stood
    there, gone through in order of score; and ``collapsed``, how many others it stands for (W13)."""
    values = F.struct("score", "doc", kind_rank.alias("k"), *[c for c in rows.columns if c not in ("qid", *page, "score", "doc")])
    grouped = rows.groupBy("qid", *page).agg(F.array_sort(F.collect_list(values)).alias("all"))  # as many as the over-fetch at most
    better = lambda a, x: F.when((x["k"] < a["k"]) & (x["score"] <= a["score"] + nearer), x).otherwise(a)
    kept = F.aggregate(F.slice("all", 2, F.size("all")), F.col("all")[0], better)
    return grouped.select("qid", *page, kept.alias("kept"), (F.size("all") - 1).cast("long").alias("collapsed")).select("qid", *page, "kept.*", "collapsed").drop("k")


def ranked(rows: DataFrame, last: Column, limit: int) -> DataFrame:
    """The best ``limit`` rows of each question, numbered from 1; those of ``last`` come after all others (L4)."""
    w = Window.partitionBy("qid").orderBy(F.coalesce(last, F.lit(False)), "score", "doc")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)


def answer(questions: DataFrame, guard: DataFrame, by_id: Callable[[DataFrame], DataFrame], full_text: Callable[[DataFrame], DataFrame], keyword: Callable[[DataFrame], DataFrame], aliases: DataFrame, most: int = 6) -> DataFrame:
    """``(qid, doc, rank, stage, alias)`` of ``questions(qid, text)`` by the first way that finds something.

    Questions in ``guard(qid)`` are not searched at all. Then come an id, the full text, keywords, and the full text of a question's
    first ``most`` ``aliases(qid, ord, text)`` in order, of which the first that finds anything answers. Every way takes
    ``(qid, text)`` and gives ``(qid, doc, rank)``; each sees only what those before left open.
    """
    left = stored(questions.select("qid", "text").join(guard.select("qid"), "qid", "left_anti"), "open-")
    out = None
    for name, way in (("id", by_id), ("fts", full_text), ("keyword", keyword)):
        got = stored(way(left).select("qid", "doc", "rank"), f"{name}-")
        rows = got.withColumns({"stage": F.lit(name), "alias": F.lit(None).cast("string")})
        out = rows if out is None else out.unionByName(rows)
        left = stored(left.join(got.select("qid").distinct(), "qid", "left_anti"), "open-")
    asked = aliases.join(left.select("qid", F.col("text").alias("__own")), "qid").where((F.col("ord") < most) & (F.col("text") != F.col("__own")))
    asked = asked.select(F.concat_ws("\x1f", "qid", F.col("ord").cast("string")).alias("__q"), F.col("qid").alias("__of"), "ord", "text")
    got = full_text(asked.select(F.col("__q").alias("qid"), "text")).select(F.col("qid").alias("__q"), "doc", "rank").join(asked, "__q")
    got = stored(got.select(F.col("__of").alias("qid"), "ord", "doc", "rank", F.col("text").alias("alias")), "alias-")
    first = got.groupBy("qid").agg(F.min("ord").alias("ord"))
    return out.unionByName(got.join(first, ["qid", "ord"]).select("qid", "doc", "rank", F.lit("alias").alias("stage"), "alias"))

r"""Operator 12, importance resampling towards a target distribution, from a table of word positions.

Every text is exploded into its words and their positions. For each order up to ``orders`` window ``lead()`` over a
document's positions puts the following words beside a word, so every row holds the n-grams that start there. They are
hashed into ``buckets`` and counted, over all raw and all target documents; the gain of a bucket is the scaled log
ratio of its smoothed shares. The gains are joined back to the features and a document's weight is their floored mean.
Gumbel noise, fixed by seed and id, is added, and the ``percent`` highest scores of the documents with enough words are drawn and ranked.

An order of one needs no following words, hence no window: words are counted where they are read and no text or word
is shuffled. For more, texts are dealt by document once, as texts, and ``lead()`` works inside a partition; rows with
equal id and text are one row with a count from then on. The gains are broadcast: as many rows as buckets, which is
a million at most. Bucket counts and a document's sums are combined before they are shuffled. Ranks are a distributed
prefix sum over ranges of the scores, so no task sorts them all. The number of documents and two totals reach the driver.

Defined results: A-Z only are lower-cased; words are runs of digits, a-z and everything beyond ASCII. A null or empty
text has no features and weight 0. A null id draws its noise like an empty one. Repeated rows have equal scores and ranks
one after another; ties go to the smaller id, null first, then by a digest of the text. Other columns are not read,
whatever their names; an empty table gives none; without target documents the smoothed shares still give gains. A very long text is read
whole, and its words are one array while it is exploded.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.llm.common import kept, running_total, table
from ferrule.llm.sql import CRC_TABLE, crc32

ORDERS, BUCKETS, SEED, PERCENT, LEAST_WORDS, SCALE = 1, 10_000, "2024", 10, 20, 1000
MOST_BUCKETS = 1_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def positions(docs: DataFrame, id_col: str, text_col: str, orders: int) -> DataFrame:
    """``(id, digest, copies, pos, word)``: a row for each word, and one with nulls for a text without any."""
    rows = docs.select(F.col(id_col).alias("id"), F.md5(text_col).alias("digest"), F.col(text_col).alias("text"))
    if orders > 1:
        rows = rows.groupBy("id", "digest").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    words = F.regexp_extract_all(F.translate("text", ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0))
    return rows.select("id", "digest", "copies", F.posexplode_outer(words).alias("pos", "word"))


def grams(orders: int) -> list[Column]:
    """The n-grams that start at a row of ``positions``, one for each order; null where the text ends before."""
    document = Window.partitionBy("id", "digest").orderBy("pos")
    words = [F.col("word")] + [F.lead("word", n).over(document) for n in range(1, orders)]
    return [words[0]] + [F.when(words[n].isNotNull(), F.concat_ws(" ", *words[: n + 1])) for n in range(1, orders)]


def features(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, digest, copies, starts, bucket)`` of every n-gram; ``starts`` marks one row of each document, ``bucket`` is null if it has no word."""
    hashed = [F.pmod(F.crc32(g), F.lit(buckets)).cast("int") for g in grams(orders)]
    rows = positions(docs, id_col, text_col, orders)
    key, first = ("id", "digest", "copies"), F.coalesce(F.col("pos"), F.lit(0)) == 0
    if orders == 1:
        return rows.select(*key, first.alias("starts"), F.lit(0).alias("nth"), hashed[0].alias("bucket"))
    each = rows.select(*key, first.alias("first"), F.array_compact(F.array(*hashed)).alias("buckets")).select(*key, "first", F.posexplode_outer("buckets").alias("nth", "bucket"))
    return each.select(*key, (F.col("first") & (F.coalesce("nth", F.lit(0)) == 0)).alias("starts"), "nth", "bucket")


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = SCALE) -> DataFrame:
    """``(bucket, gain)`` of every bucket, from two tables of features."""
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets is {buckets}, but has to be from 1 to {MOST_BUCKETS}, as every executor holds the gains")
    count = lambda df, name: df.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("copies").alias(name))
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counted = kept(every.join(count(raw, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left").fillna(0, ["s", "t"]))
    total = counted.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    ratio = (F.col("t") + 1).cast("double") * F.lit(float(total.s + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(total.t + buckets)))
    return counted.select("bucket", F.floor(scale * F.log(ratio)).alias("gain"))


def noise(id_: Column, seed: str = SEED, scale: int = SCALE) -> Column:
    """Scaled Gumbel noise, floored, fixed by seed and id."""
    own = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(own, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 32))
    return F.floor(-scale * F.log(-F.log(u)))


def weigh(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", seed: str = SEED) -> DataFrame:
    """``(id, digest, copies, n_words, n_features, weight, score)``, a row for each different row of ``docs``."""
    found = features(docs, orders, buckets, id_col, text_col)
    gain = gains(found, features(target, orders, buckets, target_id, target_text), buckets)
    per = lambda c: F.coalesce(F.sum(F.when(c, F.col("copies"))), F.lit(0))
    sums = found.join(F.broadcast(gain), "bucket", "left").groupBy("id", "digest").agg(
        per(F.col("starts")).alias("copies"), per(F.col("bucket").isNotNull()).alias("all"), per(F.col("bucket").isNotNull() & (F.col("nth") == 0)).alias("words"), F.coalesce(F.sum(F.col("copies") * F.col("gain")), F.lit(0)).alias("sum")
    )
    weight = F.when(F.col("all") > 0, F.expr("cast((sum - pmod(sum, all)) div all as long)")).otherwise(F.lit(0))
    each = sums.select("id", "digest", "copies", F.expr("words div copies").alias("n_words"), F.expr("all div copies").alias("n_features"), weight.cast("long").alias("weight"))
    return each.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def resample(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", seed: str = SEED) -> DataFrame:
    """``(id, n_words, n_features, weight, score, rank)`` of every row of ``docs``; ``rank`` is null for what is not drawn."""
    weighed = kept(weigh(docs, target, orders, buckets, id_col, text_col, target_id, target_text, seed).withColumn("counted", F.when(F.col("n_words") >= least_words, F.col("copies")).otherwise(F.lit(0))))
    drawn = percent * (weighed.agg(F.sum("counted")).first()[0] or 0) // 100
    placed = running_total(weighed.withColumn("order", F.struct((-F.col("score")).alias("low"), "id", "digest")), "order", "counted")
    rank = F.col("total") + F.col("copy")
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", F.when((F.col("counted") > 0) & (rank <= drawn), rank).alias("rank"))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document, benchmark being the target."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = rf"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS word FROM documents
  UNION ALL
  SELECT 'b', item_id, unnest(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) FROM benchmark),
vocabulary AS (SELECT word, {crc32('word')} % {BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM words), {CRC_TABLE}),
found AS (SELECT side, id, bucket FROM words JOIN vocabulary USING (word)),
counted AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM found GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor({SCALE} * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM counted),
weighed AS (SELECT id AS doc_id, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM found JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-{SCALE} * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT {PERCENT} * count(*) // 100 FROM placed) THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""

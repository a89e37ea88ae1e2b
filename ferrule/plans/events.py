"""Queries of run events: a user is a run; conversations are agent transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.operators import events as E
from ferrule.plans import query, table


@query("""WITH l AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT user_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'running' END AS state, value FROM l WHERE r = 1""")
def event_status_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each run decides its state."""
    got = E.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])
    state = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "pending").otherwise("running")
    return got.select("user_id", state.alias("state"), "value")


@query("""WITH l AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
s AS (SELECT CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'running' END AS state, value FROM l WHERE r = 1)
SELECT count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'pending') AS pending,
  round(avg(value) FILTER (state = 'done'), 6) AS mean_s, round(count(*) FILTER (state IN ('running', 'pending')) * avg(value) FILTER (state = 'done') / 4, 6) AS eta_s FROM s""")
def event_progress(spark: SparkSession, d: str) -> DataFrame:
    """Progress and time left of a study."""
    s = event_status_latest(spark, d).select(F.col("user_id").alias("id"), "state", F.col("value").alias("seconds"))
    return E.progress(s, 4).withColumns({"mean_s": F.round("mean_s", 6), "eta_s": F.round("eta_s", 6)})


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id > 4000)
SELECT user_id, event_id, event_type FROM e WHERE r <= 25""")
def event_resume_since(spark: SparkSession, d: str) -> DataFrame:
    """A resumed read: what came after a number, the last of each run within a buffer."""
    return E.retain(E.since(table(spark, d, "events"), "event_id", 4000), ["user_id"], "event_id", 25).select("user_id", "event_id", "event_type")


@query("""WITH n AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role, true) AS new FROM conversations),
r AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM n)
SELECT conv_id, CAST(run AS BIGINT) AS run, role, min(turn) AS first, count(*) AS n, sha256(string_agg(text, '' ORDER BY turn)) AS digest FROM r GROUP BY conv_id, run, role""")
def event_token_islands(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive turns of a role become one line."""
    got = E.coalesce_runs(table(spark, d, "conversations"), ["conv_id"], "turn", "role", "text")
    return got.select("conv_id", "run", "role", "first", "n", F.sha2("text", 256).alias("digest"))


@query("""WITH a AS (SELECT *, 1 + coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS attempt FROM events),
l AS (SELECT user_id, attempt, count(*) AS n, sum(value) AS seconds, max(struct_pack(ts := ts, id := event_id, t := event_type)).t AS last FROM a GROUP BY ALL)
SELECT user_id, CAST(attempt AS BIGINT) AS attempt, n, round(seconds, 4) AS seconds, CASE WHEN last IN ('purchase') THEN 'final' WHEN last = 'signup' THEN 'paused' WHEN last = 'error' THEN 'retryable' WHEN last = 'click' THEN 'transient' ELSE 'other' END AS outcome FROM l""")
def event_attempts_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of a run and how each ended."""
    a = E.attempts(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    g = a.groupBy("user_id", "attempt").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("seconds"), F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return g.select("user_id", "attempt", "n", "seconds", E.classify(F.col("m.event_type")).alias("outcome"))


#: Steps of plans, in SQL: what fails, and what that means for the steps after it. A step of a skipped project cannot fail.
STEPS = """s AS (SELECT *, {due} AND o_orderstatus = 'F' AS failed FROM (SELECT o_custkey, o_orderpriority AS project, o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN 'stop' WHEN o_orderkey % 3 = 0 THEN 'skip_project' ELSE 'continue' END AS on_fail,
  CASE WHEN o_orderkey % 4 = 1 THEN 'done' ELSE 'pending' END AS was FROM orders)),
k AS (SELECT *, coalesce(bool_or(failed AND on_fail = 'skip_project') OVER (PARTITION BY o_custkey, project ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS skip FROM s),
w AS (SELECT *, coalesce(bool_or(failed AND NOT skip AND on_fail = 'stop') OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stop FROM k)
"""


def steps(spark: SparkSession, d: str) -> DataFrame:
    on_fail = F.when(F.col("o_orderkey") % 11 == 0, "stop").when(F.col("o_orderkey") % 3 == 0, "skip_project").otherwise("continue")
    was = F.when(F.col("o_orderkey") % 4 == 1, "done").otherwise("pending")
    return table(spark, d, "orders").withColumns({"on_fail": on_fail, "was": was})


@query("WITH " + STEPS.format(due="true") + """, r AS (SELECT o_custkey, CASE WHEN stop THEN 'not_run' WHEN skip THEN 'skipped' WHEN failed THEN 'failed' ELSE 'done' END AS status FROM w)
SELECT o_custkey, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'not_run') AS not_run FROM r GROUP BY 1""")
def plan_fail_policy(spark: SparkSession, d: str) -> DataFrame:
    """A plan's steps under their fail policies, summed by status."""
    r = E.plan_outcome(steps(spark, d), "o_custkey", "o_orderpriority", "o_orderkey", F.col("o_orderstatus") == "F", "on_fail")
    return r.groupBy("o_custkey").agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("done", "failed", "skipped", "not_run")])


@query("WITH " + STEPS.format(due="was = 'pending'") + """SELECT o_custkey, o_orderkey, CASE WHEN was <> 'pending' THEN was WHEN stop THEN 'not_run' WHEN skip THEN 'skipped' WHEN failed THEN 'failed' ELSE 'done' END AS status FROM w""")
def plan_resume(spark: SparkSession, d: str) -> DataFrame:
    """A resumed plan: only its pending steps run, and only they can fail."""
    r = E.plan_outcome(steps(spark, d), "o_custkey", "o_orderpriority", "o_orderkey", F.col("o_orderstatus") == "F", "on_fail", "was")
    return r.select("o_custkey", "o_orderkey", "status")


@query("""WITH s AS (SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'pending' ELSE 'done' END AS step FROM orders)
SELECT o_custkey, CASE WHEN bool_or(step = 'running') THEN 'interrupted' WHEN bool_or(step = 'pending') THEN 'pending' ELSE 'done' END AS status, count(*) FILTER (step = 'running') AS stopped, count(*) FILTER (step = 'pending') AS pending FROM s GROUP BY 1""")
def plan_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Plans that ran when the process ended are interrupted, their running steps stopped."""
    step = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "pending").otherwise("done")
    s = table(spark, d, "orders").select("o_custkey", step.alias("was"), E.recovered(step, "stopped").alias("step"))
    plan = F.when(F.bool_or(F.col("was") == "running"), "running").when(F.bool_or(F.col("was") == "pending"), "pending").otherwise("done")
    g = s.groupBy("o_custkey").agg(plan.alias("plan"), F.count_if(F.col("step") == "stopped").alias("stopped"), F.count_if(F.col("step") == "pending").alias("pending"))
    return g.select("o_custkey", E.recovered(F.col("plan"), "interrupted").alias("status"), "stopped", "pending")


@query("""WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, event_type, event_type || CASE WHEN value > 100 THEN ' late' ELSE '' END AS line FROM events),
v AS (SELECT *, CASE WHEN event_type NOT IN ('error', 'click', 'view') THEN 'ended' WHEN attempt >= 6 THEN 'limit' WHEN lag(line) OVER (PARTITION BY user_id ORDER BY attempt) = line THEN 'unmoved' ELSE 'retry' END AS verdict FROM l WHERE attempt <= 6),
m AS (SELECT *, coalesce(bool_and(verdict = 'retry') OVER (PARTITION BY user_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS made FROM v)
SELECT user_id, attempt, line, verdict, attempt >= 3 AS overridden FROM m WHERE made""")
def run_retries(spark: SparkSession, d: str) -> DataFrame:
    """The attempts of a run that a policy of six makes: a crash at the same line ends it, the third attempt changes fields."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    line = F.concat("event_type", F.when(F.col("value") > 100, " late").otherwise(""))
    log = table(spark, d, "events").select("user_id", "event_type", n.alias("attempt"), line.alias("line"))
    return E.retried(log, ["user_id"], "attempt", F.col("event_type").isin("error", "click", "view"), "line", 6).select("user_id", "attempt", "line", "verdict", "overridden")


@query(r"""WITH q AS (SELECT item_id, text, item_id % 3 AS k FROM benchmark UNION ALL SELECT item_id, replace(text, ' ', '  ') || ' ', item_id % 3 FROM benchmark),
n AS (SELECT item_id, ['auto', 'exact_table', 'fts'][k + 1] AS kind, trim(regexp_replace(lower(coalesce(text, '')), '\s+', CASE WHEN k = 1 THEN '' ELSE ' ' END, 'g')) AS t, CASE WHEN k = 2 THEN 'second' ELSE '' END AS doc, k FROM q)
SELECT sha256('{"collection":"","doc":"' || doc || '","neighbors":' || k || ',"query":' || to_json(t) || ',"type":"' || kind || '","want_commentary":' || CASE WHEN k = 0 THEN 'true' ELSE 'false' END || '}') AS key, min(item_id) AS first, count(*) AS asked FROM n GROUP BY 1""")
def canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    """Questions that differ in spaces, case and the names of their kind have one key."""
    from ferrule.functions.keys import canonical_key

    b = table(spark, d, "benchmark").select("item_id", "text")
    q = b.unionByName(b.withColumn("text", F.concat(F.replace("text", F.lit(" "), F.lit("  ")), F.lit(" ")))).withColumn("k", (F.col("item_id") % 3).cast("int"))
    kind = F.get(F.array(F.lit(None).cast("string"), F.lit("Table "), F.lit("fts")), F.col("k"))
    key = canonical_key({"second edition": "second"})(kind, F.col("text"), F.when(F.col("k") == 2, "Second Edition "), F.lit(None).cast("string"), F.when(F.col("k") > 0, F.col("k")), F.col("k") == 0)
    return q.select("item_id", key.alias("key")).groupBy("key").agg(F.min("item_id").alias("first"), F.count("*").alias("asked"))


@query(r"""WITH f AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user')
SELECT conv_id, turn, regexp_extract(text, '^([^.]*)', 1) AS brief FROM f WHERE r = 1""")
def brief_first_turn(spark: SparkSession, d: str) -> DataFrame:
    """The brief is the first sentence of the first user turn."""
    first = table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("m"))
    return first.select("conv_id", "m.turn", F.regexp_extract("m.text", r"^([^.]*)", 1).alias("brief"))


@query("""WITH k AS (SELECT sha256('{"limit":5,"query":' || to_json(text) || ',"type":"auto"}') AS key, item_id FROM benchmark UNION ALL
  SELECT sha256('{"limit":5,"query":' || to_json(text) || ',"type":"auto"}'), item_id + 1000 FROM benchmark WHERE item_id % 2 = 0)
SELECT key, min(item_id) AS created, max(item_id) AS last, count(*) - 1 AS hits FROM k GROUP BY key""")
def cache_key_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Canonical keys; a later put keeps what was first and counts hits."""
    b = table(spark, d, "benchmark")
    both = b.unionByName(b.where("item_id % 2 = 0").withColumn("item_id", F.col("item_id") + 1000))
    key = F.sha2(F.to_json(F.struct(F.lit(5).alias("limit"), F.coalesce("text", F.lit("")).alias("query"), F.lit("auto").alias("type"))), 256)
    return both.select(key.alias("key"), "item_id").groupBy("key").agg(F.min("item_id").alias("created"), F.max("item_id").alias("last"), (F.count("*") - 1).alias("hits"))


@query("""SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def events_daily(spark: SparkSession, d: str) -> DataFrame:
    """An extension: tumbling windows over event time, the batch form of the streaming rollup."""
    w = table(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("""SELECT * FROM events""")
def stream_events_append(spark: SparkSession, d: str) -> DataFrame:
    """The event log fed through a file stream, appended once by number, and read again."""
    from ferrule.streaming.events import replay

    return replay(spark, table(spark, d, "events"))


@query("""SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_rollup(spark: SparkSession, d: str) -> DataFrame:
    """An extension: the windowed rollup over the file stream, which ends with what the batch gives."""
    from ferrule.streaming.events import replay_rollup

    w = replay_rollup(spark, table(spark, d, "events"))
    return w.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", F.round("total", 4).alias("total"))


@query("""WITH l AS (SELECT CAST(user_id % 40 AS VARCHAR) AS run, CAST(event_id % 11 AS VARCHAR) AS id, event_id AS seq, event_type, value FROM events WHERE event_type <> 'view'),
b AS (SELECT *, row_number() OVER (PARTITION BY run, id ORDER BY seq DESC) AS r FROM l)
SELECT run, id, CASE event_type WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'done' END AS state, seq, round(CASE WHEN event_type IN ('purchase', 'signup') THEN value END, 6) AS seconds FROM b WHERE r = 1""")
def stream_status(spark: SparkSession, d: str) -> DataFrame:
    """Worker lines streamed from files in no order, some twice; the state of each id as it ends."""
    from ferrule.streaming.status import line_of, replay_status

    kind = F.col("event_type")
    event = F.when(kind == "click", "start").when(kind == "signup", "skip").when(kind.isin("purchase", "error"), "done")
    id_ = (F.col("event_id") % 11).cast("string")
    said = F.coalesce(F.when(event.isNotNull(), line_of(event, id_, kind == "purchase", F.col("value"))), F.concat(F.lit("[w1] "), kind))
    lines = table(spark, d, "events").select((F.col("user_id") % 40).alias("run"), F.col("event_id").alias("seq"), "ts", said.alias("line"))
    return replay_status(spark, lines).withColumn("seconds", F.round("seconds", 6))

"""Run events: latest status, progress, resumable reads, islands of tokens, attempts, and plans judged after the fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Outcomes by pattern, in order of precedence.
OUTCOMES = [("final", r"(?i)purchase|not found|invalid"), ("paused", r"(?i)signup|budget"), ("retryable", r"(?i)error|crash"), ("transient", r"(?i)click|timeout")]


def classify(text: Column) -> Column:
    """The first outcome whose pattern occurs, else ``other``."""
    out = F.lit("other")
    for name, pattern in reversed(OUTCOMES):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def latest(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last values of each group; one pre-aggregated maximum."""
    got = df.groupBy(*by).agg(F.max(F.struct(*order, *values)).alias("__m"))
    return got.select(*by, *[F.col("__m")[v].alias(v) for v in values])


def progress(status: DataFrame, workers: int) -> DataFrame:
    """Counts by state, mean seconds of what is done, and the time left at that pace. ``status(id, state, seconds)``."""
    done = F.col("state") == "done"
    g = status.agg(F.count_if(done).alias("done"), F.count_if(F.col("state") == "failed").alias("failed"), F.count_if(F.col("state") == "running").alias("running"), F.count_if(F.col("state") == "pending").alias("pending"), F.avg(F.when(done, F.col("seconds"))).alias("mean_s"))
    return g.withColumn("eta_s", (F.col("running") + F.col("pending")) * F.col("mean_s") / workers)


def since(df: DataFrame, seq: str, last: int) -> DataFrame:
    """What came after ``last``; pushed to the scan."""
    return df.where(F.col(seq) > last)


def retain(df: DataFrame, by: list[str], seq: str, n: int) -> DataFrame:
    """The last ``n`` events of each run."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(seq)))).where(F.col("__r") <= n).drop("__r")


def coalesce_runs(df: DataFrame, by: list[str], order: str, kind: str, text: str) -> DataFrame:
    """Consecutive rows of one kind become one line: ``(*by, run, kind, first, n, text)``."""
    w = Window.partitionBy(*by).orderBy(order)
    new = F.coalesce(F.lag(kind).over(w) != F.col(kind), F.lit(True)).cast("long")
    rows = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "")
    return rows.groupBy(*by, "run", kind).agg(F.min(order).alias("first"), F.count("*").alias("n"), joined.alias("text"))


def attempts(df: DataFrame, by: list[str], order: list[str], failed: Column) -> DataFrame:
    """Numbers attempts: a new one begins after a failure. ``attempt`` from 1."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("attempt", F.coalesce(F.sum(failed.cast("long")).over(w), F.lit(0)) + 1)


def retried(log: DataFrame, by: list[str], attempt: str, crashed: Column, line: str, most: int) -> DataFrame:
    """The attempts that a retry policy makes, with ``verdict`` and ``overridden``.

    A crash is tried again, up to ``most`` attempts of at most ten, unless its last line is that of the crash before (``unmoved``);
    from the third attempt on the fields to change are set. ``log`` has a row an attempt, numbered from 1; a null line is empty.
    """
    most = max(1, min(most, 10))
    w = Window.partitionBy(*by).orderBy(attempt)
    last = F.coalesce(F.col(line), F.lit(""))
    unmoved = F.coalesce(F.lag(last).over(w) == last, F.lit(False))
    verdict = F.when(~F.coalesce(crashed, F.lit(False)), "ended").when(F.col(attempt) >= most, "limit").when(unmoved, "unmoved").otherwise("retry")
    rows = log.where(F.col(attempt) <= most).withColumn("verdict", verdict)
    made = F.coalesce(F.min(F.col("verdict") == "retry").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    return rows.withColumn("__made", made).where("__made").drop("__made").withColumn("overridden", F.col(attempt) >= 3)


def recovered(status: Column, to: str) -> Column:
    """What was running when the process ended, as ``to``; any other status stays."""
    return F.when(status == "running", to).otherwise(status)


def plan_outcome(steps: DataFrame, plan: str, project: str, n: str, failed: Column, on_fail: str, status: str | None = None) -> DataFrame:
    """What would run, as ``status``: after a failed step that says ``stop`` nothing does, after one that says ``skip_project`` nothing
    of its project; else steps run. A step that did not run cannot fail, so that of a skipped project stops nothing. With
    ``status`` a plan is resumed: only steps that are ``pending`` run, the others stay what they are."""
    before = lambda *by: Window.partitionBy(*by).orderBy(n).rowsBetween(Window.unboundedPreceding, -1)
    due = F.lit(True) if status is None else F.col(status) == "pending"
    rows = steps.withColumn("__failed", due & failed)
    skip = F.coalesce(F.max(F.col("__failed") & (F.col(on_fail) == "skip_project")).over(before(plan, project)), F.lit(False))
    rows = rows.withColumn("__skip", skip)
    stop = F.coalesce(F.max(F.col("__failed") & ~F.col("__skip") & (F.col(on_fail) == "stop")).over(before(plan)), F.lit(False))
    rows = rows.withColumn("__stop", stop)
    out = F.when(F.col("__stop"), "not_run").when(F.col("__skip"), "skipped").when(F.col("__failed"), "failed").otherwise("done")
    out = out if status is None else F.when(due, out).otherwise(F.col(status))
    return rows.withColumn("status", out).drop("__failed", "__skip", "__stop")

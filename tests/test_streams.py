"""Live status and the queue of plans: against loops, over restarts, late and repeated lines, and batches that are cut off."""

import json
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ferrule.streaming import queue, status


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    status.prepare(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def line(event, id_=None, **more):
    return json.dumps({"event": event, "id": id_, **more})


def put(spark, folder, name, rows):
    """One parquet file with rows (run, seq, line), a second of time for each number."""
    spark.createDataFrame(rows, "run string, seq long, line string").withColumn("ts", F.timestamp_seconds("seq")).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def run(spark, folder, out, checkpoint, **more):
    stream = spark.readStream.schema("run string, seq long, line string, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)
    status.write_changes(status.statuses(stream, **more), out, checkpoint).awaitTermination()


def by_loop(rows):
    """The state of each (run, id) by the line of the highest number."""
    best = {}
    for r, seq, text in rows:
        try:
            e = json.loads(text) if text.startswith("{") else {}
        except ValueError:
            continue
        if e.get("event") in ("start", "done", "skip") and e.get("id") is not None:
            state = {"start": "running", "skip": "done"}.get(e["event"]) or ("done" if e.get("ok") else "failed")
            best[r, str(e["id"])] = max(best.get((r, str(e["id"])), (-1, "")), (seq, state))
    return {k: v[1] for k, v in best.items()}


def test_status_over_restarts_with_late_and_repeated_lines(rocks, tmp_path):
    draw = random.Random(7)
    rows = []
    for seq in range(300):
        kind = draw.choice(["start", "start", "done", "done", "skip", "text", "bad", "other"])
        said = {"text": "[w1] plain", "bad": '{"event": "start"', "other": '{"event": "note", "id": 3}'}.get(kind) or line(kind, draw.randrange(12), ok=draw.random() < 0.7, seconds=seq / 2)
        rows.append((f"r{draw.randrange(3)}", seq, said))
    draw.shuffle(rows)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for k in range(3):  # each part is a run of its own of the same stream, and repeats some lines of those before
        part = rows[k * 100 : (k + 1) * 100] + draw.sample(rows[: k * 100 + 1], min(20, k * 100 + 1))
        put(rocks, folder, f"f{k}", part)
        run(rocks, folder, out, checkpoint)
        changes = rocks.read.parquet(out)
        assert {(r.run, r.id): r.state for r in status.current(changes).collect()} == by_loop(rows[: (k + 1) * 100])
    seen = changes.groupBy("run", "id", "seq").count().where("count > 1").count()
    assert seen == 0  # a repeated line is no change


def test_the_end_of_a_run_drops_its_state(rocks, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    put(rocks, folder, "a", [("r", 1, line("start", 1)), ("r", 2, line("start", 2)), ("r", 3, line("done", 1, ok=True, seconds=2.5)), ("s", 1, line("start", 9))])
    run(rocks, folder, out, checkpoint)
    put(rocks, folder, "b", [("r", 5, line("finished"))])
    run(rocks, folder, out, checkpoint)
    now = {(r.run, r.id): (r.state, r.seq, r.seconds) for r in status.current(rocks.read.parquet(out)).collect()}
    assert now == {("r", "1"): ("done", 3, 2.5), ("r", "2"): ("interrupted", 5, None), ("s", "9"): ("running", 1, None)}
    put(rocks, folder, "c", [("r", 4, line("start", 3)), ("r", 2, line("start", 2))])  # late: the run does not come back
    run(rocks, folder, out, checkpoint)
    assert {(r.run, r.id): (r.state, r.seq, r.seconds) for r in status.current(rocks.read.parquet(out)).collect()} == now
    ids = rocks.read.format("statestore").option("path", checkpoint).option("stateVarName", "ids").load()
    assert {r.key.run for r in ids.select("key").collect()} == {"s"}


def test_silence_interrupts_and_is_forgotten(rocks, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    more = {"late": "10 seconds", "stall_s": 100, "forget_s": 1000}
    put(rocks, folder, "a", [("r", 1, line("start", 1)), ("r", 2, line("done", 2, ok=False))])
    run(rocks, folder, out, checkpoint, **more)
    put(rocks, folder, "b", [("s", 90, line("start", 1))])
    run(rocks, folder, out, checkpoint, **more)
    assert {(r.run, r.id): r.state for r in status.current(rocks.read.parquet(out)).collect()} == {("r", "1"): "running", ("r", "2"): "failed", ("s", "1"): "running"}
    put(rocks, folder, "c", [("s", 150, line("start", 2))])
    run(rocks, folder, out, checkpoint, **more)
    assert {(r.run, r.id): r.state for r in status.current(rocks.read.parquet(out)).collect()} == {("r", "1"): "interrupted", ("r", "2"): "failed", ("s", "1"): "running", ("s", "2"): "running"}
    put(rocks, folder, "d", [("s", 3000, line("done", 2, ok=True))])
    run(rocks, folder, out, checkpoint, **more)
    left = rocks.read.format("statestore").option("path", checkpoint).option("stateVarName", "ended").load()
    assert "r" not in {r.key.run for r in left.select("key").collect()}


def answers(spark, out):
    return {(r.plan, r.n): ([h.doc for h in r.hits], r.found, r.cached, r.batch) for r in queue.answered(spark, out).where("n IS NOT NULL").collect()}


def test_queue_answers_each_plan_once_whatever_is_cut_off(spark, tmp_path):
    inbox, out, done, checkpoint = (str(tmp_path / n) for n in ("in", "out", "done", "cp"))
    os.mkdir(inbox)
    asked = []

    def answer(q):
        asked.extend(r.text for r in q.collect())
        return q.where("text <> 'nothing'").select("qid", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("rank"), "text").select("qid", F.concat_ws("-", "text", "rank").alias("doc"), "rank", F.lit("fts").alias("stage"))

    def file(name, *queries, **more):
        with open(f"{inbox}/{name}.json", "w") as f:
            json.dump({"queries": [{"query": x, "limit": 2} for x in queries], **more}, f)

    file("b", "one", "nothing")
    file("a", "one", "two", plan_id="alpha")
    with open(f"{inbox}/c.json", "w") as f:
        f.write("no plan")
    cut = []

    def killed(q):
        cut.append(1)
        out_rows = answer(q)
        if len(cut) == 1:
            return out_rows.withColumn("doc", F.raise_error(F.lit("killed")))
        return out_rows

    with pytest.raises(StreamingQueryException):
        queue.drain(spark, inbox, out, done, checkpoint, killed, "f1").awaitTermination()
    queue.drain(spark, inbox, out, done, checkpoint, killed, "f1").awaitTermination()
    first = answers(spark, out)
    assert first == {("alpha", 1): (["one-1", "one-2"], True, False, 0), ("alpha", 2): (["two-1", "two-2"], True, False, 0), ("b", 1): (["one-1", "one-2"], True, False, 0), ("b", 2): ([], False, False, 0)}
    assert sorted(asked) == ["nothing", "nothing", "one", "one", "two", "two"]  # asked again by the second run, once each
    # Killed after its answers were written and before the batch was committed: the commit of batch 0 is taken away.
    os.remove(f"{checkpoint}/commits/0")
    if os.path.exists(f"{checkpoint}/commits/.0.crc"):
        os.remove(f"{checkpoint}/commits/.0.crc")
    queue.drain(spark, inbox, out, done, checkpoint, answer, "f1").awaitTermination()
    assert answers(spark, out) == first
    asked.clear()
    file("d", "two", "three")
    queue.drain(spark, inbox, out, done, checkpoint, answer, "f1").awaitTermination()
    assert asked == ["three"]  # the other is known for this corpus
    assert answers(spark, out) == first | {("d", 1): (["two-1", "two-2"], True, True, 1), ("d", 2): (["three-1", "three-2"], True, False, 1)}
    file("e", "two")
    queue.drain(spark, inbox, out, done, checkpoint, answer, "f2").awaitTermination()
    assert asked == ["three", "two"]  # another corpus, so asked anew
    got = {r.plan: (r.file, r.n_queries, r.n_found, r.n_cached) for r in queue.summary(queue.answered(spark, out)).collect()}
    assert got == {"alpha": ("a.json", 2, 2, 0), "b": ("b.json", 2, 1, 0), "c": ("c.json", 0, 0, 0), "d": ("d.json", 2, 2, 1), "e": ("e.json", 1, 1, 0)}
    archived = {f for _, _, names in os.walk(done) for f in names}
    assert {"a.json", "b.json", "c.json"} <= archived and not {"a.json", "b.json", "c.json"} & set(os.listdir(inbox))

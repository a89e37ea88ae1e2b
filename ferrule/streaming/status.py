"""Live status of runs: worker lines become the state of every id, kept over restarts and dropped at the end of a run."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ferrule.shared import new_path

#: What a worker's line may say.
EVENTS = ("start", "done", "skip", "finished")
CHANGES = "run string, id string, state string, seq long, seconds double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """``(run, seq, ts, ms, event, id, ok, seconds)`` of the lines that are JSON objects with a known event; all others are log text and go."""
    v = F.try_parse_json(F.when(F.col(line).startswith("{"), F.col(line)))
    get = lambda path, kind: F.try_variant_get(v, f"$.{path}", kind)
    rows = lines.select(F.col("run").cast("string").alias("run"), F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), get("event", "string").alias("event"), get("id", "string").alias("id"), F.coalesce(get("ok", "boolean"), F.lit(False)).alias("ok"), get("seconds", "double").alias("seconds"))
    return rows.where(F.col("event").isin(*EVENTS) & F.col("run").isNotNull() & F.col("seq").isNotNull() & F.col("ts").isNotNull() & (F.col("id").isNotNull() | (F.col("event") == "finished")))


def state_of(event: str, ok: bool) -> str:
    return {"start": "running", "skip": "done"}.get(event) or ("done" if ok else "failed")


#: Ids of a run whose state a task holds before it is written back.
HELD = 10_000


class Statuses(StatefulProcessor):
    """The state of each id of a run, by the line of the highest number; late and repeated lines change nothing.

    The ids of a run are a map in the state store, on disk; a batch is gone through line by line, and each id is read and written once for ``HELD`` ids. When a run says it has finished, or
    when by the time of all lines it has said nothing for ``stall_s`` seconds, ids that still run are interrupted and the state is dropped; a mark of the last
    number stays for ``forget_s`` seconds more, so that what comes late does not bring the run back.
    """

    def __init__(self, stall_s: int, forget_s: int) -> None:
        self.stall_ms, self.forget_ms = 1000 * stall_s, 1000 * forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getMapState("ids", "id string", "state string, seq long, seconds double")
        self.ended = handle.getValueState("ended", "seq long")

    def _wake(self, ms: int) -> None:
        """The one timer of a run."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ms)

    def _put(self, held: dict[str, tuple | None], changed: set[str]) -> None:
        for id_ in changed:
            self.ids.updateValue((id_,), held[id_])
        held.clear()
        changed.clear()

    def _close(self, run: str, seq: int, ms: int) -> Iterator[Row]:
        for (id_,), (state, at, seconds) in list(self.ids.iterator()):
            if state == "running":
                yield Row(run=run, id=id_, state="interrupted", seq=max(at, seq), seconds=seconds)
        self.ids.clear()
        self.ended.update((seq,))
        self._wake(ms + self.forget_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        run, last = key[0], self.ended.get()[0] if self.ended.exists() else None
        end, newest, ms = None, -1, 0
        held: dict[str, tuple | None] = {}  # each call of the state store is a message to the JVM
        changed: set[str] = set()
        for r in rows:
            if last is not None and r.seq <= last:
                continue
            newest, ms = max(newest, r.seq), max(ms, r.ms)
            if r.event == "finished":
                end = r.seq if end is None else max(end, r.seq)
                continue
            if r.id not in held:
                if len(held) >= HELD:
                    self._put(held, changed)
                held[r.id] = tuple(self.ids.getValue((r.id,))) if self.ids.containsKey((r.id,)) else None
            if held[r.id] is not None and held[r.id][1] >= r.seq:
                continue
            state = state_of(r.event, r.ok)
            held[r.id] = (state, r.seq, r.seconds if state == "done" else None)
            changed.add(r.id)
            yield Row(run=run, id=r.id, state=state, seq=r.seq, seconds=r.seconds if state == "done" else None)
        self._put(held, changed)
        if end is not None:
            yield from self._close(run, end, ms)
        elif newest >= 0:
            self._wake(ms + self.stall_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        seen = [at for _, (_, at, _) in self.ids.iterator()]
        if seen:
            yield from self._close(key[0], max(seen), expiredTimerInfo.getExpiryTimeInMs())
        else:
            self.ended.clear()


def statuses(lines: DataFrame, late: str = "1 day", stall_s: int = 3600, forget_s: int = 86_400) -> DataFrame:
    """A stream of changes ``(run, id, state, seq, seconds)`` out of a stream ``lines(run, seq, ts, line)``.

    Lines older than the newest by more than ``late`` are not read. A run is a group of state, and a run's lines go through one task of a
    batch; the session's state store has to be RocksDB (``prepare``).
    """
    timed = parsed(lines).withWatermark("ts", late)
    return timed.groupBy("run").transformWithState(Statuses(stall_s, forget_s), CHANGES, "Update", "EventTime")


def prepare(spark: SparkSession) -> None:
    """State with maps and timers is kept by RocksDB, outside the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def write_changes(changes: DataFrame, out: str, checkpoint: str):
    """Writes each batch of changes to a folder of its own, which a batch that runs again overwrites, so that nothing stands twice."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def current(changes: DataFrame) -> DataFrame:
    """The latest state of every id: an interruption after what it interrupts, then by number."""
    late = F.struct("seq", F.col("state") == "interrupted", "state", "seconds").alias("m")
    return changes.groupBy("run", "id").agg(F.max(late).alias("m")).select("run", "id", "m.state", "m.seq", "m.seconds")


def replay_status(spark: SparkSession, lines: DataFrame, files: int = 4) -> DataFrame:
    """Streams ``lines`` from files, two at a time, in no order of their numbers and some of them twice; and reads where every id stands."""
    at = new_path(spark, "stream-")
    shape = lines.select(F.col("run").cast("string").alias("run"), F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "line")
    shape.repartition(files, F.xxhash64("seq")).write.parquet(f"{at}/in")
    shape.where("seq % 5 = 0").repartition(1).write.mode("append").parquet(f"{at}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    prepare(spark)
    try:
        stream = spark.readStream.schema(shape.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
        write_changes(statuses(stream, "10000 days", 100_000 * 86_400), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return current(spark.read.parquet(f"{at}/out"))


def line_of(event: Column, id_: Column, ok: Column, seconds: Column) -> Column:
    """A worker's line."""
    return F.to_json(F.struct(event.alias("event"), id_.alias("id"), ok.alias("ok"), seconds.alias("seconds")))

"""Event streams: a file source, exactly-once append by number, a rollup with a watermark, and latest status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.shared import new_path


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the parquet files that arrive in ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append_once(stream: DataFrame, out: str, checkpoint: str, key: str = "event_id"):
    """Appends a stream of events, each number once, whatever its age; the checkpoint makes a restart resume.

    Without a watermark no event is late, and the state holds every number that was ever appended.
    """
    kept = stream.withColumn("ts", F.col("ts").cast("timestamp")).dropDuplicates([key])
    return kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def rollup(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by kind and window of event time, with a watermark for late events."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("event_type", F.window("ts", width)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def replay(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Writes ``events`` to a folder, part of them twice, streams them through ``append_once``, and reads the result."""
    at = new_path(spark, "stream-")
    events.write.parquet(f"{at}/in")
    events.where(F.col("event_id") % 10 == 0).write.mode("append").parquet(f"{at}/in")
    query = append_once(read_events(spark, f"{at}/in", events.schema), f"{at}/out", f"{at}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def replay_rollup(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Streams ``events`` through ``rollup`` a few files at a time, and reads the last result; it is kept whole, so no event is late."""
    at = new_path(spark, "stream-")
    events.write.parquet(f"{at}/in")
    stream = rollup(read_events(spark, f"{at}/in", events.schema))
    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{at}/out")).start()
    query.awaitTermination()
    return spark.read.parquet(f"{at}/out")

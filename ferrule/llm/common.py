"""What several operators share: reading tables, cutting lineage in the shared folder, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.shared import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone, so any store that Spark opens will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map over Arrow batches that gives its memory back when a task ends, as an idle worker stays in its executor."""

    def tidied(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


def whole_numbers(df: DataFrame, *cols: str) -> None:
    """Ids that are compared and minimised as longs have to be whole numbers; others are an error, not nulls."""
    for c in cols:
        if not isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            raise TypeError(f"{c} is {df.schema[c].dataType.simpleString()}, but has to be a whole number")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Cuts the lineage, outlives any executor, and lets the planner know the real size of what follows. ``ferrule.shared.release``
    deletes these tables once results are written elsewhere.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])).parquet(path)


def bucketed(df: DataFrame, col: str) -> DataFrame:
    """``kept``, in buckets of ``col``: what is later joined or ordered by ``col`` meets these rows without shuffling them again.

    The catalogue knows the table only while it is read for the first time.
    """
    spark = df.sparkSession
    name = f"ferrule_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", new_path(spark)).bucketBy(n, col).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  resolved here, with its buckets
    spark.sql(f"DROP TABLE {name}")
    return out


def bitmap(values: DataFrame, col: str, bits: int = 1 << 20) -> Column:
    """A scalar subquery that holds a bit for every hash of ``values[col]``, to filter by before a join.

    ``bits`` bounds what is sent (128 KB by default) whatever the number of values; where they crowd it, it lets more
    pass and the join still decides.
    """
    hashes = values.select(F.pmod(F.xxhash64(F.col(col).cast("string")), F.lit(bits)).alias("h"))
    set_ = hashes.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b"))
    dense = values.sparkSession.range(bits // 64).join(set_, F.col("id") == F.col("w"), "left").select("id", F.coalesce("b", F.lit(0)).alias("b"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "b"))), lambda x: x["b"]).alias("m")).scalar()


def bits_for(n: int) -> int:
    """Bits for a bitmap of ``n`` values: sixteen a value, 8 MB at most."""
    return min(1 << 26, max(1 << 14, 1 << (16 * max(n, 1) - 1).bit_length()))


def may_hold(held: Column, col: str, bits: int = 1 << 20) -> Column:
    """Whether ``bitmap`` may hold the value of ``col``: false is certain."""
    h = F.pmod(F.xxhash64(F.col(col).cast("string")), F.lit(bits))
    return F.getbit(F.get(held, F.shiftright(h, 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: one row ``(node, root)`` for every node of an edge.

    ``root`` is the smallest node reachable. Alternating large-star and small-star rounds; each is two
    pre-aggregated minima and two joins that Spark may split where a node has very many neighbours, and each
    round's edges are written to the shared folder. Only a count and a checksum reach the driver.
    Loops and repeated edges are ignored; no edges give no rows.
    """

    def pairs(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = kept(pairs(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "a", "b"))
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = pairs(both.join(low, "a").where("b > a"), "b", "m")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        e = kept(pairs(small, "a", "b"))
        now = state(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def running_total(df: DataFrame, order: str, value: str, total: str = "total") -> DataFrame:
    """``df`` with ``total``: the sum of ``value`` over all rows before this one in the order of the distinct column ``order``.

    A distributed prefix sum: rows are range-partitioned, each partition is summed, the sums (one a partition) are added
    up, and a window inside each partition does the rest.
    """
    from pyspark.sql import Window

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(df.repartitionByRange(n, order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(F.col("__part").alias("p")).agg(F.sum(value).alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(sums), F.col("__part") == F.col("p"))  # as many rows as partitions
    return out.withColumn(total, F.col("__offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__part", "__offset", "p")

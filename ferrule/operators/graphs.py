"""Graphs in rounds: what is reached, the order in which dependencies come, the cycles that hold it up, and a selection with all it brings.

Every round writes what it has found to a folder of its own and reads the folders before, so a plan does not grow with the rounds and no round writes again what others wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.shared import new_path, stored


class Rounds:
    """The rows of all rounds so far, and the number of their round."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark, self.path, self.name = df.sparkSession, new_path(df.sparkSession, "rounds-"), name
        self.schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def add(self, df: DataFrame, n: int) -> DataFrame:
        """Writes the rows of round ``n`` and reads them."""
        df.write.parquet(f"{self.path}/{self.name}={n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.name}={n}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def closure(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """``(node, depth)`` reachable from ``start(node)`` over ``edges(src, dst)``: breadth first, one anti-joined step a round.

    Goes on until nothing new is reached; ``most`` rounds that do not end are an error, never a shorter answer.
    """
    begin = start.select("node").distinct()
    seen, depth = Rounds(begin, "depth"), 0
    front = seen.add(begin, 0)
    while most is None or depth < most:
        depth += 1
        found = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen.all().select("node"), "node", "left_anti")
        front = seen.add(found, depth)
        if front.isEmpty():
            return seen.all()
    raise RuntimeError(f"the closure goes on after {most} rounds")


def layers(nodes: DataFrame, needs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The order in which ``nodes(node)`` come after what they need, ``needs(node, needs)``: ``(node, layer)``, and what has none.

    Layer 0 needs nothing, every other layer only what is in earlier ones, one of them in the layer before. What is no node is taken to be there
    already. Then ``(node, cycle)`` of nodes that cannot come: in a cycle, named by its least node, or null for those that only wait for one. A round takes
    all that is ready, counts it off what waits for it, and reads the edges once.
    """
    all_ = stored(nodes.select("node").distinct(), "nodes-")
    edges = stored(needs.select("node", "needs").distinct().join(all_, "node", "left_semi").join(all_.withColumnRenamed("node", "needs"), "needs", "left_semi").select("node", "needs"), "edges-")
    missing = edges.groupBy("node").agg(F.count("*").alias("missing"))
    pending = stored(all_.join(missing, "node", "left").select("node", F.coalesce("missing", F.lit(0)).alias("missing")), "pending-")
    placed, n = Rounds(all_, "layer"), 0
    while True:
        front = placed.add(pending.where("missing = 0").select("node"), n)
        if front.isEmpty():
            break
        met = edges.join(front.withColumnRenamed("node", "needs"), "needs", "left_semi").groupBy("node").agg(F.count("*").alias("met"))
        pending = stored(pending.where("missing > 0").join(met, "node", "left").select("node", (F.col("missing") - F.coalesce("met", F.lit(0))).alias("missing")), "pending-")
        n += 1
    left = pending.select("node")
    held = edges.join(left, "node", "left_semi").join(left.withColumnRenamed("node", "needs"), "needs", "left_semi").select(F.col("node").alias("src"), F.col("needs").alias("dst"))
    return placed.all(), left.join(cycles(held), "node", "left")


def _spread(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """``marks(node, mark)`` with the least mark that reaches each node over ``edges(src, dst)``, its own among them."""
    while True:
        came = edges.join(marks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("mark").alias("came"))
        after = stored(marks.join(came, "node", "left").select("node", F.least("mark", "came").alias("mark"), (F.col("came") < F.col("mark")).alias("less")), "marks-")
        if after.where("less").isEmpty():
            return marks
        marks = after.select("node", "mark")


def cycles(edges: DataFrame) -> DataFrame:
    """``(node, cycle)`` of the nodes in a cycle of ``edges(src, dst)``: those that reach each other, named by the least of them.

    The least node that reaches a node colours it; of a colour, what reaches back to its first node is one group with it and goes. As many rounds as colours
    nest, each of as many steps as a path is long.
    """
    edges = stored(edges.select("src", "dst").distinct(), "edges-")
    out = None
    while not edges.isEmpty():
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        colour = stored(_spread(edges, stored(nodes.withColumn("mark", F.col("node")), "marks-")), "colours-")
        own = edges.join(colour.select(F.col("node").alias("src"), F.col("mark").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("mark").alias("d")), "dst").where("c = d")
        back = stored(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "back-")
        group = closure(back, colour.where("node = mark")).select("node").join(colour, "node")
        real = group.join(back.select(F.col("src").alias("node")).distinct(), "node", "left_semi")  # a node of its own only with an edge to itself
        sizes = real.groupBy("mark").agg(F.count("*").alias("n"))
        loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
        found = stored(real.join(sizes, "mark").join(loops, "node", "left").where("n > 1 OR loop").select("node", F.col("mark").alias("cycle")), "cycles-")
        out = found if out is None else out.unionByName(found)
        gone = stored(group.select("node"), "gone-")
        edges = stored(edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "edges-")
    return out if out is not None else edges.select(F.col("src").alias("node"), F.col("dst").alias("cycle"))


def selection(variants: DataFrame, chosen: DataFrame, always: str = "strict", ladder: Column | None = None, last: str = "compliant") -> DataFrame:
    """``(job, name, ord)`` of what a choice of variants brings, in the order of the catalogue ``variants(job, name, ord, applies, alias)``.

    ``always`` is in. A step of the ladder (names that begin with ``cum:``) brings all its steps that apply, and ``last`` if it applies; ``last`` alone brings the
    ladder up to the step that it copies. Then whatever a row copies, its ``alias``, until nothing is added. A choice that no variant has or that does
    not apply makes its job an error: ``name`` is null and ``error`` says which.
    """
    step = F.col("name").startswith("cum:") if ladder is None else ladder
    own = chosen.select("job", "name").distinct().join(variants.select("job", "name", "applies"), ["job", "name"], "left")
    bad = own.where(~F.coalesce("applies", F.lit(False))).groupBy("job").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.when(F.col("applies").isNull(), "no such variant: ").otherwise("does not apply: "), "name"))), "; ").alias("error"))
    good = own.join(bad, "job", "left_anti").select("job", "name")
    jobs = chosen.select("job").distinct().join(bad, "job", "left_anti")
    asked = good.groupBy("job").agg(F.bool_or(step).alias("climbs"), F.bool_or(F.col("name") == last).alias("ends"))
    steps = variants.where(step & F.col("applies")).select("job", "name", "ord")
    top = variants.where((F.col("name") == last)).select("job", F.col("alias").alias("name")).join(steps, ["job", "name"]).select("job", F.col("ord").alias("top"))
    on = steps.join(asked, "job").join(top, "job", "left").where("climbs OR (ends AND ord <= top)").select("job", "name")
    end = variants.where((F.col("name") == last) & F.col("applies")).join(asked.where("climbs"), "job").select("job", "name")
    start = good.unionByName(jobs.select("job", F.lit(always).alias("name"))).unionByName(on).unionByName(end)
    node = lambda name: F.struct(F.col("job").alias("job"), F.col(name).alias("name"))
    copies = variants.where("alias IS NOT NULL").join(variants.select("job", F.col("name").alias("alias")), ["job", "alias"], "left_semi").select(node("name").alias("src"), node("alias").alias("dst"))
    want = closure(copies, start.select(node("name").alias("node"))).select("node.job", "node.name")
    rows = variants.where("applies").join(want, ["job", "name"], "left_semi").select("job", "name", "ord", F.lit(None).cast("string").alias("error"))
    return rows.unionByName(bad.select("job", F.lit(None).cast("string").alias("name"), F.lit(None).cast(variants.schema["ord"].dataType).alias("ord"), "error"))

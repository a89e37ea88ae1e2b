"""Operator 9, near-duplicate embeddings with a forest of random-projection trees.

Equal vectors are collapsed first, by a 128-bit hash; a class carries its smallest id and its size. A tree splits at the median
of a random projection, one direction a level, and a vector within the spill margin of a split goes to both sides. The margin
is absolute, in proportion to how far apart two vectors at the threshold project, so the chance that a split parts a
linked pair is the same at every level; the number of trees follows from that chance and the depth. Where most of a node
lies in the margin, splitting would only copy it, and the node stays a leaf however large it is. Leaves are large, as a
comparison costs less than the copies that more levels make.

Medians are fitted on a bounded sample of classes; levels below what the sample resolves split at zero. Every class is
indexed in every tree. Leaves are compared by exact cosines in double precision, in blocks of at most ``BLOCK`` classes
a side, so no leaf is too large for a task. A pair counts in the first leaf that holds both, which the codes of the leaves
before it tell, so no pair is emitted: a leaf gives each class a number of links and a root of its local
union-find. Sums and connected components finish the job. A vector is shuffled once for each leaf it is in, in the type it
came in, and once more where the leaf is in blocks; all else moves ids.

Defined results: a vector that is null, empty or zero, or holds a null or non-finite component, has no links and is its
own component; vectors of different lengths never link (each length has a forest of its own); equal vectors link with each
other; repeated rows count as other vectors; a null id takes the component of its vector's class, and a class
without any id is compared with no other; other columns are not
read; an empty table gives none; a very long vector takes memory in proportion to it, ``BLOCK`` times.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import bitmap, bits_for, components, kept, may_hold, table, tidy, whole_numbers

THRESHOLD, LEAF, SPILL, SAMPLE, MISS, SEED, BLOCK, MOST_TREES = 0.9, 1024, 0.25, 20_000, 2e-2, 11, 1536, 127
#: A node is not split if more than this share of it would go both ways.
CROWDED = 0.5
#: Sampled classes below which a median says nothing.
RESOLVED = 24


class Forest:
    """The trees for vectors of one length: directions by (tree, level), split values by node, both small."""

    def __init__(self, sample: np.ndarray, total: int, dim: int, threshold: float, seed: int = SEED):
        self.dim, self.gap = dim, math.sqrt(max(2 - 2 * threshold, 1e-9) / max(dim, 1))
        self.margin = SPILL * self.gap
        depth = max(1, math.ceil(math.log2(max(2, total / LEAF))))
        parted = 0.4 * math.sqrt(dim) * 2 * self.gap * self._beyond(2 * SPILL)
        together = (1 - min(0.9, parted)) ** depth
        self.trees = max(4, math.ceil(math.log(MISS) / math.log(1 - together))) if together < 1 else 1
        if self.trees > MOST_TREES:
            warnings.warn(f"{self.trees} trees are needed to miss {MISS} of links at most; {MOST_TREES} are grown", stacklevel=2)
            self.trees = MOST_TREES
        rng = np.random.default_rng([seed, dim])
        self.depth = depth + 24
        self.directions = rng.standard_normal((self.trees, self.depth, dim)).astype(np.float64)
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True) + 1e-300
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for t in range(self.trees):
            self.nodes.append(self._grow(sample, t, total / max(1, len(sample))))

    @staticmethod
    def _beyond(a: float) -> float:
        """Mean excess over ``a`` of a standard normal, one side."""
        return math.exp(-a * a / 2) / math.sqrt(2 * math.pi) - a * 0.5 * math.erfc(a / math.sqrt(2))

    def _grow(self, sample: np.ndarray, tree: int, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Split value, first child (0: a leaf; the second follows) and levels below it that split at zero, by node."""
        split, child, more = [0.0], [0], [0]
        todo = [(0, np.arange(len(sample)), 0)]
        while todo:
            node, rows, level = todo.pop()
            if len(rows) * weight <= LEAF or level >= self.depth - 24:
                continue
            if len(rows) < RESOLVED:
                more[node] = max(0, math.ceil(math.log2(max(1, len(rows)) * weight / LEAF)))
                continue
            p = sample[rows] @ self.directions[tree, level]
            cut = float(np.median(p))
            left, right = rows[p < cut + self.margin], rows[p >= cut - self.margin]
            if len(left) + len(right) > (1 + CROWDED) * len(rows):
                continue
            split[node], child[node] = cut, len(split)
            for side in (left, right):
                todo.append((len(split), side, level + 1))
                split.append(0.0), child.append(0), more.append(0)
        return np.array(split), np.array(child), np.array(more)

    def codes(self, x: np.ndarray) -> list[list[int]]:
        """The leaves of every row of unit vectors ``x``, over all trees, as sorted codes."""
        rows, out = [], []
        for t, (split, child, more) in enumerate(self.nodes):
            p = x @ self.directions[t].T
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            bits, below = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for level in range(self.depth):
                inner, extra = child[node] > 0, (child[node] == 0) & (below < more[node])
                done = ~(inner | extra)
                if done.any():
                    rows.append(row[done])
                    out.append(((self.dim % 4096) << 51) + (t << 44) + (node[done] << 24) + (1 << below[done]) + bits[done])
                    row, node, bits, below, inner = row[~done], node[~done], bits[~done], below[~done], inner[~done]
                if not len(row):
                    break
                at = p[row, level]
                left, right = at < split[node] + self.margin, at >= split[node] - self.margin
                step = [(np.where(inner, child[node] + side, node)[go], np.where(inner, bits, 2 * bits + side)[go], (below + ~inner)[go], row[go]) for side, go in ((0, left), (1, right))]
                node, bits, below, row = (np.concatenate(z) for z in zip(*step, strict=True))
        row, code = np.concatenate(rows), np.concatenate(out)
        order = np.lexsort((code, row))
        return [c.tolist() for c in np.split(code[order], np.cumsum(np.bincount(row, minlength=len(x)))[:-1])]


def unit(vectors: pa.ListArray, dim: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _padded(codes: pa.ListArray) -> np.ndarray:
    """Leaf codes as (row, place), padded with -1."""
    flat, sizes = codes.flatten().to_numpy(), np.diff(codes.offsets.to_numpy())
    out = np.full((len(codes), int(sizes.max(initial=0))), -1, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _first_here(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the classes ``i`` and ``j`` share no leaf among ``codes``, those before this one. Most share one of the first."""
    out = np.ones(len(i), bool)
    for at in range(0, len(i), 8192):
        left = np.arange(at, min(at + 8192, len(i)))
        for k in range(codes.shape[1]):
            own = codes[i[left], k]
            shared = ((own[:, None] == codes[j[left]]) & (own >= 0)[:, None]).any(axis=1)
            out[left[shared]] = False
            left = left[~shared]
            if not len(left):
                break
    return out


def _compare(t: pa.Table, dim: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """One leaf, or one pair of a large leaf's blocks: number of links first found here, and local root, by class."""
    rep, copies, block = (t.column(c).to_numpy() for c in ("rep", "copies", "block"))
    one, two = (t.column(c)[0].as_py() for c in ("one", "two"))
    x = unit(t.column("vector").combine_chunks(), dim)
    near = x @ x.T >= threshold
    if one != two:
        near &= block[:, None] != block[None, :]
    np.fill_diagonal(near, False)
    linked = np.flatnonzero(near.any(axis=1))
    if not len(linked):
        return
    i, j = np.nonzero(np.triu(near))
    first = _first_here(_padded(t.column("before").combine_chunks()), i, j)
    i, j = i[first], j[first]
    links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
    root = rep.copy()
    seen = np.zeros(len(rep), bool)
    for s in linked:
        if not seen[s]:
            group = np.zeros(len(rep), bool)
            front = np.array([s])
            while len(front):
                group[front] = True
                front = np.flatnonzero(near[front].any(axis=0) & ~group)
            seen |= group
            root[group] = rep[group].min()
    yield pa.record_batch([pa.array(rep[linked]), pa.array(links[linked].astype(np.int64)), pa.array(root[linked])], names=["rep", "links", "root"])


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """``(id, n_links long, component_id long)`` of every row of ``vectors``."""
    spark = vectors.sparkSession
    whole_numbers(vectors, id_col)
    float_ = isinstance(vectors.schema[vector_col].dataType.elementType, (T.FloatType, T.ByteType, T.ShortType))
    kind = "float" if float_ else "double"  # no more bytes than came in; cosines are taken in doubles
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda v: v.cast(kind)).alias("vector"))
    sound = F.coalesce(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(sound, F.transform("vector", lambda v: v + F.lit(0.0).cast(kind))))
    key = F.when(F.col("vector").isNotNull(), F.struct(F.xxhash64("vector"), F.xxhash64(F.lit(SEED), "vector")))
    rows = kept(rows.select("id", key.alias("key"), "vector"))
    classes = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = kept(classes.withColumn("dim", F.size("vector")))
    usable = classes.where("rep is not null")
    totals = {r.dim: r.n for r in usable.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    links = edges = None
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for dim, total in sorted(totals.items()):
        own = usable.where(F.col("dim") == dim)
        sample = own.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("vector").toArrow().column(0)
        shared = spark.sparkContext.broadcast(Forest(unit(sample.combine_chunks(), dim), total, dim, threshold))

        def index(batches: Iterator[pa.RecordBatch], dim: int = dim, shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):  # every class of a length is sound
                    codes = shared.value.codes(unit(b.column(2), dim))
                    yield pa.record_batch([*b.columns, pa.array(codes, pa.list_(pa.int64()))], names=["rep", "copies", "vector", "codes"])

        def compare(batches: Iterator[pa.RecordBatch], dim: int = dim) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            key = None
            for b in batches:
                if not len(b):
                    continue
                k = np.stack([b.column(c).to_numpy() for c in ("code", "one", "two")])
                cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), len(b)]
                for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                    at = tuple(k[:, s])
                    if key is not None and at != key:
                        yield from _compare(pa.Table.from_batches(held), dim, threshold)
                        held = []
                    key = at
                    held.append(b.slice(s, e - s))
            if held:
                yield from _compare(pa.Table.from_batches(held), dim, threshold)

        indexed = kept(own.select("rep", "copies", "vector").mapInArrow(tidy(index), f"rep long, copies long, vector array<{kind}>, codes array<long>"))
        sizes = kept(indexed.select(F.explode("codes").alias("code")).groupBy("code").count().where(F.col("count") > BLOCK).select("code", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
        bits = bits_for(sizes.count())
        large = may_hold(bitmap(sizes, "code", bits), "code", bits)
        copies = indexed.select("rep", "copies", "vector", "codes", F.posexplode("codes").alias("place", "code")).withColumn("before", F.slice("codes", 1, F.col("place"))).drop("codes", "place")
        # Only the classes of large leaves are shuffled to learn in how many blocks they are dealt.
        whole = copies.where(~large).select("*", *[F.lit(0).alias(c) for c in ("block", "one", "two")])
        split = copies.where(large).join(sizes, "code", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        split = split.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
        dealt = whole.unionByName(split.select(whole.columns)).repartition(n, "code", "one", "two").sortWithinPartitions("code", "one", "two")
        found = kept(dealt.mapInArrow(tidy(compare), "rep long, links long, root long"))
        links = found if links is None else links.unionByName(found)
    if links is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    edges = links.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    roots = components(edges)
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    by_class = classes.select("key", "rep", "copies").join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    by_class = by_class.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    alone = [F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")]
    out = rows.where("key is not null").select("id", "key").join(by_class, "key")
    out = out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.unionByName(rows.where("key is null").select(*alone))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    found = near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: All pairs, for small tables: the forest has to find what this finds.
OP9_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, len(embedding) AS n FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, n, sqrt(list_inner_product(e, e)) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.n = b.n AND a.vec_id <> b.vec_id
      WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {THRESHOLD}),
c(id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.id, l.b FROM c JOIN l ON c.reached = l.a),
r AS (SELECT id, min(reached) AS root FROM c GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, r.root AS component_id, e.vec_id = r.root AS kept
FROM embeddings e JOIN r ON r.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

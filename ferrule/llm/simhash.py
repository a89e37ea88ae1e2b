r"""Operator 6, SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: the 64-bit SimHash of a text's three-word shingles (XXH64, seed 42), made in one Arrow map over the texts;
from there on only ids and 8-byte fingerprints move, and the lineage is cut once they are written.

Links are fingerprints at ``distance`` or fewer bits, 2 here. The index has these levels:

* Equal fingerprints are one leaf; it carries the smallest id of its documents, so exact copies never meet in pairs.
* The root level factors out shared masked bit patterns: of four blocks of 16 bits, two fingerprints within 2 bits
  agree on two at least, so each fingerprint hangs under six nodes, one for each pair of blocks. A node of over
  ``SPLIT`` fingerprints is factored once more, over three parts of its free bits, one of which must agree too. What is
  left differs in 22 bits at most, so no node outgrows a task, however skewed the input.
* Under a node the fingerprints are sorted by Gray rank. Runs that share a prefix of the free bits are the inner nodes,
  one level a byte. Two nodes are compared by the bits in which their patterns differ, added up from the root; beyond
  the distance the whole pair of groups is dropped.

Found links become a spanning forest in the task that finds them, and connected components of the forests give the
result; no link between different fingerprints is lost and copies are never expanded into pairs.

Defined results: a null or empty text has no words and fingerprint zero, linked like any other; fewer than three words
make one shingle; repeated rows give repeated rows with the same component; a null id keeps its fingerprint and takes
the component of its fingerprint, null if that has no other id; other columns are not read; an empty table gives none; a very
long text is hashed whole, its bits summed 65,280 shingles at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import bitmap, bits_for, components, kept, may_hold, table, tidy, whole_numbers

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Fingerprints under one root node before it is factored once more.
SPLIT = 4096
#: Node pairs compared at once, and rows taken into one search.
FRONTIER, ROWS = 1 << 20, 1 << 17
PAIRS = list(combinations(range(4), 2))
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def fingerprint(raw: bytes | None) -> int:
    """The unsigned 64-bit SimHash of a text's UTF-8 bytes."""
    from xxhash import xxh64_digest

    words = raw.lower().split() if raw else []
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, joined = [0, *ends[: len(words) - size].tolist()], b" ".join(words)
    hashes = np.frombuffer(b"".join([xxh64_digest(joined[s:e], SEED) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]), np.uint8).reshape(-1, 8)
    n, total = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 65_280):
        bits = np.unpackbits(hashes[at : at + 65_280], axis=1)
        whole = len(bits) // 255 * 255
        total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp long)``: the fingerprint's 64 bits as a signed long."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x) for x in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, fp long")


def _block(k: int) -> Column:
    return F.shiftrightunsigned("fp", 48 - 16 * k).bitwiseAND(F.lit(0xFFFF))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 32-bit pattern in the reflected Gray sequence."""
    r = codes.astype(np.uint64)
    for s in (1, 2, 4, 8, 16):
        r ^= r >> np.uint64(s)
    return r


def within(group: np.ndarray, free: np.ndarray, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``free`` (32-bit patterns, distinct in a group) in the same group, at ``distance`` or fewer bits.

    Sorts by group and Gray rank, builds the levels of prefix runs, and goes down from each group paired with itself.
    """
    order = np.lexsort((gray_rank(free), group))
    g, v = group[order], free[order].astype(np.int64)
    n = len(v)
    fresh = np.ones(n, bool)
    fresh[1:] = g[1:] != g[:-1]
    starts, byte = [np.flatnonzero(fresh)], []
    for shift in (24, 16, 8, 0):
        f = fresh.copy()
        f[1:] |= (v[1:] >> shift) != (v[:-1] >> shift)
        starts.append(np.flatnonzero(f))
        byte.append(((v[starts[-1]] >> shift) & 255).astype(np.uint8))
    children = [np.searchsorted(starts[k + 1], np.append(starts[k], n)) for k in range(4)]
    roots = np.flatnonzero(np.diff(np.append(starts[0], n)) > 1)
    stack = [(0, roots, roots, np.zeros(len(roots), np.uint8))]
    while stack:
        level, a, b, d = stack.pop()
        if level == 4:
            own = a != b
            yield order[a[own]], order[b[own]]
            continue
        first, last = children[level][:-1], children[level][1:]
        na, nb = last[a] - first[a], last[b] - first[b]
        made = np.cumsum(na * nb)
        if len(a) > 1 and made[-1] > FRONTIER:
            cut = max(1, min(len(a) - 1, int(np.searchsorted(made, FRONTIER))))
            stack += [(level, a[cut:], b[cut:], d[cut:]), (level, a[:cut], b[:cut], d[:cut])]
            continue
        if not len(a):
            continue
        pair = np.repeat(np.arange(len(a)), na * nb)
        k = np.arange(made[-1]) - np.repeat(made - na * nb, na * nb)
        ca, cb = first[a][pair] + k // nb[pair], first[b][pair] + k % nb[pair]
        far = d[pair] + POPCOUNT[byte[level][ca] ^ byte[level][cb]]
        keep = (far <= distance) & (ca <= cb)
        stack.append((level + 1, ca[keep], cb[keep], far[keep]))


def forest(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """Node -> root of a union-find over the links, for nodes other than roots."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := find(x)) != (q := find(y)):
            up[max(p, q)] = min(p, q)
    return {x: find(x) for x in up}


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Searches a sorted partition a few nodes of the root level at a time; a node is never cut."""

    def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        node, sub, pattern, free, rep = (t.column(c).to_numpy() for c in ("node", "sub", "pattern", "free", "rep"))
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (sub[1:] != sub[:-1]) | (pattern[1:] != pattern[:-1])
        up: dict[int, int] = {}
        for i, j in within(np.cumsum(new), free):
            up = forest(np.concatenate([np.fromiter(up, np.int64, len(up)), rep[i]]), np.concatenate([np.fromiter(up.values(), np.int64, len(up)), rep[j]]))
        yield pa.record_batch([pa.array(list(up), pa.int64()), pa.array(list(up.values()), pa.int64())], names=["a", "b"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= ROWS:
            t = pa.Table.from_batches(held)
            key = [t.column(c).to_numpy() for c in ("node", "sub", "pattern")]
            same = np.logical_and.reduce([k == k[-1] for k in key])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from links(t.slice(0, cut))
                held, rows = t.slice(cut).to_batches(), len(t) - cut
    if rows:
        yield from links(pa.Table.from_batches(held))


def link_forest(unique: DataFrame) -> DataFrame:
    """``unique(fp long, rep long)``, distinct fingerprints with an id each -> edges ``(a, b)`` that span every link."""
    spark = unique.sparkSession
    nodes = [F.struct(F.lit(k).alias("node"), (F.shiftleft(_block(i), 16) + _block(j)).alias("pattern"), (F.shiftleft(_block(x), 16) + _block(y)).alias("free")) for k, (i, j) in enumerate(PAIRS) for x, y in [sorted({0, 1, 2, 3} - {i, j})]]
    under = unique.where("rep is not null").select("rep", F.explode(F.array(*nodes)).alias("n")).select("rep", "n.*")
    hot = under.groupBy("node", "pattern").count().where(F.col("count") > SPLIT).select("node", "pattern", F.lit(True).alias("hot"))
    parts = F.array(*[F.struct(F.lit(k + 1).alias("sub"), F.shiftrightunsigned("free", s).bitwiseAND(F.lit(m)).alias("part")) for k, (s, m) in enumerate(((21, 0x7FF), (10, 0x7FF), (0, 0x3FF)))])
    whole = F.array(F.struct(F.lit(0).alias("sub"), F.lit(0).cast("long").alias("part")))
    dealt = under.join(hot, ["node", "pattern"], "left").select("rep", "node", "pattern", "free", F.explode(F.when(F.col("hot"), parts).otherwise(whole)).alias("s")).select("rep", "node", (F.col("pattern") * 4096 + F.col("s.part")).alias("pattern"), "free", "s.sub")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "node", "sub", "pattern").sortWithinPartitions("node", "sub", "pattern").mapInArrow(_search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp long, component_id)`` of every row; ``component_id`` is the smallest id reachable over links."""
    whole_numbers(docs, id_col)
    own = kept(fingerprints(docs, id_col, text_col))
    unique = kept(own.groupBy("fp").agg(F.min("id").alias("rep")))
    roots = components(link_forest(unique))
    classes = unique.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return own.join(classes, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which each group of near-duplicates keeps the one with the smallest id.

    Of rows that repeat an id one stays; rows with a null id cannot be named by a group and all stay.
    """
    found = near_duplicates(docs, id_col, text_col).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("special"), "component_id")
    special = found.groupBy("special").agg(F.bool_and(F.col("special") == F.col("component_id")).alias("stays"), F.count("*").alias("times"))
    special = kept(special.where("not stays or times > 1"))
    n = special.count()
    # Texts that are certain to stay pass as they are; only the others meet the list of what goes.
    docs_ = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"))
    may = may_hold(bitmap(special, "special", bits_for(n)), "id", bits_for(n)) & F.col("id").isNotNull()
    rows = docs_.where(may).join(special, F.col("id") == F.col("special"), "left")
    out = docs_.where(~may).select("row").unionByName(rows.where("special is null").select("row"))
    if not special.where("stays").isEmpty():
        out = out.unionByName(rows.where("stays").select("id", "row").dropDuplicates(["id"]).select("row"))
    return out.select("row.*")

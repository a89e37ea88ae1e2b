r"""Operator 5, benchmark decontamination by Wu-Manber multi-pattern search over words.

Every benchmark item gives windows of 13 consecutive words (an item of fewer, but not none, is one window). Windows of
one length form a class, and each class has the three parts of Wu and Manber's search, with a word as the symbol:
a shift table over hashed blocks of two words that says how far a position may be skipped, buckets of windows by the hash of
their last block, ordered inside by a hash of the whole window, and a direct comparison of the whole window. A text is cut into
words once; where a shift leads past a position, no window is looked for there.

The tables are arrays: a window is an offset into one byte string, and a table takes about 7 bytes for each byte of
benchmark. The windows are broadcast in blocks of items, each of at most ``block_bytes`` of text (an item is never split), and a
Python worker builds a block's tables once for all its tasks. Every block is one more map over the same rows, without a
shuffle; after ``ABREAST`` blocks the rows are written and read again, so that no more tables than those are held at once.

Defined results: a null or empty text has no words, no hits and no items; an item without words, or without an id,
matches nothing; repeated item ids count once; windows shared by items count for each; rows are independent, so
repeated rows give repeated rows; other columns are not read; empty tables give no hits or no rows; a very long text is
searched whole, in memory in proportion to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import kept, table, tidy

WINDOW = 13
BLOCK_BYTES, ABREAST = 8 << 20, 4
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Words are runs of digits, letters (lower-cased ASCII) and bytes beyond ASCII; all else becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(FOLD).split() if raw else []


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint64, len(words)) * MIX


class Items:
    """The words of all items as one byte string, with their hashes, and which item a word is of."""

    def __init__(self, items: Iterable[tuple[int, bytes | None]]):
        texts, hashed, lengths, self.sizes, self.numbers = [], [], [], [], []
        for k, raw in items:
            words = words_of(raw)
            if words:
                texts.append(b" ".join(words))
                hashed.append(hashes(words))
                lengths.append(np.fromiter(map(len, words), np.int64, len(words)))
                self.sizes.append(len(words))
                self.numbers.append(k)
        self.text = b" ".join(texts)
        self.hash = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
        ends = np.cumsum(np.concatenate(lengths) + 1) if lengths else np.zeros(0, np.int64)
        self.at = np.concatenate([[0], ends])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def window(self, start: int, m: int) -> bytes:
        return self.text[self.at[start] : self.at[start + m] - 1]

    def item(self, start: int) -> int:
        return self.numbers[int(np.searchsorted(self.first, start, "right")) - 1]


class WindowClass:
    """Wu-Manber tables for the windows of ``m`` words that start at ``starts``."""

    def __init__(self, items: Items, m: int, starts: np.ndarray):
        self.items, self.m, self.block = items, m, min(2, m)
        self.bits = max(8, int(4 * len(starts)).bit_length())
        far = m - self.block + 1
        blocks = self._blocks(items.hash)
        self.shift = np.full(1 << self.bits, far, np.uint8)
        for d in range(far - 1, -1, -1):  # the least distance to a window's end is written last
            self.shift[blocks[starts + (m - self.block - d)]] = d
        key = self._keys(items.hash, blocks, starts + m - 1)
        order = np.argsort(key, kind="stable")
        self.key, self.start = key[order], starts[order].astype(np.int32 if len(items.hash) < 1 << 31 else np.int64)

    def _blocks(self, h: np.ndarray) -> np.ndarray:
        """The place in the shift table of each block, by its first word."""
        whole = h if self.block == 1 else h[:-1] * STEP + h[1:]
        return ((whole * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _keys(self, h: np.ndarray, blocks: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For windows that end at ``ends``: the bucket of the last block, then a hash of the window."""
        w = np.zeros(len(ends), np.uint64)
        for k in range(self.m):
            w = (w ^ (w >> np.uint64(29))) * STEP + h[ends - (self.m - 1 - k)]
        bucket = blocks[ends - (self.block - 1)].astype(np.uint64)
        return (bucket << np.uint64(64 - self.bits)) | (w * MIX >> np.uint64(self.bits))

    def scan(self, words: list[bytes], h: np.ndarray, hit: bytearray, found: set[int]) -> None:
        """Marks in ``hit`` the words inside occurrences and adds to ``found`` the items whose windows occur."""
        m, n = self.m, len(words)
        if n < m:
            return
        blocks = self._blocks(h)
        shift = bytes(self.block - 1) + self.shift[blocks].tobytes()
        ends, i = [], m - 1
        while i < n:
            s = shift[i]
            if s:
                i += s
            else:
                ends.append(i)
                i += 1
        if not ends:
            return
        key = self._keys(h, blocks, np.array(ends))
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        mark = b"\x01" * m
        for k in np.flatnonzero(low < high).tolist():
            end = ends[k]
            own = b" ".join(words[end - m + 1 : end + 1])
            same = [s for s in self.start[low[k] : high[k]].tolist() if self.items.window(s, m) == own]
            if same:
                hit[end - m + 1 : end + 1] = mark
                found.update(map(self.items.item, same))


def window_classes(items: Iterable[tuple[int, bytes | None]], window: int = WINDOW) -> list[WindowClass]:
    """The search tables of ``items``, pairs of a number and a text; one class for each window length."""
    own = Items(items)
    size, first = np.array(own.sizes, np.int64), own.first[:-1]
    out = []
    for m in np.unique(np.minimum(size, window)).tolist():
        which = np.flatnonzero(np.minimum(size, window) == m)
        starts = np.concatenate([np.arange(first[k], first[k] + size[k] - m + 1) for k in which.tolist()])
        out.append(WindowClass(own, m, starts))
    return out


_built: dict[str, tuple[list[str], list[WindowClass]]] = {}


def _worker_tables(key: str, shared, window: int) -> tuple[list[str], list[WindowClass]]:
    """A block's ids and tables: built once in a worker's life, which keeps those of one block."""
    if key not in _built:
        _built.clear()
        ids, texts = shared.value
        _built[key] = ids, window_classes(enumerate(texts), window)
    return _built[key]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list[str], list[bytes]]]:
    """The benchmark's items in blocks of bounded size, each sent to the driver on its own."""
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k).collect()
        yield [r.id for r in rows], [r.text.encode() for r in rows]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(id, n_words, n_hit, items array<string>)`` of every document; items sorted as strings.

    ``id_col`` may be any column, a struct of a whole row too.
    """
    sc = docs.sparkSession.sparkContext
    own = T.StructField("id", docs.schema[id_col].dataType)
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items"))
    found = T.StructType([own, *T.StructType().add("text", "string").add("hit", "binary").add("items", T.ArrayType(T.StringType()))])
    result = T.StructType([own, *T.StructType().add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType()))])

    def search(shared) -> callable:
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, classes = _worker_tables(key, shared, window)
            for b in batches:
                hits, per = [], []
                for raw, before, had in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    words, got = words_of(raw), set()
                    hit = bytearray(before) if before else bytearray(len(words))
                    h = hashes(words) if classes else None
                    for c in classes:
                        c.scan(words, h, hit, got)
                    hits.append(bytes(hit))
                    per.append(sorted({ids[k] for k in got} | set(had)))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(hits, pa.binary()), pa.array(per, pa.list_(pa.string()))], names=["id", "text", "hit", "items"])

        return run

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = b.column(1).to_pylist()
            yield pa.record_batch([b.column(0), pa.array([len(h) for h in hits], pa.int64()), pa.array([h.count(1) for h in hits], pa.int64()), b.column(2)], names=["id", "n_words", "n_hit", "items"])

    def last(shared) -> callable:
        """The last block's search and the tally in one map, so that the text is not handed on."""
        inner = search(shared)
        return tidy(lambda batches: tally(pa.record_batch([b.column(0), b.column(2), b.column(3)], names=["id", "hit", "items"]) for b in inner(batches)))

    blocks = [sc.broadcast(x) for x in _blocks(benchmark, item_col, item_text_col, block_bytes)]
    for k, shared in enumerate(blocks[:-1], 1):
        out = out.mapInArrow(search(shared), found)
        out = out if k % ABREAST else kept(out)
    return out.mapInArrow(last(blocks[-1]), result).withColumnRenamed("id", id_col)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """The rule: some word is hit, and at least a twentieth of the words."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document against the whole benchmark."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the benchmark does not contaminate; searched in place, without a shuffle."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return find_contamination(rows, benchmark, id_col="row").where(~contaminated()).select("row.*")


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS win
       FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least({WINDOW}, len(w)) AS m FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS win
       FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT doc_id, item_id, m, i FROM dw JOIN bw USING (m, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""

"""Queries over printed tables that were read twice by machine; the tables are printed from the dimensions that ``part`` gives."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.operators import profiles, readings
from ferrule.plans import query, table
from ferrule.shared import dealt, stored

#: What a misreading writes for a digit.
MISREAD = str.maketrans("015", "OlS")
FIRST, SECOND = "layer", "scan"


def dimensions(parts: DataFrame) -> DataFrame:
    """A profile for every part: ``(row, table, page, h, b, c, t)``."""
    key = F.col("p_partkey")
    kind = (F.pmod(key, F.lit(10)) + 1).cast("string")
    square = kind.isin([k for k, (_, d, _) in profiles.LAYOUTS.items() if d.startswith("hh")])
    lipped = kind.isin([k for k, (_, d, _) in profiles.LAYOUTS.items() if "c" in d])
    h = 60 + 10 * F.pmod(F.floor(key / 10), F.lit(20))
    b = F.when(square, h).otherwise(40 + 5 * F.pmod(F.floor(key / 200), F.lit(12)))
    thick = F.element_at(F.array(*map(F.lit, (1.25, 1.6, 2.0, 2.5, 3.15))), (F.pmod(F.col("p_size"), F.lit(5)) + 1).cast("int"))
    return parts.select(
        key.alias("row"), kind.alias("table"), F.floor(key / 400).alias("page"),
        h.cast("double").alias("h"), b.cast("double").alias("b"), F.when(lipped, 15 + 5 * F.pmod(F.col("p_size"), F.lit(3))).otherwise(0).cast("double").alias("c"), thick.alias("t"),
    )


def number(v: float) -> str:
    return f"{v:.2f}" if v < 100 else f"{v:.1f}"


def true_cells(kind: str, dims: dict[str, np.ndarray]) -> list[list[str]]:
    """The cells of profiles of one table as printed: the first convention of every column, but the lesser modulus of a hat."""
    shape = profiles.LAYOUTS[kind][0]
    e = profiles.expected(shape, *(dims[k] for k in "hbct"))
    values = np.stack([e["Rvv" if c == "Rvv_min" else c][:, 2 if (shape, c) == ("hat", "Zxx") else 0] for c in profiles.columns(kind)], 1)
    return [[f"{v:g}" if c in "hbc" else number(v) for c, v in zip(profiles.columns(kind), row, strict=True)] for row in values.tolist()]


#: What each byte leaves of a CRC-32.
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = (CRC >> np.uint32(1)) ^ np.where(CRC & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))


def fates(rows: list[int], source: str, n: int) -> np.ndarray:
    """``crc32(f"{source}:{row}:{j}") % 240`` for each row and its cells ``j`` below ``n``, all rows at once from their own checksums on."""
    start = ~np.array([crc32(f"{source}:{row}".encode()) for row in rows], np.uint32)
    out = np.empty((len(rows), n), np.uint32)
    for j in range(n):
        c = start
        for byte in f":{j}".encode():
            c = CRC[(c ^ np.uint32(byte)) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
        out[:, j] = ~c
    return out % np.uint32(240)


def misread(fate_of: list[int], cells: list[str]) -> list[str]:
    """Cells as a source reads them: letters for digits, lost points, split and lost cells, junk."""
    out, lost = [], 0
    for cell, fate in zip(cells, fate_of, strict=True):
        if fate < 60:
            if fate < 3 and lost < 2:
                lost += 1
                continue
            if fate < 6:
                cell = cell.replace(".", "")
            elif fate < 9 and len(cell) < 7:
                cell = cell.replace(".", " ")
            elif fate < 12:
                out.append("7")
            else:
                cell = cell.translate(MISREAD)
        out.append(cell)
    return out


#: Profiles whose cells a task keeps: many rows are of equal dimensions.
KNOWN = 1 << 15


def printed(profile: DataFrame) -> DataFrame:
    """Two readings of each profile's line: ``(row, table, page, source, line)``; every fortieth designation has a slip in the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[str]] = {}
        for b in batches:
            for kind, rows, dims in readings._tables(b):
                layout, lines = profiles.LAYOUTS[kind][1], []
                keys = list(zip([kind] * len(rows), *(dims[k].tolist() for k in "hbct"), strict=True))
                new = list(dict.fromkeys(k for k in keys if k not in known))
                if len(known) + len(new) > KNOWN:
                    known, new = {}, list(dict.fromkeys(keys))
                known.update(zip(new, true_cells(kind, dict(zip("hbct", np.array([k[1:] for k in new]).T, strict=True))) if new else [], strict=True))
                ids = rows.column("row").to_pylist()
                fate = [fates(ids, source, len(profiles.columns(kind))).tolist() for source in (FIRST, SECOND)]
                for r, (row, key) in enumerate(zip(ids, keys, strict=True)):
                    cells, t = known[key], key[4]
                    size = " x ".join(f"{dims[k][r]:g}" for k in ("hbc" if "c" in layout else "hb"))
                    for source, own in zip((FIRST, SECOND), fate, strict=True):
                        thick = t + (0.7 if source == SECOND and row % 40 == 7 and 1 < t < 2.3 else 0)
                        lines.append((row, source, f"{size} x {thick:.2f} {' '.join(misread(own[r], cells))}"))
                own = np.repeat(np.arange(len(rows)), 2)
                yield pa.record_batch([pa.array([x[0] for x in lines], pa.int64()), pa.array([kind] * len(lines), pa.string()), rows.column("page").take(pa.array(own)).cast(pa.int64()), *(pa.array([x[k] for x in lines], pa.string()) for k in (1, 2))], names=["row", "table", "page", "source", "line"])

    return dealt(profile, "row").mapInArrow(run, "row long, table string, page long, source string, line string")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return printed(dimensions(table(spark, d, "part")))


@query()
def two_source_rows(spark: SparkSession, d: str) -> DataFrame:
    """Readings of one row paired by designation, thickness within a slip."""
    pairs = readings.paired(readings.parse(lines(spark, d)), FIRST, SECOND)
    return pairs.select("table", "page", "row", "h", "b", "c", "t", F.array_join("first", " ").alias("first"), F.array_join("second", " ").alias("second"))


@query()
def column_calibration(spark: SparkSession, d: str) -> DataFrame:
    """The convention, scale and tolerance of each column that both readings agree on."""
    fits = readings.calibrate(readings.paired(readings.parse(lines(spark, d)), FIRST, SECOND))
    rows = [(t, c, k, scale, tolerance) for t, own in fits.items() for c, (k, scale, tolerance) in own.items()]
    return spark.createDataFrame(rows, "table string, col string, convention int, scale double, tolerance double")


@query()
def resolved_rows(spark: SparkSession, d: str) -> DataFrame:
    """Tokens put to columns, cells chosen, one row a designation, no phantoms."""
    pairs = stored(readings.paired(readings.parse(lines(spark, d)), FIRST, SECOND), "pairs-")  # read to calibrate and to resolve
    rows = readings.settled(readings.resolve(pairs, readings.calibrate(pairs), (FIRST, SECOND)))
    text = lambda c, sep: F.array_join(c, sep, "-")
    return rows.select("table", "page", "row", "designation", text(F.transform("values", lambda v: F.round(v, 6).cast("string")), " ").alias("cells"), text("used", " ").alias("used"), text("notes", "; ").alias("notes"), text("repairs", "; ").alias("repairs"))

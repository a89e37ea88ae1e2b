"""File sources with declared schemas: paged markdown, JSON and JSON lines, property tables, packages, listings, events.

Every reader takes a path that Spark opens, so any store will do; nothing is listed or read on the driver.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MARKER = r"<!--\s*pdf_page=(\d+)([^>]*?)-->"


def paged_markdown(spark: SparkSession, path: str) -> DataFrame:
    """``(doc, pdf_page, printed_label, printed_label_qualified, part, body)``: a text cut at its page markers."""
    texts = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc"), "value")
    return pages(texts, "doc", "value")


def pages(texts: DataFrame, doc: str, text: str) -> DataFrame:
    marks = F.regexp_extract_all(F.col(text), F.lit(MARKER), F.lit(0))
    rows = texts.select(F.col(doc).alias("doc"), F.explode(F.arrays_zip(marks.alias("mark"), F.slice(F.split(text, MARKER), 2, 1 << 30).alias("body"))).alias("p")).select("doc", "p.mark", "p.body")
    field = lambda name: F.nullif(F.regexp_extract("mark", rf"\b{name}=(\S+)", 1), F.lit(""))
    clean = F.regexp_replace(F.regexp_replace("body", r"(?s)<!--.*?-->\s*", ""), r"^\s+|\s+$", "")
    return rows.select("doc", F.regexp_extract("mark", r"pdf_page=(\d+)", 1).cast("int").alias("pdf_page"), field("printed_label").alias("printed_label"), field("printed_label_qualified").alias("printed_label_qualified"), field("part").alias("part"), clean.alias("body"))


def overlay(base: DataFrame, files: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    """Page files laid over pages: a missing page is added, a body replaced where the file's is longer."""
    longer = F.coalesce(F.length("__o"), F.lit(-1)) > F.coalesce(F.length(body), F.lit(-1))
    other = files.select(*keys, F.col(body).alias("__o"))
    return base.join(other, keys, "full").withColumn(body, F.when(longer, F.col("__o")).otherwise(F.col(body))).drop("__o")


def json_rows(spark: SparkSession, path: str, schema, lines: bool = False) -> DataFrame:
    """JSON arrays or lines under a declared schema; unreadable rows are left out."""
    from pyspark.sql import types as T

    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(full).option("columnNameOfCorruptRecord", "_bad").option("multiLine", not lines).json(path)
    return rows.where(F.col("_bad").isNull()).drop("_bad")


def tail(df: DataFrame, order: list[str], n: int, by: list[str] | None = None) -> DataFrame:
    """The last ``n`` rows in order, of each group if any is named."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r") if by else df.orderBy(*[F.desc(c) for c in order]).limit(n)


def property_table(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A CSV with a header, all text, the named columns as numbers, null where they are none."""
    from ferrule.functions.text import numeric

    rows = spark.read.csv(path, header=True)
    return rows.withColumns({c: numeric(F.col(c)) for c in numbers})


def pipe_table(lines: DataFrame, by: list[str], order: str, line: str) -> DataFrame:
    """Cells of markdown table rows; header rules are left out and a first cell carries on where it is blank."""
    rows = lines.where(F.col(line).rlike(r"^\s*\|") & ~F.col(line).rlike(r"^\s*\|[\s:|-]*$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    first = F.nullif(F.get("cells", F.lit(0)), F.lit(""))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*by, order, cells.alias("cells")).withColumn("group", F.last(first, ignorenulls=True).over(w))


def number_runs(text: Column) -> Column:
    """Fields two spaces or more apart; a single space before three digits is a thousands mark."""
    return F.transform(F.split(F.trim(text), " {2,}"), lambda x: F.regexp_replace(x, r"(?<=\d) (?=\d{3}(?:\D|$))", ""))


def unzip(binaries: DataFrame) -> DataFrame:
    """``(package, path, content)`` of zip files read as ``binaryFile``; a wrapping folder is taken off, unsafe names are
    refused, and a file that is no zip gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                names = [n for n in z.namelist() if not n.endswith("/")]
                if any(n.startswith(("/", "\\")) or ".." in n.split("/") for n in names):
                    continue
                top = {n.split("/")[0] for n in names}
                cut = len(next(iter(top))) + 1 if len(top) == 1 and all("/" in n for n in names) else 0
                for n in names:
                    yield pd.DataFrame({"package": [path.rsplit("/", 1)[-1]], "path": [n[cut:]], "content": [z.read(n)]})

    return binaries.select("path", "content").mapInPandas(run, "package string, path string, content binary")


def packages(spark: SparkSession, path: str) -> DataFrame:
    return unzip(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, folder, bytes, modified)`` of a tree's files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def jobs(files: DataFrame) -> DataFrame:
    """Folders with their number of files, bytes and last change, newest first."""
    return files.groupBy("folder").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.max("modified").alias("modified")).orderBy(F.desc("modified"), "folder")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes, sha256)`` of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def server_events(text: Column) -> Column:
    """Data blocks of an event stream text: the joined ``data:`` lines of each block; comments are left out."""
    blocks = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n\n+")
    data = F.transform(blocks, lambda b: F.array_join(F.transform(F.filter(F.split(b, "\n"), lambda x: x.startswith("data:")), lambda x: F.regexp_replace(x, "^data: ?", "")), "\n"))
    return F.filter(data, lambda x: x != "")


def event_row(line: Column, kinds: list[str]) -> Column:
    """``(type, text)``: a JSON object with a known type is that event, anything else a line of the log."""
    v = F.try_parse_json(line)
    kind = F.try_variant_get(v, "$.type", "string")
    known = kind.isin(*kinds)
    return F.struct(F.when(known, kind).otherwise(F.lit("log")).alias("type"), F.when(known, F.try_variant_get(v, "$.text", "string")).otherwise(line).alias("text"))

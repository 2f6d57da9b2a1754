"""A folder of broker files with headers of their own, each taken once.

Files are read side by side, one row of Spark a file. Each has its own header,
whose names lead to the ledger's columns by keywords; lines are numbered inside the
file, and what cannot be a row is kept aside with its reason, so that a bad line
costs a line and a bad file a file. Which files were taken is committed with their
rows: a file is either in both, or in neither and comes again.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import ingest
from ledgerloom.sources.tables import Shape, Store

STATEMENT = ["date", "amount", "currency", "transaction", "description"]
FILES = "path string, length bigint, modified timestamp"
BAD = "path string, line bigint, reason string, text string"


def cleaned(name: str) -> str:
    """A header's name as keywords are compared."""
    return "".join(c for c in name.strip().lower() if c.isascii() and (c.isalnum() or c == "$"))


def placed(header: list[str], names: dict[str, str]) -> tuple[dict[str, int], dict[str, int]]:
    """Places of the known columns, the first of each, and of all others by their own names."""
    known: dict[str, int] = {}
    other: dict[str, int] = {}
    for i, name in enumerate(header):
        target = names.get(cleaned(name))
        if target is not None and target not in known:
            known[target] = i
        else:
            other.setdefault(name.strip(), i)
    return known, other


def _parsed(columns: list[str], required: list[str], names: dict[str, str], filled: list[str]):
    """The lines of each file: cells of known columns, others in a map, or a reason."""

    def lines(path: str, content: bytes) -> Iterator[tuple]:
        empty = [None] * len(columns)
        try:
            text = content.decode("utf-8-sig")
        except UnicodeDecodeError:
            yield (path, 0, *empty, None, "NOT UTF-8", None)
            return
        reader = csv.reader(io.StringIO(text, newline=""))
        known: dict[str, int] | None = None
        width = 0
        while True:
            try:
                row = next(reader)
            except StopIteration:
                break
            except csv.Error as error:
                yield (path, reader.line_num, *empty, None, f"BROKEN LINE: {error}", None)
                continue
            if not any(c.strip() for c in row):
                continue
            if known is None:
                known, other = placed(row, names)
                width = len(row)
                lacking = [c for c in required if c not in known and c not in filled]
                if lacking:
                    yield (path, reader.line_num, *empty, None, f"NO COLUMN FOR {', '.join(lacking)}", ",".join(row))
                    return
            elif len(row) != width:
                yield (path, reader.line_num, *empty, None, f"{len(row)} CELLS INSTEAD OF {width}", ",".join(row))
            else:
                yield (path, reader.line_num, *[row[known[c]] if c in known else None for c in columns], [(n, row[i]) for n, i in other.items()], None, None)
        if known is None:
            yield (path, 0, *empty, None, "EMPTY FILE", None)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * len(columns), pa.map_(pa.string(), pa.string()), pa.string(), pa.string()]
        titles = ["path", "line", *columns, "others", "reason", "text"]
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                held: list[tuple] = []
                for line in lines(path.as_py(), content.as_py()):
                    held.append(line)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], titles)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], titles)

    return parse


def listed(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """path, length, modified of the files below a folder; their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def scanned(spark: SparkSession, paths: list[str], columns: list[str], required: list[str], keywords: dict[str, list[str]] | None = None, filled: list[str] = ()) -> DataFrame:
    """path, line, the columns as text, others (a map), reason, text: the lines of some files.

    `reason` is null for lines that are rows; else it says why not, and `text` is
    the line. Keywords name a column by what its normalised header may be. A file
    without a required column gives one line with a reason, unless the column is
    one that is filled in otherwise.
    """
    names = {cleaned(c): c for c in columns} | {cleaned(k): c for c, more in (keywords or {}).items() for k in [c, *more]}
    shape = f"path string, line bigint, {', '.join(f'`{c}` string' for c in columns)}, others map<string,string>, reason string, text string"
    if not paths:
        return spark.createDataFrame([], shape)
    files = spark.read.format("binaryFile").load(paths).select("path", "content").repartition(max(1, min(len(paths), 10_000)), "path")
    return files.mapInArrow(_parsed(columns, required, names, list(filled)), shape)


def file_name(path: Column) -> Column:
    """A file's name without folder and ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def scan_ledger(spark: SparkSession, paths: list[str], keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """Lines of ledger files: the essential columns, fee and settle_date; a missing or empty account is the file's name."""
    columns = [*ingest.ESSENTIALS, "fee", "settle_date"]
    rows = scanned(spark, paths, columns, ingest.ESSENTIALS, keywords, ["account"])
    own = F.coalesce(F.nullif(F.trim("account"), F.lit("")), file_name(F.col("path")))
    return rows.withColumn("account", F.when(F.col("reason").isNull(), own))


def scan_statements(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of monthly statements: date, amount, currency, transaction, description."""
    return scanned(spark, paths, STATEMENT, STATEMENT)


def inbox(spark: SparkSession, root: str, rows: str, buckets: int = 16) -> Store:
    """A store of the rows of files, of lines kept aside, and of the files that were taken; `rows` are the columns beside path and line."""
    return Store(spark, root, {"rows": Shape(f"path string, line bigint, {rows}", ("path", "line"), ("path",), buckets), "bad": Shape(BAD, ("path", "line"), ("path",), buckets), "files": Shape(FILES, ("path",), buckets=buckets)})


def take(of: Store, folder: str, scan, pattern: str = "*.csv") -> dict:
    """Takes the files of a folder that were not taken before: rows, lines kept aside and files, all in one version.

    `scan` gives the lines of a list of paths. A file counts as another once its length or time differs; then its
    rows replace those it gave before. Spark's readers pass over files without a byte.
    """
    spark = of.spark

    def work(base: dict) -> dict:
        new = listed(spark, folder, pattern).join(of.read("files", base), ["path", "length", "modified"], "left_anti")
        paths = sorted(r.path for r in new.select("path").collect())  # the driver lists files to read them anyway
        if not paths:
            return {}
        found = ingest.stored(scan(paths), "lines")
        touched = of.touched("files", new)
        parts = {"rows": found.where("reason is null"), "bad": found.where("reason is not null"), "files": new}
        out = {}
        for table, part in parts.items():
            held = of.read(table, base, touched)
            out[table] = (touched, held.join(new.select("path"), "path", "left_anti").select(held.columns).unionByName(part.select(held.columns)))
        return out

    return of.change(work)

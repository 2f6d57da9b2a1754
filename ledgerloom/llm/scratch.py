"""Shared scratch tables: cut lineage so that lost executors cost one stage only."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_tables: weakref.WeakSet[DataFrame] = weakref.WeakSet()


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names.

    Only where that is unset, as in local tests, a temporary folder stands in.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-loom-")
        top = _own[app]
    return f"{top.rstrip('/')}/loom/{what}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _tables.add(table)
    return table


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a stored table: itself if it is one already."""
    return df if df in _tables else stored(df, what)


def release(*tables: DataFrame | None) -> None:
    """Deletes tables that `stored` wrote, once their last reader is done."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()} if table is not None else ():
            if "/loom/" in path:
                spark = table.sparkSession
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


MOST_BROADCAST = 32 << 20  # bytes of a side that is broadcast, as its rows lie in an executor's memory


def small(df: DataFrame, row_bytes: int = 64, most: int = MOST_BROADCAST // 4) -> DataFrame:
    """A stored table, to be broadcast if its rows are few enough; else it is joined in a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, jobs hand Python at most `rows` rows at a time: texts are large, and memory follows the batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(taken: list[str], name: str) -> str:
    """name, with underscores until no column has it (case does not count)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name

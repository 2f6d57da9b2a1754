"""Tables in the folder that spark.checkpoint.dir names: they cut the lineage of rounds, and a lost executor costs one round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def shared_dir(spark) -> str:
    """The shared folder; only where none is set, as in local tests, a temporary one stands in."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-ledger-")
        top = _own[app]
    return f"{top.rstrip('/')}/ledger"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame | None) -> None:
    """Deletes tables that `stored` wrote, once their last reader is done."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()} if table is not None else ():
            if "/ledger/" in path:
                spark = table.sparkSession
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

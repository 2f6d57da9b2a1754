"""Committed tables: rows bucketed by key, numbered manifests, and writers that rewrite only the buckets they touch.

A store is a folder. Its data lie in folders that are written once, one for each
bucket that a change touched; a manifest says which folders make up each table's
buckets in a version. A version is there once its manifest is, which is created
under a number that only one writer can take. A writer that loses looks what came
between: if other buckets were touched it takes the next number, else it works
its change out again. Readers hold to the manifest they began with.

The file system must refuse to create a file that exists, as HDFS and local ones do.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"
UNFINISHED_S = 10.0  # how long a manifest may take from its creation to its end


class Conflict(RuntimeError):
    """Other writers were faster, again and again."""


class Violation(ValueError):
    """Rows that a table must not hold; `rows` has all of them, with the names of the rules that they break."""

    def __init__(self, rows: DataFrame, count: int):
        super().__init__(f"{count} rows break the table's rules, as {[r.asDict() for r in rows.limit(3).collect()]}")
        self.rows = rows


@dataclass(frozen=True)
class Shape:
    """A table's columns, its key, what it is bucketed by (columns of the key), and rules that each row must keep."""

    ddl: str
    keys: tuple[str, ...]
    by: tuple[str, ...] = ()
    buckets: int = 64
    rules: dict[str, Column] = field(default_factory=dict, compare=False)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c) for c in self.by or self.keys]), F.lit(self.buckets)).cast("int")


class Files:
    """The few calls of a Hadoop file system that manifests need."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def create(self, name: str, text: str) -> bool:
        """Whether the file is new; where one of that name exists, nothing is done."""
        try:
            out = self._fs.create(self._path(f"{self.root}/{name}"), False)
        except Exception as error:
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def size(self, folder: str) -> int:
        """Bytes of a folder, -1 where there is none."""
        at = self._path(folder)
        return self._fs.getContentSummary(at).getLength() if self._fs.exists(at) else -1

    def delete(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)


class Store:
    """Tables that are committed together, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, shapes: dict[str, Shape]):
        self.spark, self.root, self.shapes = spark, root.rstrip("/"), shapes
        self.files = Files(spark, root)

    # -- versions --

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest, the latest by default; version 0 is the empty store. One that breaks off is waited for, and then passed over."""
        numbers = sorted((int(n.split(".")[0]) for n in self.files.names("manifests") if n.endswith(".json")), reverse=True)
        for number in numbers if version is None else [version] if version else []:
            until = time.time() + UNFINISHED_S
            while True:
                try:
                    return json.loads(self.files.read(f"manifests/{number:08d}.json"))
                except json.JSONDecodeError:
                    if time.time() > until:
                        break
                    time.sleep(0.2)
            if version:
                raise ValueError(f"the manifest of version {version} is broken")
        return {"version": 0, "base": 0, "tables": {t: {} for t in self.shapes}, "notes": {}}

    def _commit(self, base: dict, touched: dict[str, dict[str, dict | None]], notes: dict) -> dict | None:
        """The next version, or None if a version that touches the same came between."""
        while True:
            last = self.manifest()
            if last["version"] != base["version"]:
                between = last["tables"]
                if any(between[t].get(b) != base["tables"][t].get(b) for t, own in touched.items() for b in own) or any(last["notes"].get(k) != base["notes"].get(k) for k in notes):
                    return None
            taken = [int(n.split(".")[0]) for n in self.files.names("manifests") if n.endswith(".json")]
            tables = {t: {b: d for b, d in (last["tables"][t] | touched.get(t, {})).items() if d} for t in self.shapes}
            new = {"version": max([last["version"], *taken]) + 1, "base": last["version"], "tables": tables, "notes": last["notes"] | notes}
            if self.files.create(f"manifests/{new['version']:08d}.json", json.dumps(new)):
                # a writer that took this manifest for an abandoned one has gone past it
                later = [self.manifest(n) for n in sorted(int(x.split(".")[0]) for x in self.files.names("manifests") if x.endswith(".json")) if n > new["version"]]
                return None if any(m["base"] < new["version"] for m in later) else new

    def read(self, table: str, manifest: dict | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table's rows as of a manifest, of some buckets or all."""
        held = (manifest or self.manifest())["tables"][table]
        wanted = held if buckets is None else {b: held[b] for b in map(str, buckets) if b in held}
        shape = self.shapes[table]
        if not wanted:
            return self.spark.createDataFrame([], shape.ddl)
        return self.spark.read.schema(shape.ddl).parquet(*[d["at"] for d in wanted.values()])

    def damaged(self, table: str, manifest: dict) -> list[int]:
        """Buckets whose folders are gone or have another size than when they were written."""
        return [int(b) for b, d in manifest["tables"][table].items() if self.files.size(d["at"]) != d["bytes"]]

    # -- changes --

    def violations(self, table: str, rows: DataFrame, whole: bool = True) -> DataFrame:
        """Rows that break a rule, with the rules' names: a missing or repeated key, and, for whole rows, the table's own rules."""
        shape = self.shapes[table]
        missing = F.lit(False)
        for k in shape.keys:
            missing = missing | F.col(k).isNull()
        named = [F.when(missing, "missing key")]
        if whole:
            named += [F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in shape.rules.items()]
        repeated = rows.groupBy(*shape.keys).count().where("count > 1").select(*shape.keys)
        single = rows.withColumn("violations", F.array_compact(F.array(*named))).where(F.size("violations") > 0)
        return single.unionByName(rows.join(repeated, list(shape.keys), "left_semi").withColumn("violations", F.array(F.lit("repeated key"))).select(single.columns))

    def _held_to(self, table: str, rows: DataFrame, whole: bool = True) -> None:
        broken = self.violations(table, rows, whole)
        if count := broken.count():
            raise Violation(broken, count)

    def change(self, work: Callable[[dict], dict[str, tuple[list[int], DataFrame]]], notes: dict | None = None, attempts: int = 10) -> dict:
        """Commits what `work` makes of a manifest: for each table the buckets it rewrites and all their rows; returns the new manifest.

        Nothing to rewrite and nothing to note commits nothing.
        """
        for _ in range(attempts):
            base = self.manifest()
            touched = {}
            for table, (buckets, rows) in work(base).items():
                if not buckets:
                    continue
                shape, top = self.shapes[table], f"{self.root}/data/{table}-{uuid.uuid4().hex}"
                names = [c.split()[0].strip("`") for c in _columns(shape.ddl)]
                rows.select(names).withColumn(BUCKET, shape.bucket()).repartition(min(len(buckets), shape.buckets), BUCKET).write.partitionBy(BUCKET).parquet(top)
                at = {b: f"{top}/{BUCKET}={b}" for b in buckets}
                sizes = {b: self.files.size(p) for b, p in at.items()}
                touched[table] = {str(b): {"at": at[b], "bytes": sizes[b]} if sizes[b] >= 0 else None for b in buckets}
            if not touched and all(base["notes"].get(k) == v for k, v in (notes or {}).items()):
                return base
            if new := self._commit(base, touched, notes or {}):
                return new
        raise Conflict(f"{attempts} attempts were overtaken by other writers")

    def touched(self, table: str, rows: DataFrame) -> list[int]:
        """The buckets in which rows lie."""
        return sorted(r[0] for r in rows.select(self.shapes[table].bucket()).distinct().collect())  # at most as many as buckets

    def _rewrite(self, table: str, changes: DataFrame, make: Callable[[DataFrame], DataFrame], notes: dict | None) -> dict:
        buckets = self.touched(table, changes)
        return self.change(lambda base: {table: (buckets, make(self.read(table, base, buckets)))}, notes)

    def append(self, table: str, rows: DataFrame, notes: dict | None = None) -> dict:
        """Adds rows; keys that are there already, or come twice, are violations, as are rows that break a rule."""
        self._held_to(table, rows)
        keys = list(self.shapes[table].keys)

        def make(held: DataFrame) -> DataFrame:
            again = rows.join(held.select(keys), keys, "left_semi").withColumn("violations", F.array(F.lit("key is taken")))
            if count := again.count():
                raise Violation(again, count)
            return held.unionByName(rows.select(held.columns))

        return self._rewrite(table, rows, make, notes)

    def upsert(self, table: str, rows: DataFrame, notes: dict | None = None) -> dict:
        """Rows replace those of their keys, or are added."""
        self._held_to(table, rows)
        keys = list(self.shapes[table].keys)
        return self._rewrite(table, rows, lambda held: held.join(rows.select(keys), keys, "left_anti").select(held.columns).unionByName(rows.select(held.columns)), notes)

    def update(self, table: str, rows: DataFrame, columns: list[str], notes: dict | None = None) -> dict:
        """Sets columns of the rows whose keys are given; keys that no row has change nothing. The rows that come out must keep the rules."""
        self._held_to(table, rows, False)
        keys = list(self.shapes[table].keys)
        new = rows.select(*keys, F.struct(*columns).alias("_new"))

        def make(held: DataFrame) -> DataFrame:
            done = held.join(new, keys, "left").select(*[(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) if c in columns else F.col(c)).alias(c) for c in held.columns])
            self._held_to(table, done.join(new.select(keys), keys, "left_semi").select(held.columns))
            return done

        return self._rewrite(table, rows, make, notes)

    def delete(self, table: str, keys: DataFrame, notes: dict | None = None) -> dict:
        """Takes out the rows of the given keys."""
        names = list(self.shapes[table].keys)
        return self._rewrite(table, keys, lambda held: held.join(keys.select(names), names, "left_anti").select(held.columns), notes)

    def expire(self, keep: int = 2) -> int:
        """Deletes what none of the last `keep` versions needs; returns how many folders went. Readers of older versions must be done."""
        numbers = sorted(int(n.split(".")[0]) for n in self.files.names("manifests") if n.endswith(".json"))
        live = {d["at"].rsplit("/", 1)[0].rsplit("/", 1)[1] for n in numbers[-keep:] for t in self.manifest(n)["tables"].values() for d in t.values()}
        gone = [n for n in self.files.names("data") if n not in live]
        for name in gone:
            self.files.delete(f"{self.root}/data/{name}")
        return len(gone)


def _columns(ddl: str) -> list[str]:
    """The columns of a DDL string; commas inside types don't part them."""
    parts, depth = [""], 0
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts]

"""The replay kept in a store, and only what changed replayed again.

A lane is a symbol. Its fingerprint is the number of its prepared rows, and the sum
and the exclusive or of their hashes, so it hangs on no order. Prepared rows hold
all that a replay reads: figures, the account's fee convention, the day's rate, the
symbol that renames lead to, and the transfer pair. A lane whose fingerprint
differs from the stored one is replayed, with all lanes that transfers tie to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import matching, replay
from ledgerloom.sources.scratch import release, stored
from ledgerloom.sources.tables import Shape, Store

LANES = "symbol string, n bigint, total decimal(38,0), mixed bigint"


def store(spark: SparkSession, root: str, buckets: int = 64) -> Store:
    """A store of fingerprints, steps and endings, all bucketed by symbol."""
    shapes = {
        "lanes": Shape(LANES, ("symbol",), buckets=buckets),
        "steps": Shape(replay.step_shape(True), ("symbol", "txn_id", "scope"), ("symbol",), buckets),
        "endings": Shape(replay.end_shape(True), ("symbol", "scope", "pool"), ("symbol",), buckets),
    }
    return Store(spark, root, shapes)


def fingerprints(ready: DataFrame) -> DataFrame:
    """symbol, n, total, mixed: a lane's rows as one content hash that hangs on no order."""
    columns = [c for c in sorted(ready.columns) if c not in ("symbol", "n", "total", "mixed")]
    # a hash passes over nulls, so which columns are null is hashed too
    one = F.xxhash64(F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns]), *[F.col(c) for c in columns])
    own = ready.where("symbol is not null").select("symbol", one.alias("h"))
    return own.groupBy("symbol").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("decimal(38,0)").alias("total"), F.bit_xor("h").alias("mixed"))


def folder_fingerprint(ready: DataFrame) -> DataFrame:
    """n, total, mixed of the whole ledger, rates and renames in it: a row."""
    one = fingerprints(ready)
    lane = F.xxhash64("symbol", "n", "total", "mixed")
    return one.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(lane.cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("total"), F.coalesce(F.bit_xor(lane), F.lit(0)).alias("mixed"))


def changed_lanes(ready: DataFrame, now: DataFrame, held: DataFrame) -> DataFrame:
    """Symbols that are new, gone or different, and those that transfers tie to them."""
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("n", "total", "mixed")]
    both = now.alias("a").join(held.alias("b"), F.col("a.symbol") == F.col("b.symbol"), "full")
    different = both.where(~F.coalesce(same[0] & same[1] & same[2], F.lit(False))).select(F.coalesce("a.symbol", "b.symbol").alias("symbol"))
    legs = ready.where("crosses and symbol is not null").groupBy("pair").agg(F.min("symbol").alias("a"), F.max("symbol").alias("b")).where("a < b")
    if legs.isEmpty():
        return different
    tied = matching.closed(legs.select("a", "b").distinct())
    families = tied.join(different, F.col("name") == F.col("symbol"), "left_semi").select("family").distinct()
    return different.unionByName(tied.join(families, "family", "left_semi").select(F.col("name").alias("symbol"))).distinct()


def load_or_build(of: Store, ready: DataFrame) -> tuple[dict, DataFrame]:
    """The manifest whose steps and endings are those of `ready`, and the symbols that were replayed for it.

    Without changes the store is read as it is. Buckets that are damaged are built
    anew. Fingerprints, steps and endings are committed as one version.
    """
    replayed = []

    def work(base: dict) -> dict:
        release(*replayed)
        broken = sorted({b for t in of.shapes for b in of.damaged(t, base)})
        fine = [b for b in range(of.shapes["lanes"].buckets) if b not in broken]
        now = stored(fingerprints(ready), "lanes")
        lost = of.shapes["lanes"].bucket().isin(broken) if broken else F.lit(False)
        lanes = changed_lanes(ready, now, of.read("lanes", base, fine)).unionByName(now.where(lost).select("symbol")).distinct()
        lanes = stored(lanes, "changed")
        replayed[:] = [lanes]
        buckets = sorted({*of.touched("lanes", lanes), *broken})
        again = ready.join(lanes, "symbol", "left_semi")
        made = {"lanes": now, "steps": replay.steps(again), "endings": replay.endings(again)} if buckets else {}
        out = {}
        for table, rows in made.items():
            kept = of.read(table, base, [b for b in buckets if b not in broken]).join(lanes, "symbol", "left_anti")
            out[table] = (buckets, kept.unionByName(rows.join(lanes, "symbol", "left_semi").select(kept.columns) if table == "lanes" else rows.select(kept.columns)))
        return out

    manifest = of.change(work)
    return manifest, replayed[0]

"""A ledger that follows a stream of files: each batch is deduplicated, committed once, and replayed where it changed something.

The batch's number is committed with its rows, so a batch that comes again after a
restart adds nothing. A row that is older than what its symbol's lane has seen is
no special case: the lane's fingerprint differs, and the lane is replayed. So any
split of a ledger into files, in any order, ends at the batch result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions import scalars as S
from ledgerloom.operators import incremental, ingest, replay
from ledgerloom.sources.tables import Shape, Store

ROWS = "key string, txn_id bigint, txn_date date, settle_date date, action string, currency string, ticker string, account string, acct_type string, amount decimal(30,10), price decimal(30,10), units decimal(30,10), fee decimal(30,10)"


def ledger_store(spark: SparkSession, root: str, buckets: int = 64) -> Store:
    """A store of ledger rows by the hash of their essentials."""
    return Store(spark, root, {"rows": Shape(ROWS, ("key",), buckets=buckets)})


def keyed(rows: DataFrame) -> DataFrame:
    """Rows in the ledger's form, with the hash of what identifies them."""
    names = [c.split()[0] for c in ROWS.split(", ")[1:]]
    kinds = dict(c.split() for c in ROWS.split(", ")[1:])
    key = S.essentials_hash([F.col(c) for c in ingest.ESSENTIALS])
    return rows.select(key.alias("key"), *[F.col(c).cast(kinds[c]).alias(c) for c in names])


def take(of: Store, batch: DataFrame, number: int, name: str = "stream") -> dict:
    """Commits the rows of a batch that the ledger doesn't hold yet; of rows with equal essentials the one with the smallest id counts.

    A batch whose number was committed before changes nothing. Ids are unique over the whole stream, or rows of
    equal essentials are one row, whichever file brings them first keeps its id.
    """
    if of.manifest()["notes"].get(name, -1) >= number:
        return of.manifest()
    rows = keyed(batch).groupBy("key").agg(F.min_by(F.struct("*"), "txn_id").alias("r")).select("r.*")

    def work(base: dict) -> dict:
        if base["notes"].get(name, -1) >= number:
            return {}
        buckets = of.touched("rows", rows)
        held = of.read("rows", base, buckets)
        return {"rows": (buckets, held.unionByName(rows.join(held.select("key"), "key", "left_anti").select(held.columns)))}

    return of.change(work, {name: number})


def follow(stream: DataFrame, ledger: Store, states: Store, rates: DataFrame, aliases: DataFrame, checkpoint: str, name: str = "stream", seen: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Starts the stream: every batch is taken into `ledger`, and `states` is brought up to date; `seen` is told the symbols that were replayed.

    It takes all that is there and ends; started again, it goes on where it stopped.
    """

    def each(batch: DataFrame, number: int) -> None:
        manifest = take(ledger, batch, number, name)
        ready = replay.stored(replay.prepared(ledger.read("rows", manifest), rates, aliases), "ready")
        _, lanes = incremental.load_or_build(states, ready)
        if seen is not None:
            seen(lanes)
        replay.release(ready)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

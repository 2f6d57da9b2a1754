"""What is held and what it is worth: positions and prices as of any days, totals with their shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(asked: DataFrame, known: DataFrame, keys: list[str], day: str, values: list[str], since: str = "since") -> DataFrame:
    """asked with the values of the latest row of `known` of the same keys on or before the day, and its day as `since`; null if there is none.

    Both sides may be large. Equal keys and days of `known` should be one row, and
    `asked` is asked once for each of its different keys and days: so a window
    holds at most two rows a day of a key, and one day's many rows don't meet in it.
    """
    once = asked.select(*keys, day).distinct()
    found = known.select(*keys, day, F.struct(F.col(day).alias(since), *values).alias("_v"), F.lit(0).alias("_asks"))
    both = once.select(*keys, day, F.lit(None).cast(found.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_asks")).unionByName(found)
    until = Window.partitionBy(*keys).orderBy(day, "_asks").rowsBetween(Window.unboundedPreceding, 0)
    answered = both.withColumn("_v", F.last("_v", ignorenulls=True).over(until)).where("_asks = 1").drop("_asks")
    return asked.join(answered, [*keys, day], "left").select(*asked.columns, *[F.col(f"_v.{c}").alias(c) for c in (since, *values)])


def positions(rows: DataFrame, pool: str) -> DataFrame:
    """pool, ticker, day, units, paid: after each day of trades, the units held and the cash put in less taken out."""
    sign = F.when(F.col("action") == "BUY", 1).when(F.col("action") == "SELL", -1).otherwise(0)
    days = rows.where("action in ('BUY', 'SELL')").groupBy(F.col(pool).alias("pool"), "ticker", F.col("txn_date").alias("day")).agg(F.sum(sign * F.col("units")).alias("units"), F.sum(sign * F.col("amount")).alias("paid"))
    until = Window.partitionBy("pool", "ticker").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(c).over(until).cast("decimal(30,2)").alias(c)
    return days.select("pool", "ticker", "day", total("units"), total("paid"))


def last_prices(rows: DataFrame) -> DataFrame:
    """ticker, day, price: that of the day's last trade by id."""
    return rows.where("action in ('BUY', 'SELL')").groupBy("ticker", F.col("txn_date").alias("day")).agg(F.max_by("price", "txn_id").alias("price"))


def valued(held: DataFrame, prices: DataFrame, days: DataFrame) -> DataFrame:
    """day, pool, ticker, units, paid, price, priced_on, market: every position that is open on each of the days, at its ticker's latest price."""
    asked = held.select("pool", "ticker").distinct().join(F.broadcast(days), F.lit(True))  # a few days
    open_ = as_of(asked, held, ["pool", "ticker"], "day", ["units", "paid"]).where("units <> 0").drop("since")
    priced = as_of(open_, prices, ["ticker"], "day", ["price"], "priced_on")
    return priced.select("day", "pool", "ticker", "units", "paid", "price", "priced_on", (F.col("units") * F.col("price")).cast("decimal(38,6)").alias("market"))


def totals(values: DataFrame) -> DataFrame:
    """day, pool, positions, market, paid, share: by pool and day, a row of null pool for the whole day, and each one's share of that."""
    rolled = values.groupBy("day", "pool").agg(F.count("*").alias("positions"), F.sum("market").alias("market"), F.sum("paid").alias("paid"))
    both = rolled.rollup("day", "pool").agg(F.sum("positions").alias("positions"), F.sum("market").cast("decimal(38,6)").alias("market"), F.sum("paid").cast("decimal(30,2)").alias("paid"), F.grouping_id().alias("level")).where("level < 3")
    whole = both.where("level = 1").select("day", F.col("market").alias("_all"))
    share = F.when(F.col("_all") != 0, F.col("market").cast("double") / F.col("_all").cast("double"))
    return both.join(whole, "day").select("day", F.when(F.col("level") == 0, F.col("pool")).alias("pool"), "positions", "market", "paid", share.alias("share"))

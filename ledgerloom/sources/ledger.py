"""A ledger over the order tables, its exchange rates, and its rename edges.

One ledger row per order line; its id is made from the line's own figures, so it
needs no global numbering. Parts are tickers, suppliers are accounts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import settled

#: Account types in the order in which suppliers get them.
ACCOUNT_TYPES = ["NON_REGISTERED", "MARGIN", "CORPORATE", "TFSA", "RRSP", "RRIF", "RESP", "FHSA", "LIRA"]

def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades and dividends: a row per order line, so that filters reach the scan.

    txn_id, txn_date, settle_date, action, ticker, account, acct_type, currency,
    units, amount, price, fee. The id holds order, line, part and quantity.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    money = lambda c: F.col(c).cast("decimal(20,2)")
    supp, action = F.col("l_suppkey"), F.when(F.col("l_linenumber") == 7, "DIVIDEND").when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY")
    currency, day = F.when(F.col("l_linestatus") == "F", "CAD").otherwise("USD"), F.col("l_shipdate").cast("date")
    units, amount = money("l_quantity"), money("l_extendedprice")
    return lines.select(
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 100 + F.col("l_quantity").cast("bigint")).cast("bigint").alias("txn_id"),
        day.alias("txn_date"),
        settled(action, currency, day)["date"].alias("settle_date"),
        action.alias("action"),
        F.concat(F.lit("T"), F.col("l_partkey")).alias("ticker"),
        account_of(supp).alias("account"),
        type_of(supp).alias("acct_type"),
        currency.alias("currency"),
        units.alias("units"),
        amount.alias("amount"),
        F.round(amount / units, 4).cast("decimal(20,4)").alias("price"),
        (F.col("l_discount").cast("decimal(6,2)") * 100).cast("decimal(20,2)").alias("fee"),
    )


def type_of(supp: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ACCOUNT_TYPES)), (supp % len(ACCOUNT_TYPES) + 1).cast("int"))


def account_of(supp: Column) -> Column:
    return F.concat(F.lit("B"), supp, F.lit("-"), type_of(supp))


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the other actions, with faults among them: money in and out from orders; conversions, charges, splits, returns of capital and transfers from events.

    Same columns as `ledger`; amounts are signed. Account B7 has no type that its
    name tells, and every seventh transfer lacks its in leg.
    """
    none = F.lit(None).cast("string")
    number = lambda c, kind="decimal(20,2)": (F.lit(c) if not isinstance(c, Column) else c).cast(kind)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    of_order = orders.where("o_orderkey % 4 in (0, 1)").select(
        (-F.col("o_orderkey") * 10 - 1).cast("bigint").alias("txn_id"), F.col("o_orderdate").cast("date").alias("txn_date"), F.col("o_orderdate").cast("date").alias("settle_date"),
        F.when(F.col("o_orderkey") % 4 == 0, "CONTRIBUTION").otherwise("WITHDRAWAL").alias("action"), none.alias("ticker"), account_of(F.col("o_custkey") % 10).alias("account"), type_of(F.col("o_custkey") % 10).alias("acct_type"),
        F.lit("CAD").alias("currency"), number(0).alias("units"), number(F.col("o_totalprice").cast("decimal(20,2)") * F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(-1)).alias("amount"), number(0, "decimal(20,4)").alias("price"), number(0).alias("fee"),
    )
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("v", F.col("value").cast("decimal(20,2)")).withColumn("day", F.col("ts").cast("date"))
    kind = (
        F.when(F.col("event_type") == "signup", "FXT").when(F.col("event_type") == "error", "FCH").when((F.col("event_type") == "purchase") & (F.col("event_id") % 20 == 0), "SPLIT")
        .when((F.col("event_type") == "click") & (F.col("event_id") % 25 == 0), "ROC").when((F.col("event_type") == "view") & (F.col("event_id") % 10 == 0), "TFR")
    )
    events = events.withColumn("kind", kind).where("kind is not null")
    legs = F.when(F.col("kind") != "TFR", F.array("kind")).when(F.col("event_id") % 70 == 0, F.array(F.lit("TFR_OUT"))).otherwise(F.array(F.lit("TFR_OUT"), F.lit("TFR_IN")))
    events = events.withColumn("action", F.explode(legs)).withColumn("supp", F.col("user_id") % 10 + F.when(F.col("action") == "TFR_IN", 1).otherwise(0))
    moved = F.col("action").isin("TFR_OUT", "TFR_IN")
    side = F.when(F.col("action") == "TFR_OUT", -1).otherwise(1)
    symbolic = F.col("action").isin("SPLIT", "ROC", "TFR_OUT", "TFR_IN")
    of_event = events.select(
        (-F.col("event_id") * 10 - F.when(F.col("action") == "TFR_IN", 3).otherwise(2)).cast("bigint").alias("txn_id"), F.col("day").alias("txn_date"), F.col("day").alias("settle_date"), "action",
        F.when(symbolic, F.concat(F.lit("T"), F.col("user_id") % 50)).alias("ticker"), F.when(F.col("supp") == 7, "B7").otherwise(account_of(F.col("supp"))).alias("account"), F.when(F.col("supp") == 7, "UNKNOWN").otherwise(type_of(F.col("supp"))).alias("acct_type"),
        F.lit("CAD").alias("currency"), number(F.when(F.col("action") == "FXT", F.col("v") * 2).when(F.col("action") == "SPLIT", 2).when(moved, side * (F.floor("v") + 1)).otherwise(0)).alias("units"),
        number(F.when(F.col("action") == "FXT", -F.col("v") * F.lit("2.5").cast("decimal(2,1)") - F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)).when(F.col("action") == "FCH", -F.col("v")).when(F.col("action") == "ROC", F.col("v")).otherwise(0)).alias("amount"),
        number(F.when(F.col("action") == "FXT", F.lit("1.25").cast("decimal(3,2)")).when(F.col("action") == "SPLIT", 1).otherwise(0), "decimal(20,4)").alias("price"), number(F.when(F.col("action") == "FXT", 2).otherwise(0)).alias("fee"),
    )
    return of_order.unionByName(of_event)


def full_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades, dividends and all other actions; every 97th trade settles before it is made, every 89th a week late, and every 101st has 500 too much."""
    trades = ledger(spark, sf_dir)
    late = F.when(F.col("txn_id") % 97 == 0, F.date_sub("txn_date", 1)).when(F.col("txn_id") % 89 == 0, F.date_add("settle_date", 7)).otherwise(F.col("settle_date"))
    off = (F.col("action") != "DIVIDEND") & (F.col("txn_id") % 101 == 0)
    trades = trades.withColumn("amount", F.when(off, F.col("amount") + 500).otherwise(F.col("amount")).cast("decimal(20,2)"))
    return trades.withColumn("settle_date", F.when(F.col("action") == "DIVIDEND", F.col("settle_date")).otherwise(late)).unionByName(movements(spark, sf_dir))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_date, rate: one row per weekday that has an order."""
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("fx_date")).distinct()
    rate = ((13500 + 50 * (F.dayofyear("fx_date") % 7)) * F.lit(0.0001).cast("decimal(5,4)")).cast("decimal(20,4)")
    return days.where(F.weekday("fx_date") < 5).select("fx_date", rate.alias("rate"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """old, new, effective: of every three parts in turn the first is renamed to the second, and that to the third, on some day of the years of trade."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 3 > 0")
    name = lambda i: F.concat(F.lit("T"), F.col("p_partkey") + i)
    return parts.select(name(0).alias("old"), name(1).alias("new"), F.date_add(F.lit("1992-06-01").cast("date"), (F.col("p_partkey") * 37 % 2000).cast("int")).alias("effective"))

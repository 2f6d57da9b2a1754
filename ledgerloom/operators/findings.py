"""Figures and findings over the ledger: votes, modes, running balances, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cash_delta(row_fee: bool = True) -> Column:
    """What a row does to its account's cash."""
    fee = F.col("fee") if row_fee else F.lit(0)
    return F.when(F.col("action") == "BUY", -F.col("amount") - fee).when(F.col("action") == "SELL", F.col("amount") - fee).when(F.col("action") == "DIVIDEND", F.col("amount")).otherwise(0).cast("decimal(20,2)")


def signed_units() -> Column:
    return F.when(F.col("action") == "BUY", F.col("units")).when(F.col("action") == "SELL", -F.col("units")).otherwise(0).cast("decimal(20,2)")


def first_winner(rows: DataFrame, keys: list[str], vote: str, order: list[str]) -> DataFrame:
    """The most frequent vote of each key; of equally frequent ones that which came first in the given order."""
    counted = rows.groupBy(*keys, vote).agg(F.count("*").alias("votes"), F.min(F.struct(*order)).alias("came"))
    best = F.min_by(F.struct(vote, "votes"), F.struct(-F.col("votes"), "came")).alias("best")
    return counted.groupBy(*keys).agg(best, F.sum("votes").alias("of")).select(*keys, f"best.{vote}", "best.votes", "of")


def currency_majority(rows: DataFrame) -> DataFrame:
    """Rows whose currency is not that of most rows of their ticker (ties: by name)."""
    trades = rows.where(F.col("action").isin("BUY", "SELL", "DIVIDEND", "ROC"))
    counted = trades.groupBy("ticker", "currency").count()
    top = counted.groupBy("ticker").agg(F.min_by("currency", F.struct(-F.col("count"), F.col("currency"))).alias("most"), F.count("*").alias("n")).where("n > 1")
    return trades.join(top, "ticker").where("currency <> most").select("txn_id", "ticker", "currency", "most")


def movements(states: DataFrame) -> DataFrame:
    """txn_id, moved: the sign of the change of held units against the ticker's row before; null at the first."""
    before = F.lag("held").over(Window.partitionBy("ticker").orderBy("txn_date", "rank", "txn_id"))
    return states.select("txn_id", "ticker", F.signum(F.col("held") - before).cast("int").alias("moved"))


def merged_groups(rows: DataFrame, keys: list[str], sources: list[str], target: str, amount: str = "amount", operations: dict[str, object] | None = None) -> DataFrame:
    """Groups that hold all source actions become their first row, with the target action and the sum of amounts; all other rows stay.

    Nulls of the keys are equal. Text amounts are summed as decimals and rounded
    to 10 places; `operations` sets further columns of the merged rows.
    """
    order = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]) if "txn_id" not in rows.columns else F.col("txn_id")
    kind = rows.schema[amount].dataType
    part = rows.where(F.col("action").isin(sources))
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), order).alias("first")
    total = F.round(F.sum(F.col(amount).try_cast("decimal(28,10)")), 10)
    full = part.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.countDistinct("action").alias("kinds"), total.cast(kind).alias("total"), first).where(F.col("kinds") == len(set(sources)))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    stay = rows.where(~F.col("action").isin(sources) | F.col("action").isNull()).unionByName(part.join(full.select(*[f"_{k}" for k in keys]), same, "left_anti"))
    new = {"action": F.lit(target), amount: F.col("total")} | {c: F.lit(v).cast(rows.schema[c].dataType) for c, v in (operations or {}).items() if c in rows.columns}
    return stay.unionByName(full.select(*[new.get(c, F.col(f"first.`{c}`")).alias(c) for c in rows.columns]))


def ruled(rows: DataFrame, rules: list[tuple[dict[str, list[str]], dict[str, str | None]]]) -> DataFrame:
    """Rules in turn: where every condition column has one of its values (`contains:x` looks inside), columns are set.

    A rule whose condition column is missing is passed over, and so is a target that is missing.
    """
    for conditions, actions in rules:
        if any(c not in rows.columns for c in conditions):
            continue
        mask = F.lit(True)
        for column, values in conditions.items():
            one = F.lit(False)
            for v in values:
                text = F.col(column).cast("string")
                equal = F.coalesce(text == v, F.lit(False))
                if v.replace(".", "", 1).lstrip("-").isdigit():
                    equal = equal | F.coalesce(text.try_cast("double") == float(v), F.lit(False))
                one = one | (F.lower(text).contains(v[9:].lower()) if v.startswith("contains:") else equal)
            mask = mask & F.coalesce(one, F.lit(False))
        for column, value in actions.items():
            if column in rows.columns:
                rows = rows.withColumn(column, F.when(mask, F.lit(value or None).cast(rows.schema[column].dataType)).otherwise(F.col(column)))
    return rows

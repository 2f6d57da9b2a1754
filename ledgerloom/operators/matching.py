"""Joins of the ledger: rates as of a day, renames, pairs, ranges."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.scratch import stored


def with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows with fx_date and rate: the latest on or before settle_date, else the earliest; null for CAD.

    The rates become a calendar, a row a day from the first to the last of them, so
    rows, their days held to that span, only look theirs up.
    """
    known = rates.groupBy("fx_date").agg(F.max("rate").alias("rate"))
    until = F.coalesce(F.date_sub(F.lead("fx_date").over(Window.orderBy("fx_date")), 1), F.col("fx_date"))  # a row a day
    calendar = known.withColumn("_until", until).select(F.explode(F.sequence("fx_date", "_until")).alias("_day"), F.struct("fx_date", "rate").alias("fx"))
    span = F.broadcast(rates.agg(F.min("fx_date").alias("_from"), F.max("fx_date").alias("_to")))  # one row
    day = F.when(F.col("currency") != "CAD", F.greatest(F.least("settle_date", "_to"), "_from"))
    joined = rows.crossJoin(span).withColumn("_day", day).join(calendar, "_day", "left")
    return joined.select(*rows.columns, F.col("fx.fx_date").alias("fx_date"), F.col("fx.rate").alias("rate"))


def rate_class(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """rows of `with_rates` with rate_class: exact, carried_back, stale (after the last rate) or uncovered (before the first); null for CAD."""
    last = F.broadcast(rates.agg(F.max("fx_date").alias("_last")))  # one row
    found = F.when(F.col("fx_date").isNull(), None).when(F.col("fx_date") == F.col("settle_date"), "exact").when(F.col("fx_date") > F.col("settle_date"), "uncovered").when(F.col("settle_date") > F.col("_last"), "stale").otherwise("carried_back")
    return rows.crossJoin(last).select(*rows.columns, found.alias("rate_class"))


def canonical(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows with `canonical`: renames followed while the row is older than the rename; cycles end.

    Edges are walked once for each ticker of the edge list, until no chain grows;
    only then do rows join the finished chains. Of edges that share an old name
    one counts, the latest (then the smallest new name).
    """
    if aliases.isEmpty():
        return rows.withColumn("canonical", F.col("ticker"))
    step = stored(aliases.groupBy(F.upper(F.trim("old")).alias("old")).agg(F.min_by(F.struct(F.upper(F.trim("new")).alias("new"), "effective"), F.struct(-F.unix_date("effective"), "new")).alias("e")).select("old", "e.*"), "renames")
    chain = step.select(F.col("old").alias("ticker"), F.array(F.struct("effective", "new")).alias("path"), F.col("new").alias("next"))
    step = step.select(F.col("old").alias("next"), F.col("new").alias("then"), F.col("effective").alias("when"))
    while not chain.join(step, "next", "left_semi").isEmpty():
        grown = chain.join(step, "next", "left")
        ended = F.col("then").isNull() | F.exists("path", lambda p: p["new"] == F.col("then")) | (F.col("then") == F.col("ticker"))
        path = F.when(~ended, F.concat("path", F.array(F.struct(F.col("when").alias("effective"), F.col("then").alias("new"))))).otherwise(F.col("path"))
        chain = stored(grown.select("ticker", path.alias("path"), F.when(~ended, F.col("then")).alias("next")), "chains")
    joined = rows.join(chain.select("ticker", "path"), "ticker", "left")
    start = F.struct(F.col("ticker").alias("now"), F.lit(True).alias("open"))
    walk = F.aggregate("path", start, lambda s, e: F.when(s["open"] & (F.col("txn_date") < e["effective"]), F.struct(e["new"].alias("now"), F.lit(True).alias("open"))).otherwise(F.struct(s["now"].alias("now"), F.lit(False).alias("open"))))
    return joined.select(*rows.columns, F.when(F.col("path").isNull(), F.col("ticker")).otherwise(walk["now"]).alias("canonical"))


def closed(edges: DataFrame) -> DataFrame:
    """name, family: the smallest name among all that edges (a, b) connect; rounds go on until no name moves.

    In every round a name takes the smallest family of its neighbours, and then
    the family of that family, so chains halve.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    names = stored(both.groupBy(F.col("a").alias("name")).agg(F.min(F.least("a", "b")).alias("family")), "names")
    while True:
        near = names.join(both, F.col("name") == F.col("b")).select(F.col("a").alias("name"), "family")
        least = stored(names.unionByName(near).groupBy("name").agg(F.min("family").alias("family")), "least")
        of = least.select(F.col("name").alias("family"), F.col("family").alias("further"))
        moved = stored(least.join(of, "family", "left").select("name", F.coalesce("further", "family").alias("family")), "names")
        if moved.join(names, ["name", "family"], "left_anti").isEmpty():
            return moved
        names = moved


def families(aliases: DataFrame) -> DataFrame:
    """ticker, family: the smallest name among all that renames connect, at any time."""
    return closed(aliases.select(F.col("old").alias("a"), F.col("new").alias("b"))).withColumnRenamed("name", "ticker")


def superficial_losses(sales: DataFrame, buys: DataFrame, days: int = 30) -> DataFrame:
    """Sales with a buy of the ticker within `days` days, by buckets of days and an exact test."""
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / (days + 1))
    near = sales.withColumn("bucket", F.explode(F.sequence(bucket(F.date_sub("txn_date", days)), bucket(F.date_add("txn_date", days)))))
    days_of = buys.select("ticker", F.col("txn_date").alias("bought"), bucket(F.col("txn_date")).alias("bucket")).distinct()
    hit = near.join(days_of, ["ticker", "bucket"]).where(F.abs(F.datediff("bought", "txn_date")) <= days)
    return hit.select(*sales.columns).distinct()


def unmatched(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys no other row has."""
    return rows.join(others.select(*keys).distinct(), keys, "left_anti").select(*rows.columns)


def matched_once(statement: DataFrame, rows: DataFrame, tolerance: str = "0.01", units_tolerance: str = "0.0001", by: str | None = "statement_id") -> DataFrame:
    """statement_id, txn_id where exactly one row has the same action, day, ticker and currency, nearly the amount, and nearly the units where the line tells them.

    A band join: amounts fall into buckets as wide as the tolerance, a line looks
    into its own and the two beside it, and then exactly. Rows of equal keys,
    amounts and units are counted first, and so are lines, so however many of
    them a day and ticker have, each pair of different amounts meets once.
    Amounts and units compare by size. Lines without an amount match nothing.
    Lines with the same `by` (null: there are none) must fit one row in all.
    """
    keys, exact = ["action", "txn_date", "ticker", "currency"], "decimal(30,10)"
    bucket = lambda c: F.floor(F.col(c) / F.lit(tolerance).cast(exact)).cast("bigint")
    size = lambda c: F.abs(F.col(c).cast(exact))
    units = lambda d: size("units") if "units" in d.columns else F.lit(None).cast(exact)
    lines = statement.select("statement_id", *keys, size("amount").alias("paid"), units(statement).alias("of"))
    lines = lines.withColumn("of", F.when(F.col("of") > 0, F.col("of")))
    asked = lines.where("paid is not null").groupBy(*keys, "paid", "of").agg(F.count("*").alias("lines"))
    near = asked.withColumn("at", F.explode(F.array(*[bucket("paid") + i for i in (-1, 0, 1)])))
    held = rows.select("txn_id", *keys, size("amount").alias("amount"), units(rows).alias("units"))
    held = held.groupBy(*keys, "amount", "units").agg(F.count("*").alias("n"), F.min("txn_id").alias("txn_id")).withColumn("at", bucket("amount"))
    fits = (F.abs(F.col("amount") - F.col("paid")) < F.lit(tolerance).cast(exact)) & (F.col("of").isNull() | (F.abs(F.col("units") - F.col("of")) < F.lit(units_tolerance).cast(exact)))
    found = near.join(held, [*keys, "at"]).where(fits).groupBy(*keys, "paid", "of").agg(F.sum("n").alias("n"), F.min("txn_id").alias("txn_id"))
    found = found.where("n = 1") if by is None else found
    found = found.withColumnRenamed("of", "_of")
    back = [lines[k] == found[k] for k in [*keys, "paid"]] + [lines["of"].eqNullSafe(found["_of"])]
    hits = lines.join(found, back)
    if by is not None:
        hits = hits.groupBy(F.col(by).alias("_by")).agg(F.any_value("statement_id").alias("statement_id"), F.min("txn_id").alias("txn_id"), F.sum("n").alias("n")).where("n = 1")
    return hits.select("statement_id", "txn_id")


def split_missing(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Accounts that hold a ticker on the day of a split and have no split row: ticker, day, account.

    A ticker's split days lie in one sorted array. Rows are summed by the first
    of these days that comes after them, so no row is repeated for the later
    ones; running sums of the few remaining figures tell what an account held on
    each day. Rows and splits without a ticker, a day or an account count for nothing.
    """
    days = splits.where("ticker is not null and day is not null").groupBy("ticker").agg(F.array_sort(F.collect_set("day")).alias("days"))  # at most a day each
    signed = F.when(F.col("action") == "SELL", -F.col("units")).when(F.col("action") == "BUY", F.col("units"))
    before = rows.where("account is not null and txn_date is not null").select("ticker", "account", "txn_date", signed.alias("units")).where("units is not null")
    slot = F.size(F.filter("days", lambda d: d <= F.col("txn_date")))
    sums = before.join(days, "ticker").select("ticker", "account", slot.alias("slot"), "units", "days").groupBy("ticker", "account", "slot").agg(F.sum("units").alias("units"), F.any_value("days").alias("days"))
    own = Window.partitionBy("ticker", "account").orderBy("slot")
    held = sums.where(F.col("slot") < F.size("days")).select("ticker", "account", "days", "slot", F.sum("units").over(own).alias("held"), F.lead("slot").over(own).alias("next")).where("held > 0")
    spans = F.slice("days", F.col("slot") + 1, F.coalesce("next", F.size("days")) - F.col("slot"))
    return unmatched(held.select("ticker", F.explode(spans).alias("day"), "account"), splits, ["ticker", "day", "account"])


class _Queues:
    """Free in legs in queues by name: the least whose name is not a given one is at the top of a heap of the queues' heads."""

    def __init__(self) -> None:
        self.by: dict = {}
        self.heads: list = []

    def add(self, txn: int, name) -> None:
        """Legs come in the order of txn."""
        if name not in self.by:
            self.by[name] = deque()
            heapq.heappush(self.heads, (txn, len(self.by), name))
        self.by[name].append(txn)

    def own(self, name, used: set) -> int | None:
        legs = self.by.get(name, ())
        while legs and legs[0] in used:
            legs.popleft()
        return legs[0] if legs else None

    def other(self, name, used: set) -> int | None:
        aside, found = None, None
        while self.heads and found is None:
            txn, turn, of = heapq.heappop(self.heads)
            now = self.own(of, used)
            if now is None:
                continue
            if now != txn:
                heapq.heappush(self.heads, (now, turn, of))
            elif of == name:
                aside = (txn, turn, of)
            else:
                found = txn
                heapq.heappush(self.heads, (txn, turn, of))
        if aside:
            heapq.heappush(self.heads, aside)
        return found


class _Free:
    """Free in legs of one size."""

    def __init__(self) -> None:
        self.every, self.tickers, self.accounts = _Queues(), {}, {}

    def add(self, txn: int, ticker, account) -> None:
        self.every.add(txn, account)
        self.tickers.setdefault(ticker, _Queues()).add(txn, account)
        self.accounts.setdefault(account, _Queues()).add(txn, ticker)

    def best(self, position: bool, ticker, account, used: set) -> tuple[int, int] | None:
        """(score, txn_id): 0 the ticker in another account, 1 another ticker in the account, 2 another account; for cash 0 another account, 1 the account."""
        if position:
            found = [self.tickers[ticker].other(account, used) if ticker in self.tickers else None]
            found += [self.accounts[account].other(ticker, used) if account in self.accounts else None, self.every.other(account, used)]
        else:
            found = [self.every.other(account, used), self.every.own(account, used)]
        return next(((score, txn) for score, txn in enumerate(found) if txn is not None), None)


def _greedy(tolerances: dict[str, Decimal]):
    names = ["out_id", "in_id"]

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, free, sizes, used = None, {}, [], set()
        for batch in batches:
            out = []
            for *key, action, txn, ticker, account, size in batch.itertuples(index=False, name=None):
                if key != now:
                    now, free, sizes, used = key, {}, [], set()
                if action == "TFR_IN":
                    if size not in free:
                        free[size] = _Free()
                        insort(sizes, size)
                    free[size].add(txn, ticker, account)
                    continue
                kind = key[1]
                low, high = bisect_left(sizes, size - tolerances[kind]), bisect_right(sizes, size + tolerances[kind])
                found = [x for s in sizes[low:high] if (x := free[s].best(kind == "position", ticker, account, used))]
                if found:
                    used.add(min(found)[1])
                    out.append((txn, min(found)[1]))
            yield pd.DataFrame(out, columns=names)

    return greedy


def paired_transfers(legs: DataFrame, tolerance: float = 1e-9, cash_tolerance: float = 0.01) -> DataFrame:
    """out_id, in_id: transfer legs of one day with equal units or, without units or ticker, equal amounts, each used once.

    Out legs choose in the order of txn_id, greedily by (score, in_id). Legs of
    a day are dealt by chains of sizes that lie within the tolerance of each
    other: legs of two chains never pair. In legs come first, and a task holds
    only the free ones of one chain.
    """
    exact = "decimal(38,12)"
    own = legs.where("action in ('TFR_OUT', 'TFR_IN') and settle_date is not null")
    units = F.abs(F.coalesce("units", F.lit(0))).cast(exact)
    amount = F.abs("amount").cast(exact) if "amount" in legs.columns else F.lit(None).cast(exact)
    moves = (units != 0) & (F.coalesce("ticker", F.lit("")) != "")
    kind = F.when(moves, "position").otherwise("cash")
    own = own.select("txn_id", "action", "settle_date", "ticker", "account", kind.alias("kind"), F.when(moves, units).otherwise(amount).alias("size")).where("size is not null")
    tolerances = {"position": Decimal(str(tolerance)), "cash": Decimal(str(cash_tolerance))}
    sizes = own.groupBy("settle_date", "kind", "size").agg(F.min("action").alias("low"), F.max("action").alias("high"))
    day = Window.partitionBy("settle_date", "kind").orderBy("size")
    most = F.when(F.col("kind") == "cash", F.lit(tolerances["cash"]).cast(exact)).otherwise(F.lit(tolerances["position"]).cast(exact))
    sizes = sizes.withColumn("opens", F.when(F.coalesce(F.col("size") - F.lag("size").over(day) > most, F.lit(True)), F.col("size")))
    sizes = sizes.withColumn("chain", F.last("opens", ignorenulls=True).over(day.rowsBetween(Window.unboundedPreceding, 0)))
    chain = ["settle_date", "kind", "chain"]
    both = sizes.groupBy(*chain).agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    dealt = own.join(sizes.join(both, chain, "left_semi").select("chain", "settle_date", "kind", "size"), ["settle_date", "kind", "size"])
    dealt = dealt.select(*chain, "action", "txn_id", "ticker", "account", "size").repartition(*chain).sortWithinPartitions(*chain, "action", "txn_id")
    return dealt.mapInPandas(_greedy(tolerances), "out_id bigint, in_id bigint")

"""What is wrong with a ledger: findings by code, flags on rows, and ten checks over the findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import matching, replay
from ledgerloom.operators.fold import intraday

TRADES = ["BUY", "SELL"]
DENOMINATED = ["BUY", "SELL", "DIVIDEND", "ROC"]
COLUMNS = ["turn", "code", "txn_id", "scope", "pool", "account", "symbol", "currency", "as_of", "value", "detail"]
_KINDS = {"txn_id": "bigint", "scope": "int", "value": "double", "as_of": "date", "turn": "int"}


def _finding(rows: DataFrame, turn: int, code: str | Column, detail: Column, **named) -> DataFrame:
    """Rows as findings: columns named, others null. `turn` says when the code is raised."""
    named = {"turn": F.lit(turn), "code": F.lit(code) if isinstance(code, str) else code, "detail": detail} | named
    return rows.select(*[(named[c] if c in named else F.lit(None)).cast(_KINDS.get(c, "string")).alias(c) for c in COLUMNS])


def unknown_accounts(ready: DataFrame) -> DataFrame:
    rows = ready.where("acct_type = 'UNKNOWN'").select("account").distinct()
    return _finding(rows, 0, "UNKNOWN_ACCOUNT_TYPE", F.format_string("no type can be told from the name %s", "account"), account=F.col("account"), pool=F.col("account"), scope=F.lit(0))


def row_findings(ready: DataFrame) -> DataFrame:
    """What a row shows by itself: settlement before the trade, a conversion that does not add up, a fee that fits neither way."""
    own = {"txn_id": F.col("txn_id"), "account": F.col("account"), "symbol": F.col("symbol"), "currency": F.col("currency")}
    trades = ready.where(F.col("action").isin(TRADES))
    early = _finding(trades.where("settle_date < txn_date"), 1, "SETTLE_BEFORE_TRADE", F.format_string("settles %s, traded %s", F.col("settle_date").cast("string"), F.col("txn_date").cast("string")), **own)
    implied = F.abs(F.col("units") * F.col("price"))
    off = ready.where("action = 'FXT' and units <> 0 and price <> 0").where(F.abs(F.abs("amount") - implied) > 0.005)
    uneven = _finding(off, 2, "FXT_AMOUNT_INCONSISTENT", F.format_string("amount %s against %s", "amount", implied.cast("string")), value=implied, **own)
    without, inside = S.fee_fits(F.col("action"), F.col("amount"), F.col("price"), F.col("units"), F.col("commission"))
    odd = _finding(trades.where(F.col("fee") != 0).where(~without & ~inside), 4, "AMBIGUOUS_FEE_CONVENTION", F.format_string("amount %s fits no fee of %s", "amount", "fee"), **own)
    return early.unionByName(uneven).unionByName(odd)


def lone_legs(ready: DataFrame) -> DataFrame:
    """Transfer legs that found no other leg."""
    own = {"txn_id": F.col("txn_id"), "account": F.col("account"), "symbol": F.col("symbol"), "currency": F.col("currency")}
    return _finding(ready.where("action in ('TFR_IN', 'TFR_OUT') and pair is null"), 3, "TRANSFER_UNPAIRED", F.format_string("%s without its other leg", "action"), **own)


def pool_findings(done: DataFrame) -> DataFrame:
    """The codes that the replay raised, by pool."""
    raised = done.select("txn_id", "scope", "pool", "symbol", "value", F.explode("codes").alias("raised"))
    account = F.when(F.col("scope") == 0, F.col("pool"))
    return _finding(raised, 5, F.col("raised"), F.format_string("%s of %s in %s", "raised", "symbol", "pool"), txn_id=F.col("txn_id"), scope=F.col("scope"), pool=F.col("pool"), symbol=F.col("symbol"), account=account, value=F.when(F.col("raised").isin("OVERSELL", "ROC_EXCEEDS_ACB"), F.col("value")))


def cash_negative(ready: DataFrame) -> DataFrame:
    """The first day on which an account's cash ends below zero to the cent, and whether it has stayed there since; margin accounts may be."""
    days = replay.balances(ready.where("acct_type <> 'MARGIN'")).where("scope = 0")
    low = F.bround("balance", 2) < 0
    first = F.min_by(F.when(low, F.struct("settle_date", "first_id", "balance")), F.when(low, F.col("settle_date"))).alias("d")
    found = days.groupBy("pool", "currency").agg(first, F.max_by("balance", "settle_date").alias("ended")).where("d is not null").select("pool", "currency", "d.*", "ended")
    tail = F.when(F.bround("ended", 2) == F.bround("balance", 2), ", unchanged since").otherwise(", and moved on since")
    return _finding(
        found, 6, "CASH_NEGATIVE", F.format_string("%s of %s on %s%s", F.col("balance").cast("string"), "currency", F.col("settle_date").cast("string"), tail), txn_id=F.col("first_id"), scope=F.lit(0),
        pool=F.concat_ws(":", "pool", "currency"), account=F.col("pool"), currency=F.col("currency"), as_of=F.col("settle_date"), value=F.col("balance"),
    )


def negative_endings(ended: DataFrame) -> DataFrame:
    low = ended.where(F.col("units").cast("double") < -1e-9)
    account = F.when(F.col("scope") == 0, F.col("pool"))
    return _finding(low, 7, "NEGATIVE_FINAL_POSITION", F.format_string("%s ends at %s in %s", "symbol", F.col("units").cast("string"), "pool"), scope=F.col("scope"), pool=F.concat_ws(":", "pool", "symbol"), account=account, symbol=F.col("symbol"), value=F.col("units"))


def holders(ready: DataFrame, done: DataFrame) -> DataFrame:
    """symbol, account, day: accounts that held a symbol when the first split row of a day came.

    The accounts of a symbol ask, for each of its split days, for their last
    figures before it: one pass over each account's own rows.
    """
    order = F.struct("txn_date", intraday(F.col("action")).alias("rank"), "txn_id")
    days = ready.where("action = 'SPLIT' and symbol is not null").groupBy("symbol", "txn_date").agg(F.min(order).alias("at"))
    own = done.where("scope = 0").join(ready.select("txn_id", "txn_date", "action"), "txn_id").select("symbol", F.col("pool").alias("account"), order.alias("at"), F.col("units").cast("double").alias("units"))
    asks = own.select("symbol", "account").distinct().join(days, "symbol").select("symbol", "account", "at", F.lit(None).cast("double").alias("units"), F.lit(0).alias("kind"))
    both = own.withColumn("kind", F.lit(1)).unionByName(asks)  # at the split's own place the question comes before the row
    before = Window.partitionBy("symbol", "account").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("held", F.last("units", ignorenulls=True).over(before)).where("kind = 0 and held > 0").select("symbol", "account", F.col("at.txn_date").alias("day"))


def split_mismatches(ready: DataFrame, holding: DataFrame) -> DataFrame:
    """Accounts that held a symbol when the first split row of a day came, and have no split row that day."""
    splits = ready.where("action = 'SPLIT' and symbol is not null")
    lacking = matching.unmatched(holding, splits.select("symbol", F.col("txn_date").alias("day"), "account"), ["symbol", "day", "account"])
    return _finding(lacking, 8, "SPLIT_SCOPE_MISMATCH", F.format_string("split of %s missing in %s", "symbol", "account"), scope=F.lit(0), pool=F.concat_ws(":", "symbol", "day", "account"), account=F.col("account"), symbol=F.col("symbol"), as_of=F.col("day"))


def mixed_currencies(ready: DataFrame) -> DataFrame:
    """Rows whose currency is not that of most rows of their symbol (ties by name), with how many rows it has of each."""
    rows = ready.where(F.col("action").isin(DENOMINATED) & F.col("symbol").isNotNull())
    counted = rows.groupBy("symbol", "currency").agg(F.count("*").alias("n"))
    each = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "currency")))  # a currency each
    top = counted.groupBy("symbol").agg(each.alias("each")).where(F.size("each") > 1)
    said = F.array_join(F.transform("each", lambda x: F.concat((-x["n"]).cast("string"), F.when(x["n"] == -1, " row of ").otherwise(" rows of "), x["currency"])), ", ")
    odd = rows.join(top.select("symbol", F.col("each")[0]["currency"].alias("most"), F.concat(F.lit("booked in "), said).alias("said")), "symbol").where("currency <> most")
    return _finding(odd, 9, "MIXED_CURRENCY", F.col("said"), txn_id=F.col("txn_id"), pool=F.col("symbol"), account=F.col("account"), symbol=F.col("symbol"), currency=F.col("currency"))


def lag_outliers(ready: DataFrame) -> DataFrame:
    """Trades that settle more than two business days off their account's most frequent lag; five trades make a habit.

    Of equally frequent lags that counts which came first by (txn_date, txn_id).
    """
    trades = ready.where(F.col("action").isin(TRADES) & (F.col("settle_date") >= F.col("txn_date"))).withColumn("lag", S.business_days(F.col("txn_date"), F.col("settle_date")))
    counted = trades.groupBy("account", "lag").agg(F.count("*").alias("n"), F.min(F.struct("txn_date", "txn_id")).alias("came"))
    usual = counted.groupBy("account").agg(F.min_by("lag", F.struct(-F.col("n"), "came")).alias("usual"), F.sum("n").alias("of")).where("of >= 5")
    off = trades.join(usual, "account").where(F.abs(F.col("lag") - F.col("usual")) > 2)
    return _finding(off, 10, "SETTLE_LAG_OUTLIER", F.format_string("%s business days, usually %s", "lag", "usual"), txn_id=F.col("txn_id"), account=F.col("account"), symbol=F.col("symbol"), value=F.col("lag"))


def superficial_losses(ready: DataFrame, done: DataFrame) -> DataFrame:
    """Taxable sales at a loss in their own account with a buy of the symbol, in any account, within 30 days."""
    own = done.where("scope = 0").select("txn_id", F.col("delta_cad").cast("double").alias("delta"))
    sales = ready.where(F.col("acct_type").isin(S.TAXABLE) & (F.col("action") == "SELL") & F.col("symbol").isNotNull()).join(own, "txn_id")
    lost = sales.where((F.col("proceeds") * F.coalesce("rate", F.lit(1))).cast("double") + F.col("delta") < 0)
    named = lambda d: d.drop("ticker").withColumnRenamed("symbol", "ticker")
    near = matching.superficial_losses(named(lost).select("txn_id", "txn_date", "ticker", "account"), named(ready.where("action = 'BUY' and symbol is not null")))
    return _finding(near, 11, "SUPERFICIAL_LOSS_SUSPECT", F.format_string("loss on %s with a buy within 30 days", "ticker"), txn_id=F.col("txn_id"), account=F.col("account"), symbol=F.col("ticker"))


def parts(codes, ready: Callable[[], DataFrame], done: Callable[[], DataFrame], ended: Callable[[], DataFrame], held: Callable[[], DataFrame] | None = None) -> list[DataFrame]:
    """Findings that may hold the wanted codes; only what these need is asked for. `held` are the holders at splits, if they are known already."""
    found = []
    wants = lambda *names: not set(names).isdisjoint(codes)
    if wants("UNKNOWN_ACCOUNT_TYPE"):
        found.append(unknown_accounts(ready()))
    if wants("SETTLE_BEFORE_TRADE", "FXT_AMOUNT_INCONSISTENT", "AMBIGUOUS_FEE_CONVENTION"):
        found.append(row_findings(ready()))
    if wants("TRANSFER_UNPAIRED"):
        found.append(lone_legs(ready()))
    if wants("OVERSELL", "ROC_EXCEEDS_ACB", "INCOME_WITHOUT_POSITION", "DUPLICATE_SPLIT", "SPLIT_WITHOUT_POSITION"):
        found.append(pool_findings(done()))
    if wants("CASH_NEGATIVE"):
        found.append(cash_negative(ready()))
    if wants("NEGATIVE_FINAL_POSITION"):
        found.append(negative_endings(ended()))
    if wants("SPLIT_SCOPE_MISMATCH"):
        found.append(split_mismatches(ready(), held() if held else holders(ready(), done())))
    if wants("MIXED_CURRENCY"):
        found.append(mixed_currencies(ready()))
    if wants("SETTLE_LAG_OUTLIER"):
        found.append(lag_outliers(ready()))
    if wants("SUPERFICIAL_LOSS_SUSPECT"):
        found.append(superficial_losses(ready(), done()))
    return found


def once(found: list[DataFrame]) -> DataFrame:
    """Findings once per code, row and pool: the one that is raised first."""
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    rest = [c for c in COLUMNS if c not in ("code", "txn_id", "pool")]
    return every.groupBy("code", "txn_id", "pool").agg(F.min_by(F.struct(*rest), F.struct("turn", "scope")).alias("f")).select(*[F.col(c) if c in ("code", "txn_id", "pool") else F.col(f"f.{c}") for c in COLUMNS])


def findings(ready: DataFrame, done: DataFrame, ended: DataFrame, codes=None) -> DataFrame:
    """All findings, or those of some codes. `done` and `ended` are the replay's steps and endings of `ready`."""
    found = once(parts(CODES if codes is None else codes, lambda: ready, lambda: done, lambda: ended))
    return found if codes is None else found.where(F.col("code").isin(list(codes)))


def from_brief(codes, ready: Callable[[], DataFrame], brief: Callable[[], DataFrame]) -> DataFrame:
    """Findings of some codes from the replay's brief."""
    codes_of = F.when(F.col("kind") == 0, F.array("code")).otherwise(F.array().cast("array<string>")).alias("codes")
    done = lambda: brief().where((F.col("kind") == 3) | (F.col("kind") == 0) & F.col("code").isin(list(codes))).select("txn_id", "scope", "pool", "symbol", "value", codes_of, F.when(F.col("kind") == 3, F.col("value")).alias("delta_cad"))
    ended = lambda: brief().where("kind = 1").select("scope", "pool", "symbol", F.col("value").alias("units"))
    held = lambda: brief().where("kind = 2").select("symbol", F.col("pool").alias("account"), F.date_from_unix_date("day").alias("day"))
    found, *rest = parts(codes, ready, done, ended, held)  # the brief has each code once a row and pool, and the other parts make no others
    for part in rest:
        found = found.unionByName(part)
    return found.where(F.col("code").isin(list(codes)))


def flags(found: DataFrame) -> DataFrame:
    """txn_id, flags: the codes of each row, comma-joined in the order in which they are raised."""
    once = found.where("txn_id is not null").groupBy("txn_id", "code").agg(F.min(F.struct("turn", "scope")).alias("at"))
    return once.groupBy("txn_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), ",").alias("flags"))


def flag_counts(flagged: DataFrame) -> DataFrame:
    """flag, n: how many rows carry each code."""
    return flagged.select(F.explode(F.split("flags", ",")).alias("flag")).where("flag <> ''").groupBy("flag").agg(F.count("*").alias("n"))


def heard(found: DataFrame, ready: DataFrame, accounts: list[str] = (), symbols: list[str] = ()) -> DataFrame:
    """Findings without those of ignored accounts and symbols; where a finding names none, its row's count."""
    rows = ready.select("txn_id", F.col("account").alias("of_account"), F.coalesce("symbol", "ticker").alias("of_symbol"))
    named = found.join(rows, "txn_id", "left")
    out = lambda c, of, names: F.upper(F.coalesce(c, of, F.lit(""))).isin([n.upper() for n in names]) if names else F.lit(False)
    return named.where(~(out("account", "of_account", accounts) | out("symbol", "of_symbol", symbols))).select(*found.columns)


#: The checks in the order in which they are reported, what they become when they find something, and their codes.
CHECKS = {
    "account-types": ("FAIL", ["UNKNOWN_ACCOUNT_TYPE"]),
    "unit-balances": ("FAIL", ["OVERSELL", "NEGATIVE_FINAL_POSITION"]),
    "cash-balances": ("FAIL", ["CASH_NEGATIVE"]),
    "conversion-arithmetic": ("FAIL", ["FXT_AMOUNT_INCONSISTENT"]),
    "currency-consistency": ("FAIL", ["MIXED_CURRENCY"]),
    "split-coverage": ("FAIL", ["SPLIT_SCOPE_MISMATCH", "DUPLICATE_SPLIT"]),
    "income-sanity": ("WARN", ["INCOME_WITHOUT_POSITION", "ROC_EXCEEDS_ACB"]),
    "fee-conventions": ("WARN", ["AMBIGUOUS_FEE_CONVENTION"]),
    "settlement-dates": ("WARN", ["SETTLE_BEFORE_TRADE", "SETTLE_LAG_OUTLIER"]),
    "transfers": ("WARN", ["TRANSFER_UNPAIRED"]),
}


#: All codes that findings may have.
CODES = [*(c for _, codes in CHECKS.values() for c in codes), "SPLIT_WITHOUT_POSITION", "SUPERFICIAL_LOSS_SUSPECT"]


def check_findings(found: DataFrame, disabled: list[str] = ()) -> DataFrame:
    """slug, subject, detail, txn_ids: what each check reports.

    Only account pools count where a code is raised at three grains; an oversell
    says which wider grain is short too, and a negative ending that an oversell
    of the same account and symbol explains is left out. Currencies are reported
    by symbol and missing splits by symbol and day, with their rows or accounts.
    """
    unknown = sorted(set(disabled) - set(CHECKS))
    if unknown:
        raise ValueError(f"no such check: {', '.join(unknown)}; there are {', '.join(CHECKS)}")
    slug = F.create_map(*[F.lit(x) for name, (_, codes) in CHECKS.items() for c in codes for x in (c, name)])[F.col("code")]
    own = found.withColumn("slug", slug).where(F.col("slug").isNotNull() & ~F.coalesce(F.col("slug").isin(list(disabled)), F.lit(False)))
    widest = found.where("code = 'OVERSELL'").groupBy("txn_id").agg(F.max("scope").alias("widest"))
    over = own.where("code = 'OVERSELL' and scope = 0").select("symbol", "account").distinct()
    low = own.where("code = 'NEGATIVE_FINAL_POSITION' and scope = 0").join(over, ["symbol", "account"], "left_anti").select(*own.columns)
    rest = own.where("code <> 'NEGATIVE_FINAL_POSITION' and coalesce(scope, 0) = 0 and code not in ('MIXED_CURRENCY', 'SPLIT_SCOPE_MISMATCH')").unionByName(low)
    where = F.element_at(F.array(F.lit("; short in this account only"), F.lit("; short in the account type too"), F.lit("; missing from the whole ledger")), F.col("widest") + 1)
    single = rest.join(widest, "txn_id", "left").select("slug", F.coalesce("symbol", "account", F.lit("")).alias("subject"), F.concat("detail", F.when(F.col("code") == "OVERSELL", where).otherwise("")).alias("detail"), F.when(F.col("txn_id").isNotNull(), F.array("txn_id")).otherwise(F.array().cast("array<bigint>")).alias("txn_ids"))
    mixed = own.where("code = 'MIXED_CURRENCY'").groupBy("slug", F.col("symbol").alias("subject")).agg(F.concat_ws(", ", F.sort_array(F.collect_set("detail"))).alias("detail"), F.sort_array(F.collect_list("txn_id")).alias("txn_ids"))
    split = own.where("code = 'SPLIT_SCOPE_MISMATCH'").groupBy("slug", F.col("symbol").alias("subject"), "as_of").agg(F.concat_ws(", ", F.sort_array(F.collect_set("account"))).alias("accounts"))
    split = split.select("slug", "subject", F.format_string("split of %s missing in %s", F.col("as_of").cast("string"), "accounts").alias("detail"), F.array().cast("array<bigint>").alias("txn_ids"))
    return single.unionByName(mixed).unionByName(split)


def checks(found: DataFrame, disabled: list[str] = ()) -> DataFrame:
    """slug, status, findings, subjects: a row per check in the order of CHECKS; OK where nothing is found."""
    spark = found.sparkSession
    reported = check_findings(found, disabled).groupBy("slug").agg(F.count("*").alias("findings"), F.countDistinct("subject").alias("subjects"))
    names = [(i, slug, status) for i, (slug, (status, _)) in enumerate(CHECKS.items()) if slug not in disabled]
    every = spark.createDataFrame(names, "place int, slug string, bad string").join(reported, "slug", "left")
    n = F.coalesce("findings", F.lit(0))
    return every.orderBy("place").select("slug", F.when(n == 0, "OK").otherwise(F.col("bad")).alias("status"), n.alias("findings"), F.coalesce("subjects", F.lit(0)).alias("subjects"))


def check_counts(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("status") == "FAIL").alias("failed"), F.count_if(F.col("status") == "WARN").alias("warnings"))


def in_order(found: DataFrame) -> DataFrame:
    """Findings by row, then pool; those without a row first."""
    return found.orderBy(F.coalesce("txn_id", F.lit(0)), F.coalesce("pool", F.lit("")), "code")

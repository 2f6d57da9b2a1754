"""The whole ledger replayed: units, cost base and gain at three grains, in two currencies.

Every row is applied to its account, its account type and the whole ledger. What
a row needs beside the running state is joined to it first: its symbol, its rate,
what it cost, and the transfer leg it belongs to. Then rows are dealt by symbol
and sorted inside their partitions, and each task streams through them with the
states of one symbol's pools.

Two things would tie symbols, or the parts of one, to each other. A transfer into
another symbol needs what its out leg carried: such legs are worked out first, in
waves, each taking the lanes as far as the legs known so far allow. And a symbol
with very many rows is cut into segments; how, `segments` says.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import matching
from ledgerloom.operators.fold import intraday
from ledgerloom.sources.scratch import release, stored

SCOPES = ("acct", "type", "all")
#: What counts as no units, and for how many days after the last units income is still expected.
DUST = Decimal("1e-9")
TAIL_DAYS = 60
MONEY = "decimal(30,10)"
SEGMENT = 200_000  # rows of a symbol from which it is cut


def loaded(rows: DataFrame) -> DataFrame:
    """Rows of known actions, with defaults: CAD for other currencies, the trade day for a missing settlement, zero for missing figures.

    A missing account is the account without a name, and a missing type is UNKNOWN.
    """
    known = rows.where(F.col("action").isin(S.ACTIONS))
    number = lambda c: F.coalesce(F.col(c).cast(MONEY), F.lit(0).cast(MONEY)).alias(c)
    return known.select(
        "txn_id", "txn_date", F.coalesce("settle_date", "txn_date").alias("settle_date"), "action",
        F.when(F.col("currency").isin(S.CURRENCIES), F.col("currency")).otherwise("CAD").alias("currency"),
        F.upper(F.trim("ticker")).alias("ticker"), F.coalesce("account", F.lit("")).alias("account"), F.coalesce("acct_type", F.lit("UNKNOWN")).alias("acct_type"),
        *map(number, ("amount", "price", "units", "fee")),
    )


def account_facts(rows: DataFrame, configured: dict[str, str] | None = None) -> DataFrame:
    """account, fee_sign, convention, near_even: which sign a charge has, and whether amounts hold the fee.

    Votes of trades with a fee decide; without a usable vote the fee is outside
    the amount, and of equally many votes those count that came first by
    (txn_date, txn_id). `near_even` marks a winner of under six tenths of the
    votes. `configured` maps accounts to INCLUDED or EXCLUDED and leaves no vote.

    Votes hang on the sign and the sign on all rows, so both signs' votes are
    counted at once: the rows are read a single time, and no account is a task.
    """
    # figures once a row as doubles, as in `S.fee_fits`; both signs' votes are told from them
    plain = rows.select("account", "txn_date", "txn_id", F.col("action") == "BUY", F.signum("fee"), F.abs(F.col("price") * F.col("units")).cast("double"), F.abs("amount").cast("double"), F.col("fee").cast("double"), 0.01 + 0.005 * F.abs("units").cast("double"), F.col("action").isin("BUY", "SELL") & (F.col("fee") != 0))
    plain = plain.toDF("account", "txn_date", "txn_id", "buys", "lean", "gross", "paid", "charged", "tolerance", "votes")
    told, figures, votes = ["account", "lean", F.when(F.col("votes"), F.struct("txn_date", "txn_id")).alias("at")], [F.sum("lean").alias("lean")], {}
    outside = F.abs(F.col("paid") - F.col("gross")) <= F.col("tolerance")
    for sign in (1, -1):
        charged = sign * F.col("charged")
        inside = F.abs(F.col("paid") - F.when(F.col("buys"), F.col("gross") + charged).otherwise(F.col("gross") - charged)) <= F.col("tolerance")
        for name, rule in (("INCLUDED", inside & ~outside), ("EXCLUDED", outside & ~inside)):
            told.append((F.col("votes") & rule).alias(f"{name}{sign}"))
            figures += [F.count_if(f"{name}{sign}").alias(f"{name}{sign}"), F.min(F.when(F.col(f"{name}{sign}"), F.col("at"))).alias(f"{name}{sign}came")]
            votes[name, sign] = (F.col(f"{name}{sign}"), F.col(f"{name}{sign}came"))
    counted = plain.select(*told).groupBy("account").agg(*figures).withColumn("fee_sign", F.when(F.col("lean") < 0, -1).otherwise(1))
    of = lambda name, i: F.when(F.col("fee_sign") < 0, votes[name, -1][i]).otherwise(votes[name, 1][i])
    inside, outside = of("INCLUDED", 0), of("EXCLUDED", 0)
    first = (inside > outside) | ((inside == outside) & (of("INCLUDED", 1) < of("EXCLUDED", 1)))
    won = F.when(F.coalesce(first, F.lit(False)), "INCLUDED").otherwise("EXCLUDED")
    even = (inside + outside > 0) & (F.greatest(inside, outside) * 10 < (inside + outside) * 6)
    given = F.lit(None).cast("string")
    for account, convention in (configured or {}).items():
        given = F.when(F.col("account") == account, convention).otherwise(given)
    return counted.select("account", "fee_sign", F.coalesce(given, won).alias("convention"), (given.isNull() & even).alias("near_even"))


def with_trade_cash(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with commission, cost and proceeds."""
    commission = (F.col("fee") * F.col("fee_sign")).cast(MONEY)
    inside = F.col("convention") == "INCLUDED"
    paid = F.abs("amount")
    joined = rows.join(facts.select("account", "fee_sign", "convention"), "account", "left")
    return joined.select(*rows.columns, "fee_sign", commission.alias("commission"), F.when(inside, paid).otherwise(paid + commission).cast(MONEY).alias("cost"), F.when(inside, paid).otherwise(paid - commission).cast(MONEY).alias("proceeds"))


def moves_position() -> Column:
    return (F.col("units") != 0) & (F.coalesce("ticker", F.lit("")) != "")


def priced(rows: DataFrame, configured: dict[str, str] | None = None) -> DataFrame:
    """rows with defaults and what trades cost or brought: all that cash needs."""
    own = loaded(rows)
    return with_trade_cash(own, account_facts(own, configured))


def prepared(rows: DataFrame, rates: DataFrame, aliases: DataFrame, configured: dict[str, str] | None = None) -> DataFrame:
    """One row per ledger row with all that its replay needs: symbol, rate, trade cash, and its transfer pair.

    `pair` is the pair's out leg. `waits` marks in legs whose out leg came before
    them and has a symbol, so that something was carried, and out legs of such;
    `crosses` marks those whose legs differ in symbol. Rows in EUR are an error,
    since no rate of theirs is known.
    """
    own = loaded(rows)
    own = with_trade_cash(own, stored(account_facts(own, configured), "facts")).withColumn("currency", S.convertible(F.col("currency")))
    own = matching.canonical(matching.with_rates(own, rates), aliases).withColumnRenamed("canonical", "symbol")
    own = own.withColumn("symbol", F.nullif("symbol", F.lit("")))
    none = own.withColumns({"pair": F.lit(None).cast("bigint"), "waits": F.lit(False), "crosses": F.lit(False)})
    transfers = F.col("action").isin("TFR_OUT", "TFR_IN")
    if rows.where(transfers).isEmpty():
        return none
    legs = stored(own.where(transfers), "legs")
    pairs = matching.paired_transfers(legs)
    order = F.struct("txn_date", intraday(F.col("action")).alias("rank"), "txn_id")
    side = lambda name: legs.select(F.col("txn_id").alias(f"{name}_id"), F.col("symbol").alias(f"{name}_symbol"), order.alias(f"{name}_at"))
    both = pairs.join(side("out"), "out_id").join(side("in"), "in_id")
    waits = F.col("out_symbol").isNotNull() & F.col("in_symbol").isNotNull() & (F.col("out_at") < F.col("in_at"))
    marks = both.select(F.explode(F.array("out_id", "in_id")).alias("txn_id"), F.col("out_id").alias("pair"), waits.alias("waits"), (waits & (F.col("out_symbol") != F.col("in_symbol"))).alias("crosses"))
    marked = legs.join(marks, "txn_id", "left").select(*own.columns, "pair", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("waits", "crosses")])
    return none.where(~transfers).unionByName(marked)


def scoped(rows: DataFrame) -> DataFrame:
    """Every row three times: in its account, its account type and the whole ledger."""
    pools = F.array(*[F.struct(F.lit(i).alias("scope"), p.alias("pool")) for i, p in enumerate((F.col("account"), F.col("acct_type"), F.lit("ALL")))])
    return rows.withColumn("p", F.explode(pools)).select(*rows.columns, "p.scope", "p.pool")


class Pool:
    """The running state of one symbol in one pool."""

    __slots__ = ("units", "cad", "usd", "gain_cad", "gain_usd", "currency", "held_on", "splits", "oversold")

    def __init__(self, zero):
        self.units = self.cad = self.usd = self.gain_cad = self.gain_usd = zero
        self.currency = self.held_on = None
        self.splits: set = set()
        self.oversold = 0

    def take(self, units, zero, one):
        """Units leave with their share of the cost; all of it where more leave than are held."""
        share = one if self.units <= zero or units > self.units else units / self.units
        cad, usd = self.cad * share, self.usd * share
        self.units, self.cad, self.usd = self.units - units, self.cad - cad, self.usd - usd
        return cad, usd

    def settle_dust(self, zero, dust) -> None:
        if self.units != zero and abs(self.units) < dust:
            self.gain_cad, self.gain_usd = self.gain_cad - self.cad, self.gain_usd - self.usd
            self.units = self.cad = self.usd = zero

    def orphaned(self, day, zero) -> bool:
        """Days are dates, or their numbers."""
        gap = None if self.held_on is None else day - self.held_on
        return self.units == zero and (gap is None or (gap if isinstance(gap, int) else gap.days) > TAIL_DAYS)


class Row:
    """A dealt row; figures are decimals or floats."""

    __slots__ = ("symbol", "txn_id", "txn_date", "action", "currency", "pair", "waits", "crosses", "moved", "account", "acct_type", "units", "price", "amount", "cost", "proceeds", "rate", "repeated")

    def pools(self) -> tuple:
        return ((0, self.account), (1, self.acct_type), (2, "ALL"))


def apply(pool: Pool, row: Row, scope: int, carried: dict, zero, one, dust) -> tuple[list[str], object]:
    """One row on one pool: the codes it raises, and the figure that goes with them."""
    codes, value = [], None
    pool.currency = pool.currency or row.currency
    usd, held_before = row.currency == "USD", pool.units > zero
    cad = (lambda x: x) if row.currency == "CAD" else (lambda x: x * row.rate)
    size = abs(row.units)
    if row.action == "BUY":
        pool.units, pool.cad = pool.units + size, pool.cad + cad(row.cost)
        pool.usd += row.cost if usd else zero
    elif row.action == "SELL":
        if pool.units <= zero or size > pool.units:
            codes.append("OVERSELL")
            value, pool.oversold = pool.units, pool.oversold + 1
        gone_cad, gone_usd = pool.take(size, zero, one)
        pool.gain_cad += cad(row.proceeds) - gone_cad
        pool.gain_usd += row.proceeds - gone_usd if usd else zero
        pool.settle_dust(zero, dust)
    elif row.action == "ROC":
        back = abs(row.amount)
        whole, native = cad(back), min(back, max(pool.usd, zero))
        off = min(whole, max(pool.cad, zero))
        pool.cad, pool.gain_cad = pool.cad - off, pool.gain_cad + whole - off
        if usd:
            pool.usd, pool.gain_usd = pool.usd - native, pool.gain_usd + back - native
        if whole > off:
            codes.append("ROC_EXCEEDS_ACB")
            value = whole - off
        if pool.orphaned(row.txn_date, zero):
            codes.append("INCOME_WITHOUT_POSITION")
    elif row.action == "SPLIT" and row.price > zero and row.units > zero:
        ratio = row.units / row.price
        again = (row.txn_date, ratio) in pool.splits if row.repeated is None else bool(row.repeated >> scope & 1)
        if again:
            codes.append("DUPLICATE_SPLIT")
        else:
            pool.splits.add((row.txn_date, ratio))
            if pool.units == zero:
                codes.append("SPLIT_WITHOUT_POSITION")
            pool.units *= ratio
    elif row.action in ("TFR_OUT", "TFR_IN") and size != zero:
        out = row.action == "TFR_OUT"
        if row.pair is None:
            pool.units += -size if out else size
            pool.settle_dust(zero, dust)
        elif out:
            carried[scope, row.pair] = pool.take(size, zero, one)
            pool.settle_dust(zero, dust)
        else:
            moved_cad, moved_usd = (row.moved[2 * scope], row.moved[2 * scope + 1]) if row.moved else carried.pop((scope, row.pair), (zero, zero))
            pool.units, pool.cad = pool.units + size, pool.cad + moved_cad
            if usd:
                pool.usd += moved_usd if moved_usd != zero else moved_cad / row.rate
    elif row.action == "DIVIDEND" and pool.orphaned(row.txn_date, zero):
        codes.append("INCOME_WITHOUT_POSITION")
    if held_before or pool.units > zero:
        pool.held_on = row.txn_date
    return codes, value


FIGURES = ("units", "acb_cad", "acb_usd", "delta_cad", "delta_usd", "gain_cad", "gain_usd")
#: Codes that only the account's own pool raises.
ACCOUNT_ONLY = {"INCOME_WITHOUT_POSITION", "DUPLICATE_SPLIT", "SPLIT_WITHOUT_POSITION"}
STEP_NAMES = ["txn_id", "scope", "pool", "symbol", "holding", *FIGURES, "codes", "value"]
END_NAMES = ["scope", "pool", "symbol", "holding", *(f for f in FIGURES if "delta" not in f), "oversold"]
#: What a task is dealt: the figures as decimals or doubles.
NUMBERS = ("units", "price", "amount", "cost", "proceeds", "rate")
DEALT = ["symbol", "txn_id", "txn_date", "action", "currency", "pair", "waits", "crosses", "moved", "account", "acct_type", *NUMBERS]


def step_shape(exact: bool) -> str:
    kind = "string" if exact else "double"
    return f"txn_id bigint, scope int, pool string, symbol string, holding string, {', '.join(f'{f} {kind}' for f in FIGURES)}, codes array<string>, value {kind}"


def end_shape(exact: bool) -> str:
    kind = "string" if exact else "double"
    return f"scope int, pool string, symbol string, holding string, {', '.join(f'{f} {kind}' for f in END_NAMES[4:-1])}, oversold bigint"


def numbers(exact: bool) -> tuple:
    """zero, one, dust, a number from text, and what is written for a number."""
    return (Decimal(0), Decimal(1), DUST, Decimal, str) if exact else (0.0, 1.0, 1e-9, float, float)


def rows_of(batch: pa.RecordBatch, names: list[str], read) -> Iterator[Row]:
    """A batch's rows, column by column."""
    held = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
    for values in zip(*held, strict=True):
        row = Row()
        row.repeated = None
        for name, value in zip(names, values, strict=True):
            setattr(row, name, value)
        row.moved = row.moved and [read(x) for x in row.moved]
        yield row


def batch_of(rows: list[tuple], names: list[str], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, shape.field(n).type) for n, c in zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True)], schema=shape)


def figures(p: Pool, zero, text, before=None) -> tuple:
    """A pool's figures as they are written; without a USD holding there are no USD figures."""
    usd = p.currency == "USD"
    delta = (p.cad - before[0], p.usd - before[1] if usd else zero) if before else ()
    return tuple(map(text, (p.units, p.cad, p.usd if usd else zero, *delta, p.gain_cad, p.gain_usd if usd else zero)))


def steps_of(row: Row, pools: dict, carried: dict, kit: tuple) -> list[tuple]:
    """A row applied to its three pools: the lines that the replay returns for it."""
    zero, one, dust, _, text = kit
    out = []
    for scope, pool in row.pools():
        p = pools.get((scope, pool))
        if p is None:
            p = pools[scope, pool] = Pool(zero)
        before = (p.cad, p.usd)
        codes, value = apply(p, row, scope, carried, zero, one, dust)
        codes = [c for c in codes if scope == 0 or c not in ACCOUNT_ONLY]
        out.append((row.txn_id, scope, pool, row.symbol, p.currency, *figures(p, zero, text, before), codes, None if value is None else text(value)))
    return out


def ends_of(symbol, pools: dict, kit: tuple) -> list[tuple]:
    return [(scope, pool, symbol, p.currency, *figures(p, kit[0], kit[4]), p.oversold) for (scope, pool), p in pools.items()]


#: What the walk of a whole symbol reads: days as numbers, figures as text or doubles, and only those that the row's action uses.
LEAN = ["symbol", "txn_id", "day", "action", "currency", "pair", "waits", "crosses", "moved", "account", "acct_type", "units", "paid", "price", "rate"]
#: A row's figures in the three scopes as doubles, by `master`'s names.
WIDE = [f"{s}_{f}" for s in SCOPES for f in ("units", "acb", "acb_usd", "delta", "delta_usd", "gain", "gain_usd")]
#: What findings need of a replay: codes that were raised (kind 0), endings below zero (1), accounts that hold a symbol when the first split of a day comes (2), and taxable sales that may have lost (3).
BRIEF_NAMES = ["kind", "txn_id", "scope", "pool", "symbol", "day", "code", "value"]
BRIEF = "kind int, txn_id bigint, scope int, pool string, symbol string, day int, code string, value string"


class Lane:
    """The running state of one symbol."""

    __slots__ = ("symbol", "accounts", "types", "whole", "carried", "asked", "closed", "last")

    def __init__(self, symbol, zero):
        self.symbol, self.accounts, self.types, self.whole, self.carried = symbol, {}, {}, Pool(zero), {}
        self.asked, self.closed, self.last = None, False, None

    def pools(self, account, kind, zero) -> tuple:
        own, wide = self.accounts.get(account), self.types.get(kind)
        if own is None:
            own = self.accounts[account] = Pool(zero)
        if wide is None:
            wide = self.types[kind] = Pool(zero)
        return own, wide, self.whole

    def all_pools(self) -> dict:
        return {(0, a): p for a, p in self.accounts.items()} | {(1, t): p for t, p in self.types.items()} | {(2, "ALL"): self.whole}


def _listed_values(column: pa.Array) -> list:
    """A column as a list, without a detour over one Arrow scalar a value where that can be helped; numbers stay exact beside nulls."""
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_string(column.type) or pa.types.is_boolean(column.type) or not column.null_count and pa.types.is_primitive(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_integer(column.type):
        return [x if there else None for x, there in zip(column.fill_null(0).to_numpy().tolist(), column.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=True)]
    return column.to_pylist()


def _strides(batches: Iterator[pa.RecordBatch], exact: bool, partly: bool = False) -> Iterator[tuple]:
    """Rows of whole symbols applied one by one: batch (None but at its first row), the lane that ended before the row, the row's lane, its values, its pools, their costs before it, and what is raised.

    Raised are (scope, code, figure), and (None, account, None) for accounts that hold the symbol when a day's first
    split comes. Trades and dividends are applied here as `apply` would; it takes all other rows. `partly` passes over
    the rest of a symbol from an in leg on whose other leg is not known. After the last row comes its lane alone.
    """
    zero, one, dust, read, _ = numbers(exact)
    lane = None
    for batch in batches:
        fresh = batch
        held = [_listed_values(batch.column(batch.schema.get_field_index(c))) for c in LEAN]
        for values in zip(*held, strict=True):
            symbol, txn_id, day, action, currency, pair, waits, crosses, moved, account, kind, units, paid, price, rate = values
            ended = None
            if lane is None or symbol != lane.symbol:
                ended, lane = lane, Lane(symbol, zero)
            if partly:
                lane.closed = lane.closed or (action == "TFR_IN" and crosses and not moved)
                if lane.closed:
                    continue
            pools, raised = lane.pools(account, kind, zero), []
            before = [(p.cad, p.usd) for p in pools]
            if action == "BUY":
                size, paid, usd = abs(read(units)), read(paid), currency == "USD"
                cad = paid if currency == "CAD" else paid * read(rate)
                for p in pools:
                    p.currency = p.currency or currency
                    p.units += size
                    p.cad += cad
                    if usd:
                        p.usd += paid
                    if p.units > zero:
                        p.held_on = day
            elif action == "SELL":
                size, paid, usd = abs(read(units)), read(paid), currency == "USD"
                cad = paid if currency == "CAD" else paid * read(rate)
                for scope, p in enumerate(pools):
                    p.currency = p.currency or currency
                    had = p.units > zero
                    if not had or size > p.units:
                        raised.append((scope, "OVERSELL", p.units))
                        p.oversold += 1
                    gone_cad, gone_usd = p.take(size, zero, one)
                    p.gain_cad += cad - gone_cad
                    if usd:
                        p.gain_usd += paid - gone_usd
                    p.settle_dust(zero, dust)
                    if had or p.units > zero:
                        p.held_on = day
            elif action == "DIVIDEND":
                if pools[0].orphaned(day, zero):
                    raised.append((0, "INCOME_WITHOUT_POSITION", None))
                for p in pools:
                    p.currency = p.currency or currency
                    if p.units > zero:
                        p.held_on = day
            else:
                row = Row()
                row.symbol, row.txn_id, row.txn_date, row.action, row.currency, row.pair, row.repeated = symbol, txn_id, day, action, currency, pair, None
                row.moved = moved and [read(x) for x in moved]
                row.units, row.price, row.amount = (zero if x is None else read(x) for x in (units, price, paid))
                row.rate = None if rate is None else read(rate)
                if action == "SPLIT" and lane.asked != day:
                    lane.asked = day
                    raised += [(None, a, None) for a, p in lane.accounts.items() if float(p.units) > 0]
                for scope, p in enumerate(pools):
                    codes, value = apply(p, row, scope, lane.carried, zero, one, dust)
                    raised += [(scope, c, value) for c in codes if scope == 0 or c not in ACCOUNT_ONLY]
            yield fresh, ended, lane, values, pools, before, raised
            fresh = None
    yield None, lane, None, None, None, None, None


def _walked(exact: bool, names: list[str], shape: pa.Schema, of_row=None, of_lane=None, most: int = 20_000):
    """The walk of whole symbols: lines that `of_row` gives for a row and `of_lane` for a symbol that ended."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, ended, lane, *row in _strides(batches, exact):
            if of_lane and ended:
                out += of_lane(ended)
            if of_row and lane:
                out += of_row(lane, *row)
            if len(out) >= most:
                yield batch_of(out, names, shape)
                out = []
        yield batch_of(out, names, shape)

    return walk


def _step_lines(exact: bool):
    zero, _, _, _, text = numbers(exact)

    def lines(lane: Lane, values, pools, before, raised) -> list[tuple]:
        out = []
        for scope, (p, name, had) in enumerate(zip(pools, (values[9], values[10], "ALL"), before, strict=True)):
            own = [(c, v) for s, c, v in raised if s == scope]
            value = next((v for _, v in own if v is not None), None)
            out.append((values[1], scope, name, lane.symbol, p.currency, *figures(p, zero, text, had), [c for c, _ in own], None if value is None else text(value)))
        return out

    return lines


def _brief_lines(exact: bool):
    zero, one, _, read, _ = numbers(exact)

    def of_row(lane: Lane, values, pools, before, raised) -> list[tuple]:
        out = []
        names = (values[9], values[10], "ALL")
        for scope, code, value in raised:
            if scope is None:
                out.append((2, None, 0, code, lane.symbol, values[2], None, None))
            elif not any(s is not None and s < scope and c == code and names[s] == names[scope] for s, c, _ in raised):  # once a pool's name
                out.append((0, values[1], scope, names[scope], lane.symbol, values[2], code, None if value is None else str(value)))
        if values[3] == "SELL":
            out += tied(lane, values, pools, names, raised)
        if values[3] == "SELL" and values[10] in S.TAXABLE:
            got, delta = read(values[12]) * (one if values[4] == "CAD" else read(values[14])), pools[0].cad - before[0][0]
            if float(got + delta) < 0.01 + 1e-9 * abs(float(got)):
                out.append((3, values[1], 0, values[9], lane.symbol, values[2], None, str(delta)))
        return out

    def tied(lane: Lane, values, pools, names, raised) -> list[tuple]:
        """Sales of one id and day have no order among them, so each counts as the last of them: an earlier one may be short for a later one's sake."""
        at, size, out = (values[2], values[1]), abs(read(values[11])), []
        if lane.last is None or lane.last[0] != at:
            lane.last = (at, [])
        for scope, p in enumerate(pools):
            for other in lane.last[1]:
                if other[0] is p:
                    other[1] -= size
                    if not other[3] and (other[1] <= zero or other[2] > other[1]):
                        other[3] = True
                        out.append((0, values[1], scope, names[scope], lane.symbol, values[2], "OVERSELL", str(other[1])))
        lane.last[1].extend([p, p.units + size, size, any(s == scope and c == "OVERSELL" for s, c, _ in raised)] for scope, p in enumerate(pools))
        return out

    def of_lane(lane: Lane) -> list[tuple]:
        low = [(scope, pool, p.units) for (scope, pool), p in lane.all_pools().items() if float(p.units) < -1e-9]
        first = {pool: scope for scope, pool, _ in reversed(low)}
        return [(1, None, scope, pool, lane.symbol, None, None, str(units)) for scope, pool, units in low if first[pool] == scope]

    return of_row, of_lane


def _wide_figures(pools, before) -> list:
    """A row's figures in WIDE's order; without a USD holding there are no USD figures."""
    out = []
    for p, had in zip(pools, before, strict=True):
        usd = p.currency == "USD"
        out += [float(p.units), float(p.cad), float(p.usd) if usd else 0.0, float(p.cad - had[0]), float(p.usd - had[1]) if usd else 0.0, float(p.gain_cad), float(p.gain_usd) if usd else 0.0]
    return out


def _framed(kept: list[str]):
    """Rows as they came, columns of `kept`, with their figures in all scopes."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []

        def done() -> pa.RecordBatch:
            columns = [pa.array(c, pa.float64()) for c in (zip(*found, strict=True) if found else [[]] * len(WIDE))]
            return pa.RecordBatch.from_arrays([*[now.column(now.schema.get_field_index(c)) for c in kept], *columns], [*kept, *WIDE])

        for fresh, _, lane, _, pools, before, _ in _strides(batches, True):
            if fresh is not None:
                if now is not None:
                    yield done()
                now, found = fresh, []
            if lane is not None:
                found.append(_wide_figures(pools, before))
        if now is not None:
            yield done()

    return walk


def _summed_up():
    """Of each symbol the figures after its last row by (day, txn_id)."""

    def of_row(lane: Lane, values, pools, before, _) -> list[tuple]:
        if lane.last is None or (values[2], values[1]) >= lane.last[0]:
            usd = values[4] == "USD"
            lane.last = ((values[2], values[1]), usd, [(p.units, p.cad, p.usd, p.gain_cad, p.gain_usd, p.currency) for p in pools])
        return []

    def of_lane(lane: Lane) -> list[tuple]:
        _, usd, pools = lane.last
        out = [lane.symbol]
        for units, cad, native, gain, gain_native, currency in pools:
            own = currency == "USD"
            out += [float(units), float(cad), (float(native) if own else 0.0) if usd else None, float(gain), (float(gain_native) if own else 0.0) if usd else None]
        return [tuple(out)]

    return of_row, of_lane


LEGS = "pair bigint, moved array<string>"


def _legs(exact: bool):
    """What crossing out legs carry, as far as a symbol's rows can be applied: up to the first in leg whose other leg is not known."""
    zero, _, _, _, _ = numbers(exact)

    def legs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, _, lane, values, *_ in _strides(batches, exact, partly=True):
            if lane is not None and values[3] == "TFR_OUT" and values[7]:
                out.append((values[5], [repr(x) if not exact else str(x) for scope in range(3) for x in lane.carried.pop((scope, values[5]), (zero, zero))]))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.list_(pa.string()))], ["pair", "moved"])

    return legs


def lean_rows(ready: DataFrame, exact: bool, more: list[str] = ()) -> DataFrame:
    """The rows that have a symbol, with what the walk of whole symbols reads, and columns of `more`."""
    figure = lambda c: F.col(c).cast(MONEY).cast("string") if exact else F.col(c).cast("double")
    action = F.col("action")
    taken = {
        "day": F.unix_date("txn_date"), "moved": F.lit(None).cast("array<string>"), "units": F.when(action.isin("BUY", "SELL", "SPLIT", "TFR_IN", "TFR_OUT"), figure("units")),
        "paid": F.when(action == "BUY", figure("cost")).when(action == "SELL", figure("proceeds")).when(action == "ROC", figure("amount")),
        "price": F.when(action == "SPLIT", figure("price")), "rate": F.when(F.col("currency") != "CAD", figure("rate")),
    }
    return ready.where("symbol is not null").select(*[taken.get(c, F.col(c)).alias(c) for c in LEAN], intraday(action).alias("rank"), *more)


def in_lanes(rows: DataFrame) -> DataFrame:
    return rows.repartition("symbol").sortWithinPartitions("symbol", "day", "rank", "txn_id", "account", "units", "paid").drop("rank")


def dealt_rows(ready: DataFrame, exact: bool) -> DataFrame:
    """The rows that have a symbol, with what the walk reads; figures as decimals or doubles."""
    kind = MONEY if exact else "double"
    rows = ready.where("symbol is not null").withColumn("rank", intraday(F.col("action")))
    taken = [c for c in DEALT if c not in (*NUMBERS, "moved")]
    return rows.select(*taken, "rank", F.lit(None).cast("array<string>").alias("moved"), *[F.col(c).cast(kind).alias(c) for c in NUMBERS])


def by_symbol(rows: DataFrame) -> DataFrame:
    return rows.repartition("symbol").sortWithinPartitions("symbol", "txn_date", "rank", "txn_id").select(DEALT)


def with_moved(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """Crossing in legs get what their out legs carried, as far as it is known; other rows don't move for it."""
    if known is None:
        return rows
    waiting = (F.col("action") == "TFR_IN") & F.col("crosses")
    got = rows.where(waiting).drop("moved").join(known, "pair", "left").select(rows.columns)
    return rows.where(~waiting).unionByName(got)


def crossing_legs(rows: DataFrame, exact: bool, walked: DataFrame | None = None, also=None) -> DataFrame | None:
    """pair, moved: what each leg between two symbols carries, in waves as long as the longest chain of such legs.

    A wave walks the symbols that have an out leg not known yet, up to the first
    in leg that has to wait. Legs that are known once stay so. `walked` are the
    rows that are walked, if not all, and `also` says how the legs of the others,
    which are cut into segments, are found from what is known.
    """
    wanted = rows.where("action = 'TFR_OUT' and crosses").select("pair", "symbol")
    if wanted.isEmpty():
        return None
    wanted, known, had = stored(wanted, "crossing"), None, 0
    walked = rows if walked is None else walked
    tied = stored(walked.join(wanted.select("symbol").distinct(), "symbol", "left_semi").select(walked.columns), "tied")  # every wave reads these
    while True:
        left = wanted if known is None else wanted.join(known, "pair", "left_anti")
        again = tied.join(left.select("symbol").distinct(), "symbol", "left_semi").select(tied.columns)
        found = in_lanes(with_moved(again, known)).mapInArrow(_legs(exact), LEGS)
        for more in ([also(known)] if also is not None else []) + ([known] if known is not None else []):
            found = found.unionByName(more)
        last, known = known, stored(found.dropDuplicates(["pair"]), "carried")
        release(last)
        last, had = had, known.count()
        if had == last or wanted.join(known, "pair", "left_anti").isEmpty():
            release(wanted, tied)
            return known


class _Parts:
    """The lanes that are walked whole, what legs between symbols carry, and the symbols that are cut."""

    def __init__(self, ready: DataFrame, exact: bool, segment: int, more: list[str] = ()):
        from ledgerloom.operators import segments

        rows = lean_rows(ready, exact, more)
        lean = rows.select(*LEAN, "rank")
        many = stored(rows.groupBy("symbol").count().where(F.col("count") > segment).select("symbol"), "many")  # one symbol per `segment` rows at most
        if many.isEmpty():
            self.cut = self.heavy = None
            self.known = crossing_legs(lean, exact)
        else:
            self.heavy = ready.join(many, "symbol", "left_semi").select(ready.columns)
            self.cut = segments.Cut(dealt_rows(self.heavy, exact), exact, segment)
            rows = rows.join(many, "symbol", "left_anti").select(rows.columns)
            self.known = crossing_legs(lean, exact, rows.select(*LEAN, "rank"), self.cut.legs)
        self.lanes = in_lanes(with_moved(rows, self.known))


def _replayed(ready: DataFrame, exact: bool, final: bool, segment: int) -> DataFrame:
    parts, ddl = _Parts(ready, exact, segment), end_shape(exact) if final else step_shape(exact)
    shape, kit = pa_schema(ready, ddl), numbers(exact)
    ends = lambda lane: ends_of(lane.symbol, lane.all_pools(), kit)
    walk = _walked(exact, END_NAMES, shape, of_lane=ends) if final else _walked(exact, STEP_NAMES, shape, of_row=_step_lines(exact))
    walked = parts.lanes.mapInArrow(walk, ddl)
    if parts.cut is None:
        return walked
    return walked.unionByName(parts.cut.endings(parts.known) if final else parts.cut.steps(parts.known))


def pa_schema(df: DataFrame, shape: str) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(shape))


def steps(ready: DataFrame, *, exact: bool = True, segment: int = SEGMENT) -> DataFrame:
    """Figures of each pool after each row: three rows per ledger row with a symbol.

    Exact figures are decimals of 28 digits, as text; else doubles. `scope` is 0
    for accounts, 1 for account types, 2 for the whole ledger; `codes` are what
    the row raised there and `value` the figure that goes with them. Symbols with
    more than `segment` rows are cut, and figures then carry the rounding of the
    maps that lead to each cut.
    """
    return _replayed(ready, exact, False, segment)


def endings(ready: DataFrame, *, exact: bool = True, segment: int = SEGMENT) -> DataFrame:
    """The last figures of each symbol in each pool, and how often it was oversold there."""
    return _replayed(ready, exact, True, segment)


def brief(ready: DataFrame, *, exact: bool = True, segment: int = SEGMENT) -> DataFrame:
    """What findings need of a replay, in one walk, by kind (see BRIEF_NAMES): codes of each pool with their figures, endings below zero, holders at splits, and sales that may have lost with their costs."""
    from ledgerloom.operators import checks

    parts = _Parts(ready, exact, segment)
    of_row, of_lane = _brief_lines(exact)
    found = parts.lanes.mapInArrow(_walked(exact, BRIEF_NAMES, pa_schema(ready, BRIEF), of_row, of_lane), BRIEF)
    if parts.cut is None:
        return found
    done = stored(parts.cut.steps(parts.known), "cut")
    line = lambda d, kind, **of: d.select(*[(F.lit(kind) if c == "kind" else of.get(c, F.lit(None))).cast(t).alias(c) for c, t in (x.split() for x in BRIEF.split(", "))])
    at = {c: F.col(c) for c in ("txn_id", "scope", "pool", "symbol")}
    sales = parts.heavy.where(F.col("acct_type").isin(S.TAXABLE) & (F.col("action") == "SELL")).select("txn_id")
    first = lambda d, *keys: d.withColumn("_first", F.min("scope").over(Window.partitionBy(*keys, "pool"))).where("scope = _first")
    found = found.unionByName(line(first(done.withColumn("code", F.explode("codes")), "code", "txn_id"), 0, code=F.col("code"), value=F.col("value"), **at))
    low = first(parts.cut.endings(parts.known).where(F.col("units").cast("double") < -1e-9), "symbol")
    found = found.unionByName(line(low, 1, value=F.col("units"), **{c: at[c] for c in ("scope", "pool", "symbol")}))
    held = checks.holders(parts.heavy, done)
    found = found.unionByName(line(held, 2, scope=F.lit(0), pool=F.col("account"), symbol=F.col("symbol"), day=F.unix_date("day")))
    return found.unionByName(line(done.where("scope = 0").join(sales, "txn_id", "left_semi"), 3, value=F.col("delta_cad"), **at))


def master(ready: DataFrame, done: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """One row per ledger row: context, shared figures, and nine figures in each of three scopes; USD ones are null on CAD rows."""
    of = {"units": "units", "acb": "acb_cad", "acb_usd": "acb_usd", "delta": "delta_cad", "delta_usd": "delta_usd", "gain": "gain_cad", "gain_usd": "gain_usd"}
    wide = done.groupBy("txn_id").agg(*[F.max(F.when(F.col("scope") == i, F.col(c).cast("double"))).alias(f"{s}_{name}") for i, s in enumerate(SCOPES) for name, c in of.items()])
    return _dressed(ready.join(wide, "txn_id", "left"), flags)


#: What a master frame shows of a prepared row.
CONTEXT = ["txn_id", "txn_date", "settle_date", "action", "amount", "price", "units", "fee", "currency", "ticker", "account", "symbol", "acct_type", "rate", "fx_date", "proceeds"]


def frame(ready: DataFrame, flags: DataFrame | None = None, *, segment: int = SEGMENT) -> DataFrame:
    """The master frame in one walk: figures are put beside the rows as they pass, so that nothing is joined but the flags."""
    own = {f"of_{c}": F.col(c).alias(f"of_{c}") for c in CONTEXT}
    parts = _Parts(ready, True, segment, list(own.values()))
    kinds = {f"of_{c}": ready.schema[c].dataType.simpleString() for c in CONTEXT}
    ddl = ", ".join([f"{c} {t}" for c, t in kinds.items()] + [f"{c} double" for c in WIDE])
    rows = parts.lanes.mapInArrow(_framed(list(own)), ddl).select(*[F.col(f"of_{c}").alias(c) for c in CONTEXT], *WIDE)
    none = [F.lit(None).cast("double").alias(c) for c in WIDE]
    found = rows.unionByName(ready.where("symbol is null").select(*CONTEXT, *none))
    if parts.cut is not None:
        heavy = master(parts.heavy, stored(parts.cut.steps(parts.known), "cut"), flags)
        return _dressed(found, flags).unionByName(heavy)
    return _dressed(found, flags)


def _average(scope: str, cost: str) -> Column:
    units = F.col(f"{scope}_units")
    return F.when(units == 0, 0.0).otherwise(F.col(f"{scope}_{cost}") / F.nullif(units, F.lit(0.0)))


def _dressed(rows: DataFrame, flags: DataFrame | None) -> DataFrame:
    """A master frame of prepared rows with the figures of WIDE."""
    usd = F.col("currency") == "USD"
    number = lambda c: F.col(c).cast("double")
    native = F.when(F.col("action") == "SELL", F.col("proceeds"))
    income = F.when(F.col("action") == "DIVIDEND", F.col("amount"))
    cad = lambda c: (c * F.coalesce("rate", F.lit(1))).cast("double")
    impact = F.when(F.col("action").isin("BUY", "SELL", "ROC", "SPLIT", "TFR_IN", "TFR_OUT"), "ACB").when(F.col("action").isin("DIVIDEND", "FCH"), "INCOME").otherwise("NONE")
    if flags is not None:
        rows = rows.join(flags, "txn_id", "left")
    told = {f"{s}_{f}": F.col(f"{s}_{f}") if f[:3] != "avg" else _average(s, f"acb{f[3:]}") for s in SCOPES for f in ("units", "acb", "acb_usd", "delta", "delta_usd", "avg", "avg_usd", "gain", "gain_usd")}
    scopes = [(F.when(usd, v) if c.endswith("_usd") else v).alias(c) for c, v in told.items()]
    return rows.select(
        "txn_id", "txn_date", "settle_date", "action", *[number(c).alias(c) for c in ("amount", "price", "units", "fee")], "currency", "ticker", "account",
        "symbol", "acct_type", impact.alias("impact"), number("rate").alias("fx_rate"), "fx_date", (F.col("flags") if flags is not None else F.lit(None).cast("string")).alias("flags"),
        cad(native).alias("proceeds"), F.when(usd, native.cast("double")).alias("proceeds_usd"), cad(income).alias("dividend"), F.when(usd, income.cast("double")).alias("dividend_usd"), *scopes,
    )


def summary(frame: DataFrame) -> DataFrame:
    """A row per symbol of a master frame: the figures after its last row by (txn_date, txn_id), open positions first."""
    names = [f"{s}_{f}" for s in SCOPES for f in ("units", "acb", "acb_usd", "avg", "avg_usd", "gain", "gain_usd")]
    last = frame.where("symbol is not null").groupBy("symbol").agg(F.max_by(F.struct(*names), F.struct("txn_date", "txn_id")).alias("last")).select("symbol", "last.*")
    return _listed(last)


def _listed(last: DataFrame) -> DataFrame:
    return last.orderBy(F.coalesce(F.col("all_units"), F.lit(0.0)) == 0, "symbol")


def summarized(ready: DataFrame, *, segment: int = SEGMENT) -> DataFrame:
    """The summary in one walk that writes a row per symbol."""
    parts = _Parts(ready, True, segment)
    told = [f"{s}_{f}" for s in SCOPES for f in ("units", "acb", "acb_usd", "gain", "gain_usd")]
    ddl = ", ".join(["symbol string", *[f"{c} double" for c in told]])
    of_row, of_lane = _summed_up()
    last = parts.lanes.mapInArrow(_walked(True, ["symbol", *told], pa_schema(ready, ddl), of_row, of_lane), ddl)
    names = [f"{s}_{f}" for s in SCOPES for f in ("units", "acb", "acb_usd", "avg", "avg_usd", "gain", "gain_usd")]
    last = last.select("symbol", *[(F.when(F.col(c.replace("avg", "acb")).isNotNull(), _average(c.split("_", 1)[0], f"acb{c.split('_avg')[1]}")) if "_avg" in c else F.col(c)).alias(c) for c in names])
    if parts.cut is not None:
        last = last.unionByName(summary(master(parts.heavy, stored(parts.cut.steps(parts.known), "cut"))))
    return _listed(last)


def view(frame: DataFrame, *, pool: str | None = None, scope: str = "acct", symbol: str | None = None, since=None, until=None, income: bool = True) -> DataFrame:
    """Rows of a master frame: of a pool, a symbol, a span of trade days, with or without income rows."""
    named = {"acct": F.col("account"), "type": F.col("acct_type"), "all": F.lit("ALL")}[scope]
    for wanted, rule in ((pool, named == pool), (symbol, F.col("symbol") == symbol), (since, F.col("txn_date") >= F.lit(since)), (until, F.col("txn_date") <= F.lit(until))):
        frame = frame.where(rule) if wanted is not None else frame
    return frame if income else frame.where("impact <> 'INCOME'")


# -- cash ------------------------------------------------------------------


def cash_moves(ready: DataFrame) -> DataFrame:
    """What each row does to cash, in which currency: a row per movement, two for a conversion in one row."""
    zero = F.lit(0).cast(MONEY)
    amount, commission, action = F.col("amount"), F.col("commission"), F.col("action")
    one_row = (action == "FXT") & (F.col("price") != 0) & (F.col("units") != 0)
    move = lambda currency, cash, fees=zero: F.struct(currency.alias("of"), cash.cast(MONEY).alias("cash"), fees.cast(MONEY).alias("fees"))
    own = (
        F.when(action == "BUY", move(F.col("currency"), -F.col("cost"), commission))
        .when(action == "SELL", move(F.col("currency"), F.col("proceeds"), commission))
        .when(action.isin("DIVIDEND", "CONTRIBUTION", "WITHDRAWAL"), move(F.col("currency"), amount))
        .when(action == "FCH", move(F.col("currency"), amount, F.greatest(-amount, zero)))
        .when(one_row, move(F.lit("CAD"), amount))
        .when(action == "FXT", move(F.col("currency"), amount - commission, commission))
        .when(action.isin("TFR_IN", "TFR_OUT") & ~moves_position(), move(F.col("currency"), amount))
    )
    both = F.array_compact(F.array(own, F.when(one_row, move(F.lit("USD"), F.col("units") - commission, commission))))
    moved = ready.withColumn("m", F.explode(both))
    part = lambda a: F.when(action == a, F.abs("amount")).otherwise(zero).cast(MONEY)
    return moved.select("txn_id", "settle_date", "account", "acct_type", F.col("m.of").alias("currency"), "m.cash", "m.fees", part("CONTRIBUTION").alias("contributions"), part("WITHDRAWAL").alias("withdrawals"), F.when(action == "DIVIDEND", amount).otherwise(zero).cast(MONEY).alias("dividends"))


def cash(ready: DataFrame, ended: DataFrame | None = None) -> DataFrame:
    """scope, pool, currency with cash, contributions, withdrawals, dividends, fees and, with the fold's endings, realized gain in the holdings' own currency."""
    sums = ["cash", "contributions", "withdrawals", "dividends", "fees"]
    total = lambda c: F.sum(c).cast("decimal(38,10)").alias(c)
    by_account = cash_moves(ready).groupBy("account", "acct_type", "currency").agg(*map(total, sums))
    found = scoped(by_account).groupBy("scope", "pool", "currency").agg(*map(total, sums))
    if ended is None:
        return found
    made = realized(ended)
    none = F.lit(0).cast("decimal(38,10)")
    return found.join(made, ["scope", "pool", "currency"], "full").select("scope", "pool", "currency", *[F.coalesce(c, none).alias(c) for c in [*sums, "realized_gain"]])


def realized(ended: DataFrame) -> DataFrame:
    """Gains of the fold by pool, in the currency of each holding."""
    currency = F.when(F.col("holding") == "USD", "USD").otherwise("CAD")
    gain = F.when(F.col("holding") == "USD", F.col("gain_usd")).otherwise(F.col("gain_cad")).cast("decimal(38,10)")
    return ended.groupBy("scope", "pool", currency.alias("currency")).agg(F.sum(gain).cast("decimal(38,10)").alias("realized_gain"))


def balances(ready: DataFrame) -> DataFrame:
    """scope, pool, currency, settle_date, first_id, balance at the end of each day: days are summed by account, then by pool, before the window."""
    own = cash_moves(ready).groupBy("account", "acct_type", "currency", "settle_date").agg(F.sum("cash").alias("moved"), F.min("txn_id").alias("first_id"))
    days = scoped(own).groupBy("scope", "pool", "currency", "settle_date").agg(F.sum("moved").alias("moved"), F.min("first_id").alias("first_id"))
    until = Window.partitionBy("scope", "pool", "currency").orderBy("settle_date").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("scope", "pool", "currency", "settle_date", "first_id", F.sum("moved").over(until).cast("decimal(38,10)").alias("balance"))

"""Cut symbols and waves of transfers against the row-by-row fold of whole symbols."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import replay, segments
from ledgerloom.sources.scratch import stored

LEDGER = "txn_id bigint, txn_date date, settle_date date, action string, currency string, ticker string, account string, acct_type string, amount decimal(20,10), price decimal(20,10), units decimal(20,10), fee decimal(20,10)"
DAY = dt.date(2020, 1, 1)


def prepared(spark, rows):
    rates = spark.createDataFrame([(DAY, Decimal("1.30")), (DAY + dt.timedelta(200), Decimal("1.40"))], "fx_date date, rate decimal(20,4)")
    aliases = spark.createDataFrame([], "old string, new string, effective date")
    return stored(replay.prepared(spark.createDataFrame(rows, LEDGER), rates, aliases), "ready")


def row(n, day, action, ticker, account, units="0", amount="0", price="0", currency="CAD", fee="0"):
    on = DAY + dt.timedelta(day)
    return (n, on, on, action, currency, ticker, account, account.split("-")[-1], Decimal(amount), Decimal(price), Decimal(units), Decimal(fee))


def mixed(seed, n=170):
    """A ledger with all actions, oversells, floors, repeated splits, remainders, and transfers within and between symbols."""
    r, rows, number = random.Random(seed), [], 0
    accounts = ["A-TFSA", "B-TFSA", "C-RRSP"]
    while number < n:
        number += 1
        ticker, account, day = r.choice(["X", "X", "X", "Y"]), r.choice(accounts), r.randrange(300)
        currency, units = r.choice(["CAD", "CAD", "USD"]), r.choice(["10", "25", "7.5", "40"])
        action = r.choice(["BUY"] * 5 + ["SELL"] * 4 + ["ROC", "ROC", "SPLIT", "DIVIDEND", "TFR", "TFR", "LONE"])
        if action in ("BUY", "SELL"):
            rows.append(row(number, day, action, ticker, account, units, str(r.randrange(50, 900)), "10", currency, r.choice(["0", "1"])))
        elif action == "ROC":
            rows.append(row(number, day, action, ticker, account, "0", str(r.choice([5, 60, 900])), currency=currency))
        elif action == "SPLIT":
            rows += [row(number, day, action, ticker, account, "2", price="1"), row(number + 1, day, action, ticker, account, "2", price="1")]
            number += 1
        elif action == "DIVIDEND":
            rows.append(row(number, day, action, ticker, account, "0", "5"))
        elif action == "TFR":
            other = r.choice(["X", "Y"]), r.choice(accounts)
            rows += [row(number, day, "TFR_OUT", ticker, account, "-" + units), row(number + 1, day, "TFR_IN", other[0], other[1], units, currency=currency)]
            number += 1
        else:
            rows.append(row(number, day, "TFR_OUT", ticker, account, "-3"))
    # remainders that are swept away
    rows += [row(9001, 0, "BUY", "Z", "A-TFSA", "100", "1000", "10"), row(9002, 5, "SELL", "Z", "A-TFSA", "99.9999999999", "1200", "12"), row(9003, 6, "BUY", "Z", "A-TFSA", "50", "400", "8")]
    rows += [row(9010 + i, 7 + i, "BUY", "Z", "A-TFSA", "1", "9", "9") for i in range(12)]
    return rows


def close(a, b):
    return a == b or (a is not None and b is not None and abs(float(a) - float(b)) <= 1e-9 * max(1.0, abs(float(a))))


@pytest.mark.parametrize(("seed", "exact", "segment"), [(1, True, 9), (2, False, 40)])
def test_cut_symbols_give_the_same_figures(spark, seed, exact, segment):
    ready = prepared(spark, mixed(seed))
    key = lambda x: (x.txn_id, x.scope) if hasattr(x, "txn_id") else (x.scope, x.pool, x.symbol)
    for of in (replay.steps, replay.endings):
        whole, cut = ({key(x): x for x in of(ready, exact=exact, segment=s).collect()} for s in (10**9, segment))
        assert whole.keys() == cut.keys()
        for at, want in whole.items():
            got = cut[at]
            for name in want.__fields__:
                numeric = name in replay.FIGURES or name == "value"
                assert close(got[name], want[name]) if numeric else got[name] == want[name], (at, name, got, want)


def test_a_hot_symbol_is_cut_into_equal_tasks(spark):
    """Nine tenths of the rows, on one day and one symbol, fall into segments of about equal size."""
    rows = [row(i, 3, "BUY", "HOT", f"A{i % 7}-TFSA", "1", "10", "10") for i in range(2700)] + [row(5000 + i, i % 90, "BUY", f"T{i % 50}", "B-TFSA", "1", "10", "10") for i in range(300)]
    ready = prepared(spark, rows)
    hot = replay.dealt_rows(ready, True).where("symbol = 'HOT'")
    cut = segments.Cut(hot, True, 300)
    sizes = [r["count"] for r in cut.rows.groupBy("seg").count().collect()]
    assert sum(sizes) == 2700 and len(sizes) >= 8 and max(sizes) <= 600
    (total,) = [r for r in replay.endings(ready, segment=300).where("scope = 2 and symbol = 'HOT'").collect()]
    assert float(total.units) == 2700 and float(total.acb_cad) == 27000


def test_journals_between_symbols_go_in_waves(spark):
    """A chain of 29 journals between 30 symbols: thirty lanes, and the cost arrives at the end."""
    rows = [row(1, 0, "BUY", "S0", "A-TFSA", "100", "1000", "10")]
    for i in range(29):
        rows += [row(2 * i + 2, i + 1, "TFR_OUT", f"S{i}", "A-TFSA", "-100"), row(2 * i + 3, i + 1, "TFR_IN", f"S{i + 1}", "A-TFSA", "100")]
    ready = prepared(spark, rows)
    ended = {r.symbol: r for r in replay.endings(ready).where("scope = 0").collect()}
    assert len(ended) == 30 and float(ended["S29"].acb_cad) == 1000 and all(float(ended[f"S{i}"].units) == 0 == float(ended[f"S{i}"].acb_cad) for i in range(29))
    dealt = replay.by_symbol(replay.dealt_rows(ready, True))
    assert dealt.select("symbol").distinct().count() == 30 and "lane" not in ready.columns
    # an in leg whose out leg comes later by trade day carries nothing
    early = [row(1, 0, "BUY", "P", "A-TFSA", "10", "100", "10"), row(2, 9, "TFR_OUT", "P", "A-TFSA", "-10"), row(3, 5, "TFR_IN", "Q", "A-TFSA", "10")]
    early = [tuple(v if i != 2 or r[0] == 1 else DAY + dt.timedelta(9) for i, v in enumerate(r)) for r in early]
    (last,) = [r for r in replay.endings(prepared(spark, early)).where("scope = 0 and symbol = 'Q'").collect()]
    assert float(last.units) == 10 and float(last.acb_cad) == 0


def test_missing_accounts_and_ties_of_votes(spark):
    rows = [row(2, 0, "BUY", "X", "A-TFSA", "10", "101", "10", fee="1"), row(1, 30, "BUY", "X", "A-TFSA", "10", "100", "10", fee="1")]
    rows.append((3, DAY, None, "BUY", None, "X", None, None, Decimal(50), Decimal(10), Decimal(5), Decimal(0)))
    frame = spark.createDataFrame(rows, LEDGER)
    (fact,) = replay.account_facts(replay.loaded(frame).where("account <> ''")).collect()
    assert fact.convention == "INCLUDED" and fact.near_even  # the vote of the earlier trade, though its id is larger
    ended = {(r.scope, r.pool): float(r.acb_cad) for r in replay.endings(prepared(spark, rows)).collect()}
    assert ended[0, ""] == 50 and ended[1, "UNKNOWN"] == 50 and ended[0, "A-TFSA"] == 201 and ended[2, "ALL"] == 251


def test_curves_compose():
    kit = segments._Kit(True)
    r = random.Random(5)
    for _ in range(300):
        curve, start = kit.identity(), Decimal(r.randrange(-50, 400))
        value = start
        for _ in range(r.randrange(1, 15)):
            kind, x = r.randrange(3), Decimal(r.randrange(-20, 90))
            if kind == 0:
                curve.affine(Decimal(1), x)
                value += x
            elif kind == 1:
                part = Decimal(r.randrange(0, 5)) / 4
                curve.affine(part, Decimal(0))
                value *= part
            else:
                curve.take_off(abs(x))
                value -= min(abs(x), max(value, Decimal(0)))
        assert abs(curve(start) - value) < Decimal("1e-18")


@pytest.mark.parametrize("name", ["findings"])
def test_results_follow_their_input(spark, tmp_path, name):
    """The same folder with other rows gives another result."""
    from ledgerloom.plans import queries as plans

    sf = "/root/testdata/sf0.001"
    for t in ("orders", "lineitem", "events", "part"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(300).write.parquet(f"{tmp_path}/{t}.parquet")
    before = plans.queries()["agg_cash"](spark, str(tmp_path)).count()
    spark.read.parquet(f"{sf}/orders.parquet").limit(0).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{sf}/events.parquet").limit(0).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet(f"{sf}/lineitem.parquet").limit(0).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert before > 0 and plans.queries()["agg_cash"](spark, str(tmp_path)).count() == 0
    assert plans.queries()[name](spark, str(tmp_path)).count() == 0

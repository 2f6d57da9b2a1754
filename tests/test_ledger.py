import datetime as dt
import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import checks, findings, ingest, matching, replay
from ledgerloom.plans import queries as plans
from ledgerloom.sources.scratch import stored

SF = "/root/testdata/sf0.001"


RATES = [("2020-01-01", "1.30"), ("2021-01-01", "1.40"), ("2022-01-01", "1.35"), ("2023-01-01", "1.25")]
LEDGER = "txn_id bigint, txn_date date, settle_date date, action string, currency string, ticker string, account string, amount decimal(20,10), price decimal(20,10), units decimal(20,10), fee decimal(20,10)"
#: name: rows of (day, action, amount, units, and what differs from CAD, the name as ticker, <name>-PERSONAL, no price, no fee)
CASES = {
    "F1": [("2020-02-03", "BUY", -1000, 100, {"price": 10, "fee": 5}), ("2020-02-04", "BUY", -600, 50, {"price": 12, "fee": 5}), ("2020-02-05", "SELL", 900, -60, {"price": 15, "fee": 5})],
    "F3": [("2020-02-03", "BUY", -1000, 100, {}), ("2020-02-04", "SELL", 2250, -150, {})],
    "F4": [("2020-02-03", "BUY", -1000, 10, {"currency": "USD"}), ("2021-02-03", "BUY", -1000, 10, {"currency": "USD"})],
    "F5": [("2020-02-03", "BUY", -1000, 10, {"currency": "USD"}), ("2021-02-03", "SELL", 1000, -10, {"currency": "USD"})],
    "F7": [("2020-02-03", "BUY", -1000, 100, {}), ("2020-02-04", "ROC", 250, 0, {})],
    "F8": [("2020-02-03", "BUY", -60, 10, {}), ("2020-02-04", "ROC", 100, 0, {})],
    "F9": [("2020-02-03", "BUY", -1000, 100, {}), ("2020-02-04", "SPLIT", 0, 10, {"price": 1}), ("2020-02-04", "SPLIT", 0, 10, {"price": 1})],
    "F10": [("2020-02-03", "BUY", -10, 10, {"account": "F10A-RRSP"}), ("2020-02-03", "BUY", -20, 20, {"account": "F10B-RRSP"}), ("2020-02-04", "SPLIT", 0, 10, {"price": 1, "account": "F10A-RRSP"}), ("2020-02-04", "SPLIT", 0, 10, {"price": 1, "account": "F10B-RRSP"})],
    "F11": [("2020-02-03", "BUY", -1000, 10, {"currency": "USD"}), ("2022-02-03", "DIVIDEND", 20, 0, {"currency": "USD"})],
    "F13": [("2020-01-06", "DIVIDEND", 5, 0, {}), ("2020-02-03", "BUY", -10, 10, {}), ("2020-02-04", "SELL", 10, -10, {}), ("2020-02-23", "DIVIDEND", 5, 0, {}), ("2020-07-25", "DIVIDEND", 5, 0, {})],
    "F14": [("2020-02-03", "BUY", -1000, 100, {"account": "F14A-TFSA"}), ("2020-02-04", "SELL", 1200, -100, {"account": "F14B-TFSA"})],
    "F15": [("2020-02-03", "BUY", -1000, 100, {"account": "F15A-TFSA"}), ("2020-02-14", "TFR_OUT", 99999, -100, {"account": "F15A-TFSA"}), ("2020-02-14", "TFR_IN", -99999, 100, {"account": "F15B-TFSA"})],
    "F16": [("2023-02-03", "BUY", -1300, 103, {}), ("2023-02-14", "TFR_OUT", 0, -103, {}), ("2023-02-14", "TFR_IN", 0, 103, {"currency": "USD", "ticker": "F16.U"})],
    "F18": [("2020-02-03", "BUY", -1000, 100, {}), ("2020-02-17", "TFR_OUT", 0, -40, {}), ("2020-02-17", "TFR_IN", 0, 40, {"account": "F18B-PERSONAL"})],
    "F19": [("2020-02-03", "BUY", -1000, 100, {}), ("2020-03-19", "TFR_OUT", 0, -100, {})],
    "F20": [("2020-03-20", "TFR_OUT", -500, 0, {"account": "F20A-LIRA", "ticker": None}), ("2020-03-20", "TFR_IN", 500, 0, {"account": "F20B-LIRA", "ticker": None})],
    "F22": [("2020-02-03", "CONTRIBUTION", 1000, 0, {"ticker": None}), ("2020-02-04", "FXT", "-1000.000063", 735, {"ticker": None, "price": "1.3605442"}), ("2020-02-05", "FXT", "-0.01", 0, {"ticker": None})],
    "F25": [("2020-02-03", "FXT", -13624, 10000, {"ticker": None, "price": "1.3624", "fee": 2})],
    "F27": [("2020-02-03", "BUY", "-1004.95", 100, {"price": 10, "fee": "4.95"})],
    "F28": [("2020-02-03", "BUY", -1000, 100, {"price": 10, "fee": "-0.35"}), ("2020-02-04", "BUY", -1000, 100, {"price": 10, "fee": "-0.35"}), ("2020-02-05", "BUY", -500, 50, {"price": 10, "fee": "0.02"})],
    "F29": [("2020-02-20", "BUY", -1000, 100, {}), ("2020-03-04", "SELL", 500, -100, {}), ("2020-03-20", "BUY", -500, 100, {})],
    "F29R": [("2020-02-20", "BUY", -1000, 100, {"account": "F29-RRIF"}), ("2020-03-04", "SELL", 500, -100, {"account": "F29-RRIF"}), ("2020-03-20", "BUY", -500, 100, {"account": "F29-RRIF"})],
    "F30": [("2020-02-03", "BUY", -1000, 100, {}), ("2020-02-04", "SELL", 1200, "-99.9999999999", {})],
    "OLD": [("2020-02-03", "BUY", -50, 5, {}), ("2020-06-03", "SELL", 60, -5, {"ticker": "NEW"})],
}


@pytest.fixture(scope="module")
def cases(spark):
    """All cases in one ledger: each has its own ticker and accounts."""
    data, ids = [], {}
    for name, steps in CASES.items():
        for day, action, amount, units, more in steps:
            ids.setdefault(name, []).append(len(data) + 1)
            day = dt.date.fromisoformat(day)
            row = {"currency": "CAD", "ticker": name, "account": f"{name}-PERSONAL", "price": 0, "fee": 0} | more
            data.append((len(data) + 1, day, day, action, row["currency"], row["ticker"], row["account"], Decimal(amount), Decimal(row["price"]), Decimal(units), Decimal(row["fee"])))
    rows = spark.createDataFrame(data, LEDGER)
    rows = rows.withColumn("acct_type", S.account_type(F.col("account")))
    rates = spark.createDataFrame([(dt.date.fromisoformat(d), Decimal(r)) for d, r in RATES], "fx_date date, rate decimal(20,4)")
    aliases = spark.createDataFrame([("OLD", "NEW", dt.date(2020, 5, 1))], "old string, new string, effective date")
    ready = stored(replay.prepared(rows, rates, aliases), "ready")
    done, ended = stored(replay.steps(ready), "steps"), stored(replay.endings(ready), "endings")
    found = stored(checks.findings(ready, done, ended), "findings")
    return {"ids": ids, "ready": ready, "done": done, "ended": ended, "found": found}


def test_replay_gives_the_worked_figures(cases):
    last = {(r.scope, r.pool, r.symbol): r for r in cases["ended"].collect()}
    figure = lambda *key: tuple(float(x) for x in (last[key].units, last[key].acb_cad, last[key].acb_usd, last[key].gain_cad, last[key].gain_usd))
    own = lambda n: figure(0, f"{n}-PERSONAL", n)
    assert own("F1") == (90, 966, 0, 251, 0) and own("F3") == (-50, 0, 0, 1250, 0) and last[0, "F3-PERSONAL", "F3"].oversold == 1
    assert own("F4") == (20, 2700, 2000, 0, 0) and own("F5") == (0, 0, 0, 100, 0)
    assert own("F7") == (100, 750, 0, 0, 0) and own("F8") == (10, 0, 0, 40, 0) and own("F9") == (1000, 1000, 0, 0, 0)
    assert [figure(0, f"F10{x}-RRSP", "F10")[0] for x in "AB"] + [figure(1, "RRSP", "F10")[0]] == [100, 200, 300]
    assert own("F11")[1:3] == (1300, 1000)
    assert figure(0, "F14B-TFSA", "F14")[0] == -100 and figure(1, "TFSA", "F14") == (0, 0, 0, 200, 0)
    assert figure(0, "F15A-TFSA", "F15") == (0, 0, 0, 0, 0) and figure(0, "F15B-TFSA", "F15") == (100, 1000, 0, 0, 0) and figure(1, "TFSA", "F15") == (100, 1000, 0, 0, 0)
    assert own("F16") == (0, 0, 0, 0, 0) and figure(0, "F16-PERSONAL", "F16.U") == (103, 1300, 1040, 0, 0)
    assert own("F18") == (60, 600, 0, 0, 0) and figure(0, "F18B-PERSONAL", "F18") == (40, 400, 0, 0, 0)
    assert own("F19") == (0, 1000, 0, 0, 0)
    assert own("F27")[1] == 1004.95 and own("F28")[1] == 2500.68 and own("F30") == (0, 0, 0, 200, 0)
    assert figure(0, "OLD-PERSONAL", "NEW") == (0, 0, 0, 10, 0)


def test_findings_are_raised_where_they_should(cases):
    by = {}
    for r in cases["found"].collect():
        by.setdefault(r.code, set()).add((r.txn_id, r.scope))
    ids = lambda code: {t for t, _ in by.get(code, ())}
    at = lambda n, i: cases["ids"][n][i]
    assert ids("OVERSELL") == {at("F3", 1), at("F14", 1)} and (at("F14", 1), 1) not in by["OVERSELL"]
    assert ids("DUPLICATE_SPLIT") == {at("F9", 2)} and ids("ROC_EXCEEDS_ACB") == {at("F8", 1)}
    assert ids("INCOME_WITHOUT_POSITION") == {at("F13", 0), at("F13", 4)}
    assert ids("TRANSFER_UNPAIRED") == {at("F19", 1)} and ids("SUPERFICIAL_LOSS_SUSPECT") == {at("F29", 1)}
    assert at("F22", 1) not in ids("CASH_NEGATIVE") and at("F22", 2) in ids("CASH_NEGATIVE")
    assert not ids("FXT_AMOUNT_INCONSISTENT") and not ids("SPLIT_WITHOUT_POSITION") and not ids("MIXED_CURRENCY")
    flags = {r.txn_id: r["flags"] for r in checks.flags(cases["found"]).collect()}
    assert flags[at("F3", 1)].split(",") == ["OVERSELL"]
    results = [(r.slug, r.status) for r in checks.checks(cases["found"]).collect()]
    assert [s for s, _ in results] == list(checks.CHECKS) and dict(results)["unit-balances"] == "FAIL" and dict(results)["transfers"] == "WARN" and dict(results)["conversion-arithmetic"] == "OK"
    with pytest.raises(ValueError):
        checks.checks(cases["found"], ["nothing"])


def test_cash_by_pool(cases):
    held = {(r.scope, r.pool, r.currency): r for r in replay.cash(cases["ready"], cases["ended"]).collect()}
    assert float(held[0, "F25-PERSONAL", "CAD"].cash) == -13624 and float(held[0, "F25-PERSONAL", "USD"].cash) == 9998
    assert (float(held[0, "F28-PERSONAL", "CAD"].cash), float(held[0, "F28-PERSONAL", "CAD"].fees)) == (-2500.68, 0.68)
    assert float(held[0, "F20A-LIRA", "CAD"].cash) == -500 and float(held[1, "LIRA", "CAD"].cash) == 0 and float(held[1, "LIRA", "CAD"].contributions) == 0
    assert float(held[0, "F7-PERSONAL", "CAD"].cash) == -1000 and float(held[0, "F1-PERSONAL", "CAD"].realized_gain) == 251


def test_master_frame(cases):
    frame = replay.master(cases["ready"], cases["done"], checks.flags(cases["found"]))
    got = {r.txn_id: r for r in frame.collect()}
    assert len(frame.columns) == 48 and len(got) == sum(map(len, CASES.values()))
    sale, dividend, cash = (got[cases["ids"][n][i]] for n, i in (("F1", 2), ("F11", 1), ("F22", 0)))
    assert (sale.proceeds, sale.acct_acb, sale.acct_delta, sale.acct_acb_usd, sale.fx_rate) == (895, 966, -644, None, None)
    assert (dividend.dividend, dividend.dividend_usd, dividend.fx_rate) == (27, 20, 1.35) and cash.acct_units is None
    top = replay.summary(frame).collect()
    assert [r.symbol for r in top if not r.all_units] == sorted(r.symbol for r in top if not r.all_units) and {r.symbol: r.all_units for r in top}["F18"] == 100


def test_import_formats_and_rejects(spark):
    names = ["Date", "action", "AMOUNT ", "$", "price", "units", "Ticker", "Note", "Fee"]
    raw = [
        ("01/15/2024", "bought", "1,000", "us$", "10", "100", "abc", "n", None),
        ("2024-02-30", " Sold", "-500", "CAD", "10", "50", "ABC", None, "1"),
        ("soon", "BUY", "1", "CAD", "1", "1", "A", None, None),
        ("2024-01-15", "deposit", "500", "c$", None, None, None, None, None),
        ("2024-01-15", "DIVIDEND", "5", "CAD", None, None, " ", None, "free"),
        ("Jan 5, 2024", "zzz", "5", "gbp", "x", "1", "a b", None, None),
    ]
    done = ingest.imported(spark.createDataFrame(raw, ", ".join(f"`{n}` string" for n in names)), spark.createDataFrame([], "txn_id bigint, txn_date string, action string, amount string, currency string, price string, units string, ticker string, account string"), keywords={"txn_date": ["date"], "currency": ["$"]}, ignored=["note", "price"], account="IB-TFSA")
    got = sorted((r.txn_date, r.action, float(r.amount), r.currency, r.account, str(r.settle_date)) for r in done.final.collect())
    assert got == [("2024-01-15", "BUY", -1000, "USD", "IB-TFSA", "2024-01-17"), ("2024-01-15", "CONTRIBUTION", 500, "CAD", "IB-TFSA", "2024-01-15"), ("2024-02-30", "SELL", 500, "CAD", "IB-TFSA", "None")]
    assert sorted(r.reasons for r in done.rejected.collect()) == ["INVALID action; INVALID currency; INVALID ticker; INVALID price", "INVALID txn_date", "MISSING ticker; NON-NUMERIC fee"]
    assert tuple(done.tally().first()) == (6, 0, 3, 0, 0, 3)


def test_merges_with_null_keys(spark):
    d = spark.createDataFrame([(1, "DIVIDEND", None, "26.88"), (2, "FCH", None, "-4.03"), (3, "DIVIDEND", "A", "1"), (4, "BUY", None, "7")], "txn_id bigint, action string, ticker string, amount string")
    got = sorted(tuple(r) for r in findings.merged_groups(d, ["ticker"], ["DIVIDEND", "FCH"], "DIVIDEND", operations={"ticker": "Z"}).collect())
    assert [(a, b, c) for a, b, c, _ in got] == [(1, "DIVIDEND", "Z"), (3, "DIVIDEND", "A"), (4, "BUY", None)] and float(got[0][3]) == 22.85


def test_changes(spark):
    rows = [(1, "2024-06-03", "BUY", "10", "CAD", "2024-06-04", 1), (2, "2024-06-03", "BUY", "20", "CAD", "2024-06-09", 0)]
    d = spark.createDataFrame(rows, "txn_id bigint, txn_date string, action string, amount string, currency string, settle_date date, settle_calculated int".replace("date date", "date string"))
    d = d.withColumn("settle_date", F.col("settle_date").cast("date"))
    after = ingest.edited(d, {"amount": ("/", 4), "action": ("=", "DIVIDEND")})
    assert [(float(r.amount), str(r.settle_date), r.settle_calculated) for r in after.orderBy("txn_id").collect()] == [(2.5, "2024-06-03", 0), (5, "2024-06-09", 0)]
    assert [r.settle_calculated for r in ingest.edited(d, {"settle_date": ("=", "2024-07-01")}).collect()] == [0, 0]
    assert {r["column"]: r["rows"] for r in ingest.changed_columns(d, after).collect()} == {"action": 2, "amount": 2, "settle_date": 1, "settle_calculated": 1}
    for bad in ({"txn_id": ("=", 3)}, {"amount": ("/", 0)}):
        with pytest.raises(ValueError):
            ingest.edited(d, bad)
    assert sorted((r.txn_id, r.amount) for r in ingest.upserted(d, spark.createDataFrame([(2, "21"), (3, "30")], "txn_id bigint, amount string"), ["txn_id"]).collect()) == [(1, "10"), (2, "21"), (3, "30")]


def test_statements_and_bank_rates(spark):
    parts = spark.createDataFrame([("ABC.B - bought 12.5 shares on 2024-01-05",), ("nothing",)], "t string").select(S.statement_parts(F.col("t")).alias("p")).select("p.*").collect()
    assert [tuple(p) for p in parts] == [("ABC.B", 12.5, "2024-01-05"), (None, None, None)]
    lines = [("2025-01-05", "1", "CAD", "TRFOUTTF", "moved"), ("x", "1", "CAD", "trfinrsp", "moved"), ("2025-01-05", "1", "CAD", "TRFIN", "Money transfer in"), ("2025-01-05", "1", "CAD", "BUY", "z")]
    d = spark.createDataFrame(lines, "date string, amount string, currency string, transaction string, description string")
    got = ingest.statement_transfers(d, S.statement_account(F.lit("/a/ws_statement_WS-TFSA_202501.csv"))).collect()
    assert [(r.action, r.account, r.outcome) for r in got] == [("TFR_OUT", "WS-TFSA", "taken"), ("TFR_IN", "WS-TFSA", "rejected"), ("TFR_IN", "WS-TFSA", "skipped")]
    text = ["TERMS", "", "\ufeffOBSERVATIONS", "date,FXAUDCAD,FXUSDCAD", "2025-08-05,1,1.3785\r", "2025-08-06,1,", "2025-08-01,1,1.3750"]
    rates = {str(r.fx_date): (float(r.usdcad), float(r.cadusd)) for r in ingest.bank_rates(spark.createDataFrame(list(enumerate(text)), "at bigint, value string")).collect()}
    assert rates == {"2025-08-05": (1.3785, round(1 / 1.3785, 10)), "2025-08-01": (1.375, round(1 / 1.375, 10))}
    held = spark.createDataFrame([(dt.date(2025, 8, 1),), (dt.date(2025, 8, 5),)], "fx_date date")
    assert [tuple(map(str, r)) for r in ingest.uncovered(held, "2025-07-30", "2025-08-04").collect()] == [("2025-07-30", "2025-07-31")]


def test_trading_days_and_settlement(spark):
    days = [dt.date(2025, 7, 24) + dt.timedelta(i) for i in range(20)]
    open_ = spark.createDataFrame([("CAD", d) for d in days if d.weekday() < 5 and d != dt.date(2025, 8, 4)], "currency string, day date")
    asked = [(1, "BUY", "CAD", "2025-08-01"), (2, "BUY", "EUR", "2025-08-18"), (3, "DIVIDEND", "CAD", "2025-08-02"), (4, "SELL", "CAD", "2025-07-24"), (5, "BUY", "CAD", "2030-01-04"), (6, "BUY", "CAD", None)]
    d = spark.createDataFrame(asked, "txn_id int, action string, currency string, day string").select("txn_id", "action", "currency", F.col("day").cast("date").alias("txn_date"))
    got = {r.txn_id: str(r.settle_date) for r in ingest.on_trading_days(d, open_).collect()}
    assert got == {1: "2025-08-05", 2: "2025-08-20", 3: "2025-08-02", 4: "2025-07-25", 5: "2030-01-07", 6: "None"}


def test_long_rename_chains(spark):
    edges = spark.createDataFrame([(f"A{i}", f"A{i + 1}", dt.date(2024, 1, 1)) for i in range(20)] + [("A3", "X", dt.date(2020, 1, 1)), ("P", "Q", dt.date(2024, 1, 1)), ("Q", "P", dt.date(2024, 1, 1))], "old string, new string, effective date")
    rows = spark.createDataFrame([(1, "A0", dt.date(2023, 1, 1)), (2, "A0", dt.date(2024, 1, 1)), (3, "P", dt.date(2023, 1, 1))], "txn_id bigint, ticker string, txn_date date")
    assert [(r.txn_id, r.canonical) for r in matching.canonical(rows, edges).orderBy("txn_id").collect()] == [(1, "A20"), (2, "A0"), (3, "Q")]
    groups = matching.families(edges).collect()
    assert {r.family for r in groups if r.ticker.startswith("A")} == {"A0"} and {r.family for r in groups} == {"A0", "P"}


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(S.account_type(F.lit("CASH-RRSP"))) == "RRSP" and get(S.account_type(F.lit("WSTFSA"))) == "TFSA" and get(S.account_type(F.lit("MYSTERY"))) == "UNKNOWN"
    assert get(S.account_type(F.lit("Questrade Non-Registered"))) == "NON_REGISTERED"
    assert get(S.quote_symbol(F.lit("BRK.B"))) == "BRK-B" and get(S.quote_symbol(F.lit("REI-UN.TO"))) == "REI-UN.TO"
    assert get(S.settle_date(F.lit("2025-08-18").cast("date"), 2)) == dt.date(2025, 8, 20)
    assert get(S.settle_date(F.lit("2025-07-24").cast("date"), 2)) == dt.date(2025, 7, 28)
    assert get(S.norm_ticker(F.lit("a b"))) is None


def test_rates_as_of(spark):
    fx = spark.createDataFrame([(dt.date(2024, 6, 26), Decimal("1.37")), (dt.date(2024, 6, 28), Decimal("1.372")), (dt.date(2024, 7, 2), Decimal("1.373"))], "fx_date date, rate decimal(20,4)")
    days = [dt.date(2024, 6, 29), dt.date(2024, 7, 1), dt.date(2020, 1, 1), dt.date(2030, 1, 1)]
    asked = spark.createDataFrame([(i, d, "USD") for i, d in enumerate(days)] + [(9, days[0], "CAD")], "txn_id int, settle_date date, currency string")
    got = {r.txn_id: r.rate for r in matching.with_rates(asked, fx).collect()}
    assert got == {0: Decimal("1.372"), 1: Decimal("1.372"), 2: Decimal("1.37"), 3: Decimal("1.373"), 9: None}


def test_transfers_pair_once(spark):
    legs = spark.createDataFrame([(1, "TFR_OUT", "A", "x", 5.0), (2, "TFR_IN", "B", "y", 5.0), (3, "TFR_IN", "A", "y", 5.0), (4, "TFR_IN", "A", "z", 6.0)], "txn_id bigint, action string, ticker string, account string, units double").withColumn("settle_date", F.lit("2024-01-01").cast("date"))
    assert [tuple(r) for r in matching.paired_transfers(legs).collect()] == [(1, 3)]


def test_splits_that_holders_lack(spark):
    r, start = random.Random(11), dt.date(2020, 1, 1)
    day = lambda: start + dt.timedelta(r.randrange(12))
    rows = [(r.choice(["BUY", "BUY", "SELL", "DIVIDEND", None]), day(), r.choice("XY"), r.choice(["a", "b", "c", None]), r.choice([1, 2, 3, None])) for _ in range(200)]
    rows += [("BUY", start, "Z", "a", 1), ("BUY", start, None, "a", 1), ("BUY", None, "X", "d", 1)]
    splits = [(r.choice("XY"), day(), r.choice("abc")) for _ in range(9)] + [("W", start, "a"), (None, start, "a"), ("X", None, "a")]
    want = set()
    for ticker, on in {(t, d) for t, d, _ in splits if t and d}:
        for account in "abcd":
            held = sum((n or 0) * {"BUY": 1, "SELL": -1}.get(kind, 0) for kind, d, t, a, n in rows if (t, a) == (ticker, account) and d and d < on)
            want |= {(ticker, on, account)} if held > 0 and (ticker, on, account) not in splits else set()
    d = spark.createDataFrame(rows, "action string, txn_date date, ticker string, account string, units int").withColumn("day", F.lit(0))
    got = matching.split_missing(d, spark.createDataFrame(splits, "ticker string, day date, account string"))
    assert len(want) >= 5 and sorted(map(tuple, got.collect())) == sorted(want)


def test_rules_in_turn(spark):
    d = spark.createDataFrame([("DIVIDEND", "a-TFSA", "T"), ("BUY", "b", "T")], "action string, account string, ticker string")
    got = findings.ruled(d, [({"account": ["contains:tfsa"]}, {"action": "FCH"}), ({"action": ["FCH"]}, {"ticker": ""}), ({"gone": ["1"]}, {"action": "X"})]).collect()
    assert [tuple(r) for r in got] == [("FCH", "a-TFSA", None), ("BUY", "b", "T")]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("orders", "lineitem", "part", "events"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_queries_match_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF)
    columns = sorted(got.columns)
    held = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in held.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in held.fetchall()]
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, map(tuple, got.select(columns).collect()))) == sorted(map(key, want))


def test_queries_without_sql(spark, monkeypatch):
    """Each runs, over one replay that they share here, and they agree with each other."""
    one = plans._Replay(spark, SF)
    found = stored(one.findings(), "findings")
    one.findings = lambda codes=checks.CODES: found.where(F.col("code").isin(list(codes)))
    monkeypatch.setattr(plans, "_Replay", lambda s, d: one)
    names = sorted(set(plans.queries()) - set(plans.oracle_sql()))
    got = {n: plans.queries()[n](spark, SF).collect() for n in names}
    every = found.collect()
    by = {}
    for r in every:
        if r.txn_id is not None:
            by.setdefault(r.txn_id, set()).add(r.code)
    assert {r.txn_id: set(r["flags"].split(",")) for r in got["flags_attach"]} == by
    assert {r.flag: r.n for r in got["agg_flags_rollup"]} == {c: sum(c in s for s in by.values()) for c in set().union(*by.values())}
    reported = {s: plans.queries()[f"chk_{s.replace('-', '_')}"](spark, SF).count() for s in checks.CHECKS}
    assert {r.slug: r.findings for r in got["chk_run"]} == reported and [r.slug for r in got["chk_run"]] == list(checks.CHECKS)
    assert tuple(got["agg_check_rollup"][0]) == tuple(sum(r.status == s for r in got["chk_run"]) for s in ("FAIL", "WARN"))
    order = [(r.txn_id or 0, r.pool or "", r.code) for r in got["sort_findings"]]
    assert order == sorted(order) and len(order) == len(every) == len(got["findings"])
    rows = {r.txn_id: r for r in one.ready.collect()}
    heard = lambda r: (r.account or (rows[r.txn_id].account if r.txn_id in rows else "")) != "B1-MARGIN" and (r.symbol or (rows[r.txn_id].symbol or rows[r.txn_id].ticker if r.txn_id in rows else "")) != "T7"
    assert len(got["filter_checks_ignore"]) == sum(map(heard, every)) < len(every)
    assert len(got["proj_master_columns"]) == len(rows) and len(got["acb_summary"]) == len({r.symbol for r in rows.values() if r.symbol})
    view = got["filter_acb_view"]
    assert view and all(r.acct_type == "TFSA" and str(r.txn_date) >= "1996-01-01" and r.impact != "INCOME" for r in view)
    assert len(got["win_acb_fold_exact"]) == 3 * sum(r.symbol is not None for r in rows.values())
    assert sum(r.n for r in got["cache_fingerprint"]) == sum(r.symbol is not None for r in rows.values())
    lost = [r for r in every if r.code == "ROC_EXCEEDS_ACB"]
    assert len(got["dx_ROC_EXCEEDS_ACB"]) == len(lost) > 0 and all(r.value > 0 and rows[r.txn_id].action == "ROC" for r in lost)
    assert got["chk_income_sanity"]


@pytest.mark.parametrize("name", ["sort_default_all", "sort_multi_all"])
def test_sorts_return_the_whole_ledger_in_order(spark, duck, name):
    got = [tuple(r) for r in plans.queries()[name](spark, SF).collect()]
    assert len(got) == plans.source.ledger(spark, SF).count() > 100 and got == duck.execute(plans.oracle_sql()[name]).fetchall()


def test_transfers_match_brute_force(spark):
    r = random.Random(3)
    legs = [(i, r.choice(["TFR_OUT", "TFR_IN"]), r.choice(["A", "B", None]), r.choice("xyz"), Decimal(r.choice([0, 0, 5, -5, 6])), Decimal(r.choice(["10.00", "-10.01", "10.02", "10.03", "99"])), dt.date(2024, 1, r.randrange(1, 4))) for i in range(300)]
    used, want = set(), []
    for i, action, ticker, account, units, amount, day in sorted(legs, key=lambda x: (x[6], x[0])):
        found = []
        for j, action_, ticker_, account_, units_, amount_, day_ in legs if action == "TFR_OUT" else ():
            if action_ != "TFR_IN" or day != day_ or j in used or bool(ticker and units) != bool(ticker_ and units_):
                continue
            if abs(abs(units) - abs(units_)) > Decimal("1e-9") if ticker and units else abs(abs(amount) - abs(amount_)) > Decimal("0.01"):
                continue
            here, same = account == account_, ticker == ticker_
            if not (ticker and units and here and same):
                found.append(((0 if same and not here else 1 if here else 2) if ticker and units else int(here), j))
        if found:
            used.add(min(found)[1])
            want.append((i, min(found)[1]))
    d = spark.createDataFrame(legs, "txn_id bigint, action string, ticker string, account string, units decimal(20,4), amount decimal(20,2), settle_date date")
    assert sorted(map(tuple, matching.paired_transfers(d).collect())) == sorted(want) and len(want) > 50


REPEATED = ["asof_alias", "mut_diff", "stmt_match", "stmt_match_whole", "sink_append", "sink_upsert", "sink_update", "sink_delete", "chk_unit_balances", "chk_fee_conventions"]


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The smallest tables with lines that share an id: every ninth line twice as it is, every seventh again on other days and at another price, and parts with numbers of six digits."""
    top = tmp_path_factory.mktemp("repeated")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_partkey", F.when(F.col("l_partkey") % 5 == 0, F.col("l_partkey") + 123_000).otherwise(F.col("l_partkey")))
    more = lines.where("l_orderkey % 7 = 0").withColumns({"l_shipdate": F.col("l_shipdate") + F.expr("interval 9 days"), "l_extendedprice": F.col("l_extendedprice") + 100})
    lines.unionByName(lines.where("l_orderkey % 9 = 0")).unionByName(more).write.parquet(f"{top}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"create view lineitem as select * from read_parquet('{top}/lineitem.parquet/*.parquet')")
    for t in ("orders", "part", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{top}/{t}.parquet")
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return str(top), c


@pytest.mark.parametrize("name", REPEATED)
def test_lines_that_share_an_id_match_sql(spark, repeated, name):
    got = plans.queries()[name](spark, repeated[0])
    columns = sorted(got.columns)
    held = repeated[1].execute(plans.oracle_sql()[name])
    names = [d[0] for d in held.description]
    want = [tuple(r[names.index(c)] for c in columns) for r in held.fetchall()]
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, map(tuple, got.select(columns).collect()))) == sorted(map(key, want)) and want


def test_an_import_writes_each_row_once(spark, tmp_path):
    """What an import keeps on disk is one table, with rows as they came only where they are rejected."""
    import os

    from ledgerloom.sources.scratch import shared_dir

    top = shared_dir(spark)
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    done = plans._import(plans.source.ledger(spark, SF).limit(400))
    (only,) = set(os.listdir(top)) - before
    held = spark.read.parquet(f"{top}/{only}")
    assert "_key" not in held.columns and held.where("reasons is null and _raw is not null").isEmpty()
    assert done.rejected.count() == held.where("reasons is not null").count() > 0 and done.final.count() > 0


def test_the_walks_of_frame_and_summary_give_what_steps_give(cases):
    whole = replay.master(cases["ready"], cases["done"])
    rows = lambda d: sorted(map(repr, map(tuple, d.collect())))
    assert rows(replay.frame(cases["ready"])) == rows(whole) and rows(replay.summarized(cases["ready"])) == rows(replay.summary(whole))
    found = checks.from_brief(checks.CODES, lambda: cases["ready"], lambda: replay.brief(cases["ready"]))
    assert rows(found.select(checks.COLUMNS)) == rows(cases["found"].select(checks.COLUMNS))

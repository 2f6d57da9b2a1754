"""Files with headers of their own, each taken once; statements; matches of lines that many rows share."""

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import ingest, matching
from ledgerloom.sources import folder

KEYWORDS = {"txn_date": ["Trade Date"], "currency": ["$"], "units": ["quantity"], "ticker": ["symbol"]}


def test_files_with_their_own_headers(spark, tmp_path):
    put = lambda name, text: (tmp_path / "in" / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    (tmp_path / "in").mkdir()
    put("IB-TFSA.csv", 'Trade Date,Action,Amount,$,Price,Quantity,Symbol,Note\n2024-01-05,BUY,"1,000",CAD,10,100,ABC,"two\nlines"\n\n2024-01-06,SELL,5\n')
    put("x.csv", "﻿account,ticker,units,price,currency,amount,action,txn_date,Symbol\nQT-RRSP,XYZ,1,2,USD,3,BUY,2024-02-01,other\n,XYZ,1,2,USD,4,BUY,2024-02-02,other\n")
    put("short.csv", "Trade Date,Action\n2024-01-05,BUY\n")
    put("empty.csv", "\n \n")
    put("latin.csv", b"Trade Date\n\xff\xfe\n")
    put("notes.txt", "not taken")
    box = folder.inbox(spark, str(tmp_path / "box"), "txn_date string, action string, amount string, currency string, units string, ticker string, account string, others map<string,string>")
    scan = lambda paths: folder.scan_ledger(spark, paths, KEYWORDS)
    first = folder.take(box, str(tmp_path / "in"), scan)
    name = lambda r: r.path.rsplit("/", 1)[1]
    got = {(name(r), r.line): (r.account, r.ticker, r.amount, r.others) for r in box.read("rows").collect()}
    assert got == {
        ("IB-TFSA.csv", 3): ("IB-TFSA", "ABC", "1,000", {"Note": "two\nlines"}),
        ("x.csv", 2): ("QT-RRSP", "XYZ", "3", {"Symbol": "other"}),
        ("x.csv", 3): ("x", "XYZ", "4", {"Symbol": "other"}),
    }
    bad = {(name(r), r.line): r.reason for r in box.read("bad").collect()}
    assert bad == {
        ("IB-TFSA.csv", 5): "3 CELLS INSTEAD OF 8",
        ("short.csv", 1): "NO COLUMN FOR amount, currency, price, units, ticker",
        ("empty.csv", 0): "EMPTY FILE",
        ("latin.csv", 0): "NOT UTF-8",
    }
    assert box.read("files").count() == 5 and folder.take(box, str(tmp_path / "in"), scan) == first  # nothing is taken twice
    put("y.csv", "account,ticker,units,price,currency,amount,action,txn_date\nA,XYZ,1,2,USD,3,BUY,2024-02-01\n")
    put("short.csv", "Trade Date,Action,Amount,$,Price,Quantity,Symbol\n2024-01-05,BUY,1,CAD,1,1,NEW\n")  # mended, so another file
    folder.take(box, str(tmp_path / "in"), scan)
    assert box.read("rows").count() == 5 and {name(r) for r in box.read("bad").collect()} == {"IB-TFSA.csv", "empty.csv", "latin.csv"}


def test_a_thousand_files(spark, tmp_path):
    heads = ["txn_date,action,amount,currency,price,units,ticker", "Symbol,Quantity,Price,$,Amount,Action,Trade Date"]
    (tmp_path / "in").mkdir()
    for i in range(1000):
        cells = ["2024-01-05", "BUY", str(i), "CAD", "1", "1", "ABC"]
        (tmp_path / "in" / f"a{i}.csv").write_text(f"{heads[i % 2]}\n{','.join(cells if i % 2 == 0 else cells[::-1])}\n")
    (tmp_path / "in" / "bad.csv").write_bytes(b"\xff")
    found = folder.scan_ledger(spark, [r.path for r in folder.listed(spark, str(tmp_path / "in")).collect()], KEYWORDS)
    total = found.agg(F.count_if(F.col("reason").isNull()).alias("rows"), F.sum(F.col("amount").cast("bigint")).alias("amount"), F.count_if(F.col("reason").isNotNull()).alias("bad")).first()
    assert tuple(total) == (1000, 999 * 500, 1)


def test_statements_from_a_folder(spark, tmp_path):
    (tmp_path / "ws_statement_WS-TFSA_202501.csv").write_text(
        "Date, Amount ,currency,transaction,description\n2025-01-08,1000.004,CAD,BUY,ABC - bought 10 shares on 2025-01-06\n2025-01-09,-50,CAD,TRFOUTTF,moved\n2025-01-09,7,CAD,TRFIN,Money transfer in\nx,9,CAD,trfinrsp,moved\n"
    )
    lines = folder.scan_statements(spark, [r.path for r in folder.listed(spark, str(tmp_path)).collect()]).where("reason is null")
    moved = ingest.statement_transfers(lines, S.statement_account(F.col("path")))
    assert sorted((r.action, r.account, r.outcome) for r in moved.collect()) == [("TFR_IN", "WS-TFSA", "rejected"), ("TFR_IN", "WS-TFSA", "skipped"), ("TFR_OUT", "WS-TFSA", "taken")]
    ledger = spark.createDataFrame([(1, "BUY", "2025-01-06", "ABC", "CAD", Decimal(-1000), Decimal(10), "2025-01-07", 1), (2, "BUY", "2025-01-06", "ABC", "CAD", Decimal(-1000), Decimal(10), "2025-01-07", 0)], "txn_id bigint, action string, txn_date string, ticker string, currency string, amount decimal(20,4), units decimal(20,4), settle_date string, settle_calculated int")
    ledger = ledger.withColumns({c: F.col(c).cast("date") for c in ("txn_date", "settle_date")})
    got = {r.txn_id: (str(r.settle_date), r.settle_calculated) for r in ingest.settled_by_statement(ledger, lines).collect()}
    assert got == {1: ("2025-01-08", 0), 2: ("2025-01-07", 0)}  # the second was told before, so it is no rival


def test_matches_where_a_day_and_ticker_are_hot(spark):
    """100,000 rows and lines of one key: each pair of different amounts meets once."""
    n = 100_000
    key = [F.lit("BUY").alias("action"), F.lit("2024-01-01").alias("txn_date"), F.lit("T").alias("ticker"), F.lit("CAD").alias("currency")]
    cents = lambda c: (c / 100).cast("decimal(20,3)")
    rows = spark.range(n).select(F.col("id").alias("txn_id"), *key, cents(F.col("id") * 3).alias("amount")).unionByName(spark.range(n).select((F.col("id") + n).alias("txn_id"), *key, F.lit(-5).cast("decimal(20,3)").alias("amount")))
    lines = spark.range(n).select(F.col("id").alias("statement_id"), *key, (cents(F.col("id") * 3) + F.lit("0.009").cast("decimal(4,3)")).alias("amount"))
    got = matching.matched_once(lines, rows).agg(F.count("*").alias("n"), F.sum(F.abs(F.col("statement_id") - F.col("txn_id"))).alias("off")).first()
    assert got.n >= n - 3 and got.off == 0
    units = spark.createDataFrame([(1, Decimal(5), Decimal(2)), (2, Decimal(5), Decimal(3)), (3, Decimal(5), None), (4, None, None)], "statement_id bigint, amount decimal(20,3), units decimal(20,3)").select("*", *key)
    held = spark.createDataFrame([(7, Decimal(-5), Decimal(2)), (8, Decimal(5), Decimal(-3))], "txn_id bigint, amount decimal(20,3), units decimal(20,3)").select("*", *key)
    assert sorted(map(tuple, matching.matched_once(units, held).collect())) == [(1, 7), (2, 8)]

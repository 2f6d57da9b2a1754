"""Committed tables, the replay kept in a store, and the ledger that follows a stream."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import incremental, replay
from ledgerloom.sources.scratch import stored
from ledgerloom.sources.tables import Shape, Store, Violation
from ledgerloom.streaming import follow
from tests.test_segments import LEDGER, mixed

DDL = "id bigint, name string, n int"


@pytest.fixture
def held(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"t": Shape(DDL, ("id",), buckets=8, rules={"n is positive": F.col("n") > 0}), "u": Shape(DDL, ("id",), buckets=4)})
    store.append("t", spark.createDataFrame([(i, f"r{i}", i + 1) for i in range(200)], DDL))
    return store


def rows(store, table="t", manifest=None):
    return {r.id: (r.name, r.n) for r in store.read(table, manifest).collect()}


def test_changes_rewrite_only_their_buckets(spark, held):
    first = held.manifest()
    assert first["version"] == 1 and len(rows(held)) == 200 and rows(held, "u") == {}
    second = held.upsert("t", spark.createDataFrame([(5, "new", 9)], DDL))
    changed = [b for b, d in second["tables"]["t"].items() if d != first["tables"]["t"][b]]
    assert len(changed) == 1 and rows(held)[5] == ("new", 9) and len(rows(held)) == 200
    assert rows(held, manifest=first)[5] == ("r5", 6)  # a reader holds to its version
    held.update("t", spark.createDataFrame([(6, 70), (999, 1)], "id bigint, n int"), ["n"])
    held.delete("t", spark.createDataFrame([(7,), (998,)], "id bigint"))
    assert rows(held)[6] == ("r6", 70) and 7 not in rows(held) and len(rows(held)) == 199
    assert held.expire(1) > 0 and len(rows(held)) == 199


def test_every_violating_row_is_named(spark, held):
    bad = spark.createDataFrame([(300, "a", 0), (None, "b", 1), (301, "c", 2), (301, "d", 3), (302, "e", None)], DDL)
    got = sorted((str(r.id), r.name, tuple(r.violations)) for r in held.violations("t", bad).collect())
    assert got == [("300", "a", ("n is positive",)), ("301", "c", ("repeated key",)), ("301", "d", ("repeated key",)), ("302", "e", ("n is positive",)), ("None", "b", ("missing key",))]
    for change in (lambda: held.append("t", spark.createDataFrame([(5, "again", 1)], DDL)), lambda: held.upsert("t", bad), lambda: held.update("t", spark.createDataFrame([(5, -1)], "id bigint, n int"), ["n"])):
        with pytest.raises(Violation):
            change()
    assert held.manifest()["version"] == 1 and rows(held)[5] == ("r5", 6)


def test_two_writers(spark, held):
    """One that is overtaken in other buckets takes the next number; one that is overtaken in its own works again."""
    own, runs = held.touched("t", spark.createDataFrame([(5,)], "id bigint")), []
    other = next(i for i in range(200) if held.touched("t", spark.createDataFrame([(i,)], "id bigint")) != own)

    def slow(meanwhile):
        def work(base):
            runs.append(base["version"])
            if len(runs) == 1:
                held.upsert("t", spark.createDataFrame([(meanwhile, "fast", 1)], DDL))
            return {"t": (own, held.read("t", base, own).withColumn("n", F.col("n") + 1000))}

        return work

    held.change(slow(other))
    assert len(runs) == 1 and rows(held)[other] == ("fast", 1) and rows(held)[5] == ("r5", 1006)
    runs.clear()
    held.change(slow(5))
    assert len(runs) == 2 and rows(held)[5] == ("fast", 1001)


RATES = [(dt.date(2020, 1, 1), Decimal("1.30")), (dt.date(2020, 7, 19), Decimal("1.40"))]


def ready(spark, data, renames=(), rates=RATES):
    aliases = spark.createDataFrame(list(renames), "old string, new string, effective date")
    return stored(replay.prepared(spark.createDataFrame(data, LEDGER), spark.createDataFrame(rates, "fx_date date, rate decimal(20,4)"), aliases), "ready")


def ends(df):
    return sorted(tuple(r) for r in df.select("symbol", "scope", "pool", "units", "acb_cad", "gain_cad").collect())


def test_only_changed_lanes_are_replayed(spark, tmp_path):
    on = lambda d: dt.date(2020, 1, 1) + dt.timedelta(d)
    line = lambda n, d, a, t, units, amount, currency="CAD", fee="0": (n, on(d), on(d), a, currency, t, f"{t}-TFSA", "TFSA", Decimal(amount), Decimal("10"), Decimal(units), Decimal(fee))
    data = [line(1, 1, "BUY", "A", "10", "100"), line(2, 9, "SELL", "A", "5", "80"), line(3, 1, "BUY", "B", "10", "100", "USD"), line(4, 220, "BUY", "C", "10", "100", "USD"), line(5, 1, "BUY", "D", "10", "100"), line(6, 5, "TFR_OUT", "D", "-10", "0"), line(7, 5, "TFR_IN", "E", "10", "0")]
    of = incremental.store(spark, str(tmp_path / "states"), 16)

    def check(now, expected, **more):
        manifest, lanes = incremental.load_or_build(of, now)
        assert sorted(r.symbol for r in lanes.collect()) == expected
        assert ends(of.read("endings", manifest)) == ends(replay.endings(now))
        assert of.read("steps", manifest).count() == replay.steps(now).count()
        return manifest

    first = check(ready(spark, data), list("ABCDE"))
    assert check(ready(spark, data[::-1]), [])["version"] == first["version"]  # order doesn't count, and nothing is written
    price = [line(1, 1, "BUY", "A", "10", "101"), *data[1:]]
    check(ready(spark, price), ["A"])
    fee = [line(1, 1, "BUY", "A", "10", "101", fee="1"), *data[1:]]
    check(ready(spark, fee), ["A"])
    moved = [*fee[:4], line(5, 1, "BUY", "D", "10", "120"), *fee[5:]]
    check(ready(spark, moved), ["D", "E"])  # the cost goes on to E
    check(ready(spark, moved, rates=[RATES[0], (RATES[1][0], Decimal("1.50"))]), ["C"])
    check(ready(spark, moved, [("B", "B2", on(300))], rates=[RATES[0], (RATES[1][0], Decimal("1.50"))]), ["B", "B2"])
    last = check(ready(spark, moved[1:]), ["A", "B", "B2", "C"])
    # damage: a bucket's folder is lost
    bucket = of.touched("steps", spark.createDataFrame([("C", 4, 0)], "symbol string, txn_id bigint, scope int"))[0]
    of.files.delete(last["tables"]["steps"][str(bucket)]["at"])
    assert of.damaged("steps", last) == [bucket]
    _, lanes = incremental.load_or_build(of, ready(spark, moved[1:]))
    assert "C" in {r.symbol for r in lanes.collect()} and ends(of.read("endings")) == ends(replay.endings(ready(spark, moved[1:]))) and of.damaged("steps", of.manifest()) == []


def test_any_split_and_order_of_files_gives_the_batch_result(spark, tmp_path):
    data = mixed(11, 60)
    want = ends(replay.endings(ready(spark, data)))
    data += data[:7]  # rows that come twice
    r = random.Random(2)
    r.shuffle(data)
    rates = spark.createDataFrame(RATES, "fx_date date, rate decimal(20,4)")
    aliases = spark.createDataFrame([], "old string, new string, effective date")
    ledger, states = follow.ledger_store(spark, str(tmp_path / "ledger"), 4), incremental.store(spark, str(tmp_path / "states"), 4)
    schema = spark.createDataFrame([], LEDGER).schema

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in/*")
        query = follow.follow(stream, ledger, states, rates, aliases, str(tmp_path / "checkpoint"))
        query.awaitTermination()

    for i, part in enumerate((data[:20], data[20:50], data[50:])):
        spark.createDataFrame(part, LEDGER).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        if i:
            run()  # the second run starts from the first one's checkpoint
    assert ends(states.read("endings")) == want
    before = ledger.manifest()
    assert follow.take(ledger, spark.createDataFrame(data[:5], LEDGER), 0) == before  # a batch that comes again

"""The replay of symbols with very many rows: segments that are worked out side by side.

The rows of such symbols are cut by ranges of (symbol, day, rank, id) into segments
of about equal size. What a segment does to a pool's units is a map a * x + b; given
the units, what it does to the cost base is a monotone map of a few straight
pieces: purchases add, sales scale, a return of capital takes off down to zero.
Transfer legs stand between such maps, as they move cost from pool to pool. So

1. each segment gives its maps of units, which are chained into the units with
   which it begins. Where remainders were swept away the chain is off by less than
   a billionth: then segments whose beginning was wrong are worked out again, until
   each begins as the one before it ended;
2. each segment gives its maps of cost and its legs, and one pass over these few
   gives the cost with which it begins, and what its legs carry;
3. each segment is replayed row by row from there, and gains are added up.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import replay
from ledgerloom.sources.scratch import release, stored

POOL = ["symbol", "scope", "pool"]


class Curve:
    """A monotone map of straight pieces: [from, slope, height] each."""

    __slots__ = ("pieces",)

    def __init__(self, pieces):
        self.pieces = pieces

    def affine(self, slope, height) -> None:
        """Then slope * x + height."""
        if slope == 0:
            self.pieces = [[self.pieces[0][0], slope, height]]
        else:
            self.pieces = [[x, a * slope, b * slope + height] for x, a, b in self.pieces]

    def take_off(self, most) -> None:
        """Then `most` less, but what is above zero doesn't fall below it, and what is below stays."""
        if not most > 0:
            return
        found = []
        for i, (x, a, b) in enumerate(self.pieces):
            end = self.pieces[i + 1][0] if i + 1 < len(self.pieces) else None
            if a == 0:
                parts = [(x, a, b if b <= 0 else max(b - most, most - most))]
            else:
                parts = []
                zero, full = -b / a, (most - b) / a
                for low, high, piece in ((None, zero, (a, b)), (zero, full, (a - a, b - b)), (full, None, (a, b - most))):
                    low = x if low is None or low < x else low
                    high = end if high is None or (end is not None and end < high) else high
                    if high is None or low < high:
                        parts.append((low, *piece))
            for part in parts:
                if not found or tuple(found[-1][1:]) != part[1:]:
                    found.append(list(part))
        self.pieces = found

    def __call__(self, value):
        for x, a, b in reversed(self.pieces):
            if value >= x:
                return a * value + b
        raise ValueError(value)


class _Kit:
    """Arithmetic of one kind, and numbers as text and back."""

    def __init__(self, exact: bool):
        self.zero, self.one, self.dust, self.read, self.out = replay.numbers(exact)
        self.low = self.read("-inf")
        self.text = str if exact else repr
        self.exact = exact

    def same(self, x, y) -> bool:
        """Whether two numbers of units are the same but for rounding; only an exact zero is zero."""
        return x == y if self.exact or y == 0 else abs(x - y) <= 1e-9 * max(1.0, abs(y))

    def identity(self) -> Curve:
        return Curve([[self.low, self.one, self.zero]])


NAMES = [*replay.DEALT, "repeated", "seg", "state_scope", "state_pool", "state"]


def _stream(batches: Iterator[pa.RecordBatch], read) -> Iterator[tuple]:
    """(symbol, segment), row, and state rows as (scope, pool, state) in the place of a row."""
    for batch in batches:
        column = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in NAMES[len(replay.DEALT) :]}
        for i, row in enumerate(replay.rows_of(batch, replay.DEALT, read)):
            row.repeated = column["repeated"][i] or 0
            state = (column["state_scope"][i], column["state_pool"][i], column["state"][i]) if column["state"][i] is not None else None
            yield (row.symbol, column["seg"][i]), row, state


UNIT_MAPS = "symbol string, seg int, scope int, pool string, a string, b string, currency string, began string, ended string"


def _table(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    return replay.batch_of(rows, shape.names, shape)


def _unit_maps(kit: _Kit, shape: pa.Schema):
    """What each segment does to the units of its pools, remainders left alone."""

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        done = lambda: _table([(*now, *key, kit.text(a), kit.text(b), currency, None, None) for key, (a, b, currency) in held.items()], shape)
        for key, row, _ in _stream(batches, kit.read):
            if key != now:
                if now:
                    yield done()
                now, held = key, {}
            size = abs(row.units)
            for scope, pool in row.pools():
                a, b, currency = held.get((scope, pool), (kit.one, kit.zero, row.currency))
                if row.action in ("BUY", "TFR_IN"):
                    b += size
                elif row.action in ("SELL", "TFR_OUT"):
                    b -= size
                elif row.action == "SPLIT" and row.price > kit.zero and row.units > kit.zero and not row.repeated >> scope & 1:
                    ratio = row.units / row.price
                    a, b = a * ratio, b * ratio
                held[scope, pool] = (a, b, currency)
        if now:
            yield done()

    return maps


def _chained(kit: _Kit):
    """The units with which each of a pool's segments begins: where it began with the same units before, its end is known, else its map gives it."""

    def chain(part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: r["seg"])
        now, currency, out = kit.zero, None, []
        for r in rows:
            currency = currency or r["currency"]
            known = r["began"] is not None and kit.same(kit.read(r["began"]), now)
            began = kit.read(r["began"]) if known else now
            now = kit.read(r["ended"]) if known else kit.read(r["a"]) * now + kit.read(r["b"])
            out.append(r | {"began": kit.text(began), "ended": r["ended"] if known else None, "currency": currency})
        return pa.Table.from_pylist(out, schema=part.schema)

    return chain


ITEMS = "symbol string, seg int, pos bigint, scope int, pool string, kind string, cad array<string>, usd array<string>, units string, ended string, currency string, held_on date, pair bigint, share string, rate string, in_usd boolean, crosses boolean, moved array<string>"


class _Part:
    """A pool within a segment: its units, and what has happened to its cost since the last leg."""

    __slots__ = ("units", "began", "currency", "held_on", "cad", "usd")

    def __init__(self, units, currency, kit: _Kit):
        self.units = self.began = units
        self.currency, self.held_on = currency, None
        self.cad, self.usd = kit.identity(), kit.identity()


def _items(kit: _Kit, shape: pa.Schema):
    """The maps of cost of each segment's pools, and the legs between them, in order."""
    zero, one, text = kit.zero, kit.one, kit.text

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, out = None, {}, []
        flat = lambda c: [text(v) for piece in c.pieces for v in piece]

        def add(key, kind, part, last=False, **more):
            row = dict.fromkeys(shape.names) | {"symbol": now[0], "seg": now[1], "pos": len(out), "scope": key[0], "pool": key[1], "kind": kind} | more
            if kind == "map":
                row |= {"cad": flat(part.cad), "usd": flat(part.usd), "units": text(part.began), "currency": part.currency, "ended": text(part.units) if last else None, "held_on": part.held_on if last else None}
                part.cad, part.usd = kit.identity(), kit.identity()
            out.append(row)

        def done() -> pa.RecordBatch:
            for key, part in parts.items():
                add(key, "map", part, True)
            return pa.RecordBatch.from_pylist(out, schema=shape)

        def leave(part: _Part, size):
            share = one if part.units <= zero or size > part.units else size / part.units
            part.units -= size
            return share

        def sweep(part: _Part) -> bool:
            if part.units != zero and abs(part.units) < kit.dust:
                part.units = zero
                part.cad.affine(zero, zero)
                part.usd.affine(zero, zero)
                return True
            return False

        for key, row, state in _stream(batches, kit.read):
            if key != now:
                if now:
                    yield done()
                now, parts, out = key, {}, []
            if state is not None:
                parts[state[:2]] = _Part(kit.read(state[2][0]), state[2][1], kit)
                continue
            usd, size = row.currency == "USD", abs(row.units)
            cad = (lambda x: x) if row.currency == "CAD" else (lambda x, rate=row.rate: x * rate)
            for at in row.pools():
                part = parts[at]
                before = part.units > zero
                if row.action == "BUY":
                    part.units += size
                    part.cad.affine(one, cad(row.cost))
                    if usd:
                        part.usd.affine(one, row.cost)
                elif row.action == "SELL":
                    share = leave(part, size)
                    part.cad.affine(one - share, zero)
                    part.usd.affine(one - share, zero)
                    sweep(part)
                elif row.action == "ROC":
                    part.cad.take_off(cad(abs(row.amount)))
                    if usd:
                        part.usd.take_off(abs(row.amount))
                elif row.action == "SPLIT" and row.price > zero and row.units > zero and not row.repeated >> at[0] & 1:
                    part.units *= row.units / row.price
                elif row.action in ("TFR_OUT", "TFR_IN") and size != zero:
                    if row.action == "TFR_IN":
                        part.units += size
                        if row.pair is not None and row.waits:
                            add(at, "map", part)
                            add(at, "in", part, pair=row.pair, in_usd=usd, rate=None if row.rate is None else text(row.rate), crosses=row.crosses)
                    elif row.pair is None:
                        part.units -= size
                    else:
                        share = leave(part, size)
                        if row.waits:
                            add(at, "map", part)
                            add(at, "out", part, pair=row.pair, share=text(share), crosses=row.crosses)
                        else:
                            part.cad.affine(one - share, zero)
                            part.usd.affine(one - share, zero)
                    if row.action == "TFR_OUT" or row.pair is None:
                        sweep(part)
                if before or part.units > zero:
                    part.held_on = row.txn_date
        if now:
            yield done()

    return items


STATES = "symbol string, seg int, scope int, pool string, state array<string>, pair bigint, moved array<string>, crosses boolean"


def _scan(kit: _Kit, shape: pa.Schema):
    """One pass over a symbol's maps and legs: the state with which each segment's pools begin, and what legs carry.

    It ends early at an in leg from another symbol that is not known yet.
    """
    zero, text = kit.zero, kit.text

    def curve(flat: list[str]) -> Curve:
        v = [kit.read(x) for x in flat]
        return Curve([list(v[i : i + 3]) for i in range(0, len(v), 3)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, seg, costs, held, seen, carried, legs, open_ = None, None, {}, {}, set(), {}, {}, True
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["symbol"] != symbol:
                    symbol, seg, costs, held, carried, legs, open_ = r["symbol"], None, {}, {}, {}, {}, True
                if r["seg"] != seg:
                    seg, seen = r["seg"], set()
                if not open_:
                    continue
                at = (r["scope"], r["pool"])
                cad, usd = costs.get(at, (zero, zero))
                if at not in seen:
                    seen.add(at)
                    out.append((symbol, seg, *at, [r["units"], text(cad), text(usd), r["currency"], str(held.get(at) or "")], None, None, None))
                if r["kind"] == "map":
                    cad, usd = curve(r["cad"])(cad), curve(r["usd"])(usd)
                    held[at] = r["held_on"] or held.get(at)
                elif r["kind"] == "out":
                    share = kit.read(r["share"])
                    moved = (cad * share, usd * share)
                    cad, usd = cad - moved[0], usd - moved[1]
                    carried[at[0], r["pair"]] = moved
                    leg = legs.setdefault(r["pair"], {})
                    leg[at[0]] = moved
                    if len(leg) == 3:
                        del legs[r["pair"]]
                        out.append((symbol, None, None, None, None, r["pair"], [text(x) for s in range(3) for x in leg[s]], r["crosses"]))
                else:
                    if r["crosses"]:
                        if not r["moved"]:
                            open_ = False
                            continue
                        moved = [kit.read(x) for x in r["moved"][2 * at[0] : 2 * at[0] + 2]]
                    else:
                        moved = carried.pop((at[0], r["pair"]), (zero, zero))
                    cad += moved[0]
                    if r["in_usd"]:
                        usd += moved[1] if moved[1] != zero else moved[0] / kit.read(r["rate"])
                costs[at] = (cad, usd)
            yield _table(out, shape)

    return scan


ENDS = "symbol string, seg int, scope int, pool string, holding string, units string, cad string, usd string, gain_cad string, gain_usd string, oversold bigint"


def _restored(state: list[str], kit: _Kit) -> replay.Pool:
    p = replay.Pool(kit.zero)
    p.units, p.cad, p.usd = map(kit.read, state[:3])
    p.currency = state[3]
    p.held_on = dt.date.fromisoformat(state[4]) if state[4] else None
    if len(state) > 5:
        p.gain_cad, p.gain_usd = map(kit.read, state[5:7])
    return p


def _replay(kit: _Kit, final: bool, shape: pa.Schema):
    """A segment's rows, from its state on."""
    tools = (kit.zero, kit.one, kit.dust, kit.read, kit.out)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pools, out = None, {}, []
        ends = lambda: [(*now, *key, p.currency, *map(kit.text, (p.units, p.cad, p.usd, p.gain_cad, p.gain_usd)), p.oversold) for key, p in pools.items()]
        for key, row, state in _stream(batches, kit.read):
            if key != now:
                out += ends() if final and now else []
                now, pools = key, {}
            if state is not None:
                pools[state[:2]] = _restored(state[2], kit)
                continue
            lines = replay.steps_of(row, pools, {}, tools)
            out += [] if final else lines
            if len(out) >= 10_000:
                yield _table(out, shape)
                out = []
        out += ends() if final and now else []
        yield _table(out, shape)

    return walk


GAINS = "symbol string, seg int, scope int, pool string, gain_cad string, gain_usd string"


def _gains(kit: _Kit, shape: pa.Schema):
    """The gains with which each of a pool's segments begins."""

    def gains(part: pa.Table) -> pa.Table:
        cad = usd = kit.zero
        out = []
        for r in sorted(part.to_pylist(), key=lambda r: r["seg"]):
            out.append({k: r[k] for k in ("symbol", "seg", "scope", "pool")} | {"gain_cad": kit.text(cad), "gain_usd": kit.text(usd)})
            cad, usd = cad + kit.read(r["gain_cad"]), usd + kit.read(r["gain_usd"])
        return pa.Table.from_pylist(out, schema=shape)

    return gains


def _totals(kit: _Kit, shape: pa.Schema):
    """A pool's figures at the end of its last segment, with the gains of all."""

    def totals(part: pa.Table) -> pa.Table:
        rows = sorted(part.to_pylist(), key=lambda r: r["seg"])
        last = rows[-1]
        p = _restored([last["units"], last["cad"], last["usd"], last["holding"], ""], kit)
        p.gain_cad = sum((kit.read(r["gain_cad"]) for r in rows), kit.zero)
        p.gain_usd = sum((kit.read(r["gain_usd"]) for r in rows), kit.zero)
        line = (last["scope"], last["pool"], last["symbol"], p.currency, *replay.figures(p, kit.zero, kit.out), sum(r["oversold"] for r in rows))
        return pa.Table.from_batches([_table([line], shape)])

    return totals


class Cut:
    """Rows of symbols that are cut: their segments, and maps and legs of these."""

    def __init__(self, rows: DataFrame, exact: bool, segment: int):
        self.kit, self.exact = _Kit(exact), exact
        self.schema = lambda shape: replay.pa_schema(rows, shape)
        order = ["symbol", "txn_date", "rank", "txn_id"]
        # a repeated split of a pool's day is told before the cut, which may fall between the two
        real = (F.col("action") == "SPLIT") & (F.col("price") > 0) & (F.col("units") > 0)
        splits, mask = rows.where(real), F.lit(0)
        for bit, pool in enumerate(("account", "acct_type", None)):
            day = Window.partitionBy("symbol", "txn_date", F.try_divide("units", "price"), *([pool] if pool else [])).orderBy("txn_id")
            mask = mask + F.when(F.row_number().over(day) > 1, 1 << bit).otherwise(0)
        marked = rows.where(~real).withColumn("repeated", F.lit(0)).unionByName(splits.withColumn("repeated", mask))
        parts = max(1, -(-rows.count() // segment))
        cut = marked.repartitionByRange(parts, *order).withColumn("seg", F.spark_partition_id())
        self.rows = stored(cut, "segments")
        maps = self._dealt(self.rows).mapInArrow(_unit_maps(self.kit, self.schema(UNIT_MAPS)), UNIT_MAPS)
        self.items = self._settled(stored(maps, "unit-maps"))

    def _dealt(self, rows: DataFrame, states: DataFrame | None = None) -> DataFrame:
        """Rows by segment, in order, each segment's states before them."""
        held = rows.withColumns({"state_scope": F.lit(None).cast("int"), "state_pool": F.lit(None).cast("string"), "state": F.lit(None).cast("array<string>"), "is_row": F.lit(True)})
        if states is not None:
            own = states.select("symbol", "seg", F.col("scope").alias("state_scope"), F.col("pool").alias("state_pool"), "state", F.lit(False).alias("is_row"))
            held = held.unionByName(own, allowMissingColumns=True)
        return held.repartition("symbol", "seg").sortWithinPartitions("symbol", "seg", "is_row", "txn_date", "rank", "txn_id").select(NAMES)

    def _settled(self, maps: DataFrame) -> DataFrame:
        """Maps of cost and legs, from units on which all segments agree."""
        key = ["symbol", "seg", "scope", "pool"]
        chain = lambda m: stored(m.groupBy(*POOL).applyInArrow(_chained(self.kit), UNIT_MAPS), "units")
        last, items = maps, None
        while True:
            now = chain(last)
            if items is not None and now.where("ended is null").isEmpty():
                release(last, now)
                return items
            release(last, items)
            states = now.select(*key, F.array("began", "currency").alias("state"))
            items = stored(self._dealt(self.rows, states).mapInArrow(_items(self.kit, self.schema(ITEMS)), ITEMS), "items")
            ended = items.where("ended is not null").select(*key, F.col("ended").alias("end"))
            last = stored(now.join(ended, key).select(*key, "a", "b", "currency", "began", F.col("end").alias("ended")), "units")
            release(now)

    def _scanned(self, known: DataFrame | None) -> DataFrame:
        items = self.items
        if known is not None:
            waiting = (F.col("kind") == "in") & F.col("crosses")
            items = items.where(~waiting).unionByName(items.where(waiting).drop("moved").join(known, "pair", "left").select(items.columns))
        dealt = items.repartition("symbol").sortWithinPartitions("symbol", "seg", "pos")
        return dealt.mapInArrow(_scan(self.kit, self.schema(STATES)), STATES)

    def legs(self, known: DataFrame | None) -> DataFrame:
        """pair, moved of the legs into other symbols, as far as `known` allows."""
        return self._scanned(known).where("pair is not null and crosses").select("pair", "moved")

    def _begun(self, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The states with which segments begin, and their rows with what legs carry."""
        found = stored(self._scanned(known), "states")
        legs = found.where("pair is not null and not crosses").select("pair", "moved")
        legs = legs if known is None else legs.unionByName(known)
        waiting = (F.col("action") == "TFR_IN") & F.col("waits")
        rows = self.rows.where(~waiting).unionByName(self.rows.where(waiting).drop("moved").join(legs, "pair", "left").select(self.rows.columns))
        return found.where("pair is null").select("symbol", "seg", "scope", "pool", "state"), rows

    def _ends(self, states: DataFrame, rows: DataFrame) -> DataFrame:
        return stored(self._dealt(rows, states).mapInArrow(_replay(self.kit, True, self.schema(ENDS)), ENDS), "ends")

    def endings(self, known: DataFrame | None) -> DataFrame:
        shape = replay.end_shape(self.exact)
        return self._ends(*self._begun(known)).groupBy(*POOL).applyInArrow(_totals(self.kit, self.schema(shape)), shape)

    def steps(self, known: DataFrame | None) -> DataFrame:
        states, rows = self._begun(known)
        key = ["symbol", "seg", "scope", "pool"]
        gains = self._ends(states, rows).groupBy(*POOL).applyInArrow(_gains(self.kit, self.schema(GAINS)), GAINS)
        full = states.join(gains, key).select(*key, F.concat("state", F.array("gain_cad", "gain_usd")).alias("state"))
        shape = replay.step_shape(self.exact)
        return self._dealt(rows, full).mapInArrow(_replay(self.kit, False, self.schema(shape)), shape)

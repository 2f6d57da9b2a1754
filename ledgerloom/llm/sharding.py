"""Sharding by a permutation-filled lookup table, in SQL functions only.

Every shard has an order of preference over the slots of a table of prime size:
an offset and a skip, both from hashes of the shard's name. Shards take turns;
at its turn a shard claims the first slot in its order that is still free. The
table does not depend on the data and is broadcast; a key's hash picks a slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import fresh

MOST_SLOTS = 65_537


def hashed(text: Column, salt: str) -> Column:
    """60 bits of the MD5 digest, as a bigint."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), text)), 1, 15), 16, 10).cast("bigint")


def lookup_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """slot, shard: one row per slot. At most MOST_SLOTS slots, so it may be broadcast."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards: at least one, all different, at most one a slot")
    if slots > MOST_SLOTS or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots: a prime of at most {MOST_SLOTS}")
    names = spark.range(len(shards), numPartitions=1).select(F.element_at(F.array(*map(F.lit, shards)), (F.col("id") + 1).cast("int")).alias("name"), "id")
    start, skip = hashed(F.col("name"), "offset:") % slots, hashed(F.col("name"), "skip:") % (slots - 1) + 1
    orders = names.agg(F.sort_array(F.collect_list(F.struct("id", start.alias("start"), skip.alias("skip")))).alias("orders"))  # a row a shard
    # The rank of slot s in an order is (s - start) * inverse(skip) mod slots; the inverse is skip ** (slots - 2), slots being prime.
    bits = [i for i in range(slots.bit_length()) if (slots - 2) >> i & 1]
    power = f"""aggregate(sequence(0, {slots.bit_length()}), named_struct('v', 1L, 'p', o.skip),
        (a, i) -> named_struct('v', if(array_contains(array({", ".join(map(str, bits))}), i), a.v * a.p % {slots}, a.v), 'p', a.p * a.p % {slots})).v"""
    # At each turn the claim is found once: the free slot of lowest rank. A one-element array stands for a name given to a value.
    rank = f"array_min(transform(a.free, s -> (s - o.start + {slots}) * o.inverse % {slots}))"
    claim = f"transform(array(orders[t % {len(shards)}]), o -> (o.start + {rank} * o.skip) % {slots})"
    turn = f"transform({claim}, c -> named_struct('free', array_remove(a.free, c), 'claims', concat(a.claims, array(c))))[0]"
    filled = orders.selectExpr(f"transform(orders, o -> named_struct('start', o.start, 'skip', o.skip, 'inverse', {power})) as orders").selectExpr(
        f"""aggregate(sequence(0, {slots - 1}), named_struct('free', sequence(0L, {slots - 1}L), 'claims', cast(array() as array<bigint>)),
        (a, t) -> {turn}).claims as claims"""
    )
    names_array = F.array(*map(F.lit, shards))
    return filled.select(F.posexplode("claims").alias("turn", "slot")).select("slot", F.element_at(names_array, (F.col("turn") % len(shards) + 1).cast("int")).alias("shard"))


def sharded(df: DataFrame, key: str, shards: list[str], *, slots: int = 1021, out: str = "placement") -> DataFrame:
    """df with a struct column: slot and shard of each row.

    Equal keys go to one shard; a null key is hashed as the empty text, and so
    placed like it. Rows keep their number and their other columns.
    """
    out = fresh(df.columns, out)
    slot = hashed(F.coalesce(F.col(key).cast("string"), F.lit("")), "") % slots
    at, to, own_slot = (fresh([*df.columns, out], c) for c in ("table_slot", "table_shard", "key_slot"))
    table = F.broadcast(lookup_table(df.sparkSession, shards, slots).select(F.col("slot").alias(at), F.col("shard").alias(to)))
    own = [F.col(f"`{c}`") for c in df.columns]
    joined = df.select(*own, slot.alias(own_slot)).join(table, F.col(own_slot) == F.col(at))
    return joined.select(*own, F.struct(F.col(at).alias("slot"), F.col(to).alias("shard")).alias(out))

"""Sharding by jump consistent hashing, in DataFrame functions only.

A key's generator jumps through ever higher shard numbers; the last one below
the shard count is its shard. One shard more moves only the keys whose next
jump lands on it, so no ring table is kept and a key's shard depends on the
key and the count alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cotejo.llm._common import cut, partitions

# Fixed values of the published algorithm: multiplier of its 64-bit linear
# congruential generator, and the modulus.
LCG = 2862933555777941757
WORD = 1 << 64
#: Jumps are about ln(shards); a key that needed more than this fails aloud.
MAX_JUMPS = 128


def _dec(x: Column | int) -> Column:
    return (F.lit(str(x)) if isinstance(x, int) else x).cast("decimal(20,0)")


def stable_key(c: Column, kind: str) -> Column:
    """A 64-bit key: integers as they are, all else by xxhash64; null is 0."""
    return F.coalesce(c.cast("bigint") if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(c), F.lit(0).cast("bigint"))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a 64-bit ``key`` among ``shards``, 0-based.

    The generator runs in decimals, since its products exceed 64 bits and
    must wrap without an overflow error.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = _dec(key)
    key = F.when(key < 0, (key + F.lit(str(WORD)).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(key)
    start = F.struct(key.alias("key"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def jump(s: Column, _: Column) -> Column:
        nxt = ((s["key"] * _dec(LCG) + F.lit(1)) % F.lit(str(WORD)).cast("decimal(20,0)")).cast("decimal(20,0)")
        high = F.floor(nxt / F.lit(1 << 33).cast("decimal(20,0)")).cast("double")
        to = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (high + 1.0))).cast("bigint")
        going = s["j"] < shards
        return F.struct(
            F.when(going, nxt).otherwise(s["key"]).alias("key"),
            F.when(going, s["j"]).otherwise(s["b"]).alias("b"),
            F.when(going, to).otherwise(s["j"]).alias("j"),
        )

    steps = F.sequence(F.lit(1), F.lit(min(shards, MAX_JUMPS)))
    end = F.aggregate(F.transform(steps, lambda i: i), start, jump)
    shard = F.transform(
        F.array(end), lambda s: F.when(s["j"] >= shards, s["b"]).otherwise(F.raise_error(F.lit("jump hash did not end")).cast("bigint"))
    )
    return F.element_at(shard, 1).cast("int")


def assign_shards(df: DataFrame, key_col: str, shards: int, *, shard_col: str = "shard") -> DataFrame:
    """``df`` with each row's shard; a narrow step, whatever the keys' skew.

    Equal keys share a shard and null keys count as 0. An existing column
    ``shard_col`` is replaced; the empty table stays empty.
    """
    kind = dict(df.dtypes)[key_col]
    return df.withColumn(shard_col, jump_hash(stable_key(F.col(key_col), kind), shards))


def number_slots(df: DataFrame, shard_col: str, order_cols: list[str], *, slot_col: str = "slot") -> DataFrame:
    """``df`` with each row's gapless place (from 0) in its shard, by ``order_cols``.

    Rows are range-partitioned by (shard, order), so a shard spreads over many
    tasks; each range numbers its rows, and a table of one count per range and
    shard gives the ranges' offsets. Fully equal rows take neighbouring places
    in any order, and a tie column splits a hot key over ranges. The sorted
    rows go through the shared folder once, so pass only needed columns.
    """
    spark = df.sparkSession
    order = [F.col(c).asc_nulls_first() for c in order_cols] + [F.col("__tie").asc()]
    ranged = cut(
        df.withColumn("__tie", F.monotonically_increasing_id())
        .repartitionByRange(partitions(spark), F.col(shard_col).asc(), *order)
        .withColumn("__range", F.spark_partition_id())
    )
    counts = ranged.groupBy(shard_col, "__range").count()
    before = W.partitionBy(shard_col).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(shard_col, "__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    inside = W.partitionBy(shard_col, "__range").orderBy(*order)
    return (
        ranged.withColumn("__place", F.row_number().over(inside))
        .join(offsets, [shard_col, "__range"])
        .withColumn(slot_col, (F.col("__offset") + F.col("__place") - 1).cast("long"))
        .drop("__tie", "__range", "__place", "__offset")
    )

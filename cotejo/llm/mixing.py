"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Block i (from 0) of a source with weight w of W is released at slot
floor(i*W/w) and due by slot ceil((i+1)*W/w); among the released blocks the
earliest deadline goes first. Each window holds one slot of the source, so
until a source runs out every prefix has each source's share to within less
than one block.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm.sharding import number_slots

#: Sum of the integer weights that shares are rounded to, and slots of one period.
PERIOD = 1000
#: The schedule of a period takes PERIOD x sources steps in one expression.
MAX_SOURCES = 1000
#: Rows of a block.
BLOCK_ROWS = 16


def rounded_weights(shares: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Positive integers in proportion to ``shares`` that sum up to ``period`` (or 10 a source, if more)."""
    period = max(period, 10 * len(shares))
    total = sum(shares.values())
    exact = {k: max(1e-9, v) / total * period for k, v in shares.items()}
    out = {k: max(1, int(v)) for k, v in exact.items()}
    order = sorted(exact, key=lambda k: (int(exact[k]) - exact[k], str(k)))
    left = period - sum(out.values())
    for k in order[: max(0, left)]:
        out[k] += 1
    while (left := period - sum(out.values())) < 0:  # small sources were raised to 1
        out[max(out, key=lambda k: (out[k], str(k)))] += left if max(out.values()) + left > 1 else -1
    return out


def target_weights(df: DataFrame, source_col: str, power: float, period: int = PERIOD) -> dict[str | None, int]:
    """Weights from the rows of each source to the ``power``: 1 keeps shares, less lifts small sources."""
    counts = df.groupBy(source_col).count().limit(MAX_SOURCES + 1).collect()
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: give coarser ones a weight each")
    return rounded_weights({r[0]: r[1] ** power for r in counts}, period) if counts else {}


def period_schedule(spark: SparkSession, weights: list[int]) -> DataFrame:
    """(source, nth, slot, release, deadline) of one period, earliest deadline first; sum(weights) rows."""
    period, k = sum(weights), len(weights)
    w = F.lit(weights).cast("array<bigint>")

    def due(i: Column, c: Column) -> Column:
        return F.ceil((c + 1) * float(period) / F.get(w, i)).cast("bigint")

    def place(s: Column, t: Column) -> Column:
        ready = F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)),
            lambda i: F.when(
                (F.get(s["done"], i) < F.get(w, i)) & (F.get(s["done"], i) * period < (t + 1) * F.get(w, i)),
                F.struct(due(i, F.get(s["done"], i)).alias("d"), i.alias("i")),
            ),
        )
        chosen = F.array_min(ready)["i"]
        counted = F.transform(s["done"], lambda c, i: c + F.when(i == chosen, 1).otherwise(0).cast("bigint"))
        return F.struct(counted.alias("done"), F.concat(s["out"], F.array(chosen)).alias("out"))

    start = F.struct(F.lit([0] * k).cast("array<bigint>").alias("done"), F.array().cast("array<int>").alias("out"))
    slots = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.lit(period - 1).cast("bigint")), start, place)["out"]
    rows = spark.range(1, numPartitions=1).select(F.posexplode(slots).alias("slot", "source"))
    # nth of its source: rank of the slot among the source's slots of this one period
    of = rows.groupBy("source").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    rows = of.select("source", F.posexplode("slots").alias("nth", "slot"))
    wt = F.get(w, F.col("source"))
    return rows.select(
        "source", "nth", F.col("slot").cast("bigint").alias("slot"), F.floor(F.col("nth") * float(period) / wt).alias("release"), due(F.col("source"), F.col("nth")).alias("deadline")
    )


def mix_sources(
    df: DataFrame,
    order_cols: list[str],
    source_col: str,
    weights: Mapping[str | None, int],
    *,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every row of ``df`` with its block's schedule and its ``position`` in the mix.

    Adds weight, block (of its source, in ``order_cols``), release, deadline,
    slot, position (gapless from 0) and within_target: no source has run out
    before this slot. No row drops out: past that point the sources that are
    left go on at their weights. Null is a source like others; a source without
    a weight is an error. Ties by ``order_cols`` keep any order among equals;
    existing columns of these names are replaced. Rows are numbered in ranges,
    so a hot source spreads over tasks; only the period's table is broadcast.
    """
    spark = df.sparkSession
    if not weights:
        return df.withColumns({c: F.lit(None).cast("bigint") for c in ("weight", "block", "release", "deadline", "slot", "position")} | {"within_target": F.lit(None).cast("boolean")})
    names = sorted(weights, key=lambda k: (k is not None, str(k)))
    w = [int(weights[k]) for k in names]
    if min(w) < 1 or len(w) > MAX_SOURCES:
        raise ValueError("weights are positive integers for a bounded list of sources")
    period = sum(w)
    known = F.lit([f"+{k}" if k is not None else "-" for k in names])
    index = F.array_position(known, F.coalesce(F.concat(F.lit("+"), F.col(source_col).cast("string")), F.lit("-"))).cast("int") - 1
    index = F.when(index < 0, F.raise_error(F.lit("a source has no weight")).cast("int")).otherwise(index)
    rows = number_slots(df.withColumn("__source", index), "__source", order_cols, slot_col="__n")
    own = F.get(F.lit(w).cast("array<bigint>"), F.col("__source"))
    rows = rows.withColumns({"block": F.floor(F.col("__n") / block_rows), "weight": own})
    rows = rows.withColumns({"__round": F.floor(F.col("block") / F.col("weight")), "__nth": (F.col("block") % F.col("weight")).cast("int")})
    plan = period_schedule(spark, w).select(
        F.col("source").alias("__source"), F.col("nth").alias("__nth"), F.col("slot").alias("__slot"), F.col("release").alias("__release"), F.col("deadline").alias("__deadline")
    )
    rows = rows.drop("slot", "release", "deadline", "position", "within_target").join(F.broadcast(plan), ["__source", "__nth"])
    rows = rows.withColumns({out: F.col("__round") * period + F.col(f"__{out}") for out in ("slot", "release", "deadline")})
    # the first slot that finds its source empty: one row a source
    ends = df.groupBy(index.alias("__source")).count().withColumn("__blocks", F.ceil(F.col("count") / block_rows))
    ends = ends.withColumn("__w", F.get(F.lit(w).cast("array<bigint>"), F.col("__source")))
    ends = ends.withColumns({"__round": F.floor(F.col("__blocks") / F.col("__w")), "__nth": (F.col("__blocks") % F.col("__w")).cast("int")})
    end = ends.join(F.broadcast(plan), ["__source", "__nth"]).agg(F.min(F.col("__round") * period + F.col("__slot"))).first()[0]
    rows = rows.withColumn("within_target", F.col("slot") < F.lit(end).cast("bigint"))
    rows = rows.withColumn("__all", F.lit(0))
    rows = number_slots(rows, "__all", ["slot", "__n"], slot_col="position")
    return rows.drop("__source", "__n", "__round", "__nth", "__slot", "__release", "__deadline", "__all")

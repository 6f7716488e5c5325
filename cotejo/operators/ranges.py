"""Running totals over a total order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cumulated(df: DataFrame, by: list[str], order: str, value: str, out: str, *, buckets: int = 256) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group that come before it by ``order``.

    Approximate quantiles of the order cut it into buckets; buckets are summed
    first, and a window inside each bucket adds the rest. Nulls come first.
    """
    cuts = df.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000).alias("q")).first()
    bounds = sorted({x for x in (cuts and cuts.q) or [] if x is not None})
    # NaN sorts above all numbers, as in Spark's order; first the stretch of bounds, then how many of it
    step = max(1, int(len(bounds) ** 0.5))
    under = lambda b: b <= F.col(order)
    stretch = F.greatest(F.size(F.filter(F.lit(bounds[::step] or [0.0]), under)) - 1, F.lit(0)) * step
    bucket = stretch + F.size(F.filter(F.slice(F.lit(bounds or [0.0]), stretch + 1, F.lit(step)), under)) if bounds else F.lit(0)
    rows = df.withColumn("__bucket", F.when(F.col(order).isNull(), -1).otherwise(bucket))
    sums = rows.groupBy(*by, "__bucket").agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(*by).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    inside = W.partitionBy(*by, "__bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(sums.select(*by, "__bucket", "__base"), [*by, "__bucket"]).withColumn(out, F.col("__base") + F.col("__own")).drop("__bucket", "__base", "__own")


def percentiles(df: DataFrame, col: str, shares: list[float]) -> DataFrame:
    """One row p0, p1, ...: exact percentiles of a number column, interpolated between neighbours; null without values.

    Equal values count once; their counts cumulate in ranges, so no task sees them all.
    """
    per = df.select(F.col(col).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    placed = cumulated(per, [], "v", "n", "before").join(F.broadcast(total))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("v")))

    out = []
    for k, share in enumerate(shares):
        place = F.lit(float(share)) * (F.col("total") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        out.append((low + (high - low) * part).alias(f"p{k}"))
    return placed.agg(*out)

"""Thresholds, verdicts and balanced samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cotejo.operators.ranges import percentiles

OUT_OF_SCOPE = "no_definido"


def percentile_threshold(values: DataFrame, col: str, percentile: float = 85.0, fallback: float = 0.60) -> DataFrame:
    """One row ``corte``: the interpolated percentile, or the fallback without values."""
    return percentiles(values, col, [percentile / 100.0]).select(F.coalesce("p0", F.lit(fallback)).alias("corte"))


def article_score(top3: Column, maximum: Column) -> Column:
    return F.when(top3 > 0, top3).otherwise(maximum)


def verdict(score: Column, category: Column, cut: Column, strategy: str = "construccion") -> Column:
    """proximo from the cut on, else distante; ``construccion`` leaves the out-of-scope category undefined."""
    by_score = F.when(score >= cut, "proximo").otherwise("distante")
    if strategy == "umbral":
        return by_score
    if strategy != "construccion":
        raise ValueError(f"unknown strategy: {strategy}")
    return F.when(category == OUT_OF_SCOPE, OUT_OF_SCOPE).otherwise(by_score)


def assign_verdicts(articles: DataFrame, *, strategy: str = "construccion", percentile: float = 85.0, fallback: float = 0.60) -> DataFrame:
    """articles (categoria, ivr_top3, ivr_max) with corte and veredicto; only in-scope articles set the cut.

    The cut is one row, so the join with it moves no article.
    """
    scored = articles.withColumn("puntaje", article_score(F.col("ivr_top3"), F.col("ivr_max")))
    cut = percentile_threshold(scored.where(F.col("categoria") != OUT_OF_SCOPE), "puntaje", percentile, fallback)
    return scored.join(F.broadcast(cut)).withColumn("veredicto", verdict(F.col("puntaje"), F.col("categoria"), F.col("corte"), strategy))


def by_thresholds(sb: Column, high: Column | float = 0.70, low: Column | float = 0.45) -> Column:
    """The baseline's verdict on one similarity; null and NaN are 0."""
    v = F.coalesce(F.nanvl(sb.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.when(v >= high, "proximo").when(v >= low, "distante").otherwise("no_definido")


def number(c: Column) -> Column:
    """Text or number to double; what is no number is 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def calibrate_thresholds(train: DataFrame, *, score: str = "sb_max", verdict_col: str = "veredicto") -> tuple[float, float]:
    """(high, low) percentiles of the score at the training set's class proportions."""
    t = train.select(number(F.col(score)).alias("s"), F.col(verdict_col).alias("v"))
    near, undefined = t.agg(F.avg((F.col("v") == "proximo").cast("int")), F.avg((F.col("v") == "no_definido").cast("int"))).first()
    if near is None:
        raise ValueError("no training rows")
    high, low = percentiles(t, "s", [1.0 - near, undefined]).first()
    return float(high), float(low)


def balanced_sample(rows: DataFrame, n: int, *, key: Column, category: str = "categoria") -> DataFrame:
    """``n`` rows: an equal quota of each category, the first by ``key``, then the first others.

    Categories go by first appearance. Ranks stop at the quota and the others
    at ``n``, so whatever the size of a category few rows are shuffled.
    """
    cols = rows.columns
    k = rows.select(category).distinct().count()
    if not k or n < 1:
        return rows.limit(0)
    quota = max(1, n // k)
    keyed = rows.withColumn("__key", key)
    ranked = keyed.withColumn("__rank", F.row_number().over(W.partitionBy(category).orderBy("__key"))).where(F.col("__rank") <= quota)
    begin = ranked.where("__rank = 1").select(category, F.col("__key").alias("__begin"))
    first = ranked.join(F.broadcast(begin), category).select(*cols, "__key", "__begin", "__rank", F.lit(0).alias("__later"))
    # no more than all quotas can stand before the n-th other row
    others = keyed.orderBy("__key").limit(n + quota * k).join(first.select("__key"), "__key", "left_anti")
    both = first.unionByName(others.withColumn("__later", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("__later", "__begin", "__rank", "__key").limit(n).select(*cols)

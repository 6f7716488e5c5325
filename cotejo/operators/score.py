"""The four signals, the weighted score with null-aware weights, and its aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cotejo.config import FEATURES
from cotejo.functions import text as T

SIGNALS = ("sb", "literal", "ontologico", "autoridad")
CONCEPTS = "array<struct<id:string,categoria:string>>"


def clamp(c: Column) -> Column:
    """A signal in [0, 1]; null, NaN and infinities are 0."""
    d = c.cast("double")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.least(F.greatest(d, F.lit(0.0)), F.lit(1.0)))


def finite(c: Column) -> Column:
    """The value, or null if it is no finite number: what averages, maxima and minima skip."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def _share(a: Column, b: Column, metric: str) -> Column:
    both = F.size(F.array_intersect(a, b)).cast("double")
    if metric == "containment":
        return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(a)).otherwise(0.0)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2 * both / (F.size(a) + F.size(b))).otherwise(0.0)


def literal_similarity(premise: Column, norm: Column, n: int = 2, metric: str = "containment") -> Column:
    """Literal signal of two arrays of content tokens.

    containment: share of the premise's n-grams in the norm; dice: the
    symmetric form. A premise shorter than n compares words; one shorter than
    12 tokens averages words and n-grams; no tokens on a side give 0.
    """
    if metric not in ("containment", "dice"):
        raise ValueError(f"unknown literal metric: {metric}")
    if n < 1:
        raise ValueError("n-grams need n >= 1")
    one = _share(F.array_distinct(premise), F.array_distinct(norm), metric)
    if n == 1:
        return F.when((F.size(premise) > 0) & (F.size(norm) > 0), one).otherwise(0.0)
    full = _share(T.ngrams(premise, n), T.ngrams(norm, n), metric)
    short = F.when(F.size(premise) < n, one).when(F.size(premise) < 12, 0.5 * one + 0.5 * full).otherwise(full)
    return F.when((F.size(premise) > 0) & (F.size(norm) > 0), short).otherwise(0.0)


#: Grams of premises (counted) that are broadcast to the norms' scan, about 100 bytes each; more are joined by shuffle.
MAX_BROADCAST_GRAMS = 500_000
#: Tasks that one gram's norms are dealt to in that join.
SALTS = 32


def literal_pairs(premises: DataFrame, norms: DataFrame, n: int = 2, metric: str = "containment") -> DataFrame:
    """(premise_id, norm_id, literal) of all pairs that share a word or n-gram, others being 0.

    premises, norms: premise_id or norm_id, and an array of content tokens. The
    same signal as ``literal_similarity`` without a cross join: distinct grams
    of both sides meet by equality and are counted a pair, so the work follows
    what is shared. A premise sends words only if it is short enough to use them.
    The premises' grams, counted first, go to the norms' scan while they are
    few; more meet by a salted join. Null ids match nothing of their own; an
    empty side gives no rows.
    """
    if metric not in ("containment", "dice") or n < 1:
        raise ValueError("unknown literal metric or n < 1")
    one = lambda c: F.struct(F.lit(1).alias("kind"), F.array_distinct(c).alias("g"))
    many = lambda c: F.struct(F.lit(n).alias("kind"), T.ngrams(c, n).alias("g"))
    size = F.size("tokens")
    wanted = F.when(size < n, F.array(one(F.col("tokens")))).when((size < 12) & F.lit(n > 1), F.array(one(F.col("tokens")), many(F.col("tokens")))).otherwise(F.array(many(F.col("tokens"))))

    # empty arrays explode to nothing; a filter on them would compute the tokens twice
    p = premises.select(F.col("premise_id"), size.alias("len"), F.inline(wanted))
    p = p.select("premise_id", "len", "kind", F.size("g").alias("np"), F.explode("g").alias("gram"))
    both = F.array(one(F.col("tokens")), many(F.col("tokens"))) if n > 1 else F.array(one(F.col("tokens")))
    q = norms.select(F.col("norm_id"), F.inline(both))
    q = q.select("norm_id", "kind", F.size("g").alias("nq"), F.explode("g").alias("gram"))
    if p.count() <= MAX_BROADCAST_GRAMS:
        met = q.join(F.broadcast(p), ["kind", "gram"])
    else:  # a gram of a third of all norms is dealt to SALTS tasks
        salted = p.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = q.withColumn("salt", F.pmod(F.xxhash64("norm_id"), F.lit(SALTS)).cast("int")).join(salted, ["kind", "gram", "salt"])
    shared = met.groupBy("premise_id", "norm_id", "kind").agg(F.count("*").cast("double").alias("both"), F.first("np").alias("np"), F.first("nq").alias("nq"), F.first("len").alias("len"))
    part = F.col("both") / F.col("np") if metric == "containment" else 2 * F.col("both") / (F.col("np") + F.col("nq"))
    half = F.when((F.col("len") >= n) & (F.col("len") < 12) & F.lit(n > 1), 0.5).otherwise(1.0)
    return shared.groupBy("premise_id", "norm_id").agg(F.sum(half * part).alias("literal"))


def ontological_match(premise: Column, category: Column, norm: Column, known_categories: Column | None = None) -> Column:
    """Ontological signal; null if the premise has no concept.

    premise, norm: arrays of (id, categoria). A null norm leaves the premise's
    share alone; an empty one halves it. A category that is none of the
    thesaurus' ``known_categories`` also brings in those of the norm's concepts.
    """
    ids = F.transform(norm, lambda x: x["id"])
    cats = F.transform(norm, lambda x: x["categoria"])
    foreign = ~F.array_contains(known_categories, category) if known_categories is not None else F.lit(False)
    hit = F.filter(
        premise,
        lambda x: (x["categoria"] == category)
        | (foreign & F.coalesce(F.array_contains(cats, x["categoria"]), F.lit(False)))
        | F.coalesce(F.array_contains(ids, x["id"]), F.lit(False)),
    )
    own = F.size(hit).cast("double") / F.size(premise)
    shared = F.size(F.array_intersect(F.transform(premise, lambda x: x["id"]), ids)).cast("double")
    return (
        F.when(premise.isNull() | (F.size(premise) == 0), F.lit(None).cast("double"))
        .when(norm.isNull(), own)
        .when(F.size(norm) == 0, 0.5 * own)
        .otherwise(0.5 * own + 0.5 * shared / F.size(norm))
    )


def shared_terms(premise: Column, norm: Column) -> Column:
    """Share of the premise's concepts that the norm also has; 0 without any."""
    ids = [F.transform(c, lambda x: x["id"]) for c in (premise, norm)]
    both = F.size(F.array_intersect(*ids)).cast("double")
    return F.when(F.size(premise) > 0, F.coalesce(both, F.lit(0.0)) / F.size(premise)).otherwise(0.0)


def weighted_score(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the signals that are not null and have a positive weight; 0 if none."""
    used = {k: w for k, w in weights.items() if w > 0 and k in signals}
    if not used:
        return F.lit(0.0)
    num = sum((F.when(signals[k].isNotNull(), clamp(signals[k]) * w).otherwise(0.0) for k, w in used.items()), F.lit(0.0))
    den = sum((F.when(signals[k].isNotNull(), F.lit(float(w))).otherwise(0.0) for k, w in used.items()), F.lit(0.0))
    return F.when(den > 0, num / den).otherwise(0.0)


def score_evidence(pairs: DataFrame, weights: dict[str, float], *, ngram: int = 2, metric: str = "containment", known_categories: Column | None = None) -> DataFrame:
    """Evidence pairs with signals, score and rank by score (first retrieved among equals).

    pairs: premise_id, norm_id, similitud, posicion_rag, premise_tokens,
    norm_tokens, premise_concepts, norm_concepts, categoria, nivel_autoridad.
    """
    s = pairs.withColumns(
        {
            "sb": F.col("similitud"),
            "literal": literal_similarity(F.col("premise_tokens"), F.col("norm_tokens"), ngram, metric),
            "ontologico": ontological_match(F.col("premise_concepts"), F.col("categoria"), F.col("norm_concepts"), known_categories),
            "autoridad": F.col("nivel_autoridad"),
            "terminos_compartidos": shared_terms(F.col("premise_concepts"), F.col("norm_concepts")),
        }
    )
    s = s.withColumn("ivr", weighted_score({k: F.col(k) for k in SIGNALS}, weights))
    return rerank(s)


def rerank(scored: DataFrame) -> DataFrame:
    order = W.partitionBy("premise_id").orderBy(F.desc("ivr"), "posicion_rag")
    return scored.withColumn("posicion", F.row_number().over(order))


def report(scored: DataFrame) -> DataFrame:
    """One row a premise: the score's aggregates, the best norm and every signal's maximum."""
    order = F.struct(F.col("ivr"), -F.col("posicion_rag"))
    return scored.groupBy("premise_id").agg(
        F.count("*").alias("n_evidencias"),
        F.max(finite(F.col("ivr"))).alias("ivr_max"),
        F.avg(finite(F.col("ivr"))).alias("ivr_medio"),
        F.min(finite(F.col("ivr"))).alias("ivr_min"),
        F.max_by("norm_id", order).alias("mejor_norma"),
        F.max(finite(F.col("sb"))).alias("sb_max"),
        F.max(finite(F.col("literal"))).alias("literal_max"),
        F.max(finite(F.col("ontologico"))).alias("ontologico_max"),
        F.max(finite(F.col("autoridad"))).alias("autoridad_max"),
        F.max(finite(F.col("terminos_compartidos"))).alias("terminos_compartidos_max"),
    )


def feature_vector(scored: DataFrame) -> DataFrame:
    """The sixteen features of each premise, in their fixed order."""
    s = {c: finite(F.col(c)) for c in ("ivr", "sb", "literal", "ontologico", "autoridad", "terminos_compartidos")}
    zero = F.lit(0.0)
    a = scored.groupBy("premise_id").agg(
        F.count("*").cast("double").alias("n_evidencias"),
        F.max(F.coalesce(F.size("premise_concepts"), F.lit(0))).cast("double").alias("n_conceptos_premisa"),
        F.coalesce(F.max(s["ivr"]), zero).alias("ivr_max"),
        F.coalesce(F.avg(s["ivr"]), zero).alias("ivr_medio"),
        F.coalesce(F.min(s["ivr"]), zero).alias("ivr_min"),
        F.coalesce(F.max(s["sb"]), zero).alias("sb_max"),
        F.coalesce(F.avg(s["sb"]), zero).alias("sb_medio"),
        F.coalesce(F.min(s["sb"]), zero).alias("sb_min"),
        F.coalesce(F.max(s["literal"]), zero).alias("literal_max"),
        F.coalesce(F.avg(s["literal"]), zero).alias("literal_medio"),
        F.coalesce(F.max(s["ontologico"]), zero).alias("ontologico_max"),
        F.when(F.count("ontologico") > 0, 1.0).otherwise(0.0).alias("so_disponible"),
        F.coalesce(F.max(s["terminos_compartidos"]), zero).alias("terminos_compartidos_max"),
        F.coalesce(F.max(s["autoridad"]), zero).alias("autoridad_max"),
    )
    a = a.withColumns({"ivr_brecha": F.col("ivr_max") - F.col("ivr_medio"), "sb_brecha": F.col("sb_max") - F.col("sb_min")})
    return a.select("premise_id", *FEATURES)


def article_aggregate(windows: DataFrame, threshold: float = 0.15) -> DataFrame:
    """One row an article over its windows (article_id, i, ok, ivr, n_evidencias, <signal>_max, conceptos).

    A failed window counts as 0; the top three average over as many windows as there are, up to three.
    """
    ivr = F.when(F.col("ok"), F.coalesce("ivr", F.lit(0.0))).otherwise(0.0)
    top = F.slice(F.sort_array(F.collect_list(ivr), asc=False), 1, 3)
    ok = lambda c: F.when(F.col("ok"), F.col(c))
    agg = windows.groupBy("article_id").agg(
        F.count("*").alias("n_ventanas"),
        F.count_if(F.col("ok") & (ivr >= threshold)).alias("n_ventanas_con_senal"),
        F.max(ivr).alias("ivr_max"),
        top.alias("__top"),
        F.avg(ivr).alias("ivr_medio_ventanas"),
        *[F.max(ok(f"{s}_max")).alias(f"{s}_max") for s in (*SIGNALS, "terminos_compartidos")],
        F.max(ok("n_evidencias")).alias("n_evidencias_max"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(ok("conceptos"))))).alias("conceptos"),
    )
    mean = F.aggregate("__top", F.lit(0.0), lambda s, x: s + x) / F.size("__top")
    return agg.withColumn("ivr_top3", mean).drop("__top")


def features_proxy_mode(windows: DataFrame) -> DataFrame:
    """The features as the reference's training table holds them.

    Windows that are not ok are left out; sb_medio, sb_min, sb_brecha and
    literal_medio repeat statistics of the score instead of their signals.
    """
    w = windows.where("ok")
    a = w.groupBy("article_id").agg(
        F.max("ivr").alias("ivr_max"),
        F.avg("ivr").alias("ivr_medio"),
        F.min("ivr").alias("ivr_min"),
        F.max(F.coalesce("n_evidencias", F.lit(0))).cast("double").alias("n_evidencias"),
        F.size(F.array_distinct(F.flatten(F.collect_list("conceptos")))).cast("double").alias("n_conceptos_premisa"),
        *[F.max(f"{s}_max").alias(f"__{s}") for s in (*SIGNALS, "terminos_compartidos")],
    )
    zero = F.lit(0.0)
    a = a.withColumns(
        {
            "ivr_brecha": F.col("ivr_max") - F.col("ivr_medio"),
            "sb_max": F.when(F.coalesce("__sb", zero) != 0, F.col("__sb")).otherwise(F.col("ivr_max")),
            "sb_medio": F.col("ivr_medio"),
            "sb_min": F.col("ivr_min"),
            "sb_brecha": F.col("ivr_max") - F.col("ivr_min"),
            "literal_max": F.coalesce("__literal", zero),
            "literal_medio": F.col("ivr_medio"),
            "ontologico_max": F.coalesce("__ontologico", zero),
            "so_disponible": F.when(F.col("__ontologico").isNotNull(), 1.0).otherwise(0.0),
            "terminos_compartidos_max": F.coalesce("__terminos_compartidos", zero),
            "autoridad_max": F.coalesce("__autoridad", zero),
        }
    )
    empty = windows.select("article_id").distinct().join(a, "article_id", "left")
    return empty.select("article_id", *[F.coalesce(f, zero).alias(f) for f in FEATURES])

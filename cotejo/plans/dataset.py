"""From url rows and fetched texts to a labelled dataset, a trained model and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.config import FEATURES, Settings
from cotejo.operators import evaluate as E
from cotejo.operators import label as L
from cotejo.operators import score as S
from cotejo.operators.model import predict, train
from cotejo.plans import verify as V
from cotejo.sources.tables import exclude_domains, pending, url_key


def choose_urls(urls: DataFrame, n: int, blocked: DataFrame | None = None, cache: DataFrame | None = None) -> DataFrame:
    """A balanced sample of url rows, blocked domains and cached urls left out."""
    rows = urls if blocked is None else exclude_domains(urls, blocked)
    rows = rows if cache is None else pending(rows, cache)
    return L.balanced_sample(rows, n, key=url_key())


def labelled_dataset(
    articles: DataFrame, norms: DataFrame, concepts: DataFrame, settings: Settings | None = None, *, strategy: str = "construccion", feature_mode: str = "true_signals", stemmed: bool = True
) -> DataFrame:
    """One row an article (article_id, categoria, dominio, titulo, texto): the features, categoria_medio, dominio, veredicto.

    ``true_signals`` takes the features from the evidence's own signals;
    ``reference_proxy`` repeats the score's statistics for four of them.
    """
    s = settings or Settings()
    asked = V.premises(articles, "window", s)
    scored = V.evidence(asked, norms, concepts, s, stemmed=stemmed)
    windows = V.window_reports(asked, scored)
    totals = S.article_aggregate(windows, s.signal_threshold).select("article_id", "ivr_top3", F.col("ivr_max").alias("__max"))
    if feature_mode == "reference_proxy":
        features = S.features_proxy_mode(windows)
    elif feature_mode == "true_signals":
        by_article = scored.join(asked.select("premise_id", "article_id"), "premise_id").drop("premise_id").withColumnRenamed("article_id", "premise_id")
        features = S.feature_vector(by_article).withColumnRenamed("premise_id", "article_id")
    else:
        raise ValueError(f"unknown feature mode: {feature_mode}")
    own = articles.select("article_id", "categoria", "dominio").join(totals, "article_id").join(features, "article_id")
    told = L.assign_verdicts(own.withColumn("__keep", F.col("ivr_max")).withColumn("ivr_max", F.col("__max")), strategy=strategy, percentile=s.percentile, fallback=s.fallback_threshold)
    told = told.withColumn("ivr_max", F.col("__keep"))
    return told.select("article_id", *FEATURES, F.col("categoria").alias("categoria_medio"), "dominio", "veredicto")


def evaluate_model(data: DataFrame, *, trees: int = 300, seed: int = 42) -> DataFrame:
    """Both baselines and the forest on one split by domain (by class with two domains or fewer): metrics and McNemar."""
    if data.select("dominio").distinct().limit(3).count() > 2:
        split = E.grouped_split(data, "dominio", seed=seed)
    else:
        split = E.stratified_split(data, "veredicto", "article_id", seed=seed)
    fit, test = split.where("not es_test"), split.where("es_test")
    return E.compare_models(predict(train(fit, trees=trees, seed=seed), test).withColumnRenamed("pred", "pred_h"), fit)

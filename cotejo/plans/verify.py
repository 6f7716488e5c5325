"""Verification of many texts at once: premises, evidence, score, features, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.config import Settings
from cotejo.functions import text as T
from cotejo.functions.stem import stems
from cotejo.operators import score as S
from cotejo.operators import thesaurus as TH
from cotejo.operators.retrieve import hashed_embedding, kept, metadata_filter, retrieve_topk


def premises(articles: DataFrame, mode: str = "window", settings: Settings | None = None) -> DataFrame:
    """(premise_id, article_id, i, texto) of articles (article_id, titulo, texto).

    ``window`` cuts word windows, ``body`` takes the text as one premise,
    ``title`` the headline. Blank ones are left out.
    """
    s = settings or Settings()
    if mode == "window":
        each = articles.select("article_id", F.posexplode(T.windows(F.col("texto"), s.window_words, s.window_overlap)).alias("i", "texto"))
    elif mode in ("body", "title"):
        each = articles.select("article_id", F.lit(0).alias("i"), F.col("texto" if mode == "body" else "titulo").alias("texto"))
    else:
        raise ValueError(f"unknown premise mode: {mode}")
    each = each.where(F.trim("texto") != "")
    return each.withColumn("premise_id", F.xxhash64("article_id", "i"))


def with_tokens_and_concepts(rows: DataFrame, forms: DataFrame, *, id_col: str, text_col: str = "texto", stemmed: bool = False) -> DataFrame:
    """(id, tokens of content, concepts) of each row; concepts an empty array where none."""
    base = rows.select(id_col, T.ascii_tokens(F.col(text_col)).alias("all"), T.content_tokens(F.col(text_col)).alias("tokens"))
    if stemmed:
        base = base.select(id_col, stems(F.col("all")).alias("all"), stems(F.col("tokens")).alias("tokens"))
    found = TH.concept_arrays(TH.detect_concepts(base, forms, id_col=id_col, tokens_col="all"), id_col)
    none = F.array().cast(S.CONCEPTS)
    return base.join(found, id_col, "left").select(id_col, "tokens", F.coalesce("conceptos", none).alias("conceptos"))


def evidence(
    asked: DataFrame, norms: DataFrame, concepts: DataFrame, settings: Settings | None = None, *, where: dict | None = None, k: int | None = None, stemmed: bool = False, skip_same: bool = False
) -> DataFrame:
    """Scored and ranked evidence of premises (premise_id, texto[, embedding]) among norms.

    norms: norm_id, texto, categoria, nivel_autoridad[, embedding]. Texts
    without an embedding get the hashed bag of words. Only retrieved pairs are
    joined with texts.
    """
    s = settings or Settings()

    def embedded(df: DataFrame) -> DataFrame:
        return df if "embedding" in df.columns else df.withColumn("embedding", hashed_embedding(T.ascii_tokens(F.col("texto"))))

    asked, norms = embedded(asked), metadata_filter(embedded(norms), where)
    # k rows a premise, read three times below
    found = kept(retrieve_topk(asked, norms, s.top_k if k is None else k, max_k=s.max_top_k, skip_same=skip_same))
    forms = TH.forms_table(concepts, stemmed=stemmed)
    categories = sorted({r[0] for r in concepts.select("categoria").distinct().collect()})
    p = with_tokens_and_concepts(asked.select("premise_id", "texto"), forms, id_col="premise_id", stemmed=stemmed).toDF("premise_id", "premise_tokens", "premise_concepts")
    wanted = norms.join(found.select("norm_id").distinct(), "norm_id", "left_semi")
    n = with_tokens_and_concepts(wanted.select("norm_id", "texto"), forms, id_col="norm_id", stemmed=stemmed).toDF("norm_id", "norm_tokens", "norm_concepts")
    pairs = found.join(wanted.select("norm_id", "categoria", "nivel_autoridad"), "norm_id").join(n, "norm_id").join(p, "premise_id")
    known = F.lit(categories) if categories else F.array().cast("array<string>")
    return S.score_evidence(pairs, s.weights, ngram=s.ngram, metric=s.literal_metric, known_categories=known)


def window_reports(asked: DataFrame, scored: DataFrame) -> DataFrame:
    """One row a window: article_id, i, ok, ivr, n_evidencias, signal maxima, concept ids; ok is false without evidence."""
    r = S.report(scored)
    ids = scored.groupBy("premise_id").agg(F.first(F.transform("premise_concepts", lambda x: x["id"])).alias("conceptos"))
    both = asked.select("premise_id", "article_id", "i").join(r, "premise_id", "left").join(ids, "premise_id", "left")
    return both.select(
        "article_id",
        "i",
        F.col("n_evidencias").isNotNull().alias("ok"),
        F.coalesce("ivr_max", F.lit(0.0)).alias("ivr"),
        F.coalesce("n_evidencias", F.lit(0)).alias("n_evidencias"),
        *[f"{x}_max" for x in (*S.SIGNALS, "terminos_compartidos")],
        F.coalesce("conceptos", F.array().cast("array<string>")).alias("conceptos"),
    )


def verify(articles: DataFrame, norms: DataFrame, concepts: DataFrame, model=None, *, mode: str = "window", settings: Settings | None = None, stemmed: bool = True, where: dict | None = None) -> DataFrame:
    """One row an article: its aggregates, verdict and probabilities (null without a model), and errors.

    The model sees the features of the article's evidence as one premise.
    """
    s = settings or Settings()
    # both are read several times below
    asked = kept(premises(articles, mode, s))
    scored = kept(evidence(asked, norms, concepts, s, where=where, stemmed=stemmed).drop("premise_tokens", "norm_tokens", "norm_concepts"))
    totals = S.article_aggregate(window_reports(asked, scored), s.signal_threshold)
    by_article = scored.join(asked.select("premise_id", "article_id"), "premise_id").drop("premise_id").withColumnRenamed("article_id", "premise_id")
    features = S.feature_vector(by_article).withColumnRenamed("premise_id", "article_id")
    if model is not None:
        from cotejo.operators.model import predict

        told = predict(model, features).select("article_id", F.col("pred").alias("veredicto"), "probabilidad", "probabilidades")
    else:
        told = features.select("article_id", F.lit(None).cast("string").alias("veredicto"), F.lit(None).cast("double").alias("probabilidad"), F.lit(None).cast("map<string,double>").alias("probabilidades"))
    out = articles.select("article_id", "texto").join(totals, "article_id", "left").join(told, "article_id", "left")
    blank = F.col("texto").isNull() | (F.trim("texto") == "")
    errors = F.array_compact(
        F.array(F.when(blank, "sin contenido"), F.when(~blank & F.col("veredicto").isNull() & F.lit(model is not None), "sin evidencias"), F.when(F.lit(model is None), "sin modelo"))
    )
    return out.withColumn("errores", errors).drop("texto")

"""Command line over the plans: index, verify, dataset, train, validate, segment."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cotejo.config import FEATURES, Settings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cotejo", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, what: str, *args: str):
        c = sub.add_parser(name, help=what)
        for a in args:
            c.add_argument(a, required=not a.endswith("?")) if not a.endswith("?") else c.add_argument(a[:-1])
        return c

    add("index", "corpus files to the norm index", "--corpus", "--out")
    add("verify", "articles (Parquet: article_id, titulo, texto) against the index", "--articles", "--norms", "--thesaurus", "--out", "--model?", "--mode?")
    add("dataset", "a labelled dataset from articles (with categoria, dominio)", "--articles", "--norms", "--thesaurus", "--out")
    add("train", "a model from a dataset, evaluated on unseen domains", "--dataset", "--model")
    add("validate", "findings on a thesaurus", "--thesaurus", "--corpus?")
    add("segment", "pages (Parquet: doc_id, page, text) to fragments", "--pages", "--out")
    return p


def norms_of(index):
    """Index rows with the numeric id that retrieval works on."""
    return index.withColumn("norm_id", F.xxhash64("id"))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("cotejo").getOrCreate()
    settings = Settings.from_spark(spark)
    if a.command == "index":
        from cotejo.sources.tables import bad_files, gold_index, read_master, write_index

        write_index(gold_index(read_master(spark, a.corpus)), a.out)
        for r in bad_files(spark, a.corpus).collect():
            print("no corpus:", r.archivo)
    elif a.command in ("verify", "dataset"):
        from cotejo.operators.thesaurus import load_thesaurus
        from cotejo.plans.dataset import labelled_dataset
        from cotejo.plans.verify import verify
        from cotejo.sources.tables import write_csv

        articles, norms = spark.read.parquet(a.articles), norms_of(spark.read.parquet(a.norms))
        concepts = load_thesaurus(spark, a.thesaurus)
        if a.command == "dataset":
            write_csv(labelled_dataset(articles, norms, concepts, settings), a.out, [*FEATURES, "categoria_medio", "dominio", "veredicto"])
        else:
            from cotejo.operators.model import load

            model = load(a.model) if a.model else None
            verify(articles, norms, concepts, model, mode=a.mode or "window", settings=settings).write.mode("overwrite").parquet(a.out)
    elif a.command == "train":
        from cotejo.operators.model import save, train
        from cotejo.plans.dataset import evaluate_model

        data = spark.read.csv(a.dataset, header=True, inferSchema=True).withColumn("article_id", F.monotonically_increasing_id())
        evaluate_model(data).show(truncate=False)
        save(train(data), a.model)
    elif a.command == "validate":
        from cotejo.operators.classify import classifier_categories
        from cotejo.operators.thesaurus import exit_code, parse_thesaurus, validate
        from cotejo.sources.tables import read_corpus

        raw = parse_thesaurus(spark.read.text(a.thesaurus, wholetext=True).first()[0])
        docs = read_corpus(spark, a.corpus).withColumnRenamed("texto", "text") if a.corpus else None
        found = validate(spark, raw, docs, classifier_categories())
        found.show(1000, truncate=False)
        return exit_code(found)
    elif a.command == "segment":
        from cotejo.operators.clean import prepare_documents
        from cotejo.operators.segment import segment_documents

        segment_documents(prepare_documents(spark.read.parquet(a.pages)), most=settings.fragment_words, least=settings.fragment_min_words).write.mode("overwrite").parquet(a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

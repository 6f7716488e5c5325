"""Documents of one session: segmented, embedded and searched beside the corpus, then forgotten."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.config import SESSION_AUTHORITY_SCALE, Settings
from cotejo.errors import EmptyDocument, InvalidAuthority, SessionError
from cotejo.functions.text import ascii_tokens
from cotejo.operators.classify import pages_label
from cotejo.operators.clean import prepare_documents
from cotejo.operators.retrieve import combine, hashed_embedding, retrieve_topk
from cotejo.operators.segment import segment_documents

GENERIC = "Normativa Externa (carga dinámica)"


class Session:
    """Fragments of loaded documents as an immutable DataFrame behind one temporary view.

    A load publishes the new view only once its fragments are computed, so a
    failed load leaves the session as it was.
    """

    def __init__(self, spark: SparkSession, settings: Settings | None = None, embed=None):
        self.spark, self.settings = spark, settings or Settings()
        self.embed = embed or (lambda text: hashed_embedding(ascii_tokens(text)))
        self.view = f"session_{uuid.uuid4().hex}"
        self.fragments: DataFrame | None = None

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def load(self, pages: DataFrame, *, name: str, category: str = GENERIC, authority: float = 0.33) -> list[str]:
        """Adds documents (doc_id, page, text) that are not loaded yet; the ids added."""
        if not any(abs(authority - a) < 1e-9 for a in SESSION_AUTHORITY_SCALE):
            raise InvalidAuthority(f"authority must be one of {SESSION_AUTHORITY_SCALE}")
        if self.fragments is not None:
            pages = pages.join(self.fragments.select(F.col("doc_id").alias("__have")).distinct(), F.col("doc_id").cast("string") == F.col("__have"), "left_anti")
        docs = prepare_documents(pages)
        found = segment_documents(docs, most=self.settings.fragment_words, least=self.settings.fragment_min_words)
        found = found.withColumns(
            {
                "fragment_id": F.xxhash64("doc_id", "orden"),
                "fuente": F.lit(name),
                "tipo_corpus": F.lit("sesion"),
                "categoria": F.lit(category),
                "nivel_autoridad": F.lit(authority),
                "cita": F.concat(F.lit(f"{name}, "), F.col("etiqueta"), F.lit(", "), pages_label(F.col("pagina_inicio"), F.col("pagina_fin"))),
                "embedding": self.embed(F.col("texto")),
            }
        ).cache()
        ids = sorted(r[0] for r in found.select("doc_id").distinct().collect())  # computes it all, or raises
        if not ids and pages.take(1):
            raise EmptyDocument("no text could be taken from the document")
        self._publish(found if self.fragments is None else self.fragments.unionByName(found))
        return ids

    def _publish(self, fragments: DataFrame) -> None:
        fragments.createOrReplaceTempView(self.view)
        self.fragments = fragments

    def remove(self, doc_id: str) -> None:
        if self.fragments is not None:
            self._publish(self.fragments.where(F.col("doc_id") != doc_id))

    def documents(self) -> DataFrame:
        """(doc_id, fuente, fragmentos, paginas, esquema) of what is loaded."""
        if self.fragments is None:
            return self.spark.createDataFrame([], "doc_id string, fuente string, fragmentos bigint, paginas int, esquema string")
        return self.fragments.groupBy("doc_id", "fuente").agg(F.count("*").alias("fragmentos"), F.max("pagina_fin").alias("paginas"), F.first("esquema").alias("esquema"))

    def search(self, premises: DataFrame, k: int, doc_id: str | None = None) -> DataFrame:
        """Evidence of the session alone, of one document if ``doc_id`` is given."""
        empty = "premise_id bigint, norm_id bigint, similitud double, posicion_rag int"
        if self.fragments is None:
            return self.spark.createDataFrame([], empty)
        rows = self.fragments if doc_id is None else self.fragments.where(F.col("doc_id") == doc_id)
        return retrieve_topk(premises, rows, k, norm_id="fragment_id", max_k=self.settings.max_top_k)

    def search_combined(self, premises: DataFrame, base: DataFrame, k: int) -> DataFrame:
        """The corpus' evidence and the session's, ranked together."""
        return combine(base, self.search(premises, k), k)

    def close(self) -> None:
        if self.fragments is not None:
            self.fragments.unpersist()
            self.spark.catalog.dropTempView(self.view)
            self.fragments = None


def loaded(pages: DataFrame, known: DataFrame, content: Column) -> DataFrame:
    """Pages of documents whose content hash is known already."""
    return pages.join(known, F.substring(F.sha2(content, 256), 1, 10) == known["doc_id"], "left_semi")

"""A conversation over the verification plan: texts and urls are verified, commands steer the session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions.render import bar, route
from cotejo.operators.classify import verdict_line

HELP = {"/ayuda": "commands", "/historial": "what was verified", "/pdf": "loads pages", "/modelo": "loads a model", "/salir": "ends"}
HISTORY = "n int, tipo string, mensaje string, ivr_max double, veredicto string"


class Chat:
    """One user's session; ``verify`` maps articles (article_id, titulo, texto) to reports."""

    def __init__(self, spark: SparkSession, verify: Callable[[DataFrame], DataFrame], fetch: Callable[[DataFrame], DataFrame] | None = None, commands: dict[str, Callable[[str], object]] | None = None):
        self.spark, self.verify, self.fetch = spark, verify, fetch
        self.commands = commands or {}
        self.rows: list[tuple] = []
        self.open = True

    def history(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, HISTORY)

    def handle(self, message: str) -> object:
        """A command's answer, or the report row of a text or url; errors are in its ``errores``."""
        kind, text = self.spark.range(1).select(route(F.lit(message)), F.trim(F.lit(message))).first()
        if kind == "empty":
            return None
        if kind == "command":
            name, _, rest = text.partition(" ")
            if name == "/salir":
                self.open = False
                return None
            if name == "/historial":
                return self.history()
            if name in self.commands:
                return self.commands[name](rest.strip())
            return HELP
        asked = self.spark.createDataFrame([(len(self.rows) + 1, "", text)], "article_id bigint, titulo string, texto string")
        if kind == "url":
            if self.fetch is None:
                return {"errores": ["no fetcher"]}
            asked = self.fetch(asked.withColumnRenamed("texto", "url")).select("article_id", "titulo", "texto")
        shown = self.verify(asked).withColumns({"linea": verdict_line(F.col("veredicto")), "barra": bar(F.coalesce("ivr_max", F.lit(0.0)))})
        row = shown.first()
        self.rows.append((len(self.rows) + 1, kind, text, row["ivr_max"], row["veredicto"]))
        return row

"""Rules that give norms their category and authority, and their ids and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rule table (source, document or book, category, authority), in order.
COMPENDIUM, CODE, COUNCIL = "Compendio de la Doctrina Social", "Código de Derecho Canónico", "Concilio Vaticano II"
HIERARCHY = "Jerarquía y Gobierno Eclesiástico"
LAITY = "Derechos y Obligaciones de los Fieles (Laicado)"
LITURGY = "Sacramentos y Liturgia"
PENAL = "Derecho Penal Eclesiástico"
SOCIAL = "Doctrina Social y Política"
ECUMENISM = "Relaciones Internacionales y Ecumenismo"
BOOKS = (
    ("LIBRO I", HIERARCHY),
    ("LIBRO II", LAITY),
    ("LIBRO III", HIERARCHY),
    ("LIBRO IV", LITURGY),
    ("LIBRO V", HIERARCHY),
    ("LIBRO VI", PENAL),
    ("LIBRO VII", PENAL),
)
DOCUMENTS = (
    ("Lumen gentium", HIERARCHY, 0.85),
    ("Dei Verbum", HIERARCHY, 0.85),
    ("Sacrosanctum concilium", LITURGY, 0.85),
    ("Gaudium et spes", SOCIAL, 0.85),
    ("Christus Dominus", HIERARCHY, 0.70),
    ("Presbyterorum Ordinis", HIERARCHY, 0.70),
    ("Optatam Totius", HIERARCHY, 0.70),
    ("Perfectae Caritatis", HIERARCHY, 0.70),
    ("Apostolicam Actuositatem", LAITY, 0.70),
    ("Orientalium Ecclesiarum", ECUMENISM, 0.70),
    ("Unitatis redintegratio", ECUMENISM, 0.70),
    ("Ad gentes", SOCIAL, 0.70),
    ("Inter Mirifica", SOCIAL, 0.70),
    ("Dignitatis humanae", SOCIAL, 0.70),
    ("Nostra aetate", ECUMENISM, 0.70),
    ("Gravissimum Educationis", SOCIAL, 0.70),
)
COUNCIL_DEFAULT = (LAITY, 0.70)
CITATION_LABELS = {"corpus_constituciones": "Constitución", "corpus_declaraciones": "Declaración", "corpus_decretos": "Decreto"}


def classifier_categories() -> set[str]:
    return {SOCIAL, COUNCIL_DEFAULT[0]} | {c for _, c in BOOKS} | {c for _, c, _ in DOCUMENTS}


def _first(cases: list[tuple[Column, Column]], default: Column) -> Column:
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return default if out is None else out.otherwise(default)


def classify(items: DataFrame, *, source: str = "fuente", context: str = "contexto_jerarquico") -> DataFrame:
    """Items with categoria and nivel_autoridad; items of a source without rules drop out.

    The first rule set whose name the source contains applies; in it the first
    book (as a whole word) or document (in any case) that the context names.
    """
    src, ctx = F.col(source), F.coalesce(F.col(context), F.lit(""))
    book = [(ctx.rlike(rf"(?U)(?<!\w){b}(?!\w)"), F.lit(c)) for b, c in BOOKS]
    doc = [F.contains(F.lower(ctx), F.lit(d.lower())) for d, _, _ in DOCUMENTS]
    doc_cat = [(m, F.lit(d[1])) for m, d in zip(doc, DOCUMENTS, strict=True)]
    doc_auth = [(m, F.lit(d[2])) for m, d in zip(doc, DOCUMENTS, strict=True)]
    is_compendium, is_code = F.contains(src, F.lit(COMPENDIUM)), F.contains(src, F.lit(CODE))
    out = items.where(is_compendium | is_code | F.contains(src, F.lit(COUNCIL)))
    return out.withColumns(
        {
            "categoria": F.when(is_compendium, SOCIAL).when(is_code, _first(book, F.lit("General"))).otherwise(_first(doc_cat, F.lit(COUNCIL_DEFAULT[0]))),
            "nivel_autoridad": F.when(is_compendium, 0.55).when(is_code, 1.0).otherwise(_first(doc_auth, F.lit(COUNCIL_DEFAULT[1]))),
        }
    )


def norm_rows(items: DataFrame) -> DataFrame:
    """Index rows of classified items (tipo_corpus, indice from 0, texto, ...): a padded id and one norm number."""
    return items.select(
        F.format_string("%s:%04d", "tipo_corpus", "indice").alias("id"),
        F.col("texto"),
        "fuente",
        "tipo_corpus",
        F.coalesce("numeral_id", "canon_id").alias("id_norma"),
        "contexto_jerarquico",
        "categoria",
        "nivel_autoridad",
        F.when(F.col("url_origen") != "", F.col("url_origen")).alias("url_origen"),
    )


def citation(tipo: Column, contexto: Column, id_norma: Column, fuente: Column) -> Column:
    """Readable citation; council documents are the context's third part, unnumbered sections its fourth."""
    parts = F.split(contexto, " > ")
    number = id_norma.cast("string")
    label = _first([(tipo == k, F.lit(v)) for k, v in CITATION_LABELS.items()], fuente)
    doc = F.coalesce(F.get(parts, F.lit(2)), fuente)
    section = F.coalesce(F.get(parts, F.lit(3)), F.lit(""))
    return (
        F.when(tipo == "corpus_canones", F.concat(F.lit("CIC, canon "), number))
        .when(tipo == "corpus_compendio", F.concat(F.lit("Compendio, numeral "), number))
        .when(id_norma == 0, F.concat(label, F.lit(" "), doc, F.lit(" (Concilio Vaticano II), "), section))
        .otherwise(F.concat(label, F.lit(" "), doc, F.lit(" (Concilio Vaticano II), numeral "), number))
    )


# Labels of the verdicts and of the authority scale.
VERDICT_LABELS = {
    "proximo": "próximo al corpus",
    "distante": "distante del corpus",
    "no_definido": "no definido (el corpus no cubre el tema)",
}
VERDICT_MESSAGES = {
    "proximo": "El contenido trata los mismos temas que el corpus doctrinal y en términos "
    "compatibles con el magisterio y la normativa.",
    "distante": "El corpus no respalda esta noticia: no se encontró correspondencia suficiente "
    "con el magisterio ni con la normativa. Puede ser un tema que el corpus trata "
    "de otro modo, o un tema que no cubre.",
    "no_definido": "El corpus no cubre el tema de esta noticia: no hay base de comparación "
    "para pronunciarse sobre ella.",
}
AUTHORITY_LABELS = {
    0.33: "Nivel 1 (local / expansión dinámica)",
    0.55: "Nivel 2 — Compendio DSI (magisterial)",
    0.66: "Nivel 2 (nacional)",
    0.70: "Nivel 2 — Decreto / Declaración (Vaticano II)",
    0.85: "Nivel 3 — Constitución (Vaticano II)",
    1.0: "Nivel 3 (universal — Código de Derecho Canónico)",
}


def verdict_label(c: Column) -> Column:
    return _first([(c == k, F.lit(v)) for k, v in VERDICT_LABELS.items()], c)


def verdict_message(c: Column) -> Column:
    return F.coalesce(_first([(c == k, F.lit(v)) for k, v in VERDICT_MESSAGES.items()], F.lit(None)), F.lit("Veredicto desconocido."))


def verdict_line(c: Column) -> Column:
    """Label and message in one line; no verdict gives ``Sin veredicto.``"""
    return F.when(c.isNull() | (c == ""), "Sin veredicto.").otherwise(F.concat(verdict_label(c), F.lit(" — "), verdict_message(c)))


def authority_label(level: Column) -> Column:
    known = _first([(level == k, F.lit(v)) for k, v in AUTHORITY_LABELS.items()], F.concat(F.lit("Nivel "), level.cast("string")))
    return F.when(level.isNull(), "Nivel desconocido").otherwise(known)


def pages_label(first: Column, last: Column) -> Column:
    a, b = first.cast("string"), last.cast("string")
    return F.when(first == last, F.concat(F.lit("p. "), a)).otherwise(F.concat(F.lit("pp. "), a, F.lit("–"), b))


def valid_authority(level: Column, scale: tuple[float, ...], tolerance: float = 1e-9) -> Column:
    return F.exists(F.lit([float(x) for x in scale]), lambda x: F.abs(x - level) < tolerance)


def document_id(content: Column) -> Column:
    """The first ten digits of the content's SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 10)


def document_name(explicit: Column, filename: Column, sha: Column) -> Column:
    """The given name, else the file's stem, else ``documento_<sha8>``."""
    base = F.regexp_extract(filename, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    none = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(none(explicit), none(base), F.concat(F.lit("documento_"), F.substring(sha, 1, 8)))

"""Thesaurus: forms table, concept detection, suggestions, candidates and validation."""

from __future__ import annotations

import difflib
import functools
import json
import math
import operator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cotejo.functions import text as T
from cotejo.functions.stem import stem_arrays
from cotejo.operators.retrieve import kept

SCHEMA = "seq int, id string, canonico string, variantes array<string>, categoria string, nivel_autoridad double"
#: A one-word form in so many fragments may mean something else.
COMMON_WORD = 15
#: Forms of a thesaurus that a plan holds as a literal; more are joined with all n-grams.
FEW_FORMS = 2000
KNOWN_FIELDS = {"termino_canonico", "variaciones_lexicas", "categoria", "nivel_autoridad"}


class InvalidThesaurus(ValueError):
    """The file is no valid JSON; the message names line and column."""


def parse_thesaurus(content: str) -> dict:
    try:
        return json.loads(content.removeprefix("\ufeff"))
    except json.JSONDecodeError as e:
        raise InvalidThesaurus(f"line {e.lineno}, column {e.colno}: {e.msg}") from None


def load_thesaurus(spark: SparkSession, path: str) -> DataFrame:
    """Concept rows of a thesaurus file, in file order."""
    found = spark.read.text(path, wholetext=True).first()
    return concepts_frame(spark, parse_thesaurus(found[0]) if found else {})


def concepts_frame(spark: SparkSession, raw: dict) -> DataFrame:
    rows = [
        (i, cid, c.get("termino_canonico", ""), [str(v) for v in c.get("variaciones_lexicas", [])], c.get("categoria", ""), c.get("nivel_autoridad"))
        for i, (cid, c) in enumerate(raw.get("conceptos", {}).items())
    ]
    return spark.createDataFrame(rows, SCHEMA)


def forms_table(concepts: DataFrame, *, stemmed: bool = False) -> DataFrame:
    """(form, concept_id, categoria, n_words): of concepts with one form, the first in file order has it."""
    each = concepts.select("seq", "id", "categoria", F.posexplode(F.concat(F.array("canonico"), "variantes")).alias("pos", "form"))
    each = each.withColumn("tokens", T.ascii_tokens(F.col("form"))).where(F.size("tokens") > 0)
    if stemmed:
        each = each.withColumn("row", F.concat_ws(":", "seq", "pos"))
        each = each.drop("tokens").join(stem_arrays(each, "row", "tokens", "tokens"), "row")
    each = each.withColumns({"form": F.array_join("tokens", " "), "n_words": F.size("tokens")})
    first = F.struct("seq", "pos")
    return each.groupBy("form").agg(
        F.min_by("id", first).alias("concept_id"), F.min_by("categoria", first).alias("categoria"), F.first("n_words").alias("n_words")
    )


def detect_concepts(tokens: DataFrame, forms: DataFrame, *, id_col: str = "doc_id", tokens_col: str = "tokens", longest: int | None = None) -> DataFrame:
    """(id, concept_id, categoria): concepts whose form stands in the tokens as whole words, once each.

    Every phrase fires, sub-phrases too. The texts' distinct n-grams, up to the
    longest form, meet the forms by equality. Up to FEW_FORMS forms (counted)
    go into the plan, so only grams that are forms leave their row.
    """
    n_forms, most = forms.agg(F.count("*"), F.max("n_words")).first()
    longest = longest or most or 1
    t = F.col(tokens_col)
    grams = F.array_distinct(F.flatten(F.array(*[F.when(F.size(t) >= n, T.ngrams(t, n)).otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1)])))
    if n_forms <= FEW_FORMS:
        known = sorted(r["form"] for r in forms.select("form").collect())
        grams = F.array_intersect(grams, F.lit(known) if known else F.array().cast("array<string>"))
    each = tokens.select(id_col, F.explode(grams).alias("form"))
    return each.join(forms, "form").select(id_col, "concept_id", "categoria").dropDuplicates([id_col, "concept_id"])


def concept_arrays(detected: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, conceptos array of (id, categoria)), in order of concept."""
    pair = F.struct(F.col("concept_id").alias("id"), "categoria")
    return detected.groupBy(id_col).agg(F.sort_array(F.collect_set(pair)).alias("conceptos"))


# -- suggestions from a corpus ------------------------------------------------------------


def _plain_tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return df.select(F.col(id_col).alias("doc"), T.accent_tokens(text).alias("toks"), T.plain_tokens(text).alias("norm"))


def _phrases(docs: DataFrame, sizes: range, holds=None) -> DataFrame:
    """(doc, n, pos, norm words, spelling) of all word n-grams of these sizes, or of those with a word that ``holds``."""
    size = F.size("toks")
    if holds is not None:
        found = F.filter(F.transform("norm", lambda w, i: F.when(holds(w), i)), lambda i: i.isNotNull())
        docs = docs.withColumn("__at", found)

    def at(n: int) -> Column:
        starts = F.sequence(F.lit(0), size - n)
        if holds is not None:
            starts = F.array_distinct(F.flatten(F.transform("__at", lambda h: F.sequence(F.greatest(h - (n - 1), F.lit(0)), F.least(h, size - n)))))
        return F.transform(F.when(size >= n, starts).otherwise(F.array().cast("array<int>")), _phrase(n))

    return docs.select("doc", F.inline(F.concat(*[at(n) for n in sizes])))


def _phrase(n: int):
    return lambda p: F.struct(F.lit(n).alias("n"), p.alias("pos"), F.slice("norm", p + 1, n).alias("w"), F.array_join(F.slice("toks", p + 1, n), " ").alias("spelling"))


def _candidate_grams(norm: str) -> Column:
    """A text's distinct phrases of two or three words that may be terms.

    Neither end is a stop word or shorter than three letters, no word is a
    filler, and one of five letters or more is no stop word.
    """
    ends = [*T.STOP_WORDS, *T.FILLER_WORDS]

    def end(w: Column) -> Column:
        return (F.length(w) >= 3) & ~w.isin(ends)

    def at(x: Column, i: Column) -> Column:
        y, z, space = F.get(norm, i + 1), F.get(norm, i + 2), F.lit(" ")
        long = (F.length(x) >= 5) | (F.length(y) >= 5)
        two = F.when(long & end(y), F.concat(x, space, y))
        inside = (F.length(x) >= 5) | (F.length(z) >= 5) | ((F.length(y) >= 5) & ~y.isin(list(T.STOP_WORDS)))
        three = F.when(inside & end(z) & ~y.isin(list(T.FILLER_WORDS)), F.concat(x, space, y, space, z))
        return F.when(end(x), F.array(two, three)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.array_compact(F.flatten(F.transform(norm, at))))


def find_candidates(df: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 12, top: int = 40) -> DataFrame:
    """Frequent phrases of two or three words that no known term holds: frase, fragmentos, ejemplo.

    fragmentos counts documents; a phrase is spelled, and its example taken, as
    it first occurs. known: one column ``form``. ``top`` rows are the feature.
    Each text gives its distinct phrases, so they are counted and their first
    document is found by sums alone; only the documents of the best (and of what
    ties with the last of them, in one document) are read again for positions.
    """
    rows = df.where(F.col(id_col).isNotNull())
    docs = rows.select(F.col(id_col).alias("doc"), T.plain_tokens(F.col(text_col)).alias("norm"))
    p = docs.select("doc", F.explode(_candidate_grams("norm")).alias("phrase"))
    if rows.groupBy(id_col).count().where("count > 1").take(1):
        p = p.distinct()  # a document of several rows counts once
    found = p.groupBy("phrase").agg(F.count("*").alias("fragmentos"), F.min("doc").alias("doc")).where(F.col("fragmentos") >= least)
    # a term holds a phrase if the phrase is one of its own word n-grams
    words = known.select(F.split(T.normalize(F.col("form")), " ").alias("w"))
    inner = F.flatten(F.array(*[F.when(F.size("w") >= n, T.ngrams(F.col("w"), n)).otherwise(F.array().cast("array<string>")) for n in (2, 3)]))
    found = found.join(words.select(F.explode(inner).alias("phrase")).distinct(), "phrase", "left_anti")
    best = kept(found.withColumn("rank", F.rank().over(W.orderBy(F.desc("fragmentos"), "doc"))).where(F.col("rank") <= top))
    ids = best.select(F.col("doc").alias(id_col)).distinct()
    docs = _plain_tokens(rows.join(F.broadcast(ids), id_col, "left_semi"), id_col, text_col)
    met = _phrases(docs, range(2, 4)).withColumn("phrase", F.array_join("w", " "))
    met = met.join(F.broadcast(best), ["doc", "phrase"]).groupBy("doc", "phrase", "fragmentos").agg(F.min(F.struct("n", "pos", "spelling")).alias("first"))
    # equal counts: the phrase met first
    best = met.orderBy(F.desc("fragmentos"), "doc", "first.n", "first.pos").limit(top)
    shown = best.join(docs.select("doc", "toks"), "doc")
    start = F.greatest(F.col("first.pos") - 4, F.lit(0))
    example = F.array_join(F.slice("toks", start + 1, F.col("first.pos") + F.col("first.n") + 4 - start), " ")
    return shown.select(F.col("first.spelling").alias("frase"), "fragmentos", example.alias("ejemplo"))


def suggest_forms(df: DataFrame, term: str, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """How the corpus says ``term``: frase, fragmentos of the k best phrases of one to four words.

    Phrases share a root with the term's main words; rare roots weigh more, by
    ln((N+1)/(df+1)); then more documents, then shorter phrases, then the text.
    Roots are sought in the texts; only those with one are told apart into
    words, and only the phrases around it are built.
    """
    spark = df.sparkSession
    row = spark.range(1).select(F.transform(T.accent_tokens(F.lit(term)), T.normalize).alias("w"), T.normalize(F.lit(term)).alias("t")).first()
    main = [w for w in row["w"] if w not in T.STOP_WORDS and len(w) >= 4]
    roots = [w[: max(5, len(w) - 2)] for w in main]
    if not roots:
        return spark.createDataFrame([], "frase string, fragmentos bigint")
    stop = list(T.STOP_WORDS)

    def has(words: Column, root: str) -> Column:
        return F.exists(words, lambda w: w.startswith(root))

    def rooted(w: Column) -> Column:
        return functools.reduce(operator.or_, [w.startswith(r) for r in roots])

    # a word with the root: the root with no letter before it
    plain = df.select(id_col, text_col, T.plain_letters(F.col(text_col)).alias("__plain"))
    met = [F.contains("__plain", F.lit(r)) & F.col("__plain").rlike(f"(?<![a-z]){r}") for r in roots]
    n_docs, *seen = plain.agg(F.count("*"), *[F.count_if(m) for m in met]).first()
    rarity = [math.log((max(n_docs, 1) + 1) / (d + 1)) for d in seen]
    near = _plain_tokens(plain.where(functools.reduce(operator.or_, met)), id_col, text_col)
    p = _phrases(near, range(1, 5), rooted).where(~F.get("w", F.lit(0)).isin(stop) & ~F.try_element_at("w", F.lit(-1)).isin(stop))
    weight = sum((F.when(has(F.col("w"), r), v).otherwise(0.0) for r, v in zip(roots, rarity, strict=True)), F.lit(0.0))
    p = p.withColumns({"phrase": F.array_join("w", " "), "weight": weight}).where(F.col("phrase") != row["t"])
    first = p.groupBy("doc", "phrase").agg(F.min_by("spelling", "pos").alias("spelling"), F.first("weight").alias("weight"))
    spelt = first.groupBy("phrase", "spelling").agg(F.count("*").alias("n"), F.first("weight").alias("weight"))
    by = spelt.groupBy("phrase").agg(F.sum("n").alias("fragmentos"), F.max_by("spelling", F.struct("n", "spelling")).alias("frase"), F.first("weight").alias("weight"))
    return by.orderBy(F.desc("weight"), F.desc("fragmentos"), F.length("phrase"), "phrase").limit(k).select("frase", "fragmentos")


# -- validation ---------------------------------------------------------------------------

FINDING = "nivel string, concepto string, regla string, detalle string"


def _form_findings(raw: dict, categories: set[str] | None) -> list[tuple[str, str, str, str]]:
    """Findings on the form of the concepts of a thesaurus, a driver-side document."""
    import re

    concepts = raw.get("conceptos") if isinstance(raw, dict) else None
    if not isinstance(concepts, dict) or not concepts:
        return [("ERROR", "", "sin_conceptos", "")]
    out: list[tuple[str, str, str, str]] = []
    levels = 0
    for cid, c in concepts.items():
        if not re.fullmatch(r"ID_[A-Z0-9_]+", str(cid)):
            out.append(("ERROR", cid, "id", cid))
        if not isinstance(c, dict):
            out.append(("ERROR", cid, "no_objeto", ""))
            continue
        if not isinstance(c.get("termino_canonico"), str) or not c["termino_canonico"].strip():
            out.append(("ERROR", cid, "falta_canonico", ""))
        forms = c.get("variaciones_lexicas")
        if not isinstance(forms, list) or not forms:
            out.append(("ERROR", cid, "faltan_variantes", ""))
        elif any(not isinstance(v, str) or not v.strip() for v in forms):
            out.append(("ERROR", cid, "variante_vacia", ""))
        category = c.get("categoria")
        if not isinstance(category, str) or not category.strip():
            out.append(("ERROR", cid, "falta_categoria", ""))
        elif categories is not None and category not in categories:
            near = difflib.get_close_matches(category, sorted(categories), n=1, cutoff=0.6)
            out.append(("AVISO", cid, "categoria_desconocida", near[0] if near else ""))
        if extra := sorted(set(c) - KNOWN_FIELDS):
            out.append(("AVISO", cid, "campos_desconocidos", ", ".join(extra)))
        if "nivel_autoridad" in c:
            levels += 1
            n = c["nivel_autoridad"]
            if isinstance(n, bool) or not isinstance(n, (int, float)) or not 0 < n <= 1:
                out.append(("ERROR", cid, "nivel_autoridad", repr(n)))
    if levels:
        out.append(("INFO", "", "con_nivel_autoridad", str(levels)))
    if categories is None:
        out.append(("INFO", "", "sin_categorias", ""))
    return out


def clean_concepts(raw: dict) -> dict:
    """What of a thesaurus the corpus checks can read: texts only."""
    out = {}
    for cid, c in (raw.get("conceptos") or {}).items() if isinstance(raw, dict) and isinstance(raw.get("conceptos"), dict) else ():
        if isinstance(c, dict):
            canon, forms = c.get("termino_canonico"), c.get("variaciones_lexicas")
            canon = canon if isinstance(canon, str) and canon.strip() else ""
            forms = [v for v in forms if isinstance(v, str) and v.strip()] if isinstance(forms, list) else []
            category = c.get("categoria")
            out[cid] = {"termino_canonico": canon, "variaciones_lexicas": forms, "categoria": category if isinstance(category, str) else ""}
    return {"conceptos": out}


def term_findings(concepts: DataFrame) -> DataFrame:
    """Terms repeated in a concept (AVISO) or shared by several (ERROR)."""
    each = concepts.select("id", F.explode(F.concat(F.array("canonico"), "variantes")).alias("form"))
    each = each.where("form <> ''").select("id", T.normalize(F.col("form")).alias("term"))
    twice = each.groupBy("id", "term").count().where("count > 1")
    shared = each.groupBy("term").agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)
    return twice.select(F.lit("AVISO").alias("nivel"), F.col("id").alias("concepto"), F.lit("termino_repetido").alias("regla"), F.col("term").alias("detalle")).unionByName(
        shared.select(F.lit("ERROR").alias("nivel"), F.lit("").alias("concepto"), F.lit("termino_ambiguo").alias("regla"), F.concat("term", F.lit(": "), F.array_join("ids", ", ")).alias("detalle"))
    )


def corpus_findings(concepts: DataFrame, docs: DataFrame, *, text_col: str = "text", common: int = COMMON_WORD) -> DataFrame:
    """Canonical terms that no document has, and one-word forms in ``common`` documents or more.

    A form that shares its first five letters with a word of its canonical
    term is no such form.
    """
    texts = docs.select(T.normalize(F.col(text_col)).alias("t")).where("t is not null")
    # whole words: a word character on neither side
    each = concepts.select("id", "canonico", F.posexplode(F.concat(F.array("canonico"), "variantes")).alias("pos", "form"))
    each = each.where("form <> ''").withColumn("term", T.normalize(F.col("form")))
    terms = [r["term"] for r in each.select("term").distinct().orderBy("term").toLocalIterator()]  # of the thesaurus, a document
    if not terms:
        return concepts.sparkSession.createDataFrame([], FINDING)
    import re

    counts = texts.agg(*[F.count_if(F.col("t").rlike(r"(?U)(?<!\w)" + _java_quote(t) + r"(?!\w)")).alias(f"c{i}") for i, t in enumerate(terms)])
    counts = counts.select(F.inline(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"c{i}").alias("n")) for i, t in enumerate(terms)])))
    met = each.join(counts, "term")
    roots = F.transform(F.filter(T.accent_tokens(F.col("canonico")), lambda w: F.length(w) >= 5), lambda w: F.substring(T.normalize(w), 1, 5))
    own = (F.length("term") >= 5) & F.array_contains(roots, F.substring("term", 1, 5))
    absent = met.where((F.col("pos") == 0) & (F.col("n") == 0)).select(F.lit("AVISO").alias("nivel"), F.col("id").alias("concepto"), F.lit("canonico_ausente").alias("regla"), F.col("form").alias("detalle"))
    vague = met.where((F.col("pos") > 0) & ~F.contains("term", F.lit(" ")) & (F.col("n") >= common) & ~own)
    return absent.unionByName(vague.select(F.lit("AVISO").alias("nivel"), F.col("id").alias("concepto"), F.lit("palabra_comun").alias("regla"), F.concat("form", F.lit(": "), F.col("n").cast("string")).alias("detalle")))


def _java_quote(t: str) -> str:
    return r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E"


def validate(spark: SparkSession, raw: dict, docs: DataFrame | None, categories: set[str] | None, *, text_col: str = "text") -> DataFrame:
    """All findings on a thesaurus: nivel, concepto, regla, detalle."""
    out = spark.createDataFrame(_form_findings(raw, categories), FINDING)
    concepts = concepts_frame(spark, clean_concepts(raw))
    out = out.unionByName(term_findings(concepts))
    if docs is None:
        return out.unionByName(spark.createDataFrame([("INFO", "", "sin_corpus", "")], FINDING))
    return out.unionByName(corpus_findings(concepts, docs, text_col=text_col))


def exit_code(findings: DataFrame) -> int:
    """1 if there is an error, else 0."""
    return int(bool(findings.where("nivel = 'ERROR'").take(1)))


def write_candidates_csv(candidates: DataFrame, path: str) -> None:
    """The candidate report, a small file with a byte-order mark and an empty column to fill in."""
    rows = [f"{r['frase']};{r['fragmentos']};{r['ejemplo']};" for r in candidates.toLocalIterator()]
    Path(path).write_text("\ufeff" + "\n".join(["frase;fragmentos;ejemplo;concepto", *rows]) + "\n", encoding="utf-8")

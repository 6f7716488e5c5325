"""Registered queries over the driver's tables, each beside its DuckDB SQL.

Documents play articles and norms, benchmark items premises, embeddings the
vector index, sources domains, languages categories of media, events a cache
log. Searches take every row whose id is divisible by 20 as a query, against
all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.config import AUTHORITY_SCALE, FEATURES, SESSION_AUTHORITY_SCALE, SIGNAL_FAMILIES, Settings
from cotejo.functions import stem as ST
from cotejo.functions import text as T
from cotejo.operators import classify as C
from cotejo.operators import clean as CL
from cotejo.operators import corpora as CO
from cotejo.operators import evaluate as E
from cotejo.operators import label as L
from cotejo.operators import layout as LA
from cotejo.operators import retrieve as R
from cotejo.operators import score as S
from cotejo.operators import segment as SG
from cotejo.operators import thesaurus as TH
from cotejo.plans import verify as V
from cotejo.sources import html as H
from cotejo.sources import tables as TB

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SETTINGS = Settings()


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Tables whose rows take long to work on.
TEXTS = ("documents", "pages")


def scratch(spark: SparkSession) -> str:
    """The folder for tables that a query writes and reads again: the shared one, or on one machine a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or "/tmp/cotejo").rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return TB.spread(df) if name in TEXTS else df


def digits(c, n: int = 6):
    return F.round(c.cast("double"), n)


# -- SQL fragments ------------------------------------------------------------------------

STOP = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(T.STOP_WORDS)) + "]"


def norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(strip_accents(lower({x})), '\s+', ' ', 'g'))"


def tok_sql(x: str) -> str:
    return f"regexp_extract_all({norm_sql(x)}, '[a-z0-9]+')"


def content_sql(x: str) -> str:
    return f"list_filter({tok_sql(x)}, lambda t: NOT list_contains({STOP}, t))"


def bigram_sql(t: str) -> str:
    pairs = f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"
    return f"list_distinct(CASE WHEN len({t}) < 2 THEN {t} ELSE {pairs} END)"


# A small thesaurus over words of the synthetic texts; the real vocabulary is the user's.
THESAURUS = {
    "conceptos": {
        "ID_LINK": {"termino_canonico": "and", "variaciones_lexicas": ["und", "with the"], "categoria": "A"},
        "ID_PLACE": {"termino_canonico": "of the", "variaciones_lexicas": ["dans", "de la", "in"], "categoria": "B"},
        "ID_GOAL": {"termino_canonico": "pour", "variaciones_lexicas": ["para", "zu", "for"], "categoria": "A"},
        "ID_WHO": {"termino_canonico": "was", "variaciones_lexicas": ["der", "qui", "los", "that"], "categoria": "C", "nivel_autoridad": 0.7},
        "ID_RARE": {"termino_canonico": "worthless", "variaciones_lexicas": ["pathetic", "rights reserved"], "categoria": "D"},
    }
}
_FORMS = [
    (f, cid, c["categoria"]) for cid, c in THESAURUS["conceptos"].items() for f in [c["termino_canonico"], *c["variaciones_lexicas"]]
]
FORMS_SQL = "(VALUES " + ", ".join(f"('{f}', '{c}', '{k}')" for f, c, k in _FORMS) + ") AS forms(form, concept_id, categoria)"


def thesaurus(spark: SparkSession) -> DataFrame:
    return TH.concepts_frame(spark, THESAURUS)


# -- text ---------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS h FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("h"))


@query(f"SELECT doc_id, len({tok_sql('text')}) AS n, len(list_distinct({tok_sql('text')})) AS n_distinct FROM documents")
def tokens_count(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.ascii_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[a-záéíóúüñ]+')) AS n FROM documents")
def accent_tokens_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.accent_tokens(F.col("text"))).cast("long").alias("n"))


@query(f"SELECT doc_id, len(c) AS n, md5(array_to_string(c, ' ')) AS h FROM (SELECT doc_id, {content_sql('text')} AS c FROM documents)")
def content_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.content_tokens(F.col("text")).alias("c"))
    return d.select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join("c", " ")).alias("h"))


@query(f"SELECT doc_id, len({bigram_sql('c')}) AS n FROM (SELECT doc_id, {content_sql('text')} AS c FROM documents)")
def bigrams_distinct(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.content_tokens(F.col("text")).alias("c"))
    return d.select("doc_id", F.size(T.ngrams(F.col("c"), 2)).cast("long").alias("n"))


@query(
    r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 175 THEN [0] ELSE range(0, len(w), 125) END) AS i FROM w)
SELECT doc_id, (i // 125)::BIGINT AS i, md5(array_to_string(w[i + 1 : i + 175], ' ')) AS h FROM s"""
)
def sliding_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.windows(F.col("text"))).alias("i", "w"))
    return d.select("doc_id", F.col("i").cast("long").alias("i"), F.md5("w").alias("h"))


@query(
    r"""
SELECT doc_id, len(l) AS n_lines, md5(array_to_string(l, chr(10))) AS h FROM (
  SELECT doc_id, list_filter(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
    lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents)"""
)
def clean_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.lines(F.col("text")).alias("l"))
    return d.select("doc_id", F.size("l").cast("long").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("h"))


@query(
    r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT regexp_replace(lower(line), '\d+', '#', 'g') AS k, count(*) AS n, count(DISTINCT doc_id) AS docs FROM l WHERE line <> '' GROUP BY 1 HAVING count(*) > 1"""
)
def repeated_line_keys(spark, sf_dir):
    l = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return l.groupBy(T.repetition_key(F.col("line")).alias("k")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).where("n > 1")


@query(
    r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT doc_id, line, regexp_replace(line, '\([^)]*\)?', '', 'g') AS o FROM l WHERE line <> '')
SELECT doc_id, count(*) AS n,
  count(*) FILTER (length(regexp_replace(o, '[^\p{L}]', '', 'g')) > 0 AND length(regexp_replace(o, '[^\p{Lu}]', '', 'g')) >= 0.75 * length(regexp_replace(o, '[^\p{L}]', '', 'g'))) AS mayusculas,
  count(*) FILTER (ends_with(rtrim(o), '.')) AS punto,
  count(*) FILTER (regexp_matches(rtrim(line), '[.:;?!»”")…]$')) AS cierra
FROM s GROUP BY doc_id"""
)
def line_predicates(spark, sf_dir):
    l = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return l.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.count_if(T.mostly_upper(F.col("line"))).alias("mayusculas"),
        F.count_if(T.ends_with_period(F.col("line"))).alias("punto"),
        F.count_if(T.closes_sentence(F.col("line"))).alias("cierra"),
    )


@query(
    r"""
WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?;:])\s+([A-ZÁÉÍÓÚÑ¿¡"«“(\d])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents)
SELECT doc_id, (unnest(range(len(s))))::INTEGER AS i, unnest(s) AS oracion FROM s"""
)
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "oracion"))


@query()
def stem_tokens(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.explode(T.ascii_tokens(F.col("text"))).alias("token"))
    return ST.stem_table(tokens)


# The published sample of the stemming algorithm.
STEM_SAMPLE = {
    "cheque": "chequ", "chequeo": "cheque", "cheques": "chequ", "cheyene": "cheyen", "chi": "chi", "chiapaneca": "chiapanec", "chiapas": "chiap",
    "chic": "chic", "chica": "chic", "chicago": "chicag", "chicana": "chican", "chicano": "chican", "chicas": "chic", "chicharrones": "chicharron",
    "chichimecas": "chichimec", "chicles": "chicl", "chico": "chic", "torá": "tor", "tórax": "torax", "torcer": "torc", "toreado": "tor", "toreados":
    "tor", "toreándolo": "tor", "torear": "tor", "toreara": "tor", "torearlo": "tor", "toreó": "tore", "torero": "torer", "toreros": "torer", "torio":
    "tori", "tormenta": "torment", "tormentas": "torment", "tornado": "torn", "tornados": "torn", "tornar": "torn", "tornen": "torn", "torneo":
    "torne", "torneos": "torne", "tornillo": "tornill", "tornillos": "tornill", "torniquete": "torniquet", "torno": "torn", "toro": "tor", "toronto":
    "toront", "toros": "tor", "torpedearon": "torped", "torpeza": "torpez", "torrado": "torr", "torralba": "torralb", "torre": "torr", "torrencial":
    "torrencial", "torrenciales": "torrencial", "torrente": "torrent", "torreon": "torreon", "torreón": "torreon", "torres": "torr", "torrescano":
    "torrescan",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{s}')" for w, s in STEM_SAMPLE.items()) + ") AS v(token, stem)")
def stem_published(spark, sf_dir):
    return ST.stem_table(spark.createDataFrame([(w,) for w in STEM_SAMPLE], "token string"))


# -- retrieval ----------------------------------------------------------------------------

_PAIRS = """
pairs AS (
  SELECT p.vec_id AS premise_id, n.vec_id AS norm_id, n.label,
    round(list_cosine_similarity(p.embedding::DOUBLE[], n.embedding::DOUBLE[]), 9) AS c
  FROM embeddings p JOIN embeddings n ON p.vec_id % 20 = 0 AND p.vec_id <> n.vec_id {extra}),
top AS (
  SELECT premise_id, norm_id, label, greatest(least(c, 1.0), 0.0) AS similitud,
    row_number() OVER (PARTITION BY premise_id ORDER BY c DESC, norm_id) AS posicion_rag
  FROM pairs QUALIFY posicion_rag <= 5)"""
PAIRS = _PAIRS.format(extra="")


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("premise_id"), "embedding")
    return asked, e.select(F.col("vec_id").alias("norm_id"), "embedding", F.col("label").alias("categoria"))


@query(f"WITH {PAIRS} SELECT premise_id, norm_id, round(similitud, 6) AS similitud, posicion_rag FROM top")
def retrieve_topk(spark, sf_dir):
    asked, norms = _vectors(spark, sf_dir)
    return R.retrieve_topk(asked, norms, 5, skip_same=True).select("premise_id", "norm_id", digits(F.col("similitud")).alias("similitud"), F.col("posicion_rag").cast("long").alias("posicion_rag"))


@query(f"WITH {_PAIRS.format(extra='AND n.label = 3')} SELECT premise_id, norm_id, round(similitud, 6) AS similitud, posicion_rag FROM top")
def retrieve_where(spark, sf_dir):
    asked, norms = _vectors(spark, sf_dir)
    found = R.retrieve_topk(asked, R.metadata_filter(norms, {"categoria": 3}), 5, skip_same=True)
    return found.select("premise_id", "norm_id", digits(F.col("similitud")).alias("similitud"), F.col("posicion_rag").cast("long").alias("posicion_rag"))


@query(
    f"""
WITH {_PAIRS.format(extra='AND n.label < 5')},
base AS (SELECT *, 0 AS o FROM top),
pairs2 AS (SELECT p.vec_id AS premise_id, n.vec_id AS norm_id, round(list_cosine_similarity(p.embedding::DOUBLE[], n.embedding::DOUBLE[]), 9) AS c
  FROM embeddings p JOIN embeddings n ON p.vec_id % 20 = 0 AND p.vec_id <> n.vec_id AND n.label >= 5),
ses AS (SELECT premise_id, norm_id, NULL AS label, greatest(least(c, 1.0), 0.0) AS similitud, row_number() OVER (PARTITION BY premise_id ORDER BY c DESC, norm_id) AS posicion_rag, 1 AS o
  FROM pairs2 QUALIFY posicion_rag <= 5)
SELECT premise_id, norm_id, round(similitud, 6) AS similitud, o AS origen_orden,
  row_number() OVER (PARTITION BY premise_id ORDER BY similitud DESC, o, posicion_rag) AS posicion
FROM (SELECT * FROM base UNION ALL SELECT * FROM ses) QUALIFY posicion <= 5"""
)
def retrieve_combined(spark, sf_dir):
    asked, norms = _vectors(spark, sf_dir)
    base = R.retrieve_topk(asked, norms.where("categoria < 5"), 5, skip_same=True)
    session = R.retrieve_topk(asked, norms.where("categoria >= 5"), 5, skip_same=True)
    both = R.combine(base, session, 5)
    return both.select("premise_id", "norm_id", digits(F.col("similitud")).alias("similitud"), "origen_orden", F.col("posicion").cast("long").alias("posicion"))


@query("SELECT event_id, CASE WHEN value IS NULL THEN NULL ELSE greatest(least(1 - value / 50, 1.0), 0.0) END AS similitud FROM events")
def clamp_similarity(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", R.clamp_similarity(F.col("value") / 50).alias("similitud"))


@query()
def hashed_embedding_topk(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("norm_id"), R.hashed_embedding(T.ascii_tokens(F.col("text"))).alias("embedding"))
    asked = d.where("norm_id % 20 = 0").select(F.col("norm_id").alias("premise_id"), "embedding")
    return R.retrieve_topk(asked, d, 5, skip_same=True)


# -- literal, ontological and authority signals --------------------------------------------

_LITERAL = """
p AS (SELECT item_id, {content} AS a FROM benchmark WHERE item_id % 20 = 0),
n AS (SELECT doc_id, {content} AS b FROM documents),
g AS (SELECT item_id, doc_id, a, b, {ga} AS ga, {gb} AS gb, list_distinct(a) AS ua, list_distinct(b) AS ub FROM p, n WHERE len(a) > 0 AND len(b) > 0),
s AS (SELECT *, len(list_intersect(ga, gb)) AS both_n, len(list_intersect(ua, ub)) AS both_1 FROM g)
""".format(content=content_sql("text"), ga=bigram_sql("a"), gb=bigram_sql("b"))


def _literal(spark, sf_dir, metric: str):
    items = table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("premise_id"), T.content_tokens(F.col("text")).alias("tokens"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("norm_id"), T.content_tokens(F.col("text")).alias("tokens"))
    found = S.literal_pairs(items, docs, 2, metric)
    return found.select(F.col("premise_id").alias("item_id"), F.col("norm_id").alias("doc_id"), digits(F.col("literal")).alias("literal")).where("literal > 0")


def _literal_sql(one: str, full: str) -> str:
    return f"WITH {_LITERAL} SELECT * FROM (SELECT item_id, doc_id, round(CASE WHEN len(a) < 2 THEN {one} WHEN len(a) < 12 THEN 0.5 * {one} + 0.5 * {full} ELSE {full} END, 6) AS literal FROM s) WHERE literal > 0"


@query(_literal_sql("both_1 / len(ua)", "both_n / len(ga)"))
def literal_containment(spark, sf_dir):
    return _literal(spark, sf_dir, "containment")


@query(_literal_sql("2 * both_1 / (len(ua) + len(ub))", "2 * both_n / (len(ga) + len(gb))"))
def literal_dice(spark, sf_dir):
    return _literal(spark, sf_dir, "dice")


@query(
    f"""
SELECT DISTINCT doc_id, concept_id, categoria
FROM (SELECT doc_id, ' ' || array_to_string({tok_sql('text')}, ' ') || ' ' AS t FROM documents) d, {FORMS_SQL}
WHERE contains(t, ' ' || form || ' ')"""
)
def concept_detect_unstemmed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.ascii_tokens(F.col("text")).alias("tokens"))
    return TH.detect_concepts(d, TH.forms_table(thesaurus(spark)))


@query()
def concept_detect_stemmed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.ascii_tokens(F.col("text")).alias("t"))
    return TH.detect_concepts(ST.stem_arrays(d, "doc_id", "t", "tokens"), TH.forms_table(thesaurus(spark), stemmed=True))


_CONCEPTS = f"""
hits AS (SELECT DISTINCT doc_id, concept_id, categoria
  FROM (SELECT doc_id, ' ' || array_to_string({tok_sql('text')}, ' ') || ' ' AS t FROM documents) d, {FORMS_SQL} WHERE contains(t, ' ' || form || ' ')),
cs AS (SELECT e.vec_id AS id, coalesce(list(h.concept_id) FILTER (h.concept_id IS NOT NULL), []) AS ids, coalesce(list(h.categoria) FILTER (h.concept_id IS NOT NULL), []) AS cats
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN hits h ON h.doc_id = e.vec_id GROUP BY 1)"""
#: Norms' categories and authorities by label: every tenth label is none of the thesaurus' categories.
_CATEGORY_SQL = "CASE label % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'Externa' END"
_AUTHORITY_SQL = "([1.0, 0.85, 0.70, 0.55, 0.33])[label % 5 + 1]::DOUBLE"
_SCORED = f"""
{_PAIRS.format(extra='AND p.vec_id IN (SELECT doc_id FROM documents) AND n.vec_id IN (SELECT doc_id FROM documents)')},
{_CONCEPTS},
tk AS (SELECT doc_id AS id, {content_sql('text')} AS t FROM documents),
pr AS (SELECT top.*, {_CATEGORY_SQL} AS categoria, {_AUTHORITY_SQL} AS autoridad, cp.ids AS pi, cp.cats AS pc, cn.ids AS ni, cn.cats AS nc, tp.t AS a, tn.t AS b
  FROM top JOIN cs cp ON cp.id = premise_id JOIN cs cn ON cn.id = norm_id JOIN tk tp ON tp.id = premise_id JOIN tk tn ON tn.id = norm_id),
sg AS (SELECT *, similitud AS sb,
  CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0
    WHEN len(a) < 2 THEN len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(a))
    WHEN len(a) < 12 THEN 0.5 * len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(a)) + 0.5 * len(list_intersect({bigram_sql('a')}, {bigram_sql('b')})) / len({bigram_sql('a')})
    ELSE len(list_intersect({bigram_sql('a')}, {bigram_sql('b')})) / len({bigram_sql('a')}) END AS literal,
  len(list_filter(range(1, len(pi) + 1), lambda i: pc[i] = categoria OR (categoria = 'Externa' AND list_contains(nc, pc[i])) OR list_contains(ni, pi[i]))) AS hit,
  len(list_intersect(pi, ni)) AS shared FROM pr),
so AS (SELECT *, CASE WHEN len(pi) = 0 THEN NULL WHEN len(ni) = 0 THEN 0.5 * hit / len(pi) ELSE 0.5 * hit / len(pi) + 0.5 * shared / len(ni) END AS ontologico,
  CASE WHEN len(pi) = 0 THEN 0.0 ELSE shared / len(pi) END AS terminos_compartidos FROM sg),
sc AS (SELECT *, (0.4 * sb + 0.25 * literal + coalesce(0.2 * ontologico, 0) + 0.15 * autoridad) / (0.4 + 0.25 + CASE WHEN ontologico IS NULL THEN 0 ELSE 0.2 END + 0.15) AS ivr FROM so)"""


def _norms(spark, sf_dir) -> DataFrame:
    """Documents that have a vector, as norms: category and authority by the vector's label."""
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    n = e.join(d, e["vec_id"] == d["doc_id"])
    kind = F.get(F.array(*map(F.lit, ["A", "B", "C", "D", "Externa"])), F.col("label") % 5)
    level = F.get(F.array(*map(F.lit, AUTHORITY_SCALE)), F.col("label") % 5)
    return n.select(F.col("vec_id").alias("norm_id"), F.col("text").alias("texto"), "embedding", kind.alias("categoria"), level.alias("nivel_autoridad"))


def _scored(spark, sf_dir, settings: Settings = SETTINGS) -> DataFrame:
    norms = _norms(spark, sf_dir)
    asked = norms.where("norm_id % 20 = 0").select(F.col("norm_id").alias("premise_id"), "texto", "embedding")
    return V.evidence(asked, norms, thesaurus(spark), settings, skip_same=True)


@query(f"WITH {_SCORED} SELECT premise_id, norm_id, round(ontologico, 6) AS ontologico FROM sc")
def ontology_so(spark, sf_dir):
    return _scored(spark, sf_dir).select("premise_id", "norm_id", digits(F.col("ontologico")).alias("ontologico"))


@query(f"WITH {_SCORED} SELECT premise_id, norm_id, round(terminos_compartidos, 6) AS terminos FROM sc")
def shared_terms(spark, sf_dir):
    return _scored(spark, sf_dir).select("premise_id", "norm_id", digits(F.col("terminos_compartidos")).alias("terminos"))


@query(f"WITH {_SCORED} SELECT premise_id, norm_id, round(sb, 6) AS sb, round(literal, 6) AS literal, autoridad, round(ivr, 6) AS ivr FROM sc")
def ivr_score(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("premise_id", "norm_id", digits(F.col("sb")).alias("sb"), digits(F.col("literal")).alias("literal"), "autoridad", digits(F.col("ivr")).alias("ivr"))


@query(
    """
SELECT event_id, round(CASE WHEN value IS NULL OR value < 20 THEN (0.4 * a + 0.25 * b) / 0.65 ELSE (0.4 * a + 0.25 * b + 0.2 * c) / 0.85 END, 6) AS ivr
FROM (SELECT event_id, value, least(greatest(value / 100, 0), 1) AS a, least(greatest((user_id % 7) / 5, 0), 1) AS b, least(greatest(value / 50, 0), 1) AS c FROM events WHERE value IS NOT NULL)"""
)
def ivr_renormalized(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null")
    sig = {"sb": F.col("value") / 100, "literal": (F.col("user_id") % 7) / 5, "ontologico": F.when(F.col("value") >= 20, F.col("value") / 50)}
    return e.select("event_id", digits(S.weighted_score(sig, {"sb": 0.4, "literal": 0.25, "ontologico": 0.2, "autoridad": 0.15})).alias("ivr"))


@query(f"WITH {_SCORED} SELECT premise_id, norm_id, posicion_rag, row_number() OVER (PARTITION BY premise_id ORDER BY ivr DESC, posicion_rag) AS posicion FROM sc")
def ivr_rerank(spark, sf_dir):
    return _scored(spark, sf_dir).select("premise_id", "norm_id", F.col("posicion_rag").cast("long").alias("posicion_rag"), F.col("posicion").cast("long").alias("posicion"))


@query(
    f"""WITH {_SCORED} SELECT premise_id, count(*) AS n_evidencias, round(max(ivr), 6) AS ivr_max, round(avg(ivr), 6) AS ivr_medio, round(min(ivr), 6) AS ivr_min,
  first(norm_id ORDER BY ivr DESC, posicion_rag) AS mejor_norma, round(max(ontologico), 6) AS ontologico_max FROM sc GROUP BY premise_id"""
)
def ivr_report(spark, sf_dir):
    r = S.report(_scored(spark, sf_dir))
    return r.select("premise_id", "n_evidencias", *[digits(F.col(c)).alias(c) for c in ("ivr_max", "ivr_medio", "ivr_min")], "mejor_norma", digits(F.col("ontologico_max")).alias("ontologico_max"))


_FEATURES = """
  count(*)::DOUBLE AS n_evidencias, max(len(pi))::DOUBLE AS n_conceptos_premisa, max(ivr) AS ivr_max, avg(ivr) AS ivr_medio, min(ivr) AS ivr_min, max(ivr) - avg(ivr) AS ivr_brecha,
  max(sb) AS sb_max, avg(sb) AS sb_medio, min(sb) AS sb_min, max(sb) - min(sb) AS sb_brecha, max(literal) AS literal_max, avg(literal) AS literal_medio,
  coalesce(max(ontologico), 0) AS ontologico_max, CASE WHEN count(ontologico) > 0 THEN 1.0 ELSE 0.0 END AS so_disponible, max(terminos_compartidos) AS terminos_compartidos_max, max(autoridad) AS autoridad_max"""
_ROUNDED = ", ".join(f"round({f}, 6)::DOUBLE AS {f}" for f in FEATURES)


@query(f"WITH {_SCORED}, fv AS (SELECT premise_id, {_FEATURES} FROM sc GROUP BY premise_id) SELECT premise_id, {_ROUNDED} FROM fv")
def feature_vector(spark, sf_dir):
    return S.feature_vector(_scored(spark, sf_dir)).select("premise_id", *[digits(F.col(f)).alias(f) for f in FEATURES])


# articles: events of a user as windows, whose value plays the score
_WINDOWS_SQL = """
w AS (SELECT user_id AS article_id, event_id AS i, event_type <> 'click' AS ok, least(greatest(value / 100, 0), 1) AS ivr, user_id % 4 + 1 AS n_evidencias,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 200 END AS ont FROM events WHERE value IS NOT NULL)"""


def _windows(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null")
    return e.select(
        F.col("user_id").alias("article_id"),
        F.col("event_id").alias("i"),
        (F.col("event_type") != "click").alias("ok"),
        F.least(F.greatest(F.col("value") / 100, F.lit(0)), F.lit(1)).alias("ivr"),
        (F.col("user_id") % 4 + 1).alias("n_evidencias"),
        (F.col("value") / 100).alias("sb_max"),
        (F.col("value") / 150).alias("literal_max"),
        F.when(F.col("event_id") % 3 != 0, F.col("value") / 200).alias("ontologico_max"),
        F.lit(0.55).alias("autoridad_max"),
        F.lit(0.0).alias("terminos_compartidos_max"),
        F.array(F.col("event_type")).alias("conceptos"),
    )


@query(
    f"""
WITH {_WINDOWS_SQL}, x AS (SELECT *, CASE WHEN ok THEN ivr ELSE 0 END AS v FROM w)
SELECT article_id, count(*) AS n_ventanas, count(*) FILTER (ok AND v >= 0.15) AS n_ventanas_con_senal, round(max(v), 6) AS ivr_max,
  round(list_sum(list_sort(list(v), 'DESC')[1:3]) / least(3, count(*)), 6) AS ivr_top3, round(avg(v), 6) AS ivr_medio_ventanas, round(max(ont) FILTER (ok), 6) AS ontologico_max
FROM x GROUP BY article_id"""
)
def article_window_agg(spark, sf_dir):
    a = S.article_aggregate(_windows(spark, sf_dir))
    return a.select("article_id", "n_ventanas", "n_ventanas_con_senal", *[digits(F.col(c)).alias(c) for c in ("ivr_max", "ivr_top3", "ivr_medio_ventanas", "ontologico_max")])


@query(
    f"""
WITH {_WINDOWS_SQL}, a AS (SELECT article_id, max(ivr) AS mx, avg(ivr) AS md, min(ivr) AS mn, max(n_evidencias) AS ne, max(ont) AS om FROM w WHERE ok GROUP BY 1)
SELECT d.article_id, round(coalesce(md, 0), 6) AS sb_medio, round(coalesce(mn, 0), 6) AS sb_min, round(coalesce(mx - mn, 0), 6) AS sb_brecha, round(coalesce(md, 0), 6) AS literal_medio,
  coalesce(ne, 0)::DOUBLE AS n_evidencias, CASE WHEN om IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS so_disponible
FROM (SELECT DISTINCT article_id FROM w) d LEFT JOIN a USING (article_id)"""
)
def features_proxy_mode(spark, sf_dir):
    f = S.features_proxy_mode(_windows(spark, sf_dir))
    return f.select("article_id", *[digits(F.col(c)).alias(c) for c in ("sb_medio", "sb_min", "sb_brecha", "literal_medio", "n_evidencias", "so_disponible")])


# -- rules, citations, ids -----------------------------------------------------------------

_KINDS = ["corpus_canones", "corpus_compendio", "corpus_constituciones", "corpus_declaraciones", "corpus_decretos"]
_SOURCES = [C.CODE, C.COMPENDIUM + " de la Iglesia", C.COUNCIL, C.COUNCIL, "Otra fuente"]


def _items(spark, sf_dir) -> DataFrame:
    """Parts as corpus items: the key chooses source, book and document."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    book = F.get(F.lit([b for b, _ in C.BOOKS]), (k % 7).cast("int"))
    doc = F.get(F.lit([d for d, _, _ in C.DOCUMENTS]), (k % 16).cast("int"))
    pick = (k % 5).cast("int")
    ctx = F.when(pick == 0, F.concat(book, F.lit(" > TÍTULO I"))).when(pick == 1, "Compendio").otherwise(F.concat(F.lit("Concilio Vaticano II > Documentos > "), F.upper(doc), F.when(k % 3 == 0, " > PROEMIO").otherwise("")))
    return p.select(
        k.alias("indice"),
        F.get(F.lit(_KINDS), pick).alias("tipo_corpus"),
        F.get(F.lit(_SOURCES), pick).alias("fuente"),
        F.when(pick == 0, k).alias("canon_id"),
        F.when(pick != 0, k % 3).alias("numeral_id"),
        ctx.alias("contexto_jerarquico"),
        F.col("p_name").alias("texto"),
        F.when(k % 2 == 0, F.lit("http://x")).otherwise("").alias("url_origen"),
    )


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_ITEMS_SQL = f"""
it AS (SELECT p_partkey AS indice, ({_list(_KINDS)})[p_partkey % 5 + 1] AS tipo_corpus, ({_list(_SOURCES)})[p_partkey % 5 + 1] AS fuente,
  CASE WHEN p_partkey % 5 = 0 THEN p_partkey END AS canon_id, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 3 END AS numeral_id,
  CASE p_partkey % 5 WHEN 0 THEN ({_list(b for b, _ in C.BOOKS)})[p_partkey % 7 + 1] || ' > TÍTULO I' WHEN 1 THEN 'Compendio'
    ELSE 'Concilio Vaticano II > Documentos > ' || upper(({_list(d for d, _, _ in C.DOCUMENTS)})[p_partkey % 16 + 1]) || CASE WHEN p_partkey % 3 = 0 THEN ' > PROEMIO' ELSE '' END END AS ctx,
  p_name AS texto, CASE WHEN p_partkey % 2 = 0 THEN 'http://x' ELSE '' END AS url FROM part)"""
_CLASSIFIED_SQL = f"""{_ITEMS_SQL},
cl AS (SELECT *, CASE p_partkey5 WHEN 0 THEN ({_list(c for _, c in C.BOOKS)})[indice % 7 + 1] WHEN 1 THEN '{C.SOCIAL}' ELSE ({_list(c for _, c, _ in C.DOCUMENTS)})[indice % 16 + 1] END AS categoria,
  CASE p_partkey5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.55 ELSE ([{', '.join(str(a) for _, _, a in C.DOCUMENTS)}])[indice % 16 + 1] END::DOUBLE AS nivel_autoridad
  FROM (SELECT *, indice % 5 AS p_partkey5 FROM it) WHERE p_partkey5 <> 4)"""


@query(f"WITH {_CLASSIFIED_SQL} SELECT indice, categoria, nivel_autoridad FROM cl")
def classify_rules(spark, sf_dir):
    return C.classify(_items(spark, sf_dir)).select("indice", "categoria", "nivel_autoridad")


@query(f"WITH {_CLASSIFIED_SQL} SELECT tipo_corpus || ':' || lpad(indice::VARCHAR, greatest(4, length(indice::VARCHAR))::INTEGER, '0') AS id, coalesce(numeral_id, canon_id) AS id_norma, nullif(url, '') AS url_origen FROM cl")
def norm_ids(spark, sf_dir):
    return TB.gold_index(_items(spark, sf_dir)).select("id", "id_norma", "url_origen")


@query(
    f"""WITH {_ITEMS_SQL}, x AS (SELECT *, coalesce(numeral_id, canon_id) AS n, string_split(ctx, ' > ') AS s,
  CASE tipo_corpus WHEN 'corpus_constituciones' THEN 'Constitución' WHEN 'corpus_declaraciones' THEN 'Declaración' WHEN 'corpus_decretos' THEN 'Decreto' ELSE fuente END AS e FROM it)
SELECT indice, CASE WHEN tipo_corpus = 'corpus_canones' THEN 'CIC, canon ' || n WHEN tipo_corpus = 'corpus_compendio' THEN 'Compendio, numeral ' || n
  WHEN n = 0 THEN e || ' ' || coalesce(s[3], fuente) || ' (Concilio Vaticano II), ' || coalesce(s[4], '') ELSE e || ' ' || coalesce(s[3], fuente) || ' (Concilio Vaticano II), numeral ' || n END AS cita FROM x"""
)
def citation(spark, sf_dir):
    i = _items(spark, sf_dir)
    return i.select("indice", C.citation(F.col("tipo_corpus"), F.col("contexto_jerarquico"), F.coalesce("numeral_id", "canon_id"), F.col("fuente")).alias("cita"))


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'p. ' || p_size ELSE 'pp. ' || p_size || '–' || (p_size + 2) END AS paginas, list_contains([1.0, 0.85, 0.7, 0.55, 0.33, 0.66], round(p_size / 100, 2)) AS valida FROM part")
def page_labels(spark, sf_dir):
    a = F.col("p_size")
    z = F.when(a < 10, a).otherwise(a + 2)
    return table(spark, sf_dir, "part").select("p_partkey", C.pages_label(a, z).alias("paginas"), C.valid_authority(F.round(a / 100, 2), SESSION_AUTHORITY_SCALE).alias("valida"))


@query("SELECT doc_id, substr(sha256(text), 1, 10) AS id, 'documento_' || substr(sha256(text), 1, 8) AS nombre FROM documents")
def document_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256))
    return d.select("doc_id", C.document_id(F.col("text")).alias("id"), C.document_name(F.lit(None).cast("string"), F.lit(""), F.col("sha")).alias("nombre"))


# -- sources, caches, index ----------------------------------------------------------------

#: Domains of the exclusion query.
BLOCKED = ["src3", "src7", "src11", "SRC15"]


def _urls(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.concat(F.lit("http://"), "source", F.lit("/"), "doc_id").alias("url"), F.col("lang").alias("categoria"), F.lit(None).cast("string").alias("titulo"), F.concat(F.col("n_chars") % 97, F.lit("x")).alias("relevancia"), F.col("source").alias("dominio"))


_URLS_SQL = "u AS (SELECT doc_id AS id, 'http://' || source || '/' || doc_id AS url, lang AS categoria, '' AS titulo, (n_chars % 97) || 'x' AS relevancia, n_chars % 97 AS r, source AS dominio FROM documents)"


@query(f"WITH {_URLS_SQL} SELECT id, url, categoria, titulo, relevancia, dominio, row_number() OVER (ORDER BY r DESC, id) AS orden FROM u WHERE categoria IN ('es', 'fr')")
def url_rows(spark, sf_dir):
    from cotejo.operators.ranges import cumulated

    rows = TB.url_rows(_urls(spark, sf_dir), ["es", "fr"])
    # the place in the order, by ranges: relevance down, then id
    keyed = rows.withColumns({"__k": F.lit(97 - 0.0) - TB.leading_integer(F.col("relevancia")) + F.col("id") / 1e12, "__one": F.lit(1)})
    return cumulated(keyed, [], "__k", "__one", "__b").select("id", "url", "categoria", "titulo", "relevancia", "dominio", (F.col("__b") + 1).alias("orden"))


@query(f"SELECT doc_id, source FROM documents WHERE lower(source) NOT IN ({', '.join(repr(b.lower()) for b in BLOCKED)})")
def exclude_domains(spark, sf_dir):
    blocked = spark.createDataFrame([(b,) for b in BLOCKED], "dominio string")
    return TB.exclude_domains(table(spark, sf_dir, "documents").select("doc_id", "source"), blocked, domain="source")


@query(
    f"""WITH {_URLS_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY r DESC, id) AS g, row_number() OVER (PARTITION BY categoria ORDER BY r DESC, id) AS k FROM u),
q AS (SELECT greatest(1, 31 // count(DISTINCT categoria)) AS cuota FROM u), b AS (SELECT categoria, min(g) AS b FROM o GROUP BY 1),
z AS (SELECT id, o.categoria, CASE WHEN k <= cuota THEN 0 ELSE 1 END AS later, CASE WHEN k <= cuota THEN b ELSE 0 END AS bb, g FROM o, q, b WHERE o.categoria = b.categoria)
SELECT id, o.categoria FROM (SELECT id, categoria FROM z ORDER BY later, bb, g LIMIT 31) o"""
)
def balanced_sample(spark, sf_dir):
    return L.balanced_sample(_urls(spark, sf_dir), 31, key=TB.url_key()).select("id", "categoria")


@query("SELECT user_id, last(event_id ORDER BY ts, event_id) AS event_id, last(event_type ORDER BY ts, event_id) AS event_type FROM events GROUP BY user_id")
def cache_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("seq"))
    return TB.latest(e, "user_id", "seq")


@query("SELECT count(*) AS lineas, count(DISTINCT user_id) AS claves, count(*) - count(DISTINCT user_id) AS sobran, sum(DISTINCT user_id)::BIGINT AS suma FROM events")
def cache_compaction(spark, sf_dir):
    """Events appended as a JSON cache, compacted, and read again."""
    base = f"{scratch(spark)}/cache-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), "event_id")
    TB.append_cache(e, f"{base}/lines")
    gone = TB.compact(spark, f"{base}/lines", f"{base}/kept", "url string, event_id bigint")
    kept = TB.read_cache(spark, f"{base}/kept", "url string, event_id bigint")
    return kept.agg(
        (F.count("*") + F.lit(gone)).alias("lineas"), F.count("*").alias("claves"), F.lit(gone).cast("long").alias("sobran"), F.sum(F.col("url").cast("bigint")).alias("suma")
    )


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0)")
def pending_urls(spark, sf_dir):
    """Customers that the cache, a fifth of the orders, does not have."""
    cache = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0")
    return TB.pending(table(spark, sf_dir, "customer").select("c_custkey"), cache.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT count(*) AS urls, count(t) AS con_texto, count(*) - count(t) AS sin_texto FROM (SELECT CASE WHEN n_chars % 9 > 0 THEN text END AS t FROM documents)")
def cache_statistics(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") % 9 > 0, F.col("text")).alias("texto"))
    return TB.cache_statistics(d)


@query(
    """WITH a AS (SELECT c_custkey AS k, c_mktsegment AS t FROM customer WHERE c_custkey % 11 <> 0), b AS (SELECT c_custkey AS k, c_mktsegment AS t FROM customer WHERE c_custkey % 13 <> 0)
SELECT coalesce(a.t, b.t) AS tipo, count(a.k) AS esperado, count(b.k) AS en_indice, count(*) FILTER (b.k IS NULL) AS faltantes, count(*) FILTER (a.k IS NULL) AS huerfanos,
  count(*) FILTER (b.k IS NULL) = 0 AND count(*) FILTER (a.k IS NULL) = 0 AS ok FROM a FULL JOIN b ON a.k = b.k GROUP BY 1"""
)
def index_reconcile(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("tipo_corpus"))
    return TB.reconcile(c.where("id % 11 <> 0"), c.where("id % 13 <> 0"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE s_name END AS texto FROM supplier")
def upsert_norms(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("texto"))
    return TB.upsert(s, s.where("id % 3 = 0").withColumn("texto", F.upper("texto")))


@query("SELECT h, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, substr(sha256(text), 1, 10) AS h FROM documents) GROUP BY h")
def hash_dedupe(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", C.document_id(F.col("text")).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


# -- labels and evaluation -----------------------------------------------------------------

_LABELLED_SQL = """
art AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '5%' THEN 'no_definido' ELSE o_orderpriority END AS categoria,
  CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_totalprice / 600000 END AS ivr_top3, o_totalprice / 550000 AS ivr_max, o_custkey % 40 AS dominio FROM orders),
pt AS (SELECT *, CASE WHEN ivr_top3 > 0 THEN ivr_top3 ELSE ivr_max END AS puntaje FROM art),
ct AS (SELECT coalesce(quantile_cont(puntaje, 0.85), 0.60) AS corte FROM pt WHERE categoria <> 'no_definido'),
lb AS (SELECT pt.*, corte, CASE WHEN categoria = 'no_definido' THEN 'no_definido' WHEN puntaje >= corte THEN 'proximo' ELSE 'distante' END AS veredicto FROM pt, ct)"""


def _articles(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.startswith("o_orderpriority", F.lit("5")), "no_definido").otherwise(F.col("o_orderpriority")).alias("categoria"),
        F.when(F.col("o_orderkey") % 10 == 0, 0.0).otherwise(F.col("o_totalprice") / 600000).alias("ivr_top3"),
        (F.col("o_totalprice") / 550000).alias("ivr_max"),
        (F.col("o_custkey") % 40).alias("dominio"),
    )


def _labelled(spark, sf_dir, strategy="construccion") -> DataFrame:
    return L.assign_verdicts(_articles(spark, sf_dir), strategy=strategy)


def _dataset(spark, sf_dir) -> DataFrame:
    return _labelled(spark, sf_dir).withColumn("categoria_medio", F.col("categoria"))


@query(f"WITH {_LABELLED_SQL} SELECT round(corte, 6) AS corte FROM ct")
def percentile_threshold(spark, sf_dir):
    a = _articles(spark, sf_dir).where("categoria <> 'no_definido'").withColumn("p", L.article_score(F.col("ivr_top3"), F.col("ivr_max")))
    return L.percentile_threshold(a, "p").select(digits(F.col("corte")).alias("corte"))


@query(f"WITH {_LABELLED_SQL} SELECT id, veredicto FROM lb")
def label_construction(spark, sf_dir):
    return _labelled(spark, sf_dir).select("id", "veredicto")


@query(f"WITH {_LABELLED_SQL} SELECT id, CASE WHEN puntaje >= corte THEN 'proximo' ELSE 'distante' END AS veredicto FROM lb")
def label_threshold(spark, sf_dir):
    return _labelled(spark, sf_dir, "umbral").select("id", "veredicto")


@query(f"WITH {_LABELLED_SQL} SELECT id, CASE WHEN ivr_max >= 0.70 THEN 'proximo' WHEN ivr_max >= 0.45 THEN 'distante' ELSE 'no_definido' END AS pred FROM lb")
def baseline_fixed(spark, sf_dir):
    return _labelled(spark, sf_dir).select("id", L.by_thresholds(F.col("ivr_max")).alias("pred"))


_CAL_SQL = f"""{_LABELLED_SQL},
pr AS (SELECT avg(CASE WHEN veredicto = 'proximo' THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN veredicto = 'no_definido' THEN 1.0 ELSE 0 END) AS b, count(*) - 1 AS n FROM lb),
so AS (SELECT ivr_max AS v, row_number() OVER (ORDER BY ivr_max) - 1 AS i FROM lb),
hi AS (SELECT sum(CASE WHEN i = floor((1 - a) * n) THEN v * (1 - ((1 - a) * n - floor((1 - a) * n))) ELSE 0 END + CASE WHEN i = floor((1 - a) * n) + 1 THEN v * ((1 - a) * n - floor((1 - a) * n)) ELSE 0 END) AS hi,
  sum(CASE WHEN i = floor(b * n) THEN v * (1 - (b * n - floor(b * n))) ELSE 0 END + CASE WHEN i = floor(b * n) + 1 THEN v * (b * n - floor(b * n)) ELSE 0 END) AS lo FROM so, pr)"""


@query(f"WITH {_CAL_SQL} SELECT round(hi, 6) AS tau_alta, round(lo, 6) AS tau_baja FROM hi")
def baseline_calibrated(spark, sf_dir):
    high, low = L.calibrate_thresholds(_labelled(spark, sf_dir), score="ivr_max")
    return spark.range(1).select(digits(F.lit(high)).alias("tau_alta"), digits(F.lit(low)).alias("tau_baja"))


_PREDS_SQL = f"""{_LABELLED_SQL},
pd AS (SELECT veredicto AS y, CASE WHEN ivr_max >= 0.70 THEN 'proximo' WHEN ivr_max >= 0.45 THEN 'distante' ELSE 'no_definido' END AS pred_b,
  CASE WHEN id % 7 = 0 THEN 'distante' ELSE veredicto END AS pred_h FROM lb)"""


def _preds(spark, sf_dir) -> DataFrame:
    return _labelled(spark, sf_dir).select(F.col("veredicto").alias("y"), L.by_thresholds(F.col("ivr_max")).alias("pred_b"), F.when(F.col("id") % 7 == 0, "distante").otherwise(F.col("veredicto")).alias("pred_h"))


@query(
    f"""WITH {_PREDS_SQL}, t AS (SELECT count(*) FILTER (pred_h = y AND pred_b <> y) AS b, count(*) FILTER (pred_h <> y AND pred_b = y) AS c FROM pd)
SELECT b, c, round(CASE WHEN b + c > 0 THEN (abs(b - c) - 1.0) * (abs(b - c) - 1.0) / (b + c) ELSE 0 END, 6)::DOUBLE AS chi2 FROM t"""
)
def mcnemar(spark, sf_dir):
    return E.mcnemar(_preds(spark, sf_dir)).select("b", "c", digits(F.col("chi2")).alias("chi2"))


_CONF_SQL = f"""{_PREDS_SQL}, cls(k) AS (VALUES ('proximo'), ('distante'), ('no_definido')),
cm AS (SELECT a.k AS y, b.k AS pred, (SELECT count(*) FROM pd WHERE pd.y = a.k AND pd.pred_b = b.k) AS n FROM cls a, cls b)"""


@query(f"WITH {_CONF_SQL} SELECT y, pred, n FROM cm")
def confusion_matrix(spark, sf_dir):
    return E.confusion(_preds(spark, sf_dir), "y", "pred_b")


_CM_SQL = f"""{_CONF_SQL},
m AS (SELECT k AS clase, (SELECT n FROM cm WHERE y = k AND pred = k) AS tp, (SELECT sum(n) FROM cm WHERE y = k) AS support, (SELECT sum(n) FROM cm WHERE pred = k) AS predicted FROM cls),
mm AS (SELECT clase, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, support FROM m),
mf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM mm)"""


@query(f"WITH {_CM_SQL} SELECT clase, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM mf")
def class_metrics(spark, sf_dir):
    m = E.class_metrics(E.confusion(_preds(spark, sf_dir), "y", "pred_b"))
    return m.select("clase", *[digits(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    f"""WITH {_CM_SQL} SELECT round((SELECT sum(n) FILTER (y = pred) / sum(n) FROM cm), 6) AS accuracy, (SELECT sum(n) FILTER (pred = 'proximo' AND y <> 'proximo') FROM cm)::BIGINT AS fp_proximo,
  round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM mf"""
)
def summary_metrics(spark, sf_dir):
    m = E.summary_metrics(E.confusion(_preds(spark, sf_dir), "y", "pred_b"))
    return m.select(digits(F.col("accuracy")).alias("accuracy"), "fp_proximo", digits(F.col("macro_f1")).alias("macro_f1"), digits(F.col("weighted_f1")).alias("weighted_f1"))


@query(
    f"""WITH {_LABELLED_SQL}, r AS (SELECT veredicto = 'proximo' AS y, rank() OVER (ORDER BY ivr_max) + (count(*) OVER (PARTITION BY ivr_max) - 1) / 2.0::DOUBLE AS m FROM lb),
t AS (SELECT sum(m) FILTER (y) AS s, count(*) FILTER (y)::DOUBLE AS p, count(*) FILTER (NOT y)::DOUBLE AS q FROM r) SELECT round((s - p * (p + 1) / 2) / (p * q), 6) AS auc FROM t"""
)
def auc_rank(spark, sf_dir):
    return E.auc(_labelled(spark, sf_dir), "ivr_max", F.col("veredicto") == "proximo").select(digits(F.col("auc")).alias("auc"))


def _feature_rows(spark, sf_dir) -> DataFrame:
    p = F.col("ivr_max")
    return _labelled(spark, sf_dir).select(
        "id", "veredicto", "dominio", p.alias("sb_max"), (F.col("id") % 13 / 13).alias("literal_max"), (F.col("id") % 5 / 5).alias("ontologico_max"), F.when(F.col("id") % 4 == 0, 0.0).otherwise(1.0).alias("so_disponible"), (F.col("id") % 3 / 3).alias("autoridad_max")
    )


def _weights_sql(name: str, w: dict[str, float]) -> str:
    num = f"{w['sb']} * least(ivr_max, 1) + {w['literal']} * (id % 13 / 13) + CASE WHEN id % 4 = 0 THEN 0 ELSE {w['ontologico']} * (id % 5 / 5) END + {w['autoridad']} * (id % 3 / 3)"
    den = f"{w['sb']} + {w['literal']} + CASE WHEN id % 4 = 0 THEN 0 ELSE {w['ontologico']} END + {w['autoridad']}"
    return f"SELECT '{name}' AS candidato, veredicto = 'proximo' AS y, round(({num}) / ({den}), 9) AS s FROM lb"


@query(
    f"""WITH {_LABELLED_SQL}, al AS ({' UNION ALL '.join(_weights_sql(k, w) for k, w in E.WEIGHT_SETS.items())}),
r AS (SELECT candidato, y, rank() OVER (PARTITION BY candidato ORDER BY s) + (count(*) OVER (PARTITION BY candidato, s) - 1) / 2.0::DOUBLE AS m FROM al),
t AS (SELECT candidato, sum(m) FILTER (y) AS s, count(*) FILTER (y)::DOUBLE AS p, count(*) FILTER (NOT y)::DOUBLE AS q FROM r GROUP BY 1) SELECT candidato, round((s - p * (p + 1) / 2) / (p * q), 4) AS auc FROM t"""
)
def weight_candidates(spark, sf_dir):
    return E.compare_weights(_feature_rows(spark, sf_dir)).select("candidato", digits(F.col("auc"), 4).alias("auc"))


@query(
    """WITH g AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY md5(source || ':42'), source) AS k, count(*) OVER () AS n FROM g)
SELECT d.doc_id, k <= ceil(0.25 * n) AS es_test FROM documents d JOIN r USING (source)"""
)
def grouped_split(spark, sf_dir):
    return E.grouped_split(table(spark, sf_dir, "documents").select("doc_id", "source"), "source").select("doc_id", "es_test")


_DOMAIN_SQL = f"{_LABELLED_SQL}, dt AS (SELECT dominio, categoria AS categoria_medio, count(*) AS n, count(*) FILTER (veredicto = 'proximo') AS proximo, avg(ivr_max) AS ivr_max FROM lb GROUP BY 1, 2 HAVING count(*) >= 10)"


@query(f"WITH {_DOMAIN_SQL} SELECT dominio, categoria_medio, n, proximo, round(ivr_max, 6) AS ivr_max, round(100.0 * proximo / n, 6)::DOUBLE AS pct_proximo FROM dt")
def domain_table(spark, sf_dir):
    t = E.domain_table(_dataset(spark, sf_dir))
    return t.select("dominio", "categoria_medio", "n", "proximo", digits(F.col("ivr_max")).alias("ivr_max"), digits(F.col("pct_proximo")).alias("pct_proximo"))


@query(
    f"""WITH {_DOMAIN_SQL}, p AS (SELECT *, 100.0::DOUBLE * proximo / n AS pct FROM dt)
SELECT categoria_medio, count(*) AS dominios, sum(n)::BIGINT AS noticias, round(avg(pct), 6) AS pct_medio, round(median(pct), 6) AS pct_mediana, round(min(pct), 6) AS pct_min, round(max(pct), 6) AS pct_max, round(avg(ivr_max), 6) AS ivr_medio FROM p GROUP BY 1"""
)
def posture_summary(spark, sf_dir):
    t = E.posture_summary(_dataset(spark, sf_dir))
    return t.select("categoria_medio", "dominios", "noticias", *[digits(F.col(c)).alias(c) for c in ("pct_medio", "pct_mediana", "pct_min", "pct_max", "ivr_medio")])


@query("SELECT round(100.0 * var_samp(m) / var_samp(value), 6) AS eta2 FROM (SELECT value, avg(value) OVER (PARTITION BY event_type) AS m FROM events WHERE value IS NOT NULL)")
def eta_squared(spark, sf_dir):
    return E.eta_squared(table(spark, sf_dir, "events").where("value is not null"), "event_type", "value").select(digits(F.col("eta2")).alias("eta2"))


@query(f"WITH {_LABELLED_SQL} SELECT categoria, count(*) AS n, round(avg(ivr_max), 6) AS ivr_max_medio, round(avg(ivr_top3), 6) AS ivr_top3_medio FROM lb GROUP BY 1")
def dataset_summary(spark, sf_dir):
    t = E.dataset_summary(_labelled(spark, sf_dir))
    return t.select("categoria", "n", digits(F.col("ivr_max_medio")).alias("ivr_max_medio"), digits(F.col("ivr_top3_medio")).alias("ivr_top3_medio"))


# -- html ----------------------------------------------------------------------------------

_UNESC = "{x}"
for _k, _v in H.ENTITIES.items():
    _UNESC = f"replace({_UNESC}, '{_k}', '{_v.replace(chr(39), chr(39) * 2)}')"


@query(
    rf"""
WITH t AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t, regexp_extract(html, '(?is)<html\b[^>]*\blang\s*=\s*["'']?([A-Za-z-]+)', 1) AS l FROM pages)
SELECT page_id, trim(regexp_replace({_UNESC.format(x='t')}, '\s+', ' ', 'g')) AS titulo, l AS idioma FROM t"""
)
def html_title_lang(spark, sf_dir):
    m = H.metadata(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", m["titulo"].alias("titulo"), m["idioma"].alias("idioma"))


def _clean_html_sql() -> str:
    c = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for t in H.BOILERPLATE:
        c = rf"regexp_replace({c}, '(?is)<{t}\b[^>]*>.*?</{t}\s*>', '', 'g')"
    return c


@query(
    rf"""
WITH c AS (SELECT page_id, {_clean_html_sql()} AS h FROM pages),
a AS (SELECT page_id, CASE WHEN regexp_extract(h, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1) <> '' THEN regexp_extract(h, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1) ELSE regexp_extract(h, '(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)', 1) END AS h FROM c),
b AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(h, '(?is)<(?:p|h[1-6]|li|blockquote)\b[^>]*>(.*?)</(?:p|h[1-6]|li|blockquote)\s*>', 1),
  lambda x: trim(regexp_replace({_UNESC.format(x="regexp_replace(x, '<[^>]*>', '', 'g')")}, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM a)
SELECT page_id, CASE WHEN len(l) > 0 THEN md5(array_to_string(l, chr(10))) END AS h, len(l) AS n FROM b"""
)
def html_main_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", H.bounded_text(F.col("html")).alias("t"))
    n = F.when(F.col("t").isNull(), 0).otherwise(F.size(F.split("t", "\n")))
    return p.select("page_id", F.md5("t").alias("h"), n.cast("long").alias("n"))


@query(
    rf"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)(<a\b[^>]*>.*?</a\s*>)', 1)) AS a FROM pages),
l AS (SELECT page_id, regexp_extract(a, '(?is)^<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["'']', 1) AS href, trim(regexp_replace({_UNESC.format(x="regexp_replace(a, '<[^>]*>', '', 'g')")}, '\s+', ' ', 'g')) AS titulo FROM a)
SELECT page_id, href, titulo, count(*) AS n FROM l WHERE href <> '' GROUP BY ALL"""
)
def html_links(spark, sf_dir):
    return H.links(table(spark, sf_dir, "pages")).groupBy("page_id", "href", "titulo").agg(F.count("*").alias("n"))


@query()
def council_blocks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("titulo", H.metadata(F.col("html"))["titulo"])
    docs = pages.select("page_id", "titulo", CO.page_text_lines(F.col("html"), CO.KINDS["Decretos"]["cut"]).alias("lines"))
    return CO.council_documents(docs, "Decretos", id_col="page_id")


# -- corpora and files over rows of the tables --------------------------------------------------


def _numbered(spark, sf_dir) -> DataFrame:
    """Orders as documents: (doc_id, x array of line items in order)."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))


def _numbered_lines(spark, sf_dir) -> DataFrame:
    """(doc_id, n from 1, parte) of each line item, in order."""
    each = _numbered(spark, sf_dir).select("doc_id", F.posexplode("x").alias("n", "x"))
    return each.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), F.col("x.l_partkey").alias("parte"))


def _said(said) -> Column:
    """The lines of a document: those that ``said`` gives for each item's place and part, nulls aside."""
    return F.array_compact(F.flatten(F.transform("x", lambda x, i: said((i + 1).cast("string"), x["l_partkey"], i))))


_NUMBERED_SQL = "n AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_partkey AS parte FROM lineitem)"


@query(
    f"""WITH {_NUMBERED_SQL}, s AS (SELECT *, sum(CASE WHEN parte % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS sec,
  min(CASE WHEN parte % 97 = 0 THEN n END) OVER (PARTITION BY doc_id) AS stop FROM n), k AS (SELECT * FROM s WHERE stop IS NULL OR n < stop),
b AS (SELECT doc_id, n, parte, sec FROM k)
SELECT doc_id, n AS numeral_id, 'Concilio Vaticano II > Constituciones > Orden ' || doc_id || CASE WHEN sec > 0 THEN ' > APÉNDICE' ELSE '' END AS contexto_jerarquico, 'Parte ' || parte || ': sigue el texto.' AS texto FROM b
UNION ALL SELECT doc_id, n, 'Concilio Vaticano II > Declaraciones > Orden ' || doc_id || CASE WHEN sec > 0 THEN ' > APÉNDICE' ELSE '' END, 'Parte ' || parte || ': sigue el texto.' FROM b"""
)
def council_numerals(spark, sf_dir):
    """Numbered paragraphs under annexes, up to the notes, as a constitution and as a declaration."""

    def said(n, part, i):
        head = F.concat(n, F.lit(". Parte "), part.cast("string"), F.lit(":"))
        return F.array(F.when(part % 97 == 0, "NOTAS"), F.when(part % 5 == 0, "A P É N D I C E"), F.lit("CAPÍTULO I"), head, F.lit("Título corto"), F.lit("sigue el texto."))

    docs = _numbered(spark, sf_dir).select("doc_id", F.concat(F.lit("Orden "), "doc_id").alias("titulo"), _said(said).alias("lines"))
    both = [CO.council_documents(docs, kind).select("doc_id", "numeral_id", "contexto_jerarquico", "texto") for kind in ("Constituciones", "Declaraciones")]
    return both[0].unionByName(both[1])


@query(
    f"""WITH {_NUMBERED_SQL}, s AS (SELECT *, min(CASE WHEN parte % 31 = 0 THEN n END) OVER (PARTITION BY doc_id) AS stop FROM n)
SELECT doc_id, n AS numeral_id, 'Dice ''esto'' (de ' || parte || ') y 99 no cuenta.' || CASE WHEN n = stop THEN ' La posesión eterna de Ti mismo...».' ELSE '' END AS texto FROM s WHERE stop IS NULL OR n <= stop"""
)
def compendium_numerals(spark, sf_dir):
    """Numerals behind the signature, with numbers in running text, up to the closing words."""

    def said(n, part, i):
        begin = [F.when(i == 0, x) for x in ("1 Índice de lo que sigue.", "Mons. Giampaolo Crepaldi", "7 antes del primero.")]
        own = [F.concat(n, F.lit(' Dice "esto" ( de '), part.cast("string"), F.lit(" )")), F.lit("corta"), F.lit("y 99 no cuenta.")]
        return F.array(*begin, *own, *[F.when(part % 31 == 0, x) for x in ("La posesión eterna de Ti mismo»...", "8 Nota al pie.")])

    return CO.compendium_documents(_numbered(spark, sf_dir).select("doc_id", _said(said).alias("lines")))


@query(
    """WITH n AS (SELECT p_partkey, p_size, p_name FROM part)
SELECT (3000 + p_partkey)::BIGINT AS canon_id, 'Texto ' || p_name || '.' AS texto FROM n WHERE p_partkey % 3 > 0
UNION ALL SELECT 3000 + p_partkey, 'Nuevo ' || p_name || '.' FROM n WHERE p_partkey % 3 = 0"""
)
def canon_texts(spark, sf_dir):
    """Canons of pages by bold numbers and by marks, of several versions the last."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), "p_name", (F.col("p_partkey") + 3000).cast("string").alias("c"))
    bold = F.concat(F.lit("<p><b>"), "c", F.lit("</b> § 1. Texto <i>"), "p_name", F.lit("</i>. ( n Indica que el texto cambió)</p><hr>fin"))
    mark = F.concat(F.lit("<p>Can. "), "c", F.lit(" - Texto "), "p_name", F.lit(". [Redacción original: otra]</p>"))
    first = CO.canons(p.withColumn("html", F.when(F.col("page_id") % 2 == 0, bold).otherwise(mark))).withColumn("v", F.lit(0))
    again = p.where("page_id % 3 = 0").withColumn("html", F.concat(F.lit("<b>"), "c", F.lit("</b> Nuevo "), "p_name", F.lit(".")))
    rows = first.unionByName(CO.canons(again).withColumn("v", F.lit(1)))
    clean = F.regexp_replace("texto", r" \.$", ".")
    return CO.latest_canons(CO.require_canons(rows, 1), order=["v", "page_id", "seq"]).select("canon_id", clean.alias("texto"))


@query(
    """SELECT 'corpus_' || p_size % 4 AS tipo_corpus, 'Fuente ' || p_size % 4 AS fuente, (row_number() OVER (PARTITION BY p_size % 4 ORDER BY p_partkey) - 1)::INTEGER AS indice, p_partkey AS numeral_id,
  p_type || ' > "x"' AS contexto_jerarquico, p_name AS texto FROM part"""
)
def corpus_files(spark, sf_dir):
    """Parts as items of four corpora, written as master files and read back."""
    kind = (F.col("p_size") % 4).cast("string")
    items = table(spark, sf_dir, "part").select(
        F.concat(F.lit("corpus_"), kind).alias("tipo_corpus"), F.concat(F.lit("Fuente "), kind).alias("fuente"), F.col("p_partkey").alias("indice"), F.col("p_partkey").alias("numeral_id"),
        F.concat("p_type", F.lit(' > "x"')).alias("contexto_jerarquico"), F.col("p_name").alias("texto"),
    )
    path = f"{scratch(spark)}/master-{uuid.uuid4().hex}"
    TB.write_master(items, path)
    return TB.read_master(spark, path, "*.json").select("tipo_corpus", "fuente", "indice", "numeral_id", "contexto_jerarquico", "texto")


@query("""SELECT s_suppkey AS id, s_name || ', "' || s_nationkey || '"; ñ' AS texto, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS saldo FROM supplier""")
def csv_files(spark, sf_dir):
    """Suppliers written as CSV and read back: separators, quotes, nulls."""
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(', "'), "s_nationkey", F.lit('"; ñ')).alias("texto"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal")).alias("saldo"), F.lit(1).alias("otra")
    )
    path = f"{scratch(spark)}/csv-{uuid.uuid4().hex}"
    TB.write_csv(s, path, ["id", "texto", "saldo"])
    return TB.read_csv(spark, path, "id bigint, texto string, saldo double")


_VERDICTS = ["proximo", "distante", "no_definido", "otro"]


@query(
    "SELECT event_id, CASE event_id % 5 "
    + " ".join(f"WHEN {i} THEN '{C.VERDICT_LABELS.get(v, v)} — {C.VERDICT_MESSAGES.get(v, 'Veredicto desconocido.')}'" for i, v in enumerate(_VERDICTS))
    + " ELSE 'Sin veredicto.' END AS linea FROM events"
)
def verdict_lines(spark, sf_dir):
    v = F.get(F.lit(_VERDICTS), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", C.verdict_line(v).alias("linea"))


@query(
    f"""WITH {_NUMBERED_SQL}, l AS (SELECT doc_id, n, CASE WHEN parte % 4 = 0 THEN n END AS own FROM n)
SELECT doc_id, n AS line_no, first_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 250 FOLLOWING)::INTEGER AS siguiente FROM l"""
)
def next_paragraph(spark, sf_dir):
    rows = _numbered_lines(spark, sf_dir)
    line = F.when(F.col("parte") % 4 == 0, F.concat(F.col("n").cast("string"), F.lit(") Uno"))).otherwise(F.concat(F.lit("texto "), F.col("n").cast("string"), F.lit(". no")))
    lines = rows.select("doc_id", F.lit(1).alias("page"), F.col("n").alias("line_no"), line.alias("line"))
    return CL.next_number(lines).select("doc_id", "line_no", "siguiente")


_IMPORTANCES = [(f, round(0.01 * (i + 1), 2), k) for i, (f, k) in enumerate((f, k) for k, fs in SIGNAL_FAMILIES.items() for f in fs)]


@query(
    "WITH v(feature, importance, familia) AS (VALUES " + ", ".join(f"('{f}', {x}::DOUBLE, '{k}')" for f, x, k in _IMPORTANCES) + ", ('otra', 5.0, NULL)) "
    "SELECT familia, round(sum(importance), 6) AS importancia, round(sum(importance) / sum(sum(importance)) OVER (), 6) AS peso FROM v WHERE familia IS NOT NULL GROUP BY 1"
)
def family_importances(spark, sf_dir):
    rows = spark.createDataFrame([(f, x) for f, x, _ in _IMPORTANCES] + [("otra", 5.0)], "feature string, importance double")
    return E.importances_by_family(rows).select("familia", digits(F.col("importancia")).alias("importancia"), digits(F.col("peso")).alias("peso"))


# -- documents -----------------------------------------------------------------------------


def _pages_of(spark, sf_dir) -> DataFrame:
    """Documents as pages: eight documents of a source make one, in order of id."""
    d = table(spark, sf_dir, "documents")
    return d.select((F.col("doc_id") - F.col("doc_id") % 8).alias("doc_id"), (F.col("doc_id") % 8 + 1).cast("int").alias("page"), "text")


@query(
    r"""
WITH l AS (SELECT doc_id - doc_id % 8 AS doc_id, doc_id % 8 + 1 AS page, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> '')) AS line,
  generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), 1) AS i FROM documents),
n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS n FROM l),
k AS (SELECT *, i <= 2 OR i > n - 2 AS border, regexp_replace(lower(line), '\d+', '#', 'g') AS key FROM n),
f AS (SELECT doc_id, count(DISTINCT page) AS pages FROM k WHERE n >= 6 GROUP BY 1),
s AS (SELECT doc_id, key, count(DISTINCT page) AS seen FROM k WHERE n >= 6 AND border GROUP BY 1, 2),
r AS (SELECT s.doc_id, s.key FROM s JOIN f USING (doc_id) WHERE pages >= 2 AND seen >= CASE WHEN pages = 2 THEN 2 ELSE greatest(3, ceil(pages / 2)) END)
SELECT k.doc_id, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY page, i)) AS h FROM k LEFT JOIN r ON r.doc_id = k.doc_id AND r.key = k.key AND border
WHERE r.key IS NULL AND NOT (border AND regexp_matches(line, '(?i)^(?:p[áa]g(?:ina|\.)?\s*)?\d{1,4}(?:\s*(?:de|/)\s*\d{1,4})?$|^[-–—]\s*\d{1,4}\s*[-–—]$')) GROUP BY k.doc_id"""
)
def header_footer_removal(spark, sf_dir):
    docs = CL.whole_documents(CL.drop_headers_footers(CL.page_lines(_pages_of(spark, sf_dir))))
    return docs.select("doc_id", F.size("lines").cast("long").alias("n"), F.md5(F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("h"))


@query(
    r"""
WITH p AS (SELECT doc_id - doc_id % 8 AS doc_id, doc_id % 8 + 1 AS page, string_split(regexp_replace(text, '([a-z]{5})([a-z]{4})', '\1-' || chr(10) || '\2', 'g'), chr(10)) AS l FROM documents),
q AS (SELECT doc_id, page, unnest(list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> '')) AS line,
  generate_subscripts(list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), 1) AS i FROM p),
n AS (SELECT doc_id, page, line, row_number() OVER w - 1 AS k, coalesce(regexp_matches(lag(line) OVER w, '\p{L}-$') AND regexp_matches(line, '^\p{Ll}'), FALSE) AS j,
  lower(regexp_extract(lag(line) OVER w, '(\p{L}+)-$', 1)) AS a, lower(regexp_extract(line, '^(\p{L}+)', 1)) AS b FROM q WINDOW w AS (PARTITION BY doc_id ORDER BY page, i)),
cw AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(line), '\p{L}+(?:-\p{L}+)+')) AS c FROM n),
kw AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(line), '\p{L}+')) AS c FROM n),
f AS (SELECT n.*, j AND EXISTS (SELECT 1 FROM cw WHERE cw.doc_id = n.doc_id AND cw.c = a || '-' || b) AND NOT EXISTS (SELECT 1 FROM kw WHERE kw.doc_id = n.doc_id AND kw.c = a || b) AS keep FROM n),
g AS (SELECT *, sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS line_no, lead(j AND NOT keep) OVER (PARTITION BY doc_id ORDER BY k) AS bare FROM f)
SELECT doc_id, line_no::INTEGER AS line_no, min(page)::INTEGER AS page, md5(string_agg(CASE WHEN bare THEN left(line, length(line) - 1) ELSE line END, '' ORDER BY k)) AS h FROM g GROUP BY doc_id, line_no"""
)
def hyphen_join(spark, sf_dir):
    """Pages whose longer words are broken over two lines, joined again."""
    broken = _pages_of(spark, sf_dir).withColumn("text", F.regexp_replace("text", "([a-z]{5})([a-z]{4})", "$1-\n$2"))
    lines = CL.as_lines(CL.merge_hyphens(CL.whole_documents(CL.page_lines(broken))))
    return lines.select("doc_id", "line_no", "page", F.md5("line").alias("h"))


@query()
def segment_document(spark, sf_dir):
    return SG.segment_documents(CL.prepare_documents(_pages_of(spark, sf_dir)))


@query(
    r"""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 2 AS numbered FROM orders),
l AS (SELECT k, numbered, row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, 'Parte ' || l_partkey || ' que trae el proveedor ' || l_suppkey || '.' AS t FROM o JOIN lineitem ON l_orderkey = k),
c AS (SELECT k, count(*) AS c FROM l GROUP BY 1),
s AS (SELECT l.*, CASE WHEN numbered = 0 AND c >= 3 THEN 'articulado' WHEN numbered = 1 AND c >= 5 THEN 'numerado' ELSE 'ventanas' END AS esquema FROM l JOIN c USING (k)),
x AS (SELECT k, numbered, esquema, n, t, CASE WHEN n % 3 = 1 THEN 'CAPÍTULO ' || (n // 3 + 1) || ' ' ELSE '' END || CASE WHEN numbered = 1 THEN n || '. ' ELSE 'Artículo ' || n || '.- ' END || t AS whole FROM s),
f AS (SELECT k, esquema, n - 1 AS orden, t AS texto, n AS id_norma, CASE WHEN numbered = 1 THEN 'Numeral ' ELSE 'Artículo ' END || n AS etiqueta, 'CAPÍTULO ' || ((n - 1) // 3 + 1) AS contexto FROM x WHERE esquema <> 'ventanas'
  UNION ALL SELECT k, 'ventanas', 0, string_agg(whole, ' ' ORDER BY n), 0, 'Fragmento 1', '' FROM x WHERE esquema = 'ventanas' GROUP BY k),
b AS (SELECT k, count(*) FILTER (len(string_split(texto, ' ')) < 20) AS b FROM f GROUP BY 1)
SELECT k::VARCHAR AS doc_id, esquema, orden::INTEGER AS orden, texto, id_norma::INTEGER AS id_norma, etiqueta, contexto,
  concat_ws(' | ', CASE WHEN esquema = 'ventanas' THEN 'Sin estructura normativa: ventanas de unas 500 palabras.' END, CASE WHEN b > 0 THEN b || ' fragmento(s) tienen menos de 20 palabras.' END) AS avisos
FROM f JOIN b USING (k)"""
)
def segment_articles(spark, sf_dir):
    """Orders as documents: articles, numbered paragraphs or neither, under chapters of three lines."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    orders = items.groupBy(F.col("o_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("items"))

    def said(x, i):
        n = (i + 1).cast("string")
        mark = F.when(F.col("doc_id") % 2 == 1, F.concat(n, F.lit(". "))).otherwise(F.concat(F.lit("Artículo "), n, F.lit(".- ")))
        text = F.concat(mark, F.lit("Parte "), x["l_partkey"].cast("string"), F.lit(" que trae el proveedor "), x["l_suppkey"].cast("string"), F.lit("."))
        return F.array_compact(F.array(F.when(i % 3 == 0, F.concat(F.lit("CAPÍTULO "), (i / 3 + 1).cast("int").cast("string"))), text))

    docs = orders.select("doc_id", F.transform(F.flatten(F.transform("items", said)), lambda t: F.struct(F.lit(1).alias("page"), t.alias("line"))).alias("lines"))
    found = SG.segment_documents(docs)
    return found.select("doc_id", "esquema", "orden", "texto", "id_norma", "etiqueta", F.array_join("contexto", " > ").alias("contexto"), F.array_join("advertencias", " | ").alias("avisos"))


@query(
    r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS i FROM w),
p AS (SELECT doc_id, t, i, (i // 360)::INTEGER AS page, (i % 360) // 180 AS col, (i % 180) // 6 AS r FROM s),
n AS (SELECT doc_id, page, count(*) AS n, bool_or(count(*) >= 229) OVER (PARTITION BY doc_id) AS known FROM p GROUP BY doc_id, page),
l AS (SELECT doc_id, page, col, r, string_agg(t, ' ' ORDER BY i) AS line FROM p JOIN n USING (doc_id, page) WHERE n >= 229 OR (known AND n >= 187) GROUP BY ALL)
SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY col, r) - 1)::INTEGER AS line_no, line FROM l"""
)
def reading_order(spark, sf_dir):
    """Documents' words laid out in two columns, thirty rows a page, and read back: full pages, and last ones with enough on the right."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.words(F.col("text"))).alias("i", "text"))
    n, col, slot = F.col("i") % 360, F.floor((F.col("i") % 360) / 180), F.col("i") % 6
    x0 = 50 + col * 270 + slot * 38
    top = 60 + F.floor((n % 180) / 6) * 14
    words = d.select("doc_id", F.floor(F.col("i") / 360).cast("int").alias("page"), "text", x0.cast("double").alias("x0"), (x0 + 34).cast("double").alias("x1"), top.cast("double").alias("top"), (top + 10).cast("double").alias("bottom"))
    return LA.reorder_columns(words)


@query(
    """WITH u AS (SELECT l_orderkey AS doc_id, l_linenumber + CASE WHEN l_linenumber > 3 THEN 2 ELSE 0 END AS n FROM lineitem), r AS (SELECT doc_id, min(n) AS lo, max(n) AS hi, count(*) AS k, list(DISTINCT n) AS have FROM u GROUP BY 1),
f AS (SELECT doc_id, list_sort(list_filter(range(lo, hi + 1), lambda x: NOT list_contains(have, x::INTEGER))) AS faltan FROM r WHERE k >= 2) SELECT doc_id, array_to_string(faltan, ',') AS faltan FROM f WHERE len(faltan) > 0"""
)
def numbering_gaps(spark, sf_dir):
    u = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") + F.when(F.col("l_linenumber") > 3, 2).otherwise(0)).alias("n"))
    g = CL.numbering_gaps(u).where(F.size("faltan") > 0)
    return g.select("doc_id", F.array_join(F.transform(F.array_sort("faltan"), lambda x: x.cast("string")), ",").alias("faltan"))


@query(
    r"""SELECT source, count(*) AS paginas, round(avg((length(trim(text)) < 20)::INT), 6) AS vacias, sum(length(regexp_replace(text, '[^\p{L}]', '', 'g'))) < 0.40 * sum(length(regexp_replace(text, '\s', '', 'g'))) AS pocas_letras FROM documents GROUP BY source"""
)
def text_quality(spark, sf_dir):
    q = CL.text_quality(table(spark, sf_dir, "documents"), doc="source")
    return q.select("source", "paginas", digits(F.col("fraccion_vacias")).alias("vacias"), "pocas_letras")


# -- thesaurus tools -----------------------------------------------------------------------


@query(
    f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-záéíóúüñ]+') AS toks FROM documents),
n AS (SELECT doc_id, list_transform(toks, lambda x: strip_accents(x)) AS w FROM t),
g AS (SELECT doc_id, 2 AS k, i, w[i : i + 1] AS w FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM n) UNION ALL SELECT doc_id, 3, i, w[i : i + 2] FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM n)),
f AS (SELECT array_to_string(w, ' ') AS phrase, count(DISTINCT doc_id) AS fragmentos, min(doc_id * 100000000 + k * 10000000 + i - 1) AS first FROM g
  WHERE NOT list_contains({STOP}, w[1]) AND NOT list_contains({STOP}, w[len(w)]) AND length(w[1]) >= 3 AND length(w[len(w)]) >= 3
  AND NOT list_has_any(w, {_list(T.FILLER_WORDS)}) AND len(list_filter(w, lambda x: NOT list_contains({STOP}, x) AND length(x) >= 5)) > 0 GROUP BY 1),
b AS (SELECT *, first // 100000000 AS doc_id, (first // 10000000) % 10 AS k, first % 10000000 AS pos FROM f
  WHERE fragmentos >= 12 AND NOT EXISTS (SELECT 1 FROM {FORMS_SQL} WHERE contains(' ' || form || ' ', ' ' || phrase || ' ')) ORDER BY fragmentos DESC, first LIMIT 40)
SELECT array_to_string(toks[pos + 1 : pos + k], ' ') AS frase, fragmentos, array_to_string(toks[greatest(pos - 4, 0) + 1 : pos + k + 4], ' ') AS ejemplo FROM b JOIN t USING (doc_id)"""
)
def candidate_phrases(spark, sf_dir):
    return TH.find_candidates(table(spark, sf_dir, "documents"), TH.forms_table(thesaurus(spark)).select("form"))


@query(
    f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-záéíóúüñ]+') AS toks FROM documents),
n AS (SELECT doc_id, toks, list_transform(toks, lambda x: strip_accents(x)) AS w FROM t),
r(root) AS (VALUES ('tional'), ('worthle')),
d AS (SELECT root, count(*) FILTER (len(list_filter(w, lambda x: starts_with(x, root))) > 0) AS df, count(*) AS n FROM n, r GROUP BY root),
k AS (SELECT root, ln((greatest(n, 1) + 1) / (df + 1)) AS rarity FROM d),
g AS (SELECT doc_id, toks, w, z.z, unnest(range(0, len(w) - z.z + 1)) AS pos FROM n, (VALUES (1), (2), (3), (4)) AS z(z) WHERE len(w) >= z.z AND len(list_filter(w, lambda x: starts_with(x, 'tional') OR starts_with(x, 'worthle'))) > 0),
p AS (SELECT doc_id, pos, w[pos + 1 : pos + z] AS w, array_to_string(w[pos + 1 : pos + z], ' ') AS phrase, array_to_string(toks[pos + 1 : pos + z], ' ') AS spelling FROM g),
q AS (SELECT p.*, (SELECT sum(rarity) FROM k WHERE len(list_filter(p.w, lambda x: starts_with(x, root))) > 0) AS weight FROM p
  WHERE NOT list_contains({STOP}, w[1]) AND NOT list_contains({STOP}, w[len(w)]) AND phrase <> 'tionally worthless' AND len(list_filter(w, lambda x: starts_with(x, 'tional') OR starts_with(x, 'worthle'))) > 0),
f AS (SELECT doc_id, phrase, arg_min(spelling, pos) AS spelling, any_value(weight) AS weight FROM q GROUP BY 1, 2),
s AS (SELECT phrase, spelling, count(*) AS n, any_value(weight) AS weight FROM f GROUP BY 1, 2),
b AS (SELECT phrase, sum(n)::BIGINT AS fragmentos, first(spelling ORDER BY n DESC, spelling DESC) AS frase, any_value(weight) AS weight FROM s GROUP BY 1)
SELECT frase, fragmentos FROM b ORDER BY weight DESC, fragmentos DESC, length(phrase), phrase LIMIT 3"""
)
def suggest_forms(spark, sf_dir):
    return TH.suggest_forms(table(spark, sf_dir, "documents"), "tionally worthless")


@query()
def thesaurus_validate(spark, sf_dir):
    return TH.validate(spark, THESAURUS, table(spark, sf_dir, "documents"), {"A", "B", "C"})


# -- model ---------------------------------------------------------------------------------


@query()
def rf_predict(spark, sf_dir):
    from cotejo.operators import model as M

    data = _feature_rows(spark, sf_dir)
    split = E.grouped_split(data, "dominio")
    fitted = M.train(split.where("not es_test"))
    return M.predict(fitted, split.where("es_test")).select("id", "veredicto", "pred", digits(F.col("probabilidad")).alias("probabilidad"))


@query()
def verify_articles(spark, sf_dir):
    """Every twentieth document, in windows, against all documents as norms, by hashed embeddings."""
    d = table(spark, sf_dir, "documents")
    level = F.get(F.array(*map(F.lit, AUTHORITY_SCALE)), (F.col("doc_id") % 5).cast("int"))
    norms = d.select(F.col("doc_id").alias("norm_id"), F.col("text").alias("texto"), F.col("lang").alias("categoria"), level.alias("nivel_autoridad"))
    articles = d.where("doc_id % 20 = 0").select(F.col("doc_id").alias("article_id"), F.lit("").alias("titulo"), F.col("text").alias("texto"))
    return V.verify(articles, norms, thesaurus(spark))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: premises to features in one plan."""
    return feature_vector(spark, sf_dir)



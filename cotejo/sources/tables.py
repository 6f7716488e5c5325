"""Sources and sinks: corpus files, url tables, append-only caches, the norm index, CSV."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.operators.classify import classify, norm_rows

ITEM = "struct<canon_id:bigint,numeral_id:bigint,contexto_jerarquico:string,texto:string,url_origen:string,categoria:string,nivel_autoridad:double>"
MASTER = f"nivel_jerarquico int, tipo_corpus string, fuente string, fecha_generacion string, datos array<{ITEM}>"
URLS = "id bigint, url string, categoria string, titulo string, relevancia string, dominio string"


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores if its scan has fewer splits than there are: a small file of one row group.

    Large inputs have more splits than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_master(spark: SparkSession, path: str, pattern: str = "corpus_*_v1.json") -> DataFrame:
    """Items of the corpus files in a folder: archivo, tipo_corpus, fuente, indice (from 0) and the item's fields.

    A file that is no corpus gives no items; ``bad_files`` lists those.
    """
    raw = spark.read.schema(MASTER).json(f"{path}/{pattern}", multiLine=True, mode="PERMISSIVE")
    each = raw.select(F.col("_metadata.file_name").alias("archivo"), "tipo_corpus", "fuente", F.posexplode("datos").alias("indice", "i"))
    return each.select("archivo", "tipo_corpus", "fuente", "indice", "i.*")


def bad_files(spark: SparkSession, path: str, pattern: str = "corpus_*_v1.json") -> DataFrame:
    """Names of files in a folder that hold no corpus."""
    raw = spark.read.schema(MASTER).json(f"{path}/{pattern}", multiLine=True, mode="PERMISSIVE")
    return raw.where("datos is null or tipo_corpus is null").select(F.col("_metadata.file_name").alias("archivo"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Texts of all corpus files, in order of file and item; empty texts left out."""
    return read_master(spark, path).where("texto <> ''").select("archivo", "indice", "texto")


def write_master(items: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Items gathered under their corpus, one JSON document a corpus, each in a file of its own, as the reader takes one a file."""
    fields = [f.split(":")[0] for f in ITEM[7:-1].split(",")]
    own = [F.col(c) if c in items.columns else F.lit(None).alias(c) for c in fields]
    gathered = items.groupBy("tipo_corpus", "fuente").agg(F.sort_array(F.collect_list(F.struct("indice", F.struct(*own).alias("i")))).alias("d"))
    gathered.select("tipo_corpus", "fuente", F.current_date().cast("string").alias("fecha_generacion"), F.transform("d", lambda x: x["i"]).alias("datos")).write.mode(mode).option("maxRecordsPerFile", 1).json(path)


def load_master(spark: SparkSession, path: str, *, mode: str = "estatico", scrape=None, backup: str | None = None, attempts: int = 3, wait: float = 5.0) -> DataFrame:
    """Master items by source mode.

    ``estatico`` reads the files under ``path``. ``dinamico`` calls ``scrape``
    for items, up to ``attempts`` times with ``wait`` seconds between, writes
    them to ``path`` and reads them back; if every attempt fails the ``backup``
    folder is read instead, and without one the last error is raised.
    """
    import time

    if mode == "estatico":
        return read_master(spark, path)
    if mode != "dinamico" or scrape is None:
        raise ValueError("mode is estatico, or dinamico with a scraper")
    for attempt in range(attempts):
        try:
            write_master(scrape(), path)
            return read_master(spark, path, "*.json")
        except Exception:  # any failure of a site counts as a failed attempt
            if attempt + 1 < attempts:
                time.sleep(wait)
            elif backup is None:
                raise
    return read_master(spark, backup)


def gold_index(items: DataFrame) -> DataFrame:
    """Master items classified and brought to index rows: the whole ETL as one plan."""
    return norm_rows(classify(items))


def leading_integer(c: Column) -> Column:
    """A text's leading integer, else 0: how a text column sorts as a number."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))


def url_rows(urls: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Url rows without nulls in titulo, relevancia and dominio, the most relevant first."""
    rows = urls.where(F.col("categoria").isin(categories)) if categories else urls
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = rows.select("id", "url", "categoria", empty("titulo"), empty("relevancia"), empty("dominio"))
    return rows.orderBy(leading_integer(F.col("relevancia")).desc(), F.col("id").asc())


def url_key() -> Column:
    """An ascending sort key of url rows: most relevant first, then by id."""
    return F.struct((-leading_integer(F.col("relevancia"))).alias("r"), F.col("id"))


def parse_domains(text: str) -> set[str]:
    """Lower-case domains of an exclusion list; comments and blank lines left out."""
    return {d for d in (line.split("#")[0].strip().lower() for line in text.splitlines()) if d}


def exclude_domains(rows: DataFrame, blocked: DataFrame, *, domain: str = "dominio") -> DataFrame:
    """Rows whose domain is in no case on the list (one column dominio)."""
    own = blocked.select(F.lower(F.trim("dominio")).alias("__d")).distinct()
    return rows.join(own, F.lower(F.coalesce(F.col(domain), F.lit(""))) == F.col("__d"), "left_anti")


# -- append-only caches --------------------------------------------------------------------


def read_cache(spark: SparkSession, path: str, schema: str | T.StructType, key: str = "url") -> DataFrame:
    """The last record of each key in JSON lines; blank and broken lines are skipped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("n"))
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    parsed = lines.where("trim(value) <> ''").withColumn("r", F.from_json("value", kind))
    return latest(parsed.select("r.*", F.struct("f", "n").alias("seq")).where(F.col(key).isNotNull()), key, "seq")


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Of each key the row with the greatest ``seq``: one aggregate, combined before the shuffle."""
    cols = [c for c in rows.columns if c not in (key, seq)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), seq).alias("r")).select(key, "r.*")


def append_cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def compact(spark: SparkSession, path: str, to: str, schema: str | T.StructType, key: str = "url") -> int:
    """Writes one record a key to ``to``; the number of lines that fell away, blank and broken ones too."""
    before = spark.read.text(path).count()
    rows = read_cache(spark, path, schema, key)
    rows.write.mode("overwrite").json(to)
    return before - spark.read.text(to).count()


def pending(urls: DataFrame, cache: DataFrame, key: str = "url") -> DataFrame:
    """Url rows that the cache does not have, failures among what it has."""
    return urls.join(cache.select(key).distinct(), key, "left_anti")


def processed(urls: DataFrame, cache: DataFrame, key: str = "url") -> DataFrame:
    return urls.join(cache.select(key).distinct(), key, "left_semi")


def fetch_pending(urls: DataFrame, cache: DataFrame, fetch, key: str = "url") -> DataFrame:
    """The cache with rows for urls that it lacks; ``fetch`` maps a DataFrame of urls to (url, texto)."""
    return cache.select(key, "texto").unionByName(fetch(pending(urls.select(key).distinct(), cache, key)).select(key, "texto"))


def cache_statistics(cache: DataFrame) -> DataFrame:
    """One row: urls, con_texto, sin_texto."""
    return cache.agg(F.count("*").alias("urls"), F.count("texto").alias("con_texto"), F.count_if(F.col("texto").isNull()).alias("sin_texto"))


# -- the norm index ------------------------------------------------------------------------


def upsert(index: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The index with ``new`` rows in place of those with their ids."""
    rows = index.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    return latest(rows, key, "__v")


def write_index(norms: DataFrame, path: str) -> None:
    """The index as Parquet, one folder a corpus, so a filter on tipo_corpus reads that alone."""
    norms.write.mode("overwrite").partitionBy("tipo_corpus").parquet(path)


def open_index(spark: SparkSession, table: str) -> DataFrame | None:
    """A catalog table, None if there is none."""
    return spark.table(table) if spark.catalog.tableExists(table) else None


def reconcile(expected: DataFrame, indexed: DataFrame, *, key: str = "id", kind: str = "tipo_corpus") -> DataFrame:
    """(tipo, esperado, en_indice, faltantes, huerfanos, ok) of each corpus: one full outer join on the id."""
    a = expected.select(F.col(key).alias("k"), F.col(kind).alias("t")).distinct().withColumn("a", F.lit(1))
    b = indexed.select(F.col(key).alias("k"), F.col(kind).alias("u")).distinct().withColumn("b", F.lit(1))
    both = a.join(b, "k", "full_outer").withColumn("tipo", F.coalesce("t", "u"))
    miss, orphan = F.count_if(F.col("b").isNull()), F.count_if(F.col("a").isNull())
    return both.groupBy("tipo").agg(
        F.count("a").alias("esperado"), F.count("b").alias("en_indice"), miss.alias("faltantes"), orphan.alias("huerfanos"), ((miss == 0) & (orphan == 0)).alias("ok")
    )


# -- CSV -----------------------------------------------------------------------------------


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    rows.select(*columns).write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


# -- PDF -----------------------------------------------------------------------------------

PAGES = "array<struct<page:int,text:string>>"


def read_pdfs(spark: SparkSession, path: str, *, max_bytes: int = 50 << 20, max_pages: int = 2000) -> DataFrame:
    """(doc_id, nombre, estado, pages) of PDF files; estado says why pages are null.

    Text needs a PDF library on the executors; without one every row says so.
    """
    from cotejo.operators.classify import document_id, document_name

    def extract(batch: pa.Array) -> pa.Array:
        try:
            import pypdf
        except ImportError:
            pypdf = None
        import io

        rows = []
        for content in batch.to_pylist():
            pages, state = None, "ok"
            if pypdf is None:
                state = "sin biblioteca PDF"
            elif len(content) > max_bytes:
                state = "demasiado grande"
            else:
                try:
                    doc = pypdf.PdfReader(io.BytesIO(content))
                    if doc.is_encrypted and not doc.decrypt(""):
                        state = "cifrado"
                    elif len(doc.pages) > max_pages:
                        state = "demasiadas páginas"
                    else:
                        pages = [{"page": i, "text": p.extract_text() or ""} for i, p in enumerate(doc.pages, 1)]
                        if not any(p["text"].strip() for p in pages):
                            pages, state = None, "sin texto"
                except Exception as e:  # a broken file is a row, not a failed job
                    state = f"ilegible: {type(e).__name__}"
            rows.append({"estado": state, "pages": pages})
        page = pa.struct([("page", pa.int32()), ("text", pa.string())])
        return pa.array(rows, pa.struct([("estado", pa.string()), ("pages", pa.list_(page))]))

    files = spark.read.format("binaryFile").load(path)
    udf = F.arrow_udf(extract, f"struct<estado:string,pages:{PAGES}>")
    sha = F.sha2("content", 256)
    return files.select(document_id(F.col("content")).alias("doc_id"), document_name(F.lit(None), F.col("path"), sha).alias("nombre"), udf("content").alias("r")).select("doc_id", "nombre", "r.estado", "r.pages")

"""Top-k retrieval by exact cosine similarity, and combined retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: metadata keys that a filter may name.
FILTER_KEYS = ("fuente", "tipo_corpus", "id_norma", "contexto_jerarquico", "categoria", "nivel_autoridad", "url_origen")
#: Premises whose vectors one pass over the norms takes along, fewer if they hold over BLOCK_BYTES; more go in further passes.
BLOCK = 16384
BLOCK_BYTES = 32 << 20
#: Rows and columns of the similarities that a task holds at once.
TILE = 1024
#: Similarities are ranked to so many digits, which engines agree on; ties go by id.
DIGITS = 9


def metadata_filter(df: DataFrame, where: dict | None) -> DataFrame:
    """Equality conjunction over known keys; an unknown key leaves no rows."""
    for key, value in (where or {}).items():
        if key not in FILTER_KEYS:
            return df.where(F.lit(False))
        df = df.where(F.col(key) == value)
    return df


def clamp_similarity(distance: Column) -> Column:
    """1 - distance, held between 0 and 1."""
    return F.least(F.greatest(1 - distance, F.lit(0.0)), F.lit(1.0))


def _best(sims: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k greatest similarities, the smaller name first among equals."""
    spare = k + 16
    if sims.shape[1] <= 2 * spare:
        return np.lexsort((names, -sims), axis=1)[:, :k]
    some = np.argpartition(-sims, spare - 1, axis=1)[:, :spare]
    few, own = np.take_along_axis(sims, some, 1), np.take_along_axis(names, some, 1)
    order = np.lexsort((own, -few), axis=1)[:, :k]
    best = np.take_along_axis(some, order, 1)
    # where equals of the k-th may lie outside the part, the whole row is sorted
    tied = np.take_along_axis(few, order, 1)[:, -1] <= few.min(axis=1)
    if tied.any():
        best[tied] = np.lexsort((names[tied], -sims[tied]), axis=1)[:, :k]
    return best


def _merge(held: tuple[np.ndarray, np.ndarray], first: int, sim: np.ndarray, norm_ids: np.ndarray, own: np.ndarray | None) -> None:
    """Puts what a tile of similarities (rows from ``first`` on) has to add into the k best held of each row.

    One comparison passes over the tile; only what reaches a row's k-th best is looked at again.
    """
    best, names = held
    k = best.shape[1]
    if not np.isfinite(best[first : first + len(sim), 0]).any():
        sim = np.round(sim, DIGITS)
        if own is not None:
            sim[own[first : first + len(sim), None] == norm_ids[None, :]] = -np.inf
        few = _best(sim, np.broadcast_to(norm_ids, sim.shape), k)
        best[first : first + len(sim), : few.shape[1]] = np.take_along_axis(sim, few, 1)
        names[first : first + len(sim), : few.shape[1]] = norm_ids[few]
        return
    rows, cols = np.nonzero(sim >= best[first : first + len(sim), -1:] - 10.0**-DIGITS)
    s, n = np.round(sim[rows, cols], DIGITS), norm_ids[cols]
    rows += first
    good = (s > best[rows, -1]) | ((s == best[rows, -1]) & (n < names[rows, -1]))
    if own is not None:
        good &= own[rows] != n
    rows, s, n = rows[good], s[good], n[good]
    if not len(rows):
        return
    touched = np.unique(rows)
    rows = np.concatenate([np.repeat(touched, k), rows])
    s, n = np.concatenate([best[touched].ravel(), s]), np.concatenate([names[touched].ravel(), n])
    order = np.lexsort((n, -s, rows))
    rows, s, n = rows[order], s[order], n[order]
    begin = np.searchsorted(rows, touched)
    rank = np.arange(len(rows)) - np.repeat(begin, np.diff(np.append(begin, len(rows))))
    stays = rank < k
    best[rows[stays], rank[stays]], names[rows[stays], rank[stays]] = s[stays], n[stays]


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1."""
    x = np.asarray(vectors.flatten().cast(pa.float64())).reshape(len(vectors), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _with_vector(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(pc.fill_null(pc.greater(pc.list_value_length(batch.column(1)), 0), False))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ids, vectors) as bytes, of up to TILE rows each."""
    for batch in batches:
        batch = _with_vector(batch)
        for at in range(0, batch.num_rows, TILE):
            part = batch.slice(at, TILE)
            ids, m = np.asarray(part.column(0)).astype("i8"), _matrix(part.column(1))
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["ids", "vectors"])


def _scan(sent, k: int, skip_same: bool):
    """Map over norms: each task keeps its k best for each premise of the broadcast block, tile by tile."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, matrix = sent.value
        held = np.full((len(own), k), -np.inf), np.full((len(own), k), np.iinfo("i8").max)
        # a first narrow tile finds bounds cheaply, wider ones have little to add
        width = 64
        for batch in batches:
            batch = _with_vector(batch)
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, width)
                at, width = at + width, min(2 * width, TILE)
                norm_ids, x = np.asarray(part.column(0)), _matrix(part.column(1)).T
                for first in range(0, len(own), TILE):
                    _merge(held, first, matrix[first : first + TILE] @ x, norm_ids, own if skip_same else None)
        for first in range(0, len(own), TILE):
            best, names, ids = held[0][first : first + TILE], held[1][first : first + TILE], own[first : first + TILE]
            good = np.isfinite(best)
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], good.shape)[good]), pa.array(names[good]), pa.array(best[good])], ["premise_id", "norm_id", "cosine"])

    return scan


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once: in the cluster's checkpoint folder if there is one, which needs no release, else in the cache."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def retrieve_topk(
    premises: DataFrame,
    norms: DataFrame,
    k: int = 5,
    *,
    premise_id: str = "premise_id",
    norm_id: str = "norm_id",
    vector: str = "embedding",
    max_k: int = 30,
    skip_same: bool = False,
) -> DataFrame:
    """(premise_id, norm_id, similitud, posicion_rag) of each premise's k nearest norms.

    The stated premises go along in blocks of BLOCK vectors; each block is one
    narrow pass over all norms whose tasks keep k rows a premise and one tile of
    similarities, and only those rows are shuffled for the final rank. Vectors
    are computed once, the norms' too if there are several blocks. Null vectors
    match nothing; k is held to ``max_k``, and k < 1 gives no rows. Ties go to
    the smaller norm id.
    """
    spark = norms.sparkSession
    k = min(k, max_k)
    asked = premises.select(F.col(premise_id).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id is not null")
    # vectors are looked at in Python: a filter on them would compute a UDF's vectors twice
    known = norms.select(F.col(norm_id).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id is not null")
    schema = "premise_id bigint, norm_id bigint, cosine double"
    blocks: list = []
    block: list = []

    def send() -> None:
        ids, m = np.concatenate([x[0] for x in block]), np.concatenate([x[1] for x in block])
        blocks.append(spark.sparkContext.broadcast((ids, m)))
        block.clear()

    if k >= 1:
        rows = 0
        # all partitions at once; the iterator alone would compute one after another
        for r in kept(asked.mapInArrow(_pack, "ids binary, vectors binary")).toLocalIterator(prefetchPartitions=True):
            ids = np.frombuffer(r["ids"], "i8")
            m = np.frombuffer(r["vectors"], "f8").reshape(len(ids), -1)
            most = max(1, min(BLOCK, BLOCK_BYTES // (8 * m.shape[1])))
            at = 0
            while at < len(ids):
                take = min(most - rows, len(ids) - at)
                block.append((ids[at : at + take], m[at : at + take]))
                at, rows = at + take, rows + take
                if rows == most:
                    send()
                    rows = 0
        if block:
            send()
    if len(blocks) > 1:
        known = kept(known)
    found = spark.createDataFrame([], schema)
    for sent in blocks:
        found = found.unionByName(known.mapInArrow(_scan(sent, k, skip_same), schema))
    best = W.partitionBy("premise_id").orderBy(F.desc("cosine"), "norm_id")
    ranked = found.withColumn("posicion_rag", F.row_number().over(best)).where(F.col("posicion_rag") <= k)
    return ranked.select("premise_id", "norm_id", clamp_similarity(1 - F.col("cosine")).alias("similitud"), "posicion_rag")


def combine(base: DataFrame, session: DataFrame, n: int) -> DataFrame:
    """Base and session evidence of each premise together, by similarity, base first among equals; n stay."""
    both = base.withColumn("origen_orden", F.lit(0)).unionByName(session.withColumn("origen_orden", F.lit(1)), allowMissingColumns=True)
    order = W.partitionBy("premise_id").orderBy(F.desc("similitud"), "origen_orden", "posicion_rag")
    return both.withColumn("posicion", F.row_number().over(order)).where(F.col("posicion") <= n)


def _hashed(size: int):
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import zlib

        for batch in batches:
            parts = []
            for at in range(0, len(batch), TILE):
                part = batch.slice(at, TILE)
                words = part.flatten().dictionary_encode()
                bins = np.array([zlib.crc32(t.encode()) % size for t in words.dictionary.to_pylist()], "i8")
                lengths = np.asarray(pc.fill_null(pc.list_value_length(part), 0))
                spot = np.repeat(np.arange(len(part)) * size, lengths) + (bins[np.asarray(words.indices)] if len(bins) else 0)
                v = np.bincount(spot, minlength=len(part) * size).astype("f4").reshape(len(part), size)
                norm = np.array([np.linalg.norm(x) for x in v], "f4")
                parts.append((v / np.maximum(norm, np.float32(1e-9))[:, None]).ravel())
            flat = np.concatenate(parts) if parts else np.zeros(0, "f4")
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * size, pa.int32()), pa.array(flat))

    return embed


def hashed_embedding(tokens: Column, size: int = 512) -> Column:
    """A unit bag of words: each token counts in bin crc32 modulo ``size``."""
    return F.arrow_udf(_hashed(size), "array<float>")(tokens)

"""A training corpus from `documents`, in five stages.

Each stage is written as Parquet and read again as the next one's docs. All but
the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm import decontamination, language, mixing, near_duplicates, sharding
from cotejo.llm._common import remove, shared_path, table
from cotejo.llm.queries import MIX_POWER, SHARDS


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what lies too far from every centroid, and texts that are null, empty or without letters.

    Very long texts are read whole; repeated rows and ties are judged alike; an
    empty table, or one without labelled rows, keeps nothing. Columns of any name pass through.
    """
    model = language.fit_centroids(docs)
    found = language.predict_language(docs, model, out_col="__language")
    return found.where(~F.col("__language.rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates, repeated rows and null ids included.

    The smallest id stays, nulls last; texts without words (none reach this
    stage) are in no class. Very long texts are compared whole; an empty table stays empty.
    """
    return near_duplicates.keep_one_of_each(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark window occurs.

    A null or empty text holds none and stays; very long texts are searched
    whole; repeated rows are judged alike; an empty table or benchmark drops nothing.
    """
    found = decontamination.find_benchmark(docs, table(spark, sf_dir, "benchmark"), out_col="__contamination")
    return found.where(F.size("__contamination.hits") == 0).select(*docs.columns)


def _places(docs: DataFrame) -> DataFrame:
    """(__id, position, within_target) in the mix: rows with one id stand together, at the first one's position."""
    keys = docs.select("doc_id", "source")
    mixed = mixing.mix_sources(keys, ["doc_id"], "source", mixing.target_weights(keys, "source", MIX_POWER))
    first = mixed.groupBy(F.col("doc_id").alias("__id")).agg(F.min(F.struct("position", "within_target")).alias("__first"))
    return first.select("__id", "__first.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mix: files by ranges of positions, rows sorted inside.

    Null sources are a source, null and repeated ids keep all their rows, side
    by side; texts are not looked at; an empty table stays empty.
    """
    places = _places(docs).select("__id", F.col("position").alias("__position"))
    placed = docs.join(places, docs["doc_id"].eqNullSafe(places["__id"]))
    return placed.repartitionByRange("__position").sortWithinPartitions("__position").select(*[docs[c] for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard, by jump hash of its id, and its place in the mix.

    Adds shard, position (in the whole mix), within_target (no source has run
    out before it) and slot (gapless in the shard, by position). Readers deal
    files out by size, so the order is in these columns; the mix depends on the
    rows' ids and sources only, and gives the positions that mix() sorted by.
    Rows with one id, and those with none, share a place and a shard; columns
    with the added names are replaced; an empty table stays empty.
    """
    places = sharding.number_slots(sharding.assign_shards(_places(docs), "__id", SHARDS), "shard", ["position"])
    added = ["shard", "position", "within_target", "slot"]
    placed = docs.join(places, docs["doc_id"].eqNullSafe(places["__id"]))
    return placed.select(*[docs[c] for c in docs.columns if c not in added], *[places[c] for c in added])


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: The stages hold a learned model and hashes that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`; a stage's files go once the next one's are written.

    Only the last but one stays, which the result reads.
    """
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if read:
            remove(spark, read)
        docs, read = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)

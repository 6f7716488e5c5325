"""Substring dedup: repeated windows of words, by Rabin-Karp hashes.

Every window of 13 words gets a polynomial hash. A mapper settles windows that
repeat within its group of documents and sends each hash of the group on once,
with the group's smallest document; the task of a hash range finds the smallest
document of all and answers the groups' owners. So a window that occurs in a
third of all documents costs one entry a group. Each document then merges its
repeated windows into maximal removal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm._common import partitions
from cotejo.llm._exchange import MIX, mixed, pack, starts, unpack

WINDOW = 13
#: Words of the documents that one mapper settles together.
GROUP_WORDS = 750_000
#: Stands for a null id, which goes before all others.
NO_ID = -(1 << 63)
RESULT = "struct<n_words:bigint,n_removed:bigint,removed:array<struct<start:bigint,end:bigint>>,kept:string>"


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words, which are runs of bytes other than space and \\t to \\r."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))


def window_hashes(words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Polynomial hash of each window of consecutive words, modulo 2^64 with an odd base."""
    n = words.size - window + 1
    if n <= 0:
        return words[:0]
    h = words[:n].copy()
    for j in range(1, window):
        h *= MIX
        h += words[j : j + n]
    return mixed(h)


def _by_document(docs: np.ndarray, keys: np.ndarray, ranges: int) -> list[tuple[int, bytes]]:
    """Entries packed by ranges of document ids, so that a range has whole documents."""
    return list(pack(keys, docs, ranges, by_owner=True))


_SENT = pa.schema([("p", pa.int32()), ("settled", pa.bool_()), ("block", pa.binary())])
_ANSWER = pa.schema([("p", pa.int32()), ("block", pa.binary())])
_FOUND = pa.schema([("doc", pa.int64()), ("hashes", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _settle(docs: list[tuple[int, np.ndarray]], ranges: int) -> pa.RecordBatch | None:
    """One group's entries by hash range, and what repeats inside the group by range of documents."""
    docs = [d for d in docs if d[1].size]
    if not docs:
        return None
    docs.sort(key=lambda d: d[0])
    ids = np.array([d[0] for d in docs], "i8")
    keys = np.concatenate([d[1] for d in docs])
    of = np.repeat(np.arange(len(docs), dtype="i4"), [d[1].size for d in docs])
    order = np.argsort(keys)
    keys, of = keys[order], of[order]
    at = starts(keys)
    first = np.minimum.reduceat(of, at)
    least = np.repeat(ids[first], np.diff(np.append(at, keys.size)))
    own = ids[of]
    again = own > least
    rows = [(p, False, b) for p, b in pack(keys[at], ids[first], ranges)]
    rows += [(p, True, b) for p, b in _by_document(own[again], keys[again], ranges)]
    return _batch(rows, _SENT)


def _sender(window: int, ranges: int, group_words: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int, np.ndarray]] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    docs.append((doc, window_hashes(word_hashes(text), window)))
                    held += docs[-1][1].size
                    if held >= group_words:
                        if (out := _settle(docs, ranges)) is not None:
                            yield out
                        docs, held = [], 0
        if (out := _settle(docs, ranges)) is not None:
            yield out

    return send


def _answerer(ranges: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Passes settled blocks on; of the range's entries, those with a smaller document elsewhere."""
        entries = []
        for batch in batches:
            settled = batch.filter(batch.column(1))
            if settled.num_rows:
                yield pa.RecordBatch.from_arrays([settled.column(0), settled.column(2)], schema=_ANSWER)
            entries += [unpack(b) for b in batch.filter(pa.compute.invert(batch.column(1))).column(2).to_pylist()]
        if not entries:
            return
        keys, owners = (np.concatenate(x) for x in zip(*entries, strict=True))
        del entries
        order = np.argsort(keys)
        keys, owners = keys[order], owners[order]
        at = starts(keys)
        least = np.repeat(np.minimum.reduceat(owners, at), np.diff(np.append(at, keys.size)))
        again = owners > least
        if again.any():
            yield _batch(_by_document(owners[again], keys[again], ranges), _ANSWER)

    return answer


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range of documents: a row for each, with all its repeated windows' hashes."""
    entries = [unpack(b) for batch in batches for b in batch.column(1).to_pylist()]
    if not entries:
        return
    keys, docs = (np.concatenate(x) for x in zip(*entries, strict=True))
    del entries
    order = np.argsort(docs)
    docs, keys = docs[order], keys[order]
    at = starts(docs)
    end = np.append(at, docs.size)[1:]
    for i in range(0, at.size, 2000):
        rows = [(int(docs[a]), np.unique(keys[a:b]).tobytes()) for a, b in zip(at[i : i + 2000], end[i : i + 2000], strict=True)]
        yield _batch(rows, _FOUND)


def _cutter(window: int):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(span)), ("kept", pa.string())])

    def cut_out(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, hashes in batches:
            rows = []
            for text, found in zip(texts.cast(pa.binary()).to_pylist(), hashes.to_pylist(), strict=True):
                words = text.split() if text else []
                spans: list[dict] = []
                if found and len(words) >= window:
                    own = window_hashes(word_hashes(text), window)
                    hit = np.isin(own, np.frombuffer(found, "u8"))
                    edge = np.zeros(len(words) + 1, "i8")
                    edge[:-window] += hit
                    edge[window:] -= hit
                    gone = np.r_[False, np.cumsum(edge[:-1]) > 0, False]
                    turn = np.flatnonzero(gone[1:] != gone[:-1])
                    spans = [{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)]
                kept, at = [], 0
                for s in spans:
                    kept += words[at : s["start"]]
                    at = s["end"]
                kept += words[at:]
                rows.append({"n_words": len(words), "n_removed": len(words) - len(kept), "removed": spans, "kept": b" ".join(kept).decode()})
            yield pa.array(rows, kind)

    return cut_out


def remove_repeats(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    out_col: str = "dedup",
    window: int = WINDOW,
    group_words: int = GROUP_WORDS,
) -> DataFrame:
    """``id_col`` with a struct: n_words, n_removed, removed spans and the kept text.

    A word is removed if a window over it also starts in a document with a
    smaller integer id; windows are judged on the input. removed holds maximal
    word intervals [start, end); kept the other words joined by one space.
    Null and empty texts have no words; a null id goes before all ids, so its
    row loses nothing; rows with one id never remove each other's words. Other
    columns are ignored, an empty table gives no rows.

    Each group's hashes cross the network once (about 9 bytes a window), those
    of repeated windows twice more, and the texts once, to meet them. Equal 64-bit hashes count as
    equal windows.
    """
    spark = df.sparkSession
    ranges = partitions(spark)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text"))
    sent = rows.select("doc", "text").mapInArrow(_sender(window, ranges, group_words), "p int, settled boolean, block binary")
    answers = sent.repartitionById(ranges, "p").mapInArrow(_answerer(ranges), "p int, block binary")
    found = answers.repartitionById(ranges, "p").mapInArrow(_gather, "doc bigint, hashes binary")
    cut_out = F.arrow_udf(_cutter(window), RESULT)
    met = rows.join(found, "doc", "left")
    return met.select(F.col("id").alias(id_col), cut_out("text", "hashes").alias(out_col))

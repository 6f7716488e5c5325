"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of benchmark words. Patterns of one length share a shift
table on blocks of two words: a block that ends no pattern tells how far the
search may jump. A block with shift 0 selects a bucket by its hash; within the
bucket the pattern's first block selects strings, which are compared directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm._common import ascii_lower, shared_path, stored

WINDOW = 10
#: Benchmark bytes that one broadcast pattern set holds; larger benchmarks go in blocks.
#: The tables take about 12 bytes for each of the block's bytes, in each worker.
BLOCK_BYTES = 16 << 20

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _KEEP else 32 for b in range(256)
)
# A word: ASCII letters and digits and what is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULT = "struct<n_words:bigint,hits:array<struct<start:bigint,end:bigint>>,items:array<string>>"
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and non-ASCII characters."""
    return text.translate(_WORD_BYTES).split() if text else []


class _OneLength:
    """Shift table and buckets for the patterns of one length, in packed arrays.

    seq holds word numbers, at the places in it where the patterns begin, and
    ends of the stretches (items) they lie in. A block of two words (one, for
    patterns of one word) that ends at word i of a stretch is followed by at
    least length - i words to the nearest end of a pattern there, so one pass
    over the stretches gives all shifts.
    """

    def __init__(self, length: int, seq: np.ndarray, at: np.ndarray, stretches: list[tuple[int, int]], n_words: int):
        self.m, self.b, self.words = length, min(2, length), n_words
        self.skip = length - self.b + 1
        keys = [self.blocks(seq[a:e]) for a, e in stretches]
        shift = [np.maximum(0, length - self.b - np.arange(len(k))) for k in keys]
        key, shift = np.concatenate(keys), np.concatenate(shift)
        order = np.lexsort((shift, key))
        key, shift = key[order], shift[order]
        new = np.r_[True, key[1:] != key[:-1]]
        self.key, self.shift = key[new], shift[new].astype("u1" if length < 256 else "i4")
        # buckets: the patterns by their last block, in a bucket by their first
        last, first = self._ends(seq, at)
        order = np.lexsort((first, last))
        self.last, self.first, self.at = last[order], first[order], at[order].astype("i4" if len(seq) < 1 << 31 else "i8")

    def blocks(self, ids: np.ndarray) -> np.ndarray:
        """The number of each block, by its first word; -1 where a word is of no pattern."""
        if self.b == 1:
            return ids
        return np.where((ids[:-1] < 0) | (ids[1:] < 0), -1, ids[:-1] * self.words + ids[1:])

    def _ends(self, seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.b == 1:
            return seq[at], seq[at]
        end = at + self.m
        return seq[end - 2] * self.words + seq[end - 1], seq[at] * self.words + seq[at + 1]

    def find(self, ids: np.ndarray, seq: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, place of the pattern in seq) of every occurrence."""
        n = ids.size
        if n < self.m:
            return
        block = self.blocks(ids)
        near = np.minimum(np.searchsorted(self.key, block), self.key.size - 1)
        jump = np.where(self.key[near] == block, self.shift[near], self.skip)
        if jump.min() > 0:
            return
        end, jumps = self.m - self.b, jump.tolist()  # block numbers, of the window's last block
        while end < len(jumps):
            if jumps[end]:
                end += jumps[end]
                continue
            start = end - (self.m - self.b)
            a, z = np.searchsorted(self.last, block[end]), np.searchsorted(self.last, block[end], "right")
            low = a + np.searchsorted(self.first[a:z], block[start])
            high = a + np.searchsorted(self.first[a:z], block[start], "right")
            for p in self.at[low:high].tolist():
                if np.array_equal(seq[p : p + self.m], ids[start : start + self.m]):
                    yield start, p
            end += 1


class WuManber:
    """All windows of ``items`` (id, text), searched in one word list at a time.

    Built once, on the driver; what is sent are arrays: word numbers, shifts,
    buckets, and the distinct words as one string, numbered again by each worker.
    """

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        ids: dict[bytes, int] = {}
        parts, self.items = [], []
        for item, text in items:
            w = words(text)
            if w:
                parts.append(np.fromiter((ids.setdefault(x, len(ids)) for x in w), "i8", len(w)))
                self.items.append(item)
        self.vocabulary = b" ".join(ids)
        self.seq = np.concatenate(parts) if parts else np.zeros(0, "i8")
        self.ends = np.cumsum([len(x) for x in parts])
        starts = self.ends - [len(x) for x in parts] if parts else []
        lengths: dict[int, list[tuple[int, int]]] = {}
        for a, e in zip(starts, self.ends, strict=True):
            lengths.setdefault(int(min(window, e - a)), []).append((int(a), int(e)))
        self.searches = []
        for m, stretches in sorted(lengths.items()):
            at = np.concatenate([np.arange(a, e - m + 1) for a, e in stretches])
            self.searches.append(_OneLength(m, self.seq, at, stretches, len(ids)))
        self._ids: dict[bytes, int] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_ids": None, "seq": self.seq.astype("i4")}

    def search(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words; merged word spans inside occurrences; ids of their items."""
        if self._ids is None:
            self._ids = {w: i for i, w in enumerate(self.vocabulary.split())}
        w = words(text)
        if not w or not self.searches:
            return len(w), [], []
        known = self._ids.get
        ids = np.fromiter((known(x, -1) for x in w), "i8", len(w))
        spans: list[tuple[int, int]] = []
        items: set[str | None] = set()
        for s in self.searches:
            for start, place in s.find(ids, self.seq):
                spans.append((start, start + s.m))
                items.add(self.items[int(np.searchsorted(self.ends, place, "right"))])
        merged: list[tuple[int, int]] = []
        for start, end in sorted(spans):
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((start, end))
        return len(w), merged, sorted(x for x in items if x is not None)


def _search(sent, texts: pa.Array) -> pa.Array:
    found = (sent.value.search(t) for t in texts.cast(pa.binary()).to_pylist())
    return pa.array([{"n_words": n, "hits": [{"start": a, "end": b} for a, b in hits], "items": items} for n, hits, items in found], _ARROW)


def _searcher(sent):
    """The search as a column; a worker keeps the broadcast tables over its tasks."""

    @F.arrow_udf(RESULT)
    def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield _search(sent, batch)

    return search


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    out_col: str = "contamination",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with a struct column ``out_col``: n_words, hits, items.

    hits are the merged word spans [start, end) inside occurrences of a window;
    items the ids (as strings, sorted, distinct) of items with such windows.
    A null or empty text has no words; an item without words matches nothing;
    an item with fewer words than ``window`` is one window. A null item id hits
    words but names no item. Repeated items and rows are judged alike; an
    existing column ``out_col`` is replaced.

    Very long texts are searched whole. A benchmark of up to ``block_bytes``
    (measured) is one narrow pass over the texts, without a shuffle. A larger
    one goes block by block, one after the other: the driver builds a block's
    tables, a narrow pass looks it up in all texts, what is found is stored
    by the text's hash, and the tables are released; so one block is held at
    a time by the driver and by each worker. In the end the texts meet what was found.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.col(item_col).cast("string").alias("id"), F.col(item_text_col).cast("binary").alias("t")
    ).where("t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def tables(k: int):
        own = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == k) if blocks > 1 else items
        return spark.sparkContext.broadcast(WuManber([(r[0], bytes(r[1])) for r in own.toLocalIterator()], window))

    if blocks == 1:
        return docs.withColumn(out_col, _searcher(tables(0))(F.col(text_col)))
    texts = docs.select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("__h"), F.length(text_col).alias("__l")).where("t is not null")
    found = None
    for k in range(blocks):
        sent = tables(k)
        one = texts.withColumn("c", _searcher(sent)(F.col("t"))).where(F.size("c.hits") > 0).select("__h", "__l", "c.hits", "c.items").dropDuplicates(["__h", "__l"])
        one = stored(one, shared_path(spark, "benchmark-block"))
        sent.destroy()
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("__h", "__l").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("__hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"))
    rows = docs.withColumns({"__h": F.xxhash64(text_col), "__l": F.length(text_col)}).join(found, ["__h", "__l"], "left")
    n_words = F.size(F.regexp_extract_all(F.coalesce(ascii_lower(F.col(text_col)), F.lit("")), F.lit(WORD), F.lit(0)))
    hits = F.aggregate("__hits", F.array().cast("array<struct<start:bigint,end:bigint>>"), _merged)
    whole = F.struct(n_words.cast("long").alias("n_words"), F.coalesce(hits, F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("hits"), F.coalesce("__items", F.array().cast("array<string>")).alias("items"))
    return rows.withColumn(out_col, whole).drop("__h", "__l", "__hits", "__items")


def _merged(spans, x):
    """Sorted spans so far with one more: it joins the last if they touch."""
    last = F.try_element_at(spans, F.lit(-1))
    wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
    return F.when((F.size(spans) > 0) & (x["start"] <= last["end"]), F.concat(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(spans, F.array(x)))


def hit_words(hits):
    """Number of word positions inside the spans ``hits`` (which may overlap)."""
    spots = F.transform(hits, lambda s: F.sequence(s["start"], s["end"] - 1))
    return F.size(F.array_distinct(F.flatten(spots))).cast("long")

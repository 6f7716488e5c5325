"""Document fingerprints by closed syncmers, in DataFrame functions only.

A text is read as units: words of at most 16 characters between spaces; a
longer run, and text in scripts without spaces, is cut by its own characters.
Of all k-mers of units, those are anchors whose smallest s-mer, by hash,
stands at either edge. Where a unit ends and whether a k-mer is an anchor
depends on the characters at that place alone, never on an offset or on the
text's length, so an edit elsewhere moves no anchor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cotejo.llm._common import partitions

#: A k-mer holds three s-mers: it is an anchor unless the middle one is the smallest alone.
K, S = 4, 2

# A character of scripts without spaces: Thai to Lao, Burmese, Khmer, and from CJK
# radicals on (ideographs, kana, hangul, full-width forms) is a unit of its own.
_UNSPACED = r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{D7FF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{3FFFF}"
_WORD = rf"(?<!\S)[^\s{_UNSPACED}]{{1,16}}(?!\S)"
# Elsewhere a unit is a run of characters of rising class: the cut between two
# characters depends on those two alone, and no unit is longer than four.
_CLASSES = (r"[!-*,-.:-@\[-`{-~]", "[B-DFGJKPQSTVXZb-dfgjkpqstvxz0-4+/]", "[HLMNRWYhlmnrwy5-9]", "[AEIOUaeiou]")
_RISING = "|".join(c + "".join(f"{d}?" for d in _CLASSES[i + 1 :]) for i, c in enumerate(_CLASSES))
UNIT = rf"{_WORD}|{_RISING}|\S"


def add_fingerprint(df: DataFrame, text_col: str, anchors_col: str, at_col: str | None = None) -> DataFrame:
    """``df`` with the distinct anchor hashes of each whole text, by first place.

    ``anchors_col`` array<int>; ``at_col``, if named, array<int> with the unit
    index of every anchor, repeats included. Any 2k-s-1 = 5 units hold an
    anchor; a text of k units or more without one gives all its (one or two)
    k-mers, one of fewer units the hash of them all, and a null, empty or
    blank one none. Very long texts are read whole, in arrays of their units.
    Equal texts and repeated rows have equal anchors; an empty table gives an
    empty one; columns of these names are replaced. A narrow step.
    """
    x = "__syncmer_"
    u, s, at = (F.col(x + c) for c in ("u", "s", "at"))
    n = F.size(u)
    every = F.sequence(F.lit(0), F.greatest(n - K, F.lit(0)))
    edge = F.filter(every, lambda i: F.least(F.get(s, i), F.get(s, i + 2)) <= F.get(s, i + 1))
    steps = [
        {x + "u": F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(UNIT), F.lit(0)), lambda v: F.xxhash64(v))},
        {x + "s": F.zip_with(u, F.slice(u, 2, F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))},
        {x + "at": F.when(n >= K, edge)},
        {x + "at": F.when(F.size(at) > 0, at).when(n >= K, every)},
        # s-mers i and i + 2 hold all units of k-mer i
        {anchors_col: F.array_distinct(F.coalesce(F.transform(at, lambda i: F.hash(F.get(s, i), F.get(s, i + 2))), F.when(n > 0, F.array(F.hash(u))).otherwise(F.array().cast("array<int>"))))},
    ]
    if at_col:
        steps.append({at_col: F.coalesce(at, F.when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))})
    for step in steps:
        df = df.withColumns(step)
    return df.drop(*[x + c for c in ("u", "s", "at")])


def likeness(a: Column, b: Column) -> Column:
    """Shared share of two distinct anchor arrays, 0 to 1; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both.cast("double") / either)


def as_text(anchors: Column) -> Column:
    """Eight hexadecimal digits an anchor, in order."""
    return F.array_join(F.transform(anchors, lambda h: F.lpad(F.hex(h.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def _below(bounds: list[int], key: Column, equal: bool) -> Column:
    """How many of the sorted ``bounds`` are below ``key`` (or equal): a coarse scan, then one stretch."""
    step = max(1, int(len(bounds) ** 0.5))
    under = (lambda b: b <= key) if equal else (lambda b: b < key)
    coarse, fine = (F.lit(x).cast("array<bigint>") for x in (bounds[::step], bounds))
    stretch = F.greatest(F.size(F.filter(coarse, under)) - 1, F.lit(0)) * step
    return stretch + F.size(F.filter(F.slice(fine, stretch + 1, F.lit(step)), under))


def with_next(df: DataFrame, key_col: str, cols: list[str], tie: Column, prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """``df`` with ``next_<c>`` of the row that follows by ``key_col``; the last is followed by the first.

    Rows with one key go in an order by a hash of ``tie``, null keys come first.
    ``prepare`` is a narrow step that adds columns (``cols`` may name them)
    once the rows stand in order, so that only the rows' own columns travel.
    A row that stands alone follows itself; an empty table stays empty; columns
    named ``next_<c>`` are replaced.

    No global sort in one task: approximate quantiles of the key (as many as
    four times the shuffle partitions, the only values that reach the driver)
    cut the order into blocks, and a key that fills several of them is cut on
    by the hash of ``tie``. A window looks ahead inside each block, and a copy
    of each block's first row stands behind the block before it.
    """
    n = 4 * partitions(df.sparkSession)
    key = F.col(key_col)
    seen = df.select(
        F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("q"), F.count(F.when(key.isNull(), 1)).alias("nulls"), F.count("*").alias("rows")
    ).first()
    bounds = sorted(seen.q or [0])
    apart = F.xxhash64(tie)
    share = apart.bitwiseAND(F.lit((1 << 31) - 1)) / F.lit(float(1 << 31))
    low, high = _below(bounds, key, False), _below(bounds, key, True)
    empty = -(-n * seen.nulls // max(1, seen.rows))
    own = df.withColumns({"__low": low, "__high": high, "__share": share, "__tie": apart, "__copy": F.lit(False)})
    within = F.when(key.isNull(), F.floor(F.col("__share") * empty) - empty).otherwise(F.col("__low") + F.floor(F.col("__share") * (F.col("__high") - F.col("__low") + 1)))
    own = own.withColumn("__block", within.cast("int")).drop("__low", "__high")
    # null keys compare as smaller than any other
    firsts = own.groupBy("__block").agg(F.min(F.struct(key.alias("k"), F.col("__share").alias("s"), F.col("__tie").alias("t"))).alias("f"))
    # one row a block: bounded by n, so one small task and a broadcast
    order = W.orderBy("__block")
    before = F.coalesce(F.lag("__block").over(order), F.max("__block").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    heads = firsts.select(F.col("f.k").alias("__k"), F.col("f.s").alias("__s"), F.col("f.t").alias("__t"), before.alias("__to"))
    same = key.eqNullSafe(F.col("__k")) & (F.col("__share") == F.col("__s")) & (F.col("__tie") == F.col("__t"))
    copies = own.join(F.broadcast(heads), same).withColumns({"__block": F.col("__to"), "__copy": F.lit(True)})
    copies = copies.drop("__k", "__s", "__t", "__to").dropDuplicates(["__block"])
    by = [F.col("__copy"), key.asc_nulls_first(), F.col("__share"), F.col("__tie")]
    rows = own.unionByName(copies).repartition("__block").sortWithinPartitions("__block", *by)
    rows = prepare(rows)
    ahead = W.partitionBy("__block").orderBy(*by)
    out = rows.withColumns({f"next_{c}": F.lead(c).over(ahead) for c in cols})
    return out.where("not __copy").drop("__block", "__copy", "__share", "__tie")

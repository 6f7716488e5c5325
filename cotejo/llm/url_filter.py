"""URL filter rules in a sorted digest array.

The rules' 64-bit xxhash keys stand sorted in an array, beside their full
strings, in one file that the driver builds and Spark hands to every executor,
whose workers all map it: one copy in a machine's memory. A batch of urls turns into candidate strings (every host
suffix with every path prefix of a length that some rule has); their digests
are probed by one vectorised binary search, and each digest found is confirmed
against the stored string, so a digest collision can't decide.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.llm._common import ascii_lower

#: Bytes of rule strings that go into the mapped file; a larger list is joined instead.
MAX_BYTES = 64 << 20
RESULT = "struct<rule:string,verdict:string>"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to / ? # or end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ? # or end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _keyed(rules: Iterable[tuple[str, bool]]) -> list[tuple[int, bytes, bool]]:
    """(digest, string, blocked) in order of digest; of a repeated rule, a block wins."""
    kept: dict[bytes, bool] = {}
    for rule, blocked in rules:
        key = rule.encode()
        kept[key] = kept.get(key, False) or blocked
    return sorted((xxhash.xxh64_intdigest(k), k, b) for k, b in kept.items())


def packed(rules: Iterable[tuple[str, bool]]) -> bytes:
    """The file's bytes: numbers of rules, of path lengths and of the longest host's bytes; path lengths; digests, ends of the strings, blocked flags, strings."""
    keyed = _keyed(rules)
    ends = np.cumsum([0, *(len(k) for _, k, _ in keyed)])
    hosts = [len(k.split(b"/", 1)[0]) for _, k, _ in keyed]
    lengths = sorted({len(k) - h for (_, k, _), h in zip(keyed, hosts, strict=True)})
    head = np.array([len(keyed), len(lengths), max(hosts, default=0), *lengths], "<u8")
    parts = (head, np.array([d for d, *_ in keyed], "<u8"), ends.astype("<u8"), np.array([b for *_, b in keyed], "u1"))
    return b"".join([*(p.tobytes() for p in parts), *(k for _, k, _ in keyed)])


class DigestArray:
    """Sorted digests, string pool and verdicts of rules over a mapped file, or any buffer of its bytes."""

    def __init__(self, data: np.ndarray):
        """data: the bytes of ``packed`` as an array, mapped or not; nothing is copied but the path lengths."""
        n, lengths, self.longest_host = (int(x) for x in data[:24].view("<u8"))
        at = 24 + 8 * lengths
        self.path_lengths = data[24:at].view("<u8").tolist()
        self.digests = data[at : at + 8 * n].view("<u8")
        self.ends = data[at + 8 * n : at + 8 + 16 * n].view("<u8")
        self.blocked = data[at + 8 + 16 * n : at + 8 + 17 * n]
        self.pool = data[at + 8 + 17 * n :]

    def rule(self, i: int) -> bytes:
        return self.pool[int(self.ends[i]) : int(self.ends[i + 1])].tobytes()

    def candidates(self, host: bytes, path: bytes) -> Iterator[bytes]:
        """Host suffixes at label borders, as far as a rule's host can reach, with every path prefix of a rule's path length."""
        heads = [path[:n] for n in self.path_lengths if n <= len(path)]
        at = 0 if len(host) <= self.longest_host else host.find(b".", len(host) - self.longest_host - 1) + 1
        if at or len(host) <= self.longest_host:
            while True:
                for head in heads:
                    yield host[at:] + head
                at = host.find(b".", at) + 1
                if not at:
                    break

    def match(self, hosts: list[bytes], paths: list[bytes]) -> list[tuple[bytes, bool] | None]:
        """The longest fitting rule of each url and whether it blocks."""
        best: list[tuple[bytes, bool] | None] = [None] * len(hosts)
        if not self.digests.size:
            return best
        strings: list[bytes] = []
        owner: list[int] = []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            strings += self.candidates(host, path)
            owner += [i] * (len(strings) - len(owner))
        keys = np.fromiter(map(xxhash.xxh64_intdigest, strings), "u8", len(strings))
        low = np.searchsorted(self.digests, keys, "left")
        high = np.searchsorted(self.digests, keys, "right")
        for c in np.flatnonzero(high > low):
            for k in range(low[c], high[c]):
                rule, i = self.rule(k), owner[c]
                if rule == strings[c] and (best[i] is None or len(rule.decode()) > len(best[i][0].decode())):
                    best[i] = (rule, bool(self.blocked[k]))
        return best


#: The array that this worker has mapped last, by file name.
_mapped: dict[str, DigestArray] = {}


def _array(name: str) -> DigestArray:
    if name not in _mapped:
        _mapped.clear()
        _mapped[name] = DigestArray(np.memmap(SparkFiles.get(name), "u1", "r"))
    return _mapped[name]


def _handed_out(spark, rules: list[tuple[str, bool]]) -> str:
    """Name of the file with the packed rules, which Spark's file server brings to every executor that asks."""
    folder = tempfile.mkdtemp(prefix="url-rules-")  # the driver's own: the source that its file server reads
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = f"url-rules-{uuid.uuid4().hex}"
    with open(os.path.join(folder, name), "wb") as f:
        f.write(packed(rules))
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def judge_urls(
    df: DataFrame,
    rules: Iterable[tuple[str, str]] | DataFrame,
    *,
    host_col: str = "host",
    path_col: str = "path",
    rule_col: str = "rule",
    verdict_col: str = "verdict",
    default: str = "allow",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """``df`` with the rule that decides each url (null: none) and its verdict.

    rules: (verdict, host/path) pairs, verdict ``allow`` or ``block``, or a
    DataFrame with columns verdict and rule. A rule fits its host and all
    subdomains if the path starts with the rule's path; the longest (in
    characters) wins, and of a rule given with both verdicts the block.
    A url without a fitting rule, null and empty ones too, gets ``default``.
    Repeated rows are judged alike; very long urls cost no more than the longest
    rule asks for; an empty table gives an empty one, an empty list the default
    everywhere; existing output columns are replaced.

    A list of rules up to ``max_bytes`` (measured) is mapped by the workers: no
    shuffle. A larger one is joined: each row's candidate strings meet the rules by equality.
    """
    spark = df.sparkSession
    if isinstance(rules, DataFrame):
        total = rules.agg(F.sum(F.octet_length("rule"))).first()[0] or 0
        if total > max_bytes:
            return _by_join(df, rules, host_col, path_col, rule_col, verdict_col, default)
        rules = [(r["verdict"], r["rule"]) for r in rules.where("rule is not null").toLocalIterator()]
    held = [(rule, verdict == "block") for verdict, rule in rules]
    if sum(len(r) for r, _ in held) > max_bytes:
        rows = spark.createDataFrame([(v, r) for r, v in ((r, "block" if b else "allow") for r, b in held)], "verdict string, rule string")
        return _by_join(df, rows, host_col, path_col, rule_col, verdict_col, default)
    name = _handed_out(spark, held)

    @F.arrow_udf(RESULT)
    def judge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        array = _array(name)
        for hosts, paths in batches:
            h, p = ([x or b"" for x in a.cast(pa.binary()).to_pylist()] for a in (hosts, paths))
            found = array.match(h, p)
            yield pa.array(
                [
                    {"rule": x and x[0].decode(), "verdict": ("block" if x[1] else "allow") if x else default}
                    for x in found
                ],
                pa.struct([("rule", pa.string()), ("verdict", pa.string())]),
            )

    out = df.withColumn("__judged", judge(F.col(host_col), F.col(path_col)))
    return out.withColumns({rule_col: F.col("__judged.rule"), verdict_col: F.col("__judged.verdict")}).drop("__judged")


def _by_join(df, rules, host_col, path_col, rule_col, verdict_col, default) -> DataFrame:
    """The same for a list of rules of any size."""
    rules = rules.where("rule is not null").groupBy("rule").agg(F.max(F.col("verdict") == "block").alias("blocked"))
    slash = F.instr("rule", "/")
    lengths = [
        r[0]
        for r in rules.select(F.when(slash > 0, F.length("rule") - slash + 1).otherwise(0).alias("n")).distinct().toLocalIterator()
    ]
    row = df.withColumn("__row", F.monotonically_increasing_id())
    labels = F.split(F.coalesce(F.col(host_col), F.lit("")), r"\.", -1)
    path = F.coalesce(F.col(path_col), F.lit(""))
    heads = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]))
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    strings = F.flatten(F.transform(tails, lambda t: F.transform(heads, lambda h: F.concat(t, h))))
    met = row.select("__row", F.explode(F.array_distinct(strings)).alias("rule")).join(rules, "rule")
    best = met.groupBy("__row").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "blocked")).alias("b"))
    out = row.join(best, "__row", "left")
    return out.withColumns(
        {
            rule_col: F.col("b.rule"),
            verdict_col: F.when(F.col("b.blocked"), "block").when(~F.col("b.blocked"), "allow").otherwise(default),
        }
    ).drop("__row", "b")

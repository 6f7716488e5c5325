"""N-gram Jaccard join by parity sketches, and the classes that its links make.

A document's set holds its distinct five-word shingles, as 64-bit hashes. For
pairs of one size band, whose symmetric difference is at most D, the shingles
are dealt into m > D chunks and XOR-hashed in each: a chunk's parity differs
only if the chunk holds a differing shingle, so the number of differing chunks
is a lower bound of the difference, and by the pigeonhole principle a linked
pair shares at least s = m - D chunk parities. So each set may leave out its
s - 1 most common ones, which are those of passages that many texts share: of
what a linked pair shares, the rarest stays. Pairs that still share one go
through a 1024-bit parity sketch, whose Hamming distance bounds the difference
too, and then through an exact comparison of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cotejo.llm._common import cut, partitions, remove, shared_path, stored
from cotejo.llm._exchange import MIX, MIX2, mixed, pack, starts, unpack

SHINGLE = 5
#: A link: 100 * shared >= 80 * union.
LINK = 80
SKETCH_BITS = 1024
#: Shingles of the documents that one mapper sends together.
GROUP_SHINGLES = 750_000
#: Members of a group in one row, which one task compares with as many others.
ROW_MEMBERS = 1024
#: Parts that the pairs of one set are dealt to where no group's parts are at hand.
SALTS = 64
#: Ids of candidate texts that are broadcast to the scan of the texts; more are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Links whose components one task finds by itself; more go through distributed steps.
SMALL_GRAPH = 1_000_000
#: Times a document whose chunks are too often empty is dealt anew.
DEALS = 6
#: The low bits of a key name its band and deal.
CODE_BITS = 10

_SPARE = pa.list_(pa.struct([("code", pa.int32()), ("spare", pa.int32())]))
_SET = "struct<n:bigint,set_id:bigint,sketch:array<bigint>,spare:array<struct<code:int,spare:int>>>"
_SET_ARROW = pa.struct([("n", pa.int64()), ("set_id", pa.int64()), ("sketch", pa.list_(pa.int64())), ("spare", _SPARE)])


def shingles(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of all words together if fewer."""
    words = text.lower().split() if text else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))
    n = h.size - k + 1
    if n <= 0:
        whole = b"%d " % h.size + b" ".join(words)
        return np.array([xxhash.xxh3_64_intdigest(whole)] if words else [], "u8")
    out = h[:n].copy()
    for j in range(1, k):
        out *= MIX
        out += h[j : j + n]
    return np.unique(mixed(out))


def linked(a: np.ndarray, b: np.ndarray, percent: int = LINK) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return both > 0 and 100 * both >= percent * (a.size + b.size - both)


def set_id(s: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(s.tobytes())], "u8").view("i8")[0])


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits, each the parity of the shingles at its place, as 16 integers."""
    bits = np.bincount(((s * MIX2) >> np.uint64(54)).astype("i8"), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype("u1")).view("i8")


class Bands:
    """Size bands: of the smaller set of a pair. By band: bounds, D and the number of chunks."""

    def __init__(self, percent: int = LINK):
        self.p = percent
        low = [2]  # a set of one links with equal sets only
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, int(low[-1] * 1.3)))
        self.low = low
        top = [x - 1 for x in low[1:]]
        self.top = top
        # |A xor B| <= (100 - p) (a + b) / (100 + p), and b <= 100 a / p
        self.d = [(100 - percent) * (a + 100 * a // percent) // (100 + percent) for a in top]
        self.m = [d + 1 + -(-12 * d // 100) for d in self.d]

    def of(self, n: int) -> list[int]:
        """The band of n, and those whose sets can be linked to it from below."""
        if n < self.low[0]:
            return []
        j = int(np.searchsorted(self.low, n, "right")) - 1
        out = [j]
        while j > 0 and 100 * self.top[j - 1] >= self.p * n:
            j -= 1
            out.append(j)
        return [j for j in out if self.d[j] > 0]

    def spare(self, s: np.ndarray) -> list[dict]:
        """Keys of the first deal that a set may leave out in each of its bands.

        A linked pair shares at least m - D chunks less those empty in both, so
        it shares one more than either may leave out.
        """
        out = []
        for j in self.of(s.size):
            used = np.unique(_chunks(s, 0, np.uint64(self.m[j]))).size
            q = self.m[j] - self.d[j] - (self.m[j] - used) - 1
            if q > 0:
                out.append({"code": j * DEALS, "spare": q})
        return out


def _turn(deal: int) -> np.uint64:
    return np.uint64((2 * deal + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1)


def _chunks(s: np.ndarray, deal: int, m: np.ndarray) -> np.ndarray:
    return ((s * _turn(deal)) >> np.uint64(33)) % m


def _coded(keys: np.ndarray, code: np.ndarray) -> np.ndarray:
    low = np.uint64((1 << CODE_BITS) - 1)
    return (keys & ~low) | code.astype("u8")


def chunk_keys(sets: list[np.ndarray], owners: list[int], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owners): the chunk parities of each set in each of its bands.

    An empty chunk has no key. Where a set's empty chunks could hide all that a
    pair shares (as many as m - D), it is dealt anew with another hash, as any
    partner with the same gaps is; after DEALS times its gaps become keys.
    """
    take = [(i, j) for i, s in enumerate(sets) for j in bands.of(s.size)]
    keys, own = [np.zeros(0, "u8")], [np.zeros(0, "i8")]
    for deal in range(DEALS):
        if not take:
            break
        m = np.array([bands.m[j] for _, j in take])
        least = np.array([bands.m[j] - bands.d[j] for _, j in take])
        size = np.array([sets[i].size for i, _ in take])
        all_s = np.concatenate([sets[i] for i, _ in take])
        chunk = _chunks(all_s, deal, np.repeat(m, size).astype("u8"))
        base = np.cumsum(m) - m
        slot = chunk.astype("i8") + np.repeat(base, size)
        order = np.argsort(slot)
        slot = slot[order]
        at = starts(slot)
        parity = np.bitwise_xor.reduceat(mixed(all_s[order] ^ _turn(deal)), at)
        slot = slot[at]
        of = np.searchsorted(base, slot, "right") - 1
        code = np.array([j * DEALS + deal for _, j in take], "u8")
        place = code[of] * MIX2 + (slot - base[of]).astype("u8") * MIX
        keys.append(_coded(mixed(parity + place), code[of]))
        who = np.array([owners[i] for i, _ in take], "i8")
        own.append(who[of])
        gaps = m - np.bincount(of, minlength=len(take))
        short = np.flatnonzero(gaps >= least)
        if deal == DEALS - 1:
            full = set(slot.tolist())
            for t in short:
                holes = [c for c in range(m[t]) if int(base[t]) + c not in full]
                gap = mixed(np.array(holes, "u8") * MIX + (code[t] + np.uint64(1)) * MIX2 + np.uint64(1))
                keys.append(_coded(gap, np.full(len(holes), code[t])))
                own.append(np.full(len(holes), who[t], "i8"))
        take = [take[t] for t in short]
    return np.concatenate(keys), np.concatenate(own)


_SENT = pa.schema([("p", pa.int32()), ("block", pa.binary())])
_GROUP = pa.schema(
    [("gid", pa.int64()), ("part", pa.int32()), ("code", pa.int32()), ("size", pa.int64()), ("keys", pa.int64()), ("members", pa.list_(pa.int64()))]
)
_GROUP_SQL = "gid bigint, part int, code int, size bigint, keys bigint, members array<bigint>"


def _sets(k: int, percent: int):
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bands = Bands(percent)
        for batch in batches:
            rows = []
            for text in batch.cast(pa.binary()).to_pylist():
                s = shingles(text, k)
                row = {"n": s.size, "set_id": None, "sketch": None, "spare": None}
                if s.size:
                    row |= {"set_id": set_id(s), "sketch": sketch(s).tolist(), "spare": bands.spare(s)}
                rows.append(row)
            yield pa.array(rows, _SET_ARROW)

    return make


def _sender(k: int, percent: int, ranges: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        held: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = list(pack(*chunk_keys(list(held.values()), list(held), bands), ranges))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_SENT)

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                s = shingles(text, k)
                if s.size and (i := set_id(s)) not in held:
                    held[i] = s
                    size += s.size
                    if size >= GROUP_SHINGLES:
                        yield flush()
                        held, size = {}, 0
        if held:
            yield flush()

    return send


def _meeter(row_members: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _meet(batches, row_members)

    return meet


def _meet(batches: Iterator[pa.RecordBatch], row_members: int) -> Iterator[pa.RecordBatch]:
    """Of one key range: the groups of at least two sets that share a key; equal groups once."""
    entries = [unpack(b) for batch in batches for b in batch.column(1).to_pylist()]
    if not entries:
        return
    keys, owners = (np.concatenate(x) for x in zip(*entries, strict=True))
    del entries
    order = np.argsort(keys)
    keys, owners = keys[order], owners[order]
    at = starts(keys)
    run = np.diff(np.append(at, keys.size))
    many = np.repeat(run > 1, run)
    keys, owners = keys[many], owners[many]
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])] if keys.size else np.zeros(0, bool)
    keys, owners = keys[new], owners[new]
    at = starts(keys)
    if not at.size:
        return
    end = np.append(at, keys.size)[1:]
    code = keys[at] & np.uint64((1 << CODE_BITS) - 1)
    gid = (np.add.reduceat(mixed(owners.view("u8")), at) + mixed(code)).view("i8")
    keep = np.flatnonzero(end - at > 1)
    _, first, count = np.unique(gid[keep], return_index=True, return_counts=True)
    rows: list[tuple] = []
    for g, n in zip(keep[first], count, strict=True):
        own = owners[at[g] : end[g]]
        for part in range(0, own.size, row_members):
            rows.append((int(gid[g]), part // row_members, int(code[g]), own.size, int(n), own[part : part + row_members]))
        if len(rows) >= 5000:
            yield _group_rows(rows)
            rows = []
    if rows:
        yield _group_rows(rows)


def _group_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = [pa.array(list(c), f.type) for c, f in zip(list(zip(*rows, strict=True))[:5], list(_GROUP)[:5], strict=True)]
    ends = np.cumsum([0, *(r[5].size for r in rows)]).astype("i4")
    members = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[5] for r in rows])))
    return pa.RecordBatch.from_arrays([*cols, members], schema=_GROUP)


def _compare(k: int, percent: int):
    def compare(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, "u8"))
        for a, b in batches:
            out = []
            for x, y in zip(a.cast(pa.binary()).to_pylist(), b.cast(pa.binary()).to_pylist(), strict=True):
                if x != last[0]:
                    last = (x, shingles(x, k))
                out.append(linked(last[1], shingles(y, k), percent))
            yield pa.array(out, pa.bool_())

    return compare


def _near_pairs(percent: int, nearest: bool):
    """Of rows sorted by group (gid, i, j): pairs in different classes that size and sketch leave possible.

    Rows of a group stand together, so the pairs at each distance in the order
    are compared at once for all groups of a batch. Where a group holds two
    blocks, only rows of different sides make pairs; pairs with a group's
    center are known already. ``nearest`` keeps each row's nearest pair alone.
    """

    def compare(group: np.ndarray, side: np.ndarray, x: np.ndarray, n: np.ndarray, root: np.ndarray, sk: np.ndarray) -> np.ndarray:
        out = [np.zeros((0, 3), "i8")]
        two = np.zeros(group.max() + 1, bool)
        two[group[side]] = True
        for d in range(1, int(np.bincount(group).max())):
            k = np.flatnonzero(group[d:] == group[:-d])
            e = k + d
            k, e = (v[(root[k] != root[e]) & (100 * np.minimum(n[k], n[e]) >= percent * np.maximum(n[k], n[e])) & (~two[group[k]] | (side[k] != side[e]))] for v in (k, e))
            apart = np.bitwise_count(sk[k] ^ sk[e]).sum(axis=1, dtype="i8")
            good = (100 + percent) * apart <= (100 - percent) * (n[k] + n[e])
            out.append(np.stack([k[good], e[good], apart[good]], axis=1))
        k, e, apart = np.concatenate(out).T
        if nearest:
            row, other, far = np.r_[k, e], np.r_[e, k], np.r_[apart, apart]
            order = np.lexsort((x[other], far, row))
            first = order[starts(row[order])]
            k, e = row[first], other[first]
        return np.unique(np.stack([np.minimum(x[k], x[e]), np.maximum(x[k], x[e])], axis=1), axis=0)

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        *plain, sketches = batch.columns
        return [*(np.asarray(c.cast(pa.int64())) for c in plain), np.asarray(sketches.flatten()).view("u8").reshape(batch.num_rows, -1)]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def flush(rows: list[np.ndarray]) -> pa.RecordBatch:
            gid, i, j, side, x, n, root, sk = rows
            group = np.cumsum(np.r_[False, (gid[1:] != gid[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            both = compare(group, side.astype(bool), x, n, root, sk)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["c", "x"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = columns(batch)
            rows = own if held is None else [np.concatenate(c) for c in zip(held, own, strict=True)]
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
            at = last[-1] + 1 if last.size else 0  # the last group may go on in the next batch
            if at:
                yield flush([c[:at] for c in rows])
            held = [c[at:] for c in rows]
        if held is not None:
            yield flush(held)

    return near


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a bounded number of edges: least labels, halved paths."""
    edges = [np.stack([np.asarray(c) for c in b.columns]) for b in batches if b.num_rows]
    if not edges:
        return
    nodes, at = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
    u, v = at.reshape(2, -1)
    root = np.arange(nodes.size)
    while True:
        least = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], least)
        np.minimum.at(new, root[v], least)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    keep = np.flatnonzero(root != np.arange(nodes.size))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[root[keep]])], ["node", "root"])


def connected(edges: DataFrame, small: int | None = None) -> DataFrame:
    """(node, root) for nodes that are not the smallest of their component of edges (a, b).

    Up to ``small`` edges (counted first) one task labels them. More go through
    large-star and small-star steps in turn: each node's neighbours are tied to
    the smallest of them, until every edge leads straight to its root; a step
    is a few shuffles of the edges, their number logarithmic.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    was = mark(e)
    if was[0] <= (SMALL_GRAPH if small is None else small):
        return cut(e.coalesce(1).mapInArrow(_roots, "node bigint, root bigint"))
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        tied = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = cut(tied.distinct())
        now = mark(e)
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _with_roots(df: DataFrame, roots: DataFrame, col: str, out: str) -> DataFrame:
    own = roots.select(F.col("node").alias(col), F.col("root").alias(out))
    return df.join(own, col, "left").withColumn(out, F.coalesce(out, col))


def near_duplicate_classes(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = LINK,
) -> DataFrame:
    """``id_col``, n_shingles, component_id, class and text_hash of every row.

    class names the component by one of its sets (null: no shingles); text_hash
    is the text's xxhash64.
    component_id is the smallest id that links reach, the row's own included
    (links: Jaccard similarity of the shingle sets at least ``percent`` of 100).
    A row with a null, empty or wordless text has no shingles and no links. A
    null id takes part, but no component is named by it unless it holds no
    other. Repeated rows and equal sets are one class. Other columns are
    ignored; an empty table gives no rows.

    No pair is lost: groups of sets with a common chunk parity are tied to
    their smallest member (one candidate pair a member), and what is then still
    apart inside a group is compared sketch by sketch, in blocks.
    """
    spark = df.sparkSession
    ranges = partitions(spark)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    made = F.arrow_udf(_sets(shingle, percent), _SET)
    sets = cut(rows.select("id", F.xxhash64("text").alias("crc"), made("text").alias("s")).select("id", "crc", "s.*"))
    classes = sets.where("n > 0").groupBy("set_id").agg(
        F.min("id").alias("least"), F.min(F.struct("id", "crc")).alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("spare").alias("spare")
    )
    classes = cut(classes)

    sent = rows.select("text").mapInArrow(_sender(shingle, percent, ranges), "p int, block binary")
    met = sent.repartitionById(ranges, "p").mapInArrow(_meeter(ROW_MEMBERS), _GROUP_SQL)
    groups = met.groupBy("gid", "part").agg(
        F.first("code").alias("code"), F.first("size").alias("size"), F.sum("keys").alias("keys"), F.first("members").alias("members")
    )
    # each set leaves out its most common keys, as many as its band spares, in one order for all
    members = groups.select("gid", "part", "code", "size", "keys", F.explode("members").alias("x"))
    spare = classes.select(F.col("set_id").alias("x"), F.inline("spare"))
    order = W.partitionBy("x", "code").orderBy(F.desc("size"), "gid").rowsBetween(W.unboundedPreceding, 0)
    members = members.join(spare, ["x", "code"], "left").withColumn("so_far", F.sum("keys").over(order))
    members = cut(members.where(F.col("so_far") > F.coalesce("spare", F.lit(0))).select("gid", "part", "x"))

    # one candidate pair for each member of a group, with its smallest; what all members of a group
    # need goes to its parts of ROW_MEMBERS first, so that no key has more rows than a part
    centers = members.groupBy("gid").agg(F.min("x").alias("c"))
    parts = cut(members.select("gid", "part").distinct().join(centers, "gid"))
    pairs = members.join(parts, ["gid", "part"]).where("c <> x").groupBy("c", "x").agg(F.min("part").alias("part"))
    facts = classes.select("set_id", "n", "sketch")
    heads = parts.select("c", "part").distinct().join(facts.toDF("c", "nc", "sc"), "c")
    pairs = pairs.join(heads, ["c", "part"]).join(facts.toDF("x", "nx", "sx"), "x")
    apart = F.aggregate(F.zip_with("sc", "sx", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    fits = (F.least("nc", "nx") * 100 >= F.greatest("nc", "nx") * percent) & (F.col("apart") * (100 + percent) <= (F.col("nc") + F.col("nx")) * (100 - percent))
    pairs = cut(pairs.withColumn("apart", apart).where(fits).select("c", "x", "part"))

    def texts_of(ids: DataFrame, path: str) -> DataFrame:
        """(set_id, text) of classes, read out of the documents by the rows that stand for them, stored at ``path``."""
        need = cut(classes.join(ids, "set_id", "left_semi").select("set_id", F.col("row.id").alias("rid"), F.col("row.crc").alias("rcrc")))
        need = F.broadcast(need) if need.count() <= MAX_BROADCAST_IDS else need
        own = rows.withColumn("crc", F.xxhash64("text"))
        found = own.join(need, own["id"].eqNullSafe(need["rid"]) & (own["crc"] == need["rcrc"])).select("set_id", "text")
        return stored(found.dropDuplicates(["set_id"]), path)

    compare = F.arrow_udf(_compare(shingle, percent), "boolean")

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs (c, x, part); a text c goes to each part of its pairs, not to one task."""
        path = shared_path(spark, "near-duplicate-texts")
        texts = texts_of(pairs.select(F.explode(F.array("c", "x")).alias("set_id")).distinct(), path)
        heads = pairs.select("c", "part").distinct().join(texts.toDF("c", "tc"), "c")
        both = pairs.join(texts.toDF("x", "tx"), "x").join(heads, ["c", "part"])
        links = cut(both.where(compare("tc", "tx")).select(F.col("c").alias("a"), F.col("x").alias("b")))
        remove(spark, path)  # the links stand in a checkpoint of their own
        return links

    links = spark.createDataFrame([], "a bigint, b bigint")
    roots = spark.createDataFrame([], "node bigint, root bigint")
    if pairs.take(1):
        links = verified(pairs)
        roots = connected(links)

    # groups whose members are not all in one class: compared block by block
    def still_apart(nearest: bool, left: DataFrame) -> DataFrame:
        """Candidate pairs inside groups that hold several classes as yet."""
        left = _with_roots(left, roots, "x", "root")
        open_groups = left.groupBy("gid").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("part").alias("last"), F.count("*").alias("size"))
        open_groups = open_groups.where("r0 <> r1 and size > 2").select("gid", "last")
        left = left.join(parts.join(open_groups, "gid"), ["gid", "part"]).where("x <> c").join(facts.toDF("x", "n", "sketch"), "x")
        left = cut(left.select("gid", "part", "last", "x", "n", "root", "sketch"))

        def sided(high: bool, i, j) -> DataFrame:
            return left.where("last > 0").select("gid", i.alias("i"), j.alias("j"), F.lit(high).alias("side"), "x", "n", "root", "sketch")

        alone = left.select("gid", F.col("part").alias("i"), F.col("part").alias("j"), F.lit(False).alias("side"), "x", "n", "root", "sketch")
        later = F.when(F.col("part") < F.col("last"), F.sequence(F.col("part") + 1, F.col("last")))
        earlier = F.when(F.col("part") > 0, F.sequence(F.lit(0), F.col("part") - 1))
        blocks = alone.unionByName(sided(False, F.col("part"), F.explode(later))).unionByName(sided(True, F.explode(earlier), F.col("part")))
        blocks = blocks.repartition(ranges, "gid", "i", "j").sortWithinPartitions("gid", "i", "j", "side")
        return blocks.mapInArrow(_near_pairs(percent, nearest), "c bigint, x bigint").distinct()

    # first each set's nearest one in a group, which joins most classes; then all that is left
    for nearest in (True, False):
        near = still_apart(nearest, members).join(pairs, ["c", "x"], "left_anti")
        near = cut(near.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")))
        if near.take(1):
            links = links.unionByName(verified(near))
            roots = connected(links)
            pairs = pairs.unionByName(near)

    own = _with_roots(classes.select("set_id", "least"), roots, "set_id", "root")
    names = own.groupBy("root").agg(F.min("least").alias("component_id"))
    named = own.join(names, "root").select("set_id", "root", "component_id")
    out = sets.join(named, "set_id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.col("root").alias("class"), F.col("crc").alias("text_hash"))


def keep_one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = LINK) -> DataFrame:
    """The rows of ``df`` less near duplicates: of each class one row stays.

    It is the row with the smallest id, nulls last, then the smallest text hash;
    of rows that agree in both any one. Rows whose text is null, empty or without
    words are in no class and all stay, and so does a clean text that shares an
    id with a removed one. All columns pass through; an empty table stays empty.

    Two anti and semi joins on the few columns of removed and repeated rows: a
    class is never gathered, only its smallest row, which partial aggregates find.
    """
    found = near_duplicate_classes(df, id_col=id_col, text_col=text_col, shingle=shingle, percent=percent).where("class is not null")
    row = found.groupBy("class", F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("rows"))
    row = cut(row.withColumn("order", F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__hash").alias("hash"))))
    least = row.groupBy("class").agg(F.min("order").alias("least"))
    # by row and not by class: the rows of one class may be a third of all
    kept = least.select(F.col("least.id").alias("__i"), F.col("least.hash").alias("__h"), F.lit(True).alias("first"))
    judged = row.join(kept, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")), "left")
    judged = judged.select("__id", "__hash", F.coalesce("first", F.lit(False)).alias("first"), (F.col("rows") > 1).alias("repeated"))
    away = judged.where("not first or repeated").select("__id", "__hash")
    again = judged.where("first and repeated").select("__id", "__hash")
    docs = df.withColumn("__own", F.xxhash64(text_col))
    same = docs[id_col].cast("bigint").eqNullSafe(F.col("__id")) & (docs["__own"] == F.col("__hash"))
    once = docs.join(away, same, "left_anti").drop("__own")
    one = docs.join(again, same, "left_semi").dropDuplicates([id_col, "__own"]).drop("__own")
    return once.unionByName(one)

"""Chat formatting of reply trees.

Iterative self-joins with pointers that double their reach give each leaf its
path's score and then the root-to-leaf paths of the best ranked ones; each
chosen path becomes one conversation in a template whose marks can't occur
inside texts.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cotejo.llm._common import cut

OPEN, CLOSE = "<|turn|>", "<|end|>"

# Control strings of common chat templates start here (fixed values):
# <|...|>, <s>, </s>, <<SYS>>, <</SYS>>, [INST], [/INST].
_CONTROL = re.compile(r"\\|<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])")
_ESCAPE = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_UNESCAPE = {"\\\\": "\\", "\\l": "<", "\\b": "[", "\\n": "\n"}
_ESCAPED = re.compile(r"\\[\\lbn]")
_TURN = re.compile(rf"{re.escape(OPEN)}([^\n]*)\n(.*?){re.escape(CLOSE)}\n", re.DOTALL)


def escape(text: str) -> str:
    """``text`` with no control string left in it; ``unescape`` gives it back."""
    return _CONTROL.sub(lambda m: _ESCAPE[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _UNESCAPE[m[0]], text)


def format_turns(turns: list[tuple[str, str]], loss_roles: frozenset[str]) -> tuple[str, list[tuple[int, int]]]:
    """One conversation and the code-point spans that carry loss (the texts of ``loss_roles``)."""
    parts: list[str] = []
    mask: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head = f"{OPEN}{escape(role)}".replace("\n", "\\n") + "\n"
        body = escape(text)
        if role in loss_roles and body:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{CLOSE}\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def masked_text(formatted: str, mask: list[tuple[int, int]]) -> str:
    """All text under the loss mask, unescaped, in order."""
    return "".join(unescape(formatted[a:b]) for a, b in mask)


def reach(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointers of the nodes that lead to a root, by doubling reach, and the sums of their whole paths.

    nodes: tree, node, parent, score; a parent that is null or absent makes a
    root. Of the pointers (tree, node, anc, total, n) the k-th table holds those
    that are still below the root, 2^k steps up; total and n sum up the scores
    of the nodes from the node to below that ancestor. The sums table (tree,
    node, total, n) holds each node's path to its root, both included.

    Each round joins the pointers that still are below the root with all, so
    rounds are the logarithm of the greatest depth and only deep nodes stay in.
    Nodes move, never paths. After as many rounds as the largest tree's size
    asks for, what is left hangs on a cycle and is dropped from every table.
    """
    own = nodes.groupBy("tree", "node").agg(F.min(F.struct("parent", "score")).alias("n")).select("tree", "node", "n.*")
    a, b = own.alias("a"), own.select("tree", "node").alias("b")
    same = F.expr("a.tree <=> b.tree and a.parent = b.node")
    start = cut(a.join(b, same, "left").select("a.tree", "a.node", F.col("b.node").alias("anc"), F.col("a.score").alias("total"), F.lit(1).cast("bigint").alias("n")))
    largest = start.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    levels, done = [start.where("anc is not null")], start.where("anc is null")
    up = F.expr("p.tree <=> q.tree and p.anc = q.node")
    sums = [(F.col(f"p.{c}") + F.col(f"q.{c}")).alias(c) for c in ("total", "n")]
    for _ in range(int(largest).bit_length()):
        if not levels[-1].take(1):
            break
        far = cut(levels[-1].alias("p").join(done.unionByName(levels[-1]).alias("q"), up).select("p.tree", "p.node", F.col("q.anc").alias("anc"), *sums))
        done = done.unionByName(far.where("anc is null"))
        levels.append(far.where("anc is not null"))
    hung = levels[-1].select("tree", "node")
    if hung.take(1):
        at = F.expr("p.tree <=> h.tree and p.node = h.node")
        levels = [cut(x.alias("p").join(hung.alias("h"), at, "left_anti")) for x in levels]
    return levels, done.drop("anc")


def branch_leaves(levels: list[DataFrame], sums: DataFrame, keep: int | None) -> DataFrame:
    """(tree, leaf, score, rank): the ``keep`` best leaves of each tree by the mean score of their path (None: all)."""
    inner = levels[0].select("tree", F.col("anc").alias("node")).distinct()
    at = F.expr("p.tree <=> i.tree and p.node = i.node")
    leaves = sums.alias("p").join(inner.alias("i"), at, "left_anti").select("p.tree", F.col("p.node").alias("leaf"), (F.col("p.total") / F.col("p.n")).alias("score"))
    ranked = leaves.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    return ranked if keep is None else ranked.where(F.col("rank") <= keep)


def branch_paths(levels: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): the ancestors of each of ``leaves`` and itself, ``up`` steps above it."""
    paths = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("bigint").alias("up"))
    hop = F.expr("p.tree <=> q.tree and p.node = q.node")
    # after k tables a path holds its lowest 2^k nodes
    for k, level in enumerate(levels[:-1]):
        further = paths.alias("p").join(level.alias("q"), hop)
        paths = cut(paths.unionByName(further.select("p.tree", "p.leaf", F.col("q.anc").alias("node"), (F.col("p.up") + (1 << k)).alias("up"))))
    return paths


def format_branches(
    nodes: DataFrame,
    *,
    keep: int | None = 1,
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per chosen branch: tree, leaf, rank, score, n_turns, formatted, loss_spans.

    nodes: tree, node, parent, role, text, score. A branch's score is the mean
    score of its nodes (null: 0); ties go to the smaller leaf; ``keep`` branches
    of each tree stay (None: all). Branches are ranked by their leaves before
    any path is written out. Null roles and texts are empty, very long texts
    stay whole, a null tree is a tree. Repeated (tree, node) rows count as one,
    the first by (parent, role, text); a row without a node is left out, and so
    are nodes that lead to no root, being or hanging on a cycle. Other columns
    are ignored; an empty table gives no rows.
    """
    bare = nodes.where("node is not null").groupBy("tree", "node").agg(
        F.min(
            F.struct(
                F.col("parent"),
                F.coalesce("role", F.lit("")).alias("role"),
                F.coalesce("text", F.lit("")).alias("text"),
                F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
            )
        ).alias("n")
    )
    bare = bare.select("tree", "node", "n.*")
    levels, sums = reach(bare.select("tree", "node", "parent", "score"))
    chosen = cut(branch_leaves(levels, sums, keep))
    paths = branch_paths(levels, chosen)
    here = F.expr("p.tree <=> n.tree and p.node = n.node")
    turns = F.transform(F.sort_array(F.collect_list(F.struct("p.up", "n.role", "n.text")), asc=False), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    whole = paths.alias("p").join(bare.alias("n"), here).groupBy("p.tree", "p.leaf").agg(turns.alias("turns"))
    mine = F.expr("w.tree <=> c.tree and w.leaf = c.leaf")
    whole = whole.alias("w").join(chosen.alias("c"), mine).select("w.*", "c.rank", "c.score")
    roles = frozenset(loss_roles)

    @F.arrow_udf("struct<formatted:string,loss_spans:array<struct<start:bigint,end:bigint>>>")
    def rendered(batch: pa.Array) -> pa.Array:
        rows = []
        for turns in batch.to_pylist():
            text, mask = format_turns([(t["role"], t["text"]) for t in turns], roles)
            rows.append({"formatted": text, "loss_spans": [{"start": a, "end": b} for a, b in mask]})
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.array(rows, pa.struct([("formatted", pa.string()), ("loss_spans", pa.list_(span))]))

    return whole.select("tree", "leaf", "rank", "score", F.size("turns").cast("long").alias("n_turns"), rendered("turns").alias("r")).select(
        "tree", "leaf", "rank", "score", "n_turns", "r.formatted", "r.loss_spans"
    )


def chain_nodes(conversations: DataFrame) -> DataFrame:
    """Nodes of linear conversations (conv_id, turn, role, text): each turn replies to the one before.

    Turns go in order of turn, role and text, nulls first, so repeated and tied
    turns all stay, in one order.
    """
    w = W.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    n = F.row_number().over(w).cast("long")
    return conversations.select(F.col("conv_id").alias("tree"), n.alias("node"), "role", "text").select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def _read_back(formatted: pa.Array, spans: pa.Array) -> pa.Array:
    """Turns (role, newline, text, newline each) and masked text, parsed out of the formatted string."""
    rows = []
    for text, mask in zip(formatted.to_pylist(), spans.to_pylist(), strict=True):
        turns = parse_turns(text)
        rows.append(
            {
                "n_turns": len(turns),
                "turns": "".join(f"{r}\n{t}\n" for r, t in turns),
                "loss": masked_text(text, [(s["start"], s["end"]) for s in mask]),
            }
        )
    return pa.array(rows, pa.struct([("n_turns", pa.int64()), ("turns", pa.string()), ("loss", pa.string())]))


def read_back(formatted, spans):
    """Column of n_turns, turns and loss, parsed out of formatted conversations."""
    return F.arrow_udf(_read_back, "struct<n_turns:bigint,turns:string,loss:string>")(formatted, spans)

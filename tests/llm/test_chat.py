import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cotejo.llm import chat
from cotejo.llm.queries import op8_reply_trees

NODES = "tree bigint, node bigint, parent bigint, role string, text string, score double"
PIECES = st.sampled_from(["<|turn|>", "<|end|>", "\n", "</s>", "<s>", "[INST]", "[/INST]", "\\", "\\l", "\\b", "<", "[", "|", "é", "a", "<<SYS>>", "\\n", "😀"])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sy\ns", ""]), st.lists(PIECES, max_size=8).map("".join)), max_size=6))
def test_round_trip_and_mask(turns):
    text, mask = chat.format_turns(turns, frozenset(["assistant"]))
    assert chat.parse_turns(text) == turns
    assert chat.masked_text(text, mask) == "".join(t for r, t in turns if r == "assistant")
    inside = text.replace(chat.OPEN, "").replace(chat.CLOSE, "")
    assert not any(c in inside for c in ("</s>", "<s>", "[INST]", "[/INST]", "<|", "<<SYS>>"))
    assert text.count(chat.OPEN) == text.count(chat.CLOSE) == len(turns)


def tree(spark, rows):
    return spark.createDataFrame(rows, NODES)


def test_paths_of_a_tree_and_ranks(spark):
    #      1 -> 2 -> 4, 1 -> 3 -> (5, 6); a second tree is one node; a missing parent makes a root
    rows = [(1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 1.0), (1, 4, 2, "user", "d", 9.0), (1, 3, 1, "assistant", "c", 5.0), (1, 5, 3, "user", "e", 1.0), (1, 6, 3, "user", "f", None), (2, 1, None, None, None, None), (3, 9, 8, "user", "x", 1.0)]
    paths = {}
    levels, sums = chat.reach(tree(spark, rows))
    for r in chat.branch_paths(levels, chat.branch_leaves(levels, sums, None)).collect():
        paths.setdefault((r.tree, r.leaf), []).append((r.up, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in paths.items()} == {(1, 4): [4, 2, 1], (1, 5): [5, 3, 1], (1, 6): [6, 3, 1], (2, 1): [1], (3, 9): [9]}
    every = {(r.tree, r.leaf): (r["rank"], round(r.score, 3), [t for _, t in chat.parse_turns(r.formatted)]) for r in chat.format_branches(tree(spark, rows), keep=None).collect()}
    assert every[1, 4] == (1, 3.333, ["a", "b", "d"]) and every[1, 5] == (2, 2.0, ["a", "c", "e"]) and every[1, 6][0] == 3
    best = {r.tree: r.leaf for r in chat.format_branches(tree(spark, rows), keep=1).collect()}
    assert best == {1: 4, 2: 1, 3: 9}


def test_long_chain_doubles_its_reach(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(300)]
    got = chat.format_branches(tree(spark, rows)).collect()
    assert len(got) == 1 and [t for _, t in chat.parse_turns(got[0].formatted)] == [str(i) for i in range(300)]


def test_ties_repeats_nulls_clashes_and_empty_tables(spark):
    said = [(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, None, None), (None, 3, "assistant", "n"), (2, 1, "assistant", "x " * 60_000)]
    df = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").withColumns({"tree": F.lit(5), "node": F.lit(6), "score": F.lit(7)})
    got = {r.tree: chat.parse_turns(r.formatted) for r in chat.format_branches(chat.chain_nodes(df)).collect()}
    assert got[1] == [("", ""), ("user", "a"), ("user", "b"), ("user", "b")]
    assert got[None] == [("assistant", "n")] and got[2] == [("assistant", "x " * 60_000)]
    assert chat.format_branches(chat.chain_nodes(df.limit(0))).count() == 0


def test_cycles_lead_to_no_root_and_do_not_grow(spark, monkeypatch):
    """Nodes on a cycle and a leaf that hangs on one give no rows; no table ever has more rows than nodes."""
    rows = [(1, 1, 2, "u", "a", 0.0), (1, 2, 1, "u", "b", 0.0), (1, 3, 2, "u", "leaf", 9.0), (1, 4, 3, "u", "leaf", 9.0), (2, 5, 5, "u", "self", 0.0), (2, 6, 5, "u", "leaf", 1.0)]
    good = [(1, 10, None, "user", "q", 0.0), (1, 11, 10, "assistant", "a", 0.0), (3, 7, None, "user", "x", 0.0)]
    seen = []
    cut = chat.cut
    monkeypatch.setattr(chat, "cut", lambda df: seen.append(cut(df)) or seen[-1])
    got = {(r.tree, r.leaf): r.n_turns for r in chat.format_branches(tree(spark, rows + good), keep=None).collect()}
    assert got == {(1, 11): 2, (3, 7): 1}
    assert len(seen) < 15 and max(df.count() for df in seen) <= len(rows + good)


def test_branches_against_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for t in range(6):
        for i in range(40):
            rows.append((t, i, rnd.choice([None, i, *range(i + 5)]) if i else None, "user", f"{t}.{i}", float(rnd.randint(0, 9))))
    parent = {(t, i): p for t, i, p, *_ in rows}
    score = {(t, i): s for t, i, *_, s in rows}
    parents = {(t, p) for (t, _), p in parent.items() if p is not None}
    want: dict = {}
    for t, i in parent:
        path, at = [], i
        while at is not None and (t, at) in parent and at not in path:
            path.append(at)
            at = parent[t, at]
        if (at is None or (t, at) not in parent) and (t, i) not in parents:
            want.setdefault(t, []).append((-sum(score[t, x] for x in path) / len(path), i, path[::-1]))
    got = chat.format_branches(tree(spark, rows), keep=2).collect()
    assert sorted((r.tree, r["rank"], r.leaf) for r in got) == sorted((t, k + 1, x[1]) for t, v in want.items() for k, x in enumerate(sorted(v)[:2]))
    texts = {(t, x[1]): [f"{t}.{n}" for n in x[2]] for t, v in want.items() for x in v}
    assert all([s for _, s in chat.parse_turns(r.formatted)] == texts[r.tree, r.leaf] for r in got)


def test_query_reads_the_probe_back(spark):
    r = op8_reply_trees(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()

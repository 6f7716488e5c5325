import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cotejo.llm import _exchange as X
from cotejo.llm import substring_dedup as D
from tests.llm.conftest import rows_by


def brute(rows, k=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for a in range(len(w) - k + 1):
            key = tuple(w[a : a + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if first[tuple(w[a : a + k])] < i:
                gone[a : a + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


def result(df, **kw):
    d = D.remove_repeats(df, **kw)
    return sorted((r.doc_id, r.dedup.n_words, r.dedup.n_removed, r.dedup.kept) for r in d.collect())


@pytest.mark.parametrize("group", [50, 750_000])
def test_against_brute_force(spark, documents, group):
    rnd = random.Random(3)
    words = lambda n: [rnd.choice(["a", "b", "Cé", "d"]) + str(rnd.randrange(30)) for _ in range(n)]
    shared = [words(20), words(60), ["x"] * 30]
    rows = []
    for i in range(60):
        w = words(rnd.choice([0, 5, 13, 40]))
        for _ in range(rnd.randint(0, 2)):
            w += rnd.choice(shared) + words(rnd.randint(0, 15))
        rows.append((rnd.randrange(45), " ".join(w)))  # ids repeat
    assert result(documents(rows, dedup=1, doc=2, hashes=3), group_words=group) == brute(rows)


def test_nulls_empty_and_long_texts(spark, documents):
    t = " ".join(map(str, range(20)))
    rows = [(1, t), (1, t), (2, None), (3, ""), (4, t), (0, "y " * 40_000), (7, t + " z")]
    assert result(documents(rows)) == brute(rows)
    got = rows_by(D.remove_repeats(documents([(None, t), (None, t), (5, t)])))
    assert [r.dedup.n_removed for r in got[None]] == [0, 0] and got[5][0].dedup.n_removed == 20
    assert D.remove_repeats(documents(rows).limit(0)).count() == 0


def test_spans_are_maximal(spark, documents):
    t = [str(i) for i in range(40)]
    rows = [(1, " ".join(t)), (2, " ".join(["q", *t[:14], "r", *t[14:40]]))]
    spans = D.remove_repeats(documents(rows)).where("doc_id = 2").select(F.inline("dedup.removed")).collect()
    assert [tuple(s) for s in spans] == [(1, 15), (16, 42)]


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (4, 2), (3000, 700), (70_000, 70_000)):
        keys, own = rng.integers(0, 1 << 64, n, dtype="u8"), rng.integers(-(1 << 62), 1 << 62, m)[rng.integers(0, m, n)]
        for by_owner in (False, True):
            back = [X.unpack(b) for _, b in X.pack(keys, own, 5, by_owner=by_owner)]
            assert sorted(zip(*(np.concatenate(x).tolist() for x in zip(*back, strict=True)), strict=True)) == sorted(zip(keys.tolist(), own.tolist(), strict=True))

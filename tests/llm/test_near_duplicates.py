import random
import re

import numpy as np
import pytest

from cotejo.llm import near_duplicates as N

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def made(seed, families=12, most=9):
    """Families of edited copies of texts of many lengths, with a passage that all share."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 6)))
    shared = [word() for _ in range(40)]
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rnd.choice([1, 3, 5, 6, 8, 9, 12, 20, 60, 150, 400]))] + (shared if rnd.random() < 0.5 else [])
        for _ in range(rnd.randint(1, most)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                w[rnd.randrange(len(w))] = word()
            rows.append((len(rows), rnd.choice([" ", "\n", "\t "]).join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classes_against_brute_force(spark, documents, seed):
    rows = made(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicate_classes(documents(rows, n=1, x=2, size=3, component_id=4)).collect()}
    assert got == brute(rows)


def test_large_group_is_compared_in_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(N, "ROW_MEMBERS", 4)
    monkeypatch.setattr(N, "MAX_BROADCAST_IDS", 0)  # and candidate ids meet the texts by shuffle
    rows = made(7, families=3, most=30)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicate_classes(documents(rows)).collect()}
    assert got == brute(rows)


def test_linked_sets_share_a_key_that_neither_leaves_out():
    rng = np.random.default_rng(5)
    bands = N.Bands()
    for size in (4, 5, 7, 10, 16, 30, 55, 120, 500, 2000):
        for _ in range(60):
            base = rng.integers(0, 1 << 63, size, dtype="u8")
            most = int(20 * 2 * size / 180)
            a, b = np.unique(base), np.unique(np.r_[base[most // 2 :], rng.integers(0, 1 << 63, most - most // 2, dtype="u8")])
            if not N.linked(a, b) or a.size == b.size and (a == b).all():
                continue
            keys = {i: set(N.chunk_keys([s], [i], bands)[0].tolist()) for i, s in enumerate((a, b))}
            both = keys[0] & keys[1]
            first = [k for k in both if k % (1 << N.CODE_BITS) % N.DEALS == 0]
            spare = {x["code"]: x["spare"] for s in (a, b) for x in bands.spare(s)}
            assert both
            codes = {k % (1 << N.CODE_BITS) for k in both}
            # in some band more keys are shared than either set may leave out
            assert any(sum(k % (1 << N.CODE_BITS) == c for k in both) > spare.get(c, 0) for c in codes), (size, len(first))


def test_hamming_distance_bounds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a = np.unique(rng.integers(0, 1 << 63, 300, dtype="u8"))
        b = np.unique(np.r_[a[rng.random(a.size) < 0.8], rng.integers(0, 1 << 63, 20, dtype="u8")])
        apart = int(np.bitwise_count((N.sketch(a) ^ N.sketch(b)).view("u8")).sum())
        assert apart <= np.setxor1d(a, b).size


def test_nulls_repeats_ties_and_empty_tables(spark, documents):
    t = "one two three four five six seven eight"
    rows = [(5, t), (5, t), (3, t.upper()), (None, t), (9, None), (10, ""), (11, " \n "), (12, "one"), (13, "ONE"), (2, "long " * 30_000)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.near_duplicate_classes(documents(rows)).collect()), key=str)
    assert got == sorted([(5, 4, 3), (5, 4, 3), (3, 4, 3), (None, 4, 3), (9, 0, 9), (10, 0, 10), (11, 0, 11), (12, 1, 12), (13, 1, 12), (2, 1, 2)], key=str)
    assert N.near_duplicate_classes(documents(rows).limit(0)).count() == 0


@pytest.mark.parametrize("small", [0, 10_000])
def test_connected_components(spark, small):
    edges = [(1, 2), (2, 3), (10, 3), (7, 8), (8, 9), *[(100 + i, 101 + i) for i in range(40)], *[(-5, 200 + i) for i in range(30)]]
    got = {r.node: r.root for r in N.connected(spark.createDataFrame(edges, "a bigint, b bigint"), small).collect()}
    assert all(got[n] == 1 for n in (2, 3, 10)) and got[9] == got[8] == 7
    assert all(got[101 + i] == 100 for i in range(40)) and all(got[200 + i] == -5 for i in range(30))


def test_one_row_of_each_class_is_kept(spark, documents):
    rows = made(9, families=6)
    kept = {r.doc_id for r in N.keep_one_of_each(documents(rows, first=2, order=3)).collect()}
    assert kept == {c for _, c in brute(rows).values()}

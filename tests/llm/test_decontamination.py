import random
import re

import pytest
from pyspark.sql import functions as F

from cotejo.llm import decontamination as D
from tests.llm.conftest import rows_by

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(docs, items, k=10):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, it in items:
            p = words(it)
            m = min(k, len(p))
            wins = {tuple(p[a : a + m]) for a in range(len(p) - m + 1)} if m else set()
            for a in range(len(w) - m + 1):
                if m and tuple(w[a : a + m]) in wins:
                    hit |= set(range(a, a + m))
                    if item is not None:
                        ids.add(str(item))
        out.append((i, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def result(docs, items, **kw):
    d = D.find_benchmark(docs, items, **kw).withColumn("h", D.hit_words(F.col("contamination.hits")))
    return sorted(((r.doc_id, r.contamination.n_words, r.h, r.contamination["items"]) for r in d.collect()), key=str)


def test_words_are_the_pattern():
    for t in ["A-b_c 1.5 é´ x\x7fy\x00z", "ÀÉ straße", "", "naïve—dash 日本語、テスト", "\xa0x"]:
        assert [w.decode() for w in D.words(t.encode())] == words(t)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_against_brute_force(spark, documents, block):
    rnd = random.Random(4)
    vocab = ["the", "of", "a", "Xé", "b1", "c", "dd", "E"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.choice([3, 9, 10, 11, 14, 30]))) for i in range(25)] + [(3, text(12)), (50, None), (51, "!!"), (None, text(11))]
    docs = [(i, text(rnd.choice([0, 2, 9, 40])) + ", " + (rnd.choice(items)[1] or "").upper().replace(" ", "-") + " " + text(10)) for i in range(80)]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    assert result(documents(docs, contamination=1, hits=2, items=3), b, block_bytes=block) == brute(docs, items)


def test_tables_stay_small_and_are_built_once():
    import pickle
    import time

    rnd = random.Random(2)
    vocab = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9))) for _ in range(20_000)]
    items = [(str(i), " ".join(rnd.choices(vocab, k=500)).encode()) for i in range(600)]
    size = sum(len(t) for _, t in items)
    wm = D.WuManber(items)
    sent = pickle.dumps(wm)
    assert len(sent) < 12 * size
    there = pickle.loads(sent)
    doc = b" ".join([rnd.choice(vocab).encode() for _ in range(300)] + items[7][1].split()[20:31] + [b"end"])
    assert there.search(doc) == wm.search(doc) == (312, [(300, 311)], ["7"])
    t = time.process_time()
    for _ in range(200):
        there.search(doc)
    assert time.process_time() - t < 2


def test_shifts_skip_impossible_positions():
    wm = D.WuManber([("a", b"one two three four five six seven eight nine ten eleven")])
    (s,) = wm.searches
    of = dict(zip(s.key.tolist(), s.shift.tolist(), strict=True))
    assert [of[i * s.words + i + 1] for i in range(10)] == [8, 7, 6, 5, 4, 3, 2, 1, 0, 0] and s.skip == 9


def test_nulls_repeats_long_texts_and_empty_tables(spark, documents):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, None), (2, ""), (3, item), (3, item), (4, "zz " * 50_000 + item), (5, item.replace(" ", "  \n"))]
    b = spark.createDataFrame([(7, item), (7, item), (10, item)], "item_id bigint, text string")
    got = rows_by(D.find_benchmark(documents(docs), b))
    assert [got[i][0].contamination.n_words for i in (1, 2)] == [0, 0]
    assert [list(r.contamination["items"]) for r in got[3]] == [["10", "7"]] * 2
    assert [tuple(s) for s in got[4][0].contamination.hits] == [(50_000, 50_011)]
    assert got[5][0].contamination["items"] == ["10", "7"]
    none = D.find_benchmark(documents(docs), b.limit(0))
    assert all(r.contamination.hits == [] for r in none.collect())
    assert D.find_benchmark(documents(docs).limit(0), b).count() == 0

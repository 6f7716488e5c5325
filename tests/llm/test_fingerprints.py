import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cotejo.llm import fingerprints as P
from cotejo.llm.queries import op10_syncmers
from tests.llm.conftest import rows_by


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 12))) for _ in range(n))


def test_anchors_are_closed_syncmers(spark):
    """The rule, straight from the units and Spark's own hashes."""
    text = prose(1, 150)
    df = P.add_fingerprint(texts(spark, [(1, text)]), "text", "f", "at")
    units = [w[i : i + 16] for w in text.split() for i in range(0, len(w), 16)]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(units)], "i int, u string").select("i", F.xxhash64("u").alias("h"))
    h = [r.h for r in rows.orderBy("i").collect()]
    pairs = list(zip(h, h[1:], strict=False))
    ask = spark.createDataFrame(pairs, "a bigint, b bigint").distinct().select("a", "b", F.xxhash64("a", "b").alias("h"))
    of = {(r.a, r.b): r.h for r in ask.collect()}
    s = [of[x] for x in pairs]
    want = [i for i in range(len(h) - P.K + 1) if min(s[i : i + 3]) in (s[i], s[i + 2])]
    assert df.first()["at"] == want
    assert max(b - a for a, b in zip(want, want[1:], strict=False)) <= P.K - P.S + 1


ALPHABETS = {
    "han": [chr(c) for c in range(0x4E00, 0x4F00)], "thai": [chr(c) for c in range(0xE01, 0xE2F)], "cyrillic": [chr(c) for c in range(0x430, 0x450)],
    "base64": list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), "hex": list("0123456789abcdef"), "dna": list("ACGT"),
    "url": list("abcdefghijklmn/?&=."), "consonants": list("bcdfg"), "marks": list("!?.,;"),
}


def likeness_to(spark, rows):
    """(key, text, other) to key -> likeness."""
    df = spark.createDataFrame(rows, "k string, a string, b string")
    df = P.add_fingerprint(P.add_fingerprint(df, "a", "fa"), "b", "fb")
    return {r.k: r.x for r in df.select("k", P.likeness(F.col("fa"), F.col("fb")).alias("x")).collect()}


def test_text_without_spaces_keeps_its_anchors(spark):
    rnd, rows = random.Random(4), []
    for name, letters in ALPHABETS.items():
        t = "".join(rnd.choices(letters, k=4000))
        rows += [(f"{name} front", t, "x" + t), (f"{name} end", t, t[:-1]), (f"{name} middle", t, t[:2000] + "x" + t[2000:])]
    got = likeness_to(spark, rows)
    assert {k: v for k, v in got.items() if v <= 0.97} == {}


def test_no_length_changes_the_kind_of_anchor(spark):
    rows = []
    for n in range(8, 60):
        t = prose(n, n)
        rows.append((str(n), t, t[: t.rindex(" ")]))
    got = {int(k): v for k, v in likeness_to(spark, rows).items()}
    assert min(v for n, v in got.items() if n >= 17) > 0.8
    assert min(got.values()) >= 0.5 and sum(got.values()) / len(got) > 0.9


def test_a_changed_quarter_of_a_short_text_is_seen_as_such(spark):
    rows = [(str(n), prose(n, n), " ".join(prose(n, n).split()[: n - n // 4] + prose(1000 + n, n // 4).split())) for n in range(10, 41)]
    assert min(likeness_to(spark, rows).values()) > 0.2


def test_likeness_against_brute_force(spark):
    """Shared share of the anchor sets, from the positions of the anchors and the units themselves."""
    sets = {}
    for i, t in enumerate((prose(5, 60), prose(5, 45) + " " + prose(6, 20))):
        at = P.add_fingerprint(texts(spark, [(i, t)]), "text", "f", "at").first()["at"]
        words = [w[j : j + 16] for w in t.split() for j in range(0, len(w), 16)]
        sets[i] = {tuple(words[a : a + P.K]) for a in at}
    want = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    got = likeness_to(spark, [("x", prose(5, 60), prose(5, 45) + " " + prose(6, 20))])
    assert 0.3 < want < 1 and got["x"] == pytest.approx(want)


def test_an_edit_moves_no_anchor_elsewhere(spark):
    a = prose(2, 300)
    b = prose(9, 20) + " " + a
    rows = P.add_fingerprint(texts(spark, [(1, a), (2, b)]), "text", "f").collect()
    f = {r.doc_id: r.f for r in rows}
    assert f[2][-len(f[1]) :] == f[1]


def test_nulls_short_long_equal_and_clashing(spark):
    long = "x" * 100_000 + prose(3, 5000)
    df = texts(spark, [(1, None), (2, ""), (3, "one"), (4, "one"), (5, long), (6, "日本語 " * 30), (7, " \n ")]).withColumns({"f": F.lit(1), "u": F.lit(2)})
    got = {r.doc_id: r.f for r in P.add_fingerprint(df, "text", "f").collect()}
    assert got[1] == got[2] == got[7] == [] and got[3] == got[4] and len(got[3]) == 1
    assert P.add_fingerprint(df.limit(0), "text", "f").count() == 0
    assert len(got[5]) > 500 and got[6]
    like = spark.createDataFrame([([], []), ([1], []), ([1, 2], [2, 3])], "a array<int>, b array<int>")
    assert [r[0] for r in like.select(P.likeness(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1 / 3]


@pytest.mark.parametrize("n", [0, 1, 2, 37])
def test_next_rows_in_order(spark, n):
    rnd = random.Random(n)
    ids = rnd.sample(range(-1000, 100_000), n)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string").withColumns({"block": F.lit(0), "k": F.lit(0)})
    got = {r.doc_id: r.next_text for r in P.with_next(df, "doc_id", ["text"], F.col("text")).collect()}
    order = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_next_with_repeated_and_null_ids(spark):
    rows = [(None, "n"), (1, "a"), (1, "a"), (1, "b"), (2, "c")]
    got = rows_by(P.with_next(texts(spark, rows), "doc_id", ["text"], F.col("text")))
    assert got[None][0].next_text in ("a", "b") and [r.next_text for r in got[2]] == ["n"]
    after = sorted(r.next_text for r in got[1])
    assert len(after) == 3 and "c" in after and set(after) <= {"a", "b", "c"}


def test_a_hot_key_is_cut_into_blocks_and_stays_in_order(spark):
    rows = [(5, f"t{i}") for i in range(400)] + [(None, f"n{i}") for i in range(200)] + [(i, f"o{i}") for i in range(6, 300)] + [(1, "first")]
    blocks = []
    prepare = lambda r: blocks.append(r) or r.withColumn("twice", F.concat("text", "text"))
    got = P.with_next(texts(spark, rows), "doc_id", ["text", "twice"], F.col("text"), prepare).collect()
    assert len(got) == len(rows) and all(r.next_twice == r.next_text * 2 for r in got)
    follows = {r.text: r.next_text for r in got}
    seen, at = [], "o299"
    for _ in rows:
        at = follows[at]
        seen.append(at)
    kinds = "".join(t[0] for t in seen)
    assert kinds == "n" * 200 + "f" + "t" * 400 + "o" * 294 and len(set(seen)) == len(rows)
    sizes = [r["count"] for r in blocks[0].groupBy("__block").count().collect()]
    assert max(sizes) < 150


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in op10_syncmers(spark, sf).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        nxt, m = docs[(k + 1) % len(docs)][1], len(t) // 4
        edited = t[: len(t) - m] + nxt[:m]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_next == 1.0) == (r.fingerprint == got[docs[(k + 1) % len(docs)][0]].fingerprint) or t == nxt
    by_text = {}
    for i, t in docs:
        by_text.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    long = [got[i] for i, t in docs if len(t) > 400]
    assert sum(r.near_edited > 0.3 for r in long) / len(long) > 0.95
    assert sum(r.near_edited > r.near_next for r in long) / len(long) > 0.9

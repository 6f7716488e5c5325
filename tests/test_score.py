import math
import random

import pytest
from pyspark.sql import functions as F

from cotejo.config import FEATURES, Settings
from cotejo.operators import retrieve as R
from cotejo.operators import score as S

W = Settings().weights
SIG = "sb double, literal double, ontologico double, autoridad double"


def scores(spark, rows, weights=W):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + SIG)
    return [r.s for r in df.select("i", S.weighted_score({k: F.col(k) for k in S.SIGNALS}, weights).alias("s")).orderBy("i").collect()]


def test_weighted_score(spark):
    nan = float("nan")
    got = scores(spark, [(1.0, 0.5, 0.0, 1.0), (1.0, 0.5, None, 1.0), (2.0, -1.0, None, None), (None,) * 4, (nan, 1.0, None, None), (math.inf, None, None, None)])
    assert got == pytest.approx([0.675, 0.675 / 0.8, 0.4 / 0.65, 0.0, 0.25 / 0.65, 0.0])
    assert scores(spark, [(1.0, 1.0, 1.0, 1.0)], dict.fromkeys(W, 0.0)) == [0.0]
    assert scores(spark, [(1.0, 0.5, 0.0, 1.0)], {k: 10 * v for k, v in W.items()}) == pytest.approx([0.675])


def so(spark, p, cat, n, known=("A", "B")):
    df = spark.createDataFrame([(p, cat, n)], f"p {S.CONCEPTS}, c string, n {S.CONCEPTS}")
    return df.select(S.ontological_match(F.col("p"), F.col("c"), F.col("n"), F.lit(list(known))).alias("v")).first().v


def test_ontological_match(spark):
    a, b = ("1", "A"), ("2", "B")
    four = [("1", "A"), ("3", "A"), ("4", "A"), ("5", "A")]
    assert so(spark, [], "A", None) is None and so(spark, None, "A", []) is None
    assert so(spark, [a], "A", None) == 1.0 and so(spark, [a], "B", None) == 0.0 and so(spark, [a, b], "A", None) == 0.5
    assert so(spark, [a], "A", []) == 0.5 and so(spark, [a], "B", []) == 0.0
    assert so(spark, [a], "A", four) == pytest.approx(0.5 + 0.5 * 0.25)
    assert so(spark, [a], "Externa", [("9", "A")]) == 0.5 and so(spark, [a], "Externa", [("9", "B")]) == 0.0


@pytest.mark.parametrize(
    ("p", "n", "k", "metric", "want"),
    [
        (["a"] * 1, ["a", "b"], 2, "containment", 1.0),
        (["a", "b"], ["c"], 2, "containment", 0.0),
        ([], ["a"], 2, "containment", 0.0),
        (["a", "b"], ["b", "a"], 2, "containment", 0.5),
        (list("abcdefghijkl"), list("abcdefghijkl"), 2, "dice", 1.0),
        (list("abcdefghijkl"), list("abcdefghijkl") + ["z"], 2, "dice", 2 * 11 / 23),
        (list("abcdefghijkl"), list("lkjihgfedcba"), 2, "containment", 0.0),
        (["a", "b", "a"], ["a"], 1, "containment", 0.5),
    ],
)
def test_literal_both_ways(spark, p, n, k, metric, want):
    df = spark.createDataFrame([(p, n)], "p array<string>, n array<string>")
    assert df.select(S.literal_similarity(F.col("p"), F.col("n"), k, metric)).first()[0] == pytest.approx(want)
    left, right = spark.createDataFrame([(1, p)], "premise_id int, tokens array<string>"), spark.createDataFrame([(2, n)], "norm_id int, tokens array<string>")
    row = S.literal_pairs(left, right, k, metric).first()
    assert (row.literal if row else 0.0) == pytest.approx(want)


@pytest.mark.parametrize("most", [0, 10_000])
def test_literal_pairs_by_broadcast_and_by_salted_join(spark, monkeypatch, most):
    """All pairs against the column form: short and long premises, and a gram that all norms share."""
    monkeypatch.setattr(S, "MAX_BROADCAST_GRAMS", most)
    rnd = random.Random(3)
    words = lambda n: [rnd.choice("abcdefgh") for _ in range(n)]
    left = spark.createDataFrame([(i, ["x", "y", *words(n)]) for i, n in enumerate([0, 1, 4, 9, 10, 20])], "premise_id int, tokens array<string>")
    right = spark.createDataFrame([(i, ["x", "y", *words(i % 30)]) for i in range(60)], "norm_id int, tokens array<string>")
    both = left.withColumnRenamed("tokens", "p").join(right.withColumnRenamed("tokens", "q"))
    want = {(r[0], r[1]): round(r[2], 9) for r in both.select("premise_id", "norm_id", S.literal_similarity(F.col("p"), F.col("q"))).collect()}
    got = {(r.premise_id, r.norm_id): round(r.literal, 9) for r in S.literal_pairs(left, right).collect()}
    assert got == {k: v for k, v in want.items() if v > 0}
    assert S.literal_pairs(left.limit(0), right).count() == S.literal_pairs(left, right.limit(0)).count() == 0


def test_literal_parameters():
    for bad in ({"metric": "x"}, {"n": 0}):
        with pytest.raises(ValueError):
            S.literal_similarity(F.lit(1), F.lit(1), **bad)


def vectors(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} bigint, embedding array<double>")


def test_topk_ties_nulls_and_bounds(spark):
    norms = vectors(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, None), (6, [])], "norm_id").withColumn("categoria", F.lit("A"))
    asked = vectors(spark, [(10, [2.0, 0.0]), (11, None), (1, [1.0, 1.0])], "premise_id")
    got = [(r.premise_id, r.norm_id, round(r.similitud, 6)) for r in R.retrieve_topk(asked, norms, 3).orderBy("premise_id", "posicion_rag").collect()]
    assert got == [(1, 1, 0.707107), (1, 2, 0.707107), (1, 3, 0.707107), (10, 1, 1.0), (10, 2, 1.0), (10, 3, 0.0)]
    assert R.retrieve_topk(asked, norms, 0).count() == 0
    assert R.retrieve_topk(asked, norms, 99, max_k=2).count() == 4
    assert R.retrieve_topk(asked, R.metadata_filter(norms, {"$or": []}), 3).count() == 0
    assert R.retrieve_topk(asked, R.metadata_filter(norms, {"categoria": "A"}), 3).count() == 6
    assert R.retrieve_topk(asked.limit(0), norms, 3).count() == 0


def test_premises_in_blocks(spark, monkeypatch):
    norms = vectors(spark, [(i, [float(i), 1.0]) for i in range(20)], "norm_id")
    asked = vectors(spark, [(i, [1.0, float(i)]) for i in range(7)], "premise_id")
    whole = sorted(map(tuple, R.retrieve_topk(asked, norms, 4).collect()))
    monkeypatch.setattr(R, "BLOCK", 2)
    assert sorted(map(tuple, R.retrieve_topk(asked, norms, 4).collect())) == whole


def test_a_scan_holds_one_tile(monkeypatch):
    """A block of premises against one large batch: the memory follows the tile, the result is brute force's."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    monkeypatch.setattr(R, "TILE", 64)
    v = rng.integers(0, 3, (6000, 8)).astype(float)
    v[:, 0] += 1
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    ids = rng.permutation(6000)
    own = ids[:1500]

    class Sent:
        value = (own, unit[:1500])

    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(0, 48001, 8), pa.int32()), pa.array(v.ravel()))], ["id", "v"])
    tracemalloc.start()
    out = pa.Table.from_batches(R._scan(Sent, 5, True)(iter([batch]))).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # all similarities at once: 72 MB
    sims = np.round(unit[:1500] @ unit.T, R.DIGITS)
    sims[np.arange(1500), np.arange(1500)] = -np.inf
    order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :5]
    want = {(int(own[i]), int(ids[j]), float(sims[i, j])) for i in range(1500) for j in order[i]}
    assert set(zip(out["premise_id"], out["norm_id"], out["cosine"], strict=True)) == want and len(out["cosine"]) == 7500


def test_hashed_vectors_count_tokens(spark):
    import zlib

    import numpy as np

    rows = [(0, ["a", "b", "a"]), (1, None), (2, []), (3, ["c"])]
    d = spark.createDataFrame(rows, "id int, t array<string>").select("id", R.hashed_embedding(F.col("t"), 16).alias("v"))
    got = {r["id"]: np.array(r["v"], "f4") for r in d.collect()}
    for i, tokens in rows:
        want = np.bincount([zlib.crc32(t.encode()) % 16 for t in tokens or []], minlength=16).astype("f4") if tokens else np.zeros(16, "f4")
        assert np.array_equal(got[i], (want / max(float(np.linalg.norm(want)), 1e-9)).astype("f4"))


def test_combined_puts_the_corpus_first_among_equals(spark):
    ev = "premise_id bigint, norm_id bigint, similitud double, posicion_rag int"
    base = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.5, 2)], ev)
    session = spark.createDataFrame([(1, 7, 0.9, 1), (1, 8, 0.7, 2)], ev)
    got = [(r.norm_id, r.origen_orden) for r in R.combine(base, session, 3).orderBy("posicion").collect()]
    assert got == [(1, 0), (7, 1), (8, 1)]


def test_report_and_features(spark):
    schema = f"premise_id bigint, norm_id bigint, posicion_rag int, sb double, literal double, ontologico double, autoridad double, terminos_compartidos double, ivr double, premise_concepts {S.CONCEPTS}"
    p = [("1", "A"), ("2", "B")]
    rows = [(1, 5, 1, 0.8, 0.2, None, 1.0, 0.0, 0.5, p), (1, 6, 2, 0.6, 0.4, 0.3, 0.5, 0.5, 0.7, p), (2, 7, 1, 0.1, 0.0, None, 0.3, 0.0, 0.2, [])]
    s = spark.createDataFrame(rows, schema)
    r = {x.premise_id: x for x in S.report(s).collect()}
    assert r[1].mejor_norma == 6 and r[1].ivr_max == 0.7 and r[2].ontologico_max is None
    f = {x.premise_id: x for x in S.feature_vector(s).collect()}
    assert f[1].asDict().keys() - {"premise_id"} == set(FEATURES)
    assert f[1].so_disponible == 1.0 and f[2].so_disponible == 0.0 and f[1].n_conceptos_premisa == 2.0
    assert f[1].sb_brecha == pytest.approx(0.2) and f[1].ivr_brecha == pytest.approx(0.1)
    assert [x.norm_id for x in S.rerank(s).where("premise_id = 1").orderBy("posicion").collect()] == [6, 5]


def test_best_columns_with_many_ties():
    import numpy as np

    rng = np.random.default_rng(3)
    for values in (3, 1000):
        sims = rng.integers(0, values, (40, 300)) / values
        names = np.stack([rng.permutation(300) for _ in range(40)])
        assert np.array_equal(R._best(sims, names, 5), np.lexsort((names, -sims), axis=1)[:, :5])

import math

import pytest
from pyspark.sql import functions as F

from cotejo.operators import evaluate as E
from cotejo.operators import label as L


def test_thresholds(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.9, 0.70, 0.69, 0.45, 0.44, float("nan"), None])], "i int, sb double")
    got = [r.v for r in df.select("i", L.by_thresholds(F.col("sb")).alias("v")).orderBy("i").collect()]
    assert got == ["proximo", "proximo", "distante", "distante", "no_definido", "no_definido", "no_definido"]


def test_percentile_and_verdicts(spark):
    v = spark.createDataFrame([(float(i),) for i in range(5)], "x double")
    assert L.percentile_threshold(v, "x", 85).first()[0] == pytest.approx(3.4)
    assert L.percentile_threshold(v.limit(0), "x").first()[0] == 0.60
    a = spark.createDataFrame([("afin", 0.9, 0.9), ("afin", 0.0, 0.8), ("no_definido", 0.95, 0.95), ("critica", 0.1, 0.2)], "categoria string, ivr_top3 double, ivr_max double")
    got = {r.puntaje: r.veredicto for r in L.assign_verdicts(a, percentile=50).collect()}
    assert got == {0.9: "proximo", 0.8: "proximo", 0.95: "no_definido", 0.1: "distante"}
    assert {r.veredicto for r in L.assign_verdicts(a, strategy="umbral", percentile=50).where("categoria = 'no_definido'").collect()} == {"proximo"}
    with pytest.raises(ValueError):
        L.verdict(F.lit(1), F.lit("a"), F.lit(1), "x")


def test_mcnemar_and_p_value(spark):
    rows = [("a", "a", "b")] * 20 + [("a", "a", "a")] * 4 + [("a", "b", "a")]
    r = E.mcnemar(spark.createDataFrame(rows, "y string, pred_h string, pred_b string")).first()
    assert (r.b, r.c) == (20, 1) and r.chi2 == pytest.approx(18**2 / 21)
    assert E.mcnemar_p_value(r.chi2, 21) < 0.001 and E.mcnemar_p_value(0.0, 0) == 1.0
    assert E.mcnemar_p_value(35.21, 9) == pytest.approx(2.96e-9, rel=0.01)


def test_metrics_with_an_absent_class(spark):
    rows = [("proximo", "proximo"), ("proximo", "distante"), ("distante", "proximo")]
    c = E.confusion(spark.createDataFrame(rows, "y string, pred string"))
    assert c.count() == 9
    m = {r.clase: r for r in E.class_metrics(c).collect()}
    assert m["proximo"].precision == m["proximo"].recall == 0.5 and m["no_definido"].f1 == 0.0
    s = E.summary_metrics(c).first()
    assert s.accuracy == pytest.approx(1 / 3) and s.fp_proximo == 1


def test_auc_mid_ranks(spark):
    rows = [(0.1, False), (0.4, True), (0.4, False), (0.8, True), (0.8, True), (0.8, False)]
    df = spark.createDataFrame(rows, "s double, y boolean")
    pairs = [(p > n) + 0.5 * (p == n) for p, a in rows if a for n, b in rows if not b]
    assert E.auc(df, "s", F.col("y")).first()[0] == pytest.approx(sum(pairs) / len(pairs))
    assert math.isnan(E.auc(df.where("y"), "s", F.col("y")).first()[0])


def test_eta_squared(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, ivr_max double")
    means, values = [2.0, 2.0, 5.0], [1.0, 3.0, 5.0]
    var = lambda x: sum((v - sum(x) / len(x)) ** 2 for v in x) / (len(x) - 1)
    assert E.eta_squared(df, "g").first()[0] == pytest.approx(100 * var(means) / var(values))
    assert E.eta_squared(df.limit(1), "g").first()[0] == 0.0


def test_splits(spark):
    df = spark.range(400).select("id", (F.col("id") % 10).alias("g"), F.when(F.col("id") < 300, "a").otherwise("b").alias("v"))
    s = E.grouped_split(df, "g")
    assert s.count() == 400 and s.groupBy("g").agg(F.countDistinct("es_test").alias("n")).where("n > 1").count() == 0
    assert s.where("es_test").select("g").distinct().count() == 3
    t = {r.v: r.n for r in E.stratified_split(df, "v", "id").where("es_test").groupBy("v").agg(F.count("*").alias("n")).collect()}
    assert t["a"] == pytest.approx(75, abs=8) and t["b"] == pytest.approx(25, abs=5)


def test_balanced_sample(spark):
    rows = [(i, "x" if i < 8 else "y") for i in range(10)]
    df = spark.createDataFrame(rows, "id int, categoria string")
    got = [r.id for r in L.balanced_sample(df, 6, key=F.struct("id")).collect()]
    assert got == [0, 1, 2, 8, 9, 3]
    assert L.balanced_sample(df, 1, key=F.struct("id")).count() == 1
    assert L.balanced_sample(df.limit(0), 5, key=F.struct("id")).count() == 0


def test_model_learns_and_comes_back(spark, tmp_path):
    from cotejo.operators import model as M

    rows = [(i, ["proximo", "distante", "no_definido"][i % 3], float(i % 3) / 2 + (i % 5) / 100, f"d{i % 7}") for i in range(210)]
    data = spark.createDataFrame(rows, "article_id int, veredicto string, sb_max double, dominio string")
    m = M.train(data, trees=10, depth=5)
    M.save(m, str(tmp_path / "m"))
    p = M.predict(M.load(str(tmp_path / "m")), data)
    assert p.where("pred = veredicto").count() == 210
    r = p.first()
    assert set(r.probabilidades) == {"proximo", "distante", "no_definido"} and r.probabilidad == max(r.probabilidades.values())
    assert {x.familia for x in E.importances_by_family(M.importances(m)).collect()} == {"sb", "literal", "ontologico", "autoridad"}
    split = E.grouped_split(data, "dominio")
    c = E.compare_models(M.predict(m, split.where("es_test")).withColumnRenamed("pred", "pred_h"), split.where("not es_test"))
    assert {r.modelo: round(r.accuracy, 3) for r in c.collect()}["modelo_hibrido"] == 1.0


def test_percentiles_are_numpys(spark):
    import numpy as np

    from cotejo.operators.ranges import percentiles

    rng = np.random.default_rng(2)
    v = np.r_[rng.normal(size=500), np.zeros(200), [7.0]]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "x double")
    shares = [0.0, 0.15, 0.5, 0.85, 0.999, 1.0]
    assert list(percentiles(df, "x", shares).first()) == pytest.approx(list(np.quantile(v, shares)))
    assert percentiles(df.where("x > 100"), "x", [0.5]).first()[0] is None

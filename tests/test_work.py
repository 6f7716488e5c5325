"""Costly steps are done once and on all cores, however many readers their results have."""

from pyspark.sql import functions as F

from cotejo.operators import clean as CL
from cotejo.operators import corpora as CO
from cotejo.operators import layout as LA
from cotejo.operators import model as M
from cotejo.operators import segment as SG
from cotejo.operators import thesaurus as TH


def counted(spark, column, kind):
    """``column`` through a function, and how many values it has seen."""
    seen = spark.sparkContext.accumulator(0)

    def same(x):
        seen.add(1)
        return x

    return F.udf(same, kind)(column), seen


def test_pages_are_cleaned_once(spark):
    d = spark.createDataFrame([("d", p, "\n".join(f"línea {p}{i} de texto." for i in range(8))) for p in range(1, 5)], "doc_id string, page int, text string")
    text, seen = counted(spark, F.col("text"), "string")
    assert len(CL.drop_headers_footers(CL.page_lines(d.withColumn("text", text))).collect()) == 4
    assert seen.value == 4


def test_documents_are_prepared_once(spark):
    lines = [(1, f"Artículo {i}.- Texto del artículo número {i}.") for i in range(1, 6)]
    d = spark.createDataFrame([("a", lines), ("b", lines)], "doc_id string, lines array<struct<page:int,line:string>>")
    own, seen = counted(spark, F.col("lines"), "array<struct<page:int,line:string>>")
    assert len(SG.segment_documents(d.withColumn("lines", own)).collect()) == 10
    assert seen.value <= 4  # once for the filter that Spark adds to an explode, once for the lines


def test_words_are_laid_out_a_few_times(spark):
    rows = [("d", p, f"w{i}", 50.0 + i % 12 // 6 * 270 + i % 6 * 38, 60.0 + i // 12 * 14) for p in range(3) for i in range(360)]
    d = spark.createDataFrame(rows, "doc_id string, page int, text string, x0 double, top double")
    x0, seen = counted(spark, F.col("x0"), "double")
    words = d.withColumn("x0", x0).withColumns({"x1": F.col("x0") + 34, "bottom": F.col("top") + 10})
    assert LA.reorder_columns(words).count() == 180
    assert seen.value <= 9 * len(rows)


def test_a_forest_grows_on_all_cores(spark, monkeypatch):
    class Spy:
        def __init__(self, stages):
            pass

        def fit(self, rows):
            return rows.rdd.getNumPartitions()

    monkeypatch.setattr(M, "Pipeline", Spy)
    d = spark.range(100).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("veredicto"), (F.col("id") / 100).alias("sb_max")).coalesce(1)
    assert M.train(d) >= spark.sparkContext.defaultParallelism


def test_phrases_are_counted_by_sums_alone(spark, monkeypatch):
    """No row a document and phrase is shuffled or sorted: a text's phrases are distinct already."""
    plans, keep = [], TH.__dict__.get("kept")

    def spy(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(TH, "kept", spy, raising=False)
    rows = [(i, "Ámbar gris claro. " * 3) for i in range(15)] + [(3, "Ámbar gris claro"), (None, "ámbar gris claro")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted(tuple(r) for r in TH.find_candidates(docs.where("doc_id <> 3"), spark.createDataFrame([("nada",)], "form string"), top=2).collect())
    assert got == [("gris claro", 14, "ámbar gris claro ámbar gris claro ámbar"), ("ámbar gris", 14, "ámbar gris claro ámbar gris claro")]
    assert len(plans) == 1 and "SortAggregate" not in plans[0] and "count(distinct" not in plans[0]
    assert {r.fragmentos for r in TH.find_candidates(docs, spark.createDataFrame([("nada",)], "form string")).collect()} == {15}


def test_suggestions_read_few_texts_again(spark):
    rows = [(i, "Sobre el derecho de huelga" if i % 2 else "nada que ver") for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id int, text string")
    text, seen = counted(spark, F.col("text"), "string")
    got = [tuple(r) for r in TH.suggest_forms(d.withColumn("text", text), "Derechos de huelgas").collect()]
    assert got[0] == ("derecho de huelga", 10)
    assert seen.value <= 3 * len(rows)  # counted, sought, and told apart where met


def test_numbered_documents_stay_in_their_rows(spark):
    """One grouping of the lines, and none where documents come whole: no windows, joins or sorts of lines."""
    rows = [(d, "T", i, t) for d in (1, 2) for i, t in enumerate(["Mons. Crepaldi", "1 Uno dice.", "A P É N D I C E", "2. Dos dice:", "sigue."])]
    lines = spark.createDataFrame(rows, "doc_id int, titulo string, line_no int, line string")
    for df in (CO.compendium_blocks(lines), CO.council_blocks(lines, "Constituciones")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Window" not in plan and "Join" not in plan
    docs = spark.createDataFrame([(1, "T", [r[3] for r in rows[:5]]), (2, "T", []), (3, "T", None)], "doc_id int, titulo string, lines array<string>")
    for df in (CO.compendium_documents(docs), CO.council_documents(docs, "Constituciones")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    assert [(r.numeral_id, r.texto) for r in CO.compendium_documents(docs).collect()] == [(1, "Uno dice. 2. Dos dice: sigue.")]
    got = [(r.block, r.numeral_id, r.contexto_jerarquico, r.texto) for r in CO.council_documents(docs, "Constituciones").collect()]
    base = "Concilio Vaticano II > Constituciones > T"
    assert got == [(1, 1, base, "Uno dice."), (3, 2, f"{base} > APÉNDICE", "Dos dice: sigue.")]


def test_pages_and_documents_become_lines_once(spark):
    rows = [("d", p, f"uno de matri-\nmonio {p}") for p in range(1, 4)] + [("e", 1, ""), ("f", 1, None), ("f", 2, "dos")]
    d = spark.createDataFrame(rows, "doc_id string, page int, text string")
    text, seen = counted(spark, F.col("text"), "string")
    docs = CL.whole_documents(CL.page_lines(d.withColumn("text", text)))
    assert {r.doc_id: len(r.lines) for r in docs.collect()} == {"d": 6, "f": 1}
    assert seen.value == len(rows)
    whole = spark.createDataFrame([("a", [(1, "x"), (1, "y")]), ("b", []), ("c", None)], "doc_id string, lines array<struct<page:int,line:string>>")
    own, seen = counted(spark, F.col("lines"), "array<struct<page:int,line:string>>")
    assert [tuple(r) for r in CL.as_lines(whole.withColumn("lines", own)).collect()] == [("a", 1, 0, "x"), ("a", 1, 1, "y")]
    assert seen.value == 3

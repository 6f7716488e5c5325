import pytest
from pyspark.sql import functions as F

from cotejo.operators import clean as CL
from cotejo.operators import layout as LA
from cotejo.operators import segment as SG
from cotejo.operators import thesaurus as TH
from cotejo.plans.session import Session, SessionError


def pages(spark, texts, doc="d"):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts, 1)], "doc_id string, page int, text string")


def body(n):
    return "\n".join(f"línea {n} cuerpo {chr(97 + i)} con texto propio." for i in range(5))


def test_headers_footers_and_page_numbers(spark):
    texts = [f"DIÓCESIS\n{body(n)}\nPágina {n} de 4" for n in range(1, 4)] + ["DIÓCESIS\nÚltima.\n4"]
    lines = lambda ts: CL.drop_headers_footers(CL.page_lines(pages(spark, ts))).select("page", F.explode("lines").alias("line"))
    kept = lines(texts)
    assert kept.where("line like 'DI%' or line like 'P%' or line = '4'").count() == 0
    assert kept.where("page = 4").first().line == "Última."
    single = lines([f"DIÓCESIS\n{body(1)}"])
    assert single.where("line = 'DIÓCESIS'").count() == 1


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        (["el matri-", "monio es"], ["el matrimonio es"]),
        (["lo económico-social", "es económico-", "social aquí"], ["lo económico-social", "es económico-social aquí"]),
        (["de 1-", "a 6"], ["de 1-", "a 6"]),
        (["así-", "Pero no"], ["así-", "Pero no"]),
        (["con-", "sti-", "tución"], ["constitución"]),
        (["lo económico-social y economicosocial, económicosocial", "es económico-", "social"], ["lo económico-social y economicosocial, económicosocial", "es económicosocial"]),
        ([], []),
    ],
)
def test_hyphens(spark, lines, want):
    docs = spark.createDataFrame([("d", [(1 + i, t) for i, t in enumerate(lines)])], "doc_id string, lines array<struct<page:int,line:string>>")
    assert [x.line for x in CL.merge_hyphens(docs).first().lines] == want


def test_a_joined_line_has_its_first_page(spark):
    docs = CL.prepare_documents(pages(spark, ["uno de matri-", "monio y otro", ""]))
    assert [tuple(x) for x in docs.first().lines] == [(1, "uno de matrimonio y otro")]
    assert [tuple(r) for r in CL.as_lines(docs).collect()] == [("d", 1, 0, "uno de matrimonio y otro")]
    assert CL.prepare_documents(pages(spark, ["", None])).count() == 0


def test_numbering_gaps(spark):
    u = spark.createDataFrame([("a", n) for n in (1, 2, 5, 5, 6)] + [("b", 1), ("b", 2), ("c", 9)], "doc_id string, n int")
    g = CL.numbering_gaps(u).select("doc_id", CL.gap_warning(F.col("faltan"), F.col("repetidos")).alias("w")).collect()
    assert [tuple(r) for r in g] == [("a", "faltan [3, 4]; repetidos [5]")]


def test_next_number(spark):
    df = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(["uno", "3. Tres", "dos", "4) Cuatro"])], "doc_id string, page int, line_no int, line string")
    assert [r.siguiente for r in CL.next_number(df).orderBy("line_no").collect()] == [3, 4, 4, None]


@pytest.fixture
def seg(spark):
    """Lines of page 1, or (page, line) pairs, to (scheme, fragments, warnings)."""

    def run(*texts, **kw):
        lines = [(1, t) if isinstance(t, str) else t for t in texts]
        docs = spark.createDataFrame([("d", lines)], "doc_id string, lines array<struct<page:int,line:string>>")
        rows = [r.asDict() for r in SG.segment_documents(docs, **kw).orderBy("orden").collect()]
        return (rows[0]["esquema"], rows, rows[0]["advertencias"]) if rows else (None, [], [])

    return run


def test_articles_headings_and_context(seg):
    scheme, found, _ = seg(
        "DECRETO GENERAL", "TÍTULO I", "DE LOS FIELES", "Artículo 1.- Todos los fieles tienen derechos.", "según el artículo 2 de este decreto se aplica.", "CAPÍTULO I – DEBERES", "Art. 2º Los deberes son varios.",
        "DE LA PARROQUIA", "Artículo TERCERO. La parroquia.", "TÍTULO II", "Artículo 4 bis. Otro.", least=1,
    )
    assert scheme == "articulado"
    assert [(f["etiqueta"], f["id_norma"]) for f in found] == [("Artículo 1", 1), ("Artículo 2", 2), ("Artículo TERCERO", 3), ("Artículo 4 bis", 4)]
    assert found[0]["contexto"] == ["TÍTULO I – DE LOS FIELES"] and "artículo 2" in found[0]["texto"]
    assert found[1]["contexto"] == ["TÍTULO I – DE LOS FIELES", "CAPÍTULO I – DEBERES"]
    assert found[2]["contexto"][-1] == "DE LA PARROQUIA" and found[3]["contexto"] == ["TÍTULO II"]


def test_minor_family_is_a_subheading(seg):
    _, found, _ = seg("Can. 1 Uno.", "Can. 2 Dos.", "Art. 1 – DE LA COLACIÓN", "Can. 3 Tres.", "Can. 4 Cuatro.")
    assert [f["id_norma"] for f in found] == [1, 2, 3, 4] and found[2]["contexto"] == ["Art. 1 – DE LA COLACIÓN"]


def test_numbers_carry_on_and_inner_lists_stay(seg):
    texts = ["1. Primero dice:", "1. inciso", "2. Segundo dice.", "3. Tercero.", "5. Quinto.", "6. Sexto.", "90. Lejos."]
    scheme, found, warnings = seg(*texts)
    assert scheme == "numerado" and [f["id_norma"] for f in found] == [1, 2, 3, 5, 6]
    assert "Numeración no consecutiva (faltan [4])." in warnings
    assert seg("20. Veinte dice.", *[f"{n}. Y así." for n in range(21, 26)])[0] == "numerado"
    assert seg("20. Veinte dice.", "25. Y así.")[0] == "ventanas"


def test_windows_pages_and_giant_sentences(seg):
    words = " ".join(f"palabra{i}" for i in range(1200))
    scheme, found, warnings = seg(words, (2, "Fin de todo."), most=500)
    assert scheme == "ventanas" and [len(f["texto"].split()) for f in found] == [500, 500, 203]
    assert found[-1]["pagina_fin"] == 2 and all(f["parte"] == 1 for f in found) and warnings[0].startswith("Sin estructura")
    assert seg() == (None, [], [])
    parts = seg("Art. 1. Uno.", "Art. 2. Dos.", "Art. 3. " + "Una frase corta. " * 300, most=100)[1]
    assert {f["partes_total"] for f in parts if f["id_norma"] == 3} == {10} and max(len(f["texto"].split()) for f in parts) <= 100


def test_repeated_headings_and_titles_in_force(seg):
    _, found, _ = seg("Preámbulo con más de diez palabras para que no se pierda al final.", "LIBRO I", "TÍTULO I", "Art. 1. Uno.", "CAPÍTULO I", "Art. 2. Dos.", "CAPÍTULO II", "Art. 3. Tres.", "TÍTULO II", "Texto suelto que va aquí.", "Art. 4. Cuatro.")
    assert [(f["etiqueta"], f["contexto"]) for f in found] == [
        ("Preámbulo", []), ("Artículo 1", ["LIBRO I", "TÍTULO I"]), ("Artículo 2", ["LIBRO I", "TÍTULO I", "CAPÍTULO I"]), ("Artículo 3", ["LIBRO I", "TÍTULO I", "CAPÍTULO II"]),
        ("Texto sin numerar", ["LIBRO I", "TÍTULO II"]), ("Artículo 4", ["LIBRO I", "TÍTULO II"]),
    ]


WORDS = "doc_id string, page int, text string, x0 double, x1 double, top double, bottom double"


def laid(pages):
    """Rows of words (text, x0, x1, top, bottom) of numbered pages."""
    return [("d", p, *w) for p, words in pages.items() for w in words]


def column(x, n, start=100, tag="w", words=3):
    return [(f"{tag}{i}-{j}", x + 60.0 * j, x + 60.0 * j + 50, start + 14.0 * i, start + 14.0 * i + 10) for i in range(n) for j in range(words)]


@pytest.fixture
def read(spark):
    def run(pages):
        rows = LA.reorder_columns(spark.createDataFrame(laid(pages), WORDS)).orderBy("page", "line_no").collect()
        assert [r.line_no for r in rows if r.page == 1] == list(range(sum(r.page == 1 for r in rows)))
        out = {}
        for r in rows:
            out.setdefault(r.page, []).append(r.line.split(" ")[0].split("-")[0])
        return out

    return run


def named(tag, n):
    return [f"{tag}{i}" for i in range(n)]


def test_two_columns_read_left_then_right(read):
    two = column(50.0, 12, tag="L") + column(300.0, 12, tag="R")
    title, foot = ("TÍTULO", 100.0, 480.0, 60.0, 70.0), ("PIE", 100.0, 480.0, 780.0, 790.0)
    assert read({1: [title, *two, foot]}) == {1: ["TÍTULO", *named("L", 12), *named("R", 12), "PIE"]}
    middle = ("CAPÍTULO", 100.0, 480.0, 100.0 + 14 * 12, 110.0 + 14 * 12)
    below = column(50.0, 12, 100 + 14 * 13, "C") + column(300.0, 12, 100 + 14 * 13, "D")
    assert read({1: [*two, middle, *below]}) == {1: named("L", 12) + named("R", 12) + ["CAPÍTULO"] + named("C", 12) + named("D", 12)}
    uneven = column(50.0, 30, tag="L") + column(290.0, 22, tag="R", words=4)
    assert read({1: uneven}) == {1: named("L", 30) + named("R", 22)}


def test_pages_that_are_not_two_columns_are_left_out(read):
    full = [(f"w{i}-{j}", 60.0 + 36 * j, 92.0 + 36 * j, 100.0 + 14 * i, 110.0 + 14 * i) for i in range(40) for j in range(13)]
    index = full[: 13 * 30] + [(str(i), 560.0, 571.0, 100.0 + 14 * i, 110.0 + 14 * i) for i in range(30)]
    margin = column(150.0, 40, words=7, tag="U") + [(f"n{i}", 60.0, 75.0, 100.0 + 14 * i, 110.0 + 14 * i) for i in range(20)]
    three = column(50.0, 30, tag="A", words=2) + column(230.0, 30, tag="B", words=2) + column(410.0, 30, tag="C", words=2)
    indent = full[: 13 * 30] + column(330.0, 8, 100 + 14 * 30, "S")
    for words in (column(50.0, 40, words=8), full, index, margin, three, indent, column(50.0, 3, tag="L") + column(300.0, 3, tag="R")):
        assert read({1: words}) == {}


def test_a_sparse_last_page_is_read_by_the_other_pages_gutter(read):
    two = column(50.0, 30, tag="L") + column(300.0, 30, tag="R")
    sparse = column(50.0, 30, tag="L") + column(300.0, 3, tag="R")
    assert read({1: sparse}) == {}
    assert read({1: two, 2: two, 3: sparse})[3] == named("L", 30) + named("R", 3)
    signature = column(50.0, 30, tag="U", words=3) + column(300.0, 2, 100 + 14 * 32, "S")
    assert 3 not in read({1: two, 2: two, 3: signature})
    # one page of two columns in ten is no document of two columns
    full = [(f"w{i}-{j}", 60.0 + 36 * j, 92.0 + 36 * j, 100.0 + 14 * i, 110.0 + 14 * i) for i in range(40) for j in range(13)]
    assert read({p: two if p == 1 else full for p in range(1, 11)}) == {}


def test_even_sample(spark):
    got = spark.range(1).select(LA.even_sample_column(F.sequence(F.lit(0), F.lit(19)), 8).alias("a"), LA.even_sample_column(F.sequence(F.lit(0), F.lit(5)), 8).alias("b")).first()
    assert got.a == [0, 3, 5, 8, 11, 14, 16, 19] and got.b == list(range(6))


def test_session_loads_once_searches_and_forgets(spark):
    text = "\n".join(f"Artículo {i}. La parroquia número {i} celebra el bautismo de los niños del lugar." for i in range(1, 6))
    asked = spark.createDataFrame([(1, "bautismo de niños")], "premise_id bigint, texto string")
    with Session(spark) as s:
        asked = asked.withColumn("embedding", s.embed(F.col("texto")))
        assert s.search(asked, 3).count() == 0
        assert s.load(pages(spark, [text]), name="reglamento") == ["d"]
        assert s.load(pages(spark, [text]), name="reglamento") == []
        assert s.documents().first().fragmentos == 5 and s.search(asked, 3).count() == 3
        base = spark.createDataFrame([(1, 99, 1.0, 1)], "premise_id bigint, norm_id bigint, similitud double, posicion_rag int")
        assert s.search_combined(asked, base, 2).orderBy("posicion").first().norm_id == 99
        assert s.fragments.first().cita.startswith("reglamento, Artículo")
        with pytest.raises(SessionError):
            s.load(pages(spark, [text], "e"), name="x", authority=0.5)
        s.remove("d")
        assert s.documents().count() == 0
        view = s.view
    assert not spark.catalog.tableExists(view)


RAW = {
    "conceptos": {
        "ID_PAPA": {"termino_canonico": "Romano Pontífice", "variaciones_lexicas": ["papa", "santo padre"], "categoria": "A"},
        "ID_PADRE": {"termino_canonico": "padre", "variaciones_lexicas": ["papa", "padre"], "categoria": "Ax", "nivel_autoridad": 2, "extra": 1},
        "mal": {"termino_canonico": "", "variaciones_lexicas": [], "categoria": ""},
        "ID_X": 5,
    }
}


def test_thesaurus_forms_and_detection(spark):
    concepts = TH.concepts_frame(spark, TH.clean_concepts(RAW))
    forms = {r.form: r.concept_id for r in TH.forms_table(concepts).collect()}
    assert forms["papa"] == "ID_PAPA" and forms["romano pontifice"] == "ID_PAPA"
    d = spark.createDataFrame([(1, ["el", "santo", "padre"]), (2, ["papas"]), (3, [])], "doc_id int, tokens array<string>")
    got = sorted((r.doc_id, r.concept_id) for r in TH.detect_concepts(d, TH.forms_table(concepts)).collect())
    assert got == [(1, "ID_PADRE"), (1, "ID_PAPA")]
    s = d.withColumn("tokens", F.when(F.col("doc_id") == 2, F.array(F.lit("pap"))).otherwise(F.col("tokens")))
    assert (2, "ID_PAPA") in [(r.doc_id, r.concept_id) for r in TH.detect_concepts(s, TH.forms_table(concepts, stemmed=True)).collect()]


def test_thesaurus_validation(spark):
    docs = spark.createDataFrame([("el Papa habló al padre",)] * 16, "text string")
    found = {(r.nivel, r.concepto, r.regla) for r in TH.validate(spark, RAW, docs, {"A"}).collect()}
    assert {
        ("ERROR", "mal", "id"), ("ERROR", "mal", "falta_canonico"), ("ERROR", "mal", "faltan_variantes"), ("ERROR", "mal", "falta_categoria"), ("ERROR", "ID_X", "no_objeto"),
        ("AVISO", "ID_PADRE", "categoria_desconocida"), ("AVISO", "ID_PADRE", "campos_desconocidos"), ("ERROR", "ID_PADRE", "nivel_autoridad"), ("AVISO", "ID_PADRE", "termino_repetido"),
        ("ERROR", "", "termino_ambiguo"), ("AVISO", "ID_PAPA", "canonico_ausente"), ("AVISO", "ID_PAPA", "palabra_comun"), ("INFO", "", "con_nivel_autoridad"),
    } <= found
    assert TH.exit_code(TH.validate(spark, RAW, None, None)) == 1
    assert {r.regla for r in TH.validate(spark, {}, None, None).collect()} == {"sin_conceptos", "sin_corpus"}
    with pytest.raises(TH.InvalidThesaurus, match="line 1"):
        TH.parse_thesaurus("{,")


def test_candidates_and_suggestions(spark, tmp_path):
    rows = [(i, "La pérdida del estado clerical y la dispensa.") for i in range(20)] + [(30 + i, "Sobre derecho de huelga") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    known = spark.createDataFrame([("dispensa",)], "form string")
    got = {r.frase: r.fragmentos for r in TH.find_candidates(docs, known).collect()}
    assert got["estado clerical"] == 20 and not any("huelga" in k for k in got)
    none = spark.createDataFrame([("el estado clerical pleno",)], "form string")
    assert "estado clerical" not in {r.frase for r in TH.find_candidates(docs, none).collect()}
    assert TH.suggest_forms(docs, "Dimisión del estado clerical").first().frase.endswith("estado clerical")
    assert [r.frase for r in TH.suggest_forms(docs, "Derechos de huelgas").collect()][0] == "derecho de huelga"
    assert TH.suggest_forms(docs, "de la").count() == 0
    TH.write_candidates_csv(TH.find_candidates(docs, known), str(tmp_path / "c.csv"))
    assert (tmp_path / "c.csv").read_bytes().startswith(b"\xef\xbb\xbffrase;")


def test_no_plan_pairs_rows_blindly(spark):
    """Candidates and detection join by equality."""
    docs = spark.createDataFrame([(1, "estado clerical")], "doc_id int, text string")
    known = spark.createDataFrame([("dispensa",)], "form string")
    for df in (TH.find_candidates(docs, known), CL.drop_headers_footers(CL.page_lines(pages(spark, ["a"])))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_states_of_files_are_errors_of_their_kind():
    from cotejo import errors as X

    X.raise_for_state("ok")
    for state, kind in (("cifrado", X.InvalidPdf), ("ilegible: PdfReadError", X.InvalidPdf), ("demasiado grande", X.PdfTooLarge), ("demasiadas páginas", X.PdfTooLarge), ("sin texto", X.NoNativeText)):
        with pytest.raises(kind, match="a.pdf"):
            X.raise_for_state(state, "a.pdf")
        assert issubclass(kind, X.SessionError)

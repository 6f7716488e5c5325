import json

import pytest
from pyspark.sql import functions as F

from cotejo.operators import classify as C
from cotejo.operators import corpora as CO
from cotejo.sources import html as H
from cotejo.sources import tables as TB
from cotejo.streaming import cache as ST

PAGE = """<!DOCTYPE html><html lang="es"><head><title> Un &amp; otro
 título</title><meta name="author" content="Ana"><meta content="2024-01-02" property="article:published_time"></head>
<body><nav><p>menú</p></nav><article><h1>Título</h1><!-- <p>nota</p> --><p>Uno <a href="/x">dos</a>.</p><script>var p="<p>no</p>"</script><p> </p><li>tres</li></article>
<footer><p>pie</p></footer></body></html>"""


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "h string").select(f(F.col("h")).alias("v")).first().v


def test_main_text(spark):
    assert one(spark, PAGE, H.main_text) == "Título\nUno dos.\ntres"
    for blank in (None, "", "   ", "<html><body></body></html>", '<body><img src="a"></body>'):
        assert one(spark, blank, H.main_text) is None
    assert one(spark, "<body><p>sin artículo", H.main_text) is None
    assert one(spark, "<body><p>sin artículo</p>", H.main_text) == "sin artículo"
    assert one(spark, PAGE, lambda c: H.bounded_text(c, 10)) is None


def test_metadata(spark):
    df = spark.createDataFrame([(PAGE,), ("",), (None,)], "html string")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in H.metadata(F.col("html")).items()]).collect()]
    assert got == [("Un & otro título", "Ana", "2024-01-02", "es")] + [("",) * 4] * 2
    assert one(spark, PAGE, H.headline) == "Un & otro título" and one(spark, "", H.headline) is None


def test_links_and_index(spark):
    html = '<a href="a_const_1_sp.html"> Lumen  <b>g</b></a><a href="a_const_1_sp.html">otra</a><a href="x_decl_2_sp.html">D</a><a>n</a>'
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [tuple(r) for r in H.index_links(df, ["_const_"], "_sp.html", "http://b/").collect()] == [("http://b/a_const_1_sp.html", "Lumen g")]
    assert H.links(df).count() == 3


def test_ancestor_paths(spark):
    html = '<ul><li>LIBRO I (Cann. 1-203)<ul><li>TÍTULO I <a href="esp/documents/cic_1.html">(Can. 7)</a></li><li><a href="other">x</a></li></ul></li></ul>'
    df = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    assert [tuple(r) for r in H.ancestor_paths(df, "esp/documents/cic_").collect()] == [(1, "esp/documents/cic_1.html", "LIBRO I (Cann. 1-203) > TÍTULO I (Can. 7)")]


def lines(spark, texts):
    return spark.createDataFrame([(1, "Doc", i, t) for i, t in enumerate(texts)], "doc_id int, titulo string, line_no int, line string")


def test_council_documents(spark):
    long = "palabra " * 30
    texts = ["PROEMIO", "Texto inicial.", "1. Primero dice.", "CAPÍTULO I", "Título corto", long, "PERICLES FELICI", "2.ª Segundo dice:", "y sigue.", "A P É N D I C E", "Anexo uno.", "3 Tercero.", "NOTAS", "4. No entra."]
    got = [(r.numeral_id, r.contexto_jerarquico.split(" > ")[3:], r.texto) for r in CO.council_blocks(lines(spark, texts), "Declaraciones").orderBy("block").collect()]
    assert got == [(0, ["PROEMIO"], "Texto inicial."), (1, [], "Primero dice. " + long.strip()), (2, [], "Segundo dice: y sigue."), (0, ["APÉNDICE"], "Anexo uno."), (3, ["APÉNDICE"], "Tercero.")]
    got = [(r.numeral_id, r.contexto_jerarquico.split(" > ")[3:]) for r in CO.council_blocks(lines(spark, texts), "Constituciones").orderBy("block").collect()]
    assert got == [(0, []), (1, []), (2, []), (0, ["APÉNDICE"]), (3, ["APÉNDICE"])]
    assert CO.council_blocks(lines(spark, ["ART. 1", "IV. Romano.", "5. Cinco.", "DECRETO"]), "Decretos").first().texto == "Cinco."


def test_compendium_counts_on(spark):
    texts = ["1 Índice.", "Mons. Crepaldi", "5 antes.", "1 Uno ( a ) dice", "30 no es numeral.", "corta", "2 Dos.", "4 Cuatro.", "9 lejos."]
    got = [(r.numeral_id, r.texto) for r in CO.compendium_blocks(lines(spark, texts)).orderBy("numeral_id").collect()]
    assert got == [(1, "Uno (a) dice 30 no es numeral."), (2, "Dos."), (4, "Cuatro. 9 lejos.")]


def test_compendium_ends_behind_its_last_words_and_has_no_menu(spark):
    html = "<p>[ AR - DE - EN <a>ES</a> ]</p><p>Crepaldi</p><p>2 no es el primero</p><p>1 Uno dice.</p><p>3 Tres, y la posesión eterna de Ti mismo»...</p><p>4 Nota al pie.</p><p>Más notas, que no entran.</p>"
    pages = spark.createDataFrame([(1, html), (2, None)], "doc_id int, html string")
    rows = CO.compendium_blocks(CO.document_lines(pages, CO.COMPENDIUM_CUT, id_col="doc_id"))
    assert [(r.numeral_id, r.texto) for r in rows.orderBy("numeral_id").collect()] == [(1, "Uno dice."), (3, "Tres, y la posesión eterna de Ti mismo...».")]
    assert CO.compendium_blocks(lines(spark, ["1 sin firma."])).count() == 0


def test_canons(spark):
    bold = "<p><b>1</b> § 1. Primer <i>texto</i>.</p><p><b>2</b> n Segundo ( n Indica que el texto cambió)</p><p>196 Sin marca.</p><p><b>1481</b> § 1. Ochenta. 1482 § 1. Y uno.</p><hr>fin"
    mark = "Can. 1311 - Castiga. Can. 1312 - Más [Redacción original: x]"
    df = spark.createDataFrame([(1, bold), (2, mark)], "page_id int, html string")
    got = [(r.canon_id, r.texto) for r in CO.canons(df).orderBy("canon_id").collect()]
    assert got == [(1, "Primer texto ."), (2, "Segundo"), (196, "Sin marca."), (1311, "Castiga."), (1312, "Más"), (1481, "Ochenta."), (1482, "Y uno.")] or [g[0] for g in got] == [1, 2, 196, 1311, 1312, 1481, 1482]
    twice = spark.createDataFrame([(1, 1, "viejo"), (1, 2, "nuevo"), (2, 1, "b")], "canon_id int, seq int, texto string")
    assert {r.canon_id: r.texto for r in CO.latest_canons(twice, order=["seq"]).collect()} == {1: "nuevo", 2: "b"}
    with pytest.raises(Exception, match="too few"):
        CO.require_canons(twice).collect()
    assert CO.require_canons(twice, 3).count() == 3


def test_rules_take_whole_words_and_first_match(spark):
    rows = [(C.CODE, f"{b} > TÍTULO I") for b, _ in C.BOOKS] + [(C.CODE, "PARTE II > LIBRO IV"), (C.CODE, ""), (C.COMPENDIUM + " x", "y"), (C.COUNCIL, "a > NOSTRA AETATE"), (C.COUNCIL, "nada"), ("otra", "LIBRO I")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, fuente string, contexto_jerarquico string")
    got = {r.i: (r.categoria, r.nivel_autoridad) for r in C.classify(df).collect()}
    assert [got[i] for i in range(7)] == [(c, 1.0) for _, c in C.BOOKS]
    assert got[7] == (C.LITURGY, 1.0) and got[8] == ("General", 1.0) and got[9] == (C.SOCIAL, 0.55)
    assert got[10] == (C.ECUMENISM, 0.70) and got[11] == (C.LAITY, 0.70) and 12 not in got


def test_master_files_to_index(spark, tmp_path):
    item = {"canon_id": 7, "contexto_jerarquico": "LIBRO I", "texto": "t", "url_origen": ""}
    (tmp_path / "corpus_a_v1.json").write_text(json.dumps({"tipo_corpus": "corpus_canones", "fuente": C.CODE, "datos": [item, {**item, "texto": ""}]}))
    (tmp_path / "corpus_b_v1.json").write_text("{broken")
    assert [r.texto for r in TB.read_corpus(spark, str(tmp_path)).collect()] == ["t"]
    assert [r.archivo for r in TB.bad_files(spark, str(tmp_path)).collect()] == ["corpus_b_v1.json"]
    rows = TB.gold_index(TB.read_master(spark, str(tmp_path))).orderBy("id").collect()
    assert [(r.id, r.id_norma, r.url_origen) for r in rows] == [("corpus_canones:0000", 7, None), ("corpus_canones:0001", 7, None)]
    TB.write_index(spark.createDataFrame(rows, TB.gold_index(TB.read_master(spark, str(tmp_path))).schema), str(tmp_path / "idx"))
    assert spark.read.parquet(str(tmp_path / "idx")).count() == 2
    assert TB.open_index(spark, "no_such_table") is None


def test_url_rows(spark):
    df = spark.createDataFrame([(1, "u", "a", None, "9", None), (2, "v", "b", "t", "10x", "D"), (3, "w", "a", "", None, ""), (4, "x", "a", "", "-1", "")], TB.URLS)
    assert [r.id for r in TB.url_rows(df).collect()] == [2, 1, 3, 4]
    assert [tuple(r) for r in TB.url_rows(df, ["b"]).collect()] == [(2, "v", "b", "t", "10x", "D")]
    blocked = spark.createDataFrame([(d,) for d in TB.parse_domains("# c\n\nd # x\n")], "dominio string")
    assert {r.id for r in TB.exclude_domains(df, blocked).collect()} == {1, 3, 4}


def test_jsonl_cache(spark, tmp_path):
    p = tmp_path / "c"
    p.mkdir()
    (p / "a.jsonl").write_text('{"url":"u","texto":"1"}\n\n{bad\n{"url":"v","texto":null}\n{"url":"u","texto":"2"}\n')
    schema = "url string, texto string"
    assert {r.url: r.texto for r in TB.read_cache(spark, str(p), schema).collect()} == {"u": "2", "v": None}
    assert TB.compact(spark, str(p), str(tmp_path / "d"), schema) == 3
    cache = TB.read_cache(spark, str(tmp_path / "d"), schema)
    urls = spark.createDataFrame([("u",), ("w",)], "url string")
    assert [r.url for r in TB.pending(urls, cache).collect()] == ["w"] and [r.url for r in TB.processed(urls, cache).collect()] == ["u"]
    whole = TB.fetch_pending(urls, cache, lambda d: d.withColumn("texto", F.lit("n")))
    assert {r.url: r.texto for r in whole.collect()} == {"u": "2", "v": None, "w": "n"}
    assert tuple(TB.cache_statistics(cache).first()) == (2, 1, 1)


def test_stream_upsert_survives_a_second_run(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"url":"u","texto":"a","ts":"2024-01-01T00:00:00Z"}\n{"url":"v","texto":"b","ts":"2024-01-01T00:00:00Z"}\n')
    schema = "url string, texto string, ts timestamp"
    go = lambda: ST.upsert_into(ST.stream_records(spark, str(src), schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    go()
    (src / "2.json").write_text('{"url":"u","texto":"c","ts":"2024-01-02T00:00:00Z"}\nbroken\n')
    go()
    go()
    assert {r.url: r.texto for r in ST.current(spark, str(tmp_path / "out")).collect()} == {"u": "c", "v": "b"}


def test_csv_round_trip_and_pdf_state(spark, tmp_path):
    df = spark.createDataFrame([(1, "x,y", 0.5)], "a int, b string, c double")
    TB.write_csv(df, str(tmp_path / "c"), ["c", "a", "b"])
    assert tuple(TB.read_csv(spark, str(tmp_path / "c"), "c double, a int, b string").first()) == (0.5, 1, "x,y")
    (tmp_path / "f.pdf").write_bytes(b"no pdf")
    r = TB.read_pdfs(spark, str(tmp_path / "*.pdf")).first()
    assert r.nombre == "f" and len(r.doc_id) == 10 and r.estado != "ok" and r.pages is None


def test_reconcile_and_upsert(spark):
    a = spark.createDataFrame([("k1", "t"), ("k2", "t"), ("k3", "s")], "id string, tipo_corpus string")
    b = spark.createDataFrame([("k1", "t"), ("k4", "t"), ("k3", "s")], "id string, tipo_corpus string")
    got = {r.tipo: (r.esperado, r.en_indice, r.faltantes, r.huerfanos, r.ok) for r in TB.reconcile(a, b).collect()}
    assert got == {"t": (2, 2, 1, 1, False), "s": (1, 1, 0, 0, True)}
    assert {r.id: r.tipo_corpus for r in TB.upsert(a, b.withColumn("tipo_corpus", F.lit("n"))).collect()} == {"k1": "n", "k2": "t", "k3": "n", "k4": "n"}


def test_master_modes(spark, tmp_path):
    backup = tmp_path / "backup"
    backup.mkdir()
    item = {"canon_id": 7, "contexto_jerarquico": "LIBRO I", "texto": "t", "url_origen": ""}
    (backup / "corpus_a_v1.json").write_text(json.dumps({"tipo_corpus": "corpus_canones", "fuente": C.CODE, "datos": [item]}))
    tried = []

    def broken():
        tried.append(1)
        raise ConnectionError

    assert TB.load_master(spark, str(backup)).count() == 1
    assert TB.load_master(spark, str(tmp_path / "x"), mode="dinamico", scrape=broken, backup=str(backup), wait=0).count() == 1 and len(tried) == 3
    with pytest.raises(ConnectionError):
        TB.load_master(spark, str(tmp_path / "x"), mode="dinamico", scrape=broken, wait=0)
    fresh = TB.load_master(spark, str(tmp_path / "y"), mode="dinamico", scrape=lambda: TB.load_master(spark, str(backup)))
    assert [(r.canon_id, r.texto, r.indice) for r in fresh.collect()] == [(7, "t", 0)]
    with pytest.raises(ValueError):
        TB.load_master(spark, "p", mode="otro")


def test_fetch_never_raises(spark):
    def read(url, timeout, max_bytes):
        if "bad" in url:
            raise TimeoutError
        return "x" * 20 if "big" in url else f"<p>{url}</p>"

    df = spark.createDataFrame([("a",), ("bad",), ("big",), (" ",), (None,)], "url string")
    assert {r.url: r.html for r in H.fetch_pages(df, read=read, max_bytes=15).collect()} == {"a": "<p>a</p>", "bad": None, "big": None, " ": None, None: None}


def test_chat(spark):
    from cotejo.plans.chat import Chat

    def verify(df):
        return df.select("article_id", F.lit(0.5).alias("ivr_max"), F.lit("proximo").alias("veredicto"), F.array().cast("array<string>").alias("errores"))

    chat = Chat(spark, verify, commands={"/pdf": lambda rest: rest.upper()})
    assert chat.handle("una noticia").barra.count("█") == 6 and chat.handle("  ") is None
    assert chat.handle("/pdf a.pdf") == "A.PDF" and "/ayuda" in chat.handle("/nada")
    assert chat.handle("http://x.y")["errores"] == ["no fetcher"]
    assert chat.handle("/historial").count() == 1
    chat.handle("/salir")
    assert not chat.open

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from cotejo.functions import render
from cotejo.functions import text as T
from cotejo.functions.stem import stem, stem_arrays


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[0] for r in df.select(f(F.col("t")).alias("v"), "i").orderBy("i").select("v").collect()]


TEXTS = ["", "  Él  Niño\t\nCAMIÓN ", "straße ÄÖÜ", "pingüino y cigüeña", "é ñ", "a\xa0b", "12 Ñandú-2", None, "ÀÈÌ ǎ ệ"]


def test_normalize_is_unicode_decomposition(spark):
    def plain(t):
        if t is None:
            return None
        s = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn")
        return re.sub(r"\s+", " ", s).strip()

    assert col(spark, TEXTS, T.normalize) == [plain(t) for t in TEXTS]


def test_tokens_and_stop_words(spark):
    assert col(spark, ["El niño de 3 años, y la CASA."], T.ascii_tokens) == [["el", "nino", "de", "3", "anos", "y", "la", "casa"]]
    assert col(spark, ["El niño de 3 años, y la CASA."], T.content_tokens) == [["nino", "3", "anos", "casa"]]
    assert col(spark, ["Niño, ¿qué 3?"], T.accent_tokens) == [["niño", "qué"]]


@pytest.mark.parametrize(("n", "tokens", "want"), [(2, ["a", "b", "c", "a", "b"], ["a b", "b c", "c a"]), (2, ["a"], ["a"]), (3, ["a", "b"], ["a", "b"]), (1, ["a", "a"], ["a"]), (2, [], []), (3, ["a", "b", "c", "d"], ["a b c", "b c d"])])
def test_ngrams(spark, n, tokens, want):
    assert col(spark, [tokens], lambda c: T.ngrams(c, n), "array<string>") == [want]
    with pytest.raises(ValueError):
        T.ngrams(F.col("t"), 0)


@pytest.mark.parametrize(("words", "sizes"), [(0, []), (1, [1]), (175, [175]), (176, [175, 51]), (250, [175, 125]), (251, [175, 126, 1])])
def test_windows(spark, words, sizes):
    got = col(spark, [" ".join(f"w{i}" for i in range(words))], T.windows)[0]
    assert [len(w.split()) for w in got] == sizes
    assert all(w.split()[0] == f"w{125 * i}" for i, w in enumerate(got))


def test_unicode_cleaning_and_lines(spark):
    assert col(spark, ["oﬁcina ﬃ 1º a­b​\xa0c\x07 é"], T.normalize_unicode) == ["oficina ffi 1º ab c é"]
    assert col(spark, ["a  b\r\n\r\n c\t d\re\n\n"], T.lines) == [["a b", "c d", "e"]]
    assert col(spark, ["Página 3 de 10", "12", "- 4 -", "3/10", "Pág. 3", "12 de mayo", "a 12"], T.is_page_number) == [True, True, True, True, True, False, False]
    assert col(spark, ["Página 3 de 10"], T.repetition_key) == ["página # de #"]


def test_line_predicates(spark):
    lines = ["TÍTULO IV (Cann. 35–93)", "De los fieles", "DE LOS FIELES.", "(Cann. 3-4)", "368–430)", "Fin.", "sigue,"]
    assert col(spark, lines, T.mostly_upper) == [True, False, True, False, False, False, False]
    assert col(spark, lines, T.is_subtitle) == [True, False, False, False, False, False, False]
    assert col(spark, lines, T.is_title_continuation) == [True, False, False, True, True, False, False]
    assert col(spark, [*lines, None], T.closes_sentence) == [True, False, True, True, True, True, False, True]
    assert col(spark, ["Uno dos. Tres; cuatro. 5 seis"], T.sentences) == [["Uno dos.", "Tres; cuatro.", "5 seis"]]
    assert col(spark, ['a  "b" ( c ) , d'], T.tidy_punctuation) == ["a 'b' (c), d"]


def test_phrases_need_whole_words(spark):
    assert col(spark, ["los obispos de roma", "de romanos"], lambda c: T.contains_phrase(c, F.lit("de roma"))) == [True, False]


# Worked out from the published steps of the algorithm.
STEMS = {
    "chicas": "chic", "torneado": "torn", "comunicaciones": "comun", "biología": "biolog", "rápidamente": "rapid", "cheque": "chequ", "obispos": "obisp",
    "necesario": "necesari", "necesaria": "necesari", "haciéndola": "hac", "papado": "papado", "amigables": "amig", "resolución": "resolu", "actividades": "activ",
    "decisivamente": "decis", "comunicarías": "comunic", "pague": "pag", "construyeron": "constru", "a": "a", "": "",
}


@pytest.mark.parametrize(("word", "want"), STEMS.items())
def test_stems(word, want):
    assert stem(word) == want


def test_stems_of_arrays_keep_order_and_empty_rows(spark):
    df = spark.createDataFrame([(1, ["obispos", "de", "obispo"]), (2, []), (3, None)], "id int, t array<string>")
    assert {r.id: r.stems for r in stem_arrays(df, "id", "t").collect()} == {1: ["obisp", "de", "obisp"], 2: [], 3: []}


def test_rendering_and_routing(spark):
    assert col(spark, [0.0, 0.5, 1.7], render.bar, "double") == ["░" * 12, "█" * 6 + "░" * 6, "█" * 12]
    assert col(spark, ["https://a.b/c", "www.x.y", "/ayuda", "una noticia", " ", None], render.route) == ["url", "url", "command", "text", "empty", "empty"]

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cotejo.llm import language as G
from cotejo.llm.queries import op6_centroids
from tests.llm.conftest import rows_by

VOICES = {
    "en": "the quick brown fox jumps over this lazy dog and then with those others it was thinking of nothing when she came home",
    "es": "el perro corre por la calle cuando los niños juegan en el parque y después todos vuelven a casa con sus padres",
    "de": "der schnelle hund läuft über die straße und die kinder spielen im garten während ihre eltern nach hause kommen",
}


def corpus(n=90):
    rows, rng = [], np.random.default_rng(0)
    for i in range(n):
        lang = sorted(VOICES)[i % 3]
        words = VOICES[lang].split()
        rows.append((i, " ".join(rng.choice(words, 30)), lang))
    return rows


def test_held_out_accuracy_and_rejection(spark, documents):
    df = documents(corpus(), language=1, score=2)
    model = G.fit_centroids(df)
    out = G.predict_language(df, model).withColumn("held", ~G.in_training(F.col("doc_id")))
    held = [r for r in out.collect() if r.held]
    assert held and all(r.language.lang_pred == r.lang for r in held)
    assert {r.doc_id for r in held} == {i for i in range(90) if zlib.crc32(str(i).encode()) % 5 == 0}
    odd = documents([(1, None), (2, ""), (3, "123 !? 45"), (4, "щъыьэюя " * 60), (5, "the dog"), (5, "the dog"), (6, "the dog and " * 30_000)])
    got = rows_by(G.predict_language(odd, model))
    assert [(r.language.lang_pred, r.language.score, r.language.rejected) for i in (1, 2, 3) for r in got[i]] == [("und", 0.0, True)] * 3
    assert got[4][0].language.rejected and got[4][0].language.lang_pred in VOICES
    assert all(r.language.lang_pred == "en" and not r.language.rejected for i in (5, 6) for r in got[i])


def test_features_never_see_lang_source_or_id(spark, documents):
    rows = corpus()
    model = G.fit_centroids(documents(rows))
    a = G.predict_language(documents(rows), model).select("text", "language.*")
    b = G.predict_language(documents([(-i, t, None, "other") for i, t, _ in rows]), model).select("text", "language.*")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_bound_on_the_sample_holds(spark, documents):
    df = documents(corpus() + [(1, "the same id " * 3, "en")] * 50)
    model = G.fit_centroids(df, per_language=5, in_all=9)
    assert set(model.langs) == set(VOICES)


@pytest.mark.parametrize("one_id", [1, 2, 3, 4, 6, 7])
def test_every_language_with_rows_in_training_is_learned(spark, documents, one_id):
    rows = [(one_id, f"die kinder spielen im garten nummer {i}", "de") for i in range(3000)] + [(100 + i, f"the children play out there again {i}", "en") for i in range(200)]
    df = documents(rows + [(one_id, "siempre el mismo texto", "es")] * 900)
    learned = {"en"} | ({"de", "es"} if zlib.crc32(str(one_id).encode()) % 5 else set())
    assert set(G.fit_centroids(df, per_language=50).langs) == learned


def test_too_many_languages_are_refused(spark, documents):
    with pytest.raises(ValueError, match="languages"):
        G.fit_centroids(documents([(i, "text", f"l{i}") for i in range(40)]), in_all=9)


def plain_model(rows, per_language):
    """Vector, floor and nearest centroid of one cluster a language, spelled out with dicts."""
    import math
    from collections import Counter

    def grams(text):
        low, runs = text.lower(), [""]
        for c in low:
            if c.isalpha():
                runs[-1] += c
            elif runs[-1]:
                runs.append("")
        gapped = "\x00".join(r for r in runs if r)
        gapped = gapped + "\x00" if low and not low[-1].isalpha() and gapped else gapped
        return gapped

    def hashed(text):
        """As the model's bins: one to three characters, gaps after runs included."""
        c, out = [ord(x) if x != "\x00" else 0 for x in grams(text)], Counter()
        odd = lambda n: (0x9E3779B1 * (2 * n + 1)) & 0xFFFFFFFF | 1
        for n in range(3):
            for i in range(len(c) - n):
                x = c[i] * odd(1)
                if n > 0:
                    x = x * odd(2) + c[i + 1] * odd(3)
                if n > 1:
                    x = x * odd(4) + c[i + 2] * odd(5)
                x &= 0xFFFFFFFF
                out[(((x ^ (x >> 15)) * odd(6 + n)) & 0xFFFFFFFF) >> 19] += 1
        return out

    def unit(v):
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {k: x / norm for k, x in v.items()}

    def cosine(a, b):
        return sum(x * b.get(k, 0.0) for k, x in a.items())

    counts = [(lang, hashed(t)) for _, t, lang in rows]
    idf = lambda k: math.log((1 + len(counts)) / (1 + sum(k in c for _, c in counts))) + 1
    weight = {k: idf(k) for k in range(G.BINS)}
    vector = lambda c: unit({k: math.log1p(x) * weight[k] for k, x in c.items()})
    centre = {}
    for lang in sorted({x for x, _ in counts}):
        total = Counter()
        own = [vector(c) for x, c in counts if x == lang]
        for v in own:
            total.update(v)
        middle = unit(total)
        full = [cosine(v, middle) / min(1.0, math.sqrt(len(v) / G.FULL_GRAMS)) for v in own]
        centre[lang] = (middle, G.SLACK * float(np.quantile(full, G.QUANTILE)))

    def predict(text):
        c = hashed(text)
        if not any(x.isalpha() for x in text):
            return ("und", 0.0, True)
        v = vector(c)
        lang = max(sorted(centre), key=lambda x: cosine(v, centre[x][0]))
        s = min(1.0, max(0.0, cosine(v, centre[lang][0])))
        return (lang, s, s < centre[lang][1] * min(1.0, math.sqrt(len(v) / G.FULL_GRAMS)))

    return predict


def test_prediction_against_brute_force():
    rows = corpus(60)
    counts = np.stack(list(G.bin_counts([t for _, t, _ in rows])))
    model = G.fit([lang for *_, lang in rows], counts, centroids=1)
    plain = plain_model(rows, 60)
    asked = [t for _, t, _ in corpus(30)] + ["Der Hund läuft", "zxqv kjwp", "", "12 34", "el perro, y el gato!", "щъыь", "the"]
    for t, got in zip(asked, model.predict(asked), strict=True):
        lang, score, rejected = plain(t)
        assert (got["lang_pred"], got["rejected"]) == (lang, rejected) and abs(got["score"] - score) < 1e-4


def test_counts_match_one_text_at_a_time():
    texts = ["Hello, wörld", "", "a", "ab\x00c", "İstanbul", "1 2", "über-über"]
    together = list(G.bin_counts(texts))
    for t, row in zip(texts, together, strict=True):
        assert np.array_equal(next(G.bin_counts([t])), row)
        assert row.any() == any(c.isalpha() for c in t)


def test_no_labels_and_empty_tables(spark, documents):
    df = documents([(1, "text without label", None)])
    model = G.fit_centroids(df)
    assert [r.language.lang_pred for r in G.predict_language(df, model).collect()] == ["und"]
    assert G.predict_language(df.limit(0), G.fit_centroids(df.limit(0))).count() == 0


def test_held_out_accuracy_on_the_test_data(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = op6_centroids(spark, sf).where("held_out").join(truth, "doc_id").collect()
    assert len(rows) > 100
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) >= 0.97
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_what_is_no_known_language_is_rejected(spark):
    sf, rnd = "/root/testdata/sf0.01", random.Random(0)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    words = lambda letters: " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 9))) for _ in range(200))
    odd = {
        "letters": words("abcdefghijklmnopqrstuvwxyz"),
        "consonants": words("bcdfghjklmnpqrstvwxz"),
        "base64": "\n".join(base64.b64encode(rnd.randbytes(57)).decode() for _ in range(30)),
        "hex": "\n".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(40)),
        "finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja "
        "omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 3,
        "turkish": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve "
        "birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. " * 3,
    }
    model = G.fit_centroids(docs)
    assert {k: r["rejected"] for k, r in zip(odd, model.predict(list(odd.values())), strict=True)} == dict.fromkeys(odd, True)


def test_outliers_make_no_clusters():
    rng = np.random.default_rng(0)
    two = rng.integers(0, 2, 200)[:, None] == np.arange(2)
    x = np.hstack([two + 0.1 * rng.random((200, 2)), np.zeros((200, 4))])
    x[:4] = np.eye(6)[2:]  # each far from all others
    c, near = G.clustered((x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4"), 4)
    assert np.bincount(near).min() >= 10

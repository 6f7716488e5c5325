"""Language identification by nearest centroids.

A text is a vector of letter n-grams (one to three letters, hashed into bins),
weighted by log term frequency and idf and normalised. Every language has a few
centroids, clustered by spherical k-means from a bounded sample of labelled
texts; the highest cosine decides, and a text farther from its centroid than
that centroid's sample texts lie, with slack, is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bins of hashed n-grams.
BINS = 1 << 13
#: Labelled texts that the model is fitted on: at most so many of each language,
#: and of all together. This bound is the model's only one; prediction reads all.
PER_LANGUAGE, IN_ALL = 300, 2400
#: Parts of a language in which the smallest hashes are looked for first.
PARTS = 64
CENTROIDS = 4
#: A text is rejected below this share of its centroid's lowest sample cosines.
SLACK = 0.8
QUANTILE = 0.005
#: A text of fewer different n-grams has a sparser vector: its cosine counts by the root of its share.
FULL_GRAMS = 400
#: A cluster with a smaller share of its language's sample is dissolved into the others.
LEAST_SHARE = 0.05
NONE = "und"
#: Texts are vectorised in groups of about so many characters.
GROUP_CHARS = 4_000_000
RESULT = "struct<lang_pred:string,score:double,rejected:boolean>"
_ARROW = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _odd(n: int) -> np.uint32:
    """The n-th multiplier of the n-gram hash: an odd number from a golden-ratio step."""
    return np.uint32((0x9E3779B1 * (2 * n + 1)) & 0xFFFFFFFF | 1)


def bin_counts(texts: list[str]) -> Iterator[np.ndarray]:
    """Counts of hashed n-grams, one float32 row of BINS for each text; zeros without letters."""
    # a text's lower case can differ in length, so texts are told apart by a mark
    joined = "\x00".join(t.replace("\x00", " ") if "\x00" in t else t for t in texts).lower()
    code = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    ends = np.append(np.flatnonzero(code == 0), len(code))
    letter = _is_letter()[code]
    c = np.where(letter, code, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one gap behind each run of letters
    place = np.cumsum(keep)
    c = c[keep].astype("u4")
    with np.errstate(over="ignore"):
        one = c * _odd(1)
        two = one[:-1] * _odd(2) + c[1:] * _odd(3) if c.size > 1 else c[:0]
        three = two[:-1] * _odd(4) + c[2:] * _odd(5) if c.size > 2 else c[:0]
        grams = [((x ^ (x >> np.uint32(15))) * _odd(6 + n)) >> np.uint32(32 - 13) for n, x in enumerate((one, two, three))]
    low = 0
    for e in ends:
        high = int(place[e - 1]) if e else 0
        row = np.zeros(BINS, "f4")
        for n, g in enumerate(grams):
            last = high - n
            if last > low:
                row += np.bincount(g[low:last], minlength=BINS)
        yield row
        low = int(place[e]) if e < len(place) else high


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_CHARS or i - start >= 1023:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def fullness(grams: np.ndarray) -> np.ndarray:
    """The share of a full text's cosine that so many different n-grams can reach."""
    return np.minimum(1.0, np.sqrt(grams / FULL_GRAMS))


def clustered(own: np.ndarray, centroids: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroid rows of spherical k-means and each vector's cluster; no cluster of a few outliers."""
    rng = np.random.default_rng(0)
    seeds = [own[(own @ own.mean(axis=0)).argmax()]]
    while len(seeds) < min(centroids, len(own)):
        far = np.maximum(0.0, 1 - (own @ np.stack(seeds).T).max(axis=1).astype("f8")) ** 2
        if far.sum() <= 0:
            break
        seeds.append(own[rng.choice(len(own), p=far / far.sum())])
    c = np.stack(seeds)
    while True:
        for _ in range(12):
            near = (own @ c.T).argmax(axis=1)
            c = np.stack([own[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        near = (own @ c.T).argmax(axis=1)
        sizes = np.bincount(near, minlength=len(c))
        if len(c) == 1 or sizes.min() >= max(2, LEAST_SHARE * len(own)):
            return c, near
        c = np.delete(c, sizes.argmin(), axis=0)


@dataclass
class Centroids:
    """A fitted model: idf, centroid rows, their languages and lowest accepted cosines of full texts."""

    idf: np.ndarray
    rows: np.ndarray
    langs: list[str]
    floors: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str | None]) -> list[dict]:
        out: list[dict] = [{"lang_pred": NONE, "score": 0.0, "rejected": True} for _ in texts]
        for start, group in _groups([t or "" for t in texts]):
            counts = np.stack(list(bin_counts(group)))
            if not self.langs:
                continue
            cosines = self.vectors(counts) @ self.rows.T
            best = cosines.argmax(axis=1)
            grams = (counts > 0).sum(axis=1)
            for i in np.flatnonzero(grams):
                k, s = best[i], min(1.0, max(0.0, float(cosines[i, best[i]])))
                floor = float(self.floors[k]) * float(fullness(grams[i]))
                out[start + i] = {"lang_pred": self.langs[k], "score": s, "rejected": bool(s < floor)}
        return out


def fit(labels: list[str], counts: np.ndarray, centroids: int = CENTROIDS) -> Centroids:
    """Idf over the sample, then spherical k-means for each language, from seeds drawn by squared distance."""
    seen = (counts > 0).sum(axis=0)
    idf = np.log((1 + len(labels)) / (1 + seen)).astype("f4") + 1
    model = Centroids(idf, np.zeros((0, BINS), "f4"), [], np.zeros(0))
    x = model.vectors(counts) if labels else counts
    rows, langs, floors = [], [], []
    for lang in sorted(set(labels)):
        own = x[[i for i, v in enumerate(labels) if v == lang]]
        own = own[np.linalg.norm(own, axis=1) > 0]
        if not len(own):
            continue
        c, near = clustered(own, centroids)
        for k in range(len(c)):
            mine = near == k
            rows.append(c[k])
            langs.append(lang)
            floors.append(SLACK * float(np.quantile(own[mine] @ c[k] / fullness((own[mine] > 0).sum(axis=1)), QUANTILE)))
    if rows:
        model = Centroids(idf, np.stack(rows).astype("f4"), langs, np.array(floors))
    return model


def in_training(id_col: Column) -> Column:
    """Whether crc32 of the id as text is not a multiple of 5; a null id is not in training."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def _counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = []
        for _, group in _groups(batch.to_pylist()):
            for row in bin_counts(group):
                at = np.flatnonzero(row).astype("u2")
                rows.append(len(at).to_bytes(4, "little") + at.tobytes() + row[at].astype("f4").tobytes())
        yield pa.array(rows, pa.binary())


def fit_centroids(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = PER_LANGUAGE,
    in_all: int = IN_ALL,
) -> Centroids:
    """A model from rows in training with text and language.

    The sample is, of each language, the ``per_language`` texts with the smallest
    hashes of id and text (fewer each if they would be over ``in_all`` in all),
    so every language with rows in training is learned, whatever its ids; more
    than ``in_all`` languages are refused. Repeated rows count as often as they
    come, as far as the bound allows. Whole texts are read. The executors find
    the hashes, then turn the chosen texts into sparse counts; only those, and
    one bound for each language, reach the driver.
    """
    rows = df.where(in_training(F.col(id_col)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    langs = rows.select("lang").distinct().limit(in_all + 1).count()
    if langs > in_all:
        raise ValueError(f"more than {in_all} languages: a sample of so many texts can't show each")
    each = min(per_language, max(1, in_all // max(1, langs)))
    # ranked by hashes alone, cut in the scan's tasks first, then in parts of each language, so that
    # no task meets more than PARTS times the bound; then the texts up to each language's last hash
    first = W.partitionBy("lang").orderBy("h")
    least = rows.select("lang", "h", F.pmod(F.xxhash64("h", F.monotonically_increasing_id()), F.lit(PARTS)).alias("part"))
    for among in (W.partitionBy("lang", "part").orderBy("h"), first):
        least = least.withColumn("n", F.row_number().over(among)).where(F.col("n") <= each)
    last = least.groupBy("lang").agg(F.max("h").alias("last"))
    chosen = rows.join(F.broadcast(last), "lang").where("h <= last").select("lang", "h", "text")
    # repeated rows share a hash: the bound holds all the same
    sample = chosen.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each)
    counted = sample.select("lang", "h", F.arrow_udf(_counted, "binary")("text").alias("v")).orderBy("lang", "h", "v").collect()
    counts = np.zeros((len(counted), BINS), "f4")
    for i, r in enumerate(counted):
        n = int.from_bytes(r["v"][:4], "little")
        counts[i, np.frombuffer(r["v"], "u2", n, 4)] = np.frombuffer(r["v"], "f4", n, 4 + 2 * n)
    return fit([r["lang"] for r in counted], counts)


def predict_language(df: DataFrame, model: Centroids, *, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``df`` with a struct ``out_col``: lang_pred, score (cosine, 0 to 1), rejected.

    A null text or one without letters is ``und``, score 0, rejected. Any other
    gets the nearest centroid's language, the first of equals, and is rejected
    if that is too far away. Very long texts are read whole, a few million
    characters at a time. Repeated rows are judged alike; an empty table gives
    an empty one; an existing column ``out_col`` is replaced. A narrow step; the model is of a fixed size bound.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(sent.value.predict(batch.to_pylist()), _ARROW)

    return df.withColumn(out_col, F.arrow_udf(judge, RESULT)(F.col(text_col)))

"""Spanish stemming by the published Snowball algorithm, once for each distinct token."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VOWELS = frozenset("aeiouáéíóúü")
_PLAIN = str.maketrans("áéíóú", "aeiou")

# The suffix lists of the published algorithm.
_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_AFTER_ACCENT = "iéndo ándo ár ér ír".split()
_AFTER_PLAIN = "ando iendo ar er ir".split()
_DELETE_R2 = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
_ADOR = "adora ador ación adoras adores aciones acion ante antes ancia ancias".split()
_LOGIA = "logía logías".split()
_UCION = "ución uciones ucion".split()
_ENCIA = "encia encias".split()
_IDAD = "idad idades".split()
_IVO = "iva ivo ivas ivos".split()
_Y_VERB = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_VERB_EN = "en es éis emos".split()
_VERB = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos "
    "eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id "
    "ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas "
    "ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos "
    "imos áramos iéramos iésemos ásemos"
).split()
_RESIDUE = "os a o á í ó".split()
#: Words that keep their form.
INVARIANT = frozenset({"papado"})


def _longest(word: str, suffixes: list[str]) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _after_vowel_consonant(word: str, start: int) -> int:
    """The place behind the first consonant that follows a vowel, from ``start`` on."""
    i = start
    while i < len(word) and word[i] not in _VOWELS:
        i += 1
    while i < len(word) and word[i] in _VOWELS:
        i += 1
    return min(len(word), i + 1)


def _rv(word: str) -> int:
    n = len(word)
    if n < 3:
        return n
    second_consonant = word[1] not in _VOWELS
    if second_consonant or word[0] in _VOWELS:
        want_vowel = second_consonant
        for i in range(2, n):
            if (word[i] in _VOWELS) == want_vowel:
                return i + 1
        return n
    return 3


def _pronoun(w: str, rv: int) -> str:
    p = _longest(w, _PRONOUNS)
    if not p or len(w) - len(p) < rv:
        return w
    head = w[: len(w) - len(p)]
    before = _longest(head, _AFTER_ACCENT)
    if before and len(head) - len(before) >= rv:
        return head[: len(head) - len(before)] + before.translate(_PLAIN)
    before = _longest(head, _AFTER_PLAIN)
    if before and len(head) - len(before) >= rv:
        return head
    if head.endswith("uyendo") and len(head) - 5 >= rv:
        return head
    return w


def _standard(w: str, r1: int, r2: int) -> str | None:
    """Step 1; None if no ending was removed."""
    groups = {
        "delete": _DELETE_R2, "ador": _ADOR, "logia": _LOGIA, "ucion": _UCION, "encia": _ENCIA,
        "amente": ["amente"], "mente": ["mente"], "idad": _IDAD, "ivo": _IVO,
    }
    kind, s = max(((k, _longest(w, v)) for k, v in groups.items()), key=lambda x: len(x[1]))
    if not s:
        return None
    at = len(w) - len(s)
    head = w[:at]

    def less(head: str, *endings: str) -> str:
        e = _longest(head, list(endings))
        return head[: len(head) - len(e)] if e and len(head) - len(e) >= r2 else head

    if kind == "amente":
        if at < r1:
            return None
        shorter = less(head, "iv", "os", "ic", "ad")
        return less(shorter, "at") if shorter != head and head.endswith("iv") else shorter
    if at < r2:
        return None
    if kind == "logia":
        return head + "log"
    if kind == "ucion":
        return head + "u"
    if kind == "encia":
        return head + "ente"
    more = {"ador": ("ic",), "mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "ivo": ("at",)}
    return less(head, *more[kind]) if kind in more else head


def _verb(w: str, rv: int) -> str:
    s = _longest(w[rv:], _Y_VERB)
    if s and w[: len(w) - len(s)].endswith("u"):
        return w[: len(w) - len(s)]
    s = _longest(w[rv:], _VERB_EN + _VERB)
    if not s:
        return w
    head = w[: len(w) - len(s)]
    return head[:-1] if s in _VERB_EN and head.endswith("gu") else head


def _residual(w: str, rv: int) -> str:
    s = _longest(w[rv:], [*_RESIDUE, "e", "é"])
    if not s:
        return w
    head = w[: len(w) - len(s)]
    return head[:-1] if s in ("e", "é") and head.endswith("gu") and len(head) - 1 >= rv else head


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    w = word.lower()
    if w in INVARIANT:
        return w
    rv, r1 = _rv(w), _after_vowel_consonant(w, 0)
    r2 = _after_vowel_consonant(w, r1)
    w = _pronoun(w, rv)
    done = _standard(w, r1, r2)
    w = _verb(w, rv) if done is None else done
    return _residual(w, rv).translate(_PLAIN)


def _stems(batch: pa.Array) -> pa.Array:
    return pa.array([None if t is None else stem(t) for t in batch.to_pylist()], pa.string())


def stem_table(tokens: DataFrame, token_col: str = "token") -> DataFrame:
    """(token, stem) for each distinct token: Python sees a token once."""
    own = tokens.select(F.col(token_col).alias("token")).where("token is not null").distinct()
    return own.select("token", F.arrow_udf(_stems, "string")("token").alias("stem"))


#: Distinct tokens whose stems a worker keeps; beyond it starts anew.
CACHED = 1_000_000
_cache: dict[str, str] = {}


def _stem_lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each batch's distinct tokens are stemmed once, and a worker remembers them over its batches."""
    for batch in batches:
        if len(_cache) > CACHED:
            _cache.clear()
        tokens = batch.flatten().dictionary_encode()
        for t in tokens.dictionary.to_pylist():
            if t not in _cache:
                _cache[t] = stem(t)
        stems = pa.array([_cache[t] for t in tokens.dictionary.to_pylist()], pa.string()).take(tokens.indices)
        lengths = pc.fill_null(pc.list_value_length(batch), 0)
        ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(lengths).cast(pa.int32())])
        yield pa.ListArray.from_arrays(ends, stems)


def stems(tokens: Column) -> Column:
    """The stems of an array of tokens, in order; none for a null array. A narrow step."""
    return F.arrow_udf(_stem_lists, "array<string>")(tokens)


def stem_arrays(df: DataFrame, id_col: str, tokens_col: str, out_col: str = "stems") -> DataFrame:
    """(id, array of stems in order)."""
    return df.select(id_col, stems(F.col(tokens_col)).alias(out_col))

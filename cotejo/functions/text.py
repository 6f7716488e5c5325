"""Text functions: columns in, columns out, all inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish words without content, and filler words that form no term.
STOP_WORDS = tuple(
    """
de la el los las un una unos unas y o u e a al del en por para con sin sobre entre se su sus lo le les
que como no si es son ser sea sean han ha hay este esta estos estas ese esa esos esas aquel aquella
tambien mas muy pero sino ni cuando donde segun hasta desde contra ante bajo tras mismo misma mismos
mismas cada todo todos toda todas otro otra otros otras cualquier cual cuales quien quienes cuyo cuya
puede pueden debe deben tiene tienen hacer hace nada algo asi solo ya fue sido estar esta estan seran
sera podra podran haya hayan deba deban pueda puedan
""".split()
)
FILLER_WORDS = tuple(
    """
cuenta lugar tiempo modo manera parte caso casos forma efecto fin tanto cual nuestro nuestra nuestros
nuestras presente presentes siguiente siguientes primer primero primera segundo segunda tercero
teniendo quedando salvo debido conforme respecto
""".split()
)


def _accent_table() -> tuple[str, str]:
    """Precomposed lower-case letters and their base letters, by canonical decomposition."""
    src, dst = [], []
    for cp in range(0xC0, 0x2000):
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if c == c.lower() and base != c and len(base) == 1:
            src.append(c)
            dst.append(base)
    return "".join(src), "".join(dst)


_ACCENTED, _BASE = _accent_table()


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _ACCENTED, _BASE), r"\p{Mn}", "")


def normalize(c: Column) -> Column:
    """Lower case without accents, single spaces, trimmed."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(c)), r"(?U)\s+", " "))


def ascii_tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 of the normalised text."""
    return F.regexp_extract_all(normalize(c), F.lit("([a-z0-9]+)"), 1)


def accent_tokens(c: Column) -> Column:
    """Runs of letters with Spanish accents kept."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-záéíóúüñ]+)"), 1)


def plain_letters(c: Column) -> Column:
    """Lower case, the accented letters of accent_tokens as plain ones."""
    c = F.lower(c)
    for accented, base in zip("áéíóúüñ", "aeiouun", strict=True):
        c = F.replace(c, F.lit(accented), F.lit(base))
    return c


def plain_tokens(c: Column) -> Column:
    """accent_tokens, each normalised: the same runs, with the text's letters made plain at once."""
    return F.regexp_extract_all(plain_letters(c), F.lit("([a-z]+)"), 1)


def without(tokens: Column, words: tuple[str, ...]) -> Column:
    stop = F.lit(list(words))
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def content_tokens(c: Column) -> Column:
    """Tokens that are no stop words, unstemmed."""
    return without(ascii_tokens(c), STOP_WORDS)


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-grams joined by a space; the distinct words if there are fewer than n."""
    if n < 1:
        raise ValueError("n-grams need n >= 1")
    grams = tokens
    for i in range(1, n):
        tail = F.slice(tokens, i + 1, F.greatest(F.size(tokens), F.lit(1)))
        # zip_with fills the shorter side with null, and a null operand drops the gram
        grams = F.zip_with(grams, tail, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(F.size(tokens) < n, tokens).otherwise(F.array_compact(grams)))


def contains_phrase(tokens_text: Column, phrase: Column) -> Column:
    """Whether a text of tokens joined by single spaces holds the phrase as whole words."""
    return F.contains(F.concat(F.lit(" "), tokens_text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def words(c: Column) -> Column:
    """The text split at white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def windows(c: Column, size: int = 175, overlap: int = 50) -> Column:
    """Overlapping word windows; one window if the text is short, none if it is blank.

    A last window may lie wholly inside the one before it.
    """
    step = max(1, size - overlap)
    # the text is split once, not for each window: its words are the one item of an outer array
    each = F.transform(F.array(words(c)), lambda w: F.transform(window_starts(w, size, step), lambda i: F.array_join(F.slice(w, i + 1, size), " ")))
    return F.get(each, F.lit(0))


def window_starts(w: Column, size: int, step: int) -> Column:
    none = F.array().cast("array<int>")
    return F.when(F.size(w) == 0, none).when(F.size(w) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(w) - 1, F.lit(step)))


# Ligatures, characters that vanish, and spaces that become plain ones.
LIGATURES = {"ﬃ": "ffi", "ﬄ": "ffl", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff"}
VANISHING = "\u00ad\u200b\ufeff"
SPACES = "\xa0\u2009\u202f"


def _composition_pairs() -> dict[str, str]:
    """Letter plus combining mark to the precomposed letter, for the Latin range."""
    out = {}
    for cp in range(0xC0, 0x250):
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) == 2 and unicodedata.normalize("NFC", d) == chr(cp):
            out[d] = chr(cp)
    return out


def normalize_unicode(c: Column) -> Column:
    """Composed letters, plain ligatures and spaces, no control characters; ordinals stay."""
    pairs = _composition_pairs()
    marks = "".join(sorted({d[1] for d in pairs}))
    # only texts with combining marks pay for the composition
    composed = c
    for d, one in pairs.items():
        composed = F.replace(composed, F.lit(d), F.lit(one))
    c = F.when(c.rlike(f"[{marks}]"), composed).otherwise(c)
    for lig, plain in LIGATURES.items():
        c = F.replace(c, F.lit(lig), F.lit(plain))
    c = F.translate(c, SPACES + VANISHING, " " * len(SPACES))
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def lines(c: Column) -> Column:
    """Cleaned non-empty lines of a page."""
    t = F.regexp_replace(normalize_unicode(c), r"\r\n?", "\n")
    squeezed = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"(?U)^\s+|\s+$", ""))
    return F.filter(squeezed, lambda x: x != "")


def repetition_key(line: Column) -> Column:
    """Lines that differ in their numbers only share this key."""
    return F.regexp_replace(F.lower(line), r"\d+", "#")


# Fixed value: what a lone page number looks like.
PAGE_NUMBER = r"(?iu)^(?:p[áa]g(?:ina|\.)?\s*)?\d{1,4}(?:\s*(?:de|/)\s*\d{1,4})?$|^[-–—]\s*\d{1,4}\s*[-–—]$"


def is_page_number(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER)


def _outside_parens(line: Column) -> Column:
    return F.regexp_replace(line, r"\([^)]*\)?", "")


def mostly_upper(line: Column, share: float = 0.75) -> Column:
    """At least this share of the letters outside parentheses is upper case."""
    t = _outside_parens(line)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace(t, r"[^\p{Lu}]", ""))
    return (letters > 0) & (upper >= letters * share)


def ends_with_period(line: Column) -> Column:
    """A full stop ends the line, one inside parentheses aside."""
    return F.rtrim(_outside_parens(line)).endswith(".")


def is_numeric_rest(line: Column) -> Column:
    """Digits without letters, at most 30 characters: what is left of a split reference."""
    t = F.trim(line)
    return (F.length(t) <= 30) & t.rlike(r"\d") & ~t.rlike(r"\p{L}")


def is_canon_reference(line: Column) -> Column:
    return F.trim(line).rlike(r"(?i)^\(?\s*Cann?\.\s*[\d\s,–\-y]+\)?$")


def is_title_continuation(line: Column) -> Column:
    t = F.trim(line)
    return (F.length(t) <= 100) & ~ends_with_period(t) & (mostly_upper(t) | is_canon_reference(t) | is_numeric_rest(t))


def is_subtitle(line: Column) -> Column:
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    return (letters >= 3) & (F.length(line) <= 240) & ~ends_with_period(line) & mostly_upper(line)


def closes_sentence(line: Column) -> Column:
    """Null (no line before) or ended by a closing mark."""
    return line.isNull() | F.rtrim(line).rlike(r"[.:;?!»”\")…]$")


def sentences(c: Column) -> Column:
    """Sentences: cut behind . ! ? ; : where an upper-case letter, an opening mark or a digit follows."""
    return F.split(c, r"(?<=[.!?;:])\s+(?=[A-ZÁÉÍÓÚÑ¿¡\"«“(\d])")


def tidy_punctuation(c: Column) -> Column:
    """Straight single quotes, no space before closing marks or after opening ones, no double spaces."""
    c = F.replace(c, F.lit('"'), F.lit("'"))
    c = F.regexp_replace(c, r"(?U)\s+([.,:;!?)\]»”’])", "$1")
    c = F.regexp_replace(c, r"(?U)([({\[«“‘])\s+", "$1")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s{2,}", " "), r"(?U)^\s+|\s+$", "")

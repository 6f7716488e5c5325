"""Personal data with offsets that survive deobfuscation.

Base detectors read the text as it stands. A transducer then rewrites
homoglyphs, digits of other scripts, spelled digits and at/dot disguises, and
keeps for every character it writes the source characters it came from; the
same detectors read the rewritten text, and what they find maps back to spans
of the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
RESULT = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
)

# Fixed patterns of the four kinds; emails are found from their @, ips from chains of numbers.
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGIT_DOT = re.compile(r"[0-9]\.[0-9]")

# Letters that look like ASCII ones (fixed values): Cyrillic, Greek, then others.
HOMOGLYPHS = dict(
    zip(
        "аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅ" "οαενρτυικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ıɑɡօ",
        "aeopcyxijsdhqwABEKMHOPCTXIJS" "oaevptuikABEZHIKMNOPTYX" "iago",
        strict=True,
    )
)
# Dashes that stand for a hyphen, and characters that nobody sees (fixed values).
DASHES = "‐‑‒–—―−"
UNSEEN = "\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
# Spelled digits (fixed values): English, French, German, Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Said signs (fixed values): at and dot, in the same languages; plus.
SAID_AT, SAID_POINT, SAID_PLUS = "arroba|arobase", "punto|punkt|point", "plus|más"

# Common last labels (fixed values), asked for only behind a determiner: "at the dot com".
TOP_LABELS = "com|org|net|edu|gov|mil|int|info|biz|io|eu|es|fr|de|uk|it|pt|nl|ch|at|mx|ar|cl|co|pe|us|ca|br"
_DETERMINER = "the|an?|this|that|these|those|each|every|any|some|one|no|its|his|her|my|your|our|their"

_DIGIT_WORD = "|".join(sorted(SPELLED, key=lambda w: (-len(w), w)))
_OPEN, _CLOSE = r"[\(\[\{<]\s*", r"\s*[\)\]\}>]"
#: Bracketed signs; the spaces around them are taken by hand, as a pattern would scan long runs again and again.
_AT = rf"{_OPEN}(?:at|@|{SAID_AT}){_CLOSE}"
_DOT = rf"{_OPEN}(?:dot|\.|{SAID_POINT}){_CLOSE}"
_SAID_DOT = rf"(?:\s+dot\s+|\s*{_DOT}\s*)"
#: What stands behind a bare "at" of an address: names and dots up to a last label of
#: letters. Behind a dot as it is written that label has one case ("home.But" is a
#: sentence's end), and the name isn't www; a determiner needs a common last label.
_HOST = (
    rf"(?!www\.)(?!(?:{_DETERMINER})\s+dot\s+(?!(?:{TOP_LABELS})\b))"
    rf"[A-Za-z0-9-]+(?:(?:\.|{_SAID_DOT})[A-Za-z0-9-]+)*?(?:{_SAID_DOT}[A-Za-z]{{2,}}|\.(?-i:[a-z]{{2,}}|[A-Z]{{2,}}))(?![A-Za-z0-9-])"
)
#: Behind "arroba" any name with a dot, written or said.
_SAID_HOST = rf"[A-Za-z0-9-]+(?:\.|\s+(?:{SAID_POINT}|dot)\s+|\s*{_DOT}\s*)[A-Za-z0-9]"
_AT_DOT = (
    rf"(?P<at>{_AT}|(?<=[A-Za-z0-9])\s+(?:at\s+(?={_HOST})|(?:{SAID_AT})\s+(?={_SAID_HOST})))"
    rf"|(?P<dot>{_DOT}|(?<=[A-Za-z0-9])\s+dot\s+(?=[A-Za-z0-9]))|(?P<point>(?<=[A-Za-z0-9])\s+(?:{SAID_POINT})\s+(?=[A-Za-z0-9]))"
)
_PLUS = rf"\b(?:{SAID_PLUS})[\s-]+"
#: What the transducer rewrites besides single characters: bracketed at and
#: dot; the words "at" and "dot" between name parts; runs of at least seven spelled digits.
_DISGUISE = re.compile(rf"{_AT_DOT}|(?P<digits>(?:{_PLUS})?\b(?:{_DIGIT_WORD})(?:[\s,-]+(?:{_DIGIT_WORD})){{6,}}\b)", re.IGNORECASE)
#: The same for numbers: every spelled digit, and "plus" before one or a digit. The
#: detectors of numbers decide; names would lose their limits ("room two one@example.com").
_NUMBERS = re.compile(
    rf"{_AT_DOT}|(?P<digits>(?:(?<=[0-9])[\s,-]+)?(?:(?:{_PLUS})?\b(?:{_DIGIT_WORD})(?:[\s,-]+(?:{_DIGIT_WORD}))*\b(?:[\s,-]+(?=[0-9]))?|{_PLUS}(?=[0-9])))",
    re.IGNORECASE,
)
#: Looked for in case-folded text, for speed. Without one of the first four nothing of
#: _AT_DOT occurs that an address could hold; without the last no number holds a
#: spelled digit, as a lone one is too short.
_BRACKETED = re.compile(rf"{_AT}|{_DOT}")
_AT_HOST = re.compile(r"at\s+[a-z0-9-]+\.[a-z0-9]")
_NEAR = re.compile(rf"(?:{_DIGIT_WORD}|{SAID_PLUS}|[0-9])(?:[\s,().\[\]{{}}<>-]|dot)+(?:[0-9]|{_DIGIT_WORD})")
_NUMBER_PART = re.compile(rf"\b(?P<plus>{SAID_PLUS})\b[\s-]*|\b(?P<digit>{_DIGIT_WORD})\b|[\s,-]+", re.IGNORECASE)
_LABELS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")

#: A linear-time filter over whole batches, for Arrow's engine, which knows no look-around:
#: a text without a match holds no span, so it never becomes a Python string.
_GAP = r"(?:[\s,().\[\]{}<>\x0b\x1c-\x1f\x{85}\pZ-]|dot)+"
_SUSPECT = "|".join(
    [
        r"@|[0-9]\.[0-9]|\+[0-9]|(?:[0-9][ -]?){13}[0-9]",
        rf"(?:{_DIGIT_WORD}|{SAID_PLUS}){_GAP}(?:[0-9]|{_DIGIT_WORD})|[0-9]{_GAP}(?:{_DIGIT_WORD})|[0-9]{_GAP}dot|dot{_GAP}[0-9]",
        rf"[(\[{{<][\s\pZ\x0b\x1c-\x1f\x{{85}}]*(?:at|dot|\.|{SAID_AT}|{SAID_POINT})[\s\pZ\x0b\x1c-\x1f\x{{85}}]*[)\]}}>]|{SAID_AT}",
        r"[\s\pZ\x0b\x1c-\x1f\x{85}]at[\s\pZ\x0b\x1c-\x1f\x{85}]+[a-z0-9-]+(?:\.[a-z0-9]|[\s\pZ\x0b\x1c-\x1f\x{85}]+dot)",
        # all that a single character could be rewritten from: anything but ASCII, Latin letters, quotes, dashes away from digits
        rf"[0-9][{DASHES}]|[{DASHES}][0-9]|[^\x00-\x7f\x{{a1}}-\x{{a9}}\x{{ab}}\x{{ac}}\x{{ae}}-\x{{b1}}\x{{b4}}-\x{{b8}}\x{{bb}}-\x{{12f}}\x{{132}}-\x{{17e}}\x{{180}}-\x{{24f}}\x{{2018}}-\x{{201f}}\x{{2026}}\x{{20ac}}{DASHES}]",
    ]
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """`[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, by way of the @ signs: no rescans of long runs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (c := text[start - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """`[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)` with parts to 255: four numbers at a time of each dotted chain."""
    for m in _CHAIN.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) per kind leftmost and non-overlapping; failing matches drop out. Linear in the text."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGIT_DOT.search(text):
        out += [(a, b, "ip") for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((*m.span(), "phone"))
    return out


def _plain(c: str) -> str:
    """The ASCII character that one stands for: a homoglyph, a dash, another script's digit, a compatibility form."""
    if c < "\x80":
        return c
    if c in UNSEEN:
        return ""
    d = unicodedata.decimal(c, None)
    if d is not None:
        return str(d)
    same = unicodedata.normalize("NFKC", c)  # fullwidth, mathematical, circled, raised forms; odd spaces
    return same if len(same) == 1 and same < "\x80" else "-" if c in DASHES else HOMOGLYPHS.get(c, c)


class Plain:
    """A text with plain characters, unseen ones left out, and where its characters came from."""

    def __init__(self, text: str):
        table = {} if text.isascii() else {ord(c): p for c in set(text) if (p := _plain(c)) != c}
        self.text, self._gone, self._odd = text, [], []
        if table:
            marks = [m.start() for m in re.finditer("[" + re.escape("".join(map(chr, table))) + "]", text)]
            gone = [i for i in marks if not table[ord(text[i])]]
            self.text = text.translate(table)
            # in places of the new text: before which of its characters something is left out, and which changed
            self._gone = [i - k for k, i in enumerate(gone)]
            self._odd = [i - bisect_left(gone, i) for i in marks if table[ord(text[i])]]
        self.odd = bool(table)

    def source(self, i: int) -> int:
        return i + bisect_right(self._gone, i)

    def changed(self, a: int, b: int) -> bool:
        return bisect_left(self._odd, a) < bisect_left(self._odd, b) or bisect_right(self._gone, a) < bisect_right(self._gone, b - 1)


class Rewritten:
    """A plain text with its disguises rewritten; each piece knows the stretch it came from."""

    def __init__(self, plain: str, disguise: re.Pattern):
        out: list[str] = []
        pieces: list[tuple[int, int, int, bool]] = []  # place in the new text, stretch of the plain one, whether new
        size = at = host = 0

        def put(c: str, a: int, b: int, new: bool = True) -> None:
            nonlocal size
            if c:
                out.append(c)
                pieces.append((size, a, b, new))
                size += len(c)

        for m in disguise.finditer(plain):
            kind, a, b = m.lastgroup, *m.span()
            if kind == "point" and a != host:  # these words are dots only inside a host: "at this point"
                continue
            if kind != "digits":
                while a > at and plain[a - 1].isspace():
                    a -= 1
                while b < len(plain) and plain[b].isspace():
                    b += 1
            put(plain[at:a], at, a, False)
            if kind == "digits":
                for w in _NUMBER_PART.finditer(plain, a, b):
                    if w["digit"]:
                        put(SPELLED[w["digit"].lower()], *w.span())
                    elif w["plus"]:
                        put("+", w.start(), w.end("plus"))
                    elif w.start() == a or w.end() == b:
                        # towards a digit as it is written: one space or hyphen, which numbers may hold
                        put(w[0] if w[0] in (" ", "-") else " ", *w.span(), w[0] not in (" ", "-"))
            else:
                put("@" if kind == "at" else ".", a, b)
                labels = _LABELS.match(plain, b)
                host = labels.end() if labels else 0
            at = b
        put(plain[at:], at, len(plain), False)
        self.text = "".join(out)
        self.pieces = pieces
        self._at = [x[0] for x in pieces]
        self._new = list(accumulate((x[3] for x in pieces), initial=0))

    def stretch(self, a: int, b: int) -> tuple[int, int, bool]:
        """The stretch of the plain text that [a, b) came from, and whether it holds a new piece."""
        i, j = bisect_right(self._at, a) - 1, bisect_right(self._at, b - 1) - 1
        first, last = self.pieces[i], self.pieces[j]
        start = first[1] if first[3] else first[1] + a - first[0]
        end = last[2] if last[3] else last[1] + b - last[0]
        return start, end, self._new[j + 1] > self._new[i]


class _Cover:
    """Whether one of a set of spans holds a given one, by binary search."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self._starts = [a for a, _ in spans]
        self._reach = list(accumulate((b for _, b in spans), max))

    def holds(self, a: int, b: int) -> bool:
        k = bisect_right(self._starts, a)
        return k > 0 and self._reach[k - 1] >= b


def find_spans(text: str | None) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, base) in the source, by start and then kind as listed. Linear in the text but for sorting."""
    if not text:
        return []
    base = base_spans(text)
    plain = Plain(text)
    low = plain.text.casefold()
    near = _NEAR.search(low)
    said = "dot" in low or "arroba" in low or "arobase" in low
    views = [_DISGUISE] if plain.odd or near or said or _BRACKETED.search(low) or _AT_HOST.search(low) else []
    if near:
        views.append(_NUMBERS)
    # a partly disguised identifier holds a base span of its plain part, and is more than that
    taken = _Cover([x[:2] for x in base])
    added: list[tuple[int, int, str]] = []
    for view in views:
        new = Rewritten(plain.text, view)
        earlier = {k: _Cover([x[:2] for x in added if x[2] == k]) for k in KINDS}
        for a, b, kind in base_spans(new.text):
            s, e, rewritten = new.stretch(a, b)
            if (rewritten or plain.changed(s, e)) and not (view is _NUMBERS and kind == "email"):
                s, e = plain.source(s), plain.source(e - 1) + 1
                if not taken.holds(s, e) and not earlier[kind].holds(s, e):
                    added.append((s, e, kind))
    found = [(*x, True) for x in base] + [(*x, False) for x in added]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def suspects(texts: pa.Array) -> pa.Array:
    """Which texts could hold a span; the others surely hold none."""
    return pc.fill_null(pc.match_substring_regex(texts, _SUSPECT, ignore_case=True), False)


def _find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        rows: list[list[dict]] = [[] for _ in range(len(batch))]
        at = pc.indices_nonzero(suspects(batch))
        for i, t in zip(at.to_pylist(), batch.take(at), strict=True):
            rows[i] = [{"kind": k, "start": a, "end": b, "base": own} for a, b, k, own in find_spans(t.as_py())]
        yield pa.array(rows, _ARROW)


def find_pii(df: DataFrame, *, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``df`` with the spans of emails, ips, cards and phones in each whole text.

    Offsets are code points of the source, end exclusive. base marks what the
    detectors find in the text as it stands; the others appear only after
    deobfuscation, hold at least one rewritten character, and may overlap a base
    span (a disguised identifier's plain part) but never lie inside one. Null
    and empty texts have no spans; very long texts are read whole, in time and
    memory that grow in proportion; repeated rows are judged alike; an empty
    table gives an empty one; an existing column ``out_col`` is replaced. A narrow step.
    """
    return df.withColumn(out_col, F.arrow_udf(_find, RESULT)(F.col(text_col)))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(df: DataFrame, *, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """``df`` with each span of the text replaced by ``<KIND>``; overlapping spans by the first one's mark."""

    @F.arrow_udf("string")
    def cover(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if t is not None and found:
                parts, at = [], 0
                for s in found:
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], f"<{s['kind'].upper()}>"]
                    at = max(at, s["end"])
                t = "".join(parts) + t[at:]
            out.append(t)
        return pa.array(out, pa.string())

    return df.withColumn(text_col, cover(F.col(text_col), F.col(spans_col)))

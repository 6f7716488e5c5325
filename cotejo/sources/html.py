"""Web pages: main text, metadata, links and hierarchies, as built-in expressions over an html column."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The entities that are decoded inside the JVM, the ampersand last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&laquo;": "«", "&raquo;": "»", "&amp;": "&"}
# Parts of a page that hold no main text.
BOILERPLATE = ("script", "style", "nav", "footer", "header", "aside", "form", "table", "noscript", "iframe")


def unescape(c: Column) -> Column:
    for k, v in ENTITIES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def strip_tags(c: Column, by: str = "") -> Column:
    return F.regexp_replace(c, r"<[^>]*>", by)


def squeeze(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


def without_boilerplate(html: Column) -> Column:
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in BOILERPLATE:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return c


def main_text(html: Column) -> Column:
    """Headings, paragraphs, list items and quotes of the article (or body), a line each; null if there are none.

    Precision first: comments, tables, navigation, headers, footers, scripts and
    links' targets stay out. Blank and null pages give null.
    """
    clean = without_boilerplate(html)
    inside = F.regexp_extract(clean, r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1)
    body = F.regexp_extract(clean, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)", 1)
    part = F.when(inside != "", inside).otherwise(body)
    blocks = F.regexp_extract_all(part, F.lit(r"(?is)<(?:p|h[1-6]|li|blockquote)\b[^>]*>(.*?)</(?:p|h[1-6]|li|blockquote)\s*>"), 1)
    texts = F.filter(F.transform(blocks, lambda b: squeeze(unescape(strip_tags(b)))), lambda t: t != "")
    return F.when(F.size(texts) > 0, F.array_join(texts, "\n"))


def bounded_text(html: Column, max_bytes: int = 5 << 20) -> Column:
    """Main text of pages up to ``max_bytes`` UTF-8 bytes; null beyond, as for a page that can't be read."""
    return F.when(F.octet_length(html) <= max_bytes, main_text(html))


def _meta(html: Column, names: str) -> Column:
    by_name = F.regexp_extract(html, rf"""(?is)<meta\s[^>]*(?:name|property)\s*=\s*["'](?:{names})["'][^>]*content\s*=\s*["']([^"']*)["']""", 1)
    other = F.regexp_extract(html, rf"""(?is)<meta\s[^>]*content\s*=\s*["']([^"']*)["'][^>]*(?:name|property)\s*=\s*["'](?:{names})["']""", 1)
    return F.when(by_name != "", by_name).otherwise(other)


def metadata(html: Column) -> dict[str, Column]:
    """titulo, autor, fecha, idioma; empty strings for what is absent."""
    h = F.coalesce(html, F.lit(""))
    found = {
        "titulo": F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1),
        "autor": _meta(h, "author|article:author|dc.creator"),
        "fecha": _meta(h, "article:published_time|date|dc.date|datePublished"),
        "idioma": F.regexp_extract(h, r"""(?is)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""", 1),
    }
    return {k: squeeze(unescape(c)) for k, c in found.items()}


def headline(html: Column) -> Column:
    """The title, null if there is none: a premise to offer."""
    return F.nullif(metadata(html)["titulo"], F.lit(""))


def links(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, href, titulo) of each anchor in order."""
    anchors = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)(<a\b[^>]*>.*?</a\s*>)"), 1)
    each = pages.select(id_col, F.posexplode(anchors).alias("pos", "a"))
    href = F.regexp_extract("a", r"""(?is)^<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']""", 1)
    return each.select(id_col, "pos", href.alias("href"), squeeze(unescape(strip_tags(F.col("a")))).alias("titulo")).where("href <> ''")


def index_links(pages: DataFrame, marks: list[str], suffix: str, base: str, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(url, titulo) of links that hold one of ``marks`` and end in ``suffix``, the first of each url."""
    found = links(pages, id_col=id_col, html_col=html_col)
    hit = F.lit(False)
    for m in marks:
        hit = hit | F.contains("href", F.lit(m))
    found = found.where(hit & F.endswith("href", F.lit(suffix))).withColumn("url", F.concat(F.lit(base), "href"))
    first = F.struct(id_col, "pos")
    return found.groupBy("url").agg(F.min_by("titulo", first).alias("titulo"))


class _ListPaths(HTMLParser):
    """Paths of list items that hold a link: own texts of the items above, outermost first."""

    def __init__(self, prefix: str):
        super().__init__()
        self.prefix, self.open, self.lists = prefix, [], 0
        self.found: list[tuple[str, list]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "li":
            self.open.append({"text": [], "depth": self.lists})
        elif tag in ("ul", "ol"):
            self.lists += 1
        elif tag == "a" and self.open:
            href = dict(attrs).get("href") or ""
            item = self.open[-1]
            if href.startswith(self.prefix) and not item.get("href"):
                item["href"] = href
                self.found.append((href, list(self.open)))

    def handle_endtag(self, tag):
        if tag == "li" and self.open:
            self.open.pop()
        elif tag in ("ul", "ol"):
            self.lists -= 1

    def handle_data(self, data):
        if self.open and self.open[-1]["depth"] == self.lists:
            self.open[-1]["text"].append(data)


def list_paths(html: str, prefix: str) -> list[tuple[str, str]]:
    import re

    p = _ListPaths(prefix)
    p.feed(html or "")

    def title(item) -> str:
        t = re.sub(r"\s+", " ", " ".join(item["text"])).strip()
        m = re.search(r"^(.*?\(\s*(?:Cann?\.?)?[^)]*\d+[^)]*\))", t, re.IGNORECASE)
        return (m[1] if m else re.split(r"\s+(?=TÍTULO\b|CAPÍTULO\b|PARTE\b|Art\.\b)", t)[0]).strip()

    return [(href, " > ".join(x for x in map(title, chain) if x)) for href, chain in p.found]


def ancestor_paths(pages: DataFrame, prefix: str, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, href, contexto_jerarquico): where in nested lists each link with the prefix stands."""

    def paths(batch: pa.Array) -> pa.Array:
        rows = [[{"href": h, "ctx": c} for h, c in list_paths(t, prefix)] for t in batch.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("href", pa.string()), ("ctx", pa.string())])))

    udf = F.arrow_udf(paths, "array<struct<href:string,ctx:string>>")
    return pages.select(id_col, F.explode(udf(html_col)).alias("p")).select(id_col, "p.href", F.col("p.ctx").alias("contexto_jerarquico"))


def _read_url(url: str, timeout: float, max_bytes: int) -> str | None:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=timeout) as r:
        body = r.read(max_bytes + 1)
        return None if len(body) > max_bytes else body.decode(r.headers.get_content_charset() or "utf-8", "replace")


def fetch_pages(urls: DataFrame, *, url_col: str = "url", read=_read_url, timeout: float = 30.0, max_bytes: int = 5 << 20, pause: float = 0.0) -> DataFrame:
    """Rows with ``html``: what ``read(url, timeout, max_bytes)`` gives, null for any failure, blank or oversized page.

    Each task fetches its rows in turn, ``pause`` seconds apart; more partitions fetch in parallel.
    """

    def fetch(batch: pa.Array) -> pa.Array:
        import time

        out = []
        for url in batch.to_pylist():
            html = None
            if url and url.strip():
                try:
                    html = read(url.strip(), timeout, max_bytes)
                except Exception:  # a page that can't be had is a null, never a failed job
                    html = None
                time.sleep(pause)
            out.append(html if html and len(html.encode()) <= max_bytes else None)
        return pa.array(out, pa.string())

    return urls.withColumn("html", F.arrow_udf(fetch, "string")(F.col(url_col)))


def plain_lines(html: Column) -> Column:
    """Lines of a page's text: block ends and breaks become line ends, spaces are squeezed, blanks kept out."""
    c = F.regexp_replace(html, r"(?i)</(p|div|h[1-6]|li)>", "\n\n")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    for tag in ("script", "style"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    c = unescape(strip_tags(c, " "))
    return c


def to_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), squeeze), lambda x: x != "")

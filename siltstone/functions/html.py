"""HTML functions: tag patterns as built-ins where regular pages allow it, and a pandas UDF on the standard parser elsewhere."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import clean_title, collapse, text

SKIP_TAGS = frozenset("script style noscript nav footer header aside form iframe svg template button select".split())
SKIP_WORDS = ("cookie", "banner", "sidebar", "breadcrumb", "advert", "social", "share", "newsletter", "popup", "pagination", "menu")
SKIP_EXACT = frozenset(("ad", "ads", "nav", "footer"))
SKIP_ROLES = frozenset(("navigation", "banner", "contentinfo", "search", "complementary", "dialog"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MAIN = ("article", "main")
MAIN_NAMES = frozenset(("main", "content", "entry-content", "post-content"))
BLOCKS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "", "h6": "", "li": "- ", "p": "", "th": "", "td": "", "div": "", "br": ""}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class _Walk(HTMLParser):
    """Lines of the page and of each main container, headings, and the number of boilerplate blocks left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int | None]] = []
        self.skip = self.removed = 0
        self.lines: list[tuple[str, str, list[int]]] = []
        self.buffer: list[str] = []
        self.kind = "p"
        self.open: list[int] = []
        self.containers = 0

    def flush(self) -> None:
        line = " ".join("".join(self.buffer).split())
        if line:
            self.lines.append((self.kind, line, list(self.open)))
        self.buffer = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            self.kind = tag if tag != "br" else self.kind
        if tag in VOID:
            return
        named = dict(attrs)
        names = f"{named.get('class') or ''} {named.get('id') or ''}".lower()
        skips = tag in SKIP_TAGS or (named.get("role") or "") in SKIP_ROLES or bool(SKIP_EXACT & set(names.split())) or any(w in names for w in SKIP_WORDS)
        main = None
        if not skips and (tag in MAIN or named.get("role") == "main" or MAIN_NAMES & set(names.split())):
            self.flush()
            main, self.containers = self.containers, self.containers + 1
            self.open.append(main)
        self.stack.append((tag, skips, main))
        if skips:
            self.flush()
            self.removed += self.skip == 0
            self.skip += 1

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.stack):
            return
        if tag in BLOCKS:
            self.flush()
            self.kind = "p"
        while self.stack:
            top, skips, main = self.stack.pop()
            if skips:
                self.skip -= 1
                self.buffer = [] if self.skip == 0 else self.buffer
            if main is not None:
                self.flush()
                self.open.remove(main)
            if top == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.buffer.append(data)


def extract(page: str | None) -> dict:
    """Main text as lines with marks, its sections and headings, boilerplate blocks removed, and whether no text was found."""
    walk = _Walk()
    walk.feed(page or "")
    walk.close()
    walk.flush()
    best, size = None, -1
    for c in range(walk.containers):
        n = sum(len(line) for _, line, own in walk.lines if c in own)
        if n > size:
            best, size = c, n
    chosen = [(k, line) for k, line, own in walk.lines if best is None or best in own]
    kept: list[tuple[str, str]] = []
    for k, line in chosen:
        if not kept or kept[-1][1] != line:
            kept.append((k, line))
    sections: list[dict] = []
    heading, body = "Overview", []
    for k, line in [*kept, ("h1", "")]:
        if k in HEADINGS:
            if body:
                sections.append({"heading": heading, "content": "\n".join(body)})
            heading, body = line[:140], []
        else:
            body.append(line)
    return {"content": "\n".join(BLOCKS.get(k, "") + line for k, line in kept), "headings": [line for k, line in kept if k in HEADINGS], "sections": sections, "removed": walk.removed, "malformed": not kept}


_SECTION = T.StructType([T.StructField("heading", T.StringType()), T.StructField("content", T.StringType())])
CLEANED = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("headings", T.ArrayType(T.StringType())),
        T.StructField("sections", T.ArrayType(_SECTION)),
        T.StructField("removed", T.IntegerType()),
        T.StructField("malformed", T.BooleanType()),
    ]
)


@F.pandas_udf(CLEANED)
def clean_html(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in pages:
        yield pd.DataFrame([extract(x) for x in s], columns=["content", "headings", "sections", "removed", "malformed"])


def strip_tags(c: Column, quote: str = '"') -> Column:
    """Text without tags, its entities decoded; quote is what &quot; becomes."""
    x = F.regexp_replace(text(c), r"<[^>]*>", "")
    for entity, to in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", quote), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(to))
    return collapse(x)


def headings(c: Column) -> Column:
    """h1 to h6 in order, for pages that close them."""
    return F.filter(F.transform(F.regexp_extract_all(text(c), F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)), strip_tags), lambda h: h != "")


def first_tag(c: Column, tag: str, quote: str = '"') -> Column:
    return strip_tags(F.regexp_extract(text(c), rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1), quote)


def og_title(c: Column) -> Column:
    return collapse(F.regexp_extract(text(c), r"(?i)<meta\s+property=\"og:title\"\s+content=\"([^\"]*)\"", 1))


def title_waterfall(page: Column, slug: Column) -> Column:
    """struct(title, source): Open Graph, article heading, any first heading, title, then the URL's slug."""
    article = first_tag(F.regexp_extract(text(page), r"(?is)<article[^>]*>(.*)</article>", 1), "h1")
    found = [("og", og_title(page)), ("article_h1", article), ("h1", first_tag(page, "h1")), ("title", first_tag(page, "title")), ("url", slug)]
    out = None
    for name, c in found:
        value = F.struct(clean_title(c).alias("title"), F.lit(name).alias("source"))
        hit = clean_title(c) != ""
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def multi_article(c: Column, most: int = 2) -> Column:
    return F.regexp_count(text(c), F.lit(r"(?i)<(article|h1)[\s>]")) > most

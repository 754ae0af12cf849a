"""Text functions: every one is Column -> Column of built-in expressions, and null-safe (a null text counts as empty)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import fuzzy

TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}&.+\-]*"
#: Lines of pages that carry no content; the rules of a site are passed instead of these.
LINE_RULES = (r"^(?i)(skip to (main )?content|read more|share this)$", r"^(?i)(cookie|privacy) (notice|policy)$", r"^(?i)all rights reserved\.?$", r"^[\-_=*. ]{4,}$")
EXACT_LINES = ("home", "menu", "search", "next", "previous", "back to top")
GENERIC_HEADINGS = ("overview", "introduction", "about", "details", "more", "contents", "summary", "information", "general", "notes", "other", "home")


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"[\s ]+", " "))


@F.pandas_udf(T.StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFKC, which Spark has no function for."""
    for s in texts:
        yield s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normalize(c: Column, unicode: bool = False) -> Column:
    """Line ends, hard spaces and doubly encoded quotes repaired, space after commas, pipes as lines, runs of space and of empty lines cut."""
    x = nfkc(text(c)) if unicode else text(c)
    for pattern, to in (
        (r"\r\n?", "\n"),
        (" ", " "),
        ("â€™", "'"),
        (r" *\| *", "\n"),
        (r" *,([^ \n])", ", $1"),
        (r"[ \t]+", " "),
        (r" *\n *", "\n"),
        (r"\n{3,}", "\n\n"),
    ):
        x = F.regexp_replace(x, pattern, to)
    return F.regexp_replace(x, r"^[ \n]+|[ \n]+$", "")


def keep_lines(c: Column, rules: Sequence[str] = LINE_RULES, exact: Sequence[str] = EXACT_LINES, blanks: bool = True) -> Column:
    """Lines without those that rules or exact name, without repeats (in any case) of the line before, and with one blank line in a row at most.

    A blank line does not end a run of repeats. Without blanks, all blank lines go and repeats are compared as they are.
    """
    bad = F.lit(False)
    lines = F.transform(F.split(text(c), "\n"), lambda x: F.trim(x))
    keyed = F.filter(lines, lambda x: ~(_any(x, rules) | F.lower(x).isin(list(exact)) | bad))
    if not blanks:
        full = F.filter(keyed, lambda x: x != "")
        return _let(full, lambda f: F.array_join(F.filter(f, lambda x, i: (i == 0) | (x != F.get(f, i - 1))), "\n"))

    def numbered(k: Column) -> Column:
        """Lines with a word as (x, its place among all, its place among these)."""
        full = F.filter(F.transform(k, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda e: e["x"] != "")
        return F.transform(full, lambda e, n: F.struct(e["x"].alias("x"), e["i"].alias("i"), n.alias("n")))

    def written(kept: Column, k: Column, last: Column) -> Column:
        """Kept lines, each after a blank one if one stands between it and the kept line before; what else stands there are repeats."""
        gap = lambda e, p: (e["i"] - p["i"]) > (e["n"] - p["n"])
        parts = F.transform(kept, lambda e, m: F.concat(F.when((m > 0) & gap(e, F.get(kept, m - 1)), F.lit("\n")).otherwise(F.lit("")), e["x"]))
        end = F.struct(F.size(k).alias("i"), last.alias("n"))
        return F.concat(F.array_join(parts, "\n"), F.when((F.size(kept) > 0) & gap(end, F.get(kept, F.size(kept) - 1)), F.lit("\n")).otherwise(F.lit("")))

    def of(k: Column) -> Column:
        def from_full(full: Column) -> Column:
            kept = F.filter(full, lambda e, n: (n == 0) | (F.lower(e["x"]) != F.lower(F.get(full, n - 1)["x"])))
            return _let(kept, lambda kept_: written(kept_, k, F.size(full)))

        return _let(numbered(k), from_full)

    return _let(keyed, of)


def _any(x: Column, rules: Sequence[str]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | x.rlike(r)
    return out


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(c: Column) -> Column:
    """Lower-case words: a letter or digit, then letters, digits and &.+-"""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(TOKEN), F.lit(0))


def token_count(c: Column) -> Column:
    """Words and single marks; stands in for a model's token count."""
    return F.size(F.regexp_extract_all(text(c), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)))


def paragraphs(c: Column, least: int = 40) -> Column:
    """Blocks between blank lines, or the lines if there is only one block; those of `least` characters or more, trimmed."""
    blocks = F.split(text(c), r"\n[ \t]*\n")
    parts = F.when(F.size(F.filter(blocks, lambda p: F.trim(p) != "")) > 1, blocks).otherwise(F.split(text(c), "\n"))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) >= least)


def summary(c: Column, first: int = 40, most: int = 500) -> Column:
    """The first line of over `first` characters, or the whole text; cut at a word's end to `most` characters."""
    line = F.coalesce(F.get(F.filter(F.split(text(c), "\n"), lambda x: F.length(F.trim(x)) > first), F.lit(0)), text(c))
    flat = F.trim(F.regexp_replace(line, r"\s+", " "))
    cut = F.substring(flat, 1, most)
    return F.when(F.length(flat) <= most, flat).otherwise(F.regexp_replace(cut, r" [^ ]*$", ""))


def clean_title(c: Column, brand: str = r"\s*[|\-]\s*(?i)(official site|home page)$", most: int = 180) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(collapse(c), brand, ""), r"^[ \-|]+|[ \-|]+$", ""), 1, most)


def clean_document_title(c: Column, brand: str = r"^(?i)(home|official site|www\..*)$") -> Column:
    """Segments between pipes, without a first one that is a brand."""
    parts = F.filter(F.transform(F.split(text(c), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return _let(parts, lambda p: F.array_join(F.when((F.size(p) > 1) & F.get(p, F.lit(0)).rlike(brand), F.slice(p, 2, F.size(p))).otherwise(p), " | "))


def is_generic_heading(c: Column, generic: Sequence[str] = GENERIC_HEADINGS) -> Column:
    """Empty, a generic heading, or one made of generic words only."""
    x = F.lower(collapse(c))
    return (x == "") | x.isin(list(generic)) | F.forall(F.split(x, " "), lambda w: w.isin(list(generic)))


def humanize(c: Column, labels: Mapping[str, str] | None = None) -> Column:
    """A display label: that of the table, or the words of the name with capitals."""
    plain = F.initcap(F.regexp_replace(text(c), "[_-]+", " "))
    if not labels:
        return plain
    return F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[c], plain)


def speech(c: Column) -> Column:
    """Text to be read aloud: no [n] marks, bullets as commas."""
    x = F.regexp_replace(text(c), r"\[[0-9]+\]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(^|\n)[ \t]*[*•\-][ \t]+", ", "), r"\s+", " "))


def _department_words(c: Column) -> Column:
    x = F.lower(F.regexp_replace(text(c), "&", " and "))
    x = F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9 ]+", " "), r"(^| )(dr|prof|mr|mrs|ms|the)( |$)", " ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(x, r"(^| )[a-z](?= |$)", " "), " +", " ")), F.lit(" "))


def _department_alias(x: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    out = None
    for name, words in aliases.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | x.contains(f" {w} ")
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out if out is not None else F.lit(None).cast("string")


def _departments(values: Column, aliases: Mapping[str, Sequence[str]], least: float | None = 88.0) -> Column:
    """The names of an array of texts: by alias, else, unless least is None, by the alias most like the text. Texts too long to be like one stay out of Python."""
    names = {w: name for name, words in aliases.items() for w in words}
    longest = 8 * max(map(len, names), default=0)
    words = F.transform(values, _department_words)
    found = F.transform(words, lambda x: _department_alias(x, aliases))
    if least is None:
        return found
    asked = F.zip_with(words, found, lambda x, f: F.when(f.isNull() & (F.length(F.trim(x)) <= longest), F.trim(x)))
    return F.zip_with(found, fuzzy.closest(names, least)(asked), lambda f, g: F.coalesce(f, g))


def normalize_department(c: Column, aliases: Mapping[str, Sequence[str]], least: float | None = 88.0) -> Column:
    """The first name of which an alias stands in the text as a word, after & to and, punctuation, titles and single letters went; else that of an alias at least so many per cent alike, if any."""
    return F.get(_departments(F.array(c), aliases, least), F.lit(0))


def infer_department(columns: Sequence[Column], headings: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """The first name found in the columns, then in the headings."""
    found = _departments(F.concat(F.array(*columns), F.coalesce(headings, F.array().cast("array<string>"))), aliases)
    return F.get(F.filter(found, lambda d: d.isNotNull()), F.lit(0))


def fallback_sections(c: Column, heading: str = r"^[A-Z][^.!?]{2,60}$") -> Column:
    """Plain text as (heading, content): a block that looks like a heading opens a section if the one before has content."""
    blocks = F.filter(F.transform(F.split(text(c), r"\n[ \t]*\n"), lambda p: F.trim(p)), lambda p: p != "")

    def sections(b: Column, opens: Column) -> Column:
        """A section for each run of blocks between headings, under the last heading before it."""
        place = F.transform(b, lambda x, i: i)
        head = lambda i: F.coalesce(F.get(opens, i), F.lit(True))
        first = F.filter(place, lambda i: ~F.get(opens, i) & ((i == 0) | head(i - 1)))
        last = F.filter(place, lambda i: ~F.get(opens, i) & head(i + 1))
        return F.zip_with(first, last, lambda i, j: F.struct(F.when(i == 0, F.lit("Overview")).otherwise(F.get(b, i - 1)).alias("heading"), F.array_join(F.slice(b, i + 1, j - i + 1), "\n").alias("content")))

    return _let(blocks, lambda b: _let(F.transform(b, lambda x: x.rlike(heading)), lambda opens: sections(b, opens)))


def split_large(heading: Column, content: Column, most: int = 1200) -> Column:
    """A section of over `most` words as parts of that many, "Part n" in their headings."""

    def parts(w: Column) -> Column:
        whole = F.array(F.struct(heading.alias("heading"), content.alias("content")))
        n = F.greatest(F.lit(1), F.ceil(F.size(w) / F.lit(most)).cast("int"))
        cut = F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.struct(F.concat(heading, F.lit(" (Part "), i.cast("string"), F.lit(")")).alias("heading"), F.array_join(F.slice(w, (i - 1) * most + 1, most), " ").alias("content")),
        )
        return F.when(F.size(w) <= most, whole).otherwise(cut)

    return _let(F.filter(F.split(text(content), r"\s+"), lambda x: x != ""), parts)

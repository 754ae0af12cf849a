"""Rule tables as data, and the Column builders that read them: first match, votes, flags.

The shipped tables are neutral defaults; every builder takes others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import text

#: ASCII word edges that mean the same in every regular-expression dialect.
LEFT, RIGHT = r"(^|[^a-z0-9])", r"($|[^a-z0-9])"


def word(pattern: str) -> str:
    return f"{LEFT}({pattern}){RIGHT}"


Rules = Sequence[tuple[str, str]]

URL_RULES: Rules = (("News", r"/(news|blog|press)(/|$)"), ("Help", r"/(help|faq|support)(/|$)"), ("French", r"/fr/"), ("Mobile", r"://m\."))
TITLE_RULES: Rules = (("News", word("news|press|report")), ("Help", word("help|questions|faq")), ("Listing", word("list|index|directory")))
HEADING_RULES: Rules = (("Help", word("faq|how to|questions")), ("Events", word("event|events|agenda")))
BODY_RULES: Rules = (("Legal", word("license|licensed|terms")), ("Secrets", word("password|token")), ("Table", r"\|"))
VOTES: Mapping[str, tuple[str, ...]] = {"English": (" the ", " of ", " and ", " in "), "French": (" le ", " de ", " et ", " la "), "German": (" der ", " und ", " die ", " von "), "Spanish": (" el ", " que ", " los ", " y ")}
INTENTS: Rules = (("license_query", word("license|licensed")), ("number_query", "[0-9]{3,}"), ("question_query", r"\?"), ("the_query", word("the of|of the")), ("long_query", r"^.{220,}"))
INTENT_PAGES: Mapping[str, tuple[str, ...]] = {"license_query": ("src0", "src1"), "number_query": ("src2",), "question_query": ("src3", "src4"), "the_query": ("src0", "src5", "src6"), "long_query": ("src7", "src8", "src9"), "general_query": ()}
PRESERVED: tuple[str, ...] = (word("fee|fees|price|prices"), word("deadline|due date"), r"[0-9]{2,}%", word("phone|email"))
CTA: tuple[str, ...] = (word("click here|apply now|sign up|subscribe"), r"!!")
BOILERPLATE: tuple[str, ...] = (word("all rights reserved"), word("licensed under"), word("cookie|cookies"), word("privacy policy"))
EVENT: tuple[str, ...] = (word("event|events"), word("register"), r"[0-9]{1,2}:[0-9]{2}")
COMPONENTS: Rules = (("license", word("licensed under|public license")), ("credentials", word("password|token")), ("table", r" \| "), ("promotion", r"!!"))
TOPICS: Rules = (("legal", word("licensed|license")), ("table", r"\|"), ("english", word("the")), ("french", word("le|la|les")), ("german", word("der|die|das")), ("spanish", word("el|los|las")))
OFF_DOMAIN: tuple[str, ...] = ("credentials", "promotion")
PAGE_TOPICS: Mapping[str, tuple[str, ...]] = {"en": ("english", "legal"), "fr": ("french",), "de": ("german",), "es": ("spanish",)}
QUESTION = r"\?[ \t]*$|^(?i)(q|question)[:.]"
FOLLOWUPS: tuple[str, ...] = (word("it|they|that|this|those|these"), r"^(and|or|but|what about|how about)[^a-z]", word("more|else|also"), word("same|previous"))
ENTITIES: Mapping[str, Rules] = {"topic": (("law", word("license")), ("place", word("inin|anan"))), "lang": (("en", word("the")), ("fr", word("le")), ("de", word("der")))}
AGGREGATOR_URLS = r"/(all|list|archive|index|directory|tags?|category)(/|$)"


def first_match(c: Column, rules: Rules) -> Column:
    """The name of the first rule that finds its pattern, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def any_match(c: Column, patterns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns], F.lit(False))


def hits(c: Column, patterns: Sequence[str]) -> Column:
    """How many of the patterns are found."""
    return reduce(lambda a, b: a + b, [c.rlike(p).cast("int") for p in patterns], F.lit(0))


def occurrences(c: Column, patterns: Sequence[str]) -> Column:
    """How often the patterns are found, all together."""
    return reduce(lambda a, b: a + b, [F.regexp_count(c, F.lit(p)) for p in patterns], F.lit(0))


def vote(c: Column, classes: Mapping[str, Sequence[str]] = VOTES, least: int = 2, base: float = 0.6, step: float = 0.05, top: float = 0.7) -> Column:
    """struct(name, confidence) of the class with the most keywords present, the first of equals; null under `least`."""
    low = F.lower(c)
    counts = [F.struct(reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words]).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, words) in enumerate(classes.items())]
    best = F.array_max(F.array(*counts))
    conf = F.round(F.least(F.lit(top), F.lit(base) + step * (best["n"] - least)), 4)
    return F.when(best["n"] >= least, F.struct(best["name"].alias("name"), conf.alias("confidence")))


def page_type(url: Column, title: Column, headings: Column, body: Column) -> Column:
    """struct(type, confidence): URL, title, first headings, root page, votes on the body, then General."""
    by = lambda name, conf: F.struct(name.alias("type"), F.lit(conf).alias("confidence"))
    u, t, h = first_match(F.lower(url), URL_RULES), first_match(F.lower(title), TITLE_RULES), first_match(F.lower(F.array_join(F.slice(headings, 1, 8), " ")), HEADING_RULES)
    v = vote(F.substring(text(body), 1, 2000))
    root = url.rlike(r"^[a-z]+://[^/]+/?$")
    return (
        F.when(u.isNotNull(), by(u, 0.95))
        .when(t.isNotNull(), by(t, 0.8))
        .when(h.isNotNull(), by(h, 0.7))
        .when(root, by(F.lit("Home"), 0.9))
        .when(v.isNotNull(), F.struct(v["name"].alias("type"), v["confidence"].alias("confidence")))
        .otherwise(by(F.lit("General"), 0.3))
    )


def section_type(heading: Column, body: Column) -> Column:
    """By heading rules, question marks, statistics, structure, body rules, then overview."""
    low = F.lower(text(body))
    return (
        F.when(first_match(F.lower(heading), HEADING_RULES).isNotNull(), F.lower(first_match(F.lower(heading), HEADING_RULES)))
        .when(F.regexp_count(low, F.lit(r"\?")) >= 2, "faq")
        .when(F.regexp_count(low, F.lit(r"[0-9]{2,}")) >= 4, "statistics")
        .when(low.rlike(r" \| "), "table")
        .when(first_match(low, BODY_RULES).isNotNull(), F.lower(first_match(low, BODY_RULES)))
        .otherwise("overview")
    )


def content_type(c: Column, page: Column) -> Column:
    low = F.lower(F.substring(text(c), 1, 1200))
    return F.when(low.rlike(r"\?"), "faq").when(page.isin("src0", "src1"), "reference").when(first_match(low, BODY_RULES).isNotNull(), F.lower(first_match(low, BODY_RULES))).otherwise("prose")


def quality_flags(c: Column, tokens: Column, score: Column, confidence: Column, duplicate: Column, canonical: Column) -> Column:
    """Flags in order: low_content or thin_content, weak_classification, cta_heavy, boilerplate_heavy, event_heavy, duplicate, non_canonical."""
    low = F.lower(text(c))
    marks = [
        (tokens < 60, "low_content"),
        ((tokens >= 60) & (tokens < 150) & (score < 0.5), "thin_content"),
        (confidence < 0.6, "weak_classification"),
        (occurrences(low, CTA) / F.greatest(tokens / 100.0, F.lit(1.0)) >= 1.5, "cta_heavy"),
        (hits(low, BOILERPLATE) >= 2, "boilerplate_heavy"),
        (hits(low, EVENT) >= 3, "event_heavy"),
        (duplicate, "duplicate"),
        (~canonical, "non_canonical"),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in marks]))


def component_type(c: Column) -> Column:
    """The component a paragraph is; null for preserved content and for none."""
    low = F.lower(text(c))
    return F.when(~any_match(low, PRESERVED), first_match(low, COMPONENTS))


def topic(c: Column) -> Column:
    return F.coalesce(first_match(F.lower(F.substring(text(c), 1, 500)), TOPICS), F.lit("general"))


def route(query: Column, intents: Rules = INTENTS) -> Column:
    return F.coalesce(first_match(F.lower(text(query)), intents), F.lit("general_query"))


def matched_terms(query: Column, intent: Column) -> Column:
    """The strings that the intent's rule finds, in order, each once."""
    low = F.lower(text(query))
    out = F.array().cast("array<string>")
    for name, pattern in INTENTS:
        found = F.array_distinct(F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)), lambda x: F.trim(x)))
        out = F.when(intent == name, found).otherwise(out)
    return out


def entities(c: Column, rules: Mapping[str, Rules] = ENTITIES) -> Column:
    """A map of the first match of each kind; kinds without one are left out."""
    low = F.lower(text(c))
    found = F.create_map(*[x for kind, r in rules.items() for x in (F.lit(kind), first_match(low, r))])
    return F.map_filter(found, lambda k, v: v.isNotNull())


def is_aggregator(url: Column, c: Column, least: int = 8) -> Column:
    """A listing by its URL, or by many paragraphs that open with a capitalised phrase."""
    parts = F.filter(F.split(text(c), "\n"), lambda p: (F.length(F.trim(p)) >= 30) & F.trim(p).rlike(r"^[A-Z][a-z]+ [A-Z]"))
    return F.lower(text(url)).rlike(AGGREGATOR_URLS) | (F.size(parts) >= least)


def is_atomic(c: Column) -> Column:
    """A block that is not cut at sentences: a table, two bullets or more, or a question with its answer."""
    return text(c).rlike(r"[|\t]") | (F.regexp_count(text(c), F.lit(r"(?m)^[ ]*[-*•] ")) >= 2) | text(c).rlike(r"(?im)^(q|question)[:.]")


def answerability(c: Column) -> Column:
    """0.4, more for lists, tables, numbers and facts, less for calls to act, on the first 2000 characters; 0 to 1."""
    x = F.substring(text(c), 1, 2000)
    low = F.lower(x)
    up = F.lit(0.4) + F.when(low.rlike(r"\?"), 0.25).otherwise(0.0)
    up = up + F.least(F.lit(0.2), 0.07 * F.regexp_count(x, F.lit(r"(?m)^[ ]*[-*•] "))) + F.when(x.rlike(r" \| "), 0.15).otherwise(0.0)
    up = up + F.least(F.lit(0.25), 0.08 * F.regexp_count(x, F.lit("[0-9]{2,}"))) + F.least(F.lit(0.3), 0.07 * hits(low, PRESERVED + BOILERPLATE))
    down = F.least(F.lit(0.3), 0.1 * occurrences(low, CTA))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), up - down)), 4)

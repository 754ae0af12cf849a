"""Validation of documents and chunks, eligibility, and predicates on filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import fuzzy, keys, rules
from siltstone.functions.text import text


def issues(url: Column, title: Column, content: Column, department: Column, page_type: Column, n_sections: Column, departments: Sequence[str] = (), page_types: Sequence[str] = (), aligned: bool = False) -> Column:
    """An array of struct(field, message, severity); errors first of their fields, warnings kept beside good rows. With aligned, also a title and content unlike the URL's slug."""

    def issue(when: Column, field: str, message: str, severity: str) -> Column:
        return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"), F.lit(severity).alias("severity")))

    out = [
        issue(~text(url).rlike(r"^https?://[^/]+"), "url", "no scheme or host", "error"),
        issue(F.length(F.trim(text(title))) < 6, "title", "too short", "error"),
        issue(F.length(text(content)) < 300, "content", "short", "warning"),
        issue(n_sections == 0, "sections", "none", "warning"),
    ]
    if departments:
        out.append(issue(department.isNotNull() & ~department.isin(list(departments)), "department", "unknown", "error"))
    if page_types:
        out.append(issue(page_type.isNotNull() & ~page_type.isin(list(page_types)), "page_type", "unknown", "error"))
    if aligned:
        slug, evidence = keys.slug_words(url), F.concat_ws(" ", text(title), F.substring(text(content), 1, 1000))
        out.append(issue((slug != "") & (F.trim(evidence) != "") & (fuzzy.token_set_ratio(slug, evidence) < 25), "title", "low similarity to content", "warning"))
    return F.array_compact(F.array(*out))


def split_failures(df: DataFrame, issues_column: str = "issues") -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and those with one; warnings do not fail a row."""
    bad = F.exists(F.col(issues_column), lambda x: x["severity"] == "error")
    return df.filter(~bad), df.filter(bad)


def quality_warnings(content: Column, multi_article: Column) -> Column:
    """Sorted names: short content, a directory listing, several articles."""
    head = F.lower(F.substring(text(content), 1, 500))
    found = [F.when(F.length(text(content)) < 300, "short_content"), F.when(is_directory(head), "directory_listing"), F.when(multi_article, "multi_article")]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def is_directory(c: Column) -> Column:
    return c.contains("index of") | c.contains("parent directory") | c.rlike(r"last modified.*size")


def chunk_reject(c: Column) -> Column:
    """The reason to reject a chunk, or null: blank, boilerplate only (up to 160 characters), a useless fragment."""
    t = F.trim(text(c))
    low = F.lower(t)
    return (
        F.when(t == "", "blank")
        .when((F.length(t) <= 160) & rules.any_match(low, rules.BOILERPLATE), "boilerplate")
        .when(t.rlike(r"^[0-9\p{P}\s]+$"), "fragment")
        .when((F.length(t) < 20) & low.rlike(r"^(the|a|an|and|or|of|in|to|for)([^a-z]|$)"), "fragment")
    )


def chunk_warnings(c: Column, tokens: Column) -> Column:
    t = F.trim(text(c))
    return F.array_compact(F.array(F.when(t == "", "empty"), F.when(tokens > 1000, "too_long"), F.when(rules.any_match(F.lower(t), rules.BOILERPLATE), "boilerplate")))


def skip_reason(reusable: Column, contaminated: Column, flags: Column) -> Column:
    """Why a chunk is not embedded, by precedence; null if it is."""
    has = lambda name: F.array_contains(flags, name)
    return F.when(reusable, "reusable_component").when(contaminated, "contaminated").when(has("cta_heavy"), "cta_heavy").when(has("boilerplate_heavy"), "boilerplate_heavy")


def dense_filter(page_types: Sequence[str] = (), section_types: Sequence[str] = (), exclude_reusable: bool = True, exclude_contaminated: bool = True) -> Column:
    """The predicate of a dense search: lists that are empty admit all."""
    out = F.lit(True)
    if page_types:
        out = out & F.col("page_type").isin(list(page_types))
    if section_types:
        out = out & F.col("section_type").isin(list(section_types))
    if exclude_reusable:
        out = out & ~F.coalesce(F.col("is_reusable_component"), F.lit(False))
    if exclude_contaminated:
        out = out & ~F.coalesce(F.col("cross_domain_contamination"), F.lit(False))
    return out


def admit(df: DataFrame, page_types: Sequence[str]) -> DataFrame:
    return df.filter(F.col("page_type").isin(list(page_types))) if page_types else df


def exclude_components(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df without reusable components, and one row with their number."""
    reusable = F.coalesce(F.col("is_reusable_component"), F.lit(False))
    return df.filter(~reusable), df.agg(F.sum(reusable.cast("long")).alias("components_excluded"))


def is_followup(query: Column, prior_turns: Column, user_turn_first: bool = False) -> Column:
    """A marker and an earlier turn; with user_turn_first the query itself counts as one, as a caller that appends before asking does."""
    return rules.any_match(F.lower(text(query)), rules.FOLLOWUPS) & ((prior_turns + (1 if user_turn_first else 0)) > 0)

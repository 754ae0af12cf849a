"""Grounded contexts and answers: prompts, citations, confidence, abstention, a judge's words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import text


def grounding(blocks: DataFrame, query: str, score: str, section: str, page: str) -> DataFrame:
    """A row a query: n_blocks, grounding (mean score, 4 digits), mean_score, diversity counts and warnings."""
    out = blocks.groupBy(query).agg(F.count(F.lit(1)).alias("n_blocks"), F.avg(score).alias("mean_score"), F.countDistinct(section).alias("n_sections"), F.countDistinct(page).alias("n_pages"))
    out = out.withColumn("grounding", F.round(F.col("mean_score") + 1e-9, 4))
    marks = [(F.col("grounding") < 0.5, "low_confidence"), (F.col("n_blocks") < 2, "insufficient_blocks"), ((F.col("n_blocks") >= 3) & (F.col("n_sections") < 2), "low_topical_diversity")]
    return out.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in marks])))


def prompt(blocks: DataFrame, query: str, position: str, label: str, body: str) -> DataFrame:
    """Blocks in order, numbered from 1, between lines of dashes."""
    k = F.row_number().over(Window.partitionBy(query).orderBy(position))
    rows = blocks.select(query, k.alias("k"), F.col(label).alias("l"), F.col(body).alias("t"))
    part = lambda b: F.concat(F.lit("["), b["k"].cast("string"), F.lit("] ("), b["l"], F.lit(")\n"), b["t"])
    return rows.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "l", "t"))), part), "\n---\n").alias("prompt"))


def cited_indices(answer: Column) -> Column:
    """Numbers in brackets, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text(answer), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("long")))


def citations(answers: DataFrame, blocks: DataFrame, query: str, answer: str, position: str) -> DataFrame:
    """The blocks that an answer's marks name; marks out of range name none."""
    named = answers.select(query, F.explode(cited_indices(F.col(answer))).alias(position))
    return named.join(blocks, [query, position])


def coverage(answers: DataFrame, answer: str, n: str) -> DataFrame:
    """answers with cited, coverage (marks in range over blocks) and warnings."""
    out = answers.withColumn("cited", cited_indices(F.col(answer)))
    ok = F.size(F.filter("cited", lambda i: (i >= 1) & (i <= F.col(n))))
    marks = [(F.col("_ok") == 0, "no_citations"), (F.col("_ok") < F.size("cited"), "out_of_range")]
    out = out.withColumn("_ok", ok).withColumn("coverage", F.when(F.col(n) > 0, F.round(F.col("_ok") / F.col(n), 4)).otherwise(0.0))
    return out.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in marks]))).drop("_ok")


def parse_judge(said: Column) -> Column:
    """struct(risk, claims, judged): the JSON between the first { and the last }, risk cut to 0 to 1, blank claims dropped; nothing readable is risk 0, unjudged."""
    body = F.regexp_extract(text(said), r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, "risk double, claims array<string>")
    risk = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(parsed["risk"], F.lit(0.0))))
    claims = F.filter(F.coalesce(parsed["claims"], F.array().cast("array<string>")), lambda c: F.trim(c) != "")
    return F.struct(risk.alias("risk"), claims.alias("claims"), parsed["risk"].isNotNull().alias("judged"))


def judged(said: Column, least: float = 0.5) -> Column:
    """struct(risk, claims, judged, safe) of what a judge said; null, as an error of the judge leaves it, and words without a verdict are safe."""
    j = parse_judge(said)
    return F.struct(j["risk"].alias("risk"), j["claims"].alias("claims"), j["judged"].alias("judged"), (j["risk"] < least).alias("safe"))


def context(queries: DataFrame, blocks: DataFrame, query: str, position: str, score: str, section: str, page: str, label: str, body: str) -> DataFrame:
    """A row for each of queries: grounding, diversity, warnings and the prompt of its blocks; a query without blocks has the warning no_blocks and an empty prompt."""
    have = grounding(blocks, query, score, section, page).join(prompt(blocks, query, position, label, body), query)
    rows = queries.select(query).distinct().join(have, query, "left")
    empty = F.col("n_blocks").isNull()
    return rows.select(
        query,
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
        F.coalesce("grounding", F.lit(0.0)).alias("grounding"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sections", "n_pages")],
        F.when(empty, F.array(F.lit("no_blocks"))).otherwise(F.col("warnings")).alias("warnings"),
        F.coalesce("prompt", F.lit("")).alias("prompt"),
    )


def confidence(ground: Column, risk: Column, cover: Column, mean_score: Column) -> Column:
    return F.round(0.4 * ground + 0.3 * (1 - risk) + 0.2 * cover + 0.1 * mean_score + 1e-9, 4)


def abstention(blocks: Column, warnings: Column, ground: Column, risk: Column) -> Column:
    """The first reason to abstain, or null."""
    return F.when(blocks == 0, "no_context").when(warnings > 0, "context_warning").when(ground < 0.3, "low_grounding").when(risk >= 0.5, "high_risk")


def cacheable(abstained: Column, n_citations: Column, ground: Column, risk: Column | None = None) -> Column:
    """Fit for the cache; without risk, as on a hit, the risk is not tested, and an unjudged risk counts as 0."""
    ok = ~abstained & (n_citations >= 1) & (ground >= 0.5)
    return ok if risk is None else ok & (F.coalesce(risk, F.lit(0.0)) <= 0.3)


def augment(query: Column, entities: Column) -> Column:
    """The query with the values of entities that it does not name."""
    return F.concat_ws(" ", query, F.array_join(F.filter(F.map_values(entities), lambda v: ~F.lower(query).contains(F.lower(v))), " "))


def rewrite_is_sane(original: Column, rewritten: Column) -> Column:
    words = lambda c: F.size(F.filter(F.split(text(c), r"\s+"), lambda w: w != ""))
    return words(rewritten) >= F.greatest(F.lit(2), F.ceil(0.6 * words(original)))


def mock_answer(prompt_: Column) -> Column:
    """The default answerer: says the prompt's opening back. A real one is passed as another Column function."""
    return F.concat(F.lit("Based on [1]: "), F.substring(text(prompt_), 1, 200))

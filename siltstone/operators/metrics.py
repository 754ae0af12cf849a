"""Retrieval and answer metrics, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: To 4 digits as SQL rounds doubles, by their binary value: .00015 of 20000 relevant documents, which is stored as less, goes down.
_share = lambda x: F.floor(x * 1e4 + 0.5) / 1e4

NAMES = ("recall_5", "recall_10", "mrr", "hit_rate", "precision_3", "purity_5")


def per_query(results: DataFrame, query: str, intent: str) -> DataFrame:
    """results (query, intent, rank, relevant, page_type, total) to the six measures, 4 digits."""
    hit = lambda k: F.sum((F.col("relevant") & (F.col("rank") <= k)).cast("int"))
    total = F.max("total")
    first = F.min_by("page_type", "rank")
    grouped = results.groupBy(query, intent).agg(
        F.when(total > 0, _share(hit(5) / total)).otherwise(0.0).alias("recall_5"),
        F.when(total > 0, _share(hit(10) / total)).otherwise(0.0).alias("recall_10"),
        F.round(F.coalesce(1.0 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0)), 4).alias("mrr"),
        F.max(F.col("relevant").cast("int")).cast("double").alias("hit_rate"),
        F.round(hit(3) / 3.0, 4).alias("precision_3"),
        first.alias("_first"),
        F.collect_list(F.when(F.col("rank") <= 5, F.col("page_type"))).alias("_types"),
    )
    return grouped.withColumn("purity_5", F.round(F.size(F.filter("_types", lambda t: t == F.col("_first"))) / 5.0, 4)).drop("_first", "_types")


def rollup(measures: DataFrame, intent: str) -> DataFrame:
    """Means by intent, and over all as ALL."""
    out = measures.rollup(intent).agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(m) + 1e-9, 4).alias(m) for m in NAMES])
    return out.withColumn(intent, F.coalesce(intent, F.lit("ALL")))


def mode_gain(modes: DataFrame) -> DataFrame:
    return modes.withColumn("gain", F.col("hybrid") - F.greatest("bm25", "dense"))


def primary_type(results: DataFrame, query: str, kind: str, rank: str) -> DataFrame:
    """The most frequent type of a query's results, of equals the first seen."""
    n = results.groupBy(query, kind).agg(F.count(F.lit(1)).alias("c"), F.min(rank).alias("r"))
    return n.groupBy(query).agg(F.max_by(kind, F.struct(F.col("c"), -F.col("r"))).alias("primary_type"))


def keyword_coverage(keywords: Column, texts: Column) -> Column:
    found = F.size(F.filter(keywords, lambda w: F.exists(texts, lambda t: t.contains(w))))
    return F.when(F.size(keywords) > 0, F.round(found / F.size(keywords), 4)).otherwise(0.0)


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def corpus_report(chunks: DataFrame, doc: str, seq: str, canonical: str, duplicate: str) -> DataFrame:
    """One row: chunks, documents, duplicate chunks, and canonical documents, each judged by its first chunk alone."""
    by_doc = chunks.groupBy(doc).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(duplicate).cast("long")).alias("d"), F.min_by(canonical, seq).alias("c"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return by_doc.agg(n("n").alias("chunks"), F.count(F.lit(1)).alias("documents"), n("d").alias("duplicate_chunks"), n(F.col("c").cast("long")).alias("canonical_documents"))


def semantic_report(chunks: DataFrame, reusable: str, contaminated: str, mixed: str, priority: str) -> DataFrame:
    """One row: reusable, contaminated and mixed chunks, those with none of these marks, and the mean priority, 4 digits."""
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    marks = [F.coalesce(F.col(c), F.lit(False)) for c in (reusable, contaminated, mixed)]
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        *[n(m).alias(name) for m, name in zip(marks, ("reusable", "contaminated", "mixed"), strict=True)],
        n(~(marks[0] | marks[1] | marks[2])).alias("clean"),
        F.round(F.avg(priority) + 1e-9, 4).alias("mean_priority"),
    )


def context_quality(contexts: DataFrame, tokens: str) -> DataFrame:
    """One row over contexts (grounding, n_sections, warnings): means, and the share of those of low confidence."""
    low = F.array_contains("warnings", "low_confidence") | F.array_contains("warnings", "no_blocks")
    return contexts.agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.avg("grounding") + 1e-9, 4).alias("mean_grounding"),
        F.round(F.avg("n_sections") + 1e-9, 4).alias("mean_sections"),
        F.round(F.avg(tokens) + 1e-9, 4).alias("mean_tokens"),
        F.round(F.avg(low.cast("double")) + 1e-9, 4).alias("low_confidence_share"),
    )


def answer_means(answers: DataFrame) -> DataFrame:
    """One row over answers (grounding, coverage, risk, judged, abstained): means of those not abstained, of risk only where judged."""
    said, mean = ~F.col("abstained"), lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)) + 1e-9, 4)
    return answers.agg(
        F.count(F.lit(1)).alias("answers"),
        mean(F.when(said, F.col("grounding"))).alias("mean_grounding"),
        mean(F.when(said, F.col("coverage"))).alias("mean_coverage"),
        mean(F.when(said & F.col("judged"), F.col("risk"))).alias("mean_risk"),
        mean(F.when(said & F.col("judged"), (F.col("risk") >= 0.5).cast("double"))).alias("unsafe_share"),
        mean(F.col("abstained").cast("double")).alias("abstention_rate"),
    )

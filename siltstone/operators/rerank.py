"""Reranking, diversity, budgets: greedy choices are folds over one query's bounded, ordered pool."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import fuzzy
from siltstone.functions.text import text


def jaccard_logit(query: Column, passage: Column) -> Column:
    """-3 + 8 times the word Jaccard similarity, -5 for an empty side: the offline stand-in of a cross-encoder."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(text(c)), r"\s+"), lambda w: w != ""))
    a, b = words(query), words(passage)
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), -5.0).otherwise(-3.0 + 8.0 * F.size(F.array_intersect(a, b)) / union)


def sigmoid(x: Column) -> Column:
    return F.round(F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x))), 4)


def blend(calibrated: Column, answerability: Column, w: float = 0.8) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), w * calibrated + (1 - w) * answerability)), 4)


def boost(score: Column, hit: Column, by: float = 0.1) -> Column:
    return F.when(hit, F.least(F.lit(1.0), score + by)).otherwise(score)


def caps(pool: DataFrame, query: str, order: list[Column], key: str, section: str, document: str, top_k: int, per_section: int = 2, per_document: int = 2, exempt: tuple[str, ...] = ("overview", "general")) -> DataFrame:
    """pool with `status`: kept, section_type_saturated, document_saturated or below_top_k, by a fold in order; rejected rows use up no quota.

    A query's pool is bounded (tens of rows), so it is folded as one array.
    """
    n = "_n"
    ranked = pool.withColumn(n, F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    rows = ranked.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col(n).alias("n"), F.col(key).cast("string").alias("key"), F.col(section).cast("string").alias("s"), F.col(document).cast("string").alias("d")))).alias("rows"))
    kind = "array<struct<n:int,status:string>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.array().cast("array<string>").alias("s"), F.array().cast("array<string>").alias("d"))

    def count(items: Column, x: Column) -> Column:
        return F.size(F.filter(items, lambda i: i == x))

    def fold(acc: Column, r: Column) -> Column:
        full = F.size(acc["d"]) >= top_k
        sections = ~r["s"].isin(list(exempt)) & (count(acc["s"], r["s"]) >= per_section)
        documents = count(acc["d"], r["d"]) >= per_document
        status = F.when(full, "below_top_k").when(sections, F.concat(F.lit("section_type_saturated:"), r["s"])).when(documents, "document_saturated").otherwise("kept")
        kept = status == "kept"
        return F.struct(
            F.concat(acc["out"], F.array(F.struct(r["n"].alias("n"), status.alias("status")))).alias("out"),
            F.when(kept, F.concat(acc["s"], F.array(r["s"]))).otherwise(acc["s"]).alias("s"),
            F.when(kept, F.concat(acc["d"], F.array(r["d"]))).otherwise(acc["d"]).alias("d"),
        )

    done = rows.select(query, F.inline(F.aggregate("rows", start, fold, lambda acc: acc["out"])))
    return ranked.join(done.withColumnRenamed("n", n), [query, n]).withColumnRenamed(n, "position")


def budget(pool: DataFrame, query: str, order: list[Column], cost: str, most: int) -> DataFrame:
    """pool with `fits`: in order, each row that fits into what is left of the query's budget is kept, and others are passed over."""
    ranked = pool.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    rows = ranked.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), F.col(cost).cast("long").alias("c")))).alias("rows"))
    start = F.struct(F.array().cast("array<struct<n:int,fits:boolean>>").alias("out"), F.lit(0).cast("long").alias("used"))

    def fold(acc: Column, r: Column) -> Column:
        fits = acc["used"] + r["c"] <= most
        return F.struct(F.concat(acc["out"], F.array(F.struct(r["n"].alias("n"), fits.alias("fits")))).alias("out"), (acc["used"] + F.when(fits, r["c"]).otherwise(F.lit(0))).alias("used"))

    done = rows.select(query, F.inline(F.aggregate("rows", start, fold, lambda acc: acc["out"])))
    return ranked.join(done.withColumnRenamed("n", "_n"), [query, "_n"]).withColumnRenamed("_n", "position")


def suppress_similar(pool: DataFrame, query: str, position: str, key: str, passage: str, least: float = 85.0, prefix: int = 600) -> DataFrame:
    """(query, key, duplicate_of): in order, a row whose first characters are nearly those of an accepted one names it. A pool is one query's tens of rows."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        accepted: list[tuple] = []
        out = []
        for r in frame.sort_values(position).itertuples(index=False):
            mine = (getattr(r, passage) or "")[:prefix]
            match = next((k for k, t in accepted if fuzzy.token_set(mine, t) >= least), None)
            if match is None:
                accepted.append((getattr(r, key), mine))
            out.append((getattr(r, query), getattr(r, key), match))
        return pd.DataFrame(out, columns=[query, key, "duplicate_of"]).astype({"duplicate_of": "Int64"})

    kinds = dict(pool.dtypes)
    return pool.select(query, position, key, passage).groupBy(query).applyInPandas(one, f"{query} {kinds[query]}, {key} {kinds[key]}, duplicate_of {kinds[key]}")


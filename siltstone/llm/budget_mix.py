"""Mixing sources to target weights by fitting each source's budget as a bounded subset sum.

Documents are counted by exact word length. Every source takes whole passes over its documents while its target holds
them; the rest of its budget is fitted on its length counts: an even share of each length, then single documents from
the longest length down, then a bounded-knapsack table over the last DP_CAP words. Within a length, documents are taken
in the order of a seeded hash of doc_id and text, so reruns agree. Texts are read twice: once to be counted, of which slim
rows (source, size, slice of the hash) are written, and once for the result, whose rows are exchanged once, with the
columns that the caller keeps.

Null texts have size 0 and are taken 0 words; a very long text is counted whole; a null source is a source of its own,
last in order; repeated rows are documents of their own, and ties of the seeded hash between equal rows are the same row
either way. Empty tables give an empty result. Further columns are kept; those that bear a name of OUT give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, table, word_array

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
DP_CAP = 1 << 15
SLICES = 64
#: These columns are the operator's own: columns of docs with these names give way to them.
OUT = ("size", "source_size", "target", "repeats")


def water_fill(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_REPEATS) -> dict[str | None, float]:
    """Targets by weight in code-point order, null last; what exceeds most times a source's size is reshared by weight."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    free, left, out = list(order), share * sum(sizes.values()), {}
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def fit(counts: dict[int, int], budget: int, cap: int = DP_CAP) -> dict[int, int]:
    """How many documents of each length to take so that their words come to budget, or as near below as the counts allow."""
    lengths = sorted((n for n in counts if n > 0), reverse=True)
    total = sum(n * counts[n] for n in lengths)
    if not total or budget <= 0:
        return {}
    if budget >= total:
        return {n: counts[n] for n in lengths}
    take = {n: counts[n] * budget // total for n in lengths}
    left = budget - sum(n * k for n, k in take.items())
    for n in lengths:
        if left <= cap:
            break
        k = min(counts[n] - take[n], (left - cap + n - 1) // n, left // n)
        take[n] += k
        left -= n * k
    room = min(left, cap)
    # Bounded knapsack: reach[j] holds, as bits, the sums that the first j parts make; a part is 2^i documents of a length.
    parts: list[tuple[int, int]] = []
    for n in lengths:
        k, p = min(counts[n] - take[n], room // n), 1
        while k > 0:
            parts.append((n, min(p, k)))
            k, p = k - p, 2 * p
    mask, reach = (1 << (room + 1)) - 1, [1]
    for n, k in parts:
        new = (reach[-1] | reach[-1] << (n * k)) & mask
        if new != reach[-1]:
            reach.append(new)
        else:
            reach.append(reach[-1])
        if new >> room & 1:
            break
    at = reach[-1].bit_length() - 1
    for j in range(len(reach) - 1, 0, -1):
        if not reach[j - 1] >> at & 1:
            n, k = parts[j - 1]
            take[n] += k
            at -= n * k
    return {n: k for n, k in take.items() if k}


PLAN = "p_null boolean, p_source string, p_size long, source_size long, target double, passes long, picked long"


def _plan(targets: dict[str | None, float], sizes: dict[str | None, int], cap: int):
    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                source = None if row.own_null else row.own_source
                counts = {int(x["own_size"]): int(x["n"]) for x in row.counts}
                whole = sizes[source]
                budget = round(targets[source])
                passes = budget // whole if whole else 0
                took = fit(counts, budget - passes * whole, cap)
                lengths = sorted(counts)
                yield pd.DataFrame(
                    {"p_null": row.own_null, "p_source": row.own_source, "p_size": lengths, "source_size": whole, "target": targets[source], "passes": passes, "picked": [took.get(n, 0) for n in lengths]}
                )

    return plan


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = DP_CAP) -> DataFrame:
    """docs with size, source_size, target and repeats (how often the mix takes the document)."""
    kept = [c for c in docs.columns if c not in OUT]
    order = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)), F.lit(1 << 40))
    own = {
        "own_null": F.col("source").isNull(),
        "own_source": F.coalesce(F.col("source"), F.lit("")),
        "own_size": F.size(word_array(F.col("text"))).cast("long"),
        "own_slice": (order / F.lit((1 << 40) // SLICES)).cast("int"),
    }
    length, key = ["own_null", "own_source", "own_size"], list(own)
    slices = Scratch(docs.sparkSession, "mix").put(docs.select(*[c.alias(k) for k, c in own.items()]).groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
    counted = slices.groupBy(*length).agg(F.sum("n").alias("n"))
    by_source = counted.groupBy("own_null", "own_source").agg(F.sum(F.col("own_size") * F.col("n")).alias("words"))
    sizes = {None if r["own_null"] else r["own_source"]: r["words"] or 0 for r in by_source.collect()}  # one row a source
    targets = water_fill(sizes, weights, share)
    # A source's counts are bounded by the number of distinct lengths, not of documents.
    planned = counted.groupBy("own_null", "own_source").agg(F.collect_list(F.struct("own_size", "n")).alias("counts")).mapInPandas(_plan(targets, sizes, cap), PLAN)
    # The first `picked` documents of a length in seeded order: count by slice of the hash, rank only inside a slice.
    below = Window.partitionBy(*length).orderBy("own_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.withColumn("before", F.coalesce(F.sum("n").over(below), F.lit(0)))
    cuts = before.join(planned, [F.col(a) == F.col(b) for a, b in zip(length, ("p_null", "p_source", "p_size"), strict=True)])
    cuts = cuts.select(*key, F.struct("source_size", "target", "passes", (F.col("picked") - F.col("before")).alias("picked")).alias("own_cut"))
    # The caller's columns travel under numbers, so that no name of theirs meets one of these.
    wide = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], order.alias("own_order"), *[c.alias(k) for k, c in own.items()])
    inside = Window.partitionBy(*key).orderBy("own_order")
    joined = wide.withColumn("own_rank", F.row_number().over(inside)).join(cuts, key)
    return joined.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)],
        F.col("own_size").alias("size"),
        "own_cut.source_size",
        "own_cut.target",
        (F.col("own_cut.passes") + (F.col("own_rank") <= F.col("own_cut.picked")).cast("long")).alias("repeats"),
    )


def op9_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "source")


QUERIES = {"op9_budget_mix": op9_budget_mix}
ORACLES: dict[str, str] = {}

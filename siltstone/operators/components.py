"""Corpus-wide operators: paragraph registry, reusable components, topics, contamination, section paths, priority."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import keys, rules, text

PRIORITY: Mapping[str, float] = {"en": 1.0, "fr": 0.8, "de": 0.6, "es": 0.4}
PENALTY: Mapping[str, float] = {"low_content": 0.3, "thin_content": 0.2, "weak_classification": 0.1, "cta_heavy": 0.3, "boilerplate_heavy": 0.4, "event_heavy": 0.1, "duplicate": 0.5, "non_canonical": 0.2}


def explode_paragraphs(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, pos, paragraph, fp)"""
    p = df.select(key, F.posexplode(text.paragraphs(F.col(column))).alias("pos", "paragraph"))
    return p.withColumn("fp", keys.paragraph_hash(F.col("paragraph")))


def registry(paragraphs: DataFrame, key: str, least: int = 5) -> DataFrame:
    """(fp, n_docs, sample, component) of paragraphs in `least` documents or more; component is null for preserved ones.

    Rows are made distinct by (fp, document) before they are counted, so a line that every document has is summed, not gathered.
    """
    once = paragraphs.groupBy("fp", key).agg(F.min(F.struct("pos", "paragraph")).alias("p"))
    counted = once.groupBy("fp").agg(F.count(F.lit(1)).alias("n_docs"), F.min_by("p.paragraph", key).alias("sample")).filter(F.col("n_docs") >= least)
    preserved = rules.any_match(F.lower("sample"), rules.PRESERVED)
    return counted.withColumn("component", F.when(~preserved, F.coalesce(rules.component_type(F.col("sample")), F.lit("boilerplate"))))


def assess(paragraphs: DataFrame, reg: DataFrame, key: str, share: float = 0.5) -> DataFrame:
    """(key, component_share, is_reusable, dominant, types): character mass of components, none reusable beside a preserved paragraph."""
    rows = paragraphs.join(reg.select("fp", "component"), "fp", "left").withColumn("n", F.length("paragraph"))
    preserved = rules.any_match(F.lower("paragraph"), rules.PRESERVED)
    by_type = rows.groupBy(key, "component").agg(F.sum("n").alias("n"), F.min("pos").alias("first"), F.max(preserved.cast("int")).alias("preserved"))
    own = F.col("component").isNotNull()
    out = by_type.groupBy(key).agg(
        F.round(F.sum(F.when(own, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("component_share"),
        F.max("preserved").alias("_preserved"),
        F.max_by("component", F.when(own, F.struct(F.col("n"), -F.col("first")))).alias("dominant"),
        F.array_sort(F.collect_set("component")).alias("types"),
    )
    return out.withColumn("is_reusable", (F.col("component_share") >= share) & (F.col("_preserved") == 0)).drop("_preserved")


def topics(paragraphs: DataFrame, key: str, share: float = 0.3) -> DataFrame:
    """(key, mixed, dominant_topics): two topics or more, general aside, that each hold a share of the paragraphs; by number, then first place."""
    counted = paragraphs.withColumn("topic", rules.topic(F.col("paragraph"))).groupBy(key, "topic").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    rows = counted.groupBy(key).agg(F.sum("n").alias("total"), F.collect_list(F.struct((-F.col("n")).alias("o"), "first", "topic", "n")).alias("t"))
    big = F.filter(F.array_sort("t"), lambda x: (x["topic"] != "general") & (x["n"] >= share * F.col("total")))
    return rows.withColumn("big", F.transform(big, lambda x: x["topic"])).select(key, ((F.col("total") >= 2) & (F.size("big") >= 2)).alias("mixed"), F.col("big").alias("dominant_topics"))


def contamination(page: Column, component_types: Column, topic_names: Column, expected: Mapping[str, Sequence[str]] = rules.PAGE_TOPICS, off: Sequence[str] = rules.OFF_DOMAIN) -> Column:
    """Off-domain components, then off_topic: names that the page type does not expect; unknown types expect nothing in particular."""
    table = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    strange = F.when(table[page].isNull(), F.array().cast("array<string>")).otherwise(F.array_except(topic_names, table[page]))
    return F.array_distinct(F.concat(F.filter(component_types, lambda x: x.isin(list(off))), F.transform(strange, lambda x: F.concat(F.lit("off_topic:"), x))))


def with_documents(chunks: DataFrame, docs: DataFrame, chunk_doc: str, doc: str, columns: Sequence[str]) -> DataFrame:
    """chunks with columns of their documents, empty where there is none. Of rows that repeat a document the smallest counts."""
    known = docs.groupBy(F.col(doc).alias("_doc")).agg(*[F.min(c).alias(c) for c in columns])
    return chunks.join(known, F.col(chunk_doc) == F.col("_doc"), "left").withColumns({c: F.coalesce(c, F.lit("")) for c in columns}).drop("_doc")


def section_path(*parts: Column) -> Column:
    """Parts in order, generic and empty ones left out, each once in any case."""
    kept = F.filter(F.array(*parts), lambda x: x.isNotNull() & ~text.is_generic_heading(x))
    return F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))


def priority(kind: Column, confidence: Column, quality: Column, flags: Column, base: Mapping[str, float] = PRIORITY, penalty: Mapping[str, float] = PENALTY, unknown: float = 0.3) -> Column:
    """base * (.7 + .3 confidence) * (.7 + .3 quality) less the flags' penalties, 0 to 1, 3 digits."""
    look = lambda table, key, other: F.coalesce(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[key], F.lit(other))
    less = F.aggregate(F.transform(flags, lambda f: look(penalty, f, 0.0)), F.lit(0.0), lambda a, x: a + x)
    raw = look(base, kind, unknown) * (0.7 + 0.3 * confidence) * (0.7 + 0.3 * quality) - less
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) + 1e-9, 3)


def normalize_chunks(chunks: DataFrame, key: str, page: str, content: str) -> DataFrame:
    """The whole pass: registry, components, topics, contamination, flags and priority of every chunk."""
    paras = explode_paragraphs(chunks.select(key, F.col(content).alias("text")), key)
    reg = registry(paras, key)
    tokens = text.token_count(F.col(content))
    first = chunks.groupBy(keys.content_hash(F.col(content)).alias("h")).agg(F.min(key).alias("first"))
    rows = chunks.withColumn("h", keys.content_hash(F.col(content))).join(first, "h").join(assess(paras, reg, key), key, "left").join(topics(paras, key), key, "left")
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, empty) for c in ("types", "dominant_topics")}).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_reusable", "mixed")})
    flags = rules.quality_flags(F.col(content), tokens, F.lit(0.5), F.lit(0.7), F.col("first") != F.col(key), F.lit(True))
    rows = rows.withColumn("contamination", contamination(F.col(page), F.col("types"), F.col("dominant_topics"))).withColumn("flags", flags)
    rows = rows.withColumn("priority", priority(F.col(page), F.lit(0.7), F.lit(0.5), F.col("flags")))
    from siltstone.operators.validate import skip_reason

    return rows.withColumn("skip_reason", skip_reason(F.col("is_reusable"), F.size("contamination") > 0, F.col("flags"))).drop("h", "first")

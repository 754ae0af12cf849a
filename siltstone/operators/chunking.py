"""Chunking: sections to groups to token-sized chunks. Row generation by posexplode; sequential packing as folds over one document."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import keys, rules, text

GROUP, IDEAL, HARD, OVERLAP, TINY = 650, 700, 1000, 60, 40
_TOKEN = re.compile(r"\w+|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def sections(df: DataFrame, key: str, column: str, content: str) -> DataFrame:
    """(key, pos, heading, content): the sections that have content, or the whole document as Overview."""
    full = F.filter(F.col(column), lambda s: F.trim(s["content"]) != "")
    whole = F.array(F.struct(F.lit("Overview").alias("heading"), F.col(content).alias("content")))
    return df.select(key, F.posexplode(F.when(F.coalesce(F.size(full), F.lit(0)) > 0, full).otherwise(whole)).alias("pos", "s")).select(key, "pos", "s.heading", "s.content")


def faq_groups(lines: DataFrame, key: str, pos: str, line: str) -> DataFrame:
    """(key, group, text, n_lines): a new group at each line that is a question."""
    q = F.col(line).rlike(rules.QUESTION).cast("int")
    rows = lines.withColumn("group", F.sum(q).over(Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, line))), lambda s: s[line]), "\n").alias("text"), F.count(F.lit(1)).alias("n_lines"))


def pack(paragraphs: Column, most: int = GROUP) -> Column:
    """Greedy groups of paragraphs of up to `most` tokens; a larger paragraph stands alone. array<struct<text, tokens>>"""
    kind = "array<struct<text:string,tokens:int>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit("").alias("text"), F.lit(0).alias("tokens"))

    def close(acc: Column) -> Column:
        return F.when(acc["tokens"] > 0, F.concat(acc["out"], F.array(F.struct(acc["text"].alias("text"), acc["tokens"].alias("tokens"))))).otherwise(acc["out"])

    def fold(acc: Column, p: Column) -> Column:
        n = text.token_count(p)
        fits = (acc["tokens"] == 0) | (acc["tokens"] + n <= most)
        joined = F.when(acc["tokens"] == 0, p).otherwise(F.concat(acc["text"], F.lit("\n"), p))
        return F.struct(F.when(fits, acc["out"]).otherwise(close(acc)).alias("out"), F.when(fits, joined).otherwise(p).alias("text"), F.when(fits, acc["tokens"] + n).otherwise(n).alias("tokens"))

    return F.aggregate(paragraphs, start, fold, close)


def count_tokens(x: str) -> int:
    return len(_TOKEN.findall(x))


def _atomic(block: str) -> bool:
    return "|" in block or "\t" in block or len(re.findall(r"(?m)^\s*[-*•] ", block)) >= 2 or bool(re.search(r"(?im)^(q|question)[:.]", block))


def _tail(units: list[str], most: int) -> list[str]:
    """The longest run of last units within `most` tokens."""
    out: list[str] = []
    size = 0
    for u in reversed(units):
        size += count_tokens(u)
        if size > most:
            break
        out.insert(0, u)
    return out


def _pack_units(units: list[str], most: int, overlap: int) -> list[str]:
    out, held, size = [], [], 0
    for u in units:
        n = count_tokens(u)
        if held and size + n > most:
            out.append(" ".join(held))
            held = _tail(held, overlap)
            size = sum(map(count_tokens, held))
            if size + n > most:
                held, size = [], 0
        held.append(u)
        size += n
    return out + ([" ".join(held)] if held else [])


def split_tokens(content: str, ideal: int = IDEAL, hard: int = HARD, overlap: int = OVERLAP) -> list[str]:
    """Up to `hard` tokens as they are; else atomic blocks and sentences packed to `ideal`, each chunk opening with up to `overlap` tokens of the last."""
    if count_tokens(content) <= hard:
        return [content] if content.strip() else []
    units: list[str] = []
    for block in (b for b in re.split(r"\n\s*\n|\n", content) if b.strip()):
        units += [block] if _atomic(block) else [s for s in _SENTENCE.split(block) if s.strip()]
    small: list[str] = []
    for u in units:
        if count_tokens(u) <= ideal:
            small.append(u)
        else:
            words = u.split()
            small += [" ".join(words[i : i + ideal // 2]) for i in range(0, len(words), ideal // 2)]
    return _pack_units(small, ideal, overlap)


def merge_tiny(chunks: list[str], tiny: int = TINY, hard: int = HARD) -> list[str]:
    """Chunks of under `tiny` tokens are carried forward into the next, or joined to the last, while `hard` allows."""
    out: list[str] = []
    held = ""
    for c in chunks:
        both = f"{held}\n{c}" if held else c
        if held and count_tokens(both) > hard:
            out.append(held)
            both = c
        if count_tokens(both) < tiny:
            held = both
        else:
            out.append(both)
            held = ""
    if held:
        if out and count_tokens(f"{out[-1]}\n{held}") <= hard:
            out[-1] = f"{out[-1]}\n{held}"
        else:
            out.append(held)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def token_chunks(contents: pd.Series) -> pd.Series:
    return contents.map(lambda c: merge_tiny(split_tokens(c or "")))


def contextualize(chunk: Column, title: Column, heading: Column, tiny: int = TINY) -> Column:
    """A chunk under `tiny` tokens with its title and heading above it; null parts are left out."""
    return F.when(text.token_count(chunk) < tiny, F.concat_ws("\n", title, heading, chunk)).otherwise(chunk)


def source_quality(n_warnings: Column, n_issues: Column) -> Column:
    return 1 - F.least(F.lit(0.4), 0.08 * n_warnings) - F.least(F.lit(0.3), 0.05 * n_issues)


def chunk_documents(docs: DataFrame, key: str = "doc_id", content: str = "text") -> DataFrame:
    """(key, chunk_index, chunk_key, text, tokens, hash) of every document."""
    rows = docs.select(key, F.posexplode(token_chunks(F.coalesce(F.col(content), F.lit("")))).alias("chunk_index", "text"))
    return rows.withColumn("hash", keys.content_hash(F.col("text"))).withColumn("tokens", text.token_count(F.col("text"))).withColumn("chunk_key", keys.chunk_id(F.col(key).cast("string"), F.col("chunk_index"), F.col("text")))

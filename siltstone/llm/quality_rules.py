"""Quality rules: a threshold table compiled into one Spark projection.

Every measure and every rule is a built-in expression over the row, so the pass needs no shuffle, no Python and no
grouping, and a hot source or a group of copies costs what its rows cost. Null and empty texts have no words: all their
measures are 0 and the base rule on n_words fails them. A very long text is measured whole, in time n log n of its words.
Repeated rows give repeated results, an empty table an empty result; further columns are kept out of the result, whatever
they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import let, table, word_array

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Very frequent words of the languages served; a rule asks for a share of them.
STOP_WORDS = tuple(
    "the of and to in is it as for with that on by was are be this or an at from "
    "le la les de des du et un une que qui en dans pour par sur au aux est avec "
    "der die das und zu den von mit für im ist ein eine dem nicht auf sch "
    "el los las y que se del con una su es al lo como".split()
)


@dataclass(frozen=True)
class Rule:
    """A document fails if measure * 100 lies under low or over high times the value of per (1 if per is empty)."""

    name: str
    measure: str
    per: str = ""
    low: int | None = None
    high: int | None = None


BASE_RULES = (Rule("few_words", "n_words", low=5000), Rule("repeated_windows", "n_repeat_words", "n_words", high=50))
METHOD_RULES = (
    Rule("many_words", "n_words", high=100 * 1_000_000),
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=20),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=50),
    Rule("stop_words", "n_stop_words", "n_words", low=2),
    Rule("capitals", "n_capitals", "n_letters", high=60),
)


def _covered(starts: Column, n: int) -> Column:
    """Words that windows of n words at these sorted starts cover."""
    return F.aggregate(
        F.transform(starts, lambda i, k: F.coalesce(F.least(F.lit(n), F.get(starts, k + 1) - i), F.lit(n)).cast("long")),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )


def _repeat_words(words: Column, n: int = 3) -> Column:
    """Words that lie in a window of n words found twice or more: sort window hashes, keep the starts of equal neighbours, add up the words they cover.

    What is sorted are longs of a window's place below the upper bits of its hash. Neighbours are compared by whole hashes;
    if two differ only in the bits that gave way, the text's whole hashes are sorted instead.
    """
    start = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(start, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))

    def whole(h: Column) -> Column:
        def twice(s: Column) -> Column:
            equal = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            return let(F.array_sort(F.transform(F.filter(s, equal), lambda x: x["i"])), lambda p: _covered(p, n))

        return let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), twice)

    def packed(h: Column, place: Column) -> Column:
        def alike(s: Column, x: Column, k: Column) -> list[Column]:
            return [F.get(s, k + d).bitwiseXOR(x) <= place for d in (-1, 1)]

        def check(s: Column, x: Column, k: Column) -> Column:
            """x's place if its hash is a neighbour's; -1 if no neighbour is alike in the upper bits; -2 if one is, but its hash is another."""
            near = [F.coalesce(a & (F.get(s, k + d).bitwiseXOR(x) >= 0), F.lit(False)) for a, d in zip(alike(s, x, k), (-1, 1), strict=True)]
            at = lambda y: F.get(h, y.bitwiseAND(place).cast("int"))
            same = [a & (at(F.get(s, k + d)) == at(x)) for a, d in zip(near, (-1, 1), strict=True)]
            return F.when(~(near[0] | near[1]), F.lit(-1)).when(same[0] | same[1], x.bitwiseAND(place).cast("int")).otherwise(F.lit(-2))

        def checked(s: Column) -> Column:
            return let(
                F.filter(F.transform(s, lambda x, k: check(s, x, k)), lambda i: i != -1),
                lambda p: F.when(F.exists(p, lambda i: i == -2), whole(h)).otherwise(let(F.sort_array(p), lambda q: _covered(q, n))),
            )

        def some(s: Column) -> Column:
            found = F.filter(s, lambda x, k: alike(s, x, k)[0] | alike(s, x, k)[1])
            return let(found, lambda c: F.when(F.size(c) == 0, F.lit(0).cast("long")).otherwise(checked(c)))

        return let(F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(place)).bitwiseOR(i.cast("long")))), some)

    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.size(words) + 1)).cast("int")) - 1
    return let(hashed, lambda h: let(mask, lambda m: packed(h, m)))


def measures(text: Column) -> Column:
    """The struct of all measures of a text, as one expression."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.translate(text, SPACES, "")

    def of(words: Column) -> Column:
        return let(
            lines,
            lambda full: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(bare).cast("long").alias("word_chars"),
                (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                F.size(full).cast("long").alias("n_lines"),
                (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
                _repeat_words(words).alias("n_repeat_words"),
                F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
                (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
                (F.length(text) - F.length(F.translate(F.lower(text), "abcdefghijklmnopqrstuvwxyz", ""))).cast("long").alias("n_letters"),
            ),
        )

    return let(word_array(text), of)


def compile_rules(rules: tuple[Rule, ...], m: Column) -> Column:
    """True if any rule fails; an empty table never fails."""
    failed = F.lit(False)
    for r in rules:
        per = m[r.per] if r.per else F.lit(1)
        if r.low is not None:
            failed = failed | (m[r.measure] * 100 < per * r.low)
        if r.high is not None:
            failed = failed | (m[r.measure] * 100 > per * r.high)
    return failed


def quality(docs: DataFrame, rules: tuple[Rule, ...] = METHOD_RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """doc_id, the measures and both verdicts for every row of docs, in one projection."""
    row = let(
        measures(F.col("text")),
        lambda m: F.struct(*[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], compile_rules(base, m).alias("base_failed"), (~compile_rules(base, m) & ~compile_rules(rules, m)).alias("kept")),
    )
    return docs.select("doc_id", F.inline(F.array(row)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM w, unnest(range(1, len(ws) - 1)) AS r(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, unnest([0, 1, 2]) AS o(j) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
  length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
  length(regexp_replace(lower(t), '[^a-z]', '', 'g'))::BIGINT AS n_letters
  FROM w LEFT JOIN rep ON rep.rid = w.rid),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words > 1000000 OR 100 * word_chars < 200 * n_words OR 100 * word_chars > 1500 * n_words
  OR 100 * n_symbols > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_stop_words < 2 * n_words
  OR 100 * n_capitals > 60 * n_letters) AS kept FROM v"""


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES = {"op7_quality_rules": _sql()}

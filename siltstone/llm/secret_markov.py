"""Secret scans: three base patterns, and character Markov models of random strings and of ordinary identifiers.

Everything on the main path is a built-in expression over the row. A pattern's places come from its matches and the
pieces between them: a running sum of their lengths, in code points, gives starts and ends. Tokens of MIN_TOKEN or more
characters with a letter among them are scored by the log-likelihood ratio of two first-order Markov models, a table of
65 x 65 values that is counted with Spark from labelled samples and is a literal of the plan. A token is a secret if its
ratio is at least THRESHOLD a character, or PLAIN_THRESHOLD if it has no digit, and it has MIN_DISTINCT different
characters; it is added as a `markov` span if it overlaps no base span.

A very long text is scanned whole, by the same expressions. Null and empty texts have no spans (base_sha256 is that of the empty string). Repeated rows give equal rows, empty tables
an empty result. Further columns are kept by redact(), ignored by secrets().
"""

from __future__ import annotations

from functools import lru_cache
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import let, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A failing match of these two holds no other match, so the lengths stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
SIZE = len(ALPHABET) + 1
MIN_TOKEN = 16
TOKEN = rf"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}"
THRESHOLD = 0.6
#: Words and identifiers without a digit are far more than those with one, and lie under this value.
PLAIN_THRESHOLD = 1.0
#: Rules and fillers such as `aaaa` are unlike both models.
MIN_DISTINCT = 6
SAMPLE = 6000
KINDS = ("assign", "access", "hex", "markov")
MASK = "[SECRET]"
_PARTS = (
    "user account name id value index count list map set get put make build parse read write load save open close file path "
    "line word text page item node edge tree graph table row column key field type class method object string number "
    "default config setting option version release module package system server client session request response handler "
    "error warning message event queue worker task job batch stream buffer cache store memory disk block chunk segment "
    "customer supplier order invoice payment product price total amount currency country region language "
    "temperature pressure history report summary detail status active enabled visible updated created deleted "
    "therein another nation question mention action section station ending reading standing morning evening"
).split()


def labelled_sample(spark: SparkSession, n: int = SAMPLE, seed: int = 11) -> DataFrame:
    """(token, random): seeded random strings as base64, hexadecimal or upper-case keys, and identifiers put together from words."""
    rows = spark.range(n, numPartitions=1).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 512))
    base64 = F.translate(F.base64(F.unhex(F.substring("h", 1, 72))), "=", "")
    upper = F.substring(F.regexp_replace(F.upper(F.base64(F.unhex("h"))), "[^A-Z0-9]", ""), 1, 24)
    random = F.element_at(F.array(base64, F.substring("h", 1, 40), F.translate(base64, "+/", "-_"), upper), (F.col("id") % 4 + 1).cast("int"))
    words = F.array(*[F.lit(w) for w in _PARTS])
    pick = [F.get(words, F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(len(_PARTS))).cast("int")) for i in range(4)]
    number = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)).cast("string")
    forms = [
        F.concat_ws("_", *pick[:3], number),
        F.concat(pick[0], *[F.initcap(p) for p in pick[1:]], number),
        F.concat_ws("-", *pick[:2], number, pick[2]),
        F.concat(*pick[:3], number),
        F.concat_ws("/", *pick, number),
        F.upper(F.concat_ws("_", *pick[:3], number)),
        F.initcap(F.concat(*pick[:4])),
    ]
    ordinary = F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int"))
    return rows.select(random.alias("token"), F.lit(True).alias("random")).unionByName(rows.select(ordinary.alias("token"), F.lit(False).alias("random")))


def _code(c: Column) -> Column:
    return F.call_function("instr", F.lit(ALPHABET), c)


def _codes(token: Column) -> Column:
    """The start mark 0, then the numbers of a token's characters."""
    return F.concat(F.array(F.lit(0)), F.transform(F.filter(F.split(token, ""), lambda c: c != ""), _code))


def train(sample: DataFrame) -> list[float]:
    """Log-likelihood ratios by (previous, next) character, SIZE * SIZE of them, from labelled tokens: one count by Spark."""
    pairs = sample.select("random", _codes(F.col("token")).alias("c")).select("random", F.explode(F.arrays_zip(F.expr("slice(c, 1, size(c) - 1)").alias("a"), F.expr("slice(c, 2, size(c) - 1)").alias("b"))).alias("p"))
    counts: dict[tuple[bool, int, int], int] = {(r["random"], r["a"], r["b"]): r["n"] for r in pairs.groupBy("random", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for a in range(SIZE):
        totals = {kind: sum(counts.get((kind, a, b), 0) for b in range(SIZE)) for kind in (True, False)}
        for b in range(SIZE):
            p, q = ((counts.get((kind, a, b), 0) + 0.5) / (totals[kind] + 0.5 * SIZE) for kind in (True, False))
            out.append(log(p / q))
    return out


@lru_cache(maxsize=4)
def _default_model(app: str, n: int) -> tuple[float, ...]:
    return tuple(train(labelled_sample(SparkSession.getActiveSession(), n)))


def default_model(spark: SparkSession) -> list[float]:
    return list(_default_model(spark.sparkContext.applicationId, SAMPLE))


def ratio(token: Column, model: Column) -> Column:
    """Log-likelihood ratio a character."""
    return let(
        _codes(token),
        lambda c: F.aggregate(
            F.transform(c, lambda x, i: F.when(i > 0, F.get(model, F.get(c, i - 1) * SIZE + x)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x
        )
        / F.greatest(F.size(c) - 1, F.lit(1)),
    )


def _running(values: Column) -> Column:
    """Sums of all values before each, in blocks of about the root of their number, so that many matches stay cheap."""

    def sums(v: Column) -> Column:
        return F.aggregate(
            v,
            F.struct(F.array().cast("array<long>").alias("o"), F.lit(0).cast("long").alias("s")),
            lambda acc, x: F.struct(F.concat(acc["o"], F.array(acc["s"])).alias("o"), (acc["s"] + x).alias("s")),
        )["o"]

    def blocks(v: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(1), F.size(v), step)).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, lambda s: F.slice(v, s, step))
        return let(
            parts,
            lambda p: let(
                sums(F.transform(p, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))),
                lambda base: F.flatten(F.transform(p, lambda b, i: F.transform(sums(b), lambda x: x + F.get(base, i)))),
            ),
        )

    return let(values, blocks)


def _span(kind: int, start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(kind).alias("kind"), end.cast("long").alias("end"))


_NO_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def find_spans(text: Column, pattern: str, kind: int, least: tuple[int, int] | None = None, score=None) -> Column:
    """Spans of all matches; with least=(group, n) those whose group has n characters, with score those that it accepts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def of(m: Column) -> Column:
        before = F.split(text, pattern, -1)
        lens = F.zip_with(before, m, lambda p, x: (F.length(p) + F.coalesce(F.length(x), F.lit(0))).cast("long"))
        gaps = F.transform(before, lambda p: F.length(p))

        def place(run: Column) -> Column:
            return let(gaps, lambda g: F.transform(m, lambda x, i: _span(kind, F.get(run, i) + F.get(g, i), F.get(run, i) + F.get(g, i) + F.length(x))))

        spans = let(_running(lens), place)
        if least is not None:
            group = F.regexp_extract_all(text, F.lit(pattern), F.lit(least[0]))
            return let(group, lambda g: F.filter(spans, lambda s, i: F.length(F.get(g, i)) >= least[1]))
        if score is not None:
            return F.filter(spans, lambda s, i: score(F.get(m, i)))
        return spans

    return F.when(text.rlike(pattern), let(found, of)).otherwise(F.array().cast(_NO_SPANS))


def join_spans(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def is_random(token: Column, model: Column, threshold: float = THRESHOLD) -> Column:
    """Whether the models take a token for a random string."""
    least = F.when(token.rlike("[0-9]"), F.lit(threshold)).otherwise(F.lit(max(threshold, PLAIN_THRESHOLD)))
    return (ratio(token, model) >= least) & (F.size(F.array_distinct(F.split(token, ""))) >= MIN_DISTINCT)


def scan(text: Column, model: list[float], threshold: float = THRESHOLD) -> Column:
    """struct(base, spans): base spans, and all spans, each sorted by start, kind and end."""
    text = F.coalesce(text, F.lit(""))
    llr = F.lit(model)

    def of(base: Column) -> Column:
        markov = find_spans(text, TOKEN, 3, score=lambda t: is_random(t, llr, threshold))
        new = F.filter(markov, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return F.struct(base.alias("base"), F.array_sort(F.concat(base, new)).alias("spans"))

    return let(F.array_sort(F.concat(find_spans(text, ASSIGN, 0, (2, 8)), find_spans(text, ACCESS, 1), find_spans(text, HEX, 2))), of)


def secrets(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and the struct `found` of scan() for every row of docs."""
    return docs.select("doc_id", scan(F.col("text"), model or default_model(docs.sparkSession), threshold).alias("found"))


def redact(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every span, overlapping ones as one, replaced by MASK in text; other columns stay."""

    def masked(spans: Column) -> Column:
        merged = F.aggregate(
            spans,
            F.array().cast("array<struct<start:bigint,end:bigint>>"),
            lambda acc, s: F.when(
                (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(-1)) >= s["start"]),
                F.concat(
                    F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                    F.array(F.struct(F.get(acc, F.size(acc) - 1)["start"].alias("start"), F.greatest(F.get(acc, F.size(acc) - 1)["end"], s["end"]).alias("end"))),
                ),
            ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
        )
        text = F.col("text")
        return let(
            merged,
            lambda m: F.concat(
                F.array_join(F.transform(m, lambda s, i: F.substring(text, (F.coalesce(F.get(m, i - 1)["end"], F.lit(0)) + 1).cast("int"), (s["start"] - F.coalesce(F.get(m, i - 1)["end"], F.lit(0))).cast("int"))), MASK),
                F.lit(MASK),
                F.substring(text, (F.get(m, F.size(m) - 1)["end"] + 1).cast("int"), F.length(text)),
            ),
        )

    found = scan(F.col("text"), model or default_model(docs.sparkSession), threshold)["spans"]
    return docs.withColumn("text", let(found, lambda s: F.when(F.size(s) == 0, F.col("text")).otherwise(masked(s))))


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op4_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    base = F.col("found.base")
    return found.select(
        "doc_id",
        *[_count(base, k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(join_spans(base), 256).alias("base_sha256"),
        join_spans(F.col("found.spans")).alias("spans"),
    )


QUERIES = {"op4_secret_markov": op4_secret_markov}
ORACLES: dict[str, str] = {}

"""Cache and session state in batch form: vector index, lookup, admission, routing, time to live; turns, entities, session records.

A cache is a table of entries (cache_key, section, version, created_at, answer and so on) beside an index (cache_key, vector).
Each operation takes the tables as they are and returns them as they should be; the caller writes them with a sink.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import rules, text
from siltstone.operators import retrieval
from siltstone.operators.answer import cacheable
from siltstone.operators.embed import check_dimension
from siltstone.sources import tables

TTL_DAYS: Mapping[str, int] = {"click": 3, "view": 7, "purchase": 30, "signup": 90}
DEFAULT_TTL = 14


def ttl(section: Column, table: Mapping[str, int] = TTL_DAYS, default: int = DEFAULT_TTL) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[section], F.lit(default))


def is_fresh(created: Column, now: Column, section: Column) -> Column:
    """Fresh if the age is at most the section's days."""
    return now.cast("timestamp").cast("long") - created.cast("timestamp").cast("long") <= ttl(section) * 86400


def staleness(created: Column, now: Column, section: Column) -> Column:
    age = F.floor((now.cast("timestamp").cast("long") - created.cast("timestamp").cast("long")) / 86400)
    return F.when(is_fresh(created, now, section), F.lit(None).cast("string")).otherwise(F.concat(F.lit("age "), age.cast("string"), F.lit("d over ttl "), ttl(section).cast("string"), F.lit("d")))


def lookup_outcome(similarity: Column, found: Column, fresh: Column, valid: Column, least: float = 0.88) -> Column:
    """miss, dropped (the entry is gone), stale (evicted), invalid or hit."""
    return F.when(similarity.isNull() | (similarity < least), "miss").when(~found, "dropped").when(~fresh, "stale").when(~valid, "invalid").otherwise("hit")


def index_put(index: DataFrame, new: DataFrame, key: str, dim: int, order: str | None = None, vector: str = "vector") -> DataFrame:
    """index with the vectors of new added, or in the place of those of their keys; a vector of another dimension is an error."""
    checked = new.withColumn(vector, check_dimension(F.col(vector), dim))
    return tables.upsert(index, checked, key, order=order)


def index_remove(index: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """index without the keys; keys that it does not hold are no error."""
    return index.join(keys.select(key).distinct(), key, "left_anti")


def index_search(index: DataFrame, queries: DataFrame, key: str, k: int, dim: int, vector: str = "vector") -> DataFrame:
    """(query_id, key, score, rank): the k entries nearest to each (query_id, query_vector); none for an empty index."""
    near = retrieval.dense(index, queries, key, k, vector=vector, dim=dim)
    return retrieval.top_k(near, "query_id", [F.desc("score"), F.asc(key)], k).select("query_id", key, "score", "rank")


def lookup(queries: DataFrame, index: DataFrame, entries: DataFrame, key: str, now: Column, version: str, dim: int, least: float = 0.88) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, index, entries): each query's nearest entry judged, and both tables without what a lookup evicts.

    Only the nearest entry counts. One that is gone from entries leaves the index; a stale one leaves both; one of another
    version is a miss and stays.
    """
    nearest = queries.select("query_id").join(index_search(index, queries, key, 1, dim).drop("rank"), "query_id", "left")
    rows = nearest.join(entries.select(key, "section", "created_at", "version", F.lit(True).alias("_found")), key, "left")
    fresh = is_fresh(F.col("created_at"), now, F.col("section"))
    outcome = lookup_outcome(F.col("score"), F.coalesce("_found", F.lit(False)), fresh, F.col("version") == version, least)
    out = rows.select("query_id", key, "score", outcome.alias("outcome"))
    gone = out.filter(F.col("outcome").isin("dropped", "stale")).select(key).distinct()
    return out, index_remove(index, gone, key), entries.join(out.filter("outcome = 'stale'").select(key).distinct(), key, "left_anti")


def invalidate(entries: DataFrame, version: str | None = None, now: Column | None = None, section: str | None = None, everything: bool = False) -> DataFrame:
    """entries without those of other versions, those stale by now, those of a section, or without any."""
    gone = F.lit(everything)
    if version is not None:
        gone = gone | (F.coalesce("version", F.lit("")) != version)
    if now is not None:
        gone = gone | ~is_fresh(F.col("created_at"), now, F.col("section"))
    if section is not None:
        gone = gone | (F.col("section") == section)
    return tables.delete_where(entries, gone)


def route(queries: DataFrame, index: DataFrame, entries: DataFrame, key: str, now: Column, version: str, dim: int, answerer) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, index, entries): hits answered from the cache, all others by answerer, and the tables with what may be stored.

    queries are (query_id, query, section, query_vector). answerer takes them and adds answer, abstained, n_citations,
    grounding and risk. Stored entries bear the query's cache key; of queries with one key the last is stored.
    """
    from siltstone.functions import keys

    found, index, entries = lookup(queries, index, entries, key, now, version, dim)
    hits = found.filter("outcome = 'hit'").join(entries.select(key, "answer"), key).select("query_id", "answer", F.lit("cache").alias("source"))
    missed = answerer(queries.join(hits.select("query_id"), "query_id", "left_anti"))
    new = admit(missed).withColumn(key, keys.cache_key(F.col("query"))).withColumn("created_at", now).withColumn("version", F.lit(version))
    stored = tables.upsert(entries, new.select(key, "section", "version", "created_at", "answer", "query_id"), key, keep=("created_at",), order="query_id")
    vectors = new.select(key, F.col("query_vector").alias("vector"), "query_id")
    return hits.unionByName(missed.select("query_id", "answer", F.lit("model").alias("source"))), index_put(index, vectors, key, dim, order="query_id"), stored


def admit(answers: DataFrame) -> DataFrame:
    """answers that may be stored."""
    return answers.filter(cacheable(F.col("abstained"), F.col("n_citations"), F.col("grounding"), F.col("risk")))


def record_hits(cache: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """cache with hit_count and last_used_at moved on by hits (key, at)."""
    n = hits.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("at").alias("_at"))
    return cache.join(n, key, "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("_n", F.lit(0))).withColumn("last_used_at", F.greatest("last_used_at", "_at")).drop("_n", "_at")


def last_turns(turns: DataFrame, session: str, order: str, role: str, body: str, n: int = 6) -> DataFrame:
    """turns with window, the last n turns up to each, oldest first."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(-(n - 1), 0)
    return turns.withColumn("window", F.collect_list(F.struct(role, body)).over(w))


def session_entities(turns: DataFrame, session: str, order: str, body: str, kinds: Mapping[str, rules.Rules] = rules.ENTITIES) -> DataFrame:
    """turns with a column for each kind of entity: the last one named up to the turn."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = rules.entities(F.col(body), kinds)
    return turns.withColumns({f"entity_{k}": F.last(found[k], ignorenulls=True).over(w) for k in kinds})


def session_ids(given: Column) -> Column:
    """The given id, or a new random one for a blank."""
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.uuid())


def recent(turns: DataFrame, session: str, order: str, role: str, body: str, n: int = 6) -> DataFrame:
    """(session, turns): the last n turns of each session, oldest first. Each task keeps n rows a session before they move."""
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    last = turns.select(session, order, role, body).withColumn("_k", rank).filter(F.col("_k") <= n)
    return last.groupBy(session).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, role, body))), lambda x: F.struct(x[role].alias(role), x[body].alias(body))).alias("turns"))


def session_record(turns: DataFrame, session: str, order: str, fields: Sequence[str]) -> DataFrame:
    """(session, n_turns, fields): of each field the last value that is not null, as appended turns leave it. An aggregate, so a long session is summed before it moves."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields]
    return turns.groupBy(session).agg(F.count(F.lit(1)).alias("n_turns"), *last)


def get_or_create(sessions: DataFrame, wanted: DataFrame, session: str) -> DataFrame:
    """The records of the wanted sessions; `created` says which are new, with no turns and no values."""
    rows = wanted.select(session).distinct().join(sessions.withColumn("_known", F.lit(True)), session, "left")
    return rows.withColumn("created", F.col("_known").isNull()).withColumn("n_turns", F.coalesce("n_turns", F.lit(0))).drop("_known")


def reset(sessions: DataFrame, gone: DataFrame, session: str) -> DataFrame:
    """sessions without those that are reset."""
    return sessions.join(gone.select(session).distinct(), session, "left_anti")


def rewrite_prompt(turns: Column, query: Column, role: str, body: str, n: int = 4, most: int = 200) -> Column:
    """What a rewriter is asked: the last n turns, each cut to `most` characters, and the query."""
    from_ = F.greatest(F.lit(1), F.size(turns) - n + 1)
    lines = F.transform(F.slice(turns, from_, n), lambda t: F.concat_ws(": ", t[role], F.substring(text.text(t[body]), 1, most)))
    return F.concat(F.array_join(lines, "\n"), F.lit("\nQuestion: "), text.text(query))


def rewritten(query: Column, said: Column, sane: Column) -> Column:
    """The rewriter's words if they are sane; the query if they are not, blank, or null, as an error leaves them."""
    return F.when((F.trim(text.text(said)) != "") & sane, F.trim(said)).otherwise(query)


def cache_stats_by_section(lookups: DataFrame, outcome: str, section: str) -> DataFrame:
    """lookups, hits, misses and hit rate of each section."""
    hit = (F.col(outcome) == "hit").cast("long")
    return lookups.groupBy(section).agg(F.count(F.lit(1)).alias("lookups"), F.sum(hit).alias("hits"), F.sum(1 - hit).alias("misses"), F.round(F.avg(hit.cast("double")), 4).alias("hit_rate"))


def cache_stats(lookups: DataFrame, outcome: str) -> DataFrame:
    hit = (F.col(outcome) == "hit").cast("long")
    return lookups.agg(F.count(F.lit(1)).alias("lookups"), F.sum(hit).alias("hits"), F.round(F.avg(hit.cast("double")), 4).alias("hit_rate"))

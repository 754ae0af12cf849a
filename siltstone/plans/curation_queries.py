"""Queries on classification, validation, chunks, components, embeddings, cache and sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import html, keys, rules, text
from siltstone.operators import answer, chunking, components, embed, metrics, state, validate
from siltstone.sources import tables
from siltstone.sources.tables import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", html.first_tag(F.col("html"), "title").alias("title"), html.headings(F.col("html")).alias("headings"), html.strip_tags(F.col("html")).alias("body"))


def cls_page_type(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", rules.page_type(F.col("url"), F.col("title"), F.col("headings"), F.col("body")).alias("c")).select("page_id", F.col("c.type").alias("page_type"), F.col("c.confidence").alias("confidence"))


def cls_keyword_vote(spark: SparkSession, d: str) -> DataFrame:
    v = rules.vote(F.substring(text.text(F.col("text")), 1, 2000))
    return table(spark, d, "documents").select("doc_id", v["name"].alias("name"), v["confidence"].alias("confidence"))


def cls_section_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rules.section_type(F.lit(""), F.col("text")).alias("section_type"))


def cls_content_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rules.content_type(F.col("text"), F.col("source")).alias("content_type"))


def cls_quality_flags(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("h", keys.content_hash(F.col("text")))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    flags = rules.quality_flags(F.col("text"), F.size(text.tokens(F.col("text"))), F.lit(0.4), F.when(F.col("lang") == "en", 0.7).otherwise(0.5), F.col("first") != F.col("doc_id"), F.lit(True))
    return docs.join(first, "h").select("doc_id", F.array_join(flags, ",").alias("flags"))


def cls_intent_route(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").withColumn("intent", rules.route(F.col("text")))
    return turns.select("conv_id", "turn", "intent", F.array_join(rules.matched_terms(F.col("text"), F.col("intent")), ",").alias("terms"))


def cls_aggregator(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rules.is_aggregator(F.lit(""), F.col("text")).alias("aggregator"), rules.is_atomic(F.col("text")).alias("atomic"))


def cls_topic(spark: SparkSession, d: str) -> DataFrame:
    p = components.explode_paragraphs(table(spark, d, "documents"), "doc_id").withColumn("topic", rules.topic(F.col("paragraph")))
    return p.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def flt_validation_issues(spark: SparkSession, d: str) -> DataFrame:
    i = validate.issues(F.col("url"), F.col("title"), F.col("body"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.size("headings"))
    rows = _pages(spark, d).withColumn("issues", i)
    good, bad = validate.split_failures(rows)
    both = good.withColumn("failed", F.lit(False)).unionByName(bad.withColumn("failed", F.lit(True)))
    return both.select("page_id", F.array_join(F.transform("issues", lambda x: F.concat_ws("_", x["field"], x["severity"])), ",").alias("issues"), "failed")


def flt_quality_warnings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.array_join(validate.quality_warnings(html.strip_tags(F.col("html")), html.multi_article(F.col("html"))), ",").alias("warnings"))


def flt_chunk_reject(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select(F.explode(F.split(text.text(F.col("text")), "\n")).alias("x"))
    return lines.select(F.coalesce(validate.chunk_reject(F.col("x")), F.lit("kept")).alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _normalized(spark: SparkSession, d: str) -> DataFrame:
    return components.normalize_chunks(table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id", "lang", "text")


def flt_embedding_eligible(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark, d).select("doc_id", "skip_reason", F.array_join("flags", ",").alias("flags"))


def flt_followup(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").withColumn("prior", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    return turns.select("conv_id", "turn", validate.is_followup(F.col("text"), F.col("prior")).alias("followup"))


def chk_group_faq(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(text.text(F.col("text")), r"(?<=[.?!])\s+")).alias("pos", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"\.$", F.when(F.col("pos") % 7 == 3, "?").otherwise(".")))
    g = chunking.faq_groups(lines, "doc_id", "pos", "line")
    return g.select("doc_id", F.col("group").cast("long").alias("grp"), "n_lines", F.md5("text").alias("digest"))


def chk_pack_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.pack(text.paragraphs(F.col("text")), 200)).alias("g", "c"))
    return p.select("doc_id", F.col("g").cast("long").alias("g"), F.col("c.tokens").cast("long").alias("tokens"), F.md5("c.text").alias("digest"))


def chk_token_split(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, d, "documents"))


def chk_contextualize(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.contextualize(F.col("text"), F.col("source"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", F.md5(c).alias("digest"), F.round(chunking.source_quality(F.col("doc_id") % 7, F.col("doc_id") % 3), 4).alias("quality"))


def cmp_paragraph_registry(spark: SparkSession, d: str) -> DataFrame:
    p = components.explode_paragraphs(table(spark, d, "documents"), "doc_id")
    return components.registry(p, "doc_id").select("fp", "n_docs", F.md5("sample").alias("sample"), "component")


def cmp_component_share(spark: SparkSession, d: str) -> DataFrame:
    p = components.explode_paragraphs(table(spark, d, "documents"), "doc_id")
    a = components.assess(p, components.registry(p, "doc_id"), "doc_id")
    return a.select("doc_id", "component_share", "is_reusable", "dominant", F.array_join("types", ",").alias("types"))


def cmp_mixed_topic(spark: SparkSession, d: str) -> DataFrame:
    p = components.explode_paragraphs(table(spark, d, "documents"), "doc_id")
    return components.topics(p, "doc_id").select("doc_id", "mixed", F.array_join("dominant_topics", ",").alias("topics"))


def cmp_contamination(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark, d).select("doc_id", F.array_join("contamination", ",").alias("contamination"))


def cmp_section_path(spark: SparkSession, d: str) -> DataFrame:
    path = components.section_path(F.lit("Pages"), F.lit("General"), F.col("title"), F.get("headings", F.lit(0)), F.get("headings", F.lit(1)))
    return _pages(spark, d).select("page_id", F.array_join(path, " > ").alias("path"))


def cmp_priority(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark, d).select("doc_id", "priority")


def agg_ingest_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows, duplicates by content, failures and what is left, which add up."""
    pages = _pages(spark, d).withColumn("h", keys.content_hash(F.col("body")))
    first = pages.groupBy("h").agg(F.min("page_id").alias("first"))
    bad = F.exists(validate.issues(F.col("url"), F.col("title"), F.col("body"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.size("headings")), lambda x: x["severity"] == "error")
    rows = pages.join(first, "h").withColumn("outcome", F.when(F.col("first") != F.col("page_id"), "duplicate").when(bad, "failed").otherwise("processed"))
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("body")), 4).alias("mean_chars"))


def agg_chunk_report(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select("lang", F.explode(chunking.pack(text.paragraphs(F.col("text")), 200)).alias("c"))
    return p.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c.tokens"), 4).alias("mean"), F.max("c.tokens").cast("long").alias("largest"), F.min("c.tokens").cast("long").alias("smallest"))


def agg_distribution(spark: SparkSession, d: str) -> DataFrame:
    return metrics.distribution(table(spark, d, "documents"), "source")


def emb_manifest(spark: SparkSession, d: str) -> DataFrame:
    return embed.manifest(_normalized(spark, d))


def emb_run(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").select(keys.content_hash(F.col("text")).alias("hash"), "text")
    known = table(spark, d, "documents").filter("doc_id % 2 = 0").select(keys.content_hash(F.col("text")).alias("hash"), "text").groupBy("hash").agg(F.min("text").alias("text")).select("hash", embed.embed(F.col("text")).alias("vector"))
    return embed.embed_missing(chunks, known).select("hash", F.size("vector").alias("dim"))





def cac_ttl_fresh(spark: SparkSession, d: str) -> DataFrame:
    now = table(spark, d, "events").agg(F.max("ts").alias("now"))
    rows = table(spark, d, "events").join(F.broadcast(now))
    return rows.select("event_id", state.ttl(F.col("event_type")).alias("ttl_days"), state.is_fresh(F.col("ts"), F.col("now"), F.col("event_type")).alias("fresh"))


def cac_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user put over the users' first half; created_at stays that of the older row."""
    e = table(spark, d, "events").select(F.col("user_id").alias("cache_key"), F.col("event_type").alias("section"), F.col("value").alias("score"), "event_id")
    old = e.filter("event_id % 2 = 0").groupBy("cache_key").agg(F.max_by(F.struct("section", "score", "event_id"), "event_id").alias("r")).select("cache_key", "r.section", "r.score", F.col("r.event_id").alias("created_at"))
    new = e.filter("event_id % 2 = 1").select("cache_key", "section", "score", F.col("event_id").alias("created_at"))
    return tables.upsert(old, new, "cache_key", keep=("created_at",), order="created_at")


def cac_delete(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    left = tables.delete_where(e, F.col("event_type") == "click", F.col("value") < 50)
    return left.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def cac_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    out = state.lookup_outcome(F.col("value") / 100.0, F.col("event_id") % 11 != 0, F.col("event_id") % 7 != 0, F.col("event_id") % 5 != 0)
    return e.select("event_id", out.alias("outcome"))


def cac_stats(spark: SparkSession, d: str) -> DataFrame:
    return state.cache_stats(cac_lookup(spark, d), "outcome")


def ses_last_turns(spark: SparkSession, d: str) -> DataFrame:
    t = state.last_turns(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return t.select("conv_id", "turn", F.size("window").cast("long").alias("n"), F.md5(F.array_join(F.transform("window", lambda x: F.concat_ws(":", x["role"], x["text"])), "|")).alias("digest"))


def ses_entities(spark: SparkSession, d: str) -> DataFrame:
    return state.session_entities(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "entity_topic", "entity_lang")


def ses_augment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(answer.augment(F.col("text"), rules.entities(F.col("text")))).alias("digest"), answer.rewrite_is_sane(F.col("text"), F.substring(F.col("text"), 1, 60)).alias("sane"))


QUERIES = {f.__name__: f for f in (cls_page_type, cls_keyword_vote, cls_section_type, cls_content_type, cls_quality_flags, cls_intent_route, cls_aggregator, cls_topic, flt_validation_issues, flt_quality_warnings, flt_chunk_reject, flt_embedding_eligible, flt_followup, chk_group_faq, chk_pack_paragraphs, chk_token_split, chk_contextualize, cmp_paragraph_registry, cmp_component_share, cmp_mixed_topic, cmp_contamination, cmp_section_path, cmp_priority, agg_ingest_report, agg_chunk_report, agg_distribution, emb_manifest, emb_run, cac_ttl_fresh, cac_upsert, cac_delete, cac_lookup, cac_stats, ses_last_turns, ses_entities, ses_augment)}

# --- SQL ------------------------------------------------------------------------------------------------------

from siltstone.plans.text_queries import _PARAS, _STRIP, FLAT  # noqa: E402


def _w(p: str) -> str:
    return f"(^|[^a-z0-9])({p})($|[^a-z0-9])"


def _m(c: str, p: str) -> str:
    return f"regexp_matches({c}, '{p}')"


def _case(c: str, table_: rules.Rules, lower: bool = False) -> str:
    return "CASE " + " ".join(f"WHEN {_m(c, p)} THEN '{n.lower() if lower else n}'" for n, p in table_) + " END"


_PG = rf"pg AS (SELECT page_id, url, {_STRIP.format("regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1)")} AS title, list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda r: {_STRIP.format('r')}), lambda h: h <> '') AS headings, {_STRIP.format('html')} AS body, len(regexp_extract_all(html, '(?i)<(article|h1)[\s>]')) > 2 AS multi FROM pages)".replace("\\\\s", "\\s")
_VN = ", ".join(f"{{'n': {' + '.join(f'contains(lower({{c}}), $${w}$$)::INT' for w in ws)}, 'o': -{i}, 'name': '{name}'}}" for i, (name, ws) in enumerate(rules.VOTES.items()))
_VN = _VN.replace("{c}", "@C@").replace("{{", "{").replace("}}", "}")


def _vote(c: str) -> str:
    return f"list_max([{_VN.replace('@C@', c)}])"


_CONF = "round(least(0.7::DOUBLE, 0.6::DOUBLE + 0.05::DOUBLE * ({0}.n - 2)), 4)"
_PAR = f"""pa AS (SELECT doc_id, unnest({_PARAS}) AS paragraph, generate_subscripts({_PARAS}, 1) - 1 AS pos FROM documents),
pf AS (SELECT *, sha1({FLAT.format('paragraph')}) AS fp FROM pa)"""


def _preserved(c: str) -> str:
    return "(" + " OR ".join(_m(f"lower({c})", p) for p in rules.PRESERVED) + ")"


_REG = f"""{_PAR},
on1 AS (SELECT fp, doc_id, arg_min(paragraph, pos) AS paragraph FROM pf GROUP BY fp, doc_id),
rg0 AS (SELECT fp, count(*) AS n_docs, arg_min(paragraph, doc_id) AS sample FROM on1 GROUP BY fp HAVING count(*) >= 5),
rg AS (SELECT fp, n_docs, sample, CASE WHEN NOT {_preserved('sample')} THEN coalesce({_case('lower(sample)', rules.COMPONENTS)}, 'boilerplate') END AS component FROM rg0)"""
_ASSESS = f"""{_REG},
bt AS (SELECT doc_id, component, sum(length(paragraph)) AS n, min(pos) AS first, max({_preserved('paragraph')}::INT) AS pres FROM pf LEFT JOIN rg USING (fp) GROUP BY doc_id, component),
az AS (SELECT doc_id, round((coalesce(sum(n) FILTER (WHERE component IS NOT NULL), 0))::DOUBLE / sum(n), 4) AS component_share, max(pres) AS pres, list_sort(list_filter(list(DISTINCT component), lambda c: c IS NOT NULL)) AS types,
  (array_agg(component ORDER BY n DESC, first) FILTER (WHERE component IS NOT NULL))[1] AS dominant FROM bt GROUP BY doc_id),
ay AS (SELECT *, component_share >= 0.5 AND pres = 0 AS is_reusable FROM az)"""
_TOPICS = f"""tp0 AS (SELECT doc_id, topic, count(*) AS n, min(pos) AS first FROM (SELECT doc_id, pos, coalesce({_case('lower(substr(paragraph, 1, 500))', rules.TOPICS)}, 'general') AS topic FROM pf) GROUP BY doc_id, topic),
tp1 AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM tp0),
tp AS (SELECT doc_id, max(total) AS total, coalesce(array_agg(topic ORDER BY n DESC, first, topic) FILTER (WHERE topic <> 'general' AND n >= 0.3 * total), []) AS topics FROM tp1 GROUP BY doc_id)"""
_TC = "len(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]'))".replace("{{", "{").replace("}}", "}")
_OCC = lambda c, ps: "(" + " + ".join(f"len(regexp_extract_all({c}, '{p}'))" for p in ps) + ")"
_HITS = lambda c, ps: "(" + " + ".join(f"{_m(c, p)}::INT" for p in ps) + ")"


def _flags(tok: str, score: str, conf: str, dup: str) -> str:
    low = "lower(coalesce(text, ''))"
    marks = [(f"{tok} < 60", "low_content"), (f"{tok} >= 60 AND {tok} < 150 AND {score} < 0.5", "thin_content"), (f"{conf} < 0.6", "weak_classification"), (f"{_OCC(low, rules.CTA)} / greatest({tok} / 100.0, 1.0) >= 1.5", "cta_heavy"), (f"{_HITS(low, rules.BOILERPLATE)} >= 2", "boilerplate_heavy"), (f"{_HITS(low, rules.EVENT)} >= 3", "event_heavy"), (dup, "duplicate")]
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in marks) + "], lambda x: x IS NOT NULL)"


_NORM = f"""{_ASSESS}, {_TOPICS},
nm0 AS (SELECT d.doc_id, lang, text, coalesce(ay.types, []) AS types, coalesce(is_reusable, false) AS is_reusable, coalesce(topics, []) AS topics, {_TC} AS tok, min(d.doc_id) OVER (PARTITION BY sha256({FLAT.format('text')})) <> d.doc_id AS dup FROM documents d LEFT JOIN ay ON ay.doc_id = d.doc_id LEFT JOIN tp ON tp.doc_id = d.doc_id),
nm AS (SELECT *, list_distinct_keep(list_concat(list_filter(types, lambda x: x IN ('credentials', 'promotion')), list_transform(list_filter(topics, lambda x: NOT list_contains(CASE lang WHEN 'en' THEN ['english', 'legal'] WHEN 'fr' THEN ['french'] WHEN 'de' THEN ['german'] WHEN 'es' THEN ['spanish'] ELSE topics END, x)), lambda x: 'off_topic:' || x))) AS contamination, {_flags('tok', '0.5', '0.7', 'dup')} AS flags FROM nm0),
nn AS (SELECT *, CASE WHEN is_reusable THEN 'reusable_component' WHEN len(contamination) > 0 THEN 'contaminated' WHEN list_contains(flags, 'cta_heavy') THEN 'cta_heavy' WHEN list_contains(flags, 'boilerplate_heavy') THEN 'boilerplate_heavy' END AS skip_reason FROM nm)""".replace("list_distinct_keep(", "(")
_PACK = f"""gp AS (SELECT doc_id, list_reduce(list_transform({_PARAS}, lambda p: {{'out': []::STRUCT(text VARCHAR, tokens BIGINT)[], 'text': p, 'tokens': len(regexp_extract_all(p, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]'))}}), lambda a, b: CASE WHEN a.tokens + b.tokens <= 200 THEN {{'out': a.out, 'text': a.text || chr(10) || b.text, 'tokens': a.tokens + b.tokens}} ELSE {{'out': list_append(a.out, {{'text': a.text, 'tokens': a.tokens}}), 'text': b.text, 'tokens': b.tokens}} END) AS r, lang FROM documents WHERE len({_PARAS}) > 0),
gs AS (SELECT doc_id, lang, list_append(r.out, {{'text': r.text, 'tokens': r.tokens}}) AS g FROM gp)"""
_BAD_PAGE = "(NOT regexp_matches(url, '^https?://[^/]+') OR length(trim(title)) < 6)"

ORACLES = {
    "cls_page_type": f"WITH {_PG}, x AS (SELECT page_id, {_case('lower(url)', rules.URL_RULES)} AS u, {_case('lower(title)', rules.TITLE_RULES)} AS t, {_case("lower(array_to_string(list_slice(headings, 1, 8), ' '))", rules.HEADING_RULES)} AS h, regexp_matches(url, '^[a-z]+://[^/]+/?$') AS root, {_vote('substr(body, 1, 2000)')} AS v FROM pg) SELECT page_id, CASE WHEN u IS NOT NULL THEN u WHEN t IS NOT NULL THEN t WHEN h IS NOT NULL THEN h WHEN root THEN 'Home' WHEN v.n >= 2 THEN v.name ELSE 'General' END AS page_type, CASE WHEN u IS NOT NULL THEN 0.95::DOUBLE WHEN t IS NOT NULL THEN 0.8::DOUBLE WHEN h IS NOT NULL THEN 0.7::DOUBLE WHEN root THEN 0.9::DOUBLE WHEN v.n >= 2 THEN {_CONF.format('v')} ELSE 0.3::DOUBLE END AS confidence FROM x",
    "cls_keyword_vote": f"WITH x AS (SELECT doc_id, {_vote("substr(coalesce(text, ''), 1, 2000)")} AS v FROM documents) SELECT doc_id, CASE WHEN v.n >= 2 THEN v.name END AS name, CASE WHEN v.n >= 2 THEN {_CONF.format('v')} END AS confidence FROM x",
    "cls_section_type": f"WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents) SELECT doc_id, CASE WHEN len(regexp_extract_all(low, '\\?')) >= 2 THEN 'faq' WHEN len(regexp_extract_all(low, '[0-9]{{2,}}')) >= 4 THEN 'statistics' WHEN contains(low, ' | ') THEN 'table' ELSE coalesce({_case('low', rules.BODY_RULES, True)}, 'overview') END AS section_type FROM x",
    "cls_content_type": f"WITH x AS (SELECT doc_id, source, lower(substr(coalesce(text, ''), 1, 1200)) AS low FROM documents) SELECT doc_id, CASE WHEN contains(low, '?') THEN 'faq' WHEN source IN ('src0', 'src1') THEN 'reference' ELSE coalesce({_case('low', rules.BODY_RULES, True)}, 'prose') END AS content_type FROM x",
    "cls_quality_flags": f"WITH x AS (SELECT doc_id, lang, text, len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}&.+\\-]*')) AS tok, min(doc_id) OVER (PARTITION BY sha256({FLAT.format('text')})) <> doc_id AS dup FROM documents) SELECT doc_id, array_to_string({_flags('tok', '0.4', "(CASE WHEN lang = 'en' THEN 0.7 ELSE 0.5 END)", 'dup')}, ',') AS flags FROM x",
    "cls_topic": f"WITH {_PAR}, t AS (SELECT doc_id, coalesce({_case('lower(substr(paragraph, 1, 500))', rules.TOPICS)}, 'general') AS topic FROM pf) SELECT topic, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY topic",
    "cls_aggregator": r"SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda p: length(trim(p)) >= 30 AND regexp_matches(trim(p), '^[A-Z][a-z]+ [A-Z]'))) >= 8 AS aggregator, regexp_matches(coalesce(text, ''), '[|\t]') OR len(regexp_extract_all(coalesce(text, ''), '(?m)^[ ]*[-*•] ')) >= 2 OR regexp_matches(coalesce(text, ''), '(?im)^(q|question)[:.]') AS atomic FROM documents",
    "flt_validation_issues": f"WITH {_PG} SELECT page_id, array_to_string(list_filter([CASE WHEN NOT regexp_matches(url, '^https?://[^/]+') THEN 'url_error' END, CASE WHEN length(trim(title)) < 6 THEN 'title_error' END, CASE WHEN length(body) < 300 THEN 'content_warning' END, CASE WHEN len(headings) = 0 THEN 'sections_warning' END], lambda x: x IS NOT NULL), ',') AS issues, {_BAD_PAGE} AS failed FROM pg",
    "flt_quality_warnings": f"WITH {_PG}, x AS (SELECT *, lower(substr(body, 1, 500)) AS head FROM pg) SELECT page_id, array_to_string(list_sort(list_filter([CASE WHEN length(body) < 300 THEN 'short_content' END, CASE WHEN contains(head, 'index of') OR contains(head, 'parent directory') OR regexp_matches(head, 'last modified.*size') THEN 'directory_listing' END, CASE WHEN multi THEN 'multi_article' END], lambda x: x IS NOT NULL)), ',') AS warnings FROM x",
    "flt_chunk_reject": f"WITH l AS (SELECT trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS t FROM documents), o AS (SELECT CASE WHEN t = '' THEN 'blank' WHEN length(t) <= 160 AND ({' OR '.join(_m('lower(t)', p) for p in rules.BOILERPLATE)}) THEN 'boilerplate' WHEN regexp_matches(t, '^[0-9\\p{{P}}\\s]+$') THEN 'fragment' WHEN length(t) < 20 AND regexp_matches(lower(t), '^(the|a|an|and|or|of|in|to|for)([^a-z]|$)') THEN 'fragment' ELSE 'kept' END AS outcome FROM l) SELECT outcome, count(*) AS n FROM o GROUP BY outcome",
    "flt_embedding_eligible": f"WITH {_NORM} SELECT doc_id, skip_reason, array_to_string(flags, ',') AS flags FROM nn",
    "flt_followup": f"SELECT conv_id, turn, ({' OR '.join(_m('lower(text)', p) for p in rules.FOLLOWUPS)}) AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 AS followup FROM conversations",
    "chk_pack_paragraphs": f"WITH {_PACK}, u AS (SELECT doc_id, unnest(g) AS c, generate_subscripts(g, 1) - 1 AS g FROM gs) SELECT doc_id, g, c.tokens AS tokens, md5(c.text) AS digest FROM u",
    "chk_contextualize": f"SELECT doc_id, md5(CASE WHEN {_TC} < 40 THEN source || chr(10) || lang || chr(10) || text ELSE text END) AS digest, round(1 - least(0.4::DOUBLE, 0.08::DOUBLE * (doc_id % 7)) - least(0.3::DOUBLE, 0.05::DOUBLE * (doc_id % 3)), 4) AS quality FROM documents",
    "cmp_paragraph_registry": f"WITH {_REG} SELECT fp, n_docs, md5(sample) AS sample, component FROM rg",
    "cmp_component_share": f"WITH {_ASSESS} SELECT doc_id, component_share, is_reusable, dominant, array_to_string(types, ',') AS types FROM ay",
    "cmp_mixed_topic": f"WITH {_PAR}, {_TOPICS} SELECT doc_id, total >= 2 AND len(topics) >= 2 AS mixed, array_to_string(topics, ',') AS topics FROM tp",
    "cmp_contamination": f"WITH {_NORM} SELECT doc_id, array_to_string(contamination, ',') AS contamination FROM nn",
    "cmp_section_path": f"WITH {_PG}, p AS (SELECT page_id, list_filter(['Pages', 'General', title, headings[1], headings[2]], lambda x: x IS NOT NULL AND len(list_filter(string_split(lower(trim(x)), ' '), lambda w: w NOT IN ('overview', 'introduction', 'about', 'details', 'more', 'contents', 'summary', 'information', 'general', 'notes', 'other', 'home'))) > 0) AS l FROM pg) SELECT page_id, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), ' > ') AS path FROM p",
    "cmp_priority": f"WITH {_NORM} SELECT doc_id, round(greatest(0, least(1, CASE lang WHEN 'en' THEN 1.0::DOUBLE WHEN 'fr' THEN 0.8::DOUBLE WHEN 'de' THEN 0.6::DOUBLE WHEN 'es' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END * (0.7::DOUBLE + 0.3::DOUBLE * 0.7::DOUBLE) * (0.7::DOUBLE + 0.3::DOUBLE * 0.5::DOUBLE) - coalesce(list_sum(list_transform(flags, lambda f: CASE f WHEN 'low_content' THEN 0.3::DOUBLE WHEN 'thin_content' THEN 0.2::DOUBLE WHEN 'weak_classification' THEN 0.1::DOUBLE WHEN 'cta_heavy' THEN 0.3::DOUBLE WHEN 'boilerplate_heavy' THEN 0.4::DOUBLE WHEN 'event_heavy' THEN 0.1::DOUBLE WHEN 'duplicate' THEN 0.5::DOUBLE ELSE 0::DOUBLE END)), 0))) + 1e-9, 3) AS priority FROM nn",
    "agg_ingest_report": f"WITH {_PG}, x AS (SELECT *, min(page_id) OVER (PARTITION BY sha256({FLAT.format('body')})) AS first FROM pg), o AS (SELECT CASE WHEN first <> page_id THEN 'duplicate' WHEN {_BAD_PAGE} THEN 'failed' ELSE 'processed' END AS outcome, length(body) AS n FROM x) SELECT outcome, count(*) AS n, round(avg(n), 4) AS mean_chars FROM o GROUP BY outcome",
    "agg_chunk_report": f"WITH {_PACK}, u AS (SELECT lang, unnest(g) AS c FROM gs) SELECT lang, count(*) AS n, round(avg(c.tokens), 4) AS mean, max(c.tokens)::BIGINT AS largest, min(c.tokens)::BIGINT AS smallest FROM u GROUP BY lang",
    "agg_distribution": "SELECT source, count(*) AS n FROM documents GROUP BY source",
    "emb_manifest": f"WITH {_NORM} SELECT count(*) FILTER (WHERE skip_reason IS NULL) AS embedded, count(*) FILTER (WHERE skip_reason = 'reusable_component') AS reusable_component, count(*) FILTER (WHERE skip_reason = 'contaminated') AS contaminated, count(*) FILTER (WHERE skip_reason = 'cta_heavy') AS cta_heavy, count(*) FILTER (WHERE skip_reason = 'boilerplate_heavy') AS boilerplate_heavy FROM nn",
    "cac_ttl_fresh": "WITH n AS (SELECT max(ts) AS now FROM events), t AS (SELECT event_id, ts, CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 7 WHEN 'purchase' THEN 30 WHEN 'signup' THEN 90 ELSE 14 END AS ttl_days FROM events) SELECT event_id, ttl_days, floor(epoch(now)) - floor(epoch(ts)) <= ttl_days * 86400 AS fresh FROM t, n",
    "cac_upsert": "WITH o AS (SELECT user_id AS cache_key, arg_max(event_type, event_id) AS section, arg_max(value, event_id) AS score, max(event_id) AS created_at FROM events WHERE event_id % 2 = 0 GROUP BY user_id), n AS (SELECT user_id AS cache_key, arg_max(event_type, event_id) AS section, arg_max(value, event_id) AS score, max(event_id) AS created_at FROM events WHERE event_id % 2 = 1 GROUP BY user_id) SELECT coalesce(o.cache_key, n.cache_key) AS cache_key, CASE WHEN n.cache_key IS NOT NULL THEN n.section ELSE o.section END AS section, CASE WHEN n.cache_key IS NOT NULL THEN n.score ELSE o.score END AS score, coalesce(o.created_at, n.created_at) AS created_at FROM o FULL JOIN n ON o.cache_key = n.cache_key",
    "cac_delete": "SELECT event_type, count(*) AS n FROM events WHERE NOT coalesce(event_type = 'click' AND value < 50, false) GROUP BY event_type",
    "cac_lookup": "SELECT event_id, CASE WHEN value IS NULL OR value / 100.0::DOUBLE < 0.88 THEN 'miss' WHEN event_id % 11 = 0 THEN 'dropped' WHEN event_id % 7 = 0 THEN 'stale' WHEN event_id % 5 = 0 THEN 'invalid' ELSE 'hit' END AS outcome FROM events",
    "cac_stats": "WITH x AS (SELECT NOT (value IS NULL OR value / 100.0::DOUBLE < 0.88 OR event_id % 11 = 0 OR event_id % 7 = 0 OR event_id % 5 = 0) AS hit FROM events) SELECT count(*) AS lookups, count(*) FILTER (WHERE hit) AS hits, round(avg(hit::INT), 4) AS hit_rate FROM x",
    "ses_last_turns": "WITH w AS (SELECT conv_id, turn, list(role || ':' || text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS w FROM conversations) SELECT conv_id, turn, len(w)::BIGINT AS n, md5(array_to_string(w, '|')) AS digest FROM w",
    "ses_entities": f"WITH e AS (SELECT conv_id, turn, {_case('lower(text)', rules.ENTITIES['topic'])} AS t, {_case('lower(text)', rules.ENTITIES['lang'])} AS l FROM conversations) SELECT conv_id, turn, last_value(t IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS entity_topic, last_value(l IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS entity_lang FROM e",
}

_TERMS = "list_transform(regexp_extract_all(lower(text), '{0}'), lambda x: trim(x))"
ORACLES["cls_intent_route"] = (
    "WITH r AS (SELECT conv_id, turn, text, coalesce(" + _case("lower(text)", rules.INTENTS) + ", 'general_query') AS intent FROM conversations), t AS (SELECT *, CASE intent "
    + " ".join(f"WHEN '{n}' THEN {_TERMS.format(p)}" for n, p in rules.INTENTS)
    + " ELSE [] END AS l FROM r) SELECT conv_id, turn, intent, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS terms FROM t"
)
_LINES = r"list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.?!])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: true)"
ORACLES["chk_group_faq"] = (
    f"WITH l AS (SELECT doc_id, unnest({_LINES}) AS x, generate_subscripts({_LINES}, 1) - 1 AS pos FROM documents), m AS (SELECT doc_id, pos, CASE WHEN pos % 7 = 3 THEN regexp_replace(x, '\\.$', '?') ELSE x END AS x FROM l), "
    "g AS (SELECT *, sum((regexp_matches(x, '\\?[ \\t]*$') OR regexp_matches(x, '^(?i)(q|question)[:.]'))::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM m) "
    "SELECT doc_id, grp::BIGINT AS grp, count(*) AS n_lines, md5(string_agg(x, chr(10) ORDER BY pos)) AS digest FROM g GROUP BY doc_id, grp"
)
_ENT = "list_filter([" + _case("lower(text)", rules.ENTITIES["topic"]) + ", " + _case("lower(text)", rules.ENTITIES["lang"]) + "], lambda v: v IS NOT NULL AND NOT contains(lower(text), v))"
_WORDS = "len(list_filter(regexp_split_to_array({0}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))"
ORACLES["ses_augment"] = f"SELECT conv_id, turn, md5(text || ' ' || array_to_string({_ENT}, ' ')) AS digest, {_WORDS.format('substr(text, 1, 60)')} >= greatest(2, ceil(0.6::DOUBLE * {_WORDS.format('text')})) AS sane FROM conversations"
ORACLES["emb_run"] = f"SELECT DISTINCT sha256({FLAT.format('text')}) AS hash, 384 AS dim FROM documents"

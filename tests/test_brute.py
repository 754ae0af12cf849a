"""Queries that SQL does not express, against plain Python over the same rows."""

import random
import unicodedata
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from siltstone.functions import keys, text
from siltstone.operators import dedup, retrieval
from siltstone.plans import catalog, retrieval_queries
from siltstone.sources import tables

DATA = "/root/testdata/sf0.001"


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def alike(a, b):
    """Token-set similarity in per cent, from the definition."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, one, two = (sorted(s) for s in (x & y, x - y, y - x))
    if shared and not (one and two):
        return 100.0
    texts = [" ".join(shared), " ".join(shared + one), " ".join(shared + two)]
    pairs = [(1, 2)] + ([(0, 1), (0, 2)] if shared else [])
    return max(200.0 * common(texts[i], texts[j]) / (len(texts[i]) + len(texts[j])) for i, j in pairs)


def test_near_duplicates_equal_brute_force(spark):
    """Copies with one and with three words of their own, subsets, and texts of frequent words."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(60)]
    base, rows = [r.choice(words) for _ in range(45)], []
    for i in range(160):
        kind = i % 10
        own = base + [f"o{i}"] if kind < 4 else base + [f"{i}{j}" for j in "xyz"] if kind < 5 else base[: r.randint(1, 44)] if kind < 6 else [r.choice(words) for _ in range(r.randint(0, 3) if kind < 7 else r.randint(3, 30))]
        rows.append((i, " ".join(r.sample(own, len(own)))))
    want = {}
    for k, (i, t) in enumerate(rows):
        want[i] = next((j for j, u in rows[:k] if set(t.split()) == set(u.split()) or alike(t, u) > 95), None)
    got = {x.seq: x.near_duplicate_of for x in dedup.near_duplicate_flags(spark.createDataFrame(rows, "seq long, t string"), "seq", "t").collect()}
    assert got == want and sum(v is not None for v in want.values()) > 60


def test_a_large_group_of_copies_has_one_partner(spark):
    base = " ".join(f"word{i}" for i in range(120))
    rows = spark.range(2000).select(F.col("id").alias("seq"), F.concat(F.lit(base + " own"), "id").alias("t"))
    got = dedup.near_duplicate_flags(rows, "seq", "t").groupBy("near_duplicate_of").count().collect()
    assert {r.near_duplicate_of: r["count"] for r in got} == {None: 1, 0: 1999}


def test_nfkc(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + [(-1, "ﬁne ① ｗｉｄｅ é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", text.normalize(F.col("text"), unicode=True).alias("t")).collect()}
    plain = {r.doc_id: r.t for r in spark.createDataFrame([(i, unicodedata.normalize("NFKC", t)) for i, t in rows], df.schema).select("doc_id", text.normalize(F.col("text")).alias("t")).collect()}
    assert got == plain and got[-1] == "fine 1 wide é"


def test_title_and_url(spark):
    got = catalog.QUERIES["fuz_title_url"](spark, DATA).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", F.lower(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("t"), F.lower(keys.slug_words(F.col("url"))).alias("s")).collect()}
    for r in got:
        assert r.similarity == pytest.approx(alike(" ".join(pages[r.page_id].t.split()), pages[r.page_id].s)) and r.mismatch == (r.similarity < 35)


def test_fuzzy_suppression(spark):
    pool = retrieval_queries._reranked(spark, DATA).select("query_id", "rank", "doc_id", "text").collect()
    got = {(r.query_id, r.doc_id): r.duplicate_of for r in catalog.QUERIES["rrk_fuzzy_dedup"](spark, DATA).filter("query_id < 6").collect()}
    for q in {r.query_id for r in pool if r.query_id < 6}:
        kept = []
        for r in sorted((r for r in pool if r.query_id == q), key=lambda r: r.rank):
            mine = (r.text or "")[:600]
            match = next((k for k, t in kept if alike(mine, t) >= 85), None)
            assert got[q, r.doc_id] == match
            kept += [] if match is not None else [(r.doc_id, mine)]


@pytest.mark.parametrize("terms", [1, retrieval.MAX_TERMS])
def test_bm25_with_terms_sent_or_joined(spark, terms):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, ""), (4, None), (5, "d")], "k long, text string")
    queries = spark.createDataFrame([(7, ["a", "b", "a"]), (8, ["x"]), (9, [])], "query_id long, terms array<string>")
    got = {(r.query_id, r.k): r.bm25 for r in retrieval.bm25(docs, queries, "k", max_terms=terms).collect()}
    assert set(got) == {(7, 1), (7, 2)} and got[7, 1] > got[7, 2]


def test_dense_search_in_blocks_equals_one(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet")
    q = v.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))

    def top(**how):
        return sorted(map(tuple, retrieval.top_k(retrieval.dense(v, q, "vec_id", 5, dim=64, **how), "query_id", [F.desc("score"), F.asc("vec_id")], 5).select("query_id", "vec_id", "score", "rank").collect()))

    assert top() == top(max_bytes=1024)
    assert retrieval.dense(v, q.limit(0), "vec_id", 5, dim=64).count() == 0 and retrieval.dense(v.limit(0), q, "vec_id", 5, dim=64).count() == 0


def test_a_swap_that_was_cut_off_is_mended(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    (tmp_path / "t").rename(tmp_path / "t.old")
    tables.recover(spark, path)
    assert spark.read.parquet(path).count() == 5
    tables.swap_in(spark.read.parquet(path).filter("id > 2"), path)
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "t.old").exists()
    assert tables.create_cache(spark, str(tmp_path / "c")).count() == 0 and tables.create_cache(spark, str(tmp_path / "c")).columns[0] == "cache_key"


def test_a_cluster_without_a_shared_folder_is_an_error():
    conf = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_base(cluster)

import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import fuzzy
from siltstone.operators import answer, chunking, components, dedup, embed, rerank, retrieval, state, validate
from siltstone.sources import tables
from siltstone.streaming import sessions


def sequential(rows):
    one, two, out = set(), set(), {}
    for seq, a, b in rows:
        if a in one or b in two:
            out[seq] = "dropped"
        else:
            one.add(a)
            two.add(b)
            out[seq] = "kept"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_two_key_dedup_equals_the_sequential_rule(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.randrange(8), r.randrange(8)) for i in range(30)]
    got = dedup.sequential_two_key(spark.createDataFrame(rows, "seq long, a long, b long"), "seq", "a", "b").collect()
    assert {x["seq"]: x["status"] for x in got} == sequential(rows)


def test_near_duplicates_flag_the_earliest(spark):
    base = " ".join(f"word{i}" for i in range(40))
    rows = [(1, base), (2, base.replace("word7 ", "")), (3, "other text entirely here"), (4, base)]
    got = {r["seq"]: r["near_duplicate_of"] for r in dedup.near_duplicate_flags(spark.createDataFrame(rows, "seq long, t string"), "seq", "t").collect()}
    assert got == {1: None, 2: 1, 3: None, 4: 1}


def test_budget_is_greedy_and_passes_over(spark):
    rows = [(1, i, c) for i, c in enumerate([5, 9, 3, 2, 1])]
    got = rerank.budget(spark.createDataFrame(rows, "q long, r long, c long"), "q", [F.asc("r")], "c", 10).orderBy("position").collect()
    assert [r["fits"] for r in got] == [True, False, True, True, False]


def test_caps_use_no_quota_for_rejected_rows(spark):
    rows = [(1, i, s, d) for i, (s, d) in enumerate([("a", "x"), ("a", "y"), ("a", "x"), ("b", "x"), ("b", "x"), ("general", "z"), ("b", "w")])]
    got = rerank.caps(spark.createDataFrame(rows, "q long, r long, s string, d string"), "q", [F.asc("r")], "r", "s", "d", 5).orderBy("position").collect()
    assert [r["status"] for r in got] == ["kept", "kept", "section_type_saturated:a", "kept", "document_saturated", "kept", "kept"]


def test_similar_blocks_name_an_accepted_one(spark):
    rows = [(1, 1, 10, "a b c d e f"), (1, 2, 11, "a b c d e f g"), (1, 3, 12, "x y z"), (1, 4, 13, None)]
    got = rerank.suppress_similar(spark.createDataFrame(rows, "q long, r long, k long, t string"), "q", "r", "k", "t").collect()
    assert {r["k"]: r["duplicate_of"] for r in got} == {10: None, 11: 10, 12: None, 13: None}
    assert fuzzy.token_set("a b c d e f", "a b c d e f g") == 100


def test_fusion_bounds_and_ties(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q long, k string, rank int")
    b = spark.createDataFrame([(1, "z", 1), (1, "y", 2)], "q long, k string, rank int")
    got = retrieval.fuse(a, b, "q", "k").orderBy("rank").collect()
    assert [r["k"] for r in got] == ["y", "x", "z"]
    assert all(r["fusion_score"] <= round(2 / 61, 6) for r in got)


def test_fallback_is_by_query(spark):
    rows = [(1, "a", True), (1, "b", False), (2, "a", False), (2, "b", False)]
    got = retrieval.with_fallback(spark.createDataFrame(rows, "q long, k string, ok boolean"), "q", F.col("ok")).collect()
    assert sorted((r["q"], r["k"], r["fallback"]) for r in got) == [(1, "a", False), (2, "a", True), (2, "b", True)]


def test_chunks_keep_all_words_and_the_limit():
    r = random.Random(4)
    text = "\n".join(" ".join(r.choice("alpha beta gamma delta".split()) for _ in range(r.randrange(1, 400))) + "." for _ in range(40))
    parts = chunking.split_tokens(text)
    assert all(chunking.count_tokens(p) <= chunking.HARD for p in parts)
    assert chunking.split_tokens("") == [] and chunking.split_tokens("short one") == ["short one"]
    words = sum(len(p.split()) for p in parts)
    assert words >= len(text.split())
    merged = chunking.merge_tiny(["a b", "c " * 50, "d"])
    assert merged == ["a b\n" + "c " * 50 + "\nd"]


def test_judge_and_citations(spark):
    row = spark.createDataFrame([('so {"risk": 3, "claims": ["a", " "]} ok',), ("nothing",), (None,)], "s string").select(answer.parse_judge(F.col("s")).alias("j")).collect()
    assert [(r["j"]["risk"], r["j"]["judged"], r["j"]["claims"]) for r in row] == [(1.0, True, ["a"]), (0.0, False, []), (0.0, False, [])]
    c = answer.coverage(spark.createDataFrame([("[2] [2] [9]", 3), ("none", 3)], "a string, n long"), "a", "n").collect()
    assert [(r["cited"], r["coverage"], r["warnings"]) for r in c] == [([2, 9], 0.3333, ["out_of_range"]), ([], 0.0, ["no_citations"])]


def test_cache_upsert_keeps_created_and_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, v long, created long")
    new = spark.createDataFrame([("b", 5, 99), ("c", 6, 99), ("b", 7, 100)], "k string, v long, created long")
    once = tables.upsert(old, new, "k", keep=("created",), order="created")
    assert sorted(map(tuple, once.collect())) == [("a", 1, 10), ("b", 7, 20), ("c", 6, 99)]
    assert sorted(map(tuple, tables.upsert(once, new, "k", keep=("created",), order="created").collect())) == sorted(map(tuple, once.collect()))


def test_delete_where_without_conditions_deletes_nothing(spark):
    df = spark.range(3)
    assert tables.delete_where(df).count() == 3
    assert tables.delete_where(df, F.col("id") > 0, F.col("id") < 2).count() == 2


def test_lookup_outcomes(spark):
    rows = [(None, True, True, True), (0.9, False, True, True), (0.9, True, False, True), (0.9, True, True, False), (0.9, True, True, True)]
    df = spark.createDataFrame(rows, "s double, f boolean, r boolean, v boolean")
    got = [r[0] for r in df.select(state.lookup_outcome(F.col("s"), F.col("f"), F.col("r"), F.col("v"))).collect()]
    assert got == ["miss", "dropped", "stale", "invalid", "hit"]


def test_csv_json_and_swap(spark, tmp_path):
    (tmp_path / "a.csv").write_text('url,title,html\nu1,t,"<p>a,\nb"\nu2,,\nu3,x,y,z,w\n')
    good = tables.read_csv(spark, str(tmp_path / "a.csv"), ["url", "title", "html"])
    assert {r["url"] for r in good.collect()} == {"u1", "u2"}
    assert tables.read_csv(spark, str(tmp_path / "a.csv"), ["url", "title", "html"], keep_bad=True).count() == 3
    rows = tables.validate_rows(good).collect()
    assert {r["url"]: r["error"] for r in rows} == {"u1": None, "u2": "missing_body"}
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    assert tables.read_json(spark, str(tmp_path / "a.jsonl"), "k long").count() == 2
    tables.write_json(spark.range(3), str(tmp_path / "arr"), lines=False)
    assert tables.read_json(spark, str(tmp_path / "arr"), "id long", lines=False).count() == 3
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    tables.swap_in(spark.read.parquet(path).filter("id > 1"), path)
    assert spark.read.parquet(path).count() == 3
    wide = spark.createDataFrame([("og:title", "", "og:title", "x")], ["metadata/openGraph/0/property", "metadata/openGraph/0/content", "metadata/openGraph/1/property", "metadata/openGraph/1/content"])
    assert wide.select(tables.open_graph(wide, "og:title").alias("t")).first()["t"] == ""
    named = spark.createDataFrame([(" ", "b")], "a string, b string")
    assert named.select(tables.first_value(named, ["a", "x", "b"]).alias("v")).first()["v"] == "b"


def test_embedding_cache_and_dimension(spark):
    chunks = spark.createDataFrame([("h1", "a b"), ("h2", "c"), ("h2", "c")], "hash string, text string")
    cache = spark.createDataFrame([("h1", [1.0] * 384), ("h9", [1.0] * 384)], "hash string, vector array<float>")
    got = {r["hash"]: r["vector"] for r in embed.embed_missing(chunks, cache).collect()}
    assert set(got) == {"h1", "h2"} and got["h1"] == [1.0] * 384 and abs(sum(x * x for x in got["h2"]) - 1) < 1e-6
    with pytest.raises(Exception, match="dimension"):
        cache.select(embed.check_dimension(F.col("vector"), 3)).collect()


def test_components_and_validation(spark):
    same = "Licensed under some long enough shared notice of all pages here"
    rows = [(i, f"{same}\nA paragraph of its own with number {i} and enough letters to count") for i in range(6)]
    p = components.explode_paragraphs(spark.createDataFrame(rows, "id long, text string"), "id")
    reg = components.registry(p, "id").collect()
    assert [(r["n_docs"], r["component"]) for r in reg] == [(6, "license")]
    issues = spark.range(1).select(validate.issues(F.lit("x"), F.lit("t"), F.lit(""), F.lit("z"), F.lit(None).cast("string"), F.lit(0), departments=("a",)).alias("i")).first()["i"]
    assert [i["field"] for i in issues] == ["url", "title", "content", "sections", "department"]


def test_streams_match_batch(spark, tmp_path):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns.coalesce(1).write.parquet(str(tmp_path / "turns"))
    stream = sessions.read_table_stream(spark, str(tmp_path / "turns"), sessions.TURNS)
    got = sessions.run_to_memory(sessions.session_windows(stream), "session_rows", str(tmp_path / "c1"))
    want = state.last_turns(turns, "conv_id", "turn", "role", "text").select("conv_id", "turn", F.size("window").alias("n"), F.array_join(F.transform("window", lambda x: x["role"]), ",").alias("r"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    schema = events.schema.simpleString()[7:-1].replace(":", " ")
    stream = sessions.read_table_stream(spark, str(tmp_path / "events"), schema)
    n = sessions.run_to_memory(sessions.counts(stream), "counted", str(tmp_path / "c2"), "complete").agg(F.sum("n")).first()[0]
    assert n == events.count()
    live = sessions.run_to_memory(sessions.live_entries(sessions.read_table_stream(spark, str(tmp_path / "events"), schema).withColumn("cache_key", F.col("user_id"))), "live", str(tmp_path / "c3"))
    assert live.count() == events.select("user_id").distinct().count()


def test_content_unlike_its_url_gets_a_warning(spark):
    rows = spark.createDataFrame([(1, "https://a.org/x/wave-optics", "Wave optics", "wave optics and lenses " * 20), (2, "https://a.org/x/zzzz-qqqq", "Baking", "bread and flour " * 25), (3, "https://a.org/", "Baking bread", "bread and flour " * 25)], "k long, u string, t string, c string")
    none = F.lit(None).cast("string")
    got = {r["k"]: [(x["field"], x["severity"]) for x in r["i"]] for r in rows.select("k", validate.issues(F.col("u"), F.col("t"), F.col("c"), none, none, F.lit(1), aligned=True).alias("i")).collect()}
    assert got[1] == [] and got[3] == [] and ("title", "warning") in got[2]

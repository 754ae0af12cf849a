"""Queries against their SQL on small tables with rows that the test tables lack."""

import duckdb
import pytest

from siltstone.plans import catalog
from tests.conftest import table_of


@pytest.fixture
def equals_sql(spark, tmp_path):
    def check(name, **tables):
        con = duckdb.connect()
        for table, (rows, schema) in tables.items():
            path = str(tmp_path / f"{table}.parquet")
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
        df, want = catalog.QUERIES[name](spark, str(tmp_path)), con.sql(catalog.ORACLES[name])
        got = table_of(df.columns, df.collect())
        assert got == table_of(want.columns, want.fetchall())
        return got

    return check


WORDS = "aa bb cc dd ee ff gg hh".split()


def corpus(texts):
    """documents, labels and benchmark of a few texts, asked for with themselves and with "the of" inside of words."""
    docs = [(i, t, ["en", "fr", None][i % 3], f"src{i % 10}", len(t or "")) for i, t in enumerate(texts)]
    return {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, i % 2, 0) for i in range(0, len(texts), 2)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(0, "bathe often aa bb"), (1, "hoof therein cc"), (2, "of the dd"), (3, "x" * 110 + "\n" + "y" * 115 + " ee"), (4, "ff " * 80), (5, "license aa"), (6, "aa 123 bb"), (7, "gg?")], "item_id long, text string"),
    }


TEXTS = [" ".join([*WORDS[i % 8 :], "own" + str(i), "license", *WORDS[: i % 5]]) for i in range(40)] + ["", None]


@pytest.mark.parametrize("name", ["agg_retrieval_metrics", "agg_metrics_rollup"])
def test_measures_by_intent(equals_sql, name):
    assert "the_query" in str(equals_sql(name, **corpus(TEXTS)))


def test_fallback_by_intent(equals_sql):
    assert "the_query" in str(equals_sql("ret_bm25_filtered_fallback", **corpus(TEXTS)))


def test_fallback_of_queries_that_score_only_unknown_types(equals_sql):
    """"lonely" stands in documents without a type alone; with a rule it finds none, without one all. "zz" has a document of a wrong type too."""
    tables = corpus(["lonely zz", "zz yy", "lonely", "aa bb cc", "dd"])
    rows = [(i, t, lang, None if i in (0, 2) else "src4", n) for i, t, lang, _, n in tables["documents"][0]]
    asked = [(1, "lonely 123"), (2, "lonely"), (3, "zz 999"), (4, "license lonely"), (5, "zz?")]
    tables |= {"documents": (rows, tables["documents"][1]), "benchmark": (asked, tables["benchmark"][1])}
    assert len(equals_sql("ret_bm25_filtered_fallback", **tables)[1]) == 5


def test_departments_by_aliases_that_stand_in_the_text(equals_sql):
    texts = ["Phisics", "physics", "histery", "The History & Letters", "dr. physics", "de  la x", "physics a", "", None, "lettre"]
    equals_sql("txt_department", documents=([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))


def test_document_titles_with_quotes(equals_sql):
    titles = ["a &quot;b&quot; | c", 'd "e"', "&amp;quot; | f", "&qu<b>ot;g", "&lt;h&gt; | | i", "j"]
    pages = [(i, f"<html><title>{titles[i % len(titles)]}</title></html>") for i in range(3 * len(titles))] + [(100, "no title")]
    equals_sql("txt_document_title", pages=(pages, "page_id long, html string"))


BM25 = ("ret_bm25_topk", "ret_bm25_all", "ret_matched_terms", "ret_explanation", "rrk_calibrate_blend", "agg_primary_type", "agg_answer_quality")


@pytest.mark.parametrize("name", BM25)
def test_bm25_with_ties_and_texts_that_share_no_term(equals_sql, name):
    """Copies tie by score, and texts of other words are ranked by priority and section alone."""
    equals_sql(name, **corpus(TEXTS[:6] * 3 + ["zz yy"] * 9 + ["aa"] * 5 + [""]))


def test_shares_that_stand_on_a_half(equals_sql):
    """3 of 20000 relevant documents are .00015, which as a double is less."""
    tables = corpus([*TEXTS, "zq", "zq", "zq"])
    relevant = [(i, 1, 0) for i in range(len(TEXTS), len(TEXTS) + 20000)]
    tables |= {"labels": (relevant, tables["labels"][1]), "benchmark": ([(1, "zq")], tables["benchmark"][1])}
    assert "0.0001" in str(equals_sql("agg_retrieval_metrics", **tables))


def repeated():
    """Rows that share an id, those without an id among them, and vectors without an id."""
    tables = corpus([*TEXTS, *[TEXTS[3]] * 3, *[TEXTS[9]] * 3])
    ids = [*range(len(TEXTS)), 3, 3, 3, None, None, None]
    rows = tables["documents"][0][: len(TEXTS)]
    rows += [rows[3]] * 3 + [rows[9]] * 3
    vectors = [(i, [(i * 7 + j * j) % 11 / 10 - 0.5 for j in range(64)]) for i in range(30)] + [(None, [0.5] * 64)]
    return tables | {"documents": ([(i, *row[1:]) for i, row in zip(ids, rows, strict=True)], tables["documents"][1]), "embeddings": (vectors, "vec_id long, embedding array<float>")}


@pytest.mark.parametrize("name", ["ret_bm25_topk", "agg_retrieval_metrics", "ctx_grounding", "ans_cited_blocks", "ret_rrf", "ret_hybrid", "agg_mode_gain"])
def test_rows_of_one_id_are_one_document(equals_sql, name):
    equals_sql(name, **repeated())


def test_a_pool_has_each_row_once(spark, tmp_path):
    """Without SQL: rrk_fuzzy_dedup gives a row for each of the 20 best rows of a query, and names copies."""
    from siltstone.plans import retrieval_queries as rq

    for table, (rows, schema) in repeated().items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    rows = rq.rrk_fuzzy_dedup(spark, str(tmp_path)).filter("query_id = 5").collect()
    assert len(rows) == 20 and sum(r["doc_id"] == 3 for r in rows) > 1

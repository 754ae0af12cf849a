"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siltstone.llm import bagminhash, budget_mix, decontam_cgk, lang_crf, license_sam, lm_score, quality_rules, secret_markov, substring_dedup, warc_writer

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
BASE = " ".join(f"tok{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, node string, doc string, mark string, `key` string, n string, row string, words string, bucket string, repeats string"
CLASH = ("s",) * 10
ROWS = [
    (1, BASE, "en", "a", 1, *CLASH),
    (1, BASE, "en", "a", 1, *CLASH),
    (2, BASE + " end", "en", "a", None, *CLASH),
    (3, "", "en", None, 0, *CLASH),
    (4, None, None, "b", None, *CLASH),
    (None, "the and of password=abcdefgh1 and gnu general public license", "fr", "b", 5, *CLASH),
    (None, None, None, None, None, *[None] * 10),
    (5, LONG, "fr", "b", 9, *CLASH),
    (6, " \t\n ", "fr", "c", 9, *CLASH),
    (7, "!!! ???", None, "c", 9, *CLASH),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r.asDict())
    return out


def test_quality_rules(docs, none):
    got = by_id(quality_rules.quality(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[1][0] == got[1][1] and got[1][0]["n_words"] == 60
    assert got[4][0]["n_words"] == got[3][0]["n_words"] == 0 and got[4][0]["base_failed"]
    assert got[5][0]["n_words"] == 60_000
    assert quality_rules.quality(none).count() == 0


def test_substring_dedup(docs, none):
    got = by_id(substring_dedup.remove_repeats(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert [r["n_removed"] for r in got[1]] == [0, 0]  # one document twice
    assert got[2][0]["n_removed"] == 60 and got[2][0]["kept"] == "end"
    assert got[3][0]["kept"] == got[4][0]["kept"] == ""
    words = LONG.split()
    seen, gone = set(), set()
    for i in range(len(words) - 19):
        w = tuple(words[i : i + 20])
        if w in seen:
            gone |= set(range(i, i + 20))
        seen.add(w)
    assert got[5][0]["n_removed"] == len(gone)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_near_duplicates(docs, none):
    got = by_id(bagminhash.near_duplicates(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert {r["class_id"] for i in (1, 2) for r in got[i]} == {1}
    assert got[3][0]["class_id"] == 3 and got[4][0]["class_id"] == 4 and got[6][0]["class_id"] == 6
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 7]
    assert bagminhash.near_duplicates(none).count() == 0 and bagminhash.keep_one(none).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, " ".join(f"tok{i}" for i in range(10, 40))), (2, None), (3, ""), (None, "GNU general, public license"), (1, "absent words only here now")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"] or 0, r["edits"]) for r in decontam_cgk.leaks(docs, items).collect())
    assert got == [(0, 0, 0), (1, 1, 0), (1, 1, 0), (2, 1, 0)]
    left = decontam_cgk.decontaminate(docs, items)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 4
    assert decontam_cgk.leaks(none, items).count() == 0 and decontam_cgk.leaks(docs, items.limit(0)).count() == 0


def test_language(docs, none):
    model = lang_crf.train(docs, split=None)
    got = by_id(lang_crf.identify(docs, model))
    assert sum(map(len, got.values())) == len(ROWS)
    for i in (3, 4, 6, 7):
        assert (got[i][0]["lang_pred"], got[i][0]["score"]) == ("und", 0.0)
    assert got[1][0] == got[1][1] and 0 <= got[5][0]["score"] <= 1
    empty = lang_crf.train(none)
    assert {r["lang_pred"] for r in lang_crf.identify(docs, empty).collect()} == {"und"}
    assert lang_crf.identify(none, model).count() == 0
    assert lang_crf.keep_known(docs, model, 0.0).columns == docs.columns


def test_secrets(docs, none):
    got = by_id(secret_markov.secrets(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    spans = [s for r in got[None] for s in r["found"]["spans"]]
    assert [(s["start"], s["end"]) for s in spans] == [(11, 29)]
    assert all(r["found"]["spans"] == [] for i in (1, 3, 4, 5, 6) for r in got[i])
    clean = secret_markov.redact(docs)
    assert clean.columns == docs.columns
    assert {r["text"] for r in clean.filter("doc_id IS NULL").collect()} == {None, "the and of [SECRET] and gnu general public license"}
    assert secret_markov.secrets(none).count() == 0


def test_licenses(docs, none):
    got = by_id(license_sam.licenses(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert {r["labels"] for r in got[None]} == {"", "gpl"} and got[4][0]["first_word"] is None
    assert got[5][0]["n_words"] == 60_000
    assert license_sam.licenses(none).count() == 0


def test_lm_scores(docs, none):
    got = by_id(lm_score.score_texts(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[1][0] == got[1][1] and got[4][0]["n_tokens"] == got[3][0]["n_tokens"] == 1
    assert got[5][0]["n_tokens"] == 60_001 and all(r["score"] <= 0 for rows in got.values() for r in rows)
    assert lm_score.score_texts(none).count() == 0


def test_mix(docs, none):
    mixed = budget_mix.mix(docs)
    got = mixed.collect()
    assert len(got) == len(ROWS) and len(set(mixed.columns)) == len(mixed.columns)
    assert all(0 <= r["repeats"] <= 2 for r in got)
    for source in ("a", "b", "c", None):
        rows = [r for r in got if r["source"] == source]
        assert sum(r["size"] for r in rows) == rows[0]["source_size"]
    assert budget_mix.mix(none).count() == 0


def test_warc(spark, tmp_path):
    body = "<p>" + "x" * 200
    rows = [(3, "http://a/ü x\n", body, 1), (1, None, body, 1), (1, "u", body, 1), (None, "u", body, 1), (4, "u", None, 1), (5, "u", "", 1), (6, "u", "short", 1), (7, "u", "short", 1), (8, "u", "y" * 3_000_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    folder = str(tmp_path / "w")
    manifest = warc_writer.write_warc(pages, folder, roll=3000)
    assert len(manifest) > 1 and sum(m["records"] for m in manifest) == len(rows)
    got = [tuple(r) for r in warc_writer.read_warc(spark, folder, True).select("page_id", "payload_bytes", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == sorted([(3, 203, "revisit", 1), (1, 203, "response", None), (1, 203, "revisit", 1), (None, 203, "revisit", 1), (4, 0, "response", None), (5, 0, "response", None), (6, 5, "response", None), (7, 5, "response", None), (8, 3_000_000, "response", None)], key=str)
    again = warc_writer.write_warc(pages, str(tmp_path / "w2"), roll=3000)
    assert again == manifest
    for m in manifest:
        assert hashlib.sha256((tmp_path / "w" / m["name"]).read_bytes()).hexdigest() == m["sha256"]
    assert warc_writer.write_warc(pages.limit(0), str(tmp_path / "w3")) == []

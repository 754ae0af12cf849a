"""Methods against brute force, exact rules or held-out rows."""

import hashlib
import importlib
import json
import math
import pathlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import bagminhash, budget_mix, decontam_cgk, lang_crf, license_sam, lm_score, registry, secret_markov, substring_dedup, warc_writer
from siltstone.llm.common import ALNUM, mix, text_bytes, word_hashes

DATA = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLES[name])


def test_bagminhash_is_unbiased():
    rng, rows, items, weights, true = np.random.default_rng(1), [], [], [], []
    for p in range(60):
        a = rng.integers(0, 9, 300)
        b = np.maximum(0, a + rng.integers(-3, 4, 300) * (rng.random(300) < 0.5))
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        ids = mix(np.arange(300, dtype=np.uint64) + np.uint64(1000 * p + 1))
        for k, w in enumerate((a, b)):
            rows.append(np.full((w > 0).sum(), 2 * p + k))
            items.append(ids[w > 0])
            weights.append(w[w > 0])
    s = bagminhash.signatures(np.concatenate(rows), np.concatenate(items), np.concatenate(weights), 120, 512)
    error = (s[0::2] == s[1::2]).mean(axis=1) - true
    assert abs(error.mean()) < 0.01 and np.sqrt((error**2).mean()) < 0.03


def test_near_duplicate_classes_equal_brute_force(spark, texts):
    bags = []
    for _, t in texts:
        w = t.split()
        bags.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    parent = {i: i for i, _ in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, b in enumerate(bags):
        for j in range(k):
            both = sum((b & bags[j]).values())
            if both and both / (sum(b.values()) + sum(bags[j].values()) - both) >= 0.8:
                x, y = find(texts[k][0]), find(texts[j][0])
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in registry.QUERIES["op10_bagminhash"](spark, DATA).collect()}
    assert got == {i: find(i) for i, _ in texts}


def test_rows_of_hot_texts_are_labelled_in_place(spark, monkeypatch):
    monkeypatch.setattr(bagminhash, "HOT_LEAST", 2)
    monkeypatch.setattr(bagminhash, "HOT_SHARE", 1 << 40)
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base) for i in range(5, 25)] + [(i, base + " end") for i in range(30, 34)] + [(i, f"alone {i} " * 9) for i in range(3)]
    got = {r.doc_id: (r.class_id, r.class_size) for r in bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (5, 24) if i > 4 else (i, 1) for i, _ in rows}
    assert sorted(r.doc_id for r in bagminhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [0, 1, 2, 5]


def test_bucket_rounds_find_links_that_the_first_hub_misses(spark):
    """A chain of near copies whose ends are unlike each other ends up in one class."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for step in range(12):
        rows.append((step, " ".join(words[:])))
        for k in range(20):
            words[(step * 23 + k) % 400] = f"new{step}x{k}"
    got = bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}


def test_cgk_recall_against_all_windows():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 50))) for _ in range(80)]
    index = decontam_cgk.Items(list(range(80)), items)
    docs, planted = [], set()
    for d in range(300):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 150))]
        if d % 2:
            i = r.randrange(80)
            own = items[i].split()
            for _ in range(r.randint(0, int(index.k[i]))):
                p = r.randrange(len(own))
                own[p : p + r.randint(0, 1)] = [r.choice(vocabulary)] * r.randint(0, 1)
                own = own or ["x"]
            p = r.randint(0, len(words))
            words[p:p] = own
            planted.add((d, i))
        docs.append(" ".join(words))
    data, offs = text_bytes(pa.array(docs))
    h, _, _, woff = word_hashes(data, offs, ALNUM)
    row, item, start, dist = decontam_cgk.matches(h, woff, index)
    got = {(a, b, c): e for a, b, c, e in zip(row.tolist(), item.tolist(), start.tolist(), dist.tolist(), strict=True)}

    def edits(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    want = {}
    for d, i in planted:
        words, own = docs[d].split(), items[i].split()
        for s in range(len(words) - len(own) + 1):
            e = edits(own, words[s : s + len(own)])
            if e <= index.k[i]:
                want[d, i, s] = e
    found = {x[:2] for x in got}
    assert len({x[:2] for x in want} & found) >= 0.95 * len({x[:2] for x in want})
    assert all(got[x] == e for x, e in want.items() if x in got) and found <= planted


def test_suffix_automaton_statistics():
    r = random.Random(2)
    sequences = [[r.randrange(4) for _ in range(r.randint(1, 12))] for _ in range(8)]
    a = license_sam.Automaton(sequences)
    for _ in range(60):
        t = [r.randrange(5) for _ in range(20)]
        for i, (n, v) in enumerate(a.statistics(t)):
            assert n == max(k for k in range(i + 2) if any(s[j : j + k] == t[i + 1 - k : i + 1] for s in sequences for j in range(len(s) - k + 1)))
            if n:
                assert set(a.ends[v]) == {(q, k + n) for q, s in enumerate(sequences) for k in range(len(s) - n + 1) if s[k : k + n] == t[i + 1 - n : i + 1]}


def test_license_base_and_templates(spark, texts):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r.doc_id: r for r in registry.QUERIES["op5_license_sam"](spark, DATA).collect()}
    for i, t in texts:
        w = word.findall(t.translate(ASCII_LOWER))
        places, labels = [], set()
        for phrase, label in license_sam.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(","))
    gapped = "x Permission is hereby granted, FREE of charge, to any person obtaining a copy of this software and associated documentation files (the Software), inserted words, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included y"
    row = license_sam.licenses(spark.createDataFrame([(1, gapped)], "doc_id long, text string")).first()
    assert row.labels == "mit" and row.score >= 0.6 and row.spans.startswith("mit:1:")


def test_license_of_one_template_inside_or_beside_another(spark):
    nc = "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"
    by = "This work is licensed under a Creative Commons Attribution 4.0 International License"
    apache = "Licensed under the Apache License, Version 2.0. The words go on"
    rows = [(1, nc), (2, f"{nc}. Some words stand here. {by}"), (3, apache), (4, by)]
    templates = (*license_sam.TEMPLATES, ("apache-long", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with it"))
    got = {r.doc_id: r for r in license_sam.licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    assert got[1].labels == "cc-by-nc" and set(got[2].labels.split(",")) == {"cc-by", "cc-by-nc"} and got[4].labels == "cc-by"
    assert got[3].labels == "apache" and got[3].score == 1.0 and got[3].spans == "apache:0:8"


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    n, s = 57, 3
    score, first, trans, start = rng.normal(size=(n, s)), np.zeros(n, bool), rng.normal(size=(s, s)), rng.normal(size=s)
    first[[0, 10, 11, 40]] = True
    got = lang_crf.forward_backward(score, first, trans, start, 8)[0]
    for i, j in ((0, 10), (10, 11), (11, 40), (40, 57)):
        alpha, beta = [np.exp(score[i] + start)], [np.ones(s)]
        for t in range(i + 1, j):
            alpha.append((alpha[-1] @ np.exp(trans)) * np.exp(score[t]))
        for t in range(j - 1, i, -1):
            beta.insert(0, np.exp(trans) @ (np.exp(score[t]) * beta[0]))
        want = np.array(alpha) * np.array(beta)
        assert np.allclose(got[i:j], want / want.sum(axis=1, keepdims=True))


def test_language_on_held_out_rows_and_switches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_crf.train(docs)
    rows = lang_crf.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    one = {lang: docs.filter(F.col("lang") == lang).orderBy("doc_id").first()["text"].split()[:30] for lang in ("en", "es")}
    gamma, offs = model.label_words(pa.array([" ".join(one["en"] + one["es"])]))
    labels = [model.langs[k] for k in gamma.argmax(axis=1)]
    assert labels[:20].count("en") >= 17 and labels[-20:].count("es") >= 17


def test_texts_of_three_languages_are_kept_and_random_letters_are_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    model = lang_crf.train(docs)
    parts = [docs.filter(F.col("lang") == lang).orderBy("doc_id").first()["text"].split()[:60] for lang in ("en", "es", "fr")]
    mixed = " ".join(" ".join(p[k : k + 20]) for k in (0, 20, 40) for p in parts)
    rng = random.Random(1)
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 10))) for _ in range(600))
    assert model.predict(pa.array([mixed]))[1][0] < 0.5
    rows = spark.createDataFrame([(1, "en", mixed), (2, "en", noise), (3, "en", " ".join(parts[0]))], docs.schema)
    assert {r.doc_id for r in lang_crf.keep_known(rows, model).collect()} == {1, 3}


def test_language_of_rows_with_null_or_equal_ids(spark):
    """What is learned does not depend on doc_ids, nor on one text that many rows repeat."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    none = docs.withColumn("doc_id", F.when(F.col("lang") != "en", F.col("doc_id")).cast("long"))
    copy = docs.filter("lang = 'fr'").orderBy("doc_id").limit(1).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).select(F.lit(0).cast("long").alias("doc_id"), "text", "lang")
    for rows in (none, docs.unionByName(copy)):
        model = lang_crf.train(rows)
        found = lang_crf.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("rate")).filter("lang IS NOT NULL").collect()
        assert all(r.rate > 0.95 for r in found), found


def test_secret_spans_and_held_out_models(spark, texts):
    got = {r.doc_id: r for r in registry.QUERIES["op4_secret_markov"](spark, DATA).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for i, t in texts:
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        base = ",".join(f"{secret_markov.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    model = F.lit(secret_markov.train(secret_markov.labelled_sample(spark, 2000)))
    sample = secret_markov.labelled_sample(spark, 1000, seed=99).select("random", (secret_markov.ratio(F.col("token"), model) >= secret_markov.THRESHOLD).alias("hit"))
    rates = {r["random"]: r["rate"] for r in sample.groupBy("random").agg(F.avg(F.col("hit").cast("int")).alias("rate")).collect()}
    assert rates[True] > 0.98 and rates[False] < 0.02
    many = " é ".join(["password: token: abcdefghij", "x AKIA" + "A" * 12, "secret='k9Qz0fTx7Lm2Vw8R'"] * 40)
    row = secret_markov.secrets(spark.createDataFrame([(1, many)], "doc_id long, text string")).first()["found"]["base"]
    want = [(m.start(), 0, m.end()) for m in assign.finditer(many) if len(m[2]) >= 8] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", many)]
    assert [(s["start"], s["kind"], s["end"]) for s in row] == sorted(want)


def test_secret_models_on_strings_of_other_makers(spark):
    """Recall by format and false alarms on names of the standard library, found by scan() in a sentence."""
    rng = random.Random(5)
    letters = string.ascii_letters
    formats = {
        "base62 20": (letters + string.digits, 20, 0.99),
        "base62 40": (letters + string.digits, 40, 0.99),
        "lower case and digits 24": (string.ascii_lowercase + string.digits, 24, 0.97),
        "base32 26": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 26, 0.97),
        "letters 24": (letters, 24, 0.95),
        "base64 40": (letters + string.digits + "+/", 40, 0.99),
    }
    rows = [(name, f"so the {''.join(rng.choices(chars, k=n))} is used") for name, (chars, n, _) in formats.items() for _ in range(300)]
    names = {x for m in ("os", "ast", "socket", "unittest.mock", "xml.dom.minidom", "email.message", "asyncio", "ssl", "tarfile", "logging", "inspect", "typing", "http.client", "codecs", "decimal", "locale") for x in _names(importlib.import_module(m)) if len(x) >= 16}
    rows += [("names", f"so the {x} is used") for x in sorted(names)]
    found = secret_markov.secrets(spark.createDataFrame(rows, "doc_id string, text string"), secret_markov.default_model(spark))
    rates = {r.doc_id: r.rate for r in found.groupBy("doc_id").agg(F.avg((F.size("found.spans") > 0).cast("int")).alias("rate")).collect()}
    assert all(rates[k] >= least for k, (_, _, least) in formats.items()), rates
    assert len(names) > 300 and rates["names"] < 0.02, rates


def _names(x, depth=1):
    return set(dir(x)) | {n for k in dir(x) if depth and isinstance(getattr(x, k, None), type) for n in dir(getattr(x, k))}


def test_lm_base_is_exact_and_model_beats_it(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in lm_score.score_texts(docs, top=500).collect()}
    tokens = {r.doc_id: [w for w in SPACE.split((r.text or "").translate(ASCII_LOWER)) if w] + ["\0"] for r in docs.select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    total, types = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(counts[w] > 0 for w in t), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in t), rel_tol=1e-9)
    assert sum(rows[i].score for i in tokens if held[i]) > sum(rows[i].base_score for i in tokens if held[i])


def test_filter_reads_levels_back():
    keys = mix(np.arange(1, 20_001, dtype=np.uint64))
    counts = np.random.default_rng(2).geometric(0.3, len(keys)) ** 2
    order = np.argsort(keys)
    t = pa.table({"bucket": pa.array([0], pa.int32()), "words": [keys[order].tobytes()], "word_counts": [counts[order].astype(np.uint32).tobytes()], "pairs": [lm_score._squeeze(b"")], "pair_counts": [lm_score._squeeze(b"")]})
    model = lm_score.Model(lm_score._table(1 << 20, 100)(t).to_pylist(), 1)
    read = model.estimate(lm_score.salted(keys & lm_score.LOW40, 1), np.zeros(len(keys), np.int64))
    true = (1.5 * 2.0 ** lm_score.level_of(counts) - 1) / 2
    assert (read >= true).all() and (read == true).mean() > 0.97
    other = model.estimate(lm_score.salted(mix(keys + np.uint64(1 << 40)) & lm_score.LOW40, 1), np.zeros(len(keys), np.int64))
    assert (other > 0).mean() < 0.05


def test_filter_grows_with_its_entries():
    keys = np.sort(mix(np.arange(1, 20_001, dtype=np.uint64)))
    t = pa.table({"bucket": pa.array([0], pa.int32()), "words": [keys.tobytes()], "word_counts": [np.ones(len(keys), np.uint32).tobytes()], "pairs": [lm_score._squeeze(b"")], "pair_counts": [lm_score._squeeze(b"")]})
    model = lm_score.Model(lm_score._table(64, 100)(t).to_pylist(), 1)
    other = model.estimate(lm_score.salted(mix(keys + np.uint64(1 << 40)) & lm_score.LOW40, 1), np.zeros(len(keys), np.int64))
    assert (other > 0).mean() < 0.05


def test_lm_score_by_quantised_counts_and_any_cache(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    few, many = ({r.doc_id: r.score for r in lm_score.score_texts(docs, top=top).collect()} for top in (4, 1 << 18))
    texts = {r.doc_id: [w for w in SPACE.split((r.text or "").translate(ASCII_LOWER)) if w] + ["\0"] for r in docs.select("doc_id", "text").collect()}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    ones, twos = Counter(w for t in train for w in t), Counter(x for t in train for x in zip(["\0", *t], t))
    size, q = ones.total() + len(ones) + 1, lambda c: (1.5 * 2 ** c.bit_length() - 1) / 2 if c else 0.0
    off = []
    for i, t in texts.items():
        want = sum(math.log10((q(twos[v, w]) + lm_score.MU * (q(ones[w]) + 1) / size) / (q(ones[v]) + lm_score.MU)) for v, w in zip(["\0", *t], t))
        assert math.isclose(few[i], many[i], rel_tol=1e-9)
        off.append(abs(many[i] - want) / len(t))
    assert sum(off) / len(off) < 0.02 and max(off) < 0.2


def test_water_fill_and_fit():
    targets = budget_mix.water_fill({"b": 100, "a": 10, None: 50})
    assert targets["a"] == 20 and math.isclose(sum(targets.values()), 240) and targets["b"] <= 200 and targets[None] <= 100
    r = random.Random(5)
    for _ in range(200):
        counts = {r.randint(1, 12): r.randint(1, 4) for _ in range(r.randint(1, 5))}
        budget = r.randint(0, 60)
        sums = {0}
        for n, k in counts.items():
            sums |= {s + n * j for s in sums for j in range(1, k + 1)}
        took = budget_mix.fit(counts, budget)
        assert all(took[n] <= counts[n] for n in took)
        got = sum(n * k for n, k in took.items())
        assert got <= budget and min(budget, max(sums)) - got <= max(counts)
    assert sum(n * k for n, k in budget_mix.fit({n: 50 for n in range(1, 3000)}, 111_111_111).items()) == 111_111_111


def test_mix_meets_targets_and_repeats(spark):
    rows = registry.QUERIES["op9_budget_mix"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, registry.QUERIES["op9_budget_mix"](spark, "/root/testdata/sf0.01").collect()))
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.001 * own[0].target + 5
        assert all(r.taken <= 2 * r.size for r in own)


def test_hot_anchors_meet_by_salt(spark, same, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", 2)
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 1 << 40)
    same(registry.QUERIES["op8_substring_dedup"], registry.ORACLES["op8_substring_dedup"])


def _shards(folder):
    return {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in pathlib.Path(folder).glob("part-*")}


def test_archives_are_the_same_on_each_run_and_safe_to_write_again(spark, tmp_path):
    pages = spark.range(0, 40000, 1, 7).select((F.col("id") * 7919 % 40009).alias("page_id"), F.lit("http://a/").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), (F.col("id") % 4).cast("int")).alias("html"))
    for k, rows in enumerate((pages, pages.repartition(5, "html"))):
        warc_writer.write_warc(rows, str(tmp_path / str(k)), shards=4, roll=400_000)
    assert _shards(tmp_path / "0") == _shards(tmp_path / "1") and len(_shards(tmp_path / "0")) > 4
    sizes = [x["records"] for x in json.loads((tmp_path / "0" / "manifest.json").read_text())]
    assert sum(sizes) == 40000
    with pytest.raises(FileExistsError):
        warc_writer.write_warc(pages.limit(10), str(tmp_path / "0"), shards=2)
    warc_writer.write_warc(pages.limit(10), str(tmp_path / "0"), shards=2, overwrite=True)
    (tmp_path / "0" / "part-99999-00000.warc.gz").write_bytes(b"not of this archive")
    assert warc_writer.read_warc(spark, str(tmp_path / "0")).count() == 10


def test_shards_split_one_hot_key(spark, tmp_path):
    """A third of all rows under one key, and a third without one, are dealt to several shards, in order."""
    pages = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(5)).when(F.col("id") % 3 == 1, F.col("id")).cast("long").alias("page_id"), F.lit("u").alias("url"), F.concat(F.repeat(F.lit("x"), 200), F.col("id").cast("string")).alias("html"))
    manifest = warc_writer.write_warc(pages, str(tmp_path / "w"), shards=6)
    assert len(manifest) == 6 and max(x["records"] for x in manifest) < 700
    rows = warc_writer.read_warc(spark, str(tmp_path / "w")).collect()
    assert len(rows) == 3000 and sum(r.page_id is None for r in rows) == 1000 and sum(r.page_id == 5 for r in rows) == 1000
    slim = spark.createDataFrame([(k, f"{k:064x}", 10) for k in [-(1 << 63), -5, -1, 0, 1, 2, (1 << 63) - 1] * 3], "key long, digest string, weight long")
    first = warc_writer.bounds(slim, 7)
    order = {r["key"]: r["s"] for r in slim.withColumn("s", warc_writer.shard_of(F.col("key"), F.col("digest"), first)).collect()}
    assert [order[k] for k in sorted(order)] == list(range(7))


def test_pipeline_on_nulls_repeats_and_clashing_columns(spark, tmp_path):
    """What the stages leave of rows with nulls, empty and very long texts, repeated rows and columns of their own names, and of no rows."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    clash = [F.lit("s").alias(c) for c in ("size", "node", "comp", "own_slice", "c0", "rank", "bucket")]
    long = docs.filter("lang = 'en'").agg(F.concat_ws(" ", F.collect_list("text")).alias("t")).first()["t"]
    odd = [(None, "en", None), (900_001, "en", ""), (900_002, None, None), (None, None, docs.filter("lang = 'en' AND n_chars > 2000").orderBy("doc_id").first()["text"] + " own end"), (900_003, "en", long), (900_004, "en", "!!! ???")]
    more = spark.createDataFrame([(i, t, lang, None, None) for i, lang, t in odd], docs.schema)
    rows = docs.unionByName(docs.filter("doc_id < 50")).unionByName(more).select("*", *clash)
    for name, table in (("some", rows), ("none", rows.limit(0))):
        folder = tmp_path / name
        table.write.parquet(str(folder / "documents.parquet"))
        spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(folder / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(folder))
        assert len(set(got.columns)) == len(got.columns) and set(rows.columns) <= set(got.columns)
        found = [r.doc_id for r in got.collect()]
        if name == "none":
            assert not found
        else:
            assert len(found) > 30 and all(i not in found for i in (900_001, 900_002, 900_004)) and all(found.count(i) <= 1 for i in range(50))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    base = docs.columns
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), stage(spark, docs, DATA).schema)
        steps.append(docs)
    assert all(s.columns == base for s in steps[:-1])
    classes = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(steps[0]).collect()}
    assert {r.doc_id for r in steps[1].select("doc_id").collect()} == set(classes.values())
    leaked = {r.doc_id for r in decontam_cgk.leaks(steps[1], spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in steps[1].collect()} - leaked == {r.doc_id for r in steps[2].collect()}
    assert steps[3].count() == steps[2].count() and secret_markov.secrets(steps[3]).filter(F.size("found.base") > 0).count() == 0
    assert steps[4].filter("repeats < 1").count() == 0 and corpus_pipeline.run(spark, DATA).count() == steps[4].count()

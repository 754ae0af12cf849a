import itertools
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import fuzzy, html, keys, rules, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize_and_lines(spark):
    x = F.lit("A ,b\r\n\r\n\r\n\r\nc | d\n  e  f ")
    assert one(spark, text.normalize(x)) == "A, b\n\nc\nd\ne f"
    assert one(spark, text.keep_lines(F.lit("\na\nA\n\n\na\nb\nRead more\nb"))) == "a\n\nb"
    assert one(spark, text.normalize(F.lit("ﬁn"), unicode=True)) == "fin"


def test_null_texts_count_as_empty(spark):
    none = F.lit(None).cast("string")
    for f in (text.normalize, text.keep_lines, text.summary, text.clean_title, text.speech, keys.dedup_url):
        assert one(spark, f(none)) == ""
    assert one(spark, text.tokens(none)) == []
    assert one(spark, text.paragraphs(none)) == []


def test_titles_and_sections(spark):
    assert one(spark, text.clean_title(F.lit(" - Fees  2024 | Official Site "))) == "Fees 2024"
    assert one(spark, text.clean_document_title(F.lit("Home | Fees | Dates"))) == "Fees | Dates"
    got = one(spark, text.fallback_sections(F.lit("Fees and dates\n\nTen.\n\nRooms here\n\nOne.\n\nTwo.")))
    assert [(s["heading"], s["content"]) for s in got] == [("Fees and dates", "Ten."), ("Rooms here", "One.\nTwo.")]
    parts = one(spark, text.split_large(F.lit("H"), F.lit("a b c d e"), 2))
    assert [(p["heading"], p["content"]) for p in parts] == [("H (Part 1)", "a b"), ("H (Part 2)", "c d"), ("H (Part 3)", "e")]
    assert one(spark, text.is_generic_heading(F.lit("General Information")))


def test_url_keys(spark):
    assert one(spark, keys.canonical_url(F.lit("HTTP://www.A.org//x//?b=2&utm_source=q&a=1&c=&sort=z#f"))) == "http://a.org/x?a=1&b=2"
    assert one(spark, keys.canonical_url(F.lit("a.org/"))) == "https://a.org"
    assert one(spark, keys.slug_words(F.lit("https://a.org/x/my-first%20page.html?q"))) == "my first page"
    assert one(spark, keys.uuid5(F.lit("abc"))) == str(uuid.uuid5(keys.POINTS, "abc"))
    assert one(spark, keys.cache_key(F.lit(" What  is it?! "))) == one(spark, keys.cache_key(F.lit("what is it")))


def test_html_extraction():
    page = "<html><body><nav><a>skip</a></nav><div class='cookie-bar'>no</div><main><h1>T</h1><p>One &amp; two<p>Three<ul><li>x</ul><h2>S</h2><p>Four</main><footer>end</footer></body></html>"
    got = html.extract(page)
    assert got["content"] == "# T\nOne & two\nThree\n- x\n## S\nFour"
    assert got["sections"] == [{"heading": "T", "content": "One & two\nThree\nx"}, {"heading": "S", "content": "Four"}]
    assert got["removed"] == 3
    assert html.extract(None)["malformed"]


@settings(max_examples=60, deadline=None)
@given(st.text("ab ", max_size=12), st.text("abc ", max_size=12))
def test_token_set(a, b):
    def common(x, y):
        return max(len(s) for n in range(len(x) + 1) for s in map("".join, itertools.combinations(x, n)) if all(c in it for it in [iter(y)] for c in s))

    assert fuzzy._common(a, b) == common(a, b)
    score = fuzzy.token_set(a, b)
    assert 0 <= score <= 100 and score == fuzzy.token_set(b, a)
    if a.split() and set(a.split()) <= set(b.split()):
        assert score == 100


def test_rules(spark):
    assert one(spark, rules.first_match(F.lit("xx b a"), (("one", "a"), ("two", "b")))) == "one"
    v = one(spark, rules.vote(F.lit(" the of and x ")))
    assert (v["name"], v["confidence"]) == ("English", 0.65)
    assert one(spark, rules.vote(F.lit("x"))) is None
    assert one(spark, rules.entities(F.lit("the license"))) == {"topic": "law", "lang": "en"}
    assert one(spark, rules.component_type(F.lit("licensed under; price 3"))) is None
    assert 0 <= one(spark, rules.answerability(F.lit("- a\n- b 10 20 | ? click here"))) <= 1


def test_department_by_the_alias_most_like_it(spark):
    aliases = {"Physics": ["physics", "applied physics"], "History": ["history"]}
    cases = {"Physicss": "Physics", "Hisstory": "History", "Aplied Physicss": "Physics", "chemistry": None, "": None, None: None, "history of physics": "Physics"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["d"] for r in rows.select("t", text.normalize_department(F.col("t"), aliases).alias("d")).collect()} == cases
    assert one(spark, text.infer_department([F.lit("x"), F.lit(None).cast("string")], F.array(F.lit("none"), F.lit("Hisstory")), aliases)) == "History"

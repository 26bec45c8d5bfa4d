"""Loading, cleaning and scalar functions."""

import random
import sys

import pytest
from pyspark.errors import ArithmeticException
from pyspark.sql import functions as F

from lexaline.functions import distance, score, text
from lexaline.sources import sinks, words


def load(spark, content, max_entries=0):
    corpus, report = words.from_lines(spark.createDataFrame(list(enumerate(content)), "line_no int, line string"), max_entries)
    return [(r["word"], r["weight"]) for r in corpus.orderBy("ord").collect()], report


@pytest.mark.parametrize(
    ("content", "want", "source"),
    [
        (["the\t23135851162", "apple,12345", "banana; 999", "cherry 42"], [("the", 23135851162), ("apple", 12345), ("banana", 999), ("cherry", 42)], "COLUMN"),
        (["New York\t48210", "olive oil,900", "United States of America 12"], [("New York", 48210), ("olive oil", 900), ("United States of America", 12)], "COLUMN"),
        (["covid19", "mp3", "3d", "a1"], [("covid19", 4), ("mp3", 3), ("3d", 2), ("a1", 1)], "RANK"),
        (["the\t100", "orphan", "apple\t50"], [("the", 100), ("orphan", 0), ("apple", 50)], "COLUMN"),
        (["the\t99999999999999999999999999"], [("the", 9223372036854775807)], "COLUMN"),
        (["the\t100\t200", "plain"], [("plain", 0)], "COLUMN"),
        (["zebra 3", "apple 2", "mango 1"], [("zebra", 3), ("apple", 2), ("mango", 1)], "COLUMN"),
        (["iphone 10", "iPhone 900", "IPHONE 20"], [("iPhone", 930)], "COLUMN"),
        (["apple 50", "Apple 50"], [("Apple", 100)], "COLUMN"),
        (["apple 30", "apple 30", "Apple 50"], [("Apple", 110)], "COLUMN"),
    ],
)
def test_load(spark, content, want, source):
    got, report = load(spark, content)
    assert got == want and report.weight_source == source


def test_load_counts(spark):
    got, report = load(spark, ["# a comment", "the 5", "", "apple 3", "   "])
    assert (report.lines_read, report.skipped, len(got)) == (5, 3, 2)
    got, report = load(spark, ["apple\t70", "Apple\t30", "banana\t5"])
    assert report.merged_away == 1 and got == [("apple", 100), ("banana", 5)]
    got, report = load(spark, ["a 4", "b 3", "c 2", "d 1"], 2)
    assert got == [("a", 4), ("b", 3)] and report.lines_read == 2
    got, report = load(spark, [])
    assert got == [] and report.summary().startswith("loaded 0 terms")


def test_files_and_resources(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("the 5\r\napple 3\n\n# x\n")
    corpus, report = words.load(spark, str(path))
    assert corpus.count() == 2 and report.lines_read == 4
    with pytest.raises(ValueError):
        words.load_resource(spark, "lexaline", "missing.txt")
    assert words.max_entries_of(spark) == 0
    spark.conf.set("lexaline.dataset.max-entries", "1")
    try:
        assert words.load(spark, str(path))[0].count() == 1 and words.load(spark, str(path), 0)[0].count() == 2
    finally:
        spark.conf.unset("lexaline.dataset.max-entries")
    with pytest.raises(ValueError, match="no resource"):
        words.bundled(spark)
    package = tmp_path / "listed"
    package.mkdir()
    (package / "__init__.py").write_text("")
    (package / "some.txt").write_text("one 3\ntwo 2\n")
    sys.path.insert(0, str(tmp_path))
    try:
        assert words.load_resource(spark, "listed", "some.txt", 1)[1].entries == 1
    finally:
        sys.path.remove(str(tmp_path))


def test_words_of_all_scripts(spark):
    texts = spark.createDataFrame([("Él él ÉL naïve cafe\u0301 x1y 日本",)], "text string")
    got = {r["word"]: r["weight"] for r in words.from_tokens(texts).collect()}
    assert got == {"ÉL": 3, "naïve": 1, "cafe\u0301": 1, "x": 1, "y": 1, "日本": 1}


def test_labels(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(text.micros_label(F.lit(x).cast("double"))) for x in (None, 3.14159, 12.7, 1234.5, 2500000.0)] == ["—", "3.14 µs", "13 µs", "1.23 ms", "2500.00 ms"]
    assert [one(text.speedup_label(F.lit(x).cast("double"))) for x in (None, float("inf"), 1.234, 15.66, 445.2)] == ["—", "—", "1.23×", "15.7×", "445×"]
    assert one(text.count_label(F.lit(204075))) == "204,075"
    assert [tuple(one(text.highlight(F.lit(w), F.lit(q)))) for w, q in (("Apple", " aP"), ("Apple", "b"), ("Apple", " "))] == [("Ap", "ple"), ("", "Apple"), ("", "Apple")]


def test_banded_distance():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.randint(0, 2) for _ in range(rng.randint(0, 9))] for _ in range(2))
        want = distance.rows_of(a, b)[-1][-1]
        for most in range(5):
            assert distance.banded(a, b, most) == (want if want <= most else -1)


def test_sum_overflow_fails(spark):
    with pytest.raises(ArithmeticException):
        load(spark, ["a 9223372036854775807", "A 1"])[0]


def test_checked(spark):
    bad = spark.createDataFrame([(0, " ", " ", 1)], "ord long, word string, normalized string, weight long")
    with pytest.raises(Exception, match="blank"):
        words.checked(bad).collect()


def test_normalize(spark):
    raw = ["\t Apple \n", " x", "　x ", "ΑΣ", "a\u0085", " x"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in raw], "w string").select(text.normalize(F.col("w"))).collect()]
    assert got == ["apple", " x", "x", "ας", "a\u0085", " x"]
    row = spark.range(1).select(text.units(F.lit("a😀")), text.has_astral(F.lit("😀")), text.has_astral(F.lit("é"))).first()
    assert tuple(row) == (3, True, False)


PAIRS = [("", "", 0), ("", "apple", 5), ("apple", "apple", 0), ("abc", "xyz", 3), ("apple", "aple", 1), ("kitten", "sitting", 3), ("saturday", "sunday", 3), ("flaw", "lawn", 2), ("teh", "the", 2), ("recieve", "receive", 2), ("café", "cafe", 1), ("CA", "ABC", 3)]


def test_distance(spark):
    df = spark.createDataFrame(PAIRS, "a string, b string, want int")
    a, b = F.col("a"), F.col("b")
    for units in (False, True):
        got = df.select("want", distance.distance(a, b, units), distance.distance_with_cutoff(a, b, 2, units), distance.is_within(a, b, 2, units)).collect()
        assert all(d == w and c == min(w, 3) and i == (w <= 2) for w, d, c, i in got)
    emoji = spark.createDataFrame([("😀", "")], "a string, b string")
    assert emoji.select(distance.distance(a, b, True)).first()[0] == 2
    table = spark.createDataFrame([("ab", "xyz")], "a string, b string").select(distance.table(a, b)).first()[0]
    assert len(table) == 3 and table[0] == [0, 1, 2, 3] and table[-1][-1] == 3
    for f in (distance.distance_with_cutoff, distance.is_within):
        with pytest.raises(ValueError):
            f(a, b, -1)


def test_scores(spark):
    df = spark.createDataFrame([("PREFIX", 0, 0, 1000000), ("FUZZY", 1, 10**6, 10**6), ("FUZZY", 2, 0, 10**6), ("PREFIX", 0, 10**9, 10**6), ("PREFIX", 0, 5, 0), ("FUZZY", 1, 5, 0), ("PREFIX", 0, 1, 23135851162)], "t string, d int, w long, m long")
    got = [r[0] for r in df.select(score.score(F.col("t"), F.col("d"), F.col("w"), F.col("m"))).collect()]
    assert got[:6] == pytest.approx([0.7, 0.65, 0.7 / 3, 1.0, 0.7, 0.35])
    queries = ["", "a", "ap", "app", "appl", "  app  ", "apple", None]
    rows = spark.createDataFrame([(q,) for q in queries], "q string").select(score.budget(F.col("q"))).collect()
    assert [r[0] for r in rows] == [score.budget_of(q) for q in queries] == [0, 0, 0, 1, 1, 1, 2, 0]


def test_sinks(spark):
    rows = spark.createDataFrame([(1, 2, "b", 0.5, "FUZZY", 1, 3), (1, 1, "a", 0.9, "PREFIX", 0, 4)], "query_id int, rank int, word string, score double, match_type string, edit_distance int, weight long")
    got = sinks.responses(rows, ["query_id"]).first()["response"]
    assert got.index('"a"') < got.index('"b"') and '"result_count":2' in got
    points = sinks.with_rates(spark.createDataFrame([(2.0, 0.1), (2.0, 1.0), (2.0, float("nan"))], "micros double, error_micros double")).collect()
    assert [p["reliable"] for p in points] == [True, False, False] and points[0]["ops_per_second"] == 5e5
    assert sinks.markdown([{"a": 1}]).startswith("| a |")

"""Column functions on small literals, null and empty values among them."""

import pytest
from pyspark.sql import functions as F

from scrivener.functions import dates, entities, headings, scores, text


@pytest.fixture
def value(spark):
    def run(f, *values, kind="string"):
        df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
        return [r[0] for r in df.select(f(F.col("x"))).collect()]

    return run


def test_text(value):
    assert value(text.lookup_key, "  A b\tC\0 ", None, "") == ["a b c", "", ""]
    assert value(text.title, "o'neil a-b 3com été") == ["O'Neil A-B 3Com Été"]
    assert value(text.lines_of, "a\r\nb\rc d", None) == [["a", "b", "c", "d"], [""]]
    assert value(text.clean_line, "| a ,b<br>end - to - end ===== c;", None) == ["a, b end-to-end c", ""]
    assert value(lambda x: text.distinct_ci(F.split(x, ",")), "B,a,b,A") == [["B", "a"]]
    assert value(text.split_items, "a, b/c;;d | e", None) == [["a", "b", "c", "d", "e"], []]
    assert value(text.is_junk, "--", "a", "ab", None) == [True, True, False, True]
    assert value(text.bullet_line, "•  x  y", "* z") == ["- x y", "- z"]
    assert value(lambda x: text.preview(x, 3), "abcd", "abc") == ["abc...", "abc"]


def test_headings(value):
    got = value(headings.canonical, "EDUCATION:", "Technical Skills", "skills section", "skills & overview details", "skills and a lot", "projects", "Training and Certifications", "•  Work History —", "x@y", "", None, "1999", "about")
    assert got == ["education", "skills", "skills", "skills", None, "projects", "certifications", "experience", None, None, None, None, "summary"]
    assert value(headings.key_of, "Education", "Odd heading here", "--") == ["education", "custom_odd_heading_here", "custom_unknown"]


def test_continuation(spark):
    rows = [("Led a team", "and others", True), ("Tools:", "python", False), ("multi-", "Line", False), ("multi-", "line", True), ("x", "- y", False), ("x", "2019 role", False), ("", "a", False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string")
    assert [r[0] for r in df.select(headings.is_continuation(F.col("a"), F.col("b"))).collect()] == [w for _, _, w in rows]


def test_dates(value):
    got = value(dates.date_range, "Jan 2021 - Present", "2015 - 2019", "2019-09", "2013-17", "March 2020 to 5 2021", "nothing", "", None)
    assert [tuple(r)[:5] for r in got] == [
        ("January", "2021", "", "", True), ("", "2015", "", "2019", False), ("September", "2019", "", "", False), ("", "2013", "", "2017", False), ("March", "2020", "May", "2021", False),
        ("", "", "", "", False), ("", "", "", "", False), ("", "", "", "", False),
    ]
    assert [len(r.issues) for r in got] == [0, 0, 0, 0, 0, 1, 0, 0]
    assert value(dates.month, "Sept.", "09", "13", None) == ["September", "September", "", ""]
    assert value(dates.year, "2013-17", "2019-09", "in 1999", "x") == ["2017", "2019", "1999", ""]
    assert value(dates.achieved_date, "Aug 2020", "2018", "soon") == ["August 2020", "2018", ""]


def test_entities(value):
    assert value(entities.emails, "A@b.co a@B.co, c.d@e.org", None) == [["A@b.co", "c.d@e.org"], []]
    assert value(entities.first_phone, "call (555) 123-4567 now", "12", None) == ["5551234567", "", ""]
    assert value(entities.normalize_url, "linkedin.com/in/ann-b", "example.org/x", "plain", None) == ["https://www.linkedin.com/in/ann-b", "https://example.org/x", "", ""]
    assert value(entities.is_email, "a@b.co", "not-an-email") == [True, False] and value(entities.is_phone, "82.5%", "+1 555 123 4567") == [False, True]


def test_quality_just_below_a_half_is_rounded_down(value):
    """410 characters in 74 words: 0.164 + 0.111 + 0.3 is 0.575 in digits, and less than that as a number."""
    text = " ".join(["abcd"] * 73 + ["a" * 45])
    assert len(text) == 410 and value(scores.text_quality, text) == [0.57]


def test_scores(spark, value):
    assert value(scores.clamp, 1.5, -1.0, None, 0.12345, kind="double") == [1.0, 0.0, 0.0, 0.1235]
    assert value(scores.text_quality, "", None, "a b c") == [0.0, 0.0, 0.31]
    pick = lambda *v: tuple(spark.range(1).select(scores.choose_best(*map(F.lit, v))).first()[0])
    assert pick("iso", 0.3, "", 0.0) == ("iso", 0.45) and pick("iso", 0.5, "ext", 0.6) == ("iso", pytest.approx(0.54)) and pick("iso", 0.3, "ext", 0.9) == ("ext", 0.9)
    assert pick("iso", 0.1, "ext", 0.0) == ("ext", 0.0)
    e = spark.range(1).select(scores.ensemble(*map(F.lit, (0.8, 0.0, 0.8, 0.0)))).first()[0]
    assert tuple(e) == (0.88, "regex") and tuple(spark.range(1).select(scores.ensemble(*[F.lit(0.0)] * 4)).first()[0]) == (0.0, "none")
    assert spark.range(1).select(scores.jaccard(F.lit("a b"), F.lit("B c"))).first()[0] == pytest.approx(1 / 3)
    assert spark.range(1).select(scores.overall_accuracy(F.array(F.lit(0.5), F.lit(0.0), F.lit(1.0)))).first()[0] == 75.0

"""Lines are told by the longest word in front of them, and extractors run once."""

import re

from pyspark.sql import functions as F

from scrivener.functions import headings
from scrivener.functions.text import longest_of
from scrivener.operators import sections
from scrivener.plans import queries


def test_words_share_what_they_begin_with():
    assert longest_of(["skills", "skill set", "skill", "it"]) == "(?:it|skill(?: set|s)?)"
    words = {w for s in sections.SECTIONS for w in (*s.headers, *s.stops)} | set(headings._FIRST)
    front = re.compile(longest_of(words))
    for line in [*words, *(f"{w}s and more" for w in words), *(w[:-1] for w in words), "qux"]:
        fits = [w for w in words if line.startswith(w)]
        assert (front.match(line) or [""])[0] == max(fits, key=len, default="")


def test_marks_tell_headers_and_stops_of_each_section(spark):
    """By bits: a word behind a sign heads (certifications: 40 characters), a stop that isn't loose needs a boundary, long lines are no headers."""
    lines = ["awards", "my awards", "skills", "skillset", "skills: a", "awards and " + "x" * 60]
    pair = [sections.BY_NAME[n] for n in ("awards", "experience")]
    got = spark.range(1).select(sections.marks(F.array(*map(F.lit, lines)), pair).alias("m")).first().m
    assert [(r.i, r.heads, r.stops) for r in got] == [(0, 1, 2), (1, 1, 0), (2, 0, 3), (3, 0, 2), (4, 0, 3), (5, 0, 2)]


def test_summary_ends_at_a_heading_and_passes_further_headers(spark):
    docs = spark.createDataFrame([(1, "EDUCATION\nSummary\nfirst\nObjective\nsecond\nSkills\nthird"), (2, "nothing"), (3, None), (4, "profile")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in sections.extract_summary(docs).collect()} == {1: "first second", 2: "", 3: "", 4: ""}


def test_isolated_sections_are_found_once_for_records(spark, sf):
    """What records read twice is a table."""
    assert any("/isolated-" in f for f in queries._records(spark, sf).inputFiles())

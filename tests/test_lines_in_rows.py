"""Documents as lines stay in their row: no window, no sort, and the same lines as one by one."""

import pytest
from pyspark.sql import functions as F

from scrivener.functions import headings as H
from scrivener.functions import text
from scrivener.operators import entries, lines

ODD = (
    "\n\n• Intro-\nduction line\n\n\n\nand then more\nSKILLS\n  sql, python  \nSQL, Python\nskills summary\n- \nwith a tail:\nlower after colon\nEXPERIENCE\nEngineer at Acme\n\n\n2015 - 2019\n"
    "EXPERIENCE \nAnalyst\nnotes-\n\nthen\nâ€¢ Education\nB.Tech, College\n\n"
)


def _docs(spark):
    return spark.createDataFrame([(1, ODD), (2, ""), (3, None), (4, "one\n\n\ntwo\n\n\n"), (5, "-\nx\n- - y\n z\n  \n")], "doc_id long, text string")


@pytest.mark.parametrize("made", [lines.headings_confidence, lines.full_text, lines.entry_chunks, lines.isolated_sections, lines.unmatched, lambda d: entries.parse_education(lines.isolated_sections(d))])
def test_a_document_stays_one_row(spark, made):
    plan = made(_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Exchange" not in plan


def test_text_of_rebuilt_lines_is_that_of_the_rows(spark):
    docs = _docs(spark)
    rows = {}
    for r in lines.rebuilt_lines(docs).orderBy("doc_id", "line_no").collect():
        rows.setdefault(r.doc_id, []).append(r.line)
    whole = {r.doc_id: r.t for r in docs.select("doc_id", lines.rebuilt_text(F.col("text")).alias("t")).collect()}
    assert {k: "\n".join(v).strip("\n") for k, v in rows.items()} == {k: v.strip("\n") for k, v in whole.items() if v}
    assert "Introduction line" in whole[1].replace("- ", "") and "sql, python" in whole[1]


def test_sections_are_those_of_the_lines(spark):
    docs = _docs(spark)
    by_line = lines.islands(lines.rebuilt_lines(docs)).filter("line <> '' and section is not null").select("doc_id", "section", F.lower("line").alias("l")).distinct().groupBy("doc_id", "section").count()
    by_text = lines.isolated_sections(docs).select("doc_id", "section", F.size(F.filter(F.split("text", "\n"), lambda x: x != "")).cast("bigint").alias("count"))
    assert sorted(by_line.collect()) == sorted(by_text.collect()) != []


def test_aliases_at_once_are_those_by_tail(spark):
    one = spark.createDataFrame([(a,) for a in H._ALL], "a string")
    got = {r.a: (r.quick, r.slow) for r in one.select("a", H.canonical(F.col("a")).alias("quick"), H.canonical(F.concat(F.lit(" "), F.upper("a"), F.lit(" :"))).alias("slow")).collect()}
    assert all(quick == slow and quick for quick, slow in got.values())


def test_bullets_and_copies(spark):
    one = spark.createDataFrame([("•  x  y\n* z\n  a\t b \n-\n\n- - c",)], "t string")
    assert one.select(text.bullet_lines("t").alias("t")).first().t == "- x y\n- z\na b\n- \n\n- - c"
    assert one.select(text.first_of(F.split(F.lit("b,a,,B,a,,c"), ","), lambda x: F.lower(x)).alias("a")).first().a == ["b", "a", "", "", "c"]
    assert one.select(text.strip(F.lit("  a b\x85\n")).alias("t")).first().t == "a b"

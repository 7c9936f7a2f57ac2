"""The tracking-system format, names, the generic extractor, keyword fallbacks, headed contacts, fallbacks by other extractors, reports."""

import pytest
from pyspark.sql import functions as F

from scrivener.operators import ats, feedback, names, sections, store
from scrivener.plans import documents

ATS_TEXT = """MARA QUILL | Software Engineer | Pune
mara@quill.example | (555) 010-9999
Python | Docker | c++ tools | Lead
Excel, sql, Machine Learning, 2019 notes
Senior Software Engineer | Acme | 2019 - 2021
Board | Chess | 2018
- Developed a parser
• led the team
- slept
EDUCATION
BS in Physics 2015
bs physics 2015
Mba 2018
- MBA 2019
SKILLS
BA History 2001"""


@pytest.fixture(scope="module")
def cv(spark):
    return spark.createDataFrame([(1, ATS_TEXT), (2, ""), (3, None), (4, "Experience:\nwork " * 30)], "doc_id long, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_ats_signs(cv):
    got = by_id(ats.is_ats(cv))
    assert (got[1].indicators, got[1].is_ats, got[1].likely) == (3, True, True)
    assert (got[2].indicators, got[2].is_ats, got[2].likely) == (0, False, False) == (got[3].indicators, got[3].is_ats, got[3].likely)
    assert not got[4].is_ats


def test_ats_skills(cv, spark):
    got = by_id(ats.skills(cv))
    words = got[1].text.split(", ")
    assert {"Docker", "Python", "c++ tools"} <= set(words) and "Lead" not in words and words == sorted(words) and got[1].confidence == min(1.0, round(0.3 + 0.05 * len(words), 2))
    assert "sql" in words and "machine learning" in words  # by pattern; a line with a year gives no parts
    assert (got[2].text, got[2].confidence) == ("", 0.0) == (got[3].text, got[3].confidence)
    comma = by_id(ats.skills(spark.createDataFrame([(1, "Pandas tricks, SQL, Tea"), (2, "Go | University | sql")], "doc_id long, text string")))
    assert comma[1].text == "Pandas tricks, SQL, pandas" and comma[2].text == "go, sql"


def test_ats_education_and_experience(cv):
    studies, jobs = by_id(ats.education(cv)), by_id(ats.experience(cv))
    assert studies[1].text == "BS Physics (2015)\nMBA (2018)" and studies[1].confidence == 0.8
    assert jobs[1].text.split("\n") == ["MARA QUILL | Software Engineer | Pune", "Senior Software Engineer | Acme | 2019 - 2021", "Board | Chess | 2018", "Developed a parser", "led the team"][1:]
    assert jobs[1].confidence == 0.8 and jobs[2].confidence == 0.0 and jobs[3].text == ""


def test_ats_names(spark):
    rows = [(1, "MARA QUILL | x"), (2, "Mara Quill\nx"), (3, "Design Engineer\nB C"), (4, "x\ny\nOtto van Fern"), (5, "x\nOtto Fern"), (6, None)]
    got = by_id(ats.name(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {k: (r.text, r.confidence) for k, r in got.items()} == {1: ("MARA QUILL", 0.85), 2: ("Mara Quill", 0.85), 3: ("Design Engineer", 0.7), 4: ("", 0.0), 5: ("Otto Fern", 0.7), 6: ("", 0.0)}
    assert ats.all_sections(spark.createDataFrame(rows, "doc_id long, text string")).count() == 30


def test_names(spark):
    rows = [
        (1, "MARA QUILL\nx"), (2, "Resume\nName: Mara Quill"), (3, "Software Engineer\nPune India\nMara Quill"), (4, "Dr. Otto Fern\nx"), (5, "a\nb\nc\nd\ne\nf\nMara Quill"), (6, ""), (7, None),
        (8, "mara@quill.example\nOtto B. Fern"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(names.names(docs))
    assert {k: r.name for k, r in got.items()} == {1: "Mara Quill", 2: "Mara Quill", 3: "Mara Quill", 4: "Otto Fern", 8: "Otto B. Fern"}
    assert got[1].confidence == 0.9 and got[1].method == "regex" and got[4].method == "heuristic"
    aware = by_id(names.names(docs, spark.createDataFrame([("otto",), ("Otto",)], "name string")))
    assert aware[4].confidence > got[4].confidence and aware[1].confidence == got[1].confidence
    model = spark.createDataFrame([(3, "nlp", "Otto Fern"), (1, "nlp", "Project Manager"), (6, "layoutlm", "Ines Brook")], "doc_id long, method string, name string")
    told = by_id(names.names(docs, recognised=model))
    assert told[6].name == "Ines Brook" and told[1].name == "Mara Quill" and told[3].name == "Mara Quill"


def test_sections_by_kind(spark):
    text = "SKILLS:\npython\nPython\n----\n2019\nEducational notes\nsql\nProjects\nbuilt an api\nLanguages\nEnglish"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.section): r for r in sections.by_kind(docs, ("skills", "projects", "languages", "awards")).collect()}
    assert got[1, "skills"].text == "python" and got[1, "projects"].text == "built an api"  # "Educational notes" begins with a heading
    assert got[1, "languages"].text == "English" and got[1, "awards"].confidence == 0.0 == got[2, "skills"].confidence
    assert got[1, "skills"].confidence == round(0.06 + 0.08 + 6 / 200 * 0.3, 2)


def test_keywords_where_no_heading_is(spark):
    text = "Mara\nSummary of work\nWon the gold prize\nGolden Days\nAWS course\nx\n\nDr. Reed, professor\nWon the gold PRIZE"
    docs = spark.createDataFrame([(1, text), (2, "Awards\nbest in class"), (3, "")], "doc_id long, text string")
    got = {(r.doc_id, r.section): r.text for r in sections.extract_sections(docs, [sections.BY_NAME[s] for s in ("awards", "certifications", "references")]).collect()}
    assert got[1, "awards"] == "Won the gold prize\nDr. Reed, professor" and got[1, "certifications"] == "Golden Days\nAWS course"
    assert got[1, "references"] == "Dr. Reed, professor" and got[2, "awards"] == "best in class" and got[3, "awards"] == ""


def test_contacts_under_headings_first(spark):
    rows = [(1, "Email\nmara@quill.example\nSkills\nsql\nother@quill.example"), (2, "write to a@b.example or c@d.example"), (3, None)]
    got = {(r.doc_id, r.section): r for r in documents.entity_sections(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, "email"].text == "mara@quill.example" and got[2, "email"].text == "a@b.example\nc@d.example" and got[3, "email"].text == "" and len(got) == 9
    assert got[1, "email"].confidence == round((0.3 + 18 / 50 * 0.4) * 1.2, 2)


def test_other_extractors_step_in(spark, cv):
    found = cv.select("doc_id", F.lit("skills").alias("section"), F.lit("x").alias("text"), F.lit(0.1).alias("confidence"))
    alone = spark.createDataFrame([(1, "education", "y", 0.9)], "doc_id long, section string, text string, confidence double")
    got = by_id(documents.with_ats(found, alone, cv, 0.5))
    assert "Docker" in got[1].text and got[2].text == "x" == got[4].text and len(got) == 4
    better = by_id(documents.with_model(found, cv, lambda texts: [{"skills": (t[:4], 0.5)} if t else {} for t in texts]))
    assert better[1].text == "MARA" and better[3].text == "x" and better[1].confidence == 0.5
    sure = found.withColumn("confidence", F.lit(0.8))
    assert by_id(documents.with_model(sure, cv, lambda texts: [{"skills": ("m", 0.9)}] * len(texts)))[1].text == "x"


def test_unknown_version_changes_nothing(spark):
    rows = [("m", "1", "active"), ("m", "2", "staged")]
    versions = spark.createDataFrame(rows, "model_name string, version_id string, status string")
    assert {r.version_id: r.status for r in store.deploy(versions, "m", "9").collect()} == {"1": "active", "2": "staged"}
    assert {r.version_id: r.status for r in store.deploy(versions, "m", "2").collect()} == {"1": "archived", "2": "active"}


def test_manual_examples_reports_and_timings(spark, tmp_path):
    rows = spark.createDataFrame([("name", "a", "A"), ("email", "b", "B")], "field_name string, text string, label string")
    for _ in range(2):
        store.add_manual(rows, str(tmp_path / "manual"))
    back = store.read_manual(spark, str(tmp_path / "manual"))
    assert back.count() == 4 and {(r.field_name, r.label, r.verified) for r in back.collect()} == {("name", "A", True), ("email", "B", True)}
    report = spark.createDataFrame([("name", 3, 0.5), ("email", None, 0.25)], "field_name string, total long, rate double")
    for _ in range(2):
        store.save_report(report, str(tmp_path / "report"))
    assert sorted(map(tuple, store.load_report(spark, str(tmp_path / "report"), report).collect())) == [("email", None, 0.25), ("name", 3, 0.5)]
    timed = {r.name: r for r in store.timings(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "name string, seconds double")).collect()}
    assert (timed["a"]["count"], timed["a"].total, timed["a"].avg, timed["a"].min, timed["a"].max) == (2, 4.0, 2.0, 1.0, 3.0)


def test_readers_by_key(spark):
    rows = [(1, "name", "2024-01-01", "pending"), (1, "email", "2024-01-02", "approved"), (2, "name", None, "approved")]
    f = spark.createDataFrame(rows, "resume_id long, field_name string, timestamp string, status string")
    assert [r.field_name for r in feedback.of_resume(f, 1).collect()] == ["email", "name"] and [r.resume_id for r in feedback.of_field(f, "name").collect()] == [1, 2]
    assert feedback.count_samples(f) == 3 and feedback.count_samples(f, "approved") == 2


def test_lines_are_marked_once_for_all_sections(spark):
    """Only lines with a header's or stop's word in front, or a header's word behind a sign, are looked at again; a section of one's own has its own words."""
    from dataclasses import replace

    lines = ["some prose", "awards and prizes", "Won a medal", "my skills: many", "plain", "qux words", "inside", "end here"]
    lows = F.array(*map(F.lit, lines))
    got = spark.range(1).select(sections.marks(lows, sections.SECTIONS).alias("m")).first().m
    assert [r.i for r in got] == [1]
    own = replace(sections.BY_NAME["awards"], name="own", headers=("qux",), stops=("end",), keywords=(), inner=0)
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    assert [(r.section, r.text) for r in sections.extract_sections(docs, [own]).collect()] == [("own", "inside")]


def test_keywords_share_their_word_boundary():
    assert sections._any_word((r"\bab\b", r"\b(c|d)\b", "ef")) == r"\b(?:ab|(c|d))\b|ef"

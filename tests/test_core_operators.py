"""Operators on small tables: feedback, sections, entries, records, stores, layout, files and streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from scrivener.operators import entries, feedback, layout, lines, schema, sections, similarity, store
from scrivener.plans import documents
from scrivener.sources import files
from scrivener.streaming import feedback as stream

TEXT = """Name: Ann Lee
ann@example.org
SUMMARY
Experienced analyst
with many years of work

Work Experience
Data engineer at Blue Ltd
Jan 2020 - Present
- developed pipelines

Manager 2015 - 2018
Awards
Won a prize
2017
won a PRIZE
Education
B.Tech, State University 2010
GPA 8
"""


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "doc_id long, text string")


def sample(k, original, corrected, kind="correction", status="approved", confidence=0.5, field="name"):
    return (str(k), 1, field, original, corrected, confidence, kind, status, f"2024-01-{k:02d}", str(k))


SCHEMA = "sample_id string, resume_id long, field_name string, original_value string, corrected_value string, confidence_before double, feedback_type string, status string, ts string, seq string"


def corrections(spark, rows):
    return {(r.field_name, r.original_norm): r.corrected for r in feedback.safe_corrections(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_votes(spark):
    assert corrections(spark, [sample(1, "x", "A"), sample(2, " X ", "a"), sample(3, "x", "a"), sample(4, "x", "b")]) == {("name", "x"): "a"}
    assert corrections(spark, [sample(1, "x", "a"), sample(2, "x", "b")]) == {}
    assert corrections(spark, [sample(1, "x", "a")]) == {("name", "x"): "a"}
    assert corrections(spark, [sample(1, "x", "a"), sample(2, "x", "a"), sample(3, "x", "")]) == {}
    assert corrections(spark, [sample(1, "x", "a"), sample(2, "x", "z", "rejection")]) == {}
    assert corrections(spark, [sample(1, "x", "a"), sample(2, "x", "", status="rejected")]) == {("name", "x"): "a"}
    assert corrections(spark, [sample(1, "x", "X"), sample(2, "", "a")]) == {}
    assert corrections(spark, [sample(1, "x", "Abc"), sample(2, "x", "ABC")]) == {("name", "x"): "ABC"}


def test_calibration_edges(spark):
    rows = [sample(k, "x", "a" if k % 2 else "x", confidence=c) for k, c in enumerate((0.2, 0.4, 0.6, 0.8, 1.0, 0.19, None), 1)]
    profile = feedback.calibration_profile(spark.createDataFrame(rows, SCHEMA))
    assert {r.bin: r.total for r in profile.collect()} == {0: 2, 1: 1, 2: 1, 3: 1, 4: 2}
    values = spark.createDataFrame([("name", 1.0), ("name", 0.5), ("other", 0.5)], "field_name string, confidence double")
    got = {(r.field_name, r.confidence): r.calibrated for r in feedback.calibrate(values, profile).collect()}
    assert got == {("name", 1.0): 1.0, ("name", 0.5): pytest.approx(0.55 * 0.5 + 0.45), ("other", 0.5): 0.5}


def test_status_and_log(spark, tmp_path):
    good = {"sample_id": "a", "resume_id": 1, "field_name": "Name", "original_value": "x", "corrected_value": "y", "confidence_before": 0.4, "timestamp": "t", "extraction_context": {"feedback_id": "f1"}}
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps(good), "", "{broken", json.dumps(good | {"sample_id": "b", "status": "pending", "extraction_context": None})]))
    log = feedback.read_samples(spark, str(tmp_path / "log.jsonl"))
    assert [(r.sample_id, r.status, r.feedback_type, r.field_name) for r in log.filter("sample_id is not null").orderBy("sample_id").collect()] == [("a", "approved", "correction", "name"), ("b", "pending", "correction", "name")]
    ids = spark.createDataFrame([("f1",), ("zz",)], "id string")
    got = {r.sample_id: r.status for r in feedback.set_status(log.filter("sample_id is not null"), ids, "rejected").collect()}
    assert got == {"a": "rejected", "b": "pending"}
    with pytest.raises(ValueError):
        feedback.set_status(log, ids, "odd")


def test_headings_and_islands(docs):
    assert [(r.section, r.line_no) for r in lines.detect_headings(docs).orderBy("line_no").collect()] == [("summary", 2), ("experience", 6), ("awards", 12), ("education", 16)]
    rebuilt = [r.line for r in lines.rebuilt_lines(docs).filter("doc_id = 1 and line <> ''").orderBy("line_no").collect()]
    assert "Experienced analyst with many years of work" in rebuilt
    chunks = [(r.section, r.entry_no) for r in lines.entry_chunks(docs).orderBy("section", "entry_no").collect()]
    assert chunks == [("education", 1), ("experience", 1), ("experience", 2), ("experience", 3)]
    assert {r.doc_id: r.confidence for r in lines.unmatched(docs).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}


def test_every_line_is_in_one_section(docs):
    all_lines = lines.rebuilt_lines(docs).filter("line <> ''")
    parts = lines.islands(lines.rebuilt_lines(docs)).filter("line <> ''")
    heads = 4
    assert parts.count() + heads == all_lines.count() and parts.select("doc_id", "line_no").distinct().count() == parts.count()


def test_sections(docs):
    got = {(r.doc_id, r.section): (r.text, r.confidence) for r in sections.extract_sections(docs).collect()}
    assert got[(1, "awards")][0] == "Won a prize" and got[(1, "education")][0] == "B.Tech, State University 2010\nGPA 8"
    assert all(v == ("", 0.0) for (d, _), v in got.items() if d != 1) and all(0 <= c <= 1 for _, c in got.values())
    assert len(got) == 3 * len(sections.SECTIONS)
    skills = sections.extract_skills(docs.sparkSession.createDataFrame([(1, "Skills\nPython, SQL\n& Spark\nEducation\nX\nTechnical Skills:\nTools: git\nDeveloped a thing")], "doc_id long, text string")).first()
    assert skills.text == "Python, SQL & Spark\nTools: git"


def test_entries(spark):
    rows = lambda t: spark.createDataFrame([(1, t), (2, "")], "doc_id long, text string")
    jobs = entries.parse_experience(rows("Data engineer at Blue Ltd\nJan 2020 - Present\n- made pipelines\n\nManager 2015 - 2018\nGreen Bank\nled people")).orderBy("entry_no").collect()
    assert [(r.title, r.company) for r in jobs] == [("Data engineer at Blue Ltd", "Blue Ltd"), ("Manager 2015 - 2018", "Green Bank")]
    assert jobs[0].description == "- made pipelines" and jobs[1].duration == "Manager 2015 - 2018"
    edu = entries.parse_education(rows("B.Tech\nState University\n2010 - 2014\nGPA 8\nMaster of Arts\n\nnothing")).orderBy("entry_no").collect()
    assert [(r.level, r.year, r.institution, r.grade) for r in edu] == [("bachelors", "2010 - 2014", "State University", "GPA 8"), ("masters", None, None, None)]
    assert {r.skill: r.category for r in entries.parse_skills(rows("Python; git, tea")).collect()} == {"python": "programming_languages", "git": "tools", "tea": "other"}
    p = entries.parse_projects(rows("Shop\n- built with React, see github.com/x\n\nBlog")).orderBy("entry_no").collect()
    assert [(r.name, r.technologies, r.link) for r in p] == [("Shop", ["react"], "github.com"), ("Blog", None, None)]
    c = entries.parse_certifications(rows("AWS developer 2020\nother")).collect()
    assert [(r.name, r.year, r.issuer) for r in c] == [("AWS developer 2020", "2020", "Aws"), ("other", None, None)]


def test_records(spark, docs):
    found = documents.resolve(documents.all_sections(docs), lines.isolated_sections(docs))
    r = {x.doc_id: x for x in documents.records(docs, found).collect()}
    assert r[1].personal_information.name == "Ann Lee" and r[1].personal_information.email == "ann@example.org" and r[1].is_valid and r[2].skills == {"items": []}
    b = schema.builder_errors(schema.to_builder(documents.records(docs, found))).filter("doc_id = 1").first()
    assert b.personal.firstName == "Ann" and b.personal.lastName == "Lee" and b.is_valid
    odd = spark.range(1).select(F.lit(1).alias("doc_id")).withColumn("work_experience", F.array(F.lit(None)).cast(schema.V1["work_experience"]))
    bad = schema.v1_errors(schema.with_defaults(odd)).first()
    assert bad.errors == ["'work_experience[0]' must be object"] and not bad.is_valid and len(bad.warnings) == 7
    level = spark.createDataFrame([("French - basic",), ("Hindi (native)",), ("Greek",)], "x string").select(schema.language(F.col("x")).alias("l")).collect()
    assert [tuple(x.l) for x in level] == [("French", "Beginner"), ("Hindi", "Native"), ("Greek", "Intermediate")]
    job = spark.range(1).select(schema.job(F.lit("Blue Ltd"), F.lit("Data Engineer"), F.lit("Jan 2021 - Present"), F.lit("d")).alias("j")).first().j
    assert (job.title, job.employer, job.startMonth, job.startYear, job.endYear, job.current) == ("Data Engineer", "Blue Ltd", "January", "2021", "", True)


def test_store(spark):
    d = spark.createDataFrame([(1, "a.txt", 5), (2, "a.txt", 6), (3, "b.txt", 1)], "id long, filename string, created_at long")
    assert {r.id for r in store.latest(d, "filename", "created_at", "id").collect()} == {2, 3}
    assert {r.id for r in store.delete_newest(d, "a.txt").collect()} == {1, 3}
    changes = spark.createDataFrame([(1, "c.txt"), (3, None)], "id long, filename string")
    assert {r.id: r.filename for r in store.update(d, changes).collect()} == {1: "c.txt", 2: "a.txt", 3: "b.txt"}
    assert {r.id for r in store.without_file(d, spark.createDataFrame([("a.txt",)], "filename string")).collect()} == {3}
    v = spark.createDataFrame([("m", "1", "1", "active"), ("m", "2", "2", "staged")], "model_name string, version_id string, created_at string, status string")
    deployed = store.deploy(v, "m", "2")
    assert {r.version_id: r.status for r in deployed.collect()} == {"1": "archived", "2": "active"} and store.models(deployed).first().active_version == "2"
    assert {r.status for r in store.rollback(deployed, "m", "1").filter("version_id = '2'").collect()} == {"archived"}
    assert store.delete_version(v, "m", "1").count() == 2 and store.delete_version(v, "m", "2").count() == 1


@pytest.mark.parametrize("n", [0, 1, 10, 1003])
def test_split_sizes(spark, n):
    got = {r.part: r["count"] for r in store.split(spark.range(n).withColumnRenamed("id", "sample_id")).groupBy("part").count().collect()}
    a, b = int(n * 0.7), int(n * 0.15)
    assert {k: v for k, v in (("train", a), ("validation", b), ("test", n - a - b)) if v} == got


def test_similarity(spark):
    a = spark.createDataFrame([(1, "a b c d"), (2, "x y"), (3, ""), (4, None)], "doc_id long, text string")
    b = spark.createDataFrame([(7, "a b c e"), (8, "q"), (9, "A b")], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.jaccard for r in similarity.similar(a, b, 0.5).collect()} == {(1, 7): 0.6, (1, 9): 0.5}
    assert {(r.doc_id, r.item_id) for r in similarity.contained(a, b, 0.75).collect()} == {(1, 7), (1, 9)}


def test_layout(spark):
    left = [(1, 0, f"left {k}", 50.0, 690.0 - 20 * k, 250.0, 700.0 - 20 * k) for k in range(9)]
    right = [(1, 0, f"right {k}", 320.0, 690.0 - 20 * k, 520.0, 700.0 - 20 * k) for k in range(9)]
    e = spark.createDataFrame([*left, *right], "doc_id long, page_num int, text string, x0 double, y0 double, x1 double, y1 double")
    assert layout.columns(e).first().two_columns
    assert [r.text for r in layout.reading_order(e).orderBy("position").collect()] == [x[2] for x in [*left, *right]]
    one = e.filter("x0 < 100").withColumn("text", F.when(F.col("text") == "left 0", "Skills").otherwise(F.col("text")))
    assert layout.layout_sections(one).first().section == "skills"
    words = spark.createDataFrame([(1, 1, 1, 1, "b", "90", 20, 5, 10, 8), (1, 1, 1, 1, "a", "80", 0, 5, 10, 8), (1, 1, 1, 1, "", "80", 0, 5, 1, 1), (1, 1, 1, 1, "z", "-1", 0, 0, 1, 1), (1, 1, 1, 1, "y", "no", 0, 0, 1, 1)],
                                  "doc_id long, block_num int, par_num int, line_num int, text string, conf string, left int, top int, width int, height int")
    assert tuple(layout.word_lines(words).select("text", "left", "right", "confidence").first()) == ("a b", 0, 30, 0.85)
    assert "<div" in layout.to_html(e).first().html
    assert spark.range(1).select(layout.strip_html(F.lit("<p>a&amp;b<script>x</script> <b>c</b>"))).first()[0] == "a&b c"


def test_files(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("﻿naïve".encode())
    (tmp_path / "b.txt").write_bytes("cafés".encode("cp1252"))
    (tmp_path / "c.rtf").write_bytes(rb"{\rtf1\ansi Hello \b world}")
    (tmp_path / "d.exe").write_bytes(b"x")
    (tmp_path / "e.pdf").write_bytes(b"x")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "g.docx").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.TXT"] == ("naïve", None) and got["b.txt"][0] == "cafés" and got["c.rtf"][0] == "Hello world" and got["f.docx"][0] == "One\na | b"
    assert got["d.exe"][1] == "unsupported file type" and got["e.pdf"][1] == "no reader for pdf" and got["g.docx"][1].startswith("BadZipFile")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = {"sample_id": "a", "field_name": "name", "original_value": "x", "corrected_value": "y", "confidence_before": 0.4, "feedback_type": "correction", "status": "approved", "timestamp": "2024-01-01 00:00:00"}
    (tmp_path / "in" / "1.json").write_text(json.dumps(row) + "\n" + json.dumps(row | {"sample_id": "b"}))
    for _ in range(2):
        stream.keep_current(stream.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "reports"), str(tmp_path / "check")).awaitTermination(60)
        (tmp_path / "in" / "2.json").write_text(json.dumps(row | {"sample_id": "c"}))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3
    assert spark.read.parquet(str(tmp_path / "reports" / "corrections")).first().corrected == "y"

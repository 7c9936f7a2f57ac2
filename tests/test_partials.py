"""Studies that complete one another, certificates in running text, payloads before they have types, metrics of a run."""

import json
import random
import re

from pyspark.sql import functions as F

from scrivener.operators import partials, payload
from scrivener.plans.observed import RunMetrics

STUDY = "doc_id long, entry_no long, " + ", ".join(f"{c} string" for c in partials.STUDY)


def greedy(rows):
    """In order: a row that isn't used yet takes its blanks from all later unused rows that belong to it, and uses them up."""
    used, out = set(), []
    low = lambda x: (x or "").lower()
    for i, a in enumerate(rows):
        if i in used:
            continue
        used.add(i)
        d, s, merged = low(a["degree"]), low(a["school"]), dict(a)
        for j in range(len(rows)):
            if j in used:
                continue
            e, t = low(rows[j]["degree"]), low(rows[j]["school"])
            if (d and d == e) or (s and s == t) or (d and not s and t) or (s and not d and e):
                used.add(j)
                for c in partials.STUDY:
                    merged[c] = merged[c] or rows[j][c]
        out.append(tuple(merged[c] or "" for c in partials.STUDY))
    return out


def test_partial_studies(spark):
    rng, rows, want = random.Random(1), [], set()
    for doc in range(80):
        own = [{c: rng.choice(["", None, *v]) for c, v in zip(partials.STUDY, (["Diploma", "diploma", "Master"], ["Law"], ["North", "South"], ["8.1", "7"], ["May"], ["2001", "2009"], [""]), strict=True)} for _ in range(rng.randint(1, 6))]
        rows += [(doc, n, *s.values()) for n, s in enumerate(own)]
        want |= {(doc, n + 1, *s) for n, s in enumerate(greedy(own))}
    rng.shuffle(rows)
    got = partials.merge_partial_studies(spark.createDataFrame(rows, STUDY).repartition(3))
    assert {(r.doc_id, r.entry_no, *[r[c] or "" for c in partials.STUDY]) for r in got.collect()} == want
    # a plain grouping by degree or school would join the first and the last
    chain = [(1, 1, "Diploma", None, "North", None, None, None, None), (1, 2, "Master", None, "North", "8", None, None, None), (1, 3, "Master", None, "South", None, None, "2009", None)]
    found = partials.merge_partial_studies(spark.createDataFrame(chain, STUDY)).orderBy("entry_no").collect()
    assert [(r.degree, r.school, r.gpa, r.gradYear) for r in found] == [("Diploma", "North", "8", None), ("Master", "South", None, "2009")]
    assert partials.merge_partial_studies(spark.createDataFrame([], STUDY)).count() == 0


CERT = re.compile(r"[A-Z][A-Za-z0-9 .&+/-]{2,80}?(?:Certification|Certificate|Internship Program|Web Development)", re.I)


def scanned(text):
    """Names and the text behind each up to the next, by a scan over match positions."""
    found = list(CERT.finditer(text))
    return [(m[0].strip(" -"), text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)].strip(" -,")) for k, m in enumerate(found)]


def test_certificates(spark):
    rng, texts = random.Random(2), []
    for _ in range(60):
        names = [rng.choice(["Cloud Basics Certification", "Data Analysis Certificate", "Full Stack Web Development", "Tax Law Certificate"]) for _ in range(rng.randint(0, 4))]
        texts.append(" ".join(f"{n} {rng.choice(['Norwood', 'Fern Online', ''])} {rng.choice(['2020', 'Mar 2019', ''])}" for n in names))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(c["name"], c["issuingOrg"], c["achievedDate"]) for c in r.c] for r in rows.select("doc_id", partials.certificates(F.col("text")).alias("c")).collect()}
    for k, text in enumerate(texts):
        want = []
        for name, tail in scanned(" ".join(text.split())):
            year, month = re.search(r"20\d\d", tail), "March " if "Mar " in tail else ""
            year_in_name = re.search(r"20\d\d(.*)", name)
            name = year_in_name[1].strip() if year_in_name and "certification" in name.lower() else name
            want.append((name, re.sub(r"\s+", " ", re.sub(r"\bMar\b|20\d\d", "", tail)).strip(), f"{month}{year[0]}" if year else ""))
        want = [w for w in want if 2 <= len(w[0].split()) <= 12]
        assert got[k] == want, text


def test_certificates_end_and_are_none(spark):
    rows = [(1, "Cloud Certification Norwood 2020 a@b.co Data Certificate"), (2, "Cloud Certification Norwood PROFESSIONAL SUMMARY Data Certificate"), (3, None), (4, ""), (5, "plain words"), (6, "one two three four five Internship Program Norwood 2021"), (7, "My summary Certificate")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.expr("1").alias("x"), partials.certificates(F.col("text")).alias("c"))
    got = {r.doc_id: [tuple(c) for c in r.c] for r in df.collect()}
    assert got[1] == got[2][:1] == [("Cloud Certification", "Norwood", "2020")] or got[2] == [("Cloud Certification", "Norwood", "")]
    assert got[3] == got[4] == got[5] == got[7] == [] and got[6] == [("four five Internship Program", "Norwood", "2021")]


GOOD = {
    "personal": {k: "" for k in payload.PERSONAL} | {"websites": ["x"]}, "summary": "", "skills": ["a"], "template": "t", "_meta": {"local_resume_id": 1}, "file_type": "pdf",
    "education": [{k: "" for k in payload.KEYS["education"]}], "experience": [{k: "" for k in payload.KEYS["experience"]} | {"current": False, "lastTemplateIndex": 0, "startMonth": "May", "startYear": "2001"}],
    "projects": [{k: "" for k in payload.KEYS["projects"]}], "certifications": [{k: "" for k in payload.KEYS["certifications"]} | {"achievedDate": "May 2001"}], "languages": [{"name": "x", "level": "Fluent"}],
}


def changed(path, value):
    made = json.loads(json.dumps(GOOD))
    at = made
    for p in path[:-1]:
        at = at[p]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return made


def test_payloads(spark):
    """Broken payloads and what is said of them."""
    cases = [
        (GOOD, []), (changed(["summary"], KeyError), ["root missing keys: ['summary']"]), (changed(["more"], 1), ["root has unsupported keys: ['more']"]), ([1], ["root must be an object"]), ("x", ["root must be an object"]),
        (changed(["personal"], []), ["personal must be an object"]), (changed(["personal", "city"], 5), ["personal.city must be a string"]), (changed(["personal", "zip"], ""), ["personal has unsupported keys: ['zip']"]),
        (changed(["personal", "websites"], "x"), ["personal.websites must be an array"]), (changed(["personal", "websites"], ["a", 1, None]), ["personal.websites[1] must be a string", "personal.websites[2] must be a string"]),
        (changed(["personal", "email"], KeyError), ["personal missing keys: ['email']", "personal.email must be a string"]), (changed(["summary"], None), ["summary must be a string"]), (changed(["skills"], {"a": 1}), ["skills must be an array"]),
        (changed(["education"], "x"), ["education must be an array"]), (changed(["education", 0, "gradYear"], "99"), ["education[0].gradYear must be '' or a four-digit year"]),
        (changed(["education", 0, "gradMonth"], "may"), ["education[0].gradMonth must be one of the canonical month values or ''"]), (changed(["education", 0], 7), ["education[0] must be an object"]),
        (changed(["education", 0, "gradYear"], 2001), ["education[0].gradYear must be '' or a four-digit year"]), (changed(["experience", 0, "current"], "no"), ["experience[0].current must be boolean"]),
        (changed(["experience", 0, "startYear"], 2001), ["experience[0].startYear must be a string", "experience[0].startYear must be '' or a four-digit year"]),
        (changed(["experience", 0, "lastTemplateIndex"], 1.5), ["experience[0].lastTemplateIndex must be integer"]), (changed(["experience", 0, "lastTemplateIndex"], True), []), (changed(["experience", 0, "lastTemplateIndex"], 10**30), []),
        (changed(["projects", 0, "tools"], ["a"]), ["projects[0].tools must be a string"]), (changed(["certifications", 0, "achievedDate"], "05/2001"), ["certifications[0].achievedDate must be '', 'YYYY', or 'Month YYYY'"]),
        (changed(["languages", 0, "level"], "Great"), ["languages[0].level must be one of ['Advanced', 'Beginner', 'Fluent', 'Intermediate', 'Native']"]), (changed(["languages", 0, "level"], None), ["languages[0].level must be a string"]),
        (changed(["_meta"], 1), ["_meta must be an object"]), (changed(["_meta", "more"], 1), ["_meta must only contain local_resume_id"]), (changed(["_meta", "local_resume_id"], "1"), ["_meta.local_resume_id must be integer"]),
        (changed(["file_type"], 1), ["file_type must be a string"]), (changed(["education"], []), []),
    ]
    rows = [(k, json.dumps(p)) for k, (p, _) in enumerate(cases)] + [(900, None), (901, "{broken")]
    got = {r.doc_id: (r.errors, r.is_valid) for r in payload.payload_errors(spark.createDataFrame(rows, "doc_id long, payload string")).collect()}
    for k, (_, want) in enumerate(cases):
        assert got[k] == (want, not want)
    assert got[900] == got[901] == (["payload is no JSON"], False)


def test_run_metrics(spark):
    m = RunMetrics()
    for n in (10, 1000, 0):
        df = m.watch(spark.range(n).withColumn("v", F.when(F.col("id") % 2 == 0, F.col("id") * 1.5)), "read", {"v": F.col("v")})
        df.write.format("noop").mode("overwrite").save()
    m.watch(spark.range(7), "other").collect()
    even = [x * 1.5 for n in (10, 1000) for x in range(0, n, 2)]
    assert m.stats("read") == {"rows": {"count": 3, "total": 1010, "avg": 1010 / 3, "min": 0, "max": 1000}, "v": {"count": len(even), "total": sum(even), "avg": sum(even) / len(even), "min": 0.0, "max": max(even)}}
    assert m.all_stats()["other"]["rows"]["total"] == 7 and m.stats("unknown") == {}
    m.clear()
    assert m.all_stats() == {}

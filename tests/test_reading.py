"""Element dumps and the ladder of readers."""

import json
import random

from pyspark.sql import functions as F

from scrivener.functions.scores import text_quality
from scrivener.sources import elements
from scrivener.sources.ladder import by_document, read_ladder


def boxes(spark, docs=6, pages=5):
    rng = random.Random(1)
    rows = [(d, p, f"d{d} p{p} n{n} é", float(n), float(n), n + 1.0, n + 2.0, rng.choice([None, 9.5])) for d in range(docs) for p in range(1, pages + 1) for n in range(rng.randint(1, 4))]
    return spark.createDataFrame(rows, "doc_id long, page_num int, text string, x0 double, y0 double, x1 double, y1 double, font_size double"), rows


def test_dumps_come_back(spark, tmp_path):
    df, rows = boxes(spark)
    elements.write_dumps(df, f"file://{tmp_path}/d")
    assert sorted(p.name for p in (tmp_path / "d").iterdir()) == [f"{d}.elements" for d in range(6)]
    got = elements.read_dumps(spark, f"file://{tmp_path}/d")
    assert sorted((r.doc_id, r.page_num, r.text, r.x0, r.y0, r.x1, r.y1, r.font_size) for r in got.collect()) == sorted(rows, key=lambda r: r[:4])
    assert elements.rejects(spark, f"file://{tmp_path}/d").count() == 0


def test_only_pages_asked_for_are_read(spark, tmp_path):
    """All pages but the second are broken: reading the second meets none of them, by option and by filter."""
    df, rows = boxes(spark)
    path = f"file://{tmp_path}/d"
    elements.write_dumps(df, path)
    for file in (tmp_path / "d").iterdir():
        head, *pages = file.read_bytes().split(b"\n")
        file.write_bytes(b"\n".join([head] + [x if b" p2 " in x else b"#" * len(x) for x in pages]))
    second = sorted(r[2] for r in rows if r[1] == 2)
    assert sorted(r.text for r in elements.read_dumps(spark, path, "2").collect()) == second
    assert elements.rejects(spark, path).count() == 6 * 4
    told = spark.read.format(elements.FORMAT).load(path)
    assert sorted(r.text for r in told.filter("page_num = 2").collect()) == second
    assert told.filter("page_num in (2, 9) and doc_id = 3").filter("error is not null").count() == 0
    assert told.filter("page_num > 1 and page_num < 3").filter("error is not null").count() == 0


def test_broken_files_are_rejects(spark, tmp_path):
    df, rows = boxes(spark, docs=2)
    elements.write_dumps(df, f"file://{tmp_path}/d")
    for name, content in {"a": b"", "b": b"{no json\n[]", "c": b'{"pages": []}\n', "e": json.dumps({"doc_id": 9, "pages": [[1, 0, 14], [2, 14, 900]]}).encode() + b'\n[{"text": 1}]\n[]'}.items():
        (tmp_path / "d" / f"{name}.elements").write_bytes(content)
    (tmp_path / "d" / "other.txt").write_text("not a dump")
    bad = elements.rejects(spark, f"file://{tmp_path}/d").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.doc_id, r.page_num) for r in bad if r.path.rsplit("/", 1)[1][0] in "abc") == [("a.elements", None, None), ("b.elements", None, None), ("c.elements", None, None)]
    assert (9, 1) in {(r.doc_id, r.page_num) for r in bad} and elements.read_dumps(spark, f"file://{tmp_path}/d").filter("doc_id < 2").count() == len(rows)


def test_a_large_dump_is_shared_by_pages(spark, tmp_path):
    df, rows = boxes(spark, docs=1, pages=40)
    elements.write_dumps(df, f"file://{tmp_path}/d")
    reader = elements.ElementReader(f"file://{tmp_path}/d", None, 500)
    shares = reader.partitions()
    assert len(shares) > 5
    got = [list(reader.read(s)) for s in shares]
    assert sorted(r[4] for s in got for r in s) == sorted(r[2] for r in rows) and max(map(len, got)) < len(rows) / 3


def quality(spark, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.q for r in rows.select("k", text_quality(F.col("t")).alias("q")).orderBy("k").collect()]


def test_ladder(spark):
    """Choices are those of one document after another; each reader sees what the rungs before it left open."""
    rng, rows = random.Random(4), []
    sized = lambda: rng.choice(["", None, "short", "word " * 12, "many more words here " * 30, "many more words here " * 80])
    for k in range(120):
        rows.append((k, sized(), sized(), rng.choice([0.0, 0.02, 0.3, 0.75, 0.9]), rng.random() < 0.3, sized(), rng.choice([0.1, 0.4, 0.8]), sized()))
    docs = spark.createDataFrame(rows, "doc_id long, plain string, cols string, c_score double, two boolean, routed string, r_score double, scan string").repartition(3)
    seen = {name: spark.sparkContext.accumulator(0) for name in ("plain", "routed", "scan")}

    def counted(name, read):
        def one(row):
            seen[name].add(1)
            if row["doc_id"] % 50 == 49:
                raise OSError("broken page")
            return read(row)

        return by_document(one, ("doc_id", "plain", "routed", "r_score", "scan"))

    found = read_ladder(
        docs, counted("plain", lambda r: r["plain"]), lambda d: d.select("doc_id", F.col("cols").alias("text"), F.col("c_score").alias("confidence"), F.col("two").alias("two_columns")),
        counted("routed", lambda r: (r["routed"], r["r_score"])), counted("scan", lambda r: r["scan"]),
    )
    got = {r.doc_id: (r.text, round(r.confidence, 9), r.step) for r in found.collect()}
    found.count()
    rate = dict(zip({t or "" for r in rows for t in r[1:] if t is None or isinstance(t, str)}, quality(spark, list({t or "" for r in rows for t in r[1:] if t is None or isinstance(t, str)})), strict=True))
    asked = {"plain": 120, "routed": 0, "scan": 0}
    for k, plain, cols, c_score, two, routed, r_score, scan in rows:
        broken = k % 50 == 49
        text, score = ("" if broken else plain or ""), 0.0
        if cols and (c_score >= 0.04 or (two and c_score >= 0.35)):
            text, score = cols, c_score
        if len(text.strip()) > 50 and score <= 0:
            score = rate[text]
        if score >= 0.7 and len(text.strip()) >= 180:
            want = (text, score, "text")
        else:
            asked["routed"] += 1
            if not broken and routed and len(routed.strip()) > 50 and r_score >= max(score, 0.3):
                want = (routed, r_score, "routed")
            else:
                asked["scan"] += 1
                good = not broken and scan and len(scan.strip()) > 50
                want = (scan, rate[scan] * 0.8, "scanned") if good else (text, rate[text], "left")
        assert got[k] == (want[0], round(want[1], 9), want[2]), k
    assert {k: v.value for k, v in seen.items()} == asked
    assert read_ladder(docs.limit(0), counted("plain", lambda r: r["plain"])).count() == 0

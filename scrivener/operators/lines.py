"""Documents as lines: headings, wrapped lines, sections by gaps and islands, entries, isolated confidence.

A document is one row and so is its array of lines; only ``islands``, whose input is lines, has a window over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import headings as H
from ..functions.scores import share
from ..functions.text import bullet_lines, first_of, let, lines_of, normalize_document, sessions, strip


def doc_order() -> WindowSpec:
    """The lines of a document in their order."""
    return Window.partitionBy("doc_id").orderBy("line_no")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), line (stripped). A null text has one empty line."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(lines_of(F.col(text_col))).alias("line_no", "line")).withColumn("line", strip(F.col("line")))


def _headings(text: Column) -> Column:
    """Array of (line_no, section, line) of the headings with content in the next four lines."""

    def followed(a: Column, i: Column) -> Column:
        """The first of the next lines that is not blank decides: a heading says no, more than two characters say yes; shorter ones are passed over."""
        decides = F.filter(F.slice(a, i + 2, 4), lambda r: (r["line"] != "") & (r["section"].isNotNull() | (F.length(r["line"]) > 2)))
        return F.coalesce(F.get(decides, F.lit(0))["section"].isNull() & (F.size(decides) > 0), F.lit(False))

    rows = F.transform(lines_of(text), lambda x, i: let(strip(x), lambda s: F.struct(i.alias("line_no"), H.canonical(s).alias("section"), s.alias("line"))))
    found = let(rows, lambda a: F.filter(a, lambda r, i: r["section"].isNotNull() & followed(a, i)))
    same = lambda r: F.concat_ws(":", r["section"], H.normalize_line(r["line"]))
    return first_of(found, same)


def detect_headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no, section, line of headings with content in the next four lines; distinct by section and normal form.

    The first of the next lines that is not blank decides: a heading says no, more than two characters say yes; shorter
    ones are passed over.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(_headings(F.col(text_col))))


def headings_confidence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_headings, confidence of every document with a heading."""
    distinct = lambda of: F.size(F.array_distinct(F.transform("found", of)))
    found = docs.select(F.col(id_col).alias("doc_id"), F.length(text_col).alias("chars"), F.explode(F.filter(F.array(_headings(F.col(text_col))), lambda a: F.size(a) > 0)).alias("found"))
    counts = found.select("doc_id", "chars", F.size("found").cast("bigint").alias("n_headings"), distinct(lambda r: r["section"]).alias("sections"), distinct(lambda r: F.lower(F.trim(r["line"]))).alias("titles"))
    score = H.headings_confidence(F.col("sections"), F.col("titles"), F.col("n_headings"), F.col("chars"))
    return counts.select("doc_id", "n_headings", score.alias("confidence"))


def _rebuilt(text: Column) -> Column:
    """Array of (line_no, line): cleaned lines with wrapped ones joined again; runs of blank lines as one.

    Whether a line goes on depends on the end of the line before alone, so every line that does not go on begins a session.
    """

    def marked(a: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(a, i - 1), F.lit(""))
            used = (x != "") | (before != "")  # of a run of blank lines the first
            on = lambda g: F.struct(i.alias("line_no"), x.alias("line"), g.alias("goes_on"), (g & before.endswith("-")).alias("glued"))
            return F.when(used, let(H.is_continuation(before, x), on))

        return F.filter(F.transform(a, one), lambda r: r.isNotNull())

    def joined(part: Column) -> Column:
        # a glued line takes the hyphen before it away
        more = lambda a, p: F.when(p["glued"], F.concat(F.regexp_replace(a, "-$", ""), p["line"])).when(a == "", p["line"]).otherwise(F.concat_ws(" ", a, p["line"]))
        first = F.get(part, F.lit(0))
        return F.struct(first["line_no"].alias("line_no"), F.when(F.size(part) == 1, first["line"]).otherwise(F.aggregate(part, F.lit(""), more)).alias("line"))

    return F.transform(sessions(let(F.split(bullet_lines(normalize_document(text)), "\n"), marked), lambda r, _: ~r["goes_on"]), joined)


def rebuilt_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no, line: cleaned lines with wrapped ones joined again; runs of blank lines as one."""
    return docs.select(F.col(id_col).alias("doc_id"), F.inline(_rebuilt(F.col(text_col))))


def islands(docs_lines: DataFrame) -> DataFrame:
    """doc_id, line_no, line, section, heading: every line that is no heading with the section of the last heading before it, else null."""
    marked = docs_lines.withColumn("head", H.probable_heading(F.col("line")))
    last = F.last(F.when(F.col("head").isNotNull(), F.struct("head", "line")), ignorenulls=True).over(doc_order())
    return marked.withColumn("last", last).filter(F.col("head").isNull()).select("doc_id", "line_no", "line", F.col("last.head").alias("section"), F.col("last.line").alias("heading"))


def rebuilt_text(text: Column) -> Column:
    """As rebuilt_lines, in one text.

    Only what begins with a small letter, or follows a hyphen, may go on; such lines stay together and are looked at one by one.
    """

    def step(a: Column, x: Column) -> Column:
        on = H.is_continuation(F.when(a.endswith("\n"), "").otherwise(a), x)
        glued = F.concat(F.left(a, F.length(a) - 1), x)
        return F.when(on, F.when(a.endswith("-"), glued).otherwise(F.concat(a, F.lit(" "), x))).otherwise(F.concat(a, F.lit("\n"), x))

    def joined(g: Column) -> Column:
        rows = F.split(g, "\n")
        return F.when(g.contains("\n"), let(rows, lambda r: F.aggregate(F.slice(r, 2, F.size(r)), F.get(r, F.lit(0)), step))).otherwise(g)

    clean = F.regexp_replace(bullet_lines(normalize_document(text)), r"^\n+|(?<=\n\n)\n+", "")
    return F.array_join(F.transform(F.split(clean, r"(?<!-)\n(?!\p{Ll})"), joined), "\n")


def _blocks(text: Column) -> Column:
    """Array of (section, text) of the rebuilt lines: sections with a line that is not blank, each once, in their order.

    Section null is what stands before the first heading; headings are left out. Callers generate rows from the expression
    itself: a filter on a column of it would be pushed below and compute it twice.
    """

    def headed(p: Column) -> Column:
        first = F.substring_index(p, "\n", 1)
        rest = F.when(p.contains("\n"), F.substring(p, F.length(first) + 2, F.length(p)))
        return let(H.probable_heading(first), lambda h: F.struct(h.alias("head"), F.when(h.isNull(), p).otherwise(rest).alias("text")))

    def block(part: Column) -> Column:
        return F.struct(F.get(part, F.lit(0))["head"].alias("section"), F.array_join(F.transform(part, lambda r: r["text"]), "\n").alias("text"))

    def merged(blocks: Column) -> Column:
        own = lambda s: F.array_join(F.transform(F.filter(blocks, lambda b: b["section"].eqNullSafe(s)), lambda b: b["text"]), "\n")
        names = F.array_distinct(F.transform(blocks, lambda b: b["section"]))
        return let(names, lambda n: F.when(F.size(n) == F.size(blocks), blocks).otherwise(F.transform(n, lambda s: F.struct(s.alias("section"), own(s).alias("text")))))

    found = F.transform(sessions(F.transform(H.parts(rebuilt_text(text)), headed), lambda r, i: (i == 0) | r["head"].isNotNull()), block)
    return let(F.filter(found, lambda b: F.replace(b["text"], F.lit("\n"), F.lit("")) != ""), merged)


def _without_blanks(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, "\n{2,}", "\n"), F.lit("\n"))


def unmatched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, confidence: the lines before the first heading; 0.5 if there are any, else 0."""
    before = F.get(F.filter(_blocks(F.col(text_col)), lambda b: b["section"].isNull()), F.lit(0))["text"]
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(_without_blanks(before), F.lit("")).alias("text"))
    return found.select("doc_id", "text", F.when(F.col("text") != "", 0.5).otherwise(0.0).alias("confidence"))


#: Words at which entries begin, and patterns of the isolated sections.
ROLES = "engineer|developer|analyst|manager|consultant|intern|lead|architect|specialist|director"
DEGREES = r"bachelor|master|phd|b\.tech|m\.tech|b\.e|m\.e|mba|diploma"
SCHOOLS = "university|college|institute|school"
PATTERNS = {
    "skills": (r"\b(python|java|javascript|sql|react|node|aws|docker|kubernetes)\b", r"\b(framework|library|tool|technology|platform)\b"),
    "education": (r"\b(university|college|institute|school)\b", r"\b(bachelor|master|phd|degree|gpa|cgpa)\b", r"\b(19|20)\d{2}\b"),
    "experience": (r"\b(19|20)\d{2}\b", r"\b(present|current|responsible|developed|managed|implemented)\b", r"\b(company|organization|team|role|project)\b"),
    "projects": (r"\b(project|developed|built|implemented|github|api|application)\b",),
    "certifications": (r"\b(certificate|certification|certified|aws|azure|gcp|pmp|scrum)\b",),
}


def starts_entry(line: Column, section: Column) -> Column:
    low = F.lower(line)
    work = low.rlike(r"\b(19|20)\d{2}\b") | low.rlike(ROLES) | line.rlike(r"\b(?:at|@)\s+[A-Z]")
    school = low.rlike(DEGREES) | low.rlike(SCHOOLS) | (low.rlike(r"\b(19|20)\d{2}\b") & (F.length(line) < 80))
    return F.when(section == "experience", work).when(section == "education", school).otherwise(F.lit(False))


def _sections(docs: DataFrame, id_col: str, text_col: str, only: Sequence[str] = ()) -> DataFrame:
    """doc_id, section, lines, chunks of headed sections with a line that is not blank; ``only`` those sections, if any are named.

    lines: repeated ones gone (first kept, whatever their case), blank ones kept as marks between entries. chunks: texts of the sessions of its lines; a section without entries is one session.
    """
    wanted = F.filter(_blocks(F.col(text_col)), lambda b: b["section"].isin(*only) if only else b["section"].isNotNull())
    inside = docs.select(F.col(id_col).alias("doc_id"), F.inline(wanted))
    inside = inside.select("doc_id", "section", first_of(F.split("text", "\n"), lambda x: F.lower(x)).alias("lines"))

    def starts(a: Column):
        return lambda x, i: (x != "") & ((F.coalesce(F.get(a, i - 1), F.lit("")) == "") | starts_entry(x, F.col("section")))

    full = lambda part: F.array_join(F.filter(part, lambda x: x != ""), "\n")
    entries = let(F.col("lines"), lambda a: F.transform(sessions(a, starts(a)), full))
    return inside.withColumn("chunks", F.when(F.col("section").isin("experience", "education"), entries).otherwise(F.array(full(F.col("lines")))))


def _entries(chunks: Column) -> Column:
    """Texts of up to two characters are no entries."""
    return F.filter(F.transform(chunks, lambda x: F.trim(x)), lambda x: F.length(x) > 2)


def entry_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section, entry_no (from 1), entry: sessions of the lines of experience and education.

    A new one begins at a line that starts an entry or after a blank line. Entries of up to two characters go.
    """
    inside = _sections(docs, id_col, text_col, ("experience", "education"))
    return inside.select("doc_id", "section", F.posexplode(_entries(F.col("chunks"))).alias("at", "entry")).select("doc_id", "section", (F.col("at") + 1).alias("entry_no"), "entry")


def isolated_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: Sequence[str] = ()) -> DataFrame:
    """doc_id, section, text, confidence, valid: sections by their headings, scored by words, patterns and entries.

    Sessions give the entries, and their texts in order the section. ``only``: these sections alone, if any are named.
    """
    of = lambda test: F.size(F.filter("lines", test))
    marks = of(lambda x: x.startswith("- ")) + of(lambda x: x.contains(",") | x.contains("|"))
    grouped = _sections(docs, id_col, text_col, only).withColumn("marks", marks)
    both = grouped.select("doc_id", "section", "marks", F.array_join("chunks", "\n").alias("lines_text"), F.when(F.col("section").isin("experience", "education"), _entries(F.col("chunks"))).alias("entries"))
    t = F.col("lines_text")
    words = F.size(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0)))
    pattern, shape = F.lit(0.0), F.lit(0.0)
    for name, ps in PATTERNS.items():
        found = sum((F.when(t.rlike(f"(?i){p}"), 1).otherwise(0) for p in ps), F.lit(0))
        pattern = F.when(F.col("section") == name, found / float(len(ps)) * 0.50).otherwise(pattern)
    shape = F.when(F.col("section").isin("experience", "education"), share(F.size("entries"), 3, 0.25)).when(
        F.col("section").isin("skills", "projects", "certifications"), share(F.col("marks"), 5, 0.25)).otherwise(shape)
    score = F.round(F.least(share(words, 80, 0.25) + pattern + shape, F.lit(1.0)), 2)
    text = F.when(F.size("entries") > 0, F.array_join("entries", "\n\n")).otherwise(t)
    out = both.select("doc_id", "section", text.alias("text"), score.alias("confidence"))
    return out.withColumn("valid", (F.col("text") != "") & (F.col("confidence") >= 0.2))


#: Order of the blocks of a rewritten full text.
FULL_ORDER = ("name", "contact", "summary", "skills", "experience", "education", "projects", "certifications", "awards", "languages", "interests", "references")


def full_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, confidence (0.95): blocks in a fixed order of sections, what has no heading first, others last."""
    rank = lambda s: F.coalesce(F.when(s.isNull(), F.lit(0)), *[F.when(s == name, k) for k, name in enumerate(FULL_ORDER, 1)], F.lit(99))

    def block(b: Column, i: Column) -> Column:
        return F.struct(rank(b["section"]).alias("rank"), i.alias("first"), F.concat_ws("\n", F.upper(b["section"]), _without_blanks(b["text"])).alias("block"))

    text = F.array_join(F.transform(F.sort_array(F.transform(_blocks(F.col(text_col)), block)), lambda b: b["block"]), "\n\n")
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(F.filter(F.array(text), lambda t: t != "")).alias("text"), F.lit(0.95).alias("confidence"))

"""Résumés in the layout of applicant tracking systems: bars between fields, no headings to speak of.

Every extractor works on the array of a document's lines inside its row, so all of them are one scan without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import distinct_ci, let, text_or_empty

#: Patterns of skills, words that are none, skills that mark a line as one of skills, words of other lines.
SKILL_PATTERNS = (
    r"\b(python|java|javascript|typescript|c\+\+|c#|ruby|go|rust|scala|kotlin|swift|php|r|matlab|perl|shell|bash)\b",
    r"\b(html|css|react|angular|vue|node|django|flask|express|next\.js|nuxt\.js|jquery|bootstrap|tailwind)\b",
    r"\b(aws|azure|gcp|docker|kubernetes|jenkins|terraform|ansible|ci/cd|devops|cloud)\b",
    r"\b(sql|mysql|postgresql|mongodb|redis|elasticsearch|oracle|sqlite|nosql|firebase)\b",
    r"\b(machine learning|deep learning|tensorflow|pytorch|scikit-learn|pandas|numpy|scipy|keras|jupyter|nlp|computer vision)\b",
    r"\b(git|github|gitlab|jira|confluence|vs code|eclipse|intellij|visual studio|figma|adobe)\b",
    r"\b(agile|scrum|kanban|waterfall|tdd|bdd|rest|api|microservices|oop|design patterns)\b",
    r"\b(linux|unix|windows|macos|networking|security|testing|qa|debugging|performance optimization)\b",
)
NO_SKILLS = (
    "software", "engineer", "developer", "manager", "analyst", "designer", "consultant", "architect", "lead", "senior", "junior", "intern", "trainee", "associate", "principal",
    "director", "vp", "head", "chief", "email", "phone", "address", "university", "college", "company", "corp", "inc", "llc", "ltd", "group", "solutions", "services", "technologies",
    "developed", "built", "created", "designed", "implemented", "led", "managed", "optimized",
)
SKILLS = (
    "python", "java", "javascript", "sql", "aws", "docker", "react", "node", "django", "flask", "git", "linux", "html", "css", "c++", "c#", "ruby", "php", "swift", "kotlin", "go", "rust",
    "scala", "mongodb", "mysql", "postgresql", "redis", "elasticsearch", "azure", "gcp", "kubernetes", "jenkins", "terraform", "ansible", "agile", "scrum", "typescript", "angular", "vue",
    "express", "pandas", "numpy", "tensorflow", "pytorch", "machine learning", "deep learning", "nlp", "devops", "ci/cd", "cloud",
)
DEGREE_WORDS = ("bs ", "ba ", "ms ", "ma ", "mba", "phd", "b.s.", "b.a.", "m.s.", "m.a.", "b.tech", "m.tech", "b.e.", "m.e.")
SCHOOL_WORDS = ("university", "college", "institute", "school")
LABELS = ("experience:", "education:", "skills:", "projects:")
HEADINGS = (
    "education", "academic", "qualification", "degree", "experience", "work", "employment", "professional", "skills", "technologies", "competencies", "projects", "portfolio",
    "certifications", "certificates", "licenses", "awards", "achievements", "honors", "publications", "research", "volunteer", "community", "references", "contact",
)
ROLE_WORDS = ("engineer", "developer", "manager", "analyst", "consultant")
NOT_NAMES = ("engineer", "developer", "manager", "analyst", "consultant", "intern", "specialist")
VERBS = ("developed", "built", "created", "designed", "implemented", "led", "managed", "optimized", "improved", "increased", "reduced", "automated", "integrated")
DEGREE_START = r"(?i)^(bs|ba|msc|ms|ma|mba|phd|b\.s\.|b\.a\.|m\.s\.|m\.a\.|b\.tech|m\.tech|b\.e\.|m\.e\.?)\s*(?:in\s+)?([a-zA-Z\s]+)?"
STUDY_YEAR = r"\b(19[89]\d|20[0-2]\d)\b"
TITLE = (
    r"(?i)\b((?:senior|junior|lead|principal|staff)?\s*(?:software|full.?stack|front.?end|back.?end|web|data|machine.?learning|devops|cloud|product|project|marketing|sales|financial|business)?\s*"
    r"(?:engineer|developer|manager|analyst|designer|architect|consultant|lead|director|specialist))\b"
)
JOB_YEAR = r"\b((?:19[89]|20[0-2])\d(?:\s*[-–]\s*(?:19[89]|20[0-2])\d|present)?)\b"
MOST_ENTRIES = 10


def any_word(words: Sequence[str]) -> str:
    """A pattern that finds any of the words, wherever they stand."""
    return "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-").replace("/", "/") for w in words)


def _lines(text: Column) -> Column:
    return F.transform(F.split(text_or_empty(text), "\n"), lambda x: F.trim(x))


def _share(lines: Column, test, of: Column) -> Column:
    return F.size(F.filter(lines, test)) > of


def _capitals(x: Column) -> Column:
    return x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}")


def _short(x: Column) -> Column:
    return (x != "") & (F.length(x) < 50) & ~F.lower(x).rlike(any_word(LABELS))


def signs(text: Column) -> Column:
    """How many of three signs a text shows: rows of bars, mostly short lines, no headings with a colon."""
    t = text_or_empty(text)
    bars = F.exists(_lines(t), lambda x: F.size(F.split(x, r"\|")) > 2)
    short = let(_lines(t), lambda a: _share(a, _short, F.size(a) * 0.5))
    plain = ~F.lower(t).rlike(r"\n(?:experience|skills|education|projects):")
    return F.when(t == "", 0).otherwise(bars.cast("int") + short.cast("int") + plain.cast("int"))


def likely_signs(text: Column) -> Column:
    """The quick test: a bar anywhere, two fifths of short lines, three short lines in capitals."""
    t = text_or_empty(text)
    full = F.filter(_lines(t), lambda x: x != "")
    short = let(full, lambda a: _share(a, _short, F.size(a) * 0.4))
    capitals = _share(full, lambda x: _capitals(x) & (F.length(x) < 30), F.lit(2))
    return F.when(t == "", 0).otherwise(t.contains("|").cast("int") + short.cast("int") + capitals.cast("int"))


def is_ats(docs: DataFrame) -> DataFrame:
    """doc_id, indicators, is_ats, likely: two signs or more, by the thorough and by the quick test."""
    found = docs.select("doc_id", signs(F.col("text")).alias("indicators"), likely_signs(F.col("text")).alias("quick"))
    return found.select("doc_id", "indicators", (F.col("indicators") >= 2).alias("is_ats"), (F.col("quick") >= 2).alias("likely"))


def is_education_line(x: Column) -> Column:
    return F.lower(x).rlike(any_word((*DEGREE_WORDS, *SCHOOL_WORDS)))


def is_skill_line(x: Column) -> Column:
    """Two or more of the skills, and nothing of education."""
    known = lambda low: F.filter(F.array(*map(F.lit, SKILLS)), lambda s: F.contains(low, s))
    return let(F.lower(x), lambda low: F.when(low.rlike(any_word(SKILLS)), ~is_education_line(x) & (F.size(known(low)) >= 2)).otherwise(False))


def is_heading(x: Column) -> Column:
    clean = F.regexp_replace(F.lower(F.trim(x)), r"^[\s\-•:]+|[\s\-•:]+$", "")
    return clean.rlike(f"^(?:{any_word(HEADINGS)})(?:$|:)") | (_capitals(x) & (F.length(clean) < 30))


def skills(docs: DataFrame) -> DataFrame:
    """doc_id, text, confidence: skills by pattern, and the known parts of lines between bars or commas, sorted; 0.3 and 0.05 each.

    Of spellings that differ in case the first of the lines stays, before that of the patterns.
    """
    t = text_or_empty(F.col("text"))
    by_pattern = F.array_distinct(F.flatten(F.array(*[F.transform(F.regexp_extract_all(t, F.lit(f"(?i){p}"), F.lit(1)), lambda s: F.lower(s)) for p in SKILL_PATTERNS])))

    def parts(known: Column):
        def of(x: Column) -> Column:
            bars, commas = F.split(x, r"\|"), F.split(x, ",")
            contact = x.rlike(r"@\w+\.\w+") | x.rlike(r"\(\d{3}\)\s*\d{3}-\d{4}")
            role = F.lower(x).rlike(any_word(ROLE_WORDS)) & (x.contains("|") | ~x.contains(","))
            pieces = F.when(F.size(bars) >= 3, bars).when((F.size(commas) >= 3) & ~x.rlike(r"20\d{2}|19\d{2}"), commas)
            named = F.transform(F.coalesce(pieces, F.array().cast("array<string>")), lambda p: F.trim(p))
            good = lambda p: (F.length(p) >= 2) & (F.array_contains(known, F.lower(p)) | F.lower(p).rlike(any_word(SKILLS)))
            none = F.array().cast("array<string>")
            return F.when(~x.rlike(r"(?s)\|.*\||,.*,"), none).when(is_education_line(x) | contact | role, none).otherwise(F.filter(named, good))  # most lines have no two bars or commas

        return of

    every = let(by_pattern, lambda known: F.concat(F.flatten(F.transform(_lines(t), parts(known))), known))
    kept = F.array_sort(distinct_ci(F.filter(every, lambda s: (F.length(s) >= 2) & ~s.rlike(r"^\d+$") & ~F.lower(s).isin(*NO_SKILLS))))
    found = docs.select("doc_id", kept.alias("found"))
    score = F.round(F.least(0.3 + 0.05 * F.size("found"), F.lit(1.0)), 2)
    return found.select("doc_id", F.array_join("found", ", ").alias("text"), F.when(F.size("found") > 0, score).otherwise(0.0).alias("confidence"))


def _study(x: Column) -> Column:
    """``BS Physics (2015)`` of a line that begins with a degree and has a year, else null."""
    field, year = F.trim(F.regexp_extract(x, DEGREE_START, 2)), F.regexp_extract(x, STUDY_YEAR, 1)
    skip = (x == "") | x.rlike("^[-•]") | F.lower(x).rlike(any_word((*ROLE_WORDS, "architect"))) | is_skill_line(x)
    entry = F.concat_ws(" ", F.upper(F.regexp_extract(x, DEGREE_START, 1)), F.nullif(field, F.lit("")), F.concat(F.lit("("), year, F.lit(")")))
    return F.when(x.rlike(DEGREE_START) & (year != "") & ~skip, entry)  # what settles most lines comes first


def education(docs: DataFrame) -> DataFrame:
    """doc_id, text, confidence: degrees with years between the heading of education and the next one, else of all lines; 0.5 and 0.15 each."""

    def marked(x: Column, i: Column) -> Column:
        head = is_heading(x)
        return F.struct(i.alias("i"), _study(x).alias("entry"), (head & F.lower(x).contains("education")).alias("opens"), head.alias("head"))

    def entries(rows: Column) -> Column:
        begin = F.get(F.filter(rows, lambda r: r["opens"]), F.lit(0))["i"]
        named = lambda a: F.transform(F.filter(a, lambda r: r["entry"].isNotNull()), lambda r: r["entry"])

        def inside(b: Column) -> Column:
            end = F.coalesce(F.get(F.filter(rows, lambda r: (r["i"] > b) & r["head"] & ~r["opens"]), F.lit(0))["i"], F.lit(1 << 30))
            return let(end, lambda e: named(F.filter(rows, lambda r: (r["i"] > b) & (r["i"] < e) & ~r["opens"])))

        return let(let(begin, inside), lambda own: F.when(F.size(F.coalesce(own, F.array().cast("array<string>"))) > 0, own).otherwise(named(rows)))

    found = docs.select("doc_id", distinct_ci(let(F.transform(_lines(F.col("text")), marked), entries)).alias("found"))
    score = F.round(F.least(0.5 + 0.15 * F.size("found"), F.lit(1.0)), 2)
    return found.select("doc_id", F.array_join("found", "\n").alias("text"), F.when(F.size("found") > 0, score).otherwise(0.0).alias("confidence"))


def experience(docs: DataFrame) -> DataFrame:
    """doc_id, text, confidence: rows of bars with a title or a year, then bullets with a verb; distinct by their first 50 characters.

    0.4 and 0.1 for each; the first ten make the text.
    """

    def row(x: Column) -> Column:
        bars = F.transform(F.split(x, r"\|"), lambda p: F.trim(p))
        listed = (F.size(F.split(x, ",")) >= 3) & ~F.lower(x).rlike(any_word(("engineer", "developer", "manager")))
        fits = F.get(bars, F.lit(0)).rlike(TITLE) | F.element_at(bars, F.lit(-1)).rlike(JOB_YEAR)
        return F.when(x.contains("|") & (F.size(bars) >= 2) & fits & ~listed & ~is_education_line(x) & ~is_skill_line(x), F.array_join(bars, " | "))  # what settles most lines comes first

    def bullet(x: Column) -> Column:
        action = F.trim(F.regexp_replace(x, "^[-•]+", ""))
        return F.when(x.rlike("^[-•]") & F.lower(action).rlike(any_word(VERBS)), action)

    full = lambda a: F.filter(a, lambda e: e.isNotNull())
    every = let(_lines(F.col("text")), lambda a: F.concat(full(F.transform(a, row)), full(F.transform(a, bullet))))
    key = lambda e: F.substring(F.lower(e), 1, 50)
    kept = let(every, lambda a: let(F.transform(a, key), lambda k: F.filter(a, lambda e, i: F.array_position(k, key(e)) == i + 1)))
    found = docs.select("doc_id", kept.alias("found"))
    score = F.round(F.least(0.4 + 0.1 * F.size("found"), F.lit(1.0)), 2)
    return found.select("doc_id", F.array_join(F.slice("found", 1, MOST_ENTRIES), "\n").alias("text"), F.when(F.size("found") > 0, score).otherwise(0.0).alias("confidence"))


def name(docs: DataFrame) -> DataFrame:
    """doc_id, text, confidence: what stands before the first bar, or the first line as a name (0.85), or a capitalised line of the first three (0.7)."""
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    titled = lambda x: F.size(words(x)).between(2, 4) & F.forall(words(x), lambda w: w.rlike(r"^\p{Lu}"))
    every = _lines(F.col("text"))
    first = F.get(every, F.lit(0))
    before = F.trim(F.get(F.split(first, r"\|"), F.lit(0)))
    shaped = first.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}$") & ~F.lower(first).rlike(any_word(NOT_NAMES))
    best = F.when(first.contains("|") & titled(before), F.struct(before.alias("text"), F.lit(0.85).alias("confidence"))).when(shaped, F.struct(first.alias("text"), F.lit(0.85).alias("confidence")))
    later = F.get(F.filter(F.slice(every, 1, 3), titled), F.lit(0))
    found = F.coalesce(best, F.when(later.isNotNull(), F.struct(F.array_join(words(later), " ").alias("text"), F.lit(0.7).alias("confidence"))))
    return docs.select("doc_id", found.alias("f")).select("doc_id", F.coalesce("f.text", F.lit("")).alias("text"), F.coalesce("f.confidence", F.lit(0.0)).alias("confidence"))


def all_sections(docs: DataFrame) -> DataFrame:
    """doc_id, section, text, confidence of name, summary (always empty in this format), skills, education and experience."""
    summary = docs.select("doc_id", F.lit("").alias("text"), F.lit(0.0).alias("confidence"))
    parts = {"name": name(docs), "summary": summary, "skills": skills(docs), "education": education(docs), "experience": experience(docs)}
    out = None
    for section, rows in parts.items():
        own = rows.select("doc_id", F.lit(section).alias("section"), "text", "confidence")
        out = own if out is None else out.unionByName(own)
    return out

"""Canonical records: adapters from section maps, defaults, the builder form, and validation as arrays of errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import MONTHS, date_range
from ..functions.text import distinct_ci, let, text_or_empty
from ..functions.text import title as title_case

_S = "string"
PERSON = f"struct<name:{_S},email:{_S},phone:{_S},location:{_S},city:{_S},country:{_S},linkedin:{_S},websites:array<{_S}>>"
WORK = f"struct<job_title:{_S},company:{_S},location:{_S},start_date:{_S},end_date:{_S},description:{_S},responsibilities:array<{_S}>>"
STUDY = f"struct<degree:{_S},institution:{_S},field_of_study:{_S},start_date:{_S},end_date:{_S},graduation_year:{_S},gpa:{_S},description:{_S}>"
PROJECT = f"struct<title:{_S},description:{_S},url:{_S},associated_with:{_S}>"
VOLUNTEER = f"struct<organization:{_S},role:{_S},start_date:{_S},end_date:{_S},description:{_S}>"
CUSTOM = f"struct<section_title:{_S},items:array<{_S}>>"
#: Fields of the canonical record and their types.
V1 = {
    "personal_information": PERSON, "summary": _S, "work_experience": f"array<{WORK}>", "education": f"array<{STUDY}>", "skills": f"map<{_S},array<{_S}>>",
    "projects": f"array<{PROJECT}>", "volunteer_experience": f"array<{VOLUNTEER}>", "custom_sections": f"array<{CUSTOM}>",
}
#: Sections that have a field of their own.
MAPPED = ("name", "email", "phone", "contact", "summary", "skills", "education", "experience", "projects", "volunteer", "links", "text", "raw_text")


def section_map(sections: DataFrame) -> DataFrame:
    """doc_id, sections: map of section to (text, confidence), from the long table."""
    pairs = F.map_from_entries(F.collect_list(F.struct("section", F.struct("text", "confidence"))))
    return sections.groupBy("doc_id").agg(pairs.alias("sections"))


def _section(name: str) -> Column:
    return F.trim(F.coalesce(F.col("sections")[name]["text"], F.lit("")))


def blocks(text: Column) -> Column:
    """Parts between blank lines; if there is one, its lines."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda b: F.trim(b)), lambda b: b != "")
    rows = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" -\t"))), lambda x: x != "")
    return let(parts, lambda p: F.when(F.size(p) > 1, p).otherwise(let(rows, lambda r: F.when(F.size(r) > 1, r).otherwise(p))))


def items(text: Column) -> Column:
    """Distinct items between line ends, commas, semicolons, bullets and bars."""
    parts = F.transform(F.split(text, r"[\n,;•|]+"), lambda x: F.btrim(x, F.lit(" -\t")))
    return distinct_ci(F.filter(parts, lambda x: x != ""))


def _row(kind: str, **given: Column) -> Column:
    """A struct of the kind with the given fields, the others empty."""
    fields = [f.split(":")[0] for f in kind[len("struct<") : -1].split(",")]
    return F.struct(*[given.get(f, F.lit(None)).alias(f) for f in fields]).cast(kind)


def from_sections(docs: DataFrame) -> DataFrame:
    """doc_id and the fields of V1. Input: doc_id, sections (map of section to text and confidence), raw_text."""
    first_line = lambda b: F.trim(F.get(F.split(b, "\n"), F.lit(0)))
    raw = F.coalesce(F.nullif(F.col("raw_text"), F.lit("")), F.array_join(F.transform(F.map_values("sections"), lambda s: s["text"]), "\n"))
    person = _row(
        PERSON, name=F.nullif(_section("name"), F.lit("")), email=F.nullif(F.regexp_extract(raw, r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0), F.lit("")),
        phone=F.nullif(F.trim(F.regexp_extract(raw, r"\+?[0-9][0-9\s().-]{8,}[0-9]", 0)), F.lit("")), websites=F.regexp_extract_all(raw, F.lit(r"(?i)(?:https?://|www\.)[^\s,;]+"), F.lit(0)),
    )
    others = F.filter(F.map_entries("sections"), lambda e: ~e["key"].isin(*MAPPED) & (F.trim(e["value"]["text"]) != ""))
    named = F.transform(F.array_sort(others), lambda e: _row(CUSTOM, section_title=title_case(F.replace(e["key"], F.lit("_"), F.lit(" "))), items=items(e["value"]["text"])))
    return docs.select(
        "doc_id",
        person.alias("personal_information"),
        _section("summary").alias("summary"),
        F.transform(blocks(_section("experience")), lambda b: _row(WORK, description=b)).alias("work_experience"),
        F.transform(blocks(_section("education")), lambda b: _row(STUDY, description=b)).alias("education"),
        F.create_map(F.lit("items"), items(_section("skills"))).alias("skills"),
        F.transform(blocks(_section("projects")), lambda b: _row(PROJECT, title=F.substring(first_line(b), 1, 120), description=b)).alias("projects"),
        F.transform(blocks(_section("volunteer")), lambda b: _row(VOLUNTEER, organization=first_line(b), role=F.lit(""), description=b)).alias("volunteer_experience"),
        named.alias("custom_sections"),
    )



def with_defaults(records: DataFrame) -> DataFrame:
    """All fields of V1, absent and null ones empty, and ``warnings`` about those that were absent."""
    absent = [c for c in V1 if c not in records.columns]
    values = {}
    for c, kind in V1.items():
        empty = F.lit("") if kind == _S else F.create_map().cast(kind) if kind.startswith("map") else F.array().cast(kind) if kind.startswith("array") else _row(kind)
        values[c] = empty if c in absent else F.coalesce(F.col(c), empty)
    notes = [F.lit(f"missing required key '{c}' was defaulted") for c in absent]
    return records.withColumns(values).withColumn("warnings", F.array(*notes).cast("array<string>"))


def v1_errors(records: DataFrame) -> DataFrame:
    """With ``errors``: array items that are no objects (null); is_valid is their absence."""
    checks = [F.transform(F.col(c), lambda x, i: F.when(x.isNull(), F.format_string("%s[%d]", F.lit(c), i))) for c in ("work_experience", "education", "projects", "volunteer_experience", "custom_sections")]
    named = F.filter(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in checks]), lambda e: e.isNotNull())
    errors = F.transform(named, lambda e: F.concat(F.lit("'"), e, F.lit("' must be object")))
    return records.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


BUILDER_VERSION = "resume-schema-v1-to-builder-v1"
SECTION_NAMES = {"certifications": ("certifications", "certification", "licenses", "courses"), "languages": ("languages", "language skills", "known languages")}


def to_builder(records: DataFrame, file_type: str = "pdf") -> DataFrame:
    """doc_id and the builder's fields from V1 records."""
    p = F.col("personal_information")
    words = F.split(F.trim(text_or_empty(p["name"])), r"\s+")
    text = lambda x: F.trim(text_or_empty(x))
    custom = lambda names: F.transform(
        F.flatten(F.transform(F.filter("custom_sections", lambda s: F.lower(s["section_title"]).isin(*names)), lambda s: s["items"])),
        lambda i: F.struct(i.alias("name"), F.lit("").alias("issuingOrg"), F.lit("").alias("achievedDate"), F.lit("").alias("url")),
    )
    described = lambda x: F.when(F.size(x["responsibilities"]) > 0, F.array_join(x["responsibilities"], "\n")).otherwise(text(x["description"]))
    return records.select(
        "doc_id",
        F.struct(
            F.get(words, F.lit(0)).alias("firstName"), F.array_join(F.slice(words, 2, 100), " ").alias("lastName"), F.lit("").alias("profession"), text(p["city"]).alias("city"),
            text(p["country"]).alias("country"), F.lit("").alias("pincode"), text(p["phone"]).alias("phone"), text(p["email"]).alias("email"), text(p["linkedin"]).alias("linkedin"),
            F.coalesce(p["websites"], F.array().cast("array<string>")).alias("websites"),
        ).alias("personal"),
        text(F.col("summary")).alias("summary"),
        F.array_distinct(F.flatten(F.map_values("skills"))).alias("skills"),
        F.transform("education", lambda e: F.struct(
            text(e["institution"]).alias("school"), F.lit("").alias("location"), text(e["degree"]).alias("degree"), text(e["field_of_study"]).alias("field"), F.lit("").alias("gradMonth"),
            text(F.coalesce(F.nullif(e["graduation_year"], F.lit("")), e["end_date"])).alias("gradYear"), text(e["gpa"]).alias("gpa"))).alias("education"),
        F.transform("work_experience", lambda e: F.struct(
            text(e["job_title"]).alias("title"), text(e["company"]).alias("employer"), text(e["location"]).alias("location"), described(e).alias("description"), F.lit("").alias("startMonth"),
            text(e["start_date"]).alias("startYear"), F.lit("").alias("endMonth"), text(e["end_date"]).alias("endYear"), F.lit(False).alias("current"))).alias("experience"),
        F.transform("projects", lambda e: F.struct(
            text(e["title"]).alias("title"), text(e["description"]).alias("description"), F.lit("").alias("role"), F.lit("").alias("tools"), text(e["url"]).alias("url"))).alias("projects"),
        custom(SECTION_NAMES["certifications"]).alias("certifications"),
        custom(SECTION_NAMES["languages"]).alias("languages"),
        F.lit(file_type).alias("file_type"),
    )


LEVELS = ("Beginner", "Intermediate", "Advanced", "Fluent", "Native")
_YEAR, _DATE = r"^(?:|19\d{2}|20\d{2})$", rf"^(?:|19\d{{2}}|20\d{{2}}|(?:{'|'.join(MONTHS)})\s+(?:19|20)\d{{2}})$"


def builder_errors(records: DataFrame) -> DataFrame:
    """With ``errors`` about years, months, dates and language levels out of their range; keys and types are the columns'."""

    def check(column: str, field: str, pattern: str, says: str) -> Column:
        said = F.transform(column, lambda x, i: F.when(~text_or_empty(x[field]).rlike(pattern), F.format_string(f"{column}[%d].{field} {says}", i)))
        return F.coalesce(said, F.array().cast("array<string>"))

    month = f"^(?:|{'|'.join(MONTHS)})$"
    checks = [
        check("education", "gradMonth", month, "must be one of the canonical month values or ''"),
        check("education", "gradYear", _YEAR, "must be '' or a four-digit year"),
        *[check("experience", f"{w}Month", month, "must be one of the canonical month values or ''") for w in ("start", "end")],
        *[check("experience", f"{w}Year", _YEAR, "must be '' or a four-digit year") for w in ("start", "end")],
        check("certifications", "achievedDate", _DATE, "must be '', 'YYYY', or 'Month YYYY'"),
    ]
    if "level" in records.schema["languages"].dataType.elementType.names:
        checks.append(check("languages", "level", f"^(?:{'|'.join(LEVELS)})$", f"must be one of {sorted(LEVELS)}"))
    return records.withColumn("errors", F.filter(F.concat(*checks), lambda e: e.isNotNull())).withColumn("is_valid", F.size("errors") == 0)


#: Levels as they are written, strongest first.
LEVEL_WORDS = (("Native", "native|mother tongue"), ("Fluent", "fluent|bilingual"), ("Advanced", "advanced|professional|proficient"), ("Intermediate", "intermediate|conversational|working"), ("Beginner", "beginner|basic|elementary|limited"))


def language(item: Column) -> Column:
    """struct(name, level) of an item such as ``French - basic``; without a level Intermediate."""
    level = F.coalesce(*[F.when(F.lower(item).rlike(words), name) for name, words in LEVEL_WORDS], F.lit("Intermediate"))
    bare = F.regexp_replace(item, rf"(?i)\b(?:{'|'.join(w for _, w in LEVEL_WORDS)})\b", "")
    return F.struct(title_case(F.btrim(bare, F.lit(" -–:()|,"))).alias("name"), level.alias("level"))


def job(title: Column, company: Column, duration: Column, description: Column) -> Column:
    """A builder job from the fields of a parsed one: dates split, employer and title swapped where they are the wrong way round."""
    role = lambda x: F.lower(text_or_empty(x)).rlike(r"\b(?:engineer|developer|manager|analyst|designer|consultant|architect|lead|director|accountant|intern|specialist)\b")
    swapped = role(company) & ~role(title)
    return let(date_range(duration), lambda d: F.struct(
        text_or_empty(F.when(swapped, company).otherwise(title)).alias("title"), text_or_empty(F.when(swapped, title).otherwise(company)).alias("employer"), text_or_empty(description).alias("description"),
        d["start_month"].alias("startMonth"), d["start_year"].alias("startYear"), d["end_month"].alias("endMonth"), d["end_year"].alias("endYear"), d["current"].alias("current")))


def distinct_by(entries: Column, key) -> Column:
    """Entries of an array whose key (Column of an entry) has not come before."""
    return let(entries, lambda a: let(F.transform(a, key), lambda k: F.filter(a, lambda e, i: F.array_position(k, key(e)) == i + 1)))


def section_text(records: DataFrame) -> DataFrame:
    """doc_id, section, text: V1 fields as plain text, an entry a block, empty fields left out."""
    entry = lambda fields: lambda e: F.concat_ws("\n", *[F.nullif(e[f], F.lit("")) for f in fields])
    joined = lambda column, fields: F.array_join(F.transform(column, entry(fields)), "\n\n")
    p = F.col("personal_information")
    parts = {
        "personal": F.concat_ws("\n", p["name"], p["email"], p["phone"], F.array_join(p["websites"], "\n")), "summary": F.col("summary"),
        "skills": F.array_join(F.flatten(F.map_values("skills")), ", "), "experience": joined("work_experience", ("job_title", "company", "description")),
        "education": joined("education", ("degree", "institution", "description")), "projects": joined("projects", ("title", "description", "url")),
        "volunteer": joined("volunteer_experience", ("organization", "role", "description")),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("section"), text_or_empty(t).alias("text")) for n, t in parts.items()])
    return records.select("doc_id", F.inline(rows))

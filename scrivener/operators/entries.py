"""Section texts to typed entries. Input rows have doc_id and text, the text of one section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, lines_of, sessions, strip
from ..functions.text import title as title_case
from .lines import doc_order, lines

YEAR = r"(?:19|20)\d{2}"
#: Keywords of the categories of skills; the first category that fits takes a skill.
SKILL_CATEGORIES = {
    "programming_languages": r"python|java|javascript|c\+\+|c#|ruby|php|go|rust|swift|kotlin|scala|typescript|matlab",
    "frameworks": r"react|angular|vue|django|flask|spring|node|express|rails|laravel|\.net|asp\.net",
    "databases": "sql|mysql|postgresql|mongodb|redis|elasticsearch|oracle|sqlite|cassandra|dynamodb",
    "tools": "git|docker|kubernetes|jenkins|jira|terraform|ansible|maven|gradle|npm|yarn",
    "cloud": "aws|azure|gcp|google cloud|amazon web services|heroku|digitalocean",
    "soft_skills": "leadership|communication|teamwork|problem-solving|analytical|management",
}


def skill_category(skill: Column) -> Column:
    return F.coalesce(*[F.when(skill.rlike(rf"\b(?:{words})\b"), name) for name, words in SKILL_CATEGORIES.items()], F.lit("other"))


def skills_of(text: Column) -> Column:
    """Distinct lower-cased parts of two characters or more between commas, semicolons and line ends."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[,;â€¢\n]+"), lambda s: F.lower(F.trim(s)))
    return F.array_distinct(F.filter(parts, lambda s: F.length(s) >= 2))


def parse_skills(rows: DataFrame) -> DataFrame:
    """doc_id, skill, category of each skill."""
    skills = rows.select("doc_id", F.explode(skills_of(F.col("text"))).alias("skill"))
    return skills.withColumn("category", skill_category(F.col("skill")))


#: Degrees by level, first fit wins, and words of schools.
DEGREE_LEVELS = (
    ("phd", r"\bphd\b|\bdoctorate\b"),
    ("masters", r"\bmaster\b|\bm\.sc\b|\bmba\b|\bm\.tech\b|\bm\.e\."),
    ("bachelors", r"\bbachelor\b|\bb\.sc\b|\bb\.tech\b|\bb\.e\.|\bba\b|\bbba\b"),
    ("diploma", r"\bdiploma\b"),
    ("certificate", r"\bcertificate\b"),
)


def degree_level(line: Column) -> Column:
    return F.coalesce(*[F.when(line.rlike(f"(?i){p}"), level) for level, p in DEGREE_LEVELS])


def parse_education(rows: DataFrame) -> DataFrame:
    """doc_id, entry_no, degree, level, year, institution, grade: entries begin at a degree and after blank lines.

    The first years count, and the last school and grade; entries with none of the fields go.
    """

    def facts(raw: Column) -> Column:
        x = strip(raw)
        return let(x, lambda x: F.struct(x.alias("line"), degree_level(x).alias("level"), F.lower(x).alias("low"), F.regexp_extract_all(x, F.lit(YEAR), F.lit(0)).alias("years")))

    def entry(part: Column) -> Column:
        of = lambda test: F.filter(part, lambda r: test(r) & (r["line"] != ""))
        plain = lambda test: of(lambda r: r["level"].isNull() & test(r))
        last = lambda rows: F.get(rows, F.size(rows) - 1)["line"]
        best = lambda c: F.array_max(F.transform(of(lambda r: r["level"].isNotNull()), lambda r: r[c]))
        return F.struct(
            best("line").alias("degree"), best("level").alias("level"), F.array_join(F.get(plain(lambda r: F.size(r["years"]) > 0), F.lit(0))["years"], " - ").alias("year"),
            let(plain(lambda r: r["low"].rlike("university|college|institute|school|academy")), last).alias("institution"),
            let(plain(lambda r: r["low"].rlike("gpa|grade") | r["line"].contains("%")), last).alias("grade"),
        )

    def begins(a: Column):
        return lambda r, i: r["level"].isNotNull() | (F.coalesce(F.get(a, i - 1)["line"], F.lit("")) == "")

    every = let(F.transform(lines_of(F.col("text")), facts), lambda a: F.transform(sessions(a, begins(a)), entry))
    found = F.filter(every, lambda e: F.coalesce(e["degree"], e["year"], e["institution"], e["grade"]).isNotNull())
    return rows.select("doc_id", F.posexplode(found).alias("at", "e")).select("doc_id", (F.col("at") + 1).alias("entry_no"), "e.*")


#: Technologies and hosts of projects, issuers of certificates.
TECHNOLOGIES = r"(?i)\b(python|java|javascript|react|angular|vue|node|django|flask|mongodb|mysql|postgresql|aws|azure|gcp|docker|kubernetes)\b"
PROJECT_HOSTS = r"(?i)(github\.com|gitlab\.com|heroku\.com|aws\.amazon\.com|bitbucket\.org)[^\s]*"
ISSUERS = ("aws", "azure", "google", "microsoft", "oracle", "salesforce", "scrum", "pmi")


def parse_projects(rows: DataFrame) -> DataFrame:
    """doc_id, entry_no, name, technologies, link, description: entries between blank lines.

    A short line without a leading hyphen is the name, the last one counts; of the others the first with technologies and
    the last with a link count.
    """
    marked = lines(rows).withColumn("begins", (F.lag("line", 1, "").over(doc_order()) == "").cast("int")).withColumn("entry", F.sum("begins").over(doc_order())).filter("line <> ''")
    at, name = F.col("line_no"), (F.length("line") < 60) & ~F.col("line").startswith("-")
    techs = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("line", F.lit(TECHNOLOGIES), F.lit(1)), lambda t: F.lower(t))))
    link = F.regexp_extract("line", PROJECT_HOSTS, 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~name, F.struct("line_no", "line")))), lambda x: x["line"]), " ")
    found = marked.groupBy("doc_id", "entry").agg(
        F.max_by(F.when(name, F.col("line")), F.when(name, at)).alias("name"), F.min_by(techs, F.when(~name & (F.size(techs) > 0), at)).alias("technologies"),
        F.max_by(link, F.when(~name & (link != ""), at)).alias("link"), F.nullif(text, F.lit("")).alias("description"),
    )
    return found.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("entry")).alias("entry_no"), "name", "technologies", "link", "description")


def parse_certifications(rows: DataFrame) -> DataFrame:
    """doc_id, entry_no, name, year, issuer: a record for each line; the last issuer of the list that it names counts."""
    every = F.filter(F.transform(lines_of(F.col("text")), lambda x: strip(x)), lambda x: x != "")
    full = rows.select("doc_id", F.posexplode(every).alias("at", "line"))
    issuer = F.coalesce(*[F.when(F.lower("line").contains(i), i.title()) for i in reversed(ISSUERS)])
    year = F.nullif(F.regexp_extract("line", YEAR, 0), F.lit(""))
    return full.select("doc_id", (F.col("at") + 1).alias("entry_no"), F.col("line").alias("name"), year.alias("year"), issuer.alias("issuer"))


#: What tells titles, companies, dates and descriptions of jobs apart.
TITLES = "engineer|developer|manager|analyst|designer|consultant|architect|lead|director|head|chief|specialist|executive|accountant"
COMPANY = (
    r"(?i)\b(?:company|employer|organization)\s*[:\-]\s*([A-Z][A-Za-z0-9&,.\-\s]{1,60})$",
    r"(?i)@\s*([A-Z][A-Za-z0-9&,.\-\s]{1,60})$",
    r"(?i)\bat\s+([A-Z][A-Za-z0-9&,.\-\s]{1,60})(?:\s*(?:\||-|–|from|to|present|current|$))",
)
SUFFIXES = "inc|llc|ltd|limited|corp|corporation|company|technologies|solutions|services|pvt|bank|group|consulting"
ACTIONS = "responsible|developed|managed|implemented|worked|budgeting|forecasting|designed|led|handled"
NOISE_COMPANY = "responsible|developed|managed|implemented|budgeting|forecasting|process|processes|duties|achievements|projects"
_MONTH = r"(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s*)?"
DATES = rf"(?i){_MONTH}(?:19|20)\d{{2}}"


def _company_like(x: Column) -> Column:
    low = F.lower(x)
    words = F.split(x, r"\s+")
    lettered = F.filter(words, lambda w: w.rlike(r"^\p{L}"))
    titled = (F.size(lettered) > 0) & F.forall(lettered, lambda w: w.rlike(r"^\p{Lu}"))
    return (x != "") & (F.length(x) <= 60) & ~x.rlike(r"\d") & ~low.rlike(ACTIONS) & (F.size(words) <= 6) & (low.rlike(f"(?:{SUFFIXES})$| (?:{SUFFIXES})") | titled)


def _company_in(x: Column) -> Column:
    """The company named after a label, @ or at; null for none or noise."""
    found = [F.btrim(F.regexp_extract(x, p, 1), F.lit(" -|,")) for p in COMPANY]
    good = [F.when((c != "") & ~F.lower(c).rlike(NOISE_COMPANY) & (F.size(F.split(c, r"\s+")) <= 8), c) for c in found]
    return F.coalesce(*good)


def parse_experience(rows: DataFrame) -> DataFrame:
    """doc_id, entry_no, title, company, duration, description."""
    out = rows.select("doc_id", F.posexplode(experience_of(F.col("text"))).alias("entry_no", "e"))
    return out.select("doc_id", (F.col("entry_no") + 1).alias("entry_no"), "e.*")


def experience_of(text: Column) -> Column:
    """Array of struct(title, company, duration, description).

    Where an entry begins depends on what the open one has, so each document's lines are folded by ``aggregate``: the
    state is the open entry and the finished ones. All of it stays in the JVM.
    """
    empty = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("title", "company", "duration", "description")])
    facts = F.transform(
        F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n"),
        lambda raw: _facts(F.trim(raw)),
    )

    def step(a: Column, x: Column) -> Column:
        e = a["open"]
        started = e["title"].isNotNull() | e["company"].isNotNull() | e["duration"].isNotNull()
        filled = F.size(F.filter(F.array(e["title"], e["company"], e["duration"], e["description"]), lambda v: v.isNotNull()))
        said = e["description"].isNotNull()
        other = lambda c: e[c].isNotNull() & (x["x"] != e[c])
        begins = (
            F.when(~started, False)
            .when(x["date"], other("duration"))
            .when(x["title80"], other("title") & (e["duration"].isNotNull() | said | e["company"].isNotNull()))
            .when(x["header"], other("company"))
            .when(x["like"], e["company"].isNotNull() & (e["duration"].isNotNull() | said))
            .otherwise(False)
        )
        blank = x["x"] == ""
        close = (blank & (filled > 1)) | (~blank & begins)
        now = lambda c: F.when(close, F.lit(None)).otherwise(e[c])
        company = F.coalesce(x["company"], now("company"), F.when(x["like"] & ~x["title"], x["x"]))
        consumed = x["title70"] | x["date"] | x["company"].isNotNull() | (now("company").isNull() & x["company"].isNull() & x["like"] & ~x["title"])
        grown = F.struct(
            F.when(x["title70"], x["x"]).otherwise(now("title")).alias("title"), company.alias("company"), F.when(x["date"], x["x"]).otherwise(now("duration")).alias("duration"),
            F.when(consumed, now("description")).otherwise(F.concat_ws(" ", now("description"), x["x"])).alias("description"),
        )
        kept = F.struct(*[now(c).alias(c) for c in ("title", "company", "duration", "description")])
        return F.struct(F.when(blank, kept).otherwise(grown).alias("open"), F.when(close, F.array_append(a["done"], e)).otherwise(a["done"]).alias("done"))

    start = F.struct(empty.alias("open"), F.array().cast("array<struct<title:string,company:string,duration:string,description:string>>").alias("done"))
    any_ = lambda e: F.coalesce(e["title"], e["company"], e["duration"], e["description"]).isNotNull()
    return F.aggregate(facts, start, step, lambda a: F.when(any_(a["open"]), F.array_append(a["done"], a["open"])).otherwise(a["done"]))


def _facts(x: Column) -> Column:
    low = F.lower(x)
    titled = low.rlike(TITLES)
    return F.struct(
        x.alias("x"), titled.alias("title"), (titled & (F.length(x) < 70)).alias("title70"), (titled & (F.length(x) <= 80)).alias("title80"), x.rlike(DATES).alias("date"),
        x.rlike(r"(?i)\b(?:company|employer|organization)\s*[:\-]|@[A-Z]").alias("header"), _company_in(x).alias("company"), _company_like(x).alias("like"),
    )


def name_of_file(path: Column) -> Column:
    """Last resort: the file's name without its ending, digits and words such as resume, in title case."""
    stem = F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]+)?$", 1)
    return title_case(F.trim(F.regexp_replace(F.regexp_replace(stem, r"(?i)resume|curriculum|vitae|\bcv\b|final|updated|[0-9]+", " "), r"[_\-.\s]+", " ")))

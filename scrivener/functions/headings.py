"""Headings: aliases, canonical names and the tests of heading lines, as Column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, longest_of, strip

#: Headings of each section; the first section that fits wins.
ALIASES = {
    "name": ("name", "personal details", "personal information"),
    "summary": ("summary", "professional summary", "career summary", "career objective", "objective", "profile", "about me", "about", "introduction"),
    "skills": (
        "skills", "technical skills", "key skills", "core skills", "skill set", "skills summary", "technical expertise", "technical competencies", "technical proficiencies",
        "technical knowledge", "tools and technologies", "tools & technologies", "technologies", "software skills", "programming skills", "technology stack", "tech stack", "core competencies",
        "competencies", "professional skills", "areas of expertise", "computer skills", "it skills", "soft skills",
    ),
    "education": (
        "education", "education qualification", "educational background", "educational qualifications", "academic qualifications", "education and qualifications", "education & qualifications",
        "education details", "education background", "academic background", "educational profile", "educational summary", "academic credentials", "education and training", "qualification",
        "qualifications", "degree", "degrees",
    ),
    "experience": (
        "experience", "work experience", "professional experience", "employment history", "employment", "work history", "job history", "career history", "internship", "internships",
        "professional background", "career timeline",
    ),
    "projects": ("projects", "project", "project details", "project work", "project experience", "key projects", "academic projects", "personal projects"),
    "certifications": (
        "certifications", "certification", "certificates", "professional certifications", "technical certifications", "certifications and training", "certifications & training",
        "training and certifications", "training & certifications", "licenses and certifications", "licenses & certifications", "credentials", "professional credentials",
        "courses and certifications", "certifications and courses", "certifications & courses", "certifications/courses",
    ),
    "awards": ("awards", "achievements", "select achievements", "key achievements", "honors", "recognition", "accomplishments", "awards and achievements"),
    "languages": ("languages", "languages known", "language skills", "language proficiency", "known languages"),
    "interests": ("interests", "interests & hobbies", "hobbies", "personal interests", "activities"),
    "references": ("references", "referees", "recommendations", "professional references", "references upon request"),
    "publications": ("publications", "papers", "research", "journal articles"),
    "volunteer": ("volunteer", "volunteering", "community service", "social work"),
    "training": ("training", "trainings attended", "workshops", "seminars", "courses"),
    "patents": ("patents", "inventions"),
    "presentations": ("presentations", "talks", "lectures"),
    "affiliations": ("affiliations", "memberships"),
    "service": ("service",),
    "strengths": ("strengths", "core strengths"),
    "declaration": ("declaration", "statement"),
    "contact": ("contact", "personal profile", "contact details", "contact information"),
}
#: Words that may follow a heading.
TAIL_WORDS = "details|detail|summary|section|profile|background|history|overview|highlights|highlight|information|and"
#: Longest tail in blank-separated parts: two words and the signs around them.
TAIL_PARTS = 4


def normalize_line(line: Column) -> Column:
    """Lower case, bullets and dashes as hyphens, punctuation off both ends, white space collapsed."""
    t = F.regexp_replace(F.lower(strip(line)), "â€¢|•|â€“|â€”|–|—", "-")
    t = F.regexp_replace(F.regexp_replace(t, r"^[\-*.:;|_ ]+", ""), r"[\-*.:;|_ ]+$", "")
    return F.regexp_replace(t, r"(?U)\s+", " ")


def is_noise(normal: Column) -> Column:
    """Empty, over 64 characters, with @ or a backslash, or without a letter."""
    return (normal == "") | (F.length(normal) > 64) | normal.rlike(r"[@\\]") | normal.rlike(r"(?U)^[\d\W_]+$")


def allowed_tail(tail: Column) -> Column:
    """Nothing, or one or two of the tail words between blanks, slashes and &."""
    return (tail == "") | tail.rlike(rf"^[\s/&]*(?:{TAIL_WORDS})(?:[\s/&]+(?:{TAIL_WORDS}))?[\s/&]*$")


def _shorter(alias: str) -> list[str]:
    """The alias without a tail that allowed_tail takes."""
    parts = alias.split(" ")
    tail = rf"[\s/&]*(?:{TAIL_WORDS})(?:[\s/&]+(?:{TAIL_WORDS}))?[\s/&]*"
    return [" ".join(parts[:-k]) for k in range(1, min(TAIL_PARTS, len(parts) - 1) + 1) if re.fullmatch(tail, " ".join(parts[-k:]))]


#: First words of the aliases: a line that begins otherwise is no heading, and nothing more is asked about it.
_FIRST = sorted({alias.split(" ")[0] for words in ALIASES.values() for alias in words})
_ALL = sorted({alias for words in ALIASES.values() for alias in words})
#: The aliases as they are, by the section that each heads: that of itself or of what is left of it without tail words.
_HEADED_BY = {
    alias: next(name for name, words in ALIASES.items() if any(head in words for head in [alias, *_shorter(alias)])) for alias in _ALL
}
#: What a line that heads a section begins with, before it is made normal: signs, and the first word of an alias to its end.
_POSSIBLE = rf"[[\P{{L}}â]&&[^\n]]*+{longest_of(_FIRST)}(?![\p{{L}}&&[^â]])"


def canonical(line: Column) -> Column:
    """The section that the line heads, or null.

    Hashed set look-ups: the whole line, or the line without a tail of a few words. No join is needed. Most lines are
    settled by their first word as it stands, and sections are told apart only where one of all aliases has been found.
    """

    def heads_of(p: Column, normal: Column) -> Column:
        heads = [(F.lit(True), normal)]
        for k in range(1, TAIL_PARTS + 1):
            n = F.size(p) - k
            head = F.when(n > 0, F.array_join(F.slice(p, 1, F.greatest(n, F.lit(0))), " "))
            tail = F.array_join(F.slice(p, F.greatest(n, F.lit(0)) + 1, k), " ")
            heads.append(((n > 0) & allowed_tail(tail), head))
        return F.filter(F.array(*[F.when(F.coalesce(ok, F.lit(False)), head) for ok, head in heads]), lambda h: F.coalesce(h.isin(*_ALL), F.lit(False)))

    def named(heads: Column) -> Column:
        any_of = lambda words: F.exists(heads, lambda h: h.isin(*words))
        return F.when(F.size(heads) > 0, F.coalesce(*[F.when(any_of(words), name) for name, words in ALIASES.items()]))

    def section(normal: Column) -> Column:
        possible = F.substring_index(normal, " ", 1).isin(*_FIRST) & ~is_noise(normal)
        return F.when(possible, let(F.split(normal, " "), lambda p: let(heads_of(p, normal), named)))

    def plain(low: Column) -> Column:
        return F.coalesce(*[F.when(low.isin(*[a for a in _ALL if _HEADED_BY[a] == name]), name) for name in ALIASES])

    known = let(F.btrim(F.lower(line), F.lit("-*.:;|_ ")), plain)  # most headings are an alias and signs, and need no more
    return F.when(line.rlike(f"(?iU)^{_POSSIBLE}"), F.coalesce(known, let(normalize_line(line), section)))


def parts(text: Column) -> Column:
    """The text as an array of parts; every line that may be a heading begins one, what follows it stands in it."""
    return F.split(text, rf"(?iU)\n(?={_POSSIBLE})")


def key_of(line: Column) -> Column:
    """Canonical name, else ``custom_`` and the start of the line."""
    short = let(F.substring(F.replace(normalize_line(line), F.lit(" "), F.lit("_")), 1, 24), lambda s: F.when(s == "", "custom_unknown").otherwise(F.concat(F.lit("custom_"), s)))
    return F.coalesce(canonical(line), short)


def probable_heading(line: Column) -> Column:
    """As canonical, for a line of at most 72 characters without @ and backslash."""
    return F.when((line != "") & (F.length(line) <= 72) & ~line.rlike(r"[@\\]"), canonical(line))


#: Words that make a short line look like a heading.
HEADING_TERMS = (
    "summary|objective|profile|skills|competencies|education|experience|employment|projects|certification|achievements|awards|references|languages|interests|declaration|training|technologies"
)


def looks_like_heading(line: Column) -> Column:
    """A known heading, or at most six words of which all that begin with a letter begin with a capital."""
    words = F.filter(F.split(strip(line), r"(?U)\s+"), lambda w: w != "")
    lettered = F.filter(words, lambda w: w.rlike(r"\p{L}"))
    titled = F.forall(lettered, lambda w: ~w.rlike(r"^\p{L}") | w.rlike(r"^\p{Lu}"))
    plain = (F.length(line) <= 64) & ~line.startswith("- ") & ~line.rlike(r"[@\\]") & ~line.rlike(r"[.;,]$") & F.size(words).between(1, 6)
    shape = F.lower(line).rlike(HEADING_TERMS) | ((F.size(lettered) > 0) & (titled | (F.upper(line) == line)))
    return (line != "") & (probable_heading(line).isNotNull() | (plain & shape))


def is_continuation(previous: Column, line: Column) -> Column:
    """The line goes on with the one before; only the end of that one matters."""
    # no lower-case letter comes before a, and the words that join (and, or, with, to, for, in) begin with one
    joins = previous.endswith("-") | ((line >= "a") & line.rlike(r"^\p{Ll}"))
    capitals = line.rlike(r"^[A-Z][A-Z ]+$") & (F.length(line) < 36)
    # cheap tests first: few lines are left to be looked up as headings
    possible = (previous != "") & (line != "") & joins & ~line.startswith("- ") & ~line.rlike(r"^(19|20)\d{2}") & ~capitals & ~previous.endswith(":")
    return possible & ~looks_like_heading(line)


def headings_confidence(sections: Column, titles: Column, total: Column, length: Column) -> Column:
    """Of the counts of sections, distinct titles, headings, and characters of the text."""
    score = F.least(sections / 6.0, F.lit(1.0)) * 0.40 + (titles / F.greatest(total, F.lit(1))) * 0.35 + F.least(length / 4000.0, F.lit(1.0)) * 0.25
    return F.when(total > 0, F.round(F.least(score, F.lit(1.0)), 2)).otherwise(0.0)

"""Section extractors: one operator, parameterised by section.

A document is one row and so is its array of lines; headers, stops and kept lines are found by higher-order functions
inside the row, so extracting any number of sections is one scan without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import hits, non_blank_lines, share
from ..functions.text import distinct_ci, lines_of, let, longest_of, places, strip, text_or_empty

SEPARATOR = r"^[-–—=_*#]+$"
YEARS_ONLY = r"^(?:19|20)\d{2}(?:\s*[-–]\s*(?:19|20)\d{2})?$"


@dataclass(frozen=True)
class Section:
    """How a section is captured and scored.

    A line is a header if it is one of ``headers``, starts with one and is shorter than ``prefix``, or has one after a
    blank, hyphen or colon and is shorter than ``inner``. It is a stop if it is one of ``stops`` or begins with one
    (``loose``: anything may follow; else white space, colon or dash), or contains one and is shorter than ``contains``;
    unless loose, the last holds only once something is captured. ``confidence`` is (items, weight, matches, weight,
    characters, weight); ``boost`` multiplies what is above (score, length). Where the headers find nothing, lines with one of
    ``keywords`` are taken, each with the line before if that is shorter than ``before``, has at most ``words`` words and no
    stop word.
    """

    name: str
    headers: tuple[str, ...]
    stops: tuple[str, ...]
    prefix: int = 50
    inner: int = 0
    loose: bool = False
    contains: int = 0
    shortest: int = 1
    no_years: bool = False
    distinct: str = "ci"
    only: str = ""
    patterns: tuple[str, ...] = ()
    confidence: tuple[float, ...] = (3, 0.4, 3, 0.4, 100, 0.2)
    boost: tuple[float, float, int] | None = None
    keywords: tuple[str, ...] = ()
    before: int = 50
    words: int = 1000


#: Header words, stop words and patterns of the sections.
_COMMON = ("skills", "education", "experience", "projects", "certifications", "summary", "about", "interests", "hobbies", "references", "declaration", "languages")
LANGUAGES = (
    "english|hindi|telugu|tamil|kannada|malayalam|marathi|gujarati|bengali|punjabi|urdu|french|german|spanish|portuguese|italian|chinese|japanese|korean|arabic|russian|dutch"
    "|swedish|norwegian|danish|finnish|polish|turkish|vietnamese|thai|indonesian|malay|tagalog|swahili|hebrew|greek|latin|sanskrit"
)
AWARD_WORDS = (
    r"\b(awarded|won|received|achieved|earned|granted)\b", r"\b(prize|medal|certificate|recognition|trophy|plaque)\b", r"\b(winner|first|second|third|top|best|honorable)\b",
    r"\b(competition|contest|event|hackathon|challenge)\b", r"\b(scholarship|fellowship|stipend)\b", r"\b(dean.*list|president.*list|honor.*roll)\b",
)
CERTIFICATE_WORDS = (
    r"\bcertified\b", r"\bcertificate\b", r"\bcertification\b", r"\baws\b", r"\bazure\b", r"\bgcp\b", r"\bgoogle cloud\b", r"\bpmp\b", r"\bscrum\b", r"\bagile\b", r"\bpmi\b", r"\bitil\b",
    r"\bccna\b", r"\bccnp\b", r"\bmcse\b", r"\bmcsa\b", r"\biso\b", r"\bceh\b", r"\bcissp\b", r"\bcisa\b", r"\bcomptia\b", r"\bsalesforce\b", r"\boracle\b", r"\bjava\b", r"\bpython\b",
    r"\bmicrosoft certified\b", r"\bgoogle certified\b", r"\bcisco\b", r"\bvmware\b", r"\bredhat\b", r"\bprofessional\b", r"\bspecialist\b", r"\bexpert\b",
)
REFERENCE_WORDS = (r"\b(reference|referee|recommend)\b", r"\b(contact|phone|email)\b", r"\b(mr\.|mrs\.|ms\.|dr\.)\b", r"\b(professor|manager|director|ceo|cto|vp|head)\b")
SECTIONS = (
    Section(
        "education",
        (
            "education", "education qualification", "educational qualifications", "academic qualifications", "education & qualifications", "education details", "education background",
            "educational background", "academic background", "educational profile", "educational summary", "academic credentials", "qualification", "qualifications", "academic details",
            "degree", "degrees",
        ),
        (
            "skills", "projects", "certifications", "experience", "summary", "about", "technical skills", "work experience", "employment", "internships", "achievements", "awards", "objective",
            "career objective", "project details", "training", "trainings attended",
        ),
        inner=40, loose=True, shortest=3, no_years=True, distinct="cs",
        patterns=(r"\b(bachelor|master|phd|doctorate|diploma|certificate)\b", r"\b(20\d{2}|19\d{2})\b", r"\b(university|college|institute|school)\b", r"\b(gpa|grade|percentage|score)\b"),
        confidence=(5, 0.4, 8, 0.4, 300, 0.2),
    ),
    Section(
        "experience",
        (
            "experience", "work experience", "employment history", "employment", "professional experience", "work history", "job history", "career history", "internship", "internships",
            "practical experience", "work experience details", "employment details", "professional history", "career details", "job profile", "responsibilities", "duties", "employment record",
            "professional background", "career timeline", "job experience",
        ),
        (
            "skills", "education", "projects", "certifications", "summary", "about", "technical skills", "strength", "strengths", "personal details", "extra-curricular activities", "languages",
            "interests", "hobbies", "references", "declaration", "objective", "career objective", "introduction", "contact", "achievements", "awards", "publications", "volunteer experience",
            "training", "workshops", "seminars", "awards & achievements",
        ),
        prefix=60, loose=True, distinct="cs",
        patterns=(
            r"\b(company|organization|employer|work|job|role|position)\b", r"\b(20\d{2}|19\d{2})\b", r"\b(developer|engineer|manager|analyst|designer|consultant|intern|trainee)\b",
            r"\b(junior|senior|lead|head|principal|staff)\b", r"\b(responsible|duties|achievements|developed|created|managed|implemented)\b", r"\b(present|current|ongoing)\b",
        ),
        confidence=(5, 0.3, 8, 0.4, 500, 0.3), boost=(1.1, 0.7, 0),
    ),
    Section(
        "projects",
        (
            "projects", "project", "academic projects", "personal projects", "project experience", "project details", "key projects", "project work", "major projects", "minor projects",
        ),
        (
            "education", "experience", "technical skills", "soft skills", "skills", "certifications", "certificates", "languages", "declaration", "summary", "about", "contact", "references",
            "achievements", "awards",
        ),
        prefix=60, loose=True, no_years=True, distinct="",
        patterns=(
            r"\b(developed|built|created|designed|implemented|led)\b", r"\b(python|java|javascript|react|angular|node|django|flask)\b",
            r"\b(machine learning|data science|api|database|web)\b", r"\b(github|gitlab|heroku|aws|azure)\b", r"\b(project|team|application|system)\b",
            r"\b(analysis|design|development|testing)\b",
        ),
        confidence=(5, 0.4, 5, 0.4, 200, 0.2), boost=(1.2, 0.3, 20),
    ),
    Section(
        "certifications",
        (
            "certifications", "certificates", "certification", "credentials", "licenses", "licenses & certifications", "certifications & licenses", "professional certifications",
            "certifications earned", "certifications obtained", "certified", "license", "certifications and licenses", "professional credentials", "certification details",
        ),
        (
            "skills", "projects", "education", "experience", "summary", "about", "technical skills", "work experience", "employment", "internships", "achievements", "awards", "languages",
            "interests", "hobbies", "references", "declaration", "contact", "personal details",
        ),
        inner=40, contains=30, shortest=3, no_years=True,
        keywords=CERTIFICATE_WORDS,
        patterns=(
            r"\b(certified|certificate|certification)\b", r"\b(aws|azure|gcp|google|amazon|microsoft)\b", r"\b(pmp|scrum|agile|pmi|itil|ccna|ccnp|mcse|mcsa)\b",
            r"\b(iso|ceh|cissp|cisa|comptia)\b",
        ),
        confidence=(5, 0.4, 5, 0.4, 200, 0.2),
    ),
    Section(
        "awards",
        (
            "awards", "achievements", "honors", "recognition", "accomplishments", "awards & achievements", "awards and achievements", "honors & awards", "achievements & awards",
            "awards received", "awards earned", "honors and awards", "professional awards", "academic honors", "awards and recognitions", "certifications and awards",
        ),
        (
            "skills", "projects", "education", "experience", "certifications", "summary", "about", "technical skills", "work experience", "employment", "internships", "languages", "interests",
            "hobbies", "references", "declaration", "contact", "personal details", "publications", "volunteer", "training", "workshops",
        ),
        inner=40, contains=30, shortest=3, no_years=True,
        patterns=AWARD_WORDS, keywords=AWARD_WORDS,
        confidence=(5, 0.4, 5, 0.4, 150, 0.2), boost=(1.2, 0.3, 20),
    ),
    Section(
        "references",
        (
            "references", "referees", "recommendations", "professional references", "personal references", "character references", "reference available", "references furnished",
            "references upon request",
        ),
        (
            "skills", "projects", "education", "experience", "certifications", "summary", "about", "technical skills", "work experience", "employment", "internships", "languages", "interests",
            "hobbies", "awards", "achievements", "declaration", "contact", "personal details", "publications", "volunteer", "training", "workshops", "signature",
        ),
        inner=40, contains=30, shortest=3, no_years=True,
        patterns=REFERENCE_WORDS, keywords=REFERENCE_WORDS, before=60, words=5,
        boost=(1.2, 0.3, 30),
    ),
    Section(
        "contact",
        ("contact", "contact details", "contact information", "personal details", "personal information", "contact me", "reach me", "communication details"),
        _COMMON, inner=40, contains=30, shortest=3,
        patterns=(r"[\w.-]+@[\w.-]+\.\w+", r"\+?[\d\s\-–()]{10,}", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", r"[\w\s,]+,\s*[\w\s]+,\s*[\w\s]+"),
        confidence=(3, 0.4, 2, 0.4, 100, 0.2), boost=(1.2, 0.3, 20),
    ),
    Section(
        "declaration",
        ("declaration", "statement", "legal declaration", "affidavit", "declaration statement", "personal declaration", "certification"),
        ("skills", "education", "experience", "projects", "certifications", "summary", "about", "interests", "hobbies", "references", "languages"), inner=40, contains=30, shortest=3,
        patterns=(r"\b(declare|declared|hereby|certify|certified)\b", r"\b(believe|truth|accurate|best of my knowledge)\b", r"\b(signature|date|place)\b"),
        confidence=(3, 0.4, 3, 0.4, 200, 0.2), boost=(1.2, 0.3, 20),
    ),
    Section(
        "strengths",
        (
            "strengths", "strength", "key strengths", "personal strengths", "core strengths", "strong suits", "key competencies", "personal qualities", "soft skills", "key attributes",
            "positive traits", "professional strengths",
        ),
        (*_COMMON, "awards", "achievements"), inner=40, contains=30, shortest=3,
        patterns=(
            r"\b(leadership|communication|teamwork|problem.solving|critical.thinking)\b", r"\b(analytical|creative|innovative|adaptable|flexible)\b",
            r"\b(organized|detail.oriented|time.management|multitasking)\b", r"\b(confident|self.motivated|proactive|ambitious)\b",
        ),
        boost=(1.2, 0.3, 20),
    ),
    Section(
        "training",
        (
            "training", "trainings", "workshops", "seminars", "courses", "professional development", "training & development", "training programs", "workshops & seminars", "training courses",
            "corporate training", "skill development", "learning & development", "trainings attended", "internship", "internships",
        ),
        (*_COMMON, "awards", "achievements", "publications"), inner=40, contains=30, shortest=3, no_years=True,
        patterns=(r"\b(training|workshop|seminar|course|certified|completed)\b", r"\b(attended|participated|undergone|undertook)\b", r"\b(certificate|diploma|program|bootcamp)\b"),
        confidence=(3, 0.4, 3, 0.4, 150, 0.2), boost=(1.2, 0.3, 20),
    ),
    Section(
        "extra-curricular",
        (
            "extra-curricular", "extracurricular", "co-curricular", "extra curricular", "extracurricular activities", "extra-curricular activities", "co-curricular activities", "activities",
            "sports", "games", "cultural activities", "leadership activities", "club activities", "events", "competitions",
        ),
        (
            "skills", "education", "experience", "projects", "certifications", "summary", "about", "references", "declaration", "languages", "awards", "achievements", "publications",
            "volunteer",
        ),
        inner=40, contains=30, shortest=3, no_years=True,
        patterns=(
            r"\b(sports|football|cricket|basketball|tennis|badminton)\b", r"\b(dance|music|drama|art|painting|photography)\b", r"\b(club|society|committee|event|competition)\b",
            r"\b(captain|lead|organizer|coordinator|volunteer)\b",
        ),
        boost=(1.2, 0.3, 20),
    ),
    Section(
        "languages",
        ("languages", "language skills", "known languages", "language proficiency", "linguistic skills", "communication skills", "spoken languages"),
        ("skills", "education", "experience", "projects", "certifications", "summary", "about", "interests", "hobbies", "references", "declaration"), loose=True, distinct="cs", only=f"(?:{LANGUAGES})",
        patterns=(f"(?m)^.*?(?:{LANGUAGES}).*$",),
    ),
    Section(
        "interests",
        ("interests", "hobbies", "personal interests", "activities", "interest", "hobby", "leisure activities", "pastimes"),
        (
            "skills", "education", "experience", "projects", "certifications", "summary", "references", "declaration", "languages", "personal profile", "languages known", "email", "mobile",
            "contact",
        ),
        loose=True, distinct="cs", confidence=(3, 0.5, 1, 0.0, 100, 0.5),
    ),
    Section(
        "achievements",
        ("achievements", "awards", "honors", "recognition", "accomplishments", "awards & achievements", "awards and achievements", "honors & awards"),
        (
            "skills", "education", "experience", "projects", "certifications", "summary", "references", "declaration", "languages", "interests", "professional experience", "work experience",
            "employment history", "tools & technologies", "tools and technologies", "additional information",
        ),
        loose=True, distinct="cs",
        patterns=(r"\b(awarded|won|received|achieved|earned|granted)\b", r"\b(prize|medal|certificate|recognition|trophy)\b", r"\b(winner|first|second|third|top|best)\b"),
        confidence=(3, 0.4, 3, 0.3, 150, 0.3),
    ),
    Section(
        "publications",
        ("publications", "papers", "research", "conference papers", "journal articles", "thesis", "dissertation", "books", "presentations"),
        ("skills", "education", "experience", "projects", "certifications", "summary", "references", "declaration", "awards"), loose=True, distinct="cs",
        patterns=(r"\b(published|presented|conference|journal|paper|article)\b", r"\b(research|study|analysis)\b", r"\b(isbn|doi|volume|issue)\b"),
        confidence=(3, 0.4, 3, 0.3, 200, 0.3),
    ),
    Section(
        "volunteer",
        ("volunteer", "volunteering", "community service", "social work", "charity", "community involvement", "social activities"),
        ("skills", "education", "experience", "projects", "certifications", "summary", "references", "declaration", "awards"), loose=True, distinct="cs",
        patterns=(r"\b(volunteer|community|charity|non-profit|social)\b", r"\b(organization|foundation|trust|society)\b"),
        confidence=(3, 0.4, 2, 0.3, 150, 0.3),
    ),
)
BY_NAME = {s.name: s for s in SECTIONS}
_AFTER_CONTACT = (
    "skills", "education", "experience", "projects", "certifications", "summary", "about", "interests", "hobbies", "references", "declaration", "languages", "awards", "achievements",
    "publications", "volunteer",
)
#: Headed sections of addresses, numbers and links.
CONTACTS = (
    Section(
        "email", ("email", "email address", "email id", "e-mail", "mail", "electronic mail", "contact email", "personal email", "official email", "email id:"), (*_AFTER_CONTACT, "training"),
        contains=30, shortest=3,
    ),
    Section(
        "phone",
        (
            "phone", "phone number", "contact number", "mobile", "mobile number", "telephone", "tel", "cell", "cell number", "phone no", "phone no.", "contact phone", "phone:", "mobile:", "tel:",
            "ph:", "ph no",
        ),
        (*_AFTER_CONTACT, "training"), contains=30, shortest=3,
    ),
    Section(
        "links", ("links", "contact links", "social links", "profiles", "online profiles", "web links", "website", "urls", "social media", "portfolio"), _AFTER_CONTACT, contains=30, shortest=3,
    ),
)


def _one_of(words: Sequence[str]) -> str:
    """Longest first, so that the alternation finds the longest word that fits."""
    return "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-").replace("\\&", "&") for w in sorted(set(words), key=lambda w: (-len(w), w)))


def _any_word(patterns: Sequence[str]) -> str:
    """One pattern for all: those between word boundaries share theirs, so that nothing is tried inside a word."""
    inner = [p[2:-2] for p in patterns if p.startswith(r"\b") and p.endswith(r"\b")]
    rest = [p for p in patterns if not (p.startswith(r"\b") and p.endswith(r"\b"))]
    return "|".join(([rf"\b(?:{'|'.join(inner)})\b"] if inner else []) + rest)


def header_pattern(s: Section) -> tuple[str, str, str]:
    """(exact, prefix, inner) patterns over the lower-cased line."""
    any_ = _one_of(s.headers)
    return f"^(?:{any_})$", f"^(?:{any_})", f"[ :-](?:{any_})"


def stop_pattern(s: Section) -> tuple[str, str]:
    """(begins, contains) patterns over the lower-cased line."""
    any_ = _one_of(s.stops)
    return (f"^(?:{any_})" if s.loose else f"^(?:{any_})(?:$|[\\s:–—-])"), f"(?:{any_})"


def is_header(line: Column, s: Section) -> Column:
    return _is_header(F.lower(line), s)


def _is_header(low: Column, s: Section) -> Column:
    """The same of a line in lower case; the length, which settles most lines, is looked at first."""
    exact, prefix, inner = header_pattern(s)
    test = (F.length(low) < s.prefix) & low.rlike(prefix)
    if max(map(len, s.headers)) >= s.prefix:
        test = test | low.rlike(exact)
    return test | ((F.length(low) < s.inner) & low.rlike(inner)) if s.inner else test


def keeps(line: Column, s: Section) -> Column:
    test = (line != "") & ~line.rlike(SEPARATOR) & (F.length(line) >= s.shortest)
    if s.no_years:
        test = test & ~line.rlike(YEARS_ONLY)
    return test & F.lower(line).rlike(s.only) if s.only else test


#: What may follow a stop that begins a line: the line's end, or one of these.
_BOUNDARY = "[\\s:–—-]"


def _bits(test: Callable[[Section], bool], sections: Sequence[Section]) -> int:
    return sum(1 << k for k, s in enumerate(sections) if test(s))


def _front_facts(word: str, sections: Sequence[Section]) -> tuple[int, int, int, int]:
    """Of the longest word in front of a line: bits of the sections that it heads, heads if it is the whole line, stops, and stops if a boundary follows.

    Every word in front of the line is in front of the longest one, so this one tells them all.
    """
    bounded = lambda w: len(w) < len(word) and re.match(_BOUNDARY, word[len(w)]) is not None
    return (
        _bits(lambda s: word.startswith(s.headers), sections),
        _bits(lambda s: word in s.headers, sections),
        _bits(lambda s: any(word.startswith(w) and (s.loose or bounded(w)) for w in s.stops), sections),
        _bits(lambda s: word in s.stops, sections),
    )


def _place(words: Sequence[str], word: Column) -> Column:
    """Where the word stands among the words; behind them if it does not."""
    at = F.map_from_arrays(F.lit(list(words)), F.lit(list(range(len(words)))))
    return F.when(word == "", len(words)).otherwise(F.coalesce(F.try_element_at(at, word), F.lit(len(words))))


def _at(values: Sequence[int], place: Column) -> Column:
    """The value at the place, 0 behind them."""
    return F.get(F.lit([*values, 0]).cast("array<bigint>"), place)


def _shorter_than(n: Column, limits: Sequence[int], bits: Sequence[int]) -> Column:
    """The bits of the sections whose limit the length is below."""
    below = lambda limit: sum(b for own, b in zip(limits, bits, strict=True) if own >= limit)
    test = F.lit(0).cast("bigint")
    for limit in sorted(set(limits), reverse=True):
        test = F.when(n < limit, F.lit(below(limit)).cast("bigint")).otherwise(test)
    return test


def marks(lows: Column, sections: Sequence[Section]) -> Column:
    """Array of (i, heads, stops): the lines in lower case that may head or end one of the sections, with their places; asked once for all.

    heads and stops have a bit for each of the sections, in their order: the line is a header of it, or begins with a stop of it.
    A line without any of their words in front, or a header's word behind a sign, does neither.
    """
    words, behind = sorted({w for s in sections for w in (*s.headers, *s.stops)}), sorted({w for s in sections if s.inner for w in s.headers})
    most, each = max(s.inner for s in sections), [1 << k for k in range(len(sections))]
    heads, whole, stops, ends = zip(*[_front_facts(w, sections) for w in words], strict=True)
    none = F.array().cast("array<string>")

    def told(low: Column, i: Column, word: Column, inside: Column, place: Column) -> Column:
        n = F.length(low)
        of = lambda values: _at(values, place)
        heading = of(heads).bitwiseAND(_shorter_than(n, [s.prefix for s in sections], each))
        if any(len(w) >= s.prefix for s in sections for w in s.headers):
            heading = heading.bitwiseOR(F.when(word == low, of(whole)).otherwise(F.lit(0).cast("bigint")))
        if most:
            inner = [_bits(lambda s, w=w: bool(s.inner) and w.startswith(s.headers), sections) for w in behind]
            every = F.aggregate(inside, F.lit(0).cast("bigint"), lambda a, w: a.bitwiseOR(_at(inner, _place(behind, w))))
            heading = heading.bitwiseOR(every.bitwiseAND(_shorter_than(n, [s.inner for s in sections], each)))
        after = F.substring(low, F.length(word) + 1, 1)
        ending = F.when(after.rlike(f"^(?:$|{_BOUNDARY})"), of(ends)).otherwise(F.lit(0).cast("bigint"))
        return F.struct(i.alias("i"), heading.alias("heads"), of(stops).bitwiseOR(ending).alias("stops"))

    def one(low: Column, i: Column) -> Column:
        front = F.regexp_extract(low, f"^(?:{longest_of(words)})", 0)
        inside = F.when(F.length(low) < most, F.regexp_extract_all(low, F.lit(f"[ :-](?=({longest_of(behind)}))"), F.lit(1))).otherwise(none) if most else none
        return let(front, lambda word: let(inside, lambda found: F.when((word != "") | (F.size(found) > 0), let(_place(words, word), lambda at: told(low, i, word, found, at)))))

    return F.filter(F.transform(lows, one), lambda r: r.isNotNull())


def capture(lines: Column, s: Section, marked: Column | None = None, place: int = 0) -> Column:
    """The kept lines between the first header and the first stop after it; further headers are skipped.

    marked: ``marks`` of the lines, if they are at hand, and the section's place among those they were asked for. Only they are
    looked at for headers and for a stop that begins a line, and only what stands between is looked at line by line.
    """
    marked = marks(F.transform(lines, lambda x: F.lower(x)), [s]) if marked is None else marked
    last, bit = F.lit(1 << 30), F.lit(1 << place).cast("bigint")
    has = lambda bits: bits.bitwiseAND(bit) != 0
    first = lambda rows, test: F.get(F.filter(rows, test), F.lit(0))["i"]
    head_at = F.transform(F.filter(marked, lambda r: has(r["heads"])), lambda r: r["i"])

    def kept_of(rows: Column, h: Column, heads: Column) -> Column:
        head = lambda i: F.array_contains(heads, i + h + 1)
        if not s.contains:
            return F.filter(rows, lambda x, i: keeps(x, s) & ~head(i))
        soft = lambda x: (F.length(x) < s.contains) & F.lower(x).rlike(longest_of(s.stops))
        facts = lambda x, i: F.struct(i.alias("i"), x.alias("x"), (soft(x) & ~head(i)).alias("soft"), (keeps(x, s) & ~head(i)).alias("keep"))
        kept = lambda rows: F.transform(F.filter(rows, lambda r: r["keep"]), lambda r: r["x"])

        def inside(rows: Column) -> Column:
            begun = F.coalesce(first(rows, lambda r: r["keep"]), last) if not s.loose else F.lit(-1)
            stop = lambda b: F.coalesce(first(rows, lambda r: r["soft"] & (r["i"] > b)), last)
            return let(let(begun, stop), lambda end: kept(F.filter(rows, lambda r: r["i"] < end)))

        return let(F.transform(rows, facts), inside)

    def between(heads: Column) -> Column:
        def piece(h: Column) -> Column:
            end = F.coalesce(first(marked, lambda r: (r["i"] > h) & has(r["stops"]) & ~has(r["heads"])), F.size(lines))
            return kept_of(F.slice(lines, h + 2, F.greatest(end - h - 1, F.lit(0))), h, heads)

        return F.when(F.size(heads) > 0, let(F.get(heads, F.lit(0)), piece))

    kept = let(let(head_at, between), lambda a: F.coalesce(a, F.array().cast("array<string>")))
    if s.distinct == "cs":
        return F.array_distinct(kept)
    if s.distinct == "ci":
        return let(kept, lambda a: let(F.transform(a, lambda x: F.lower(x)), lambda low: F.filter(a, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))
    return kept


def with_marks(text: Column, sections: Sequence[Section], body: Callable[[Column, Column], Column]) -> Column:
    """body(lines, marks) of a text, both computed once."""
    lines = F.transform(lines_of(text), lambda x: strip(x))
    return let(lines, lambda a: let(marks(F.transform(a, lambda x: F.lower(x)), sections), lambda m: body(a, m)))


def by_keywords(lines: Column, s: Section) -> Column:
    """The lines with a keyword and what may introduce them, distinct up to case."""

    stops = "|".join(re.escape(w) for w in s.stops)

    def pick(x: Column, i: Column) -> Column:
        previous = F.get(lines, i - 1)
        words = F.size(F.regexp_extract_all(previous, F.lit(r"\S+"), F.lit(0)))
        leads = (i > 0) & (previous != "") & (F.length(previous) < s.before) & ~F.lower(previous).rlike(stops) & (words <= s.words)
        return F.when(F.coalesce(leads, F.lit(False)), F.array(previous, x)).otherwise(F.array(x))

    hits_at = F.filter(F.transform(lines, lambda x, i: F.when(F.lower(x).rlike(_any_word(s.keywords)), i)), lambda i: i.isNotNull())
    return distinct_ci(F.flatten(F.transform(hits_at, lambda i: pick(F.get(lines, i), i))))


def confidence(text: Column, s: Section) -> Column:
    """Of items, matches and length, to two decimals; 0 for a blank text."""
    a, wa, b, wb, c, wc = s.confidence
    score = share(non_blank_lines(text), a, wa) + (share(hits(text, s.patterns), b, wb) if s.patterns and wb else F.lit(0.0)) + share(F.length(text), c, wc)
    if s.boost:
        factor, above, length = s.boost
        score = let(score, lambda v: F.when((v > above) & (F.length(text) > length), F.least(v * factor, F.lit(1.0))).otherwise(v))
    return F.when(F.trim(text) == "", 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 2))


def extract_sections(docs: DataFrame, sections: Sequence[Section] = SECTIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and section: doc_id, section, text, confidence; an absent section has an empty text and 0.

    Null and empty texts have no sections. One scan, no shuffle.
    """
    lines = F.transform(lines_of(F.col(text_col)), lambda x: strip(x))
    found = docs.select(F.col(id_col).alias("doc_id"), lines.alias("_lines")).withColumn("_marks", marks(F.transform("_lines", lambda x: F.lower(x)), sections))

    def text(place: int, s: Section) -> Column:
        own = capture(F.col("_lines"), s, F.col("_marks"), place)
        return F.array_join(let(own, lambda a: F.when(F.size(a) > 0, a).otherwise(by_keywords(F.col("_lines"), s))) if s.keywords else own, "\n")

    each = F.array(*[F.struct(F.lit(s.name).alias("section"), text(k, s).alias("text")) for k, s in enumerate(sections)])
    rows = found.select("doc_id", F.inline(each))
    score = F.coalesce(*[F.when(F.col("section") == s.name, confidence(F.col("text"), s)) for s in sections])
    return rows.select("doc_id", "section", "text", score.alias("confidence"))


#: What a line of skills is not.
_SKILL_HEADERS = (
    (
    "skills", "technical skills", "key skills", "core skills", "skill set", "skills summary", "technical expertise", "technical competencies", "technical proficiencies", "technical knowledge",
    "tools & technologies", "tools and technologies", "technologies", "software skills", "programming skills", "technology stack", "tech stack", "core competencies", "competencies",
    "professional skills", "areas of expertise", "strengths", "skills & abilities", "skills and abilities", "computer skills", "it skills", "technical skill", "skills set", "soft skills",
    "professional competencies", "technical abilities", "skill summary", "expertise", "technical profile", "skill profile", "technical skills & competencies",
)
)
_SKILL_STOPS = (
    (
    "education", "projects", "experience", "certifications", "summary", "about", "technical skills", "strength", "strengths", "personal details", "extra-curricular activities", "languages",
    "interests", "hobbies", "references", "declaration", "objective", "career objective", "introduction", "contact", "achievements", "awards", "publications", "volunteer experience",
    "internships", "work experience", "employment", "professional experience", "awards & achievements", "training", "trainings attended", "educational background", "education background",
    "project details", "personal profile", "languages known", "internship",
)
)
SKILLS = Section("skills", _SKILL_HEADERS, _SKILL_STOPS, inner=40, loose=True, contains=40, confidence=(5, 0.5, 1, 0.0, 200, 0.5), boost=(1.2, 0.3, 20))
NOT_SKILLS = (
    r"\b(?:19|20)\d{2}\b|(?:\d{1,2}/\d{4}\s*[-–]\s*\d{1,2}/\d{4})",
    r"\b(?:success|boost|excellence|award|winner|achiev)\b",
    r"\b(?:assistant|accountant|engineer|developer|manager|analyst|executive|specialist|intern|co\.|ltd|llp|inc)\b",
    r"\b(?:reviewed|managed|assisted|supported|developed|implemented|coordinated|authored|prepared|drafted|collaborated|achieved|reducing|improving)\b",
)
SKILL_NOISE = ("key achievements", "achievements", "core competencies", "languages", "education", "experience")
SINGLE_SKILLS = ("budgeting", "forecasting", "regulatory", "compliance", "taxation", "auditing", "accounting", "analysis", "excel", "python", "java", "sql")


def looks_like_skills(line: Column) -> Column:
    """A category with a colon, or a short phrase that is no date, role, sentence or name."""
    low = F.lower(line)
    words = F.size(F.regexp_extract_all(line, F.lit(r"\S+"), F.lit(0)))
    colon, letters = line.contains(":"), F.regexp_replace(line, "[^A-Za-z]", "")
    test = (F.length(line) >= 2) & ~F.trim(F.regexp_replace(low, "[^a-z ]", "")).isin(*SKILL_NOISE)
    for p in NOT_SKILLS:
        test = test & ~low.rlike(p)
    prose = (line.startswith("- ") & (words > 8)) | (~colon & ((words > 10) | (line.contains(",") & (words > 3)) | line.contains("."))) | line.rlike("[.;]$")
    name = (words == 1) & ~F.lower(letters).isin(*SINGLE_SKILLS) & letters.rlike("^[A-Z][a-z]+$")
    return test & ~prose & ~name & (colon | (words <= 7))


def extract_skills(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As extract_sections, for skills: a header after a stop opens the section again, and a line that starts with ``& `` goes on."""
    s = SKILLS
    begins, contains = stop_pattern(s)
    lines = F.filter(F.transform(lines_of(F.col(text_col)), lambda x: strip(x)), lambda x: x != "")

    def facts(x: Column, low: Column) -> Column:
        known = lambda head: F.struct(
            x.alias("x"), low.alias("low"), head.alias("head")
        )
        return let(_is_header(low, s), known)

    def step(a: Column, r: Column) -> Column:
        # only an open section is stopped, and nothing more is asked about the lines outside
        stops = a["on"] & ~r["head"] & (r["low"].rlike(begins) | ((F.length(r["x"]) < s.contains) & r["low"].rlike(contains)))
        return let(stops, lambda stop: moved(a, r, stop))

    def moved(a: Column, r: Column, stop: Column) -> Column:
        on = F.when(r["head"], True).when(stop, False).otherwise(a["on"])

        def grown(normal: Column) -> Column:
            joined = normal.startswith("& ") & (F.size(a["kept"]) > 0)
            more = F.when(joined, F.concat(F.slice(a["kept"], 1, F.greatest(F.size(a["kept"]) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.element_at(a["kept"], F.lit(-1)), normal))))
            return more.when(looks_like_skills(normal), F.array_append(a["kept"], normal)).otherwise(a["kept"])

        inside = a["on"] & ~r["head"] & ~stop & ~r["x"].rlike(SEPARATOR)
        return F.struct(on.alias("on"), F.when(inside, let(F.regexp_replace(r["x"], r"\s{2,}", " "), grown)).otherwise(a["kept"]).alias("kept"))

    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("kept"))
    kept = F.aggregate(F.transform(lines, lambda x: let(F.lower(x), lambda low: facts(x, low))), start, step, lambda a: a["kept"])
    unique = let(kept, lambda a: let(F.transform(a, lambda x: F.lower(x)), lambda low: F.filter(a, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))
    found = docs.select(F.col(id_col).alias("doc_id"), F.lit("skills").alias("section"), F.array_join(unique, "\n").alias("text"))
    return found.withColumn("confidence", confidence(F.col("text"), s))


#: Words of a summary.
SUMMARY_HEADERS = ("summary", "career summary", "professional summary", "objective", "career objective", "profile", "about me", "about", "introduction")
SUMMARY_PATTERNS = (r"\b(experienced|skilled|professional|dedicated|motivated)\b", r"\b(years|experience|expertise|proficient)\b")


def summary_confidence(text: Column) -> Column:
    n = F.length(text)
    size = F.when(n.between(50, 500), 0.6).when(n < 50, 0.3).otherwise(F.greatest(F.lit(0.5), 1.0 - (n - 500) / 1000.0))
    return F.when(F.trim(text) == "", 0.0).otherwise(F.round(F.least(size + share(hits(text, SUMMARY_PATTERNS), 3, 0.4), F.lit(1.0)), 2))


def extract_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines after a summary header up to another heading, joined by blanks."""
    from ..functions.headings import canonical

    s = Section("summary", SUMMARY_HEADERS, ("summary",))
    lines = F.filter(F.transform(lines_of(F.col(text_col)), lambda x: strip(x)), lambda x: x != "")
    skills = r"^(?:technical\s+)?skills\s*[:–—-]?\s*$|^(?:programming languages|web development|database|tools|soft skills)"

    def stops(x: Column) -> Column:
        return F.lower(x).rlike(skills) | F.coalesce(canonical(x) != "summary", F.lit(False))

    def body(behind: Column) -> Column:
        end = F.coalesce(F.get(places(behind, lambda x, _: stops(x)), F.lit(0)), F.size(behind))
        return let(end, lambda end: F.array_join(F.slice(behind, 1, end), " "))

    def after(rows: Column, h: Column) -> Column:
        """What stands behind the first header, further headers left out: only these lines are looked up as headings."""
        return F.when(h.isNotNull(), let(F.filter(F.slice(rows, F.coalesce(h, F.lit(0)) + 2, F.size(rows)), lambda x: ~is_header(x, s)), body))

    text = let(lines, lambda rows: let(F.get(places(rows, lambda x, _: is_header(x, s)), F.lit(0)), lambda h: after(rows, h)))
    found = docs.select(F.col(id_col).alias("doc_id"), F.lit("summary").alias("section"), text.alias("text"))
    return found.withColumn("text", text_or_empty(F.col("text"))).withColumn("confidence", summary_confidence(F.col("text")))


#: Fixed values of the generic extractor: headings of each kind, and patterns of some.
KINDS = {
    "name": ("name", "personal details", "personal information", "contact info", "profile"),
    "summary": ("summary", "career summary", "professional summary", "objective", "career objective", "profile", "about me", "about", "introduction"),
    "skills": (
        "skills", "technical skills", "key skills", "core skills", "skill set", "skills summary", "technical expertise", "technical competencies", "technical proficiencies", "technologies",
        "tools & technologies", "tools and technologies", "software skills", "programming skills", "technology stack", "tech stack", "competencies", "professional skills",
        "areas of expertise", "computer skills", "it skills", "skills & abilities", "skills and abilities",
    ),
    "education": (
        "education", "education qualification", "educational qualifications", "academic qualifications", "education & qualifications", "education details", "education background",
        "academic background", "educational profile", "educational summary", "academic credentials", "qualification", "qualifications", "academic details", "degree", "degrees",
    ),
    "experience": (
        "experience", "work experience", "employment history", "employment", "professional experience", "work history", "job history", "career history", "internship", "internships",
        "practical experience",
    ),
    "projects": (
        "projects", "project", "academic projects", "personal projects", "project experience", "project details", "key projects", "project work", "major projects", "minor projects",
    ),
    "certifications": (
        "certifications", "certificates", "certification", "credentials", "licenses", "licenses & certifications", "certifications & licenses", "professional certifications",
        "certifications earned", "certifications obtained", "certificate", "certified", "license",
    ),
    "awards": ("awards", "achievements", "honors", "recognition", "accomplishments", "awards & achievements", "awards and achievements"),
    "languages": ("languages", "language skills", "language proficiency", "known languages"),
    "interests": ("interests", "hobbies", "personal interests", "activities"),
    "references": ("references", "referees", "recommendations"),
    "declaration": ("declaration", "statement", "legal"),
    "contact": ("contact", "contact details", "contact information", "email", "phone", "address"),
    "publications": ("publications", "papers", "research", "conference papers"),
    "volunteer": ("volunteer", "volunteering", "community service", "social work"),
    "training": ("training", "workshops", "seminars", "courses", "professional development"),
    "strengths": ("strengths", "strength", "key strengths", "personal strengths", "core strengths"),
    "extra-curricular": ("extra-curricular", "extracurricular", "co-curricular"),
}
KIND_PATTERNS = {
    "skills": (
        r"\b(python|java|javascript|html|css|sql|react|angular|vue|node|django|flask)\b", r"\b(machine learning|deep learning|data science|artificial intelligence)\b",
        r"\b(aws|azure|gcp|docker|kubernetes|jenkins|git)\b", r"\b(c\+\+|c#|ruby|php|swift|kotlin|go|rust)\b", r"\b(mysql|postgresql|mongodb|redis|elasticsearch)\b",
        r"\b(framework|library|tool|platform|language)\b",
    ),
    "education": (
        r"\b(bachelor|master|phd|doctorate|diploma|certificate)\b", r"\b(20\d{2}|19\d{2})\b", r"\b(university|college|institute|school)\b", r"\b(gpa|grade|percentage|score)\b",
        r"\b(degree|graduation|passed)\b", r"\b(location|place)\b",
    ),
    "projects": (
        r"\b(developed|built|created|designed|implemented|led)\b", r"\b(python|java|javascript|react|angular|node|django|flask)\b", r"\b(machine learning|data science|api|database|web)\b",
        r"\b(github|gitlab|heroku|aws|azure)\b", r"\b(project|team|application|system)\b",
    ),
    "experience": (
        r"\b(company|organization|employer|work)\b", r"\b(20\d{2}|19\d{2})\b", r"\b(developer|engineer|manager|analyst|designer|consultant)\b", r"\b(intern|junior|senior|lead|head)\b",
        r"\b(responsible|duties|achievements)\b",
    ),
    "certifications": (
        r"\b(certified|certificate|certification)\b", r"\b(aws|azure|gcp|google|amazon|microsoft)\b", r"\b(pmp|scrum|agile|pmi|itil|ccna|ccnp|mcse|mcsa)\b",
        r"\b(iso|ceh|cissp|cisa|comptia)\b", r"\b(license|earned|obtained)\b",
    ),
    "awards": (
        r"\b(awarded|won|received|achieved)\b", r"\b(prize|medal|certificate|recognition)\b", r"\b(competition|contest|event)\b", r"\b(first|second|third|winner)\b",
    ),
}
#: Headings that should not stand inside another section: each takes a fifth of the confidence, down to two fifths.
FOREIGN = ("languages", "declaration", "references", "hobbies", "personal details", "certifications", "projects", "education", "experience", "skills")


def kind_headings() -> tuple[str, str]:
    """(a line that begins with a heading of any kind, a pattern for ends to strip): lines over 60 characters are no headings."""
    return f"^(?:{_one_of({w for words in KINDS.values() for w in words})})", r"[:\-–—]+$"


def by_kind(docs: DataFrame, kinds: Sequence[str] = tuple(KINDS), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section, text, confidence by one rule for all kinds: the lines between a heading that stands alone and the next heading of any kind.

    One scan for any number of kinds; unknown kinds raise KeyError, documents without the heading have an empty text and 0.
    """
    any_, _ = kind_headings()

    def flags(x: Column, i: Column, low: Column) -> Column:
        # signs at the end of a line don't tell whether it begins with a heading
        keep = (x != "") & ~x.rlike(SEPARATOR) & ~x.rlike(YEARS_ONLY)
        return F.struct(i.alias("i"), x.alias("x"), low.alias("low"), ((x != "") & (F.length(x) <= 60) & low.rlike(any_)).alias("head"), keep.alias("keep"))

    def body(rows: Column, heads: Column, kind: str) -> Column:
        start = F.get(F.filter(heads, lambda r: r["low"].rlike(f"^(?:{_one_of(KINDS[kind])})[\\s:–—-]*$")), F.lit(0))["i"]

        def after(b: Column) -> Column:
            end = F.coalesce(F.get(F.filter(heads, lambda r: (r["i"] > b) & r["head"]), F.lit(0))["i"], F.size(rows))
            return let(end, lambda e: F.transform(F.filter(F.slice(rows, b + 2, F.greatest(e - b - 1, F.lit(0))), lambda r: r["keep"]), lambda r: r["x"]))

        kept = let(let(start, after), lambda a: F.coalesce(a, F.array().cast("array<string>")))
        normal = lambda x: F.regexp_replace(F.lower(x), r"\s+", " ")
        return let(kept, lambda a: let(F.transform(a, normal), lambda low: F.filter(a, lambda x, i: F.array_position(low, normal(x)) == i + 1)))

    marked = F.transform(F.transform(lines_of(F.col(text_col)), lambda x: strip(x)), lambda x, i: let(F.lower(x), lambda low: flags(x, i, low)))
    # a heading of a kind begins with one of the words, whatever the line's length
    heads = lambda rows: F.filter(rows, lambda r: r["low"].rlike(any_))
    each = lambda rows, heads: F.array(*[F.struct(F.lit(k).alias("section"), F.array_join(body(rows, heads, k), "\n").alias("text")) for k in kinds])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.inline(let(marked, lambda m: let(heads(m), lambda h: each(m, h)))))
    score = F.coalesce(*[F.when(F.col("section") == k, kind_confidence(F.col("text"), k)) for k in kinds])
    return rows.select("doc_id", "section", "text", score.alias("confidence"))


def kind_confidence(text: Column, kind: str) -> Column:
    """Of lines, matches, characters and the kind's own words, less for headings of other kinds inside; to two decimals."""
    full, weight = (5, 0.4) if kind in ("skills", "education", "experience", "projects", "certifications") else (3, 0.3)
    own = sum((F.when(F.contains(F.lower(text), F.lit(w)), 1).otherwise(0) for w in KINDS[kind]), F.lit(0))
    score = share(non_blank_lines(text), 5, 0.3) + share(hits(text, KIND_PATTERNS.get(kind, ())), full, weight) + share(F.length(text), 200, 0.3) + share(own, 3, 0.1)
    rounded = let(score, lambda v: F.round(F.least(F.when(v > 0.7, F.least(v * 1.1, F.lit(1.0))).otherwise(v), F.lit(1.0)), 2))
    inside = F.concat(F.lit("\n"), F.lower(text), F.lit("\n"))
    foreign = sum((F.when(F.contains(inside, F.lit(f"\n{w}\n")), 1).otherwise(0) for w in FOREIGN if w != kind), F.lit(0))
    return F.when(F.trim(text) == "", 0.0).otherwise(F.round(F.when(foreign > 0, rounded * F.greatest(F.lit(0.4), 1 - foreign * 0.2)).otherwise(rounded), 2))

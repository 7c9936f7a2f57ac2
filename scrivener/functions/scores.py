"""Confidence formulas and choices between candidates, as Column builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, text_or_empty


def clamp(x: Column) -> Column:
    """To [0, 1] with four decimals; null counts as 0."""
    return F.round(F.least(F.greatest(F.coalesce(x.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), 4)


def hundredths(x: Column) -> Column:
    """To two decimals by the number as it is: 0.575 is a little below the half, and F.round would take its digits instead."""
    return F.round(x * 100) / 100


def share(count: Column, full: float, weight: float) -> Column:
    return F.least(count / float(full), F.lit(1.0)) * weight


def hits(text: Column, patterns: Sequence[str]) -> Column:
    """Matches of all patterns, each counted, whatever their case."""
    counts = [F.regexp_count(text, F.lit(f"(?i){p}")) for p in patterns]
    total = F.lit(0)
    for c in counts:
        total = total + c
    return total


def non_blank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda s: F.trim(s) != ""))


#: What counts as damage in a text.
DAMAGE = ("[\\x00-\\x08\\x0b-\\x0c\\x0e-\\x1f]", "[_~]{5,}")


def text_quality(text: Column) -> Column:
    """Of length, words and signs of damage."""

    def score(t: Column) -> Column:
        stripped = F.trim(F.regexp_replace(t, r"^\s+|\s+$", ""))
        words = F.size(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0)))
        errors = F.regexp_count(t, F.lit(DAMAGE[0])) + F.regexp_count(t, F.lit(DAMAGE[1]))
        total = share(F.length(stripped), 1000, 0.4) + share(words, 200, 0.3) + F.greatest(1.0 - errors / 100.0, F.lit(0.0)) * 0.3
        return F.when(stripped == "", 0.0).otherwise(hundredths(total))

    return let(text_or_empty(text), score)


#: Words that a scanned page of this kind has.
PAGE_TERMS = ("experience", "education", "skills", "summary", "projects", "certifications", "languages", "contact", "profile")


def scan_score(text: Column) -> Column:
    """Rank of one reading of a scanned page: quality, headings and structure less noise."""

    def score(t: Column) -> Column:
        low = F.lower(t)
        heads = sum((F.when(low.rlike(rf"\b{w}\b"), 1).otherwise(0) for w in PAGE_TERMS), F.lit(0))
        noise = F.least(F.regexp_count(t, F.lit(r"[^\w\s]{4,}")) * 0.02, F.lit(0.15))
        total = text_quality(t) + F.least(heads * 0.03, F.lit(0.2)) + F.least(non_blank_lines(t) / 100.0, F.lit(0.08)) - noise
        return F.when(F.trim(t) == "", 0.0).otherwise(F.round(F.greatest(total, F.lit(0.0)), 4))

    return let(text_or_empty(text), score)


def choose_best(isolated: Column, isolated_score: Column, extracted: Column, extracted_score: Column) -> Column:
    """struct(text, confidence): the isolated section if it is good enough, else the extracted one."""
    good = (isolated != "") & (isolated_score >= 0.2)
    take = good & ((extracted == "") | (isolated_score >= extracted_score - 0.15))
    score = F.when(extracted == "", F.greatest(isolated_score, F.lit(0.45))).otherwise(F.greatest(isolated_score, extracted_score * 0.9))
    return F.struct(F.when(take, isolated).otherwise(extracted).alias("text"), F.when(take, score).otherwise(extracted_score).alias("confidence"))


def prefer_layout(extracted: Column, score: Column, layout: Column, layout_score: Column, isolated: Column, isolated_score: Column) -> Column:
    """struct(text, confidence): the section by layout if it is clearly better."""
    words = lambda t: F.size(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0)))
    keep = F.struct(extracted.alias("text"), score.alias("confidence"))
    enough = words(layout) >= F.greatest(F.lit(3), F.floor(words(extracted) * 0.7).cast("int"))
    return (
        F.when(layout == "", keep)
        .when(extracted == "", F.struct(layout.alias("text"), F.greatest(layout_score, F.lit(0.35)).alias("confidence")))
        .when((isolated != "") & (isolated_score >= 0.3) & (score >= layout_score), keep)
        .when(layout_score >= score + 0.12, F.struct(layout.alias("text"), layout_score.alias("confidence")))
        .when((score < 0.45) & (layout_score >= score - 0.05) & enough, F.struct(layout.alias("text"), F.greatest(layout_score, score).alias("confidence")))
        .otherwise(keep)
    )


def allow_fallback(isolated: Column, isolated_score: Column, score: Column) -> Column:
    """Another extractor may try: nothing good is isolated and the score is below 0.7."""
    return ~((isolated != "") & (isolated_score >= 0.25)) & (score < 0.7)


def merge_scan(text: Column, score: Column, scanned: Column) -> Column:
    """struct(text, confidence): a longer scanned text wins at the mean with 0.8, else it is appended where it adds something."""
    tried = (score < 0.7) & (scanned != "")
    longer = F.length(scanned) > F.length(text)
    both = F.concat(text, F.lit("\n\n[OCR]\n"), scanned)
    return F.struct(
        F.when(tried & longer, scanned).when(tried, both).otherwise(text).alias("text"),
        F.when(tried & longer, (score + 0.8) / 2).when(tried, F.greatest(score, F.lit(0.75))).otherwise(score).alias("confidence"),
    )


#: Weights of the methods.
METHODS = (("regex", 0.25), ("nlp", 0.30), ("transformer", 0.40), ("layoutlm", 0.35))


def ensemble(*scores: Column) -> Column:
    """struct(confidence, method) of the positive scores, in the order of METHODS; the first highest names the method."""
    used = [F.when(s > 0, s) for s in scores]
    add = lambda xs: sum((F.coalesce(x, F.lit(0.0)) for x in xs), F.lit(0.0))
    n = sum((F.when(s > 0, 1).otherwise(0) for s in scores), F.lit(0))
    weights = add(F.when(s > 0, w) for s, (_, w) in zip(scores, METHODS, strict=False))
    mean = F.try_divide(add(u * w for u, (_, w) in zip(used, METHODS, strict=False)), weights)
    plain = F.try_divide(add(used), n)
    boosted = F.when((n >= 2) & (F.abs(mean - plain) < 0.15), F.least(mean * 1.1, F.lit(1.0))).otherwise(mean)
    top = F.greatest(*[F.coalesce(u, F.lit(0.0)) for u in used], F.lit(0.0))
    method = F.coalesce(*[F.when((u == top) & (u > 0), name) for u, (name, _) in zip(used, METHODS, strict=False)], F.lit("none"))
    return F.struct(F.coalesce(F.round(boosted, 2), F.lit(0.0)).alias("confidence"), method.alias("method"))


def words_of(text: Column) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(r"\S+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of the distinct words of two texts; 0 if either has none."""
    return let(words_of(a), lambda x: let(words_of(b), lambda y: F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)))


#: Words that confirm a section.
CONFIRMING = {
    "skills": ("python", "java", "javascript", "react", "angular", "vue", "node", "django", "flask", "aws", "azure", "gcp", "docker"),
    "education": ("bachelor", "master", "phd", "university", "college", "degree"),
    "experience": ("company", "engineer", "developer", "manager", "experience", "years"),
}


def overlap(extracted: Column, original: Column, section: Column) -> Column:
    """Share of the extracted words that the original has, and 0.1 for a confirming word of the section."""

    def score(x: Column) -> Column:
        inside = F.size(F.array_intersect(x, words_of(original))) / F.size(x)
        boost = F.lit(0.0)
        for name, words in CONFIRMING.items():
            boost = F.when((section == name) & F.lower(extracted).rlike("|".join(words)), 0.1).otherwise(boost)
        return F.when((F.size(x) > 0) & (original != ""), F.round(F.least(inside + boost, F.lit(1.0)), 2)).otherwise(0.0)

    return let(words_of(extracted), score)


def overall_accuracy(scores: Column) -> Column:
    """Mean of the positive scores of an array, in percent with two decimals."""
    return let(F.filter(scores, lambda s: s > 0), lambda p: F.when(F.size(p) > 0, F.round(F.aggregate(p, F.lit(0.0), lambda a, s: a + s) / F.size(p) * 100, 2)).otherwise(0.0))


def is_low(score: Column, strict: bool = False) -> Column:
    """Above 0 and below 0.35, or below 0.5 where strict; 0 is unknown, not low."""
    return (score > 0) & (score < (0.5 if strict else 0.35))

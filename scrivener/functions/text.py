"""Text normalisers and small predicates as Column builders."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: an alias may be expanded wherever it is used, a lambda's variable is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def longest_of(words: Iterable[str]) -> str:
    """A pattern of the longest of the words that fits. What words begin with in common stands once, so a place is tried letter by letter, not word by word."""
    root: dict = {}
    for w in words:
        at = root
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def written(node: dict) -> str:
        more = [(c if c in " -&" else re.escape(c)) + written(rest) for c, rest in sorted(node.items()) if c]
        if len(more) < 2 and "" not in node:
            return "".join(more)
        return f"(?:{'|'.join(more)}){'?' if '' in node else ''}" if more else ""

    return written(root)


#: All characters that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space at both ends, whatever its kind. Most lines begin and end with a visible ASCII sign, and are left alone."""
    last = F.substring(x, -1, 1)
    return F.when((x >= "!") & (x < "\x7f") & (last >= "!") & (last < "\x7f"), x).otherwise(F.btrim(x, F.lit(WHITE)))


def text_or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def lookup_key(x: Column) -> Column:
    """Null as empty, NUL as a blank, lower case, white space collapsed."""
    return F.lower(strip(F.regexp_replace(F.replace(text_or_empty(x), F.lit("\0"), F.lit(" ")), r"(?U)\s+", " ")))


def clean_text(x: Column) -> Column:
    return F.replace(text_or_empty(x), F.lit("\0"), F.lit(" "))


def coerce(x: Column) -> Column:
    """White space collapsed."""
    return strip(F.regexp_replace(text_or_empty(x.cast("string")), r"(?U)\s+", " "))


def lines_of(text: Column) -> Column:
    """Array of lines; every kind of line end counts."""
    return F.split(F.regexp_replace(text_or_empty(text), "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", "\n"), "\n")


#: White space of one line.
_BLANKS = r"[^\S\n]"


def clean_multiline(x: Column) -> Column:
    """Clean-up after optical recognition, line by line; empty lines go."""
    t = F.regexp_replace(text_or_empty(x.cast("string")), r"\r\n?|<br ?/?>", "\n")
    t = F.replace(t, F.lit("\u00a0"), F.lit(" "))
    t = F.regexp_replace(t, r"(?i)\bend\s*-\s*to\s*-\s*end\b", "end-to-end")
    t = F.regexp_replace(t, r"(?i)\bself\s*-\s*service\b", "self-service")
    t = F.regexp_replace(t, r"(?i)\b([A-Za-z]+)\s*-\s*\n\s*([A-Za-z]+)\b", "$1-$2")
    t = F.regexp_replace(t, r"(?:\|\s*){2,}|[•◦●▪]+|[<>]{2,}|[_=]{3,}", " ")

    # none of these goes over a line's end, so the text is gone through once, not each line again
    t = F.regexp_replace(t, r"[`~^]+", " ")
    t = F.regexp_replace(t, rf"{_BLANKS}*([,;:]){_BLANKS}*", "$1 ")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), lambda s: F.btrim(s, F.lit(" -|,;:"))), lambda s: s != ""), "\n")


def clean_line(x: Column) -> Column:
    """Clean-up of one line; words of ASCII letters and digits with one blank between them are clean."""
    cleaned = lambda t: F.btrim(F.regexp_replace(clean_multiline(t), r"(?U)\s+", " "), F.lit(" -|,;:"))
    return let(text_or_empty(x.cast("string")), lambda t: F.when(t.rlike(r"^[A-Za-z0-9]++(?: [A-Za-z0-9]++)*+\z"), t).otherwise(cleaned(t)))


def tidy(x: Column) -> Column:
    """White space collapsed, signs off both ends: all that a part of a clean line needs."""
    return F.btrim(F.regexp_replace(text_or_empty(x), r"\s+", " "), F.lit(" -|,;:"))


def tidy_lines(x: Column) -> Column:
    """Array of the lines of a text, each as ``tidy`` makes it."""
    return F.transform(F.split(F.regexp_replace(text_or_empty(x), rf"{_BLANKS}+", " "), "\n"), lambda s: F.btrim(s, F.lit(" -|,;:")))


def split_items(x: Column) -> Column:
    """Items between line ends, commas, semicolons, bars and slashes."""
    parts = F.transform(F.split(clean_line(x), r"[\n,;|/]+"), lambda s: F.btrim(s, F.lit(" -|,;:")))
    return F.filter(parts, lambda s: s != "")


def distinct_ci(items: Column) -> Column:
    """Distinct up to case, first spelling and order kept."""
    return let(items, lambda a: let(F.transform(a, lambda s: F.lower(s)), lambda low: F.filter(a, lambda s, i: F.array_position(low, F.lower(s)) == i + 1)))


def is_junk(x: Column) -> Column:
    return let(clean_line(x), lambda t: (F.length(t) <= 1) | t.rlike(r"^[^A-Za-z0-9]{2,}$"))


def title(x: Column) -> Column:
    """A capital wherever a letter follows no letter, lower case elsewhere (o'neil a-b 3com: O'Neil A-B 3Com)."""
    marked = F.split(F.regexp_replace(F.lower(x), r"(?<![\p{L}])(?=\p{L})", "\0"), "\0")
    return F.array_join(F.transform(marked, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30)))), "")


#: Replacements before lines are read.
NOISE = ("â€¢", "•", "◦", "●", "▪", "â€“", "â€”", "–", "—")


def normalize_document(x: Column) -> Column:
    """Line ends, bullets and dashes unified; tabs and runs of blanks as one blank."""
    t = F.regexp_replace(text_or_empty(x), r"\r\n?", "\n")
    t = let(t, lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(F.regexp_replace(t, "|".join(NOISE), "-")))  # all of them are beyond ASCII
    return F.regexp_replace(F.replace(t, F.lit("\t"), F.lit(" ")), r"[ ]{2,}", " ")


def bullet_line(x: Column) -> Column:
    """White space collapsed, a bullet at the start as ``- ``."""
    t = F.regexp_replace(strip(F.regexp_replace(x, r"(?U)\s+", " ")), r"^[\u2022\-\*\u25CF\u25E6]+\s*", "- ")
    return F.regexp_replace(t, r"^-\s{2,}", "- ")


def bullet_lines(x: Column) -> Column:
    """As bullet_line, of every line of a text whose lines end in ``\\n``: a text is gone through once, not each line again."""
    other = r"\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    t = F.regexp_replace(x, f"[{other}][ {other}]*| [ {other}]+", " ")
    t = F.trim(F.replace(F.replace(t, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")))
    return F.regexp_replace(t, r"(?m)^[\u2022\-\*\u25CF\u25E6]+ *", "- ")


def first_of(items: Column, key: Callable[[Column], Column]) -> Column:
    """The items of an array whose key has not come before, in their order; those with an empty key stay.

    Copies are found by sorting, so a long array costs no pass for each of its items.
    """

    def keep(a: Column, keys: Column) -> Column:
        ranked = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        first = lambda s: F.transform(s, lambda r, n: F.when((n == 0) | (r["k"] == "") | (F.get(s, n - 1)["k"] != r["k"]), r["i"]))
        at = F.sort_array(F.filter(let(ranked, first), lambda i: i.isNotNull()))
        full = F.filter(keys, lambda k: k != "")
        return F.when(F.size(F.array_distinct(full)) == F.size(full), a).otherwise(F.transform(at, lambda i: F.get(a, i)))

    return let(items, lambda a: let(F.transform(a, key), lambda keys: keep(a, keys)))


def places(items: Column, test: Callable[[Column, Column], Column]) -> Column:
    """Where in the array (from 0) the items stand for which test(item, place) holds."""
    return F.filter(F.transform(items, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())


def sessions(items: Column, starts: Callable[[Column, Column], Column]) -> Column:
    """The parts of the array that begin where starts(item, place) holds, as arrays; what stands in front of the first goes."""
    part = lambda a, at: F.transform(at, lambda i, n: F.slice(a, i + 1, F.coalesce(F.get(at, n + 1), F.size(a)) - i))
    return let(items, lambda a: let(places(a, starts), lambda at: part(a, at)))


def preview(x: Column, most: int = 500) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)

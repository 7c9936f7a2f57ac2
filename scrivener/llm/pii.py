"""Personal data: patterns, and a semi-Markov conditional random field that adds what the patterns miss.

The field scores whole candidate segments (kind, begin, end) by features of the span, and bounded-entity dynamic
programming picks the segmentation of highest total score: boundaries and types at once. It is trained here by maximum
conditional likelihood on generated sentences with known spans. Spans of the patterns always stay.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, in_arrow, text_of

KINDS = ("email", "ip", "card", "phone")
#: A segment has at most so many tokens.
MOST_TOKENS = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*")
# a match can't begin inside a run of digits: from the run's first digit it would have failed as well
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    double = str.maketrans("0123456789", "0246813579")
    return sum(map(int, digits[-1::-2])) % 10 == -sum(map(int, digits[-2::-2].translate(double))) % 10 if digits else False


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, begin, end) by the patterns, leftmost and non-overlapping within a kind; linear in the text."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        # an address has one @, so its local part is what runs up to it, after the match before
        begin = at - len(_LOCAL_BACK.match(text[free:at][::-1])[0])
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append((0, begin, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    if re.search("[0-9]", text):
        found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
_TRIGGER = re.compile(r"[0-9@]|[(\[{ ](?:at|AT)[)\]} ]")
_NUMBERS = frozenset(" ().-/+")
_MARK = re.compile(r"@| ?[(\[{] ?(?:at|AT) ?[)\]}] ?| (?:at|AT) ")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[(\[{] ?(?:dot|DOT) ?[)\]}] ?| (?:dot|DOT) )[A-Za-z0-9-]+)+")
_CUE = re.compile(r"\b(?:tel|phone|call|mobile|fax|cell)\b\W*$", re.I)


def features(kind: int, span: str, before: str, after: str) -> list[str]:
    """Names of the features that hold for the whole span as one entity of the kind."""
    f = ["bias"]
    digits = _digits(span)
    n = len(digits)
    if kind == 0:
        plain = bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", span))
        bracketed = bool(re.search(r"[(\[{] ?(?:at|AT) ?[)\]}]", span)) and bool(re.search(r"dot|DOT|\.", span))
        f += ["plain" if plain else "bracketed" if bracketed else "spoken"]
        f += [f"end_letters{min(len(re.search('[A-Za-z]*$', span)[0]), 5)}", "common_end" if re.search(r"(com|org|net|edu|gov|io|de|fr|es|uk)$", span, re.I) else "other_end"]
        f += ["cue" if re.search(r"mail|contact|write|reach", before, re.I) else "no_cue"]
    elif kind == 1:
        parts = re.split(r"\.", span)
        small = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
        f += ["octets" if small else "no_octets", "version" if re.search(r"[vV](ersion)? ?$", before) else "no_version"]
        f += ["runs_on" if re.match(r"\.?[0-9]", after) or re.search(r"[0-9]\.?$", before) else "alone"]
    elif kind == 2:
        f += ["luhn" if luhn(digits) else "no_luhn", "len" if 13 <= n <= 19 else "no_len", "issuer" if digits[:1] in ("3", "4", "5", "6") else "no_issuer"]
        f += ["clean" if re.fullmatch(r"[0-9]+([ -][0-9]+)*", span) and len(set(re.findall("[ -]", span))) <= 1 else "messy", "cue" if re.search(r"card|visa|credit", before, re.I) else "no_cue"]
        f += ["runs_on" if re.match(r"[0-9-]", after) or re.search(r"[0-9-]$", before) else "alone"]
    else:
        groups = [len(g) for g in re.findall("[0-9]+", span)]
        f += ["plus" if span[0] == "+" else "no_plus", "len" if 9 <= n <= 15 else "no_len", "area" if re.search(r"\([0-9]{2,5}\)", span) else "no_area"]
        f += ["shape" if groups[-3:] == [3, 3, 4] or groups[-2:] == [3, 4] and "(" in span else "no_shape", "cue" if _CUE.search(before) else "no_cue"]
        f += ["one_group" if len(groups) == 1 else "groups", "balanced" if span.count("(") == span.count(")") else "unbalanced", "date" if re.fullmatch(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}", span) else "no_date"]
        f += ["runs_on" if re.match(r"[-.]?[0-9]", after) or re.search(r"[0-9][-.]?$", before) else "alone"]
    return [f"{KINDS[kind]}:{x}" for x in f]


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits, @ and its spellings; between them no segment but single tokens is possible."""
    begin = end = -1
    for m in _TRIGGER.finditer(text):
        if begin >= 0 and m.start() - end <= 24:
            end = m.end()
            continue
        if begin >= 0:
            yield begin, end
        begin, end = m.start(), m.end()
    if begin >= 0:
        yield begin, end


def widened(text: str, begin: int, end: int) -> tuple[int, int]:
    """The window with MOST_TOKENS whole tokens more on either side, as far as the text has them: no entity is cut at its edge."""
    back = 64
    while True:
        starts = [m.start() for m in _TOKEN.finditer(text, max(0, begin - back), begin)]
        if len(starts) > MOST_TOKENS:  # the first of them may be cut, so it isn't counted
            low = starts[-MOST_TOKENS]
            break
        if back >= begin:
            low = 0
            break
        back *= 4
    high = end
    for m in islice(_TOKEN.finditer(text, end), MOST_TOKENS):
        high = m.end()
    return low, high


def candidates(text: str, begin: int, end: int) -> tuple[list[int], list[tuple[int, int, int, list[str]]]]:
    """Token boundaries of the widened window, and its candidate segments (first token, end token, kind, features).

    Only spans that can be entities are candidates: addresses around an @ or its spelling; numbers of 7 to 15 digits after
    +, ( or a word such as phone; 13 to 19 digits in groups of three or more; four dotted numbers.
    """
    low, high = widened(text, begin, end)
    tokens = [m.span() for m in _TOKEN.finditer(text, low, high)]
    edges = [t[0] for t in tokens] + [tokens[-1][1]] if tokens else [low]
    at_begin, at_end = {b: i for i, b in enumerate(edges[:-1])}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
    out = []

    def add(i: int, j: int, kind: int) -> None:
        b, e = edges[i], edges[j]
        out.append((i, j, kind, features(kind, text[b:e], text[max(0, b - 16) : b], text[e : e + 2])))

    free = low
    for m in _MARK.finditer(text, low, high):
        begin = m.start() - len(_LOCAL_BACK.match(text[free : m.start()][::-1])[0])
        host = _HOST.match(text, m.end(), high)
        if host and begin < m.start():
            i, j = at_begin.get(begin), at_end.get(host.end())
            if i is not None and j is not None and j - i <= MOST_TOKENS:
                add(i, j, 0)
        free = m.end()
    for i, (b, _) in enumerate(tokens):
        first = text[b]
        if "0" <= first <= "9":
            phone, dotted = bool(_CUE.search(text, max(0, b - 16), b)), True
        elif first in "+(":
            phone, dotted = True, False
        else:
            continue
        count, short, j = 0, False, i
        while j < len(tokens) and j - i < MOST_TOKENS and count <= 19:
            s = text[tokens[j][0] : tokens[j][1]]
            if "0" <= s[0] <= "9":
                count += len(s)
                short |= len(s) < 3
                j += 1
                if phone and 7 <= count <= 15:
                    add(i, j, 3)
                if dotted and 13 <= count <= 19 and not short:
                    add(i, j, 2)
                if dotted and j - i == 7 and all(text[tokens[k][0]] == "." for k in (i + 1, i + 3, i + 5)):
                    add(i, j, 1)
            elif s in _NUMBERS and (s != "+" or j == i) and (s != " " or text[tokens[j - 1][0]] != " "):
                j += 1
            else:
                break
    return edges, out


def _example(rng: random.Random) -> tuple[str, set[tuple[int, int, int]]]:
    """A generated sentence and its true spans; half of the numbers and addresses are none."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    domain = lambda dot: f"{word()}{rng.choice(['', d(1)])}{dot}{rng.choice(['com', 'org', 'net', 'example' + dot + 'com', 'de', 'io'])}"

    def card() -> str:
        body = rng.choice("3456") + d(14)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", "", " ", "-"])
        return sep.join(number[i : i + 4] for i in range(0, 16, 4))

    def not_card() -> str:
        number = d(rng.choice([13, 14, 16, 16, 16, 16, 18, 20, 24]))
        return number if not luhn(number) else number[:-1] + str((int(number[-1]) + 1) % 10)

    local = rng.choice([word(), f"{word()}.{word()}", f"{word()}.{d(2)}", f"{word()}_{word()}"])
    true = [
        (0, "", f"{local}@{domain('.')}"),
        (0, rng.choice(["mail ", "contact ", ""]), f"{word()} (at) {domain(' (dot) ')}"),
        (0, "", f"{word()}[at]{domain('[dot]')}"),
        (1, "", ".".join(str(rng.randint(0, 255)) for _ in range(4))),
        (2, rng.choice(["card ", "", ""]), card()),
        (2, "", card()),
        (3, "", f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}"),
        (3, "", f"+{rng.randint(1, 99)} {d(3)} {d(3)} {d(4)}"),
        (3, rng.choice(["tel ", "phone: ", "call ", ""]), f"({d(3)}) {d(3)}-{d(4)}"),
        (3, rng.choice(["tel ", "phone: ", "mobile "]), f"{d(3)}-{d(3)}-{d(4)}"),
        (3, rng.choice(["", "phone "]), f"+{d(11)}"),
    ]
    false = [
        ("order ", d(rng.randint(6, 12))), ("", not_card()), ("", not_card()), ("in ", f"20{d(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"), ("version ", f"{d(1)}.{d(1)}.{d(1)}.{d(1)}"),
        ("version ", f"{d(1)}.{d(1)}"), ("", f"{d(3)}.{d(3)}.{d(3)}.999"), ("", f"{word()}@{word()}"), ("looking at ", f"{word()} dot {word()}"), ("", f"{d(4)}-{d(4)}"),
        ("", f"{d(3)} {d(3)} {d(4)}"), ("total ", f"{d(3)},{d(3)}.{d(2)}"), ("", f"{d(2)}/{d(2)}/{d(4)}"), ("isbn ", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"), ("", d(10)), ("", f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}"),
        ("", f"{d(4)} {d(4)} {d(4)}"), ("", f"({d(4)}) {d(6)}"), ("pages ", f"{d(3)}-{d(3)}"), ("ref ", f"{d(3)}-{d(3)}-{d(4)}-{d(4)}"),
    ]
    text, spans = f"{word()} {word()} ", set()
    for _ in range(rng.randint(1, 3)):
        if rng.random() < 0.5:
            kind, cue, value = rng.choice(true)
            text += cue
            spans.add((kind, len(text), len(text) + len(value)))
        else:
            cue, value = rng.choice(false)
            text += cue
        text += value + rng.choice([" ", ", ", ". "]) + f"{word()} {word()} {word()} {word()} {word()} {word()} "
    return text, spans


@lru_cache(1)
def train(examples: int = 1500, steps: int = 60, ridge: float = 0.02, seed: int = 5) -> dict[str, float]:
    """Weights of the features: gradient ascent on the conditional log likelihood of the examples' segmentations."""
    rng, names, data = random.Random(seed), {}, []
    for _ in range(examples):
        text, true = _example(rng)
        for begin, end in windows(text):
            edges, segments = candidates(text, begin, end)
            if segments:
                rows = [(i, j, [names.setdefault(f, len(names)) for f in fs], (kind, edges[i], edges[j]) in true) for i, j, kind, fs in segments]
                data.append((len(edges) - 1, rows))
    width = max(len(r[2]) for _, rows in data for r in rows)
    index = np.full((sum(len(rows) for _, rows in data), width), len(names))
    for k, r in enumerate(r for _, rows in data for r in rows):
        index[k, : len(r[2])] = r[2]
    gold = np.array([r[3] for _, rows in data for r in rows], float)
    w, grow = np.zeros(len(names) + 1), np.full(len(names) + 1, 1e-8)
    for _ in range(steps):
        score, expected, k = w[index].sum(1), np.zeros(len(index)), 0
        for n, rows in data:
            own = [(r[0], r[1], score[k + x]) for x, r in enumerate(rows)]
            expected[k : k + len(rows)] = _marginals(n, own)
            k += len(rows)
        change = np.bincount(index.ravel(), np.repeat(gold - expected, width), len(w)) / len(data) - ridge / 100 * w
        change[-1] = 0
        grow += change**2
        w += 0.7 * change / np.sqrt(grow)
    return {f: float(w[i]) for f, i in names.items()}


def _marginals(n: int, segments: list[tuple[int, int, float]]) -> list[float]:
    """Probability of each segment; single tokens outside segments score 0."""
    into, out_of = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for i, j, s in segments:
        into[j].append((i, s))
        out_of[i].append((j, s))
    a, b = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        a[j] = _logsum([a[j - 1], *(a[i] + s for i, s in into[j])])
    for i in range(n - 1, -1, -1):
        b[i] = _logsum([b[i + 1], *(b[j] + s for j, s in out_of[i])])
    return [math.exp(min(0.0, a[i] + s + b[j] - a[n])) for i, j, s in segments]


def _logsum(x: list[float]) -> float:
    if len(x) == 1:
        return x[0]
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def decode(text: str, weights: dict[str, float]) -> list[tuple[int, int, int]]:
    """Spans of the best segmentation of every window (Viterbi over tokens with segments of at most MOST_TOKENS)."""
    found, free = [], 0
    for begin, end in windows(text):
        edges, segments = candidates(text, begin, end)
        into: dict[int, list[tuple[float, int, int]]] = {}
        for i, j, kind, fs in segments:
            s = sum(weights.get(f, 0.0) for f in fs)
            if s > 0:
                into.setdefault(j, []).append((s, i, kind))
        if not into:
            continue
        n = len(edges) - 1
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for s, i, kind in into.get(j, ()):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, kind)
        j, own = n, []
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                own.append((kind, edges[i], edges[j]))
                j = i
        for span in reversed(own):  # windows are widened, so two may see the same span
            if span[1] >= free:
                found.append(span)
                free = span[2]
    return found


def find(text: str, weights: dict[str, float]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(spans of the patterns, all spans), each by kind, then begin. An added span overlaps none of the patterns' spans."""
    base = sorted(base_spans(text))
    taken = sorted((b, e) for _, b, e in base)
    added, k = [], 0
    for kind, b, e in sorted(decode(text, weights), key=lambda s: s[1]) if _TRIGGER.search(text) else ():
        while k < len(taken) and taken[k][1] <= b:
            k += 1
        if all(o[0] >= e or o[1] <= b for o in taken[k : k + 4]):
            added.append((kind, b, e))
    return base, sorted(base + added)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{b}:{e}" for k, b, e in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base_sha256, spans, n_added.

    Spans are kind:begin:end in code points, end exclusive, by kind, then begin. Null and empty texts have none. Whole
    texts of any length are searched, in time linear in their length; repeated rows give repeated results, an empty table an
    empty one; ids of any type come back as they are, null ones too.
    """
    weights = train()

    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batch: dict[str, list], _: int) -> Iterator[tuple[None, dict]]:
        nothing, rows = hashlib.sha256(b"").hexdigest(), []
        for text in batch["text"]:
            base, spans = find(text, weights) if _TRIGGER.search(text) else ([], [])
            kinds = [k for k, _, _ in base]
            digest = hashlib.sha256(_joined(base).encode()).hexdigest() if base else nothing
            rows.append((*(kinds.count(k) for k in range(4)), digest, _joined(spans), len(spans) - len(base)))
        yield None, dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}

    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return in_arrow(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), run, schema, ["doc_id"])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span of the text replaced by its kind, as <EMAIL>; null stays null.

    A column n_chars, if there is one, becomes the length of the new text where the text changed.
    """
    weights = train()

    def clean(text: str | None) -> str | None:
        if text is None or not _TRIGGER.search(text):
            return text
        out, free = [], 0
        for kind, b, e in sorted(find(text, weights)[1], key=lambda s: (s[1], -s[2])):
            if e > free:  # of overlapping spans the rest goes with the first
                if b >= free:
                    out += [text[free:b], f"<{KINDS[kind].upper()}>"]
                free = e
        return "".join([*out, text[free:]])

    bound_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def replace(texts: pd.Series) -> pd.Series:
        return pd.Series([clean(t) for t in texts], dtype=object)

    # the row as one struct, so that its columns may have any names
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), replace(docs[text_col]).alias("_text"))
    old = lambda c: F.col("_row").getField(c)
    values = {c: old(c) for c in docs.columns} | {text_col: F.col("_text")}
    if "n_chars" in docs.columns:
        changed = ~F.col("_text").eqNullSafe(old(text_col))
        values["n_chars"] = F.when(changed, F.length("_text")).otherwise(old("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[v.alias(c) for c, v in values.items()])

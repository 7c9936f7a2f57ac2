"""DuckDB SQL of the registered queries: the same semantics written with windows and lists, as an independent check."""

from __future__ import annotations

import re

from ..functions.dates import CURRENT, MONTH, MONTHS, RANGE, YEAR
from ..functions.entities import EMAIL, LINKS, PHONES, SIMPLE_PHONES
from ..functions.headings import ALIASES, HEADING_TERMS, TAIL_WORDS
from ..functions.scores import DAMAGE
from ..operators import ats
from ..operators.entries import DEGREE_LEVELS, ISSUERS, PROJECT_HOSTS, SKILL_CATEGORIES, TECHNOLOGIES
from ..operators.lines import DEGREES, FULL_ORDER, PATTERNS, ROLES, SCHOOLS
from ..operators.schema import LEVEL_WORDS
from ..operators.sections import CONTACTS, FOREIGN, KIND_PATTERNS, KINDS, NOT_SKILLS, SECTIONS, SEPARATOR, SINGLE_SKILLS, SKILL_NOISE, SKILLS, SUMMARY_HEADERS, SUMMARY_PATTERNS, YEARS_ONLY, Section, _one_of, header_pattern, kind_headings, stop_pattern
from ..sources.tables import RESUME_TEXT_SQL, SAMPLES_SQL
from . import repairs
from .documents import CONTACT_SCORES

RES = f"resume_text as ({RESUME_TEXT_SQL})"
SAM = f"samples as ({SAMPLES_SQL})"
#: Samples with keys and whether they changed.
KEYED = f"""{SAM}, k as (select *, lower(trim(original_value)) as original_norm, lower(trim(corrected_value)) as corrected_norm, confidence_before as before,
  (corrected_value <> '' and lower(corrected_value) <> lower(original_value)) as changed from samples)"""


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _lines(table: str = "resume_text", ident: str = "doc_id") -> str:
    return f"""l as (select doc_id, idx, trim(raw) as line, lower(trim(raw)) as low from (
  select {ident} as doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as idx, unnest(string_split(text, chr(10))) as raw from {table}))"""


def _hits(text: str, patterns: tuple[str, ...]) -> str:
    return " + ".join(f"len(regexp_extract_all({text}, {_q('(?i)' + p)}))" for p in patterns) or "0"


def _confidence(s: Section, text: str, items: str) -> str:
    a, wa, b, wb, c, wc = s.confidence
    score = f"least({items} / {float(a)}::double, 1.0::double) * {wa}::double"
    if s.patterns and wb:
        score += f" + least(({_hits(text, s.patterns)}) / {float(b)}::double, 1.0::double) * {wb}::double"
    score += f" + least(length({text}) / {float(c)}::double, 1.0::double) * {wc}::double"
    if s.boost:
        factor, above, length = s.boost
        score = f"(case when ({score}) > {above}::double and length({text}) > {length} then least(({score}) * {factor}::double, 1.0::double) else ({score}) end)"
    return f"case when trim({text}) = '' then 0.0::double else round(least({score}, 1.0::double), 2) end"


def _header(s: Section) -> str:
    exact, prefix, inner = header_pattern(s)
    test = f"regexp_matches(low, {_q(exact)}) or (length(line) < {s.prefix} and regexp_matches(low, {_q(prefix)}))"
    return test + (f" or (length(line) < {s.inner} and regexp_matches(low, {_q(inner)}))" if s.inner else "")


def section_sql(s: Section) -> str:
    begins, contains = stop_pattern(s)
    soft = f"length(line) < {s.contains} and regexp_matches(low, {_q(contains)})" if s.contains else "false"
    keep = f"line <> '' and not regexp_matches(line, {_q(SEPARATOR)}) and length(line) >= {s.shortest}"
    keep += f" and not regexp_matches(line, {_q(YEARS_ONLY)})" if s.no_years else ""
    keep += f" and regexp_matches(low, {_q(s.only)})" if s.only else ""
    begun = "coalesce((select min(idx) from f2 where f2.doc_id = x.doc_id and idx > h and keep), 1000000)" if s.contains and not s.loose else "h"
    same = {"ci": "partition by doc_id, low order by idx", "cs": "partition by doc_id, line order by idx", "": "partition by doc_id, idx order by idx"}[s.distinct]
    return f"""with {RES}, {_lines()},
f as (select *, ({_header(s)}) as head from l),
f2 as (select *, (not head and regexp_matches(low, {_q(begins)})) as stop, (not head and {soft}) as soft, (not head and {keep}) as keep from f),
x as (select doc_id, min(case when head then idx end) as h from f2 group by doc_id),
b as (select doc_id, h, {begun} as b from x),
e as (select b.doc_id, any_value(h) as h, min(case when idx > h and (stop or (soft and idx > b)) then idx end) as e from b join f2 on b.doc_id = f2.doc_id group by b.doc_id),
kept as (select f2.* from f2 join e on f2.doc_id = e.doc_id where idx > h and idx < coalesce(e, 1000000) and keep),
u as (select * from (select *, row_number() over ({same}) as nth from kept) where nth = 1),
{_by_keywords(s)}
t as (select r.doc_id, coalesce(string_agg(line, chr(10) order by idx), '') as text, count(line) as items from resume_text r left join {'u2' if s.keywords else 'u'} as u on r.doc_id = u.doc_id group by r.doc_id)
select doc_id, '{s.name}' as section, text, {_confidence(s, 'text', 'items')} as confidence from t"""


def _by_keywords(s: Section) -> str:
    """u2: the kept lines, or, of documents without any, lines with a keyword and short lines before them."""
    if not s.keywords:
        return ""
    stops = "|".join(re.escape(w) for w in s.stops)
    leads = f"prev <> '' and length(prev) < {s.before} and not regexp_matches(lower(prev), {_q(stops)}) and len(regexp_extract_all(prev, '\\S+')) <= {s.words}"
    return f"""kw as (select * from (select *, lag(line) over (partition by doc_id order by idx) as prev from l) where regexp_matches(low, {_q('|'.join(s.keywords))}) and doc_id not in (select doc_id from u)),
kl as (select doc_id, 2 * idx + 1 as idx, line from kw union all select doc_id, 2 * idx as idx, prev from kw where {leads}),
u2 as (select doc_id, idx, line from u union all select doc_id, idx, line from (select *, row_number() over (partition by doc_id, lower(line) order by idx) as nth from kl) where nth = 1),"""


def _ats() -> dict[str, str]:
    """The tracking-system format over unnested lines."""
    has = lambda x, words: f"regexp_matches({x}, {_q(ats.any_word(words))})"
    short = f"(line <> '' and length(line) < 50 and not {has('low', ats.LABELS)})"
    capitals = "(regexp_matches({0}, '\\p{{Lu}}') and not regexp_matches({0}, '\\p{{Ll}}'))"
    school = has("low", (*ats.DEGREE_WORDS, *ats.SCHOOL_WORDS))
    skill = f"(not {school} and ({' + '.join(f'contains(low, {_q(x)})::int' for x in ats.SKILLS)}) >= 2)"
    known = f"list_distinct(flatten([{', '.join(f'regexp_extract_all(lower(text), {_q(p)}, 1)' for p in ats.SKILL_PATTERNS)}]))"
    pieces = "case when len(string_split(line, '|')) >= 3 then string_split(line, '|') when len(string_split(line, ',')) >= 3 and not regexp_matches(line, '20\\d{2}|19\\d{2}') then string_split(line, ',') end"
    role = f"({has('low', ats.ROLE_WORDS)} and (contains(line, '|') or not contains(line, ',')))"
    contact = "regexp_matches(line, '@\\w+\\.\\w+') or regexp_matches(line, '\\(\\d{3}\\)\\s*\\d{3}-\\d{4}')"
    excluded = ", ".join(map(_q, ats.NO_SKILLS))
    clean = "regexp_replace(low, '^[\\s\\-•:]+|[\\s\\-•:]+$', '', 'g')"
    head = f"(regexp_matches({clean}, {_q(f'^(?:{ats.any_word(ats.HEADINGS)})(?:$|:)')}) or ({capitals.format('line')} and length({clean}) < 30))"
    field = f"trim(regexp_extract(line, {_q(ats.DEGREE_START)}, 2))"
    year = f"regexp_extract(line, {_q(ats.STUDY_YEAR)}, 1)"
    skip = f"line = '' or regexp_matches(line, '^[-•]') or {has('low', (*ats.ROLE_WORDS, 'architect'))} or {skill}"
    entry = f"upper(regexp_extract(line, {_q(ats.DEGREE_START)}, 1)) || case when {field} <> '' then ' ' || {field} else '' end || ' (' || {year} || ')'"
    listed = f"(len(string_split(line, ',')) >= 3 and not {has('low', ('engineer', 'developer', 'manager'))})"
    first, last = "trim(string_split(line, '|')[1])", "trim(string_split(line, '|')[-1])"
    fits = f"(regexp_matches({first}, {_q(ats.TITLE)}) or regexp_matches({last}, {_q(ats.JOB_YEAR)}))"
    action = "trim(regexp_replace(line, '^[-•]+', ''))"
    titled = lambda x: f"(len(regexp_extract_all({x}, '\\S+')) between 2 and 4 and not regexp_matches({x}, '(^|\\s)[^\\p{{Lu}}\\s]'))"
    return {
        "res_ats": f"""with {RES}, {_lines()}, c as (select doc_id, any_value(text) as text, max((len(string_split(line, '|')) > 2)::int) as bars, sum({short}::int) as s, count(*) as n, sum((line <> '')::int) as f,
  sum((line <> '' and {capitals.format('line')} and length(line) < 30)::int) as caps from l join resume_text using (doc_id) group by doc_id),
i as (select *, case when text = '' then 0 else bars + (s > n * 0.5)::int + (not regexp_matches(lower(text), '\\n(?:experience|skills|education|projects):'))::int end as indicators,
  case when text = '' then 0 else contains(text, '|')::int + (s > f * 0.4)::int + (caps > 2)::int end as quick from c)
select doc_id, indicators::bigint as indicators, indicators >= 2 as is_ats, quick >= 2 as likely from i""",
        "res_ats_skills": f"""with {RES}, {_lines()}, k as (select doc_id, {known} as known from resume_text),
p as (select doc_id, idx, unnest(range(1, 1 + len(q))) as j, unnest(q) as raw from (select *, {pieces} as q from l where line <> '' and not {school} and not ({contact}) and not {role}) where q is not null),
e as (select p.doc_id, idx, j, trim(raw) as x from p join k using (doc_id) where list_contains(known, lower(trim(raw))) or {has('lower(trim(raw))', ats.SKILLS)}
  union all select doc_id, 1000000 as idx, unnest(range(1, 1 + len(known))) as j, unnest(known) as x from k),
u as (select * from (select *, row_number() over (partition by doc_id, lower(x) order by idx, j) as nth from e where length(x) >= 2 and not regexp_matches(x, '^\\d+$') and lower(x) not in ({excluded})) where nth = 1)
select r.doc_id, coalesce(string_agg(x, ', ' order by x collate "C"), '') as text, case when count(x) > 0 then round(least(0.3::double + 0.05::double * count(x), 1.0::double), 2) else 0.0::double end as confidence
  from resume_text r left join u on r.doc_id = u.doc_id group by r.doc_id""".replace(' collate "C"', ""),
        "res_ats_education": f"""with {RES}, {_lines()}, m as (select *, {head} as head, case when not ({skip}) and regexp_matches(line, {_q(ats.DEGREE_START)}) and {year} <> '' then {entry} end as entry from l),
o as (select *, head and contains(low, 'education') as opens from m), b as (select doc_id, min(idx) filter (opens) as b from o group by doc_id),
z as (select b.doc_id, any_value(b) as b, coalesce(min(idx) filter (head and not opens and idx > b), 1000000) as z from b join o on b.doc_id = o.doc_id group by b.doc_id),
i as (select o.*, coalesce(idx > b and idx < z and not opens, false) as inside from o join z on o.doc_id = z.doc_id where entry is not null),
w as (select * from i where inside or doc_id not in (select doc_id from i where inside)),
u as (select * from (select *, row_number() over (partition by doc_id, lower(entry) order by idx) as nth from w) where nth = 1)
select r.doc_id, coalesce(string_agg(entry, chr(10) order by idx), '') as text, case when count(entry) > 0 then round(least(0.5::double + 0.15::double * count(entry), 1.0::double), 2) else 0.0::double end as confidence
  from resume_text r left join u on r.doc_id = u.doc_id group by r.doc_id""",
        "res_ats_experience": f"""with {RES}, {_lines()}, e as (select doc_id, idx, regexp_replace(line, '\\s*\\|\\s*', ' | ', 'g') as x from l where line <> '' and not {skill} and not {school} and not {listed} and contains(line, '|') and {fits}
  union all select doc_id, 1000000 + idx, {action} from l where regexp_matches(line, '^[-•]') and {has(f'lower({action})', ats.VERBS)}),
u as (select *, row_number() over (partition by doc_id order by idx) as rank from (select *, row_number() over (partition by doc_id, substr(lower(x), 1, 50) order by idx) as nth from e) where nth = 1)
select r.doc_id, coalesce(string_agg(x, chr(10) order by idx) filter (rank <= {ats.MOST_ENTRIES}), '') as text, case when count(x) > 0 then round(least(0.4::double + 0.1::double * count(x), 1.0::double), 2) else 0.0::double end as confidence
  from resume_text r left join u on r.doc_id = u.doc_id group by r.doc_id""",
        "res_ats_name": f"""with {RES}, {_lines()}, o as (select doc_id, any_value(line) filter (idx = 0) as line, any_value(low) filter (idx = 0) as low, arg_min(line, idx) filter (idx < 3 and {titled('line')}) as later from l group by doc_id),
n as (select *, case when contains(line, '|') and {titled(first)} then {first} when regexp_matches(line, '^[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){{1,3}}$') and not {has('low', ats.NOT_NAMES)} then line end as best from o)
select doc_id, coalesce(best, regexp_replace(later, '\\s+', ' ', 'g'), '') as text, case when best is not null then 0.85::double when later is not null then 0.7::double else 0.0::double end as confidence from n""",
    }


def _ordered(a: str) -> str:
    """Distinct elements of a list, the first of each kept."""
    return f"list_filter({a}, lambda x, i: list_position({a}, x) = i)"


def _found(kind: str, text: str) -> str:
    """The list of matches of addresses, numbers or links in a text."""
    if kind == "email":
        return f"list_filter(regexp_extract_all({text}, {_q(EMAIL)}), lambda x, i: list_position(list_transform(regexp_extract_all({text}, {_q(EMAIL)}), lambda y: lower(y)), lower(x)) = i)"
    patterns, flags = (PHONES, "") if kind == "phone" else (LINKS, "(?i)")
    return _ordered(f"flatten([{', '.join(f'regexp_extract_all({text}, {_q(flags + p)})' for p in patterns)}])")


def _contacts() -> str:
    """What stands under a heading if it has a match, else all matches of the whole text."""
    parts = []
    for s in CONTACTS:
        full, weight, length, rest, raised = CONTACT_SCORES[s.name]

        def score(text: str, s=s, full=full, weight=weight, length=length, rest=rest, raised=raised) -> str:
            items = f"len(list_filter(string_split({text}, chr(10)), lambda x: trim(x) <> ''))" if s.name == "links" else f"len({_found(s.name, text)})"
            raw = f"(least({items} / {full}.0::double, 1.0::double) * {weight}::double + least(length({text}) / {length}.0::double, 1.0::double) * {rest}::double)"
            return f"case when trim({text}) = '' or {items} = 0 then 0.0::double else round(least(case when {raw} > 0.3 and length({text}) > {raised} then least({raw} * 1.2::double, 1.0::double) else {raw} end, 1.0::double), 2) end"

        parts.append(
            f"""select doc_id, '{s.name}' as section, text, {score('text')} as confidence from (select h.doc_id, case when ({score('h.text')}) > 0 then h.text else array_to_string({_found(s.name, 'r.text')}, chr(10)) end as text
  from ({section_sql(s)}) h join ({RESUME_TEXT_SQL}) r on h.doc_id = r.doc_id)"""
        )
    return "\nunion all\n".join(parts)


def _by_kind(kinds: tuple[str, ...]) -> str:
    """The generic extractor: headings that stand alone, the next heading of any kind, distinct lines."""
    any_, ends = kind_headings()
    bare = f"trim(regexp_replace(low, {_q(ends)}, ''))"
    head = f"(line <> '' and length(line) <= 60 and regexp_matches({bare}, {_q(any_)}))"
    keep = f"(line <> '' and not regexp_matches(line, {_q(SEPARATOR)}) and not regexp_matches(line, {_q(YEARS_ONLY)}))"
    starts = ", ".join(f"min(idx) filter (regexp_matches(low, {_q(f'^(?:{_one_of(KINDS[k])})[{chr(92)}s:–—-]*$')})) as \"{k}\"" for k in kinds)

    def score(k: str) -> str:
        full, weight = (5, 0.4) if k in ("skills", "education", "experience", "projects", "certifications") else (3, 0.3)
        own = " + ".join(f"contains(lower(text), {_q(w)})::int" for w in KINDS[k])
        foreign = " + ".join(f"contains(chr(10) || lower(text) || chr(10), chr(10) || {_q(w)} || chr(10))::int" for w in FOREIGN if w != k)
        raw = f"least(items / 5.0::double, 1.0::double) * 0.3::double + least(({_hits('text', KIND_PATTERNS.get(k, ()))}) / {full}.0::double, 1.0::double) * {weight}::double"
        raw += f" + least(length(text) / 200.0::double, 1.0::double) * 0.3::double + least(({own}) / 3.0::double, 1.0::double) * 0.1::double"
        rounded = f"round(least(case when ({raw}) > 0.7::double then least(({raw}) * 1.1::double, 1.0::double) else ({raw}) end, 1.0::double), 2)"
        return f"when section = '{k}' then round(case when ({foreign}) > 0 then {rounded} * greatest(0.4::double, 1 - ({foreign}) * 0.2::double) else {rounded} end, 2)"

    return f"""with {RES}, {_lines()}, s as (select doc_id, {starts} from l group by doc_id),
b as (select doc_id, section, b from s unpivot include nulls (b for section in ({", ".join(f'"{k}"' for k in kinds)}))),
e as (select b.doc_id, section, any_value(b) as b, coalesce(min(idx) filter ({head} and idx > b), 1000000) as e from b join l on b.doc_id = l.doc_id group by b.doc_id, section),
i as (select e.doc_id, section, idx, line, low from e join l on e.doc_id = l.doc_id where idx > b and idx < e and {keep}),
u as (select * from (select *, row_number() over (partition by doc_id, section, regexp_replace(low, '\\s+', ' ', 'g') order by idx) as nth from i) where nth = 1),
t as (select b.doc_id, b.section, coalesce(string_agg(line, chr(10) order by idx), '') as text, count(line) as items from b left join u on b.doc_id = u.doc_id and b.section = u.section group by b.doc_id, b.section)
select doc_id, section, text, case when text = '' then 0.0::double {' '.join(map(score, kinds))} end as confidence from t"""


def _skills() -> str:
    s = SKILLS
    begins, contains = stop_pattern(s)
    words = r"len(regexp_extract_all(line, '\S+'))"
    letters = "regexp_replace(line, '[^A-Za-z]', '', 'g')"
    good = f"length(line) >= 2 and not trim(regexp_replace(low, '[^a-z ]', '', 'g')) in ({', '.join(_q(x) for x in SKILL_NOISE)})"
    good += "".join(f" and not regexp_matches(low, {_q(p)})" for p in NOT_SKILLS)
    good += f" and not (line like '- %' and {words} > 8) and not (not contains(line, ':') and ({words} > 10 or (contains(line, ',') and {words} > 3) or contains(line, '.'))) and not regexp_matches(line, '[.;]$')"
    good += f" and not ({words} = 1 and not lower({letters}) in ({', '.join(_q(x) for x in SINGLE_SKILLS)}) and regexp_matches({letters}, '^[A-Z][a-z]+$'))"
    good += f" and (contains(line, ':') or {words} <= 7)"
    return f"""with {RES}, {_lines()},
f as (select *, ({_header(s)}) as head, (regexp_matches(low, {_q(begins)}) or (length(line) < {s.contains} and regexp_matches(low, {_q(contains)}))) as stop from l where line <> ''),
g as (select *, last_value(case when head then 1 when stop then 0 end ignore nulls) over (partition by doc_id order by idx) as on_ from f),
kept as (select *, row_number() over (partition by doc_id, low order by idx) as nth from g where on_ = 1 and not head and not stop and not regexp_matches(line, {_q(SEPARATOR)}) and {good}),
t as (select r.doc_id, coalesce(string_agg(line, chr(10) order by idx), '') as text, count(line) as items from resume_text r left join (select * from kept where nth = 1) u on r.doc_id = u.doc_id group by r.doc_id)
select doc_id, 'skills' as section, text, {_confidence(s, 'text', 'items')} as confidence from t"""


def _head(column: str) -> str:
    """Canonical heading of a lower-cased line, by patterns: an alias and at most two tail words."""
    norm = f"regexp_replace(regexp_replace(regexp_replace({column}, '–|—|•', '-', 'g'), '^[-*.:;|_ ]+', ''), '[-*.:;|_ ]+$', '')"
    tail = rf"(?: [\s/&]*(?:{TAIL_WORDS})(?:[\s/&]+(?:{TAIL_WORDS}))?[\s/&]*)?"
    cases = " ".join(f"when regexp_matches({norm}, {_q(f'^(?:{"|".join(words)}){tail}$')}) then '{name}'" for name, words in ALIASES.items())
    return f"(case when length({norm}) > 64 or regexp_matches({norm}, {_q('[@' + chr(92) * 2 + ']')}) then null {cases} end)"


HEADS = f"h as (select *, {_head('low')} as head from l)"

_SUMMARY = f"""with {RES}, {_lines()}, {HEADS},
f as (select *, ({_header(Section('summary', SUMMARY_HEADERS, ('summary',)))}) as top,
  ((head is not null and head <> 'summary') or regexp_matches(low, '^(?:technical\\s+)?skills\\s*[:–—-]?\\s*$|^(?:programming languages|web development|database|tools|soft skills)')) as stop from h where line <> ''),
x as (select doc_id, min(case when top then idx end) as h from f group by doc_id),
e as (select x.doc_id, any_value(h) as h, min(case when idx > h and stop and not top then idx end) as e from x join f on x.doc_id = f.doc_id group by x.doc_id),
t as (select r.doc_id, coalesce(string_agg(case when idx > h and idx < coalesce(e, 1000000) and not top then line end, ' ' order by idx), '') as text
  from resume_text r left join f on r.doc_id = f.doc_id left join e on r.doc_id = e.doc_id group by r.doc_id)
select doc_id, 'summary' as section, text, case when trim(text) = '' then 0.0::double else round(least(case when length(text) between 50 and 500 then 0.6::double when length(text) < 50 then 0.3::double
  else greatest(0.5::double, 1.0 - (length(text) - 500) / 1000.0) end + least(({_hits('text', SUMMARY_PATTERNS)}) / 3.0::double, 1.0::double) * 0.4::double, 1.0::double), 2) end as confidence from t"""

_FOLLOWED = "(" + "case " + " ".join(
    f"when coalesce(lead(line, {k}) over w, '') <> '' and lead(head, {k}) over w is not null then false when coalesce(lead(line, {k}) over w, '') <> '' and length(lead(line, {k}) over w) > 2 then true" for k in range(1, 5)
) + " else false end)"
_DETECTED = f"""{RES}, {_lines()}, {HEADS},
d as (select *, {_FOLLOWED} as followed from h window w as (partition by doc_id order by idx)),
heads as (select doc_id, idx, head, line from (select *, row_number() over (partition by doc_id, head, rtrim(low, ':') order by idx) as nth from d where head is not null and followed) where nth = 1)"""

#: Wrapped lines joined: numbers of runs of lines that do not go on.
_LOOKS = f"""(head is not null or (length(line) <= 64 and not line like '- %' and not regexp_matches(line, '[@\\\\]') and not regexp_matches(line, '[.;,]$')
  and len(regexp_extract_all(line, '\\S+')) between 1 and 6 and (regexp_matches(lower(line), '{HEADING_TERMS}')
  or (regexp_matches(line, '[A-Za-z]') and (upper(line) = line or not regexp_matches(line, '(?:^| )[a-z]'))))))"""
_REBUILT = f"""{RES}, {_lines()}, {HEADS},
c as (select *, lag(line, 1, '') over (partition by doc_id order by idx) as prev from h),
mk as (select *, (prev <> '' and line <> '' and not {_LOOKS} and not line like '- %' and not regexp_matches(line, '^(19|20)\\d{{2}}') and not (regexp_matches(line, '^[A-Z][A-Z ]+$') and length(line) < 36)
  and not prev like '%:' and (prev like '%-' or regexp_matches(line, '^[a-z]'))) as goes_on from c where line <> '' or prev <> ''),
nk as (select *, sum(case when goes_on then 0 else 1 end) over (partition by doc_id order by idx) as grp from mk),
rl as (select doc_id, min(idx) as idx, string_agg(line, ' ' order by idx) as line from nk group by doc_id, grp),
rh as (select *, {_head('lower(line)')} as head from rl)"""
_ISLANDS = """ri as (select *, last_value(head ignore nulls) over (partition by doc_id order by idx) as section from rh)"""
_INSIDE = """si as (select * from (select *, row_number() over (partition by doc_id, section, lower(line) order by idx) as nth from ri where head is null and section is not null) where nth = 1 or line = '')"""
_STARTS = f"""case when section = 'experience' then regexp_matches(lower(line), '\\b(19|20)\\d{{2}}\\b') or regexp_matches(lower(line), '{ROLES}') or regexp_matches(line, '\\b(?:at|@)\\s+[A-Z]')
  when section = 'education' then regexp_matches(lower(line), '{DEGREES}') or regexp_matches(lower(line), '{SCHOOLS}') or (regexp_matches(lower(line), '\\b(19|20)\\d{{2}}\\b') and length(line) < 80) else false end"""
_CHUNKS = f"""ch as (select *, (line <> '' and (lag(line, 1, '') over (partition by doc_id, section order by idx) = '' or {_STARTS})) as starts from si where section in ('experience', 'education')),
cn as (select *, sum(starts::int) over (partition by doc_id, section order by idx) as chunk from ch),
ce as (select doc_id, section, row_number() over (partition by doc_id, section order by chunk) as entry_no, entry from
  (select doc_id, section, chunk, trim(string_agg(line, chr(10) order by idx)) as entry from cn where line <> '' group by all) where length(entry) > 2)"""


def _isolated() -> str:
    words = r"len(regexp_extract_all(t, '\S+'))"
    pattern = " ".join(
        f"when p.section = '{n}' then ({' + '.join(f'regexp_matches(t, {_q(chr(40) + chr(63) + chr(105) + chr(41) + p)})::int' for p in ps)}) / {float(len(ps))}::double * 0.5::double" for n, ps in PATTERNS.items()
    )
    return f"""{_REBUILT}, {_ISLANDS}, {_INSIDE}, {_CHUNKS},
p as (select doc_id, section, string_agg(line, chr(10) order by idx) as t, sum((line like '- %')::int + regexp_matches(line, '[,|]')::int) as marks from si where line <> '' group by all),
en as (select doc_id, section, count(*) as n, string_agg(entry, chr(10) || chr(10) order by entry_no) as et from ce group by all),
iso as (select p.doc_id, p.section, coalesce(et, t) as text, round(least(least({words} / 80.0::double, 1.0::double) * 0.25::double + case {pattern} else 0.0::double end
  + case when p.section in ('experience', 'education') then least(coalesce(n, 0) / 3.0::double, 1.0::double) * 0.25::double
         when p.section in ('skills', 'projects', 'certifications') then least(marks / 5.0::double, 1.0::double) * 0.25::double else 0.0::double end, 1.0::double), 2) as confidence
  from p left join en on p.doc_id = en.doc_id and p.section = en.section)"""


_SAFE = f"""{KEYED}, a as (select *, (feedback_type = 'rejection' or (feedback_type = 'correction' and corrected_norm = '')) as is_del from k where status = 'approved' and original_norm <> ''),
dead as (select field_name, original_norm from a group by all having bool_or(is_del)),
v as (select a.* from a anti join dead d on a.field_name = d.field_name and a.original_norm = d.original_norm where feedback_type = 'correction' and changed),
c as (select field_name, original_norm, corrected_norm, count(*) as cnt, min((ts, seq)) as first_at, arg_max(corrected_value, (ts, seq)) as corrected from v group by all),
r as (select *, row_number() over w as rn, lead(cnt, 1, 0) over w as second_cnt, sum(cnt) over (partition by field_name, original_norm) as tot, count(*) over (partition by field_name, original_norm) as n
  from c window w as (partition by field_name, original_norm order by cnt desc, first_at)),
safe as (select field_name, original_norm, corrected_norm, corrected, cnt from r where rn = 1 and (n = 1 or (cnt >= 2 and cnt::double / tot >= 0.6 and cnt - second_cnt >= 1)))"""
_BIN = "case when {c} < 0.2 then 0 when {c} < 0.4 then 1 when {c} < 0.6 then 2 when {c} < 0.8 then 3 else 4 end"
_PROFILE = f"""prof as (select field_name, {_BIN.format(c='before')} as bin, count(*) as total, count(*) filter (changed) as changed, round(1.0::double - count(*) filter (changed)::double / count(*), 4) as correctness
  from k where status = 'approved' group by all)"""
_COUNTS = "count(*) as total, count(*) filter (status = 'approved') as approved, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'rejected') as rejected, count(*) filter (changed) as changed"
_ERRORS = f"""{KEYED}, f as (select field_name, count(*) as total_samples, count(*) filter (changed) as changed_samples, round(avg(before), 4) as avg_confidence_before, count(*) filter (before < 0.65) as low_confidence_samples,
  round(count(*) filter (changed)::double / count(*), 4) as error_rate, coalesce(round(count(*) filter (before < 0.65 and changed)::double / nullif(count(*) filter (before < 0.65), 0), 4), 0) as low_confidence_error_rate
  from k where status = 'approved' group by field_name),
e as (select *, round((error_rate * 0.6::double + low_confidence_error_rate * 0.4::double) * greatest(1.0::double, total_samples / 5.0::double), 6) as severity from f)"""

_EXPERIENCE_TEXT = f"with {_isolated()}"

_ELEMENTS = """el as (select l_orderkey % 500 as doc_id, (l_orderkey % 3)::int as page_num, 'item ' || l_orderkey::varchar || ' ' || l_linenumber::varchar as text,
  case when l_partkey % 2 = 1 then 50.0::double else 320.0::double end + l_linenumber % 3 as x0, 700.0::double - l_linenumber * 30 - l_suppkey % 7 as y1 from lineitem),
e as (select *, x0 + 200 as x1, y1 - 12 as y0 from el),
s as (select doc_id, min(x0) as lo, max(x1) as hi, min(x0) + (max(x1) - min(x0)) / 2 as split_x from e group by doc_id),
c as (select s.doc_id, any_value(split_x) as split_x, any_value(hi - lo) as width, count(*) filter (x0 <= split_x - 20 and length(text) >= 3) as nl, count(*) filter (x0 >= split_x + 20 and length(text) >= 3) as nr
  from e join s on e.doc_id = s.doc_id group by s.doc_id),
cols as (select doc_id, split_x, width >= 180 and least(nl, nr) >= 8 and least(nl, nr)::double / greatest(nl, nr, 1) >= 0.25 as two_columns from c)"""

_QUALITY = f"""case when trim(regexp_replace({{t}}, '^\\s+|\\s+$', '', 'g')) = '' then 0.0::double else round(least(length(regexp_replace({{t}}, '^\\s+|\\s+$', '', 'g')) / 1000.0::double, 1.0::double) * 0.4::double
  + least(len(regexp_extract_all({{t}}, '\\S+')) / 200.0::double, 1.0::double) * 0.3::double
  + greatest(1.0::double - (len(regexp_extract_all({{t}}, '{DAMAGE[0]}')) + len(regexp_extract_all({{t}}, '{DAMAGE[1]}'))) / 100.0::double, 0.0::double) * 0.3::double, 2) end"""
_WORDS = r"list_distinct(regexp_extract_all(lower(text), '\S+'))"
_JOBS_STORE = "d as (select doc_id as id, source || '.txt' as filename, text as extracted_text, n_chars as created_at from documents)"
_VERSIONS = """v as (select event_type as model_name, event_id::varchar as version_id, lpad(event_id::varchar, 12, '0') as created_at,
  case when event_id % 50 = 7 then 'active' when event_id % 3 = 0 then 'archived' else 'staged' end as status from events)"""
_EXAMPLES = f"{SAM}, x as (select field_name, 'feedback' as source, false as verified from samples where status = 'pending' union all select field_name, 'correction', true from samples where status = 'approved')"
#: The jobs in the texts that are made from customers: a title with years, a title at a company, and a line of dates.
_JOBS = """j as (select c_custkey as doc_id, 1 as entry_no, c_mktsegment || ' manager 2015 - 2019' as title, null::varchar as company, c_mktsegment || ' manager 2015 - 2019' as duration, '- managed the company team' as description from customer
  union all select c_custkey, 2, 'Software developer at Acme Ltd', 'Acme Ltd', null, null from customer
  union all select c_custkey, 3, null, null, 'Jan ' || (2019 + c_custkey % 4)::varchar || ' - Present', '- developed web applications' from customer)"""
_STUDIES = """s as (select c_custkey as doc_id, 1::bigint as entry_no, 'B.Tech' as degree, '' as field, 'State University' as school, '' as gpa, (2000 + c_custkey % 20)::varchar as year from customer
  union all select c_custkey, 2, 'Diploma', '', 'City College', '', '' from customer)"""
_YEAR = r"(?:19|20)\d{2}"
_EMAIL = "lower(replace(c_name, '#', '.')) || '@example.com'"
_SUMMARY_LINE = "'Experienced analyst in ' || n_name || ' with many years of expertise in reporting'"


_LEVELS = "|".join(w for _, w in LEVEL_WORDS)


def _month(token: str) -> str:
    cases = " ".join(f"when lower({token}) in ('{m.lower()}', '{m.lower()[:3]}', '{n}', '{n:02d}'{', ' + repr('sept') if n == 9 else ''}) then '{m}'" for n, m in enumerate(MONTHS, 1))
    return f"(case {cases} else '' end)"


def oracle_sql() -> dict[str, str]:
    out = {f"sec_{s.name.replace('-', '_')}": section_sql(s) for s in SECTIONS}
    edu_level = " ".join(f"when regexp_matches(line, {_q('(?i)' + p)}) then '{n}'" for n, p in DEGREE_LEVELS)
    category = " ".join(f"when regexp_matches(skill, {_q(rf'{chr(92)}b(?:{w}){chr(92)}b')}) then '{n}'" for n, w in SKILL_CATEGORIES.items())
    skills = f"""sk as (select distinct doc_id, skill from (select doc_id, lower(trim(unnest(regexp_split_to_array(text, '[,;â€¢\\n]+')))) as skill from ({_skills().replace('with ', 'with ', 1)})) where length(skill) >= 2),
sc as (select doc_id, skill, case {category} else 'other' end as category from sk)"""
    issuer = " ".join(f"when contains(lower(line), '{i}') then '{i.title()}'" for i in reversed(ISSUERS))
    lines_of = lambda section: f"il as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as idx, trim(unnest(string_split(text, chr(10)))) as line from iso where section = '{section}')"
    out |= {
        "sec_skills": _skills(),
        "sec_summary": _SUMMARY,
        # feedback
        "fb_filtered_scan": f"with {SAM} select sample_id, original_value, corrected_value from samples where field_name = 'click' and status = 'approved' and feedback_type = 'correction'",
        "fb_changed_only": f"with {KEYED} select sample_id, field_name, original_value, corrected_value from k where changed",
        "fb_pending": f"with {SAM} select sample_id, field_name, status from samples where status = 'pending'",
        "fb_stats_grouping_sets": f"with {KEYED} select field_name, feedback_type, {_COUNTS} from k group by grouping sets ((field_name), (feedback_type), ())",
        "fb_error_by_field": f"with {_ERRORS} select * from e",
        "fb_common_mistakes_topk": f"""with {KEYED}, p as (select field_name, original_norm, trim(corrected_value) as corrected, count(*) as count, round(avg(before), 4) as a, min((ts, seq)) as f from k where status = 'approved' and changed group by all),
r as (select *, row_number() over (partition by field_name order by count desc, a, f)::int as rank from p) select field_name, rank, original_norm, corrected, count from r where rank <= 10""",
        "fb_problem_fields": f"with {_ERRORS} select field_name, severity from e order by severity desc, field_name limit 5",
        "fb_calibration_profile": f"with {KEYED}, {_PROFILE} select * from prof",
        "fb_calibrate_apply": f"""with {KEYED}, {_PROFILE} select sample_id, k.field_name, confidence_before as confidence,
  coalesce(round(before * 0.55::double + correctness * 0.45::double, 4), round(before, 4)) as calibrated from k left join prof p on k.field_name = p.field_name and {_BIN.format(c='before')} = p.bin""",
        "fb_safe_map": f"with {_SAFE} select field_name, original_norm, corrected_norm, cnt as count from safe",
        "fb_apply_corrections": f"""with {_SAFE}, {_PROFILE}, j as (select k.sample_id, k.field_name, coalesce(s.corrected, original_value) as new_value, s.corrected is not null as corrected,
  case when s.corrected is not null then greatest(confidence_before, 0.98::double) else confidence_before end as c from k left join safe s on k.field_name = s.field_name and k.original_norm = s.original_norm)
select sample_id, new_value, corrected, coalesce(round(c * 0.55::double + correctness * 0.45::double, 4), round(c, 4)) as new_confidence from j left join prof p on j.field_name = p.field_name and {_BIN.format(c='c')} = p.bin""",
        "fb_backfill_antijoin": f"""with {SAM}, n as (select *, row_number() over (partition by resume_id, field_name, original_value, corrected_value, feedback_type order by ts, seq) as nth
  from samples a where sample_id % 2 = 1 and not exists (select 1 from samples b where b.sample_id % 2 = 0 and a.resume_id = b.resume_id and a.field_name = b.field_name and a.original_value = b.original_value
    and a.corrected_value = b.corrected_value and a.feedback_type = b.feedback_type)) select sample_id, resume_id, field_name, original_value, corrected_value, feedback_type from n where nth = 1""",
        "fb_export": f"""with {SAM} select sample_id, field_name, original_value as input, case when feedback_type = 'correction' then corrected_value end as expected, feedback_type
  from samples where feedback_type in ('correction', 'rejection')""",
        "fb_set_status": f"with {SAM} select sample_id, case when status = 'pending' then 'rejected' else status end as status from samples",
        # documents
        "doc_lines": f"with {_lines('documents')} select doc_id, count(*) as n_lines, count(*) filter (line <> '') as n_full, max(length(line)) as longest from l group by doc_id",
        "doc_text_confidence": f"select doc_id, {_QUALITY.replace('{t}', 'text')} as confidence from documents",
        "doc_word_stats": f"select doc_id, len(regexp_extract_all(text, '\\S+')) as n_words, len({_WORDS}) as n_distinct from documents",
        "doc_emails": """with e as (select doc_id, generate_subscripts(a, 1) as i, unnest(a) as email from (select doc_id, regexp_extract_all(text, '(?i)\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b') as a from documents))
select doc_id, email from (select *, row_number() over (partition by doc_id, lower(email) order by i) as nth from e) where nth = 1""",
        "doc_line_dedupe_ci": f"""with {_lines('documents')}, u as (select * from (select *, row_number() over (partition by doc_id, low order by idx) as nth from l where line <> '') where nth = 1)
select d.doc_id, count(line) as n_distinct, coalesce(string_agg(line, chr(10) order by idx), '') as text from documents d left join u on d.doc_id = u.doc_id group by d.doc_id""",
        "doc_repeated_lines_topk": f"with {_lines('documents')} select line, count(*) as total from l where line <> '' group by line order by total desc, line limit 10",
        "doc_best_scan": f"""with c as (select doc_id, 0 as attempt, 'plain' as method, text from documents union all select doc_id, 1, 'lower', lower(text) from documents union all select doc_id, 2, 'first', string_split(text, chr(10))[1] from documents),
s as (select *, {_QUALITY.replace('{t}', 'text')} as score from c) select doc_id, method, score from (select *, row_number() over (partition by doc_id order by score desc, attempt) as nth from s) where nth = 1""",
        "sim_jaccard": f"""with a as (select doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as v from benchmark),
p as (select doc_id, item_id, len(list_intersect(w, v))::double as i, len(w) as nw, len(v) as nv from a, b) select doc_id, item_id, round(i / (nw + nv - i), 6) as jaccard from p where i / (nw + nv - i) >= 0.3""",
        "sim_overlap": f"""with a as (select doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as v from benchmark),
p as (select doc_id, item_id, len(list_intersect(w, v))::double / len(v) as o from a, b) select doc_id, item_id, round(o, 6) as overlap from p where o >= 0.8""",
        "page_text": """with t as (select page_id, regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g') as t from pages),
u as (select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(t, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) as t from t)
select page_id, md5(t) as digest, length(t) as chars from u""",
        "conversation_order": "select conv_id, md5(string_agg(role || ': ' || text, chr(10) order by turn)) as digest, count(*) as turns from conversations group by conv_id",
        # résumés
        "res_headings": f"with {_DETECTED} select doc_id, idx as line_no, head as section, line from heads",
        "res_headings_confidence": f"""with {_DETECTED}, c as (select doc_id, count(*) as n_headings, count(distinct head) as s, count(distinct lower(line)) as t from heads group by doc_id)
select c.doc_id, n_headings, round(least(least(s / 6.0::double, 1.0::double) * 0.4::double + t::double / n_headings * 0.35::double + least(length(text) / 4000.0::double, 1.0::double) * 0.25::double, 1.0::double), 2) as confidence
  from c join resume_text r on c.doc_id = r.doc_id""",
        "res_sections_islands": f"""with {RES}, {_lines()}, {HEADS}, g as (select *, last_value(head ignore nulls) over (partition by doc_id order by idx) as section from h)
select doc_id, section, count(*) as n_lines, sum(length(line))::bigint as chars from g where head is null and line <> '' group by all""",
        "res_rebuilt_lines": f"with {_REBUILT} select doc_id, idx as line_no, line from rl where line <> ''",
        "res_unmatched": f"""with {_REBUILT}, {_ISLANDS}, u as (select doc_id, string_agg(line, chr(10) order by idx) as text from ri where section is null and head is null and line <> '' group by doc_id)
select r.doc_id, coalesce(u.text, '') as text, case when u.text is not null then 0.5::double else 0.0::double end as confidence from resume_text r left join u on r.doc_id = u.doc_id""",
        "res_entry_chunks": f"with {_REBUILT}, {_ISLANDS}, {_INSIDE}, {_CHUNKS} select * from ce",
        "res_section_confidence": f"with {_isolated()} select doc_id, section, confidence, (text <> '' and confidence >= 0.2) as valid from iso",
        "res_skills_split": f"with {skills} select doc_id, skill, category from sc",
        "res_skill_categories": f"with {skills} select category, count(*) as total, count(distinct skill) as n_skills from sc group by category",
        "res_education_entries": f"""{_EXPERIENCE_TEXT}, {lines_of('education')}, m as (select *, case {edu_level} end as level, lag(line, 1, '') over (partition by doc_id order by idx) as prev from il),
n as (select *, sum((level is not null or prev = '')::int) over (partition by doc_id order by idx) as entry, regexp_extract_all(line, '{_YEAR}') as ys from m),
e as (select doc_id, entry, max(case when level is not null then line end) as degree, max(level) as level, arg_min(array_to_string(ys, ' - '), idx) filter (level is null and len(ys) > 0) as year,
  arg_max(line, idx) filter (level is null and regexp_matches(lower(line), 'university|college|institute|school|academy')) as institution,
  arg_max(line, idx) filter (level is null and (regexp_matches(lower(line), 'gpa|grade') or contains(line, '%'))) as grade from n where line <> '' group by all)
select doc_id, row_number() over (partition by doc_id order by entry) as entry_no, degree, level, year, institution, grade from e where coalesce(degree, year, institution, grade) is not null""",
        "res_project_entries": f"""{_EXPERIENCE_TEXT}, {lines_of('projects')}, m as (select *, sum((p = '')::int) over (partition by doc_id order by idx) as entry, length(line) < 60 and not line like '-%' as name from
  (select *, lag(line, 1, '') over (partition by doc_id order by idx) as p from il)),
t as (select *, list_sort(list_distinct([lower(x) for x in regexp_extract_all(line, {_q(TECHNOLOGIES)}, 1)])) as ts, regexp_extract(line, {_q(PROJECT_HOSTS)}, 1) as host from m where line <> '')
select doc_id, row_number() over (partition by doc_id order by entry) as entry_no, arg_max(line, idx) filter (name) as name, array_to_string(arg_min(ts, idx) filter (not name and len(ts) > 0), ',') as technologies,
  arg_max(host, idx) filter (not name and host <> '') as link, string_agg(line, ' ' order by idx) filter (not name) as description from t group by doc_id, entry""",
        "res_certifications": f"""{_EXPERIENCE_TEXT}, {lines_of('certifications')} select doc_id, row_number() over (partition by doc_id order by idx) as entry_no, line as name,
  nullif(regexp_extract(line, '{_YEAR}'), '') as year, case {issuer} end as issuer from il where line <> ''""",
        "res_date_range": f"""with {RES}, {_lines()}, c as (select *, regexp_extract_all(line, {_q(MONTH)}) as ms, regexp_extract_all(line, '\\b(?:19|20)\\d{{2}}\\b') as ys,
  regexp_extract(line, {_q(RANGE)}, 1) as a, regexp_extract(line, {_q(RANGE)}, 2) as b, regexp_matches(line, {_q(CURRENT)}) as cur from l where regexp_matches(line, '\\b(19|20)\\d{{2}}\\b')),
d as (select {_month('ms[1]')} as start_month, case when a <> '' then a else coalesce(ys[1], '') end as start_year, case when cur then '' else {_month('ms[2]')} end as end_month,
  case when cur then '' when a <> '' then case when length(b) = 4 then b when b::int > 12 then substr(a, 1, 2) || b else '' end else coalesce(ys[2], '') end as end_year, cur as current from c)
select start_month, start_year, end_month, end_year, current, count(*) as total from d group by all""",
        "res_languages": f"""with t as ({section_sql(next(s for s in SECTIONS if s.name == 'languages'))}), i as (select doc_id, trim(unnest(regexp_split_to_array(text, '[\\n,;•|]+')), ' -') as item from t),
j as (select distinct doc_id, item from i where item <> '')
select doc_id, (select string_agg(upper(w[1]) || lower(w[2:]), ' ') from (select unnest(string_split(trim(regexp_replace(item, '(?i)\\b(?:{_LEVELS})\\b', '', 'g'), ' -–:()|,'), ' ')) as w)) as name,
  case {' '.join(f"when regexp_matches(lower(item), '{w}') then '{n}'" for n, w in LEVEL_WORDS)} else 'Intermediate' end as level from j""",
        **_ats(),
        "doc_phones": "select doc_id, phone from (select doc_id, coalesce("
        + ", ".join(f"case when length(regexp_replace(regexp_extract(text, {_q(p)}), '[^\\d+]', '', 'g')) >= 10 then regexp_replace(regexp_extract(text, {_q(p)}), '[^\\d+]', '', 'g') end" for p in SIMPLE_PHONES)
        + ", '') as phone from documents) where phone <> ''",
        "doc_entity_counts": f"select doc_id, len({_found('email', 'text')}) as emails, len({_found('links', 'text')}) as links, len(regexp_extract_all(text, {_q(YEAR)})) as years from documents",
        "doc_key_normal": "select doc_id, md5(lower(regexp_replace(trim(regexp_replace(replace(text, chr(0), ' '), '\\s+', ' ', 'g')), '^ | $', '', 'g'))) as key from documents",
        "res_entities": _contacts(),
        # what a reader takes from the jobs of each text, told from the columns that the texts are made of
        "res_experience_entries": f"with {_JOBS} select doc_id, entry_no, title, company, duration, description from j",
        "res_builder_jobs": f"""with {_JOBS} select doc_id, entry_no, coalesce(title, '') as title, coalesce(company, '') as employer, coalesce(description, '') as description,
  case when entry_no = 3 then 'January' else '' end as "startMonth", case entry_no when 1 then '2015' when 3 then duration[5:8] else '' end as "startYear", '' as "endMonth", case when entry_no = 1 then '2019' else '' end as "endYear",
  entry_no = 3 as current from j""",
        "res_jobs_distinct": f"""with {_JOBS} select doc_id, entry_no::bigint - 1 as pos, coalesce(title, '') as title, coalesce(company, '') as employer, [0.7::double, 0.6::double, 0.4::double][entry_no] as quality from j""",
        "res_degree_blocks": f"with {_STUDIES} select * from s",
        "res_studies_merged": f"with {_STUDIES} select * from s",
        # sql is a part of mysql, labels go, and strengths are a heading of skills
        "res_builder_skills": "select c_custkey as doc_id, 'Python,Leadership,Docker And React,MySQL,Redis' || case when c_custkey % 6 = 0 then ',Analytical And Organized,Confident' else '' end as skills from customer",
        "res_years_experience": "select c_custkey as doc_id, 2024 - 2015 as years from customer",
        "res_names": f"""with n as (select c_custkey as doc_id, ['Mara', 'Otto', 'Ines', 'Yann'][c_custkey % 4 + 1] as a, ['Quill', 'Fern', 'Brook'][c_custkey % 3 + 1] as b from customer where c_custkey % 5 <> 4)
select doc_id, a || ' ' || b as name, round(least(case when doc_id % 5 = 1 then 0.85::double else 0.9::double end + ((a = 'Mara')::int + (b = 'Brook')::int) / 2.0::double * 0.35::double, 1.0::double), 2) as confidence,
  case when doc_id % 5 = 1 then 'heuristic' else 'regex' end as method from n""",
        "res_full_text": f"""with {_REBUILT}, {_ISLANDS}, fb as (select doc_id, section, min(idx) as first, case when section is null then '' else upper(section) || chr(10) end || string_agg(line, chr(10) order by idx) as block from ri where head is null and line <> '' group by doc_id, section),
fr as (select *, case when section is null then 0 else coalesce(nullif(list_position({list(FULL_ORDER)!r}, section), 0), 99) end as rank from fb)
select doc_id, string_agg(block, chr(10) || chr(10) order by rank, first) as text, 0.95::double as confidence from fr group by doc_id""",
        "res_accuracy": f"""with a as ({" union all ".join(f"select confidence, doc_id from ({x})" for x in (*map(section_sql, SECTIONS), _skills(), _SUMMARY, _contacts()))})
select doc_id, coalesce(round(round(avg(confidence) filter (confidence > 0) * 100, 6), 2), 0.0::double) as accuracy from a group by doc_id""",
        # records as told from the columns that the texts are made of: the first line is no name, prizes are awards and achievements, and volunteer work ends at none of the headings behind it
        "res_schema_v1": f"""select c_custkey as doc_id, null::varchar as name, {_EMAIL} as email, {_SUMMARY_LINE} as summary, 3 as jobs, 3 as studies,
  5 + (c_custkey % 2 = 0)::int + 2 * (c_custkey % 3 = 0)::int + (c_custkey % 5 = 0)::int + (c_custkey % 4 = 0)::int as customs, true as is_valid from customer join nation on c_nationkey = n_nationkey""",
        "res_builder": f"""select c_custkey as doc_id, '' as "firstName", {_EMAIL} as email, 6 + 2 * (c_custkey % 6 = 0)::int as skills, 3 as languages, 0 as errors, true as is_valid from customer""",
        "res_section_text": f"""with c as (select c_custkey as doc_id, * from customer join nation on c_nationkey = n_nationkey)
select doc_id, unnest(['personal', 'summary', 'skills', 'experience', 'education', 'projects', 'volunteer']) as section, unnest([
  concat_ws(chr(10), {_EMAIL}, '555) ' || (100 + doc_id % 900)::varchar || '-' || (1000 + doc_id % 9000)::varchar, 'https://github.com/user' || (doc_id % 50)::varchar, 'www.example.org/cv'),
  {_SUMMARY_LINE},
  'python, sql, leadership, docker and react, Databases: mysql, redis' || case when doc_id % 6 = 0 then ', analytical and organized, confident' else '' end,
  concat_ws(chr(10), c_mktsegment || ' manager 2015 - 2019', '- managed the company team', '', 'Software developer at Acme Ltd', '', 'Jan ' || (2019 + doc_id % 4)::varchar || ' - Present', '- developed web applications'),
  concat_ws(chr(10), 'B.Tech, State University ' || (2000 + doc_id % 20)::varchar, 'GPA 8.' || (doc_id % 10)::varchar, '', 'Diploma, City College', '', '1999 - 2002'),
  array_to_string([x || chr(10) || x for x in ['Inventory Portal', 'built an api with python and react, see github.com/user' || (doc_id % 50)::varchar, 'Sales Board', 'designed a reporting application on aws']], chr(10) || chr(10)),
  array_to_string([x || chr(10) || x for x in case when doc_id % 7 = 0 then ['Community trust organization'] || case when doc_id % 4 = 0 then ['Trainings attended', 'Completed a workshop on leadership'] else [] end
    || case when doc_id % 6 = 0 then ['Strengths', 'analytical and organized', 'confident'] else [] end else [] end], chr(10) || chr(10))]) as text from c""",
        "res_by_kind": _by_kind(("skills", "education", "experience", "projects", "certifications", "awards", "languages", "summary")),
        "res_choose_best": f"""with {SAM}, c as (select *, (sample_id % 7) / 7.0::double as x, original_value <> '' and confidence_before >= 0.2 as good from samples)
select sample_id, case when good and (corrected_value = '' or confidence_before >= x - 0.15::double) then original_value else corrected_value end as text,
  round(case when good and corrected_value = '' then greatest(confidence_before, 0.45::double) when good and confidence_before >= x - 0.15::double then greatest(confidence_before, x * 0.9::double) else x end, 6) as confidence from c""",
        "res_prefer_layout": f"""with {SAM}, c as (select *, (sample_id % 7) / 7.0::double as x, (sample_id % 3) / 3.0::double as i from samples),
d as (select *, case when original_value = '' then 0 when corrected_value = '' then 1 when field_name <> '' and i >= 0.3 and x >= confidence_before then 0 when confidence_before >= x + 0.12::double then 2
  when x < 0.45 and confidence_before >= x - 0.05::double and len(regexp_extract_all(original_value, '\\S+')) >= greatest(3, floor(len(regexp_extract_all(corrected_value, '\\S+')) * 0.7)::int) then 3 else 0 end as way from c)
select sample_id, case when way = 0 then corrected_value else original_value end as text,
  round(case way when 0 then x when 1 then greatest(confidence_before, 0.35::double) when 2 then confidence_before else greatest(confidence_before, x) end, 6) as confidence from d""",
        "res_ensemble_confidence": f"""with {SAM}, c as (select sample_id, (sample_id % 5) / 5.0::double as r, (sample_id % 4) / 4.0::double as n, (sample_id % 3) / 3.0::double as t from samples),
d as (select *, (r > 0)::int + (n > 0)::int + (t > 0)::int as cnt, (r * 0.25::double + n * 0.3::double + t * 0.4::double) / nullif((r > 0)::int * 0.25::double + (n > 0)::int * 0.3::double + (t > 0)::int * 0.4::double, 0) as mean,
  (r + n + t) / nullif((r > 0)::int + (n > 0)::int + (t > 0)::int, 0) as plain, greatest(r, n, t) as top from c)
select sample_id, case when top = 0 then 'none' when r = top then 'regex' when n = top then 'nlp' else 'transformer' end as method,
  coalesce(round(case when cnt >= 2 and abs(mean - plain) < 0.15 then least(mean * 1.1::double, 1.0::double) else mean end, 2), 0.0::double) as confidence from d""",
        # stores
        "store_search_ilike": f"with {_JOBS_STORE} select id, filename from d where filename ilike '%src1_%' or extracted_text ilike '%src1_%'",
        "store_latest": f"with {_JOBS_STORE} select id, filename, created_at from (select *, row_number() over (partition by filename order by created_at desc, id desc) as nth from d) where nth = 1",
        "store_orphans_antijoin": "select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)",
        "store_delete_newest": f"""with {_JOBS_STORE}, g as (select id from d where filename = 'src1.txt' order by created_at desc, id desc limit 1)
select id, filename, created_at from d where id not in (select id from g)""",
        "store_update": f"with {_JOBS_STORE} select id, case when id % 20 = 0 then 'renamed.txt' else filename end as filename, created_at from d",
        "store_previews": f"with {_JOBS_STORE} select id, md5(case when length(extracted_text) > 500 then substr(extracted_text, 1, 500) || '...' else extracted_text end) as digest from d",
        "registry_models": f"""with {_VERSIONS} select model_name, count(*) as n_versions, arg_max(version_id, (created_at, version_id)) as latest_version,
  arg_max(version_id, (created_at, version_id)) filter (status = 'active') as active_version from v group by model_name""",
        "registry_deploy": f"""with {_VERSIONS} select model_name, version_id, case when model_name = 'click' and version_id = '1' and n > 0 then 'active' when model_name = 'click' and status = 'active' and n > 0 then 'archived' else status end as status
  from v, (select count(*) as n from v where model_name = 'click' and version_id = '1') k""",
        "train_split": f"""with {SAM}, r as (select sample_id, row_number() over (order by md5(sample_id::varchar), sample_id) as rn, count(*) over () as n from samples)
select sample_id, case when rn <= floor(n * 0.7::double) then 'train' when rn <= floor(n * 0.7::double) + floor(n * 0.15::double) then 'validation' else 'test' end as part from r""",
        "train_stats": f"with {_EXAMPLES} select field_name, source, verified, count(*) as total from x group by grouping sets ((field_name), (source), (verified), ())",
        "train_augment": f"""with {SAM}, x as (select field_name, 'feedback' as source, false as verified, original_value as text, corrected_value as label from samples where status = 'pending'
  union all select field_name, 'correction', true, original_value, corrected_value from samples where status = 'approved')
select field_name, source, verified, label, count(text) as originals, 2 * count(*) as variations from x group by field_name, source, verified, label""",
        # layout
        "layout_columns": f"with {_ELEMENTS} select * from cols",
        "layout_reading_order": f"""with {_ELEMENTS}, j as (select e.*, split_x, two_columns, case when two_columns and x0 > split_x then 'right' else 'left' end as side from e join cols on e.doc_id = cols.doc_id),
pg as (select doc_id, page_num, max(y1) as top, greatest(1.0, max(x1) - min(x0)) as span, coalesce(greatest(1.0, max(x1) filter (side = 'left') - min(x0) filter (side = 'left')), 0) as lw,
  coalesce(greatest(1.0, max(x1) filter (side = 'right') - min(x0) filter (side = 'right')), 0) as rw, coalesce(sum(length(text)) filter (side = 'left'), 0) as lt, coalesce(sum(length(text)) filter (side = 'right'), 0) as rt from j group by all),
k as (select j.*, pg.*, (lw / span < 0.38 and lt < rt * 0.7) and not (rw / span < 0.38 and rt < lt * 0.7) and rw > 0 as rf from j join pg on j.doc_id = pg.doc_id and j.page_num = pg.page_num),
b as (select *, case when not two_columns then 0 when y1 >= top - 24 and split_x between x0 and x1 and lw > 0 and rw > 0 then 0 when rf then case when side = 'left' then 2 else 1 end when side = 'left' then 1 else 2 end as band from k)
select doc_id, text, row_number() over (partition by doc_id order by page_num, band, y1 desc, x0, text) as position from b""",
        "layout_word_lines": """with w as (select l_orderkey as doc_id, l_linenumber % 2 as line_num, 'w' || l_partkey::varchar as text, case when l_linenumber = 7 then null else (l_quantity - 1)::int end as c, l_linenumber * 40 as lft from lineitem)
select doc_id, line_num, string_agg(text, ' ' order by lft, text) as text, min(lft) as left, max(lft + 30) as right, round(avg(c) / 100, 4) as confidence from w where c >= 0 group by doc_id, line_num""",
        "layout_pages_routed": f"""with p as (select doc_id, string_split(text, chr(10))[1] as f, text from documents), s as (select *, {_QUALITY.replace('{t}', 'f')} as fs, {_QUALITY.replace('{t}', 'text')} as ts from p),
t as (select *, (trim(f) = '' or length(f) < 80 or fs < 0.28) and text <> '' and (ts >= fs + 0.08::double or length(text) > 1.2 * length(f)) as take from s)
select doc_id, md5(case when take then text else f end) as digest, round(case when take then ts else fs end, 4) as confidence from t""",
        "flagship": f"""with {_SAFE}, g as (select field_name, count(*) as samples, round(avg(confidence_before), 4) as confidence from samples group by 1), b as (select field_name, count(*) as accepted from safe group by 1)
select g.field_name, samples, confidence, accepted, row_number() over (order by accepted desc, g.field_name)::int as rank from g left join b on g.field_name = b.field_name""",
    }
    return {k: v for k, v in out.items() if v} | repairs.oracles(_SAFE, _QUALITY)

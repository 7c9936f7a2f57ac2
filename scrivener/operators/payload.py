"""Check of builder payloads before they have types: unknown and missing keys, wrong types, values out of their range.

A payload is JSON text, read once into a VARIANT; keys and types are asked of its parts, so nothing is lost by a cast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import MONTHS
from ..functions.text import let
from .schema import LEVELS

#: The keys of a payload and of the objects in it.
TOP = ("personal", "summary", "skills", "education", "experience", "projects", "certifications", "languages", "template", "_meta", "file_type")
PERSONAL = ("firstName", "lastName", "profession", "onet_code", "city", "country", "pincode", "phone", "email", "linkedin", "websites")
KEYS = {
    "education": ("school", "location", "field", "degree", "gradMonth", "gradYear", "gpa"),
    "experience": ("title", "employer", "location", "description", "startMonth", "startYear", "endMonth", "endYear", "current", "onet_code", "originalDescription", "lastTemplateIndex"),
    "projects": ("title", "description", "role", "tools", "url"),
    "certifications": ("name", "issuingOrg", "achievedDate", "url"),
    "languages": ("name", "level"),
}
#: In this order, what must be a string in the entries of each list.
STRINGS = {
    "education": ("school", "location", "field", "degree", "gpa"),
    "experience": ("title", "employer", "location", "description", "startMonth", "startYear", "endMonth", "endYear", "onet_code", "originalDescription"),
    "projects": ("description", "role", "title", "tools", "url"),
    "certifications": ("name", "issuingOrg", "url"),
    "languages": ("name",),
}
MONTH_NAMES = f"^(?:|{'|'.join(MONTHS)})$"
YEAR = r"^(?:|19\d{2}|20\d{2})$"
DATE = rf"^(?:|19\d{{2}}|20\d{{2}}|(?:{'|'.join(MONTHS)})\s+(?:19|20)\d{{2}})$"


def _kind(v: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, ARRAY<..>, OBJECT<..>, VOID ...; null if there is no value."""
    return F.schema_of_variant(v)


def _is_string(v: Column) -> Column:
    return F.coalesce(_kind(v) == "STRING", F.lit(False))


def _is_whole(v: Column) -> Column:
    """A whole number; true and false count as such, as they do in the service's language."""
    return F.coalesce(_kind(v).rlike(r"^(?:BIGINT|BOOLEAN|DECIMAL\(\d+,0\))$"), F.lit(False))


def _text(v: Column) -> Column:
    return F.when(_is_string(v), F.try_variant_get(v, "$", "string"))


def _items(v: Column) -> Column:
    """The entries of an array; null for anything else."""
    return F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def _object(v: Column) -> Column:
    """The fields of an object; null for anything else."""
    return F.when(_kind(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))


def _listed(names: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "), F.lit("]"))


def _says(wrong: Column, *text: Column | str) -> Column:
    """The text if it is wrong, else null."""
    return F.when(wrong, F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text]))


def _keys(fields: Column, wanted: tuple[str, ...], path: Column) -> list[Column]:
    """Errors about an object's keys; ``fields`` is null if it is no object."""
    want = F.array(*map(F.lit, wanted))
    has = F.map_keys(fields)
    missing, extra = F.array_sort(F.array_except(want, has)), F.array_sort(F.array_except(has, want))
    return [_says(fields.isNull(), path, " must be an object"), _says(F.size(missing) > 0, path, " missing keys: ", _listed(missing)), _says(F.size(extra) > 0, path, " has unsupported keys: ", _listed(extra))]


def _strings(value: Column, path: Column | str) -> Column:
    """Errors of an array of strings, as an array of texts."""
    path = F.lit(path) if isinstance(path, str) else path
    items = _items(value)
    wrong = F.transform(items, lambda v, i: _says(~_is_string(v), path, "[", i.cast("string"), "] must be a string"))
    return F.when(items.isNull(), F.array(F.concat(path, F.lit(" must be an array")))).otherwise(wrong)


def _entry(name: str, item: Column, i: Column) -> Column:
    """Errors of one entry of a list of objects."""
    path = F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))

    def test(fields: Column) -> Column:
        at = lambda k: fields[k]
        dot = lambda k: F.concat(path, F.lit(f".{k}"))
        fits = lambda k, pattern: F.coalesce(_text(at(k)).rlike(pattern), F.lit(False))
        month = lambda k: _says(~fits(k, MONTH_NAMES), dot(k), " must be one of the canonical month values or ''")
        year = lambda k: _says(~fits(k, YEAR), dot(k), " must be '' or a four-digit year")
        said = [*_keys(fields, KEYS[name], path), *[_says(~_is_string(at(k)), dot(k), " must be a string") for k in STRINGS[name]]]
        if name == "education":
            said += [month("gradMonth"), year("gradYear")]
        elif name == "experience":
            said += [month("startMonth"), month("endMonth"), year("startYear"), year("endYear")]
            said += [_says(~F.coalesce(_kind(at("current")) == "BOOLEAN", F.lit(False)), dot("current"), " must be boolean"), _says(~_is_whole(at("lastTemplateIndex")), dot("lastTemplateIndex"), " must be integer")]
        elif name == "certifications":
            said += [_says(~fits("achievedDate", DATE), dot("achievedDate"), " must be '', 'YYYY', or 'Month YYYY'")]
        elif name == "languages":
            level = at("level")
            said += [_says(~_is_string(level), dot("level"), " must be a string"), _says(_is_string(level) & ~_text(level).isin(*LEVELS), dot("level"), f" must be one of {sorted(LEVELS)}")]
        return F.array(*said)

    # an entry that is no object has no fields to ask for: only that is said
    return let(_object(item), lambda f: F.when(f.isNull(), F.array(F.concat(path, F.lit(" must be an object")))).otherwise(test(f)))


def payload_errors(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """With ``errors`` (array of texts, in the order of the keys) and ``is_valid``, of JSON payloads in ``column``.

    Wrong keys at the top end the check there. Text that is no JSON, and null, say so. An entry that is no object is told
    once. Numbers of any size, nested values and repeated entries are kept as they are while they are checked.
    """
    root = F.try_parse_json(F.col(column))

    def top(fields: Column) -> Column:
        wrong = F.array_compact(F.array(*_keys(fields, TOP, F.lit("root"))))
        return F.when(F.size(wrong) > 0, wrong).otherwise(inner(fields))

    def inner(fields: Column) -> Column:
        at = lambda k: fields[k]
        string = lambda v, path: F.array(_says(~_is_string(v), path, " must be a string"))

        def personal(p: Column) -> Column:
            texts = [_says(~_is_string(p[k]), f"personal.{k} must be a string") for k in sorted(set(PERSONAL) - {"websites"})]
            return F.when(p.isNull(), F.array(F.lit("personal must be an object"))).otherwise(F.concat(F.array(*_keys(p, PERSONAL, F.lit("personal")), *texts), _strings(p["websites"], "personal.websites")))

        def meta(m: Column) -> Column:
            only = F.array_except(F.map_keys(m), F.array(F.lit("local_resume_id")))
            said = F.array(_says((F.size(only) > 0) | ~F.map_contains_key(m, "local_resume_id"), "_meta must only contain local_resume_id"), _says(~_is_whole(m["local_resume_id"]), "_meta.local_resume_id must be integer"))
            return F.when(m.isNull(), F.array(F.lit("_meta must be an object"))).otherwise(said)

        def entries(name: str) -> Column:
            return let(_items(at(name)), lambda x: F.when(x.isNull(), F.array(F.lit(f"{name} must be an array"))).otherwise(F.flatten(F.transform(x, lambda v, i: _entry(name, v, i)))))

        parts = [let(_object(at("personal")), personal), string(at("summary"), "summary"), _strings(at("skills"), "skills"), *map(entries, KEYS), string(at("template"), "template"), let(_object(at("_meta")), meta), string(at("file_type"), "file_type")]
        return F.array_compact(F.concat(*parts))

    unread = F.array(F.lit("payload is no JSON"))
    errors = let(root, lambda v: F.when(v.isNull(), unread).otherwise(let(_object(v), top)))
    out = payloads.withColumn("errors", errors)
    return out.withColumn("is_valid", F.size("errors") == 0)

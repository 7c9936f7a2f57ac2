"""Registered queries of stores, sources and repairs of records, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs, partials, payload
from ..sources import elements, ladder, tables
from ..sources.shared import shared_folder
from ..sources.snapshots import Snapshots
from ..streaming.corrections import current_corrections, keep_corrections
from .observed import RunMetrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def store_after_edits(spark, sf):
    """The state of a persisted store after an update, a deletion and an upsert, each by key bucket."""
    docs = tables.load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars")
    store = Snapshots.create(docs, shared_folder(spark, "store"), "id", buckets=32)
    store.update(docs.filter("id % 10 = 0").select("id", F.when(F.col("id") % 20 == 0, F.lit("moved")).alias("source"), (F.col("n_chars") + 1).alias("n_chars")))
    store.delete(tables.load(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id")))
    store.upsert(tables.load(spark, sf, "pages").select((F.col("page_id") * 7).alias("id"), F.lit("page").alias("source"), F.length("url").cast("long").alias("n_chars")))
    return store.read()


@_query
def stream_corrections(spark, sf):
    """The correction map after a stream of all samples, in files of a third each."""
    source, path, check = (shared_folder(spark, x) for x in ("samples", "corrections", "stream-state"))
    log = tables.samples(spark, sf).withColumn("part", F.col("sample_id") % 3).repartition("part")
    log.write.partitionBy("part").parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    keep_corrections(stream, path, check, buckets=16).awaitTermination()
    return current_corrections(spark, path)


@_query
def elements_of_pages(spark, sf):
    """Elements of two pages of each document, from dumps: written, and read by page."""
    path = shared_folder(spark, "dumps")
    li = tables.load(spark, sf, "lineitem")
    boxes = li.select((F.col("l_orderkey") % 200).alias("doc_id"), F.col("l_linenumber").cast("int").alias("page_num"), F.concat(F.lit("item "), F.col("l_partkey").cast("string")).alias("text"), *[F.col("l_quantity").alias(c) for c in elements.BOX])
    elements.write_dumps(boxes, path)
    found = elements.read_dumps(spark, path, "2-3")
    return found.groupBy("doc_id", "page_num").agg(F.count("*").alias("n"), F.min("text").alias("first"), F.sum("y1").alias("height"))


@_query
def ladder_choices(spark, sf):
    """A document's first line as plain text, its first three as columns, its longest line as routed pages, all of it as the scan."""
    docs = tables.load(spark, sf, "documents").select("doc_id", "text")
    parts = F.split("text", "\n")
    score = lambda n: (F.col("doc_id") % n / n).cast("double").alias("confidence")
    longest = F.array_max(F.transform(parts, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("i"), s.alias("s"))))["s"]
    found = ladder.read_ladder(
        docs, lambda d: d.select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("text")),
        lambda d: d.select("doc_id", F.array_join(F.slice(parts, 1, 3), "\n").alias("text"), score(10), (F.col("doc_id") % 4 == 0).alias("two_columns")),
        lambda d: d.select("doc_id", longest.alias("text"), score(7)), lambda d: d.select("doc_id", "text"),
    )
    return found.select("doc_id", F.md5("text").alias("digest"), F.round("confidence", 6).alias("confidence"), "step")


@_query
def jobs_from_raw(spark, sf):
    return jobs.raw_jobs(tables.raw_job_texts(spark, sf))


@_query
def jobs_fragments(spark, sf):
    return jobs.merge_fragments(tables.job_entries(spark, sf)).select("doc_id", "entry_no", "title", "description", "originalDescription")


@_query
def jobs_orphans(spark, sf):
    return jobs.merge_orphans(tables.job_entries(spark, sf)).select("doc_id", "entry_no", "title", "employer", "description")


@_query
def jobs_sequence(spark, sf):
    return jobs.repair_sequence(tables.job_entries(spark, sf)).select("doc_id", "entry_no", "title", "employer", "description")


@_query
def studies_partial(spark, sf):
    return partials.merge_partial_studies(tables.study_rows(spark, sf)).select("doc_id", "entry_no", "degree", "field", "school", "gpa", "gradYear")


@_query
def certificates_in_text(spark, sf):
    found = tables.certificate_texts(spark, sf).select("doc_id", F.posexplode(partials.certificates(F.col("text"))).alias("pos", "c"))
    return found.select("doc_id", F.col("pos").cast("long").alias("pos"), "c.name", "c.issuingOrg", "c.achievedDate")


@_query
def payload_checked(spark, sf):
    return payload.payload_errors(tables.payload_texts(spark, sf)).select("doc_id", F.array_join("errors", "; ").alias("errors"), "is_valid")


@_query
def run_metrics(spark, sf):
    """Counts and extremes by segment, taken while each segment's customers are written."""
    metrics, customers = RunMetrics(), tables.load(spark, sf, "customer")
    for nation in range(5):
        metrics.watch(customers.filter(F.col("c_nationkey") % 5 == nation), f"nations {nation}", {"c_acctbal": F.col("c_acctbal")}).write.format("noop").mode("overwrite").save()
    rows = [(name, s["rows"]["total"], s["c_acctbal"]["min"], s["c_acctbal"]["max"]) for name, s in metrics.all_stats().items() if "c_acctbal" in s]
    return spark.createDataFrame(rows, "name string, rows long, least double, most double")


_ENTRIES = f"e as ({tables.JOB_ENTRIES_SQL})"


def _folded(fragment: str, addition: str, leading: bool, columns: str) -> str:
    """Islands behind the last entry that is no fragment."""
    first = " and nth > 1" if leading else ""
    return f"""n as (select *, row_number() over (partition by doc_id order by entry_no) as nth from e),
f as (select *, ({fragment}){first} as frag, {addition} as addition from n),
i as (select *, sum((not frag)::int) over (partition by doc_id order by entry_no) as island from f),
m as (select doc_id, island, string_agg(addition, ' ' order by entry_no) filter (frag and addition <> '') as more from i group by all),
g as (select i.* replace (case when more is null then description else trim(description || ' ' || more) end as description,
        case when more is null or originalDescription = '' then originalDescription else trim(description || ' ' || more) end as originalDescription)
      from i join m using (doc_id, island) where not frag and island > 0)
select {columns} from g"""


_DATED = "(startYear <> '' or endYear <> '' or current)"
_STUDY = ("degree", "field", "school", "gpa", "gradYear")
_RELATED = "((a.degree <> '' and lower(a.degree) = lower(b.degree)) or (a.school <> '' and a.school = b.school) or (a.degree <> '' and a.school = '' and b.school <> '') or (a.school <> '' and a.degree = '' and b.degree <> ''))"
_ANCHOR = partials.ANCHOR


def _says(*cases: tuple[str, str]) -> str:
    return "concat_ws('; ', " + ", ".join("case when {} then '{}' end".format(test, text.replace("'", "''")) for test, text in cases) + ")"


def oracles(safe: str, quality: str) -> dict[str, str]:
    """``safe``: the SQL of safe corrections, as table safe; ``quality``: that of a text's quality, with {t} for the text."""
    stripped = "regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
    rate, bare = lambda t: "(" + quality.replace("{t}", t) + ")", lambda t: f"length({stripped.replace('{t}', t)})"
    return {
        "store_after_edits": """with d as (select doc_id as id, case when doc_id % 20 = 0 then 'moved' else source end as source, n_chars + (doc_id % 10 = 0)::int as n_chars from documents where doc_id not in (select doc_id from labels where toxic = 1)),
p as (select page_id * 7 as id, 'page' as source, length(url)::bigint as n_chars from pages)
select id, source, n_chars::bigint as n_chars from d where id not in (select id from p) union all select * from p""",
        "stream_corrections": f"with {safe} select field_name, original_norm, corrected_norm, corrected, cnt as count from safe",
        "elements_of_pages": """select l_orderkey % 200 as doc_id, l_linenumber::int as page_num, count(*) as n, min('item ' || l_partkey::varchar) as first, sum(l_quantity) as height
from lineitem where l_linenumber between 2 and 3 group by all""",
        "ladder_choices": f"""with d as (select doc_id, text, string_split(text, chr(10)) as p, (doc_id % 10) / 10.0::double as c, (doc_id % 7) / 7.0::double as r from documents),
a as (select *, array_to_string(p[1:3], chr(10)) as ct, list_max([length(x) for x in p]) as most from d),
b as (select *, ct <> '' and (c >= 0.04 or (doc_id % 4 = 0 and c >= 0.35)) as by_column, [x for x in p if length(x) = most][1] as rt from a),
s as (select *, case when by_column then ct else p[1] end as t0, case when by_column then c else 0 end as c0 from b),
q as (select *, case when {bare("t0")} > 50 and c0 <= 0 then {rate("t0")} else c0 end as c1 from s),
w as (select *, case when c1 >= 0.7 and {bare("t0")} >= 180 then 'text' when {bare("rt")} > 50 and r >= greatest(c1, 0.3) then 'routed' when {bare("text")} > 50 then 'scanned' else 'left' end as step from q)
select doc_id, md5(case step when 'routed' then rt when 'scanned' then text else t0 end) as digest,
  round(case step when 'text' then c1 when 'routed' then r when 'scanned' then {rate("text")} * 0.8::double else {rate("t0")} end, 6) as confidence, step from w""",
        # told by layout, from the columns that the texts are made of
        "jobs_from_raw": """with c as (select c_custkey as doc_id, c_custkey % 4 as layout from customer)
select doc_id, 1::bigint as entry_no, 'Sales Manager' as title, 'Brook ' || doc_id % 9 as company, 'Jan ' || (2001 + doc_id % 20) || ' - Present' as duration, '' as location, 'opened shop ' || doc_id || chr(10) || 'Prepared monthly accounts' as description from c where layout = 0
union all select doc_id, 1, 'Planning Analyst', 'Fern Works', '2010 - ' || (2011 + doc_id % 9), 'Pune', 'Reviewed file ' || doc_id from c where layout = 1
union all select doc_id, 2, '', '', '2005 - 2007', '', 'Supported the desk' from c where layout = 1
union all select doc_id, 1, 'Audit Officer', 'Norwood', 'Mar 2015 - Apr 2016', '', '' from c where layout = 2
union all select doc_id, 2, 'Trainer', 'Quill', '2012 - 2014', '', 'taught ' || doc_id || ' people' from c where layout = 2""",
        "jobs_fragments": f"with {_ENTRIES}, {_folded(f'not {_DATED} and title not like $$Planner%$$', 'description', False, 'doc_id, entry_no, title, description, originalDescription')}",
        "jobs_orphans": f"with {_ENTRIES}, {_folded('title = $$$$ and employer = $$$$ and description <> $$$$', 'description', True, 'doc_id, entry_no, title, employer, description')} where title <> '' or employer <> '' or description = '' or {_DATED}",
        "jobs_sequence": f"with {_ENTRIES}, {_folded(f'title like $$Managed%$$ and employer = $$$$ and not {_DATED}', 'trim(title || chr(32) || description)', True, 'doc_id, entry_no, title, employer, description')}",
        # one study after another, each taking the unused ones behind it that belong to it
        "studies_partial": f"""with recursive e as ({tables.STUDY_ROWS_SQL}), l as (select doc_id, list({{'no': entry_no, {", ".join(f"'{c}': {c}" for c in _STUDY)}}} order by entry_no) as rest from e group by doc_id),
s as (select doc_id, rest, rest[1:0] as own, 0 as nth from l union all
  select doc_id, [b for b in rest[2:] if not {_RELATED.replace("a.", "rest[1].")}], [rest[1]] || [b for b in rest[2:] if {_RELATED.replace("a.", "rest[1].")}], nth + 1 from s where len(rest) > 0)
select doc_id, nth::bigint as entry_no, {", ".join(f"coalesce([x.{c} for x in own if x.{c} <> ''][1], '') as {c}" for c in _STUDY)} from s where nth > 0""",
        "certificates_in_text": f"""with t as (select doc_id, string_split(text, ' a@b.co')[1] as text from ({tables.CERTIFICATE_TEXT_SQL})),
m as (select doc_id, regexp_extract_all(trim(text, ' ,'), '{_ANCHOR}') as names, regexp_split_to_array(trim(text, ' ,'), '{_ANCHOR}') as pieces from t),
n as (select doc_id, i - 1 as pos, names[i] as name, trim(pieces[i + 1], ' ,') as tail from m, unnest(range(1, len(names) + 1)) as u(i)),
y as (select *, regexp_extract(tail, '(?:19|20)[0-9]{{2}}') as year, contains(tail, 'Mar ') as march from n)
select doc_id, pos, trim(regexp_replace(name, '^.*(?:19|20)[0-9]{{2}}(.*Certification)', '\\1'), ' ,') as name, trim(regexp_replace(tail, 'Mar|(?:19|20)[0-9]{{2}}', '', 'g'), ' ,') as "issuingOrg",
  case when year = '' then '' when march then 'March ' || year else year end as "achievedDate" from y""",
        "payload_checked": "select o_orderkey as doc_id, case when o_orderkey % 29 = 0 then 'payload is no JSON' when o_orderkey % 19 = 0 then 'root has unsupported keys: [''more'']' else "
        + _says(
            ("o_orderkey % 3 = 0", "personal.city must be a string"), ("o_orderkey % 5 = 0", "personal.websites[1] must be a string"), ("o_orderkey % 7 = 0", "skills must be an array"),
            ("o_orderkey % 2 = 1", "education[0].gradMonth must be one of the canonical month values or ''"), ("o_orderkey % 11 = 0", "certifications[0].achievedDate must be '', 'YYYY', or 'Month YYYY'"),
            ("o_orderkey % 13 = 0", "languages[0].level must be one of ['Advanced', 'Beginner', 'Fluent', 'Intermediate', 'Native']"), ("o_orderkey % 17 = 0", "_meta.local_resume_id must be integer"),
        )
        + " end as errors, errors = '' as is_valid from orders",
        "run_metrics": "select 'nations ' || c_nationkey % 5 as name, count(*) as rows, min(c_acctbal) as least, max(c_acctbal) as most from customer group by all",
    }

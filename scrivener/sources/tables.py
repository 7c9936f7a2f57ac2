"""Parquet tables, the schemas of stored records, and views derived from the tables by SQL that any engine reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: So many documents, made of narrow rows, are one task's work.
DOCUMENTS_A_TASK = 5000

#: Résumé-like documents: one for each customer.
RESUME_TEXT_SQL = """
select c_custkey as doc_id, 'Name: '||c_name||chr(10)||'Email: '||lower(replace(c_name,'#','.'))||'@example.com'||chr(10)
 ||'Phone: (555) '||cast(100 + c_custkey % 900 as string)||'-'||cast(1000 + c_custkey % 9000 as string)||chr(10)
 ||'https://github.com/user'||cast(c_custkey % 50 as string)||' and www.example.org/cv'||chr(10)
 ||'SUMMARY'||chr(10)||'Experienced analyst in '||n_name||chr(10)||'with many years of expertise in reporting'||chr(10)||chr(10)
 ||'Technical Skills:'||chr(10)||'python, sql, leadership'||chr(10)||'Python, sql, leadership'||chr(10)||'- docker and react'||chr(10)
 ||'Databases: mysql, redis'||chr(10)||'Work Experience'||chr(10)||c_mktsegment||' manager 2015 - 2019'||chr(10)
 ||'- managed the company team'||chr(10)||chr(10)||'Software developer at Acme Ltd'||chr(10)
 ||'Jan '||cast(2019 + c_custkey % 4 as string)||' - Present'||chr(10)||'- developed web applications'||chr(10)
 ||'EDUCATION'||chr(10)||'B.Tech, State University '||cast(2000+c_custkey%20 as string)||chr(10)||'GPA 8.'||cast(c_custkey % 10 as string)||chr(10)
 ||chr(10)||'Diploma, City College'||chr(10)||'1999 - 2002'||chr(10)
 ||'PROJECTS'||chr(10)||'Inventory Portal'||chr(10)||'- built an api with python and react, see github.com/user'||cast(c_custkey % 50 as string)||chr(10)
 ||chr(10)||'Sales Board'||chr(10)||'- designed a reporting application on aws'||chr(10)
 ||case when c_custkey % 2 = 0 then 'CERTIFICATIONS'||chr(10)||'AWS Certified Developer 2020'||chr(10)||'Scrum Master certificate 2018'||chr(10) else '' end
 ||case when c_custkey % 3 = 0 then 'Awards'||chr(10)||'Won the first prize in a contest'||chr(10)||'2017'||chr(10)||'won the FIRST prize in a contest'||chr(10) else '' end
 ||'Languages'||chr(10)||'English, Hindi'||chr(10)||'French - basic'||chr(10)||'shorthand'||chr(10)
 ||'Interests'||chr(10)||'chess and cricket'||chr(10)||'painting'||chr(10)
 ||case when c_custkey % 5 = 0 then 'Publications'||chr(10)||'Paper on research at a conference, volume 3'||chr(10) else '' end
 ||case when c_custkey % 7 = 0 then 'Volunteering'||chr(10)||'Community trust organization'||chr(10) else '' end
 ||case when c_custkey % 4 = 0 then 'Trainings attended'||chr(10)||'Completed a workshop on leadership'||chr(10) else '' end
 ||case when c_custkey % 6 = 0 then 'Strengths'||chr(10)||'analytical and organized'||chr(10)||'confident'||chr(10) else '' end
 ||'References'||chr(10)||'Dr. Reed, professor, phone on request'||chr(10)
 ||'Declaration'||chr(10)||'I hereby declare that the above is accurate' as text
from customer join nation on c_nationkey = n_nationkey
"""

#: Feedback on extracted fields: one sample for each event.
SAMPLES_SQL = """
select event_id as sample_id, user_id as resume_id, event_type as field_name,
  'v'||cast(user_id % 150 as string) as original_value,
  case when event_id % 131 = 0 then '' when event_id % 5 = 0 then 'v'||cast(user_id % 150 as string)
       else 'c'||cast(case when event_id % 7 < 4 then 0 else event_id % 3 end as string) end as corrected_value,
  cast(event_id % 100 as double)/100 as confidence_before,
  case when event_id % 97 = 0 then 'rejection' when event_id % 17 = 0 then 'confirmation' else 'correction' end as feedback_type,
  case when event_id % 97 = 0 then 'rejected' when event_id % 19 = 0 then 'pending' else 'approved' end as status,
  cast(event_id as string) as seq, ts
from events
"""

_NUMBERED = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)"

#: Entries of jobs: one for each line item, some of them fragments of the one in front, one or several or leading.
JOB_ENTRIES_SQL = f"""
select l_orderkey as doc_id, cast({_NUMBERED} as bigint) as entry_no,
  case l_partkey % 7 when 0 then '' when 1 then 'Education' when 2 then 'Managed the night shift' when 3 then 'one two three four five six seven' else 'Planner '||cast(l_suppkey as string) end as title,
  case when l_suppkey % 3 = 0 then 'Brook Group' else '' end as employer, case when l_quantity > 40 then '2019' else '' end as startYear, case when l_quantity > 45 then '2020' else '' end as endYear,
  l_quantity = 7 as current, case when l_partkey % 5 = 0 then '' else 'part '||cast(l_partkey as string) end as description, case when l_partkey % 2 = 0 then 'first' else '' end as originalDescription
from lineitem
"""

#: Rows of studies that complete one another, or contradict one another: one for each line item.
STUDY_ROWS_SQL = f"""
select l_orderkey as doc_id, cast({_NUMBERED} as bigint) as entry_no, case l_partkey % 4 when 0 then '' when 1 then 'Diploma' when 2 then 'diploma' else 'Master of Law' end as degree,
  case when l_partkey % 3 = 0 then 'Law' else '' end as field, case l_suppkey % 4 when 0 then 'North College' when 1 then 'South School' else '' end as school, case when l_quantity > 30 then cast(cast(l_quantity as int) as string) else '' end as gpa,
  '' as gradMonth, case when l_suppkey % 5 = 0 then cast(1990 + l_suppkey % 30 as string) else '' end as gradYear, '' as location
from lineitem
"""

#: Raw sections of jobs in four layouts: one for each customer.
RAW_JOBS_SQL = """
select c_custkey as doc_id, case c_custkey % 4
  when 0 then 'WORK EXPERIENCE'||chr(10)||'Sales Manager at Brook '||cast(c_custkey % 9 as string)||chr(10)||'Jan '||cast(2001 + c_custkey % 20 as string)||' - Present'||chr(10)||'- opened shop '||cast(c_custkey as string)
    ||chr(10)||'Prepared monthly accounts'||chr(10)||'EDUCATION'||chr(10)||'Cloud Engineer at Nowhere'||chr(10)||'2001'
  when 1 then '- stray bullet'||chr(10)||'Planning Analyst'||chr(10)||'Fern Works'||chr(10)||'Pune - 2010 - '||cast(2011 + c_custkey % 9 as string)||chr(10)||'Reviewed file '||cast(c_custkey as string)
    ||chr(10)||'2005 - 2007'||chr(10)||'Supported the desk'
  when 2 then 'Experience'||chr(10)||'Audit Officer @ Norwood'||chr(10)||'Mar 2015 - Apr 2016'||chr(10)||'Trainer at Quill'||chr(10)||'2012 - 2014'||chr(10)||'Key Responsibilities'||chr(10)||'- taught '||cast(c_custkey as string)||' people'
  else 'some plain words'||chr(10)||'and more of them '||cast(c_custkey as string) end as text
from customer
"""

#: Running text that names certificates, up to three in a text: one for each customer.
CERTIFICATE_TEXT_SQL = """
select c_custkey as doc_id, case when c_custkey % 5 = 0 then '' else 'Cloud Basics Certification '||case when c_custkey % 2 = 0 then 'Norwood ' else '' end||'Mar '||cast(2001 + c_custkey % 20 as string)||', ' end
  ||case when c_custkey % 3 = 0 then '' else 'Tax Law Certificate Fern Online '||cast(1990 + c_custkey % 30 as string)||' ' end||case when c_custkey % 7 = 0 then 'Deep Full Stack Web Development' else '' end
  ||case when c_custkey % 11 = 0 then ' a@b.co Late Certificate' else '' end as text
from customer
"""

#: Builder payloads as text, most of them broken in one or more places: one for each order.
PAYLOAD_SQL = """
select o_orderkey as doc_id, case when o_orderkey % 29 = 0 then '{broken' else
  '{"personal":{"firstName":"a","lastName":"b","profession":"","onet_code":"","city":'||case when o_orderkey % 3 = 0 then '7' else '"x"' end||',"country":"","pincode":"","phone":"","email":"","linkedin":"","websites":['
  ||case when o_orderkey % 5 = 0 then '"u",1' else '' end||']},"summary":"","skills":'||case when o_orderkey % 7 = 0 then '"sql"' else '["sql"]' end||',"education":[{"school":"","location":"","field":"","degree":"","gradMonth":"'
  ||case when o_orderkey % 2 = 0 then 'May' else 'may' end||'","gradYear":"2001","gpa":""}],"experience":[],"projects":[],"certifications":[{"name":"","issuingOrg":"","achievedDate":"'
  ||case when o_orderkey % 11 = 0 then '05/2001' else 'May 2001' end||'","url":""}],"languages":[{"name":"x","level":"'||case when o_orderkey % 13 = 0 then 'Great' else 'Fluent' end||'"}],"template":"t","_meta":{"local_resume_id":'
  ||case when o_orderkey % 17 = 0 then '"1"' else cast(o_orderkey as string) end||'},"file_type":"pdf"'||case when o_orderkey % 19 = 0 then ',"more":1' else '' end||'}' end as payload
from orders
"""


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt out by their key: files are split by bytes, and a few bytes of a narrow row become a long text.

    What groups by the key afterwards finds its rows together and shuffles no more.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // DOCUMENTS_A_TASK))
    return rows.repartition(tasks, key)


def _over(spark: SparkSession, sf_dir: str, sql: str, *tables: str, by: str | None = None) -> DataFrame:
    """The SQL over the named tables, bound by name, so no view is left in the session; the first dealt out ``by`` its key."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = sql.replace(f" {t} ", f" {{{t}}} ").replace(f" {t}\n", f" {{{t}}}\n")
    bound = {t: load(spark, sf_dir, t) for t in tables}
    if by:
        bound[tables[0]] = spread(bound[tables[0]], by)
    return spark.sql(sql, **bound)


def resume_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, RESUME_TEXT_SQL, "customer", "nation", by="c_custkey")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, SAMPLES_SQL, "events")


def job_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, JOB_ENTRIES_SQL, "lineitem")


def study_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, STUDY_ROWS_SQL, "lineitem")


def raw_job_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, RAW_JOBS_SQL, "customer", by="c_custkey")


def certificate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, CERTIFICATE_TEXT_SQL, "customer", by="c_custkey")


def payload_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over(spark, sf_dir, PAYLOAD_SQL, "orders", by="o_orderkey")


_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: One line of the correction log (JSON lines).
CORRECTION_SCHEMA = _struct(
    sample_id=_S, resume_id=_L, field_name=_S, original_value=_S, corrected_value=_S, confidence_before=_D, confidence_after=_D, feedback_type=_S,
    status=_S, source=_S, user_id=_S, session_id=_S, comment=_S, model_name=_S, model_version=_S,
    extraction_context=_struct(feedback_id=_S, correction_id=_S, backfill=_B), timestamp=_S, updated_at=_S,
)
#: One file of the feedback folder.
FEEDBACK_SCHEMA = _struct(resume_id=_L, field_name=_S, original_value=_S, corrected_value=_S, user_id=_S, session_id=_S, feedback_type=_S, comment=_S, timestamp=_S, processed=_B)
#: A stored résumé.
RESUME_SCHEMA = _struct(id=_L, filename=_S, structured_data=_S, extracted_text=_S, layout_html=_S, original_pdf_path=_S, created_at=T.TimestampType(), updated_at=T.TimestampType())
#: A version of a model in the registry.
VERSION_SCHEMA = _struct(
    model_name=_S, model_type=_S, version_id=_S, created_at=_S, status=_S, model_path=_S, training_samples=_L, accuracy=_D, metrics=T.MapType(_S, _D), config=_S, notes=_S
)
EXAMPLE_SCHEMA = _struct(field_name=_S, text=_S, label=_S, source=_S, confidence=_D, verified=_B)

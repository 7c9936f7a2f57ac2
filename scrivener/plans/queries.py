"""The registered queries of the document and feedback engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, entities, scores, text
from ..operators import ats, builder, entries, feedback, layout, lines, mapper, names, schema, sections, similarity, store
from ..sources.shared import cut
from ..sources.tables import load, resume_text, samples
from . import documents, repairs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


# feedback ---------------------------------------------------------------------


@query
def fb_filtered_scan(spark, sf):
    return feedback.filtered(samples(spark, sf), field_name="click", status="approved", feedback_type="correction").select("sample_id", "original_value", "corrected_value")


@query
def fb_changed_only(spark, sf):
    return feedback.filtered(samples(spark, sf), only_changed=True).select("sample_id", "field_name", "original_value", "corrected_value")


@query
def fb_pending(spark, sf):
    return feedback.pending(samples(spark, sf)).select("sample_id", "field_name", "status")


@query
def fb_stats_grouping_sets(spark, sf):
    return feedback.statistics(samples(spark, sf))


@query
def fb_error_by_field(spark, sf):
    return feedback.errors_by_field(samples(spark, sf))


@query
def fb_common_mistakes_topk(spark, sf):
    return feedback.common_mistakes(samples(spark, sf)).select("field_name", "rank", "original_norm", "corrected", "count")


@query
def fb_problem_fields(spark, sf):
    return feedback.problem_fields(samples(spark, sf))


@query
def fb_calibration_profile(spark, sf):
    return feedback.calibration_profile(samples(spark, sf))


@query
def fb_calibrate_apply(spark, sf):
    s = samples(spark, sf)
    rows = s.select("sample_id", "field_name", F.col("confidence_before").alias("confidence"))
    return feedback.calibrate(rows, feedback.calibration_profile(s))


@query
def fb_safe_map(spark, sf):
    return feedback.safe_corrections(samples(spark, sf)).select("field_name", "original_norm", "corrected_norm", "count")


@query
def fb_apply_corrections(spark, sf):
    s = samples(spark, sf)
    values = s.select("sample_id", "field_name", F.col("original_value").alias("value"), F.col("confidence_before").alias("confidence"))
    done = feedback.apply_corrections(values, feedback.safe_corrections(s), feedback.calibration_profile(s))
    return done.select("sample_id", "new_value", "corrected", "new_confidence")


@query
def fb_backfill_antijoin(spark, sf):
    s = samples(spark, sf)
    return feedback.backfill(s.filter("sample_id % 2 = 1"), s.filter("sample_id % 2 = 0")).select("sample_id", *feedback.BACKFILL_KEY)


@query
def fb_export(spark, sf):
    return feedback.export(samples(spark, sf))


@query
def fb_set_status(spark, sf):
    s = samples(spark, sf)
    return feedback.set_status(s, s.filter("status = 'pending'").select(F.col("sample_id").alias("id")), "rejected").select("sample_id", "status")


# documents ----------------------------------------------------------------------


@query
def doc_lines(spark, sf):
    x = lines.lines(load(spark, sf, "documents"))
    return x.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count(F.when(F.col("line") != "", 1)).alias("n_full"), F.max(F.length("line")).cast("bigint").alias("longest"))


@query
def doc_text_confidence(spark, sf):
    return load(spark, sf, "documents").select("doc_id", scores.text_quality(F.col("text")).alias("confidence"))


@query
def doc_word_stats(spark, sf):
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    return load(spark, sf, "documents").select("doc_id", F.size(words).cast("bigint").alias("n_words"), F.size(scores.words_of(F.col("text"))).cast("bigint").alias("n_distinct"))


@query
def doc_emails(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.explode(entities.emails(F.col("text"))).alias("email"))


@query
def doc_phones(spark, sf):
    return load(spark, sf, "documents").select("doc_id", entities.first_phone(F.col("text")).alias("phone")).filter("phone <> ''")


@query
def doc_entity_counts(spark, sf):
    t = F.col("text")
    count = lambda a: F.size(a).cast("bigint")
    return load(spark, sf, "documents").select("doc_id", count(entities.emails(t)).alias("emails"), count(entities.links(t)).alias("links"), count(F.regexp_extract_all(t, F.lit(dates.YEAR), F.lit(0))).alias("years"))


@query
def doc_line_dedupe_ci(spark, sf):
    clean = F.filter(F.transform(text.lines_of(F.col("text")), lambda x: text.strip(x)), lambda x: x != "")
    return load(spark, sf, "documents").select("doc_id", F.size(text.distinct_ci(clean)).cast("bigint").alias("n_distinct"), F.array_join(text.distinct_ci(clean), "\n").alias("text"))


@query
def doc_repeated_lines_topk(spark, sf):
    x = lines.lines(load(spark, sf, "documents")).filter("line <> ''").groupBy("line").agg(F.count("*").alias("total"))
    return x.orderBy(F.col("total").desc(), "line").limit(10)


@query
def doc_best_scan(spark, sf):
    """Of each document as it is, in lower case, and cut at its first line end: the reading with the best rank."""
    d = load(spark, sf, "documents")
    ways = F.array(*[F.struct(F.lit(k).alias("attempt"), F.lit(n).alias("method"), c.alias("text")) for k, (n, c) in enumerate((("plain", F.col("text")), ("lower", F.lower("text")), ("first", F.substring_index("text", "\n", 1))))])
    tried = d.select("doc_id", F.inline(ways)).withColumn("score", scores.text_quality(F.col("text")))
    return layout.best_reading(tried).select("doc_id", "method", "score")


@query
def doc_key_normal(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.md5(text.lookup_key(F.col("text"))).alias("key"))


@query
def sim_jaccard(spark, sf):
    return similarity.similar(load(spark, sf, "documents"), load(spark, sf, "benchmark"), 0.3).withColumn("jaccard", F.round("jaccard", 6))


@query
def sim_overlap(spark, sf):
    return similarity.contained(load(spark, sf, "documents"), load(spark, sf, "benchmark")).withColumn("overlap", F.round("overlap", 6))


@query
def page_text(spark, sf):
    t = layout.strip_html(F.col("html"))
    return load(spark, sf, "pages").select("page_id", F.md5(t).alias("digest"), F.length(t).cast("bigint").alias("chars"))


@query
def conversation_order(spark, sf):
    """Turns as one text, in their order, as documents of several pages are joined."""
    x = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("said")))), lambda v: v["said"]), "\n")
    return load(spark, sf, "conversations").groupBy("conv_id").agg(F.md5(x).alias("digest"), F.count("*").alias("turns"))


# résumés ------------------------------------------------------------------------


def _section(s: sections.Section) -> Query:
    return lambda spark, sf: sections.extract_sections(resume_text(spark, sf), [s])


for _s in sections.SECTIONS:
    _QUERIES[f"sec_{_s.name.replace('-', '_')}"] = _section(_s)


@query
def sec_skills(spark, sf):
    return sections.extract_skills(resume_text(spark, sf))


@query
def sec_summary(spark, sf):
    return sections.extract_summary(resume_text(spark, sf))


@query
def res_headings(spark, sf):
    return lines.detect_headings(resume_text(spark, sf)).withColumn("line_no", F.col("line_no").cast("bigint"))


@query
def res_headings_confidence(spark, sf):
    return lines.headings_confidence(resume_text(spark, sf))


@query
def res_sections_islands(spark, sf):
    x = lines.islands(lines.lines(resume_text(spark, sf))).filter("line <> ''")
    return x.groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("bigint").alias("chars"))


@query
def res_rebuilt_lines(spark, sf):
    x = lines.rebuilt_lines(resume_text(spark, sf)).filter("line <> ''")
    return x.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query
def res_unmatched(spark, sf):
    return lines.unmatched(resume_text(spark, sf))


@query
def res_entry_chunks(spark, sf):
    return lines.entry_chunks(resume_text(spark, sf)).withColumn("entry_no", F.col("entry_no").cast("bigint"))


@query
def res_section_confidence(spark, sf):
    return lines.isolated_sections(resume_text(spark, sf)).select("doc_id", "section", "confidence", "valid")


@query
def res_full_text(spark, sf):
    return lines.full_text(resume_text(spark, sf))


def _isolated(spark, sf, name):
    return lines.isolated_sections(resume_text(spark, sf), only=[name]).select("doc_id", "text")


@query
def res_skills_split(spark, sf):
    return entries.parse_skills(sections.extract_skills(resume_text(spark, sf)).select("doc_id", "text"))


@query
def res_skill_categories(spark, sf):
    return res_skills_split(spark, sf).groupBy("category").agg(F.count("*").alias("total"), F.count_distinct("skill").alias("n_skills"))


@query
def res_education_entries(spark, sf):
    return entries.parse_education(_isolated(spark, sf, "education")).withColumn("entry_no", F.col("entry_no").cast("bigint"))


@query
def res_experience_entries(spark, sf):
    return entries.parse_experience(_isolated(spark, sf, "experience")).withColumn("entry_no", F.col("entry_no").cast("bigint"))


@query
def res_project_entries(spark, sf):
    x = entries.parse_projects(_isolated(spark, sf, "projects"))
    return x.select("doc_id", F.col("entry_no").cast("bigint").alias("entry_no"), "name", F.array_join("technologies", ",").alias("technologies"), "link", "description")


@query
def res_certifications(spark, sf):
    return entries.parse_certifications(_isolated(spark, sf, "certifications")).withColumn("entry_no", F.col("entry_no").cast("bigint"))


@query
def res_builder_jobs(spark, sf):
    j = schema.job(F.col("title"), F.col("company"), F.col("duration"), F.col("description"))
    return entries.parse_experience(_isolated(spark, sf, "experience")).select("doc_id", F.col("entry_no").cast("bigint").alias("entry_no"), j.alias("j")).select("doc_id", "entry_no", "j.*")


@query
def res_date_range(spark, sf):
    x = lines.lines(resume_text(spark, sf)).filter(F.col("line").rlike(r"\b(19|20)\d{2}\b")).withColumn("r", dates.date_range(F.col("line")))
    return x.groupBy("r.start_month", "r.start_year", "r.end_month", "r.end_year", "r.current").agg(F.count("*").alias("total"))


@query
def res_years_experience(spark, sf):
    jobs = entries.parse_experience(_isolated(spark, sf, "experience")).filter("duration is not null")
    ranges = F.collect_list(dates.date_range(F.col("duration")))
    return jobs.groupBy("doc_id").agg(dates.years_of_experience(ranges, F.lit(2024)).cast("bigint").alias("years"))


@query
def res_languages(spark, sf):
    spoken = sections.extract_sections(resume_text(spark, sf), [sections.BY_NAME["languages"]])
    return spoken.select("doc_id", F.explode(schema.items(F.col("text"))).alias("item")).select("doc_id", schema.language(F.col("item")).alias("l")).select("doc_id", "l.name", "l.level")


@query
def res_entities(spark, sf):
    return documents.entity_sections(resume_text(spark, sf))


@query
def res_names(spark, sf):
    """Names written in four ways in front of each text; the dictionary knows some of them."""
    first, last = F.element_at(F.array(*map(F.lit, ("Mara", "Otto", "Ines", "Yann"))), (F.col("doc_id") % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("Quill", "Fern", "Brook"))), (F.col("doc_id") % 3 + 1).cast("int"))
    full = F.concat_ws(" ", first, last)
    line = F.when(F.col("doc_id") % 5 == 0, F.upper(full)).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("Mr. "), full)).when(F.col("doc_id") % 5 == 2, F.concat(F.lit("Name: "), full)).when(F.col("doc_id") % 5 == 3, full).otherwise(F.lit("Software Engineer"))
    docs = resume_text(spark, sf).select("doc_id", F.concat(line, F.expr("substring(text, instr(text, chr(10)))")).alias("text"))
    return names.names(docs, spark.createDataFrame([("Mara",), ("Brook",)], "name string"))


@query
def res_ats(spark, sf):
    return ats.is_ats(resume_text(spark, sf)).withColumn("indicators", F.col("indicators").cast("bigint"))


@query
def res_ats_skills(spark, sf):
    return ats.skills(resume_text(spark, sf))


@query
def res_ats_education(spark, sf):
    return ats.education(resume_text(spark, sf))


@query
def res_ats_experience(spark, sf):
    return ats.experience(resume_text(spark, sf))


@query
def res_ats_name(spark, sf):
    return ats.name(resume_text(spark, sf))


@query
def res_choose_best(spark, sf):
    s = samples(spark, sf)
    pick = scores.choose_best(F.col("original_value"), F.col("confidence_before"), F.col("corrected_value"), (F.col("sample_id") % 7) / 7.0)
    return s.select("sample_id", pick.alias("p")).select("sample_id", "p.text", F.round("p.confidence", 6).alias("confidence"))


@query
def res_prefer_layout(spark, sf):
    s = samples(spark, sf)
    pick = scores.prefer_layout(F.col("corrected_value"), (F.col("sample_id") % 7) / 7.0, F.col("original_value"), F.col("confidence_before"), F.col("field_name"), (F.col("sample_id") % 3) / 3.0)
    return s.select("sample_id", pick.alias("p")).select("sample_id", "p.text", F.round("p.confidence", 6).alias("confidence"))


@query
def res_ensemble_confidence(spark, sf):
    s = samples(spark, sf)
    e = scores.ensemble((F.col("sample_id") % 5) / 5.0, (F.col("sample_id") % 4) / 4.0, (F.col("sample_id") % 3) / 3.0, F.lit(0.0))
    return s.select("sample_id", e.alias("e")).select("sample_id", "e.method", "e.confidence")


@query
def res_parse(spark, sf):
    """The whole chain: extractors, choice, corrections, calibration."""
    return documents.parse(resume_text(spark, sf), samples(spark, sf))


@query
def res_native_payload(spark, sf):
    docs = resume_text(spark, sf)
    natives = mapper.native_payload(mapper.structured_output(docs, documents.section_table(docs)))
    return natives.select("doc_id", "native")


@query
def res_builder_mapped(spark, sf):
    """The builder records of all documents, through the mapper."""
    docs = resume_text(spark, sf)
    return documents.builder_records(docs, documents.section_table(docs))


@query
def res_by_kind(spark, sf):
    return sections.by_kind(resume_text(spark, sf), ("skills", "education", "experience", "projects", "certifications", "awards", "languages", "summary"))


@query
def res_accuracy(spark, sf):
    return documents.accuracy(documents.all_sections(resume_text(spark, sf)))


def _records(spark, sf):
    docs = resume_text(spark, sf)
    return documents.records(docs, documents.resolve(documents.section_table(docs), cut(lines.isolated_sections(docs), "isolated")))


@query
def res_schema_v1(spark, sf):
    r = _records(spark, sf)
    p = F.col("personal_information")
    return r.select("doc_id", p["name"].alias("name"), p["email"].alias("email"), "summary", F.size("work_experience").alias("jobs"), F.size("education").alias("studies"), F.size("custom_sections").alias("customs"), "is_valid")


@query
def res_builder(spark, sf):
    b = schema.builder_errors(schema.to_builder(_records(spark, sf)))
    return b.select("doc_id", "personal.firstName", "personal.email", F.size("skills").alias("skills"), F.size("languages").alias("languages"), F.size("errors").alias("errors"), "is_valid")


@query
def res_section_text(spark, sf):
    return schema.section_text(_records(spark, sf))


@query
def res_builder_skills(spark, sf):
    named = sections.extract_skills(resume_text(spark, sf)).select("doc_id", builder.skills(schema.items(F.col("text"))).alias("s"))
    return named.select("doc_id", F.array_join("s", ",").alias("skills"))


@query
def res_degree_blocks(spark, sf):
    studies = entries.parse_education(_isolated(spark, sf, "education")).filter("degree is not null")
    return studies.select("doc_id", F.col("entry_no").cast("bigint").alias("entry_no"), builder.degree_block(F.col("degree")).alias("b")).select("doc_id", "entry_no", "b.*")


@query
def res_studies_merged(spark, sf):
    return builder.merge_studies(res_degree_blocks(spark, sf))


@query
def res_jobs_distinct(spark, sf):
    j = schema.job(F.col("title"), F.col("company"), F.col("duration"), F.col("description"))
    jobs = entries.parse_experience(_isolated(spark, sf, "experience")).select("doc_id", F.struct("entry_no", j.alias("j")).alias("x"))
    kept = builder.distinct_jobs(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["j"]))
    return jobs.groupBy("doc_id").agg(kept.alias("jobs")).select("doc_id", F.posexplode("jobs").alias("pos", "j")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "j.title", "j.employer", builder.job_quality(F.col("j")).alias("quality"))


# stores --------------------------------------------------------------------------


def _stored(spark, sf):
    return load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit(".txt")).alias("filename"), F.col("text").alias("extracted_text"), F.col("n_chars").alias("created_at"), F.lit("").alias("layout_html"))


@query
def store_search_ilike(spark, sf):
    return store.search(_stored(spark, sf), "src1_").select("id", "filename")


@query
def store_latest(spark, sf):
    return store.latest(_stored(spark, sf), "filename", "created_at", "id").select("id", "filename", "created_at")


@query
def store_orphans_antijoin(spark, sf):
    return store.without_file(load(spark, sf, "documents").select("doc_id"), load(spark, sf, "labels"), "doc_id").select("doc_id")


@query
def store_delete_newest(spark, sf):
    return store.delete_newest(_stored(spark, sf), "src1.txt").select("id", "filename", "created_at")


@query
def store_update(spark, sf):
    docs = _stored(spark, sf).select("id", "filename", "created_at")
    changes = docs.filter("id % 10 = 0").select("id", F.when(F.col("id") % 20 == 0, F.lit("renamed.txt")).alias("filename"))
    return store.update(docs, changes).select("id", "filename", "created_at")


@query
def store_previews(spark, sf):
    return _stored(spark, sf).select("id", F.md5(text.preview(F.col("extracted_text"))).alias("digest"))


def _versions(spark, sf):
    e = load(spark, sf, "events")
    status = F.when(F.col("event_id") % 50 == 7, "active").when(F.col("event_id") % 3 == 0, "archived").otherwise("staged")
    return e.select(F.col("event_type").alias("model_name"), F.col("event_id").cast("string").alias("version_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("created_at"), status.alias("status"))


@query
def registry_models(spark, sf):
    return store.models(_versions(spark, sf))


@query
def registry_deploy(spark, sf):
    """One version that exists and one that does not."""
    return store.deploy(store.deploy(_versions(spark, sf), "click", "1"), "view", "none").select("model_name", "version_id", "status")


@query
def train_split(spark, sf):
    return store.split(samples(spark, sf)).select("sample_id", "part")


@query
def train_stats(spark, sf):
    s = samples(spark, sf)
    return store.dataset_statistics(store.examples(s.filter("status = 'pending'"), s.filter("status = 'approved'")))


@query
def train_augment(spark, sf):
    s = samples(spark, sf)
    """Every example as it is, and how many variations it has."""
    rows = store.augment(store.examples(s.filter("status = 'pending'"), s.filter("status = 'approved'")), 3)
    kept = F.count(F.when(~F.col("augmented"), F.col("text")))
    return rows.groupBy("field_name", "source", "verified", "label").agg(kept.alias("originals"), F.count(F.when(F.col("augmented"), 1)).alias("variations"))


# layout ----------------------------------------------------------------------------


def elements(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes from line items: an order is a document; odd parts stand in the left column, even ones in the right."""
    li = load(spark, sf, "lineitem")
    left = F.col("l_partkey") % 2 == 1
    x0 = F.when(left, 50.0).otherwise(320.0) + F.col("l_linenumber") % 3
    y1 = 700.0 - F.col("l_linenumber") * 30 - F.col("l_suppkey") % 7
    return li.select(
        (F.col("l_orderkey") % 500).alias("doc_id"), (F.col("l_orderkey") % 3).cast("int").alias("page_num"), F.concat(F.lit("item "), F.col("l_orderkey").cast("string"), F.lit(" "), F.col("l_linenumber").cast("string")).alias("text"),
        x0.alias("x0"), (y1 - 12).alias("y0"), (x0 + 200).alias("x1"), y1.alias("y1"),
    )


@query
def layout_columns(spark, sf):
    return layout.columns(elements(spark, sf))


@query
def layout_reading_order(spark, sf):
    return layout.reading_order(elements(spark, sf)).select("doc_id", "text", F.col("position").cast("bigint").alias("position"))


@query
def layout_word_lines(spark, sf):
    li = load(spark, sf, "lineitem")
    words = li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), (F.col("l_linenumber") % 2).alias("line_num"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"),
        F.when(F.col("l_linenumber") == 7, "x").otherwise((F.col("l_quantity") - 1).cast("int").cast("string")).alias("conf"), (F.col("l_linenumber") * 40).alias("left"), F.lit(10).alias("top"), F.lit(30).alias("width"), F.lit(12).alias("height"),
    )
    return layout.word_lines(words).select("doc_id", "line_num", "text", "left", "right", "confidence")


@query
def layout_pages_routed(spark, sf):
    """Benchmark of page routing: a document's first line read plainly, its whole text as the scan."""
    d = load(spark, sf, "documents")
    plain = F.substring_index("text", "\n", 1)
    pages = d.select("doc_id", F.lit(1).alias("page_num"), plain.alias("text"), scores.text_quality(plain).alias("score"), F.col("text").alias("scanned"), scores.text_quality(F.col("text")).alias("scanned_score"))
    return layout.route_pages(pages).select("doc_id", F.md5("text").alias("digest"), "confidence")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Samples, majority-vote corrections, their application, accepted and refused groups and mean confidence by field."""
    s = samples(spark, sf)
    groups = s.groupBy("field_name").agg(F.count("*").alias("samples"), F.round(F.avg("confidence_before"), 4).alias("confidence"))
    by = feedback.safe_corrections(s).groupBy("field_name").agg(F.count("*").alias("accepted"))
    return groups.join(by, "field_name", "left").withColumn("rank", F.row_number().over(Window.orderBy(F.col("accepted").desc(), "field_name")))


query(flagship)


def queries() -> dict[str, Query]:
    return _QUERIES | repairs.QUERIES



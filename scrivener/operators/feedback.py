"""Feedback on extracted fields: statistics, error mining, calibration, corrections by vote, and their application.

Samples have sample_id, resume_id, field_name, original_value, corrected_value, confidence_before, feedback_type, status,
ts, and seq where events of one time must be told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp
from ..functions.text import lookup_key
from ..sources.tables import CORRECTION_SCHEMA, FEEDBACK_SCHEMA

STATUSES, TYPES = ("approved", "pending", "rejected"), ("correction", "confirmation", "rejection")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """The correction log; blank and malformed lines are passed over, a missing status is approved, a missing type a correction."""
    rows = spark.read.schema(CORRECTION_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    tidy = lambda c, default: F.lower(F.trim(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))))
    rows = rows.withColumns({"status": tidy("status", "approved"), "feedback_type": tidy("feedback_type", "correction"), "field_name": tidy("field_name", "unknown")})
    return rows.withColumns({"ts": F.col("timestamp"), "seq": F.col("sample_id")})


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """A folder of one-record files; empty and broken ones are passed over."""
    return spark.read.schema(FEEDBACK_SCHEMA).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def keyed(samples: DataFrame) -> DataFrame:
    """Samples with lookup keys, the clamped confidence and whether the value changed."""
    return samples.withColumns(
        {"original_norm": lookup_key(F.col("original_value")), "corrected_norm": lookup_key(F.col("corrected_value")), "before": clamp(F.col("confidence_before"))}
    ).withColumn("changed", (F.col("corrected_norm") != "") & (F.col("corrected_norm") != F.col("original_norm")))


def filtered(samples: DataFrame, field_name: str | None = None, status: str | None = None, feedback_type: str | None = None, only_changed: bool = False) -> DataFrame:
    """Up to four conditions, all of which must hold; without a Python function they reach the source."""
    for c, v in (("field_name", field_name), ("status", status), ("feedback_type", feedback_type)):
        samples = samples.filter(F.col(c) == v) if v is not None else samples
    return keyed(samples).filter("changed").select(samples.columns) if only_changed else samples


def count_samples(samples: DataFrame, status: str | None = None) -> int:
    """How many samples there are, or of one status."""
    return filtered(samples, status=status).count()


def of_resume(feedback: DataFrame, resume_id: int) -> DataFrame:
    """One document's feedback, newest first."""
    return feedback.filter(F.col("resume_id") == resume_id).orderBy(F.col("timestamp").desc_nulls_last())


def of_field(feedback: DataFrame, field_name: str) -> DataFrame:
    """One field's feedback, newest first."""
    return feedback.filter(F.col("field_name") == field_name).orderBy(F.col("timestamp").desc_nulls_last())


def statistics(samples: DataFrame) -> DataFrame:
    """field_name, feedback_type, total, approved, pending, rejected, changed: by field, by type, and over all (nulls)."""
    k = keyed(samples)
    count = lambda test: F.count(F.when(test, 1))
    aggregates = [F.count("*").alias("total"), *[count(F.col("status") == s).alias(s) for s in STATUSES], count(F.col("changed")).alias("changed")]
    sets = k.groupingSets([["field_name"], ["feedback_type"], []], "field_name", "feedback_type").agg(*aggregates)
    return sets.select("field_name", "feedback_type", "total", *STATUSES, "changed")


def collector_statistics(feedback: DataFrame) -> DataFrame:
    """field_name (null: all), total, one count for each known type, processed, unprocessed; fields by their exact name."""
    count = lambda test: F.count(F.when(test, 1))
    done = F.coalesce("processed", F.lit(False))
    aggregates = [F.count("*").alias("total"), *[count(F.col("feedback_type") == t).alias(f"{t}s") for t in TYPES], count(done).alias("processed"), count(~done).alias("unprocessed")]
    return feedback.rollup("field_name").agg(*aggregates)


def errors_by_field(samples: DataFrame, low: float = 0.65) -> DataFrame:
    """Of approved samples by field: counts, error rate, mean confidence, the same where confidence is low, severity."""
    k = keyed(samples.filter(F.col("status") == "approved"))
    count = lambda test: F.count(F.when(test, 1))
    weak = F.col("before") < low
    by = k.groupBy("field_name").agg(
        F.count("*").alias("total_samples"), count(F.col("changed")).alias("changed_samples"), F.round(F.avg("before"), 4).alias("avg_confidence_before"),
        count(weak).alias("low_confidence_samples"), count(weak & F.col("changed")).alias("_weak_changed"),
    )
    by = by.withColumn("error_rate", F.round(F.col("changed_samples") / F.col("total_samples"), 4))
    by = by.withColumn("low_confidence_error_rate", F.coalesce(F.round(F.try_divide("_weak_changed", "low_confidence_samples"), 4), F.lit(0.0)))
    severity = (F.col("error_rate") * 0.6 + F.col("low_confidence_error_rate") * 0.4) * F.greatest(F.lit(1.0), F.col("total_samples") / 5.0)
    return by.withColumn("severity", F.round(severity, 6)).drop("_weak_changed")


def common_mistakes(samples: DataFrame, top: int = 10) -> DataFrame:
    """field_name, rank, original_norm, corrected, count, avg_confidence_before: the most frequent changes of each field."""
    k = keyed(samples.filter(F.col("status") == "approved")).filter("changed")
    pairs = k.groupBy("field_name", "original_norm", F.trim("corrected_value").alias("corrected")).agg(
        F.count("*").alias("count"), F.round(F.avg("before"), 4).alias("avg_confidence_before"), F.min(F.struct("ts", "seq")).alias("_first")
    )
    order = Window.partitionBy("field_name").orderBy(F.col("count").desc(), "avg_confidence_before", "_first")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).drop("_first")


def problem_fields(samples: DataFrame, top: int = 5) -> DataFrame:
    return errors_by_field(samples).orderBy(F.col("severity").desc(), "field_name").limit(top).select("field_name", "severity")


def bin_of(confidence: Column) -> Column:
    """0 to 4 by comparison: dividing by 0.2 would put edges into other bins."""
    return F.when(confidence < 0.2, 0).when(confidence < 0.4, 1).when(confidence < 0.6, 2).when(confidence < 0.8, 3).otherwise(4)


def calibration_profile(samples: DataFrame) -> DataFrame:
    """field_name, bin, total, changed, correctness of approved samples."""
    k = keyed(samples.filter(F.col("status") == "approved"))
    by = k.groupBy("field_name", bin_of(F.col("before")).alias("bin")).agg(F.count("*").alias("total"), F.count(F.when(F.col("changed"), 1)).alias("changed"))
    return by.withColumn("correctness", F.round(1.0 - F.col("changed") / F.col("total"), 4))


def calibrate(rows: DataFrame, profile: DataFrame, field_col: str = "field_name", confidence_col: str = "confidence") -> DataFrame:
    """With ``calibrated``: 0.55 of the confidence and 0.45 of the correctness of its bin; 1.0, and what has no bin, stay."""
    raw = clamp(F.col(confidence_col))
    p = profile.select(F.col("field_name").alias("_f"), F.col("bin").alias("_b"), "correctness")
    joined = rows.join(p, (F.col(field_col) == F.col("_f")) & (bin_of(raw) == F.col("_b")) & (raw < 1), "left")
    blended = F.round(F.least(F.greatest(raw * 0.55 + F.col("correctness") * 0.45, F.lit(0.0)), F.lit(1.0)), 4)
    # greatest passes over nulls, so what has no bin is told apart first
    return joined.withColumn("calibrated", F.when(F.col("correctness").isNull(), raw).otherwise(blended)).drop("_f", "_b", "correctness")


def safe_corrections(samples: DataFrame, min_support: int = 2, min_share: float = 0.6, min_margin: int = 1) -> DataFrame:
    """field_name, original_norm, corrected_norm, corrected, count: what approved samples agree to replace a value by.

    An approved rejection or an empty correction rules its whole group out. One candidate alone wins; several need
    support, share and margin. Ties go to the one seen first; the spelling is the latest of the winner.
    """
    k = keyed(samples.filter(F.col("status") == "approved")).filter("original_norm <> ''")
    deletes = (F.col("feedback_type") == "rejection") | ((F.col("feedback_type") == "correction") & (F.col("corrected_norm") == ""))
    at = F.struct("ts", "seq")
    # one aggregation by candidate carries the group's verdict, so the samples are shuffled once
    vote = F.when((F.col("feedback_type") == "correction") & F.col("changed"), F.col("corrected_norm"))
    votes = k.groupBy("field_name", "original_norm", vote.alias("corrected_norm")).agg(
        F.count("*").alias("count"), F.min(at).alias("_first"), F.max_by(F.trim("corrected_value"), at).alias("corrected"), F.max(deletes).alias("_dead")
    )
    group = Window.partitionBy("field_name", "original_norm")
    real = F.col("corrected_norm").isNotNull()
    ranked = votes.withColumn("_dead", F.max("_dead").over(group)).filter(real & ~F.col("_dead"))
    order = group.orderBy(F.col("count").desc(), "_first")
    ranked = ranked.withColumns(
        {"_rank": F.row_number().over(order), "_second": F.lead("count", 1, 0).over(order), "_all": F.sum("count").over(group), "_n": F.count("*").over(group)}
    )
    agreed = (F.col("count") >= max(1, min_support)) & (F.col("count") / F.col("_all") >= min_share) & (F.col("count") - F.col("_second") >= min_margin)
    return ranked.filter((F.col("_rank") == 1) & ((F.col("_n") == 1) | agreed)).select("field_name", "original_norm", "corrected_norm", "corrected", "count")


def apply_corrections(values: DataFrame, corrections: DataFrame, profile: DataFrame, field_col: str = "field_name", value_col: str = "value", confidence_col: str = "confidence") -> DataFrame:
    """With ``new_value``, ``corrected`` (whether it differs) and ``new_confidence``; empty values stay as they are.

    Whether the corrections are broadcast is left to their measured size.
    """
    v = values.withColumn("_key", lookup_key(F.col(value_col)))
    c = corrections.select(F.col("field_name").alias("_field"), F.col("original_norm").alias("_norm"), F.col("corrected").alias("_new"))
    c = c.filter(lookup_key(F.col("_new")) != F.col("_norm"))
    joined = v.join(c, (F.col(field_col) == F.col("_field")) & (F.col("_key") == F.col("_norm")), "left")
    empty = F.col("_key") == ""
    joined = joined.withColumn("new_value", F.when(empty, F.col(value_col)).otherwise(F.coalesce("_new", value_col)))
    joined = joined.withColumn("corrected", ~empty & F.col("_new").isNotNull())
    joined = joined.withColumn("_score", F.when(F.col("corrected"), F.greatest(F.col(confidence_col), F.lit(0.98))).otherwise(F.col(confidence_col)))
    scored = calibrate(joined, profile, field_col, "_score")
    return scored.withColumn("new_confidence", F.when(empty, F.col(confidence_col)).otherwise(F.col("calibrated"))).drop("_key", "_field", "_norm", "_new", "_score", "calibrated")


BACKFILL_KEY = ("resume_id", "field_name", "original_value", "corrected_value", "feedback_type")


def backfill(feedback: DataFrame, store: DataFrame, key: tuple[str, ...] = BACKFILL_KEY) -> DataFrame:
    """Feedback whose key the store lacks, each key once (the first by time)."""
    first = Window.partitionBy(*key).orderBy("ts", "seq")
    new = feedback.join(store.select(*key).distinct(), list(key), "left_anti")
    return new.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth").select(feedback.columns)


def export(samples: DataFrame, field_name: str | None = None, types: tuple[str, ...] = ("correction", "rejection")) -> DataFrame:
    """Training rows of the types asked for; confirmations are never exported."""
    rows = samples.filter(F.col("feedback_type").isin(*types) & (F.col("feedback_type") != "confirmation"))
    rows = rows.filter(F.col("field_name") == field_name) if field_name else rows
    label = F.when(F.col("feedback_type") == "correction", F.col("corrected_value")).otherwise(F.lit(None))
    return rows.select("sample_id", "field_name", F.col("original_value").alias("input"), label.alias("expected"), "feedback_type")


def new_sample(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows ready to append: id from time and content, confidence_after 1 where the value changed, else the one before."""
    now = F.current_timestamp() if now is None else now
    key = F.concat_ws("|", "resume_id", "field_name", "original_value", "corrected_value", now.cast("string"))
    ident = F.concat(F.lit("cs_"), F.date_format(now, "yyyyMMddHHmmss"), F.lit("_"), F.substring(F.md5(key), 1, 8))
    k = keyed(rows)
    after = F.when(F.col("changed"), 1.0).otherwise(F.col("before"))
    return k.withColumns({"sample_id": ident, "confidence_after": after, "timestamp": now.cast("string")}).drop("original_norm", "corrected_norm", "before", "changed")


def append_samples(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def set_status(samples: DataFrame, ids: DataFrame, status: str, now: Column | None = None) -> DataFrame:
    """The snapshot with a new status where sample_id, feedback_id or correction_id is among ``ids`` (column id)."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {', '.join(STATUSES)}")
    names = [F.col("sample_id").cast("string")] + [F.col(f"extraction_context.{c}") for c in ("feedback_id", "correction_id") if "extraction_context" in samples.columns]
    rows = samples.withColumn("_row", F.col("sample_id").cast("string"))
    hit = rows.select("_row", F.explode(F.array(*names)).alias("id")).join(ids.select(F.col("id").cast("string").alias("id")), "id").select("_row").distinct()
    marked = rows.join(hit.withColumn("_hit", F.lit(True)), "_row", "left").drop("_row")
    out = marked.withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status")))
    if "updated_at" in samples.columns:
        stamp = (F.current_timestamp() if now is None else now).cast("string")
        out = out.withColumn("updated_at", F.when(F.col("_hit"), stamp).otherwise(F.col("updated_at")))
    return out.select(samples.columns)


def pending(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("status") == "pending")


def mark_processed(feedback: DataFrame, condition: Column) -> DataFrame:
    return feedback.withColumn("processed", F.when(condition, True).otherwise(F.col("processed")))

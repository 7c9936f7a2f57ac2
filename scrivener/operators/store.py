"""Stored documents, model versions and training examples: reads, and writes as new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import preview

# documents ------------------------------------------------------------------


def search(docs: DataFrame, query: str, columns: tuple[str, ...] = ("filename", "extracted_text")) -> DataFrame:
    """Rows of which a column contains the query, whatever its case; % and _ in it stand for any characters, as in LIKE."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return docs.filter(test)


def newest_first(docs: DataFrame, at: str = "created_at", ident: str = "id") -> DataFrame:
    return docs.orderBy(F.col(at).desc(), F.col(ident).desc())


def by_id(docs: DataFrame, value, ident: str = "id") -> DataFrame:
    return docs.filter(F.col(ident) == value)


def latest(docs: DataFrame, key: str, at: str, ident: str) -> DataFrame:
    """The newest row of each key, ties to the larger id: one aggregation, no sort."""
    row = F.max_by(F.struct(*docs.columns), F.struct(at, ident))
    return docs.groupBy(key).agg(row.alias("_row")).select("_row.*")


def insert(docs: DataFrame, new: DataFrame) -> DataFrame:
    return docs.unionByName(new, allowMissingColumns=True)


def update(docs: DataFrame, changes: DataFrame, ident: str = "id", now: Column | None = None) -> DataFrame:
    """The snapshot with the columns of ``changes`` where they are not null; None keeps."""
    others = [c for c in changes.columns if c != ident]
    c = changes.select(F.col(ident).alias("_id"), *[F.col(x).alias(f"_new_{x}") for x in others])
    joined = docs.join(c, F.col(ident) == F.col("_id"), "left")
    values = {x: F.coalesce(f"_new_{x}", x) for x in others}
    if "updated_at" in docs.columns:
        values["updated_at"] = F.when(F.col("_id").isNotNull(), F.current_timestamp() if now is None else now).otherwise(F.col("updated_at"))
    return joined.withColumns(values).select(docs.columns)


def delete(docs: DataFrame, ids: DataFrame, ident: str = "id") -> DataFrame:
    return docs.join(ids.select(ident), ident, "left_anti").select(docs.columns)


def without_file(docs: DataFrame, listing: DataFrame, column: str = "filename") -> DataFrame:
    """Rows whose file is not in the listing (orphans); deleting them is an anti join of the other side."""
    return docs.join(listing.select(F.col(column).alias("_there")).distinct(), F.col(column) == F.col("_there"), "left_anti")


def delete_newest(docs: DataFrame, filename: str, at: str = "created_at", ident: str = "id") -> DataFrame:
    """The snapshot without the newest row of a file name."""
    gone = docs.filter(F.col("filename") == filename).agg(F.max_by(ident, F.struct(at, ident)).alias(ident))
    return delete(docs, gone, ident)


def summaries(docs: DataFrame) -> DataFrame:
    """Listing rows: the text cut for preview, and whether there is a layout."""
    has = F.coalesce(F.col("layout_html") != "", F.lit(False))
    return docs.select("id", "filename", "structured_data", preview(F.col("extracted_text")).alias("extracted_text"), has.alias("has_layout_html"), "created_at", "updated_at")


# model versions ---------------------------------------------------------------


def register(versions: DataFrame, new: DataFrame) -> DataFrame:
    """New versions come in as staged."""
    return insert(versions, new.withColumn("status", F.lit("staged")))


def deploy(versions: DataFrame, model: str, version: str) -> DataFrame:
    """The version becomes active and the one before archived (the reference loses the second by writing a stale list).

    A version that does not exist changes nothing. Versions are few: whether it exists is asked first.
    """
    here = F.col("model_name") == model
    if versions.filter(here & (F.col("version_id") == version)).isEmpty():
        return versions
    status = F.when(here & (F.col("version_id") == version), "active").when(here & (F.col("status") == "active"), "archived").otherwise(F.col("status"))
    return versions.withColumn("status", status)


rollback = deploy


def archive(versions: DataFrame, model: str, version: str) -> DataFrame:
    return versions.withColumn("status", F.when((F.col("model_name") == model) & (F.col("version_id") == version), "archived").otherwise(F.col("status")))


def delete_version(versions: DataFrame, model: str, version: str) -> DataFrame:
    """Only staged versions go."""
    return versions.filter(~((F.col("model_name") == model) & (F.col("version_id") == version) & (F.col("status") == "staged")))


def models(versions: DataFrame) -> DataFrame:
    """model_name, n_versions, latest_version, active_version: last by creation."""
    at = F.struct("created_at", "version_id")
    return versions.groupBy("model_name").agg(
        F.count("*").alias("n_versions"), F.max_by("version_id", at).alias("latest_version"),
        F.max_by(F.when(F.col("status") == "active", F.col("version_id")), F.when(F.col("status") == "active", at)).alias("active_version"),
    )


def compare_versions(versions: DataFrame, model: str, a: str, b: str) -> DataFrame:
    """metric, value_a, value_b, difference of the metrics that either has."""
    long = versions.filter(F.col("model_name") == model).select("version_id", F.explode("metrics").alias("metric", "value"))
    side = lambda v, n: long.filter(F.col("version_id") == v).select("metric", F.col("value").alias(n))
    return side(a, "value_a").join(side(b, "value_b"), "metric", "full").withColumn("difference", F.col("value_b") - F.col("value_a"))


# training examples --------------------------------------------------------------


def examples(feedback: DataFrame, corrections: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """field_name, text, label, source, verified from the sources of training data."""
    take = lambda df, source, ok: df.select("field_name", F.col("original_value").alias("text"), F.col("corrected_value").alias("label"), F.lit(source).alias("source"), F.lit(ok).alias("verified"))
    out = take(feedback, "feedback", False).unionByName(take(corrections, "correction", True))
    return out.unionByName(manual.select("field_name", "text", "label", F.lit("manual").alias("source"), F.lit(True).alias("verified"))) if manual is not None else out


def dataset_statistics(rows: DataFrame) -> DataFrame:
    """field_name, source, verified, total over each alone and over all (nulls)."""
    return rows.groupingSets([["field_name"], ["source"], ["verified"], []], "field_name", "source", "verified").agg(F.count("*").alias("total")).select("field_name", "source", "verified", "total")


#: Leading hexadecimal digits of the hash by which rows are dealt into cells before they are numbered.
CELL_DIGITS = 3


def split(rows: DataFrame, ident: str = "sample_id", train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """With ``part``: train, validation or test, of exact sizes; the order is that of the md5 of the id, the rest is test.

    Rows are numbered without a global sort: counts of the cells of the hash give each cell its offset, and rows are
    numbered inside their cell.
    """
    if train < 0 or validation < 0 or train + validation > 1 + 1e-3:
        raise ValueError("shares must be positive and at most 1 together")
    keyed = rows.withColumn("_h", F.md5(F.col(ident).cast("string"))).withColumn("_cell", F.substring("_h", 1, CELL_DIGITS))
    cells = keyed.groupBy("_cell").agg(F.count("*").alias("_n"))
    running = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # 16^CELL_DIGITS rows at most
    cells = cells.withColumns({"_before": F.coalesce(F.sum("_n").over(running), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy())})
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy("_h", ident))
    placed = keyed.withColumn("_inside", inside).join(cells, "_cell").withColumn("_rank", F.col("_before") + F.col("_inside"))
    a, b = F.floor(F.col("_all") * train), F.floor(F.col("_all") * validation)
    part = F.when(F.col("_rank") <= a, "train").when(F.col("_rank") <= a + b, "validation").otherwise("test")
    return placed.withColumn("part", part).select(*rows.columns, "part")


def augment(rows: DataFrame, factor: int = 2, seed: int = 1) -> DataFrame:
    """Each example and ``factor`` - 1 variations of its text: case, spacing or punctuation, chosen by a hash."""
    t = F.col("text")
    changes = F.array(F.lower(t), F.upper(t), F.initcap(t), F.regexp_replace(t, r"[,;]", " "), F.regexp_replace(t, r"\s+", "  "))
    copies = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(max(0, factor - 1)))))
    pick = F.pmod(F.xxhash64(t, F.lit(seed), F.col("_k")), F.size(changes)).cast("int")
    return copies.withColumn("text", F.when(F.col("_k") == 0, t).otherwise(F.get(changes, pick))).withColumn("augmented", F.col("_k") > 0).drop("_k")


def to_classifier_lines(rows: DataFrame) -> DataFrame:
    """One JSON line for each example: the text and the category it belongs to."""
    cats = F.create_map(F.col("field_name"), F.lit(1.0))
    return rows.select(F.to_json(F.array(F.col("text"), F.to_json(F.struct(cats.alias("cats"))))).alias("value"))


def add_manual(rows: DataFrame, path: str) -> None:
    """Append examples (field_name, text, label) as JSON files, one folder a field; they count as verified."""
    out = rows.select("text", "label", F.lit("manual").alias("source"), F.lit(True).alias("verified"), F.current_timestamp().cast("string").alias("added_at"), "field_name")
    out.write.mode("append").partitionBy("field_name").json(path)


def read_manual(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text string, label string, source string, verified boolean, added_at string, field_name string").json(path)


# reports ------------------------------------------------------------------------


def save_report(report: DataFrame, path: str) -> None:
    """One JSON document of a report's rows, in place of the one before."""
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def load_report(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The report's rows, with the columns of ``like``; lines that are no JSON are passed over."""
    read = spark.read.text(path).select(F.from_json("value", like.schema, {"mode": "PERMISSIVE"}).alias("r")).filter("r is not null")
    return read.select("r.*")


def timings(runs: DataFrame) -> DataFrame:
    """name, count, total, avg, min, max of recorded durations (name, seconds)."""
    s = F.col("seconds")
    return runs.groupBy("name").agg(F.count(s).alias("count"), F.sum(s).alias("total"), F.avg(s).alias("avg"), F.min(s).alias("min"), F.max(s).alias("max"))

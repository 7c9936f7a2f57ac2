"""The correction map by state against one aggregation over all samples, however they are batched."""

import random

from pyspark.sql import functions as F

from scrivener.operators.feedback import safe_corrections
from scrivener.streaming.corrections import current_corrections, keep_corrections

SCHEMA = "sample_id string, field_name string, original_value string, corrected_value string, confidence_before double, feedback_type string, status string, ts string, seq string"


def rows(rng, n, start):
    kinds = ["correction"] * 12 + ["confirmation", "rejection"]
    return [
        (f"s{start + k}", rng.choice(["name", "email"]), rng.choice(["Jon", "jon ", "Ann", "Bo", "", "Cy", "Di"]), rng.choice(["John", "JOHN", "Joan", "Jonn", "jon", "Ann"] + [""] * (rng.random() < 0.05)), 0.5, rng.choice(kinds) if rng.random() < 0.3 else "correction",
         rng.choice(["approved"] * 5 + ["pending"]), rng.choice([None, "2024-01-01", "2024-01-02"]), f"{rng.randint(0, 99):02d}-{start + k}")
        for k in range(n)
    ]


def as_set(df):
    return {tuple(r) for r in df.select("field_name", "original_norm", "corrected_norm", "corrected", "count").collect()}


def test_any_batching_gives_the_map_of_all(spark, tmp_path):
    rng, all_rows = random.Random(3), []
    source = tmp_path / "in"
    for number, n in enumerate((3, 40, 1)):
        new = rows(rng, n, 1000 * number)
        all_rows += new
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        keep_corrections(stream, f"file://{tmp_path}/map", str(tmp_path / "check"), buckets=8).awaitTermination(120)
        want = as_set(safe_corrections(spark.createDataFrame(all_rows, SCHEMA)))
        assert as_set(current_corrections(spark, f"file://{tmp_path}/map")) == want
    assert want


def test_a_batch_rewrites_the_buckets_of_its_groups(spark, tmp_path):
    from scrivener.sources.snapshots import Snapshots

    source, path = tmp_path / "in", f"file://{tmp_path}/map"
    many = [(f"s{k}", "name", f"v{k}", "w", 0.5, "correction", "approved", "2024-01-01", f"{k:03d}") for k in range(100)]
    more = [("t", "name", "v7", "other", 0.5, "correction", "approved", "2024-01-02", "999")]
    folders = []
    for new in (many, more):
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        keep_corrections(spark.readStream.schema(SCHEMA).parquet(str(source)), path, str(tmp_path / "check"), buckets=16).awaitTermination(120)
        folders.append(Snapshots(spark, path).head()[1]["folders"])
    assert sum(folders[0][b] != folders[1][b] for b in folders[0]) == 1
    # one vote against one: v7 has no agreed correction any more
    assert current_corrections(spark, path).filter(F.col("original_norm") == "v7").count() == 0 and current_corrections(spark, path).count() == 99

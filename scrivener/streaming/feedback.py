"""The feedback log as a stream: new files are appended, and small aggregates follow each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.feedback import calibration_profile, safe_corrections, statistics
from ..sources.tables import CORRECTION_SCHEMA


def read_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """New files of the correction log; malformed lines are passed over."""
    return spark.readStream.schema(CORRECTION_SCHEMA).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_a_batch).json(path)


def counts_by_window(stream: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and mean confidence by field and time window; events later than ``late`` are left out."""
    timed = stream.withColumn("at", F.to_timestamp("timestamp")).withWatermark("at", late)
    by = timed.groupBy(F.window("at", width), "field_name").agg(F.count("*").alias("total"), F.round(F.avg("confidence_before"), 4).alias("avg_confidence"))
    return by.select(F.col("window.start").alias("start"), "field_name", "total", "avg_confidence")


def distinct_feedback(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each sample_id once within the watermark."""
    return stream.withColumn("at", F.to_timestamp("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["sample_id"])


def keep_current(stream: DataFrame, store: str, reports: str, checkpoint: str) -> StreamingQuery:
    """Append each batch to the store and write statistics, corrections and the calibration profile anew.

    A batch that is run again writes the same folder of the store, so it is not stored twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        rows = spark.read.parquet(store).drop("batch").withColumns({"ts": F.col("timestamp"), "seq": F.col("sample_id")})
        for name, report in (("statistics", statistics), ("corrections", safe_corrections), ("calibration", calibration_profile)):
            report(rows).write.mode("overwrite").parquet(f"{reports}/{name}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

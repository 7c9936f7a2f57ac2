"""Resampling towards a target distribution by importance weights of hashed n-grams, scored without exploding a document."""

from __future__ import annotations

import functools
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, text_of

#: A word, after lower-casing A-Z: every run of ASCII digits, small letters and code points beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text_col: str = "text") -> Column:
    lowered = F.translate(text_of(text_col), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORDS), F.lit(0))


def _run(found: Column, k: int, i: Column) -> Column:
    return F.concat_ws(" ", *[F.get(found, i + j) for j in range(k)])  # slice() would copy all words


def buckets(found: Column, longest: int, n_buckets: int) -> Column:
    """The bucket of each run of 1 to ``longest`` consecutive words, repeats included: crc32 of its bytes modulo ``n_buckets``."""
    bucket = lambda run: (F.crc32(run.cast("binary")) % n_buckets).cast("int")
    out = F.transform(found, bucket)
    for k in range(2, longest + 1):
        begins = F.when(F.size(found) >= k, F.sequence(F.lit(0), F.size(found) - k)).otherwise(F.array().cast("array<int>"))
        run = functools.partial(_run, found, k)
        out = F.concat(out, F.transform(begins, lambda i: bucket(run(i))))  # noqa: B023  Spark calls it at once
    return out


def totals(rows: DataFrame) -> DataFrame:
    """bucket, n: what is summed in each task before it moves is at most one row for each bucket.

    A plain explode would have Spark test the array's size in a filter of its own, which finds all words once more.
    """
    return rows.select(F.explode_outer("b").alias("bucket")).filter("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(source: DataFrame, target: DataFrame, n_buckets: int, text_col: str = "text", longest: int = 1) -> list[int]:
    """floor(1000 ln of target share over source share), one for each bucket, of counts smoothed by one.

    The list's length is the parameter ``n_buckets``, whatever the tables hold.
    """
    # the words are a column of their own, or each run would find them again
    one = lambda docs, name: totals(docs.select(words(text_col).alias("w")).select(buckets(F.col("w"), longest, n_buckets).alias("b"))).withColumnRenamed("n", name)
    both = source.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket")).join(one(source, "s"), "bucket", "left").join(one(target, "t"), "bucket", "left").na.fill(0)
    everything = Window.partitionBy()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    s_all, t_all = F.sum("s").over(everything).cast("double"), F.sum("t").over(everything).cast("double")
    gain = F.floor(1000 * F.log((t + 1) * (s_all + n_buckets) / ((s + 1) * (t_all + n_buckets))))
    return [r.gain for r in both.select("bucket", gain.alias("gain")).orderBy("bucket").collect()]


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, n_buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each input row: doc_id, n_features, weight, score, rank (null unless drawn).

    Gumbel noise on the weight draws without replacement: of the N documents with at least ``least_words`` words those of the
    floor(percent * N / 100) highest scores. Ties go to the smaller id, null last, then to fewer features, then to the smaller
    weight. Null text has no words; a null id is drawn by the text ``null``; repeated rows are documents of their own. Empty
    tables give an empty result; an empty target gives flat shares. Ranks are numbers within ranges of the order, after those
    of the ranges before, so no task sorts all documents.
    """
    with scratch(docs.sparkSession):
        table = ",".join(map(str, gains(docs, target, n_buckets, text_col, longest)))
        literal = F.split(F.lit(table), ",").cast("array<bigint>")  # folded to one literal when planned
        rows = docs.select(F.col(id_col).alias("doc_id"), words(text_col).alias("w"))
        rows = rows.select("doc_id", F.size("w").alias("n_words"), buckets(F.col("w"), longest, n_buckets).alias("b"))
        total = F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + F.element_at(literal, x + 1))
        rows = rows.select("doc_id", "n_words", F.size("b").cast("long").alias("n_features"), total.alias("total"))
        floored = F.expr("(total - pmod(total, n_features)) div n_features")
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
        noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
        rows = rows.withColumn("weight", F.when(F.col("n_features") > 0, floored).otherwise(0).cast("long")).withColumn("score", F.col("weight") + noise)
        rows = materialize(rows.select("doc_id", "n_words", "n_features", "weight", "score", F.monotonically_increasing_id().alias("row")), "resample-rows")
        able = rows.filter(F.col("n_words") >= least_words)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc(), F.col("row").asc()]
        ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = materialize(able.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "resample-ranges")
        parts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("part"))  # one row for each range
        begins = parts.select(F.col("range").alias("r"), (F.sum("part").over(Window.orderBy("range")) - F.col("part")).alias("begin"), F.sum("part").over(Window.partitionBy()).alias("able"))
        place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("begin")
        ranked = ranged.join(begins, F.col("range") == F.col("r")).withColumn("place", place)
        drawn = F.when(F.col("place") <= F.expr(f"({percent} * able) div 100"), F.col("place").cast("long"))
        columns = ["doc_id", "n_features", "weight", "score"]
        rest = rows.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
        return materialize(ranked.select(*columns, drawn.alias("rank")).unionByName(rest), "resample", keep=True)

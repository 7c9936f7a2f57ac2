"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is a count of words. Whole epochs of the source come first; what is left of the target is filled by a
weighted sample without replacement: every document draws the key -ln(u) / weight, keys are sorted within the source and
documents are taken while the prefix sum of their sizes stays within what is left. The sort is by ranges of (source, key,
row): a hot source spans many ranges, and prefix sums are those of the ranges before plus those inside the range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, scratch, text_of


def default_weight(text_col: str = "text") -> Column:
    """Document quality weight: 1 for text without symbol characters, falling with their share, never under 0.05."""
    t = text_of(text_col)
    symbols = F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.05), 1 - 10.0 * symbols / F.greatest(F.length(t), F.lit(1)))


def uniform(id_col: str, seed: int) -> Column:
    """In (0, 1], the same at every run: 52 bits of the md5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, source_size, target of each row of ``sizes`` (source, source_size); sources by code point, null last.

    The weights repeat along the sources. Together the targets are ``share`` times all sizes; none is over ``cap`` times
    its source: the excess is reshared by weight, which is water filling and is solved by one sort over the sources.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    everything, by_name, by_ratio = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "nth")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("nth", F.row_number().over(by_name) - 1).withColumn("w", F.element_at(w, (F.col("nth") % len(weights)).cast("int") + 1))
    level = (
        ranked.withColumns({"cap": F.col("source_size") * float(cap), "ratio": F.col("source_size") * float(cap) / F.col("w")})
        .withColumns({"all_w": F.sum("w").over(everything), "all_size": F.sum("source_size").over(everything)})
        .withColumns({"w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0)), "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0))})
        .withColumn("level", (F.col("all_size") * float(share) - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
        .withColumn("free", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "nth", "level"))).over(everything)["level"])
    )
    target = F.coalesce(F.least("cap", F.col("free") * F.col("w")), F.col("cap"))
    return level.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weight: Column | None = None,
) -> DataFrame:
    """One row for each input row: doc_id, size, source, source_size, target, taken (words, repeats counted), times.

    taken is size times (whole epochs + 1 if sampled): the document at which the budget ends is taken if that brings the
    source nearer to its target. Null text: size 0. A null source is a source. Ties of keys go by id, then size; repeated rows
    are documents of their own, rows without an id share one key. An empty table gives an empty result. Documents of size 0
    take nothing.
    """
    size = F.size(F.regexp_extract_all(text_of(text_col), F.lit(WORD), F.lit(0))).cast("long")
    # u near 1 gives the smallest keys, so heavy documents come early
    key = -F.log(uniform(id_col, seed)) / (default_weight(text_col) if weight is None else weight)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "mix-rows")
    # no two rows are equal, so ranges are even whatever the sources, weights and repeated ids are
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "doc_id", "size", "row"]
    ranged = materialize(rows.repartitionByRange(ranges, "source", *order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    parts = materialize(ranged.groupBy("source", "range").agg(F.sum("size").alias("part")), "mix-parts")
    plan = targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = materialize(plan.withColumnRenamed("source", "p_source"), "mix-plan")
    earlier = F.sum("part").over(Window.partitionBy("source").orderBy("range")) - F.col("part")  # at most so many rows a source as there are ranges
    begins = parts.withColumn("begin", earlier).join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    begins = materialize(begins.select(F.col("source").alias("b_source"), F.col("range").alias("b_range"), "begin", "source_size", "target", "epochs", "rest"), "mix-begins")
    known = ranged.join(begins, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("range") == F.col("b_range")))
    inside = F.sum("size").over(Window.partitionBy("range", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    times = F.col("epochs") + (2 * (F.col("begin") + inside) + F.col("size") <= 2 * F.col("rest")).cast("long")
    found = known.withColumn("times", times)
    return found.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents as the mix holds them: each row as many times as it is taken, with all its columns.

    Ids should be unique; rows that repeat an id all come as often as the one taken most.
    """
    with scratch(docs.sparkSession):
        plan = mix(docs, id_col=id_col, **options).groupBy(F.col("doc_id").alias("_id")).agg(F.max("times").alias("_times")).filter("_times > 0")
        plan = materialize(plan, "mix-times", keep=True)
    # the row as one struct, so that its columns may have any names
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[id_col].alias("_key"))
    # the same plan at every size: the times grow with the documents and are never broadcast
    taken = rows.join(plan.hint("merge"), F.col("_key").eqNullSafe(F.col("_id"))).select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return taken.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])

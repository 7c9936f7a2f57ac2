"""Reading page files by a ladder of readers: each costlier one sees only what the cheaper ones left open.

A reader takes a DataFrame of documents and gives doc_id, text and, where it knows, confidence and two_columns. Between
rungs the state is a table, so no reader runs twice on a document, however the result is used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import text_quality
from ..functions.text import strip, text_or_empty
from .shared import cut

Reader = Callable[[DataFrame], DataFrame]
#: What a text needs to count, to end the ladder at once, and for a routed or scanned one to be taken.
SHORT, SURE, LONG, ROUTED, SCANNED, BETTER, TWO_COLUMNS = 50, 0.7, 180, 0.3, 0.8, 0.04, 0.35


def by_document(read: Callable[[dict], str | tuple[str, float] | None], columns: tuple[str, ...]) -> Reader:
    """A reader from a Python function on one document's columns, run in Arrow batches; what it fails on has no text."""

    def reader(docs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, scores = [], []
                for row in b.select(list(columns)).to_pylist():
                    try:
                        got = read(row)
                    except Exception:  # a reader that breaks on a document leaves it to the next
                        got = None
                    text, score = got if isinstance(got, tuple) else (got, None)
                    texts.append(text)
                    scores.append(score)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "text", "confidence"])

        kind = dict(docs.dtypes)["doc_id"]
        return docs.select("doc_id", *[c for c in columns if c != "doc_id"]).mapInArrow(run, f"doc_id {kind}, text string, confidence double")

    return reader


def _long_enough(text: Column, least: int = SHORT) -> Column:
    return F.length(strip(text_or_empty(text))) > least


def _of(docs: DataFrame, reader: Reader, tag: str) -> DataFrame:
    """The reader's rows under names of their own; missing columns are null."""
    got = reader(docs)
    col = lambda c, kind: (F.col(c) if c in got.columns else F.lit(None)).cast(kind).alias(f"{tag}_{c}")
    return got.select(F.col("doc_id").alias("_id"), col("text", "string"), col("confidence", "double"), col("two_columns", "boolean"))


def read_ladder(docs: DataFrame, plain: Reader, columns: Reader | None = None, routed: Reader | None = None, scanned: Reader | None = None) -> DataFrame:
    """doc_id, text, confidence, step of each document: ``docs`` has distinct doc_ids and whatever the readers need.

    The plain text, or the column-aware one if it is surer or tells two columns, ends the ladder if it is long and sure.
    Else the pages are read one by one, each in the way that suits it, which is taken if it is as sure as the text so far;
    else all is read as an image. What no rung settles keeps the plain text. Documents that a reader gives no row for have an
    empty text there.
    """
    state = docs.select("doc_id").join(_of(docs, plain, "p"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    text, score = text_or_empty(F.col("p_text")), F.lit(0.0)
    if columns is not None:
        state = state.join(_of(docs, columns, "c"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
        sure = F.coalesce(F.col("c_confidence"), F.lit(0.0))
        takes = (text_or_empty(F.col("c_text")) != "") & ((sure >= BETTER) | (F.coalesce(F.col("c_two_columns"), F.lit(False)) & (sure >= TWO_COLUMNS)))
        text, score = F.when(takes, F.col("c_text")).otherwise(text), F.when(takes, sure).otherwise(0.0)
    state = state.select("doc_id", text.alias("text"), score.alias("confidence"))
    rated = F.when(_long_enough(F.col("text")) & (F.col("confidence") <= 0), text_quality(F.col("text"))).otherwise(F.col("confidence"))
    state = state.withColumn("confidence", rated)
    done = (F.col("confidence") >= SURE) & (F.length(strip(F.col("text"))) >= LONG)
    state = cut(state.withColumn("step", F.when(done, "text")), "ladder-text")
    if routed is not None:
        state = _rung(docs, state, routed, "routed", F.greatest(F.col("confidence"), F.lit(ROUTED)), None)
    if scanned is not None:
        state = _rung(docs, state, scanned, "scanned", None, SCANNED)
    left = F.col("step").isNull()
    return state.select("doc_id", "text", F.when(left, text_quality(F.col("text"))).otherwise(F.col("confidence")).alias("confidence"), F.coalesce("step", F.lit("left")).alias("step"))


def _rung(docs: DataFrame, state: DataFrame, reader: Reader, step: str, least: Column | None, worth: float | None) -> DataFrame:
    """``state`` after the reader has seen what is open: its text is taken if it is long and, with ``least``, sure enough.

    ``worth``: the confidence is the text's quality times it, as the reader's own counts for nothing.
    """
    open_ids = cut(state.filter("step is null").select("doc_id"), f"ladder-open-{step}")
    seen = _of(docs.join(open_ids, "doc_id", "left_semi"), reader, "r")
    score = F.coalesce(F.col("r_confidence"), F.lit(0.0)) if worth is None else text_quality(F.col("r_text")) * worth
    seen = cut(seen.filter(_long_enough(F.col("r_text"))).select("_id", "r_text", score.alias("r_score")), f"ladder-{step}")
    both = state.join(seen, F.col("doc_id") == F.col("_id"), "left")
    takes = F.col("step").isNull() & F.col("_id").isNotNull() & (F.lit(True) if least is None else F.col("r_score") >= least)
    pick = lambda new, old: F.when(takes, new).otherwise(F.col(old))
    return both.select("doc_id", pick(F.col("r_text"), "text").alias("text"), pick(F.col("r_score"), "confidence").alias("confidence"), F.when(takes, step).otherwise(F.col("step")).alias("step"))

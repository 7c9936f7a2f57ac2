"""The map of safe corrections kept by a stream: state holds the votes of each (field, original value), a batch touches its own.

Votes of a group merge by sums, earliest and latest events, so the map after any batching is that of ``safe_corrections`` over
all samples. The map itself is a persisted store; each batch rewrites the buckets of the groups it has changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.feedback import keyed
from ..sources.snapshots import Snapshots, open_or_create

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = ["field_name", "original_norm"]
#: One row for each group that has samples; without an agreed correction the last three are null.
MAP = "field_name string, original_norm string, corrected_norm string, corrected string, count long"


def _at(ts: str | None, seq: str | None) -> tuple:
    """Events in the order of (ts, seq), nulls first, as structs are ordered."""
    return ts is not None, ts or "", seq is not None, seq or ""


def _given(x):
    return None if x is None or x != x else x


class Votes(StatefulProcessor):
    """State of a group: for each candidate its votes, first and latest event and latest spelling; whether the group is ruled out."""

    def __init__(self, min_support: int = 2, min_share: float = 0.6, min_margin: int = 1) -> None:
        self.support, self.share, self.margin = min_support, min_share, min_margin

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.votes = handle.getMapState("votes", "corrected_norm string", "n long, first_ts string, first_seq string, last_ts string, last_seq string, corrected string")
        self.dead = handle.getValueState("dead", "dead boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {k[0]: tuple(v) for k, v in self.votes.iterator()}
        dead, changed = self.dead.exists() and bool(self.dead.get()[0]), set()
        for batch in rows:
            for r in batch.itertuples(index=False):
                dead = dead or bool(r.deletes)
                if not r.votes:
                    continue
                ts, seq, name = _given(r.ts), _given(r.seq), r.corrected_norm
                n, first_ts, first_seq, last_ts, last_seq, spelt = known.get(name, (0, ts, seq, ts, seq, r.corrected))
                if _at(ts, seq) < _at(first_ts, first_seq):
                    first_ts, first_seq = ts, seq
                if _at(ts, seq) >= _at(last_ts, last_seq):
                    last_ts, last_seq, spelt = ts, seq, r.corrected
                known[name] = (n + 1, first_ts, first_seq, last_ts, last_seq, spelt)
                changed.add(name)
        for name in changed:
            self.votes.updateValue((name,), known[name])
        self.dead.update((dead,))
        won = None if dead else self._winner(known)
        yield pd.DataFrame([(*key, *(won or (None, None, None)))], columns=["field_name", "original_norm", "corrected_norm", "corrected", "count"]).astype({"count": "Int64"})

    def _winner(self, known: dict[str, tuple]) -> tuple[str, str, int] | None:
        """One candidate alone, or the one with support, share and margin; ties go to the one seen first."""
        order = sorted(known.items(), key=lambda x: (-x[1][0], _at(*x[1][1:3])))
        if not order:
            return None
        name, (n, *_, spelt) = order[0]
        second, total = order[1][1][0] if len(order) > 1 else 0, sum(v[0] for v in known.values())
        agreed = n >= max(1, self.support) and n / total >= self.share and n - second >= self.margin
        return (name, spelt, n) if len(order) == 1 or agreed else None

    def close(self) -> None:
        pass


def corrections_by_state(samples: DataFrame, **thresholds) -> DataFrame:
    """The rows of MAP that change with each batch of a stream of samples (columns of the correction log)."""
    if samples.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKS:
        samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    k = keyed(samples.filter(F.col("status") == "approved")).filter("original_norm <> ''")
    correction = F.col("feedback_type") == "correction"
    deletes = F.coalesce((F.col("feedback_type") == "rejection") | (correction & (F.col("corrected_norm") == "")), F.lit(False))
    votes = F.coalesce(correction & F.col("changed"), F.lit(False))
    rows = k.select(*KEY, "corrected_norm", F.trim("corrected_value").alias("corrected"), F.col("ts").cast("string").alias("ts"), F.col("seq").cast("string").alias("seq"), deletes.alias("deletes"), votes.alias("votes"))
    return rows.groupBy(*KEY).transformWithStateInPandas(Votes(**thresholds), MAP, outputMode="Update", timeMode="None")


def keep_corrections(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64, **thresholds) -> StreamingQuery:
    """Follow a stream of samples; the map below ``path`` changes by each batch's groups. A repeated batch is applied once."""

    def apply(batch: DataFrame, number: int) -> None:
        open_or_create(batch, path, KEY, buckets).upsert(batch, applied=str(number))

    rows = corrections_by_state(stream, **thresholds)
    return rows.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_corrections(spark: SparkSession, path: str) -> DataFrame:
    """What ``safe_corrections`` gives for all samples so far: field_name, original_norm, corrected_norm, corrected, count."""
    return Snapshots(spark, path).read().filter("corrected_norm is not null")

"""Metrics of a run, taken while it runs: counts, sums and extremes by name, without a second pass."""

from __future__ import annotations

import threading
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class RunMetrics:
    """What named steps of this session have handled: every execution of a watched DataFrame adds its figures.

    Threads may share one; a figure is added when the execution ends.
    """

    def __init__(self) -> None:
        self._open: list[tuple[str, Observation]] = []
        self._lock = threading.Lock()
        self._seen: dict[str, list[dict]] = {}

    def watch(self, df: DataFrame, name: str, values: Mapping[str, Column] | None = None) -> DataFrame:
        """``df``, observed under ``name``: rows, and count, total, min and max of each of ``values`` where it isn't null.

        The figures are those of the first execution of the DataFrame that is returned.
        """
        observation = Observation()
        sums = [F.count(F.lit(1)).alias("rows")]
        for key, value in (values or {}).items():
            sums += [F.count(value).alias(f"{key}.count"), F.sum(value).alias(f"{key}.total"), F.min(value).alias(f"{key}.min"), F.max(value).alias(f"{key}.max")]
        with self._lock:
            self._open.append((name, observation))
        return df.observe(observation, *sums)

    def _collect(self) -> None:
        with self._lock:
            pending, self._open = self._open, []
            for name, observation in pending:
                self._seen.setdefault(name, []).append(dict(observation.get))

    def stats(self, name: str) -> dict[str, dict[str, float]]:
        """By value: count, total, avg, min, max over all executions under ``name``; rows under ``rows``. Empty if none ran.

        Waits for executions of watched DataFrames, so each must have been started.
        """
        self._collect()
        runs = self._seen.get(name, [])
        if not runs:
            return {}
        rows = [r["rows"] for r in runs]
        out = {"rows": {"count": len(runs), "total": sum(rows), "avg": sum(rows) / len(rows), "min": min(rows), "max": max(rows)}}
        for key in sorted({k.rpartition(".")[0] for r in runs for k in r if "." in k}):
            has = [r for r in runs if r.get(f"{key}.count")]
            if has:
                n, total = sum(r[f"{key}.count"] for r in has), sum(r[f"{key}.total"] for r in has)
                out[key] = {"count": n, "total": total, "avg": total / n, "min": min(r[f"{key}.min"] for r in has), "max": max(r[f"{key}.max"] for r in has)}
        return out

    def all_stats(self) -> dict[str, dict[str, dict[str, float]]]:
        self._collect()
        return {name: self.stats(name) for name in sorted(self._seen)}

    def clear(self) -> None:
        with self._lock:
            self._open, self._seen = [], {}

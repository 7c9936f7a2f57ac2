"""Stores that keep their edits: copy-on-write snapshots by key bucket.

A version is a small file that names, for each bucket, the folder that holds its rows. An edit reads the buckets of its keys
alone, writes them into a new folder and commits by creating the next version's file, which fails if another writer was
first. Folders are never written again, so a reader keeps the version that it began with, and an edit that dies before its
commit has changed nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import store
from .shared import filesystem

Edit = Callable[[DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer committed first; nothing was changed."""


class Snapshots:
    """A table below ``path``, dealt into buckets by ``key`` (one column or more). Null keys make a bucket like any other."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str | list[str], buckets: int = 64) -> Snapshots:
        """Version 0. ``buckets`` bounds the size of a version's file and the share of the table that an edit rewrites."""
        self = cls(rows.sparkSession, path)
        head = {"key": [key] if isinstance(key, str) else list(key), "buckets": buckets, "schema": rows.schema.jsonValue(), "applied": None}
        self._commit(0, head | {"folders": self._write(rows, head)})
        return self

    # reading --------------------------------------------------------------------

    def versions(self) -> list[int]:
        fs, folder = filesystem(self.spark, f"{self.path}/versions")
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def head(self, version: int | None = None) -> tuple[int, dict]:
        if version is None:
            known = self.versions()
            if not known:
                raise FileNotFoundError(f"no version below {self.path}")
            version = known[-1]
        fs, file = filesystem(self.spark, self._file(version))
        stream = fs.open(file)
        try:
            said = bytes(stream.readAllBytes())
        finally:
            stream.close()
        return version, json.loads(said)

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, the newest unless told; of some buckets alone, if they are named."""
        head = self.head(version)[1]
        wanted = [f for b, f in head["folders"].items() if buckets is None or int(b) in buckets]
        schema = T.StructType.fromJson(head["schema"])
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in wanted])

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is among ``keys``: only their buckets are read."""
        version, head = self.head()
        key = head["key"]
        test = [F.col(f"t.{k}").eqNullSafe(F.col(f"k.{k}")) for k in key]
        rows = self.read(version, self._touched(keys, head))
        for t in test[1:]:
            test[0] = test[0] & t
        return rows.alias("t").join(keys.select(*key).distinct().alias("k"), test[0], "left_semi")

    # writing --------------------------------------------------------------------

    def upsert(self, rows: DataFrame, applied: str | None = None) -> int:
        """Rows replace those of their key or come in as new; keys must not repeat within ``rows``."""
        key = self.head()[1]["key"]
        return self.edit(rows, lambda old: _without(old, rows, key).unionByName(rows.select(old.columns)), applied)

    def insert(self, rows: DataFrame, applied: str | None = None) -> int:
        """Rows of new keys; those whose key is known already are left out, so a repeated insert adds nothing."""
        key = self.head()[1]["key"]
        return self.edit(rows, lambda old: old.unionByName(_without(rows, old, key).select(old.columns)), applied)

    def update(self, changes: DataFrame, now: Column | None = None) -> int:
        """Columns of ``changes`` where they are not null, by the one key column."""
        (key,) = self.head()[1]["key"]
        return self.edit(changes, lambda old: store.update(old, changes, key, now))

    def delete(self, keys: DataFrame) -> int:
        key = self.head()[1]["key"]
        return self.edit(keys, lambda old: _without(old, keys, key))

    def edit(self, keys: DataFrame, change: Edit, applied: str | None = None) -> int:
        """Rewrite the buckets of ``keys`` by ``change``, which gets their rows and gives the new ones; the new version's number.

        Keys that move to a bucket that was not read are refused: they could meet rows that ``change`` has not seen.
        ``applied`` names the edit: the one that was applied last is not applied again, as when a stream repeats a batch.
        """
        version, head = self.head()
        if applied is not None and head["applied"] == applied:
            return version
        touched = self._touched(keys, head)
        if not touched:
            return version
        new = change(self.read(version, touched))
        stray = self._write(new, head, touched)
        kept = {b: f for b, f in head["folders"].items() if int(b) not in touched}
        self._commit(version + 1, head | {"folders": kept | stray, "applied": applied if applied is not None else head["applied"]})
        return version + 1

    def vacuum(self, keep: int = 2) -> int:
        """Remove the folders that the last ``keep`` versions don't use, and older versions' files; how many folders went.

        Readers of older versions and unfinished edits lose their files, so this is for quiet hours.
        """
        versions = self.versions()
        used = {f for v in versions[-keep:] for f in self.head(v)[1]["folders"].values()}
        for v in versions[:-keep]:
            fs, file = filesystem(self.spark, self._file(v))
            fs.delete(file, False)
        gone = 0
        fs, data = filesystem(self.spark, f"{self.path}/data")
        for commit in fs.listStatus(data) if fs.exists(data) else ():
            for bucket in fs.listStatus(commit.getPath()):
                name = f"data/{commit.getPath().getName()}/{bucket.getPath().getName()}"
                if bucket.isDirectory() and name not in used:
                    fs.delete(bucket.getPath(), True)
                    gone += 1
        return gone

    # inside ---------------------------------------------------------------------

    def _file(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def _touched(self, keys: DataFrame, head: dict) -> list[int]:
        """At most as many numbers as there are buckets."""
        return sorted(r.b for r in keys.select(_bucket(head).alias("b")).distinct().collect())

    def _write(self, rows: DataFrame, head: dict, allowed: list[int] | None = None) -> dict[str, str]:
        """The rows by bucket in a folder of this commit's own; bucket -> folder, of buckets that have rows."""
        name = f"data/{uuid.uuid4().hex}"
        columns = T.StructType.fromJson(head["schema"]).names
        dealt = rows.select(*columns, _bucket(head).alias("_bucket"))
        dealt.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        fs, folder = filesystem(self.spark, f"{self.path}/{name}")
        found = {s.getPath().getName().removeprefix("_bucket="): f"{name}/{s.getPath().getName()}" for s in fs.listStatus(folder) if s.isDirectory()}
        stray = sorted(int(b) for b in found if allowed is not None and int(b) not in allowed)
        if stray:
            raise ValueError(f"the edit moved keys to buckets {stray}, which it has not read")
        return found

    def _commit(self, version: int, head: dict) -> None:
        """Write aside, then rename to the version's name unless it exists."""
        jvm = self.spark.sparkContext._jvm
        fs, aside = filesystem(self.spark, f"{self.path}/versions/{uuid.uuid4().hex}.tmp")
        out = fs.create(aside, False)
        try:
            out.write(json.dumps(head).encode())
        finally:
            out.close()
        _, final = filesystem(self.spark, self._file(version))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(final), options)
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(final):
                raise Conflict(f"version {version} was committed by another writer") from e
            raise


def _bucket(head: dict) -> Column:
    return F.pmod(F.xxhash64(*head["key"]), F.lit(head["buckets"])).cast("int")


def _without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key, nulls included, is not among those of ``gone``."""
    test = None
    for k in key:
        t = F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}"))
        test = t if test is None else test & t
    return rows.alias("r").join(gone.select(*key).distinct().alias("g"), test, "left_anti")


def open_or_create(rows: DataFrame, path: str, key: str | list[str], buckets: int = 64) -> Snapshots:
    """The store below ``path``; if there is none, a new one of the columns of ``rows``, without rows."""
    found = Snapshots(rows.sparkSession, path)
    return found if found.versions() else Snapshots.create(rows.limit(0), path, key, buckets)

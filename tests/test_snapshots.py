"""Persisted stores: what an edit rewrites, what readers see, and what a dead edit leaves."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from scrivener.operators import store
from scrivener.sources.snapshots import Conflict, Snapshots, open_or_create


@pytest.fixture
def made(spark, tmp_path):
    rows = spark.range(200).select("id", F.concat(F.lit("f"), "id").alias("filename"), F.lit(None).cast("string").alias("note"))
    return Snapshots.create(rows, f"file://{tmp_path}/store", "id", buckets=16)


def state(df):
    return {r.id: (r.filename, r.note) for r in df.collect()}


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def test_edits_follow_a_plain_model(spark, made):
    """A hundred keys, twelve random edits, against a dictionary."""
    rng, want = random.Random(1), {k: (f"f{k}", None) for k in range(200)}
    for step in range(6):
        some = rng.sample(range(260), 3)
        if step % 3 == 0:
            made.upsert(spark.createDataFrame([(k, f"u{step}", "new") for k in some], "id long, filename string, note string"))
            want |= {k: (f"u{step}", "new") for k in some}
        elif step % 3 == 1:
            made.update(spark.createDataFrame([(k, None, f"n{step}") for k in some], "id long, filename string, note string"))
            want |= {k: (want[k][0], f"n{step}") for k in some if k in want}
        else:
            made.delete(ids(spark, *some))
            want = {k: v for k, v in want.items() if k not in some}
    assert state(made.read()) == want and made.versions() == list(range(7))
    assert state(made.read(0)) == {k: (f"f{k}", None) for k in range(200)}


def test_an_update_rewrites_its_buckets_alone(spark, made):
    before = made.head()[1]["folders"]
    made.update(spark.createDataFrame([(7, "seven")], "id long, filename string"))
    after = made.head()[1]["folders"]
    assert set(before) == set(after) and sum(before[b] != after[b] for b in before) == 1
    assert state(made.read_keys(ids(spark, 7, 999))) == {7: ("seven", None)}


def test_a_reader_keeps_its_version(spark, made):
    old = made.read()
    made.delete(ids(spark, *range(100)))
    assert old.count() == 200 and made.read().count() == 100


def test_an_edit_that_dies_changes_nothing(spark, made, monkeypatch):
    before, version = state(made.read()), made.versions()
    dead = F.udf(lambda x: 1 / 0, "string")
    with pytest.raises(Exception, match="ZeroDivision"):
        made.edit(ids(spark, 3), lambda old: old.withColumn("filename", dead("filename")))
    monkeypatch.setattr(Snapshots, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        made.delete(ids(spark, 3))
    assert state(made.read()) == before and made.versions() == version


def test_the_second_of_two_writers_fails(spark, made):
    rival = Snapshots(spark, made.path)

    def change(old):
        rival.delete(ids(spark, 5))
        return old.filter("id <> 3")

    with pytest.raises(Conflict):
        made.edit(ids(spark, 3), change)
    assert 3 in state(made.read()) and 5 not in state(made.read())


def test_inserts_nulls_repeats_and_empties(spark, tmp_path):
    rows = spark.createDataFrame([(None, "none", None), (1, "one", None)], "id long, filename string, note string")
    s = Snapshots.create(rows, f"file://{tmp_path}/s", "id", buckets=4)
    s.insert(spark.createDataFrame([(1, "again", None), (2, "two", None)], rows.schema))
    assert state(s.read()) == {None: ("none", None), 1: ("one", None), 2: ("two", None)}
    assert s.delete(rows.limit(0)) == 1
    s.delete(ids(spark, None, 1, 2))
    assert s.read().count() == 0 and s.read().columns == rows.columns
    assert s.upsert(rows, applied="a") == 3 and s.upsert(rows.withColumn("note", F.lit("x")), applied="a") == 3
    assert s.vacuum(keep=1) > 0 and state(s.read()) == {None: ("none", None), 1: ("one", None)} and s.versions() == [3]
    empty = open_or_create(rows, f"file://{tmp_path}/e", "id")
    assert empty.read().count() == 0 and open_or_create(rows, f"file://{tmp_path}/e", "id").versions() == [0]


def test_an_edit_may_not_move_keys_into_unread_buckets(spark, made):
    with pytest.raises(ValueError, match="moved keys"):
        made.edit(ids(spark, 3), lambda old: old.withColumn("id", F.col("id") + 1000))


def test_versions_of_models_are_kept(spark, tmp_path):
    """Register, deploy and roll back on a persisted registry, one bucket of models at a time."""
    rows = [("m", "1", "2024-01-01", "active"), ("m", "2", "2024-01-02", "staged"), ("n", "1", "2024-01-01", "active")]
    versions = spark.createDataFrame(rows, "model_name string, version_id string, created_at string, status string")
    s = Snapshots.create(versions, f"file://{tmp_path}/models", "model_name", buckets=8)
    one = spark.createDataFrame([("m",)], "model_name string")
    s.edit(one, lambda old: store.register(old, spark.createDataFrame([("m", "3", "2024-01-03")], "model_name string, version_id string, created_at string")))
    s.edit(one, lambda old: store.deploy(old, "m", "3"))
    now = lambda: collections.Counter((r.model_name, r.version_id, r.status) for r in s.read().collect())
    assert now() == collections.Counter([("m", "1", "archived"), ("m", "2", "staged"), ("m", "3", "active"), ("n", "1", "active")])
    s.edit(one, lambda old: store.rollback(old, "m", "1"))
    s.edit(one, lambda old: store.delete_version(old, "m", "2"))
    assert now() == collections.Counter([("m", "1", "active"), ("m", "3", "archived"), ("n", "1", "active")])

"""Documents made of narrow rows are dealt out by number, and what goes by document shuffles no more."""

from scrivener.operators import lines
from scrivener.sources import tables


def _customers(spark, path, n):
    spark.range(n).selectExpr("id as c_custkey", "concat('Customer#', id) as c_name", "cast(id % 3 as int) as c_nationkey", "0d as c_acctbal", "'BUILDING' as c_mktsegment").coalesce(1).write.parquet(f"{path}/customer.parquet")
    spark.range(3).selectExpr("cast(id as int) as n_nationkey", "concat('N', id) as n_name").coalesce(1).write.parquet(f"{path}/nation.parquet")


def test_tasks_grow_with_the_documents(spark, tmp_path):
    n = tables.DOCUMENTS_A_TASK * 10
    _customers(spark, tmp_path, n)
    docs = tables.resume_text(spark, str(tmp_path))
    assert docs.rdd.getNumPartitions() == 10
    assert docs.select("doc_id").distinct().count() == n
    assert tables.raw_job_texts(spark, str(tmp_path)).rdd.getNumPartitions() == 10


def test_windows_by_document_need_no_exchange(spark, tmp_path):
    _customers(spark, tmp_path, 50)
    found = lines.entry_chunks(tables.resume_text(spark, str(tmp_path)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1

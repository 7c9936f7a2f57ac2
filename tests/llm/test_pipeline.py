"""The pipeline's stages, the registered queries, and their SQL."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scrivener.llm import queries
from scrivener.llm.common import materialize, read


def test_stages_in_order(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "personal data", "mixing", "packing"]
    docs = read(spark, sf, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), "stage")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] < sizes[4]
    assert not docs.filter(F.col("text").rlike(r"[A-Za-z0-9]@mail[0-9]\.example")).count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").distinct().collect()}


def test_run_and_empty(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
    docs = read(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), "empty")
    assert docs.count() == 0


def test_stages_on_hard_rows(spark, sf):
    """Null ids, texts and sources, repeated rows, ids that floating point can't hold, clashing names: through all stages."""
    body = "the cat sat on the mat and ran away from the dog in the town, "
    rows = [(k, " ".join(f"w{k}x{n}" if n % 9 else f"W{k}x{n}." for n in range(120)), "en", "a", 1) for k in range(20)]
    rows += [(None, rows[3][1], "en", None, 1), (None, None, None, None, None), ((1 << 53) + 1, body * 9, "en", "b", 7), (5, "", "en", "b", 0), rows[4], rows[4], (6, "x " * 50_000, None, "b", 9)]
    rows += [(30, rows[7][1] + " mail a@b.co", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("x") for c in ("_row", "_key", "_text", "_id", "key", "size", "rep", "n_words", "digest", "times", "range")})
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), "hard")
        assert docs.columns == columns and docs.count()
    assert not docs.filter(F.col("text").contains("a@b.co")).count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.agg(F.sum("length")).first()[0] == pieces.filter("start = 0").agg(F.sum("doc_tokens")).first()[0]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path if os.path.isfile(path) else glob.escape(path) + '/*.parquet'}'")
    got = queries.queries()[name](spark, sf).toPandas()
    want = con.execute(queries.oracle_sql()[name]).df()[list(got.columns)]
    keys = [c for c in got.columns if c != "target"]
    got, want = (d.sort_values(keys).reset_index(drop=True) for d in (got, want))
    assert got.convert_dtypes().astype(str).equals(want.convert_dtypes().astype(str))


def test_queries_return_the_columns_of_their_contracts(spark, sf):
    q = queries.queries()
    columns = {
        "op1_language_id": "doc_id held_out lang_pred score", "op2_token_counts": "doc_id n_bytes n_tokens over_limit", "op3_mixing": "doc_id size source_size target taken",
        "op5_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op6_url_filters": "page_id host path rule verdict", "op7_top_k": "query_id rank vec_id score",
        "op8_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op9_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op4_near_duplicates": "doc_id class_id", "op10_sharding": "doc_id shard_id", "op11_prefix_trie": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256", "op12_importance_resampling": "doc_id n_features weight score rank", "op13_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    }
    assert set(q) == set(columns)
    for name, wanted in columns.items():
        assert set(wanted.split()) <= set(q[name](spark, sf).columns), name

"""The pipeline and the registered queries of the subpackage on the given tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
import corpus_pipeline

_DIR = "/root/testdata/sf0.001"


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "near_dedup", "mix_sources", "pack_sequences"]


@pytest.mark.skipif(not os.path.isdir(_DIR), reason="no test data")
def test_stages_keep_columns_and_narrow(spark, tmp_path):
    docs = spark.read.parquet(f"{_DIR}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, _DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids and left
        if i == 1:
            assert left == ids
        ids = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, _DIR)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)

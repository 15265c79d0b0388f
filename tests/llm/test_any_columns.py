"""Columns of the caller that bear the operators' own names pass through unchanged."""

import pytest

import corpus_pipeline as pipeline
from billsift.llm import mixing

NAMES = ["_id", "_home", "_text", "_key", "_hash", "_block", "_n", "_rest", "_more", "_full", "_salt", "_node", "_row",
         "_score", "score", "kept", "n_removed", "n_bytes", "n_spans", "root", "node", "place", "own", "whole", "number",
         "home", "id", "a.b", "c0"]


@pytest.fixture(scope="module")
def docs(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()
    return spark.createDataFrame([(*r, *(f"{r.doc_id}-{n}" for n in NAMES)) for r in rows],
                                 ["doc_id", "text", "lang", "source", "n_chars", *NAMES])


@pytest.mark.parametrize("name, stage", pipeline.STAGES[:-1])
def test_stages(spark, small, docs, name, stage):
    out = stage(spark, docs, small)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(tuple(r)[5:] == tuple(f"{r.doc_id}-{n}" for n in NAMES) for r in rows)


def test_mixing(spark, docs):
    rows = mixing.mix(docs, repeats=1.25).collect()
    assert rows and all(tuple(r)[5:-2] == tuple(f"{r.doc_id}-{n}" for n in NAMES) for r in rows)

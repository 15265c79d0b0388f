from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from billsift.llm import quality
from billsift.llm.common import in_bucket

from test_nearcopies import plain_tops
from test_suffixes import plain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def outputs(spark, small, tmp_path_factory):
    """Rows after each stage, each stage fed from the files of the one before."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_and_run(spark, small, outputs):
    assert all(o.columns == COLUMNS for o in outputs[:-1])
    got = Counter((r.doc_id, r.text, bytes(r.ids)) for r in pipeline.run(spark, small).collect())
    assert got == Counter((r.doc_id, r.text, bytes(r.ids)) for r in outputs[-1].collect())


def test_quality_filter(spark, small, outputs):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    net = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"), ~in_bucket(F.col("doc_id"), 5, 0))
    rows = docs.collect()
    scores = quality.score_texts(net, [r.text or "" for r in rows])
    want = {r.doc_id for r, s in zip(rows, scores) if s >= pipeline.LEAST_QUALITY}
    assert {r.doc_id for r in outputs[0].collect()} == want and 150 < len(want) < 200


def test_near_copies(outputs):
    rows = sorted(outputs[0].collect(), key=lambda r: r.doc_id)
    tops = plain_tops([r.text for r in rows])
    assert sorted(outputs[1].collect()) == sorted(r for i, r in enumerate(rows) if tops[i] == i)


def test_repeats(outputs):
    before = {r.doc_id: r for r in outputs[1].collect()}
    want = {}
    for i, data, gone in plain(sorted((r.doc_id, r.text) for r in before.values())):
        kept = bytes(np.frombuffer(data, np.uint8)[~gone]).decode(errors="ignore")
        if not data or not gone.all():
            want[i] = kept
    after = {r.doc_id: r for r in outputs[2].collect()}
    assert {i: r.text for i, r in after.items()} == want
    assert all(r.n_chars == len(r.text) and r.source == before[i].source for i, r in after.items())


def test_mix_keeps_every_document(outputs):
    before, after = outputs[2].collect(), Counter(outputs[3].collect())
    assert set(before) == set(after)
    words = Counter()
    for r in before:
        words[r.source] += len(r.text.split())
    largest = max(words, key=words.get)
    assert all(n == 1 for r, n in after.items() if r.source == largest)
    assert max(after.values()) == 2


def test_encoding(outputs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = outputs[4].collect()
    assert len(rows) == outputs[3].count() and all(r.restored for r in rows)
    for r in rows:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert list(memoryview(bytes(r.ids)).cast("I")) == ids and r.n_tokens == len(ids)


def test_stages_on_edge_rows(spark, small):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same words here " * 9, "en", "a", 144),
            (3, "same words here " * 9, "en", "a", 144), (None, "x" * 200, "en", "b", 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0
    near = pipeline.drop_near_copies(spark, docs, small)
    assert sorted((r.doc_id or 0) for r in near.collect()) == [0, 1, 3]
    cut = {r.doc_id: r.text for r in pipeline.cut_repeats(spark, docs.where("doc_id is not null"), small).collect()}
    assert cut[1] is None and cut[2] == "" and cut[3].startswith("same words here ")
    assert pipeline.mix_sources(spark, docs, small).count() >= 5
    assert pipeline.encode(spark, docs, small).count() == 5

import numpy as np
from pyspark.sql import functions as F

from billsift.llm import quality
from billsift.llm.common import in_bucket
from billsift.llm.queries import op5_quality


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = op5_quality(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert rows.count() == 1000
    held = rows.where("held_out").join(labels, "doc_id").collect()
    assert len(held) > 50 and all(0 <= r.score <= 1 for r in held)
    good, bad = ([r for r in held if r.quality == y] for y in (1, 0))
    assert sum(r.predicted for r in good) / len(good) > 0.95
    assert sum(r.predicted for r in bad) / len(bad) < 0.5
    order = sum((g.score > b.score) for g in good for b in bad) / (len(good) * len(bad))
    assert order > 0.9


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        at = quality.starts(n)
        assert at[0] == 0 and at[-1] + quality.LENGTH >= n
        rows = quality.padded(bytes(range(256)) * 20, quality.starts(5120))
        assert rows.shape[1] == quality.LENGTH
        if len(at) > 1:
            assert at[-2] + quality.LENGTH < n


def test_gradient_of_the_filters():
    """The direction training moves in lowers the loss of separable examples."""
    examples = [([b"!!" * 200], 0), ([b"plain words here " * 20], 1)] * 40
    net = quality.train(examples, {0: 1.0, 1: 1.0})
    got = quality.score_texts(net, ["!!" * 200, "plain words here " * 20])
    assert got[0] < 0.1 and got[1] > 0.9


def test_table_edges(spark):
    docs = spark.createDataFrame(
        [(i, ("!!$ " if i % 2 else "soft words ") * 30, 0.5) for i in range(40)]
        + [(100, None, 0.1), (101, "", 0.2), (101, "", 0.2), (None, "x" * 300_000, 0.3)],
        "doc_id long, text string, Score double")
    labels = spark.createDataFrame([(i, 1 - i % 2, None) for i in range(40)] + [(None, 1, 0), (7, None, 0)],
                                   "doc_id long, quality int, text string")
    net = quality.fit(docs, labels, ~in_bucket(F.col("doc_id"), 5, 0))
    out = quality.score(docs, net)
    assert out.columns == ["doc_id", "text", "score"]
    rows = out.collect()
    assert len(rows) == 44 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert {r.score > 0.5 for r in rows if r.doc_id is not None and r.doc_id < 40 and r.doc_id % 2} == {False}
    assert quality.score(docs.limit(0), net).count() == 0
    one = quality.fit(docs, labels.where("quality = 1"), F.lit(True))
    assert {r.score for r in quality.score(docs, one).collect()} == {1.0}
    none = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert np.isfinite([r.score for r in rows]).all()

import numpy as np
from pyspark.sql import functions as F

from billsift.llm import toxicity
from billsift.llm.common import in_bucket
from billsift.llm.queries import op9_toxicity


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    rows = op9_toxicity(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = rows.where("held_out").join(labels, "doc_id").collect()
    assert len(held) > 300 and all(0 <= r.score <= 1 for r in held)
    toxic, clean = ([r for r in held if r.toxic == y] for y in (1, 0))
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.8  # some carry no sign at all
    assert sum(r.predicted for r in clean) / len(clean) < 0.03


def test_label_model_discounts_copies_and_finds_accuracies():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.2
    good = [np.where(y, rng.random(4000) < 0.6, rng.random(4000) < 0.01) for _ in range(3)]
    x = np.stack([*good, good[0], good[0], rng.random(4000) < 0.3], axis=1).astype("f8")
    votes, start = toxicity.ballots(x, list(range(6)), [3.0] * 5)
    q, hit1, hit0, discount = toxicity.label_model(votes, np.ones(4000), start, 0.2)
    assert ((q > 0.5) == y).mean() > 0.9
    assert abs(hit1[1] - 0.6) < 0.1 and hit0[1] < 0.05
    assert discount[0] < 0.4 and discount[1] > 0.9
    assert abs(hit1[5] - hit0[5]) < 0.1


def test_table_edges(spark):
    docs = spark.createDataFrame(
        [(i, "calm words about rain and sea " + ("Grumbly! grumbled " if i % 4 == 0 else ""), 1) for i in range(120)]
        + [(300, None, 1), (301, "", 1), (301, "", 1), (None, "sea " * 100_000 + "grumbling", 1)],
        "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), "x") for i in range(120)] + [(None, 1, ""), (300, None, "")],
                                   "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels, ~in_bucket(F.col("doc_id"), 5, 0))
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "score"]
    rows = out.collect()
    assert len(rows) == 124
    for r in rows:
        assert (r.score >= 0.5) == ("grumbl" in (r.text or "").lower()), r.text and r.text[:60]
    assert toxicity.score(docs.limit(0), model).count() == 0
    clean = toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True))
    assert max(r.score for r in toxicity.score(docs, clean).collect()) < 0.01
    none = toxicity.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}

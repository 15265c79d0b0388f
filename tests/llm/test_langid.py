from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from billsift.llm import langid
from billsift.llm.common import in_bucket, labelled_sample
from billsift.llm.queries import op7_langid


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = op7_langid(spark, folder)
    assert rows.count() == 1000
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "n_chars")
    held = rows.where("held_out").join(docs, "doc_id").where("lang is not null").collect()
    assert len(held) > 150 and all(0 <= r.score <= 1 for r in held)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    rows = rng.integers(1, 6, (3, 7)).astype(np.uint8)
    y = np.array([0, 1, 1])
    u, two = langid.UNITS, range(2)
    net = langid.Network([rng.normal(0, .5, (256, 3 * u)) for _ in two], [rng.normal(0, .4, (u, 2 * u)) for _ in two],
                         [rng.normal(0, .4, (u, u)) for _ in two], rng.normal(0, .5, (2 * u, 2)), np.zeros(2), ["a", "b"])

    def loss():
        return -np.log(langid.places(net, rows)[:, np.arange(3), y]).sum()

    for way in two:
        trace = [[], []]
        h = np.concatenate([langid.states(net, rows, w, trace[w]) for w in two], axis=2)
        d = langid.places(net, rows).astype("f8")
        d[:, np.arange(3), y] -= 1
        grads = langid.backward(net, rows, way, trace[way], (d @ net.outer.T)[:, :, way * u:(way + 1) * u])
        for part, g in zip((net.inputs[way], net.gates[way], net.candidate[way]), grads):
            for cell in [(2, 1), (3, u + 1), (5, 2 * u + 2)] if part.shape[0] == 256 else [(0, 1), (3, 4)]:
                was = part[cell]
                part[cell] = was + 1e-2
                up = loss()
                part[cell] = was - 1e-2
                down = loss()
                part[cell] = was
                assert abs((up - down) / 2e-2 - g[cell]) < 0.05 * max(1, abs(g[cell])), (way, part.shape, cell)
        assert h.shape == (7, 3, 2 * u)


def test_table_edges(spark):
    docs = spark.createDataFrame(
        [(i, "der die und das " * 9 if i % 2 else "el la que los " * 9, "de" if i % 2 else "es", 1) for i in range(60)]
        + [(70, None, "de", 2), (71, "", "es", 3), (72, "123 !?", None, 4), (72, "123 !?", None, 4),
           (None, "der und " * 40_000, "de", 5)], "doc_id long, text string, lang string, Lang_Pred int")
    net = langid.fit(docs, ~in_bucket(F.col("doc_id"), 4, 2))
    assert net.languages == ["de", "es"]
    out = langid.identify(docs, net)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == 65
    assert all(r.lang_pred == r.lang for r in rows if r.doc_id is None or r.doc_id < 60)
    assert {(r.lang_pred, r.score) for r in rows if (r.doc_id or 0) >= 70} == {("und", 0.0)}
    assert langid.identify(docs.limit(0), net).count() == 0
    blank = langid.fit(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, blank).collect()} == {"und"}


def test_many_languages_are_all_learned(spark):
    names = [f"l{n:02}" for n in range(70)]  # each writes with a sign of its own
    rows = [(100 * n + k, f"{chr(97 + n % 26)}{chr(65 + n // 26)} " * 60, name, k) for n, name in enumerate(names)
            for k in range(40 if n < 64 else 36)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, k int")
    sample, counts = labelled_sample(docs, docs, "lang", F.lit(True), 6, most=35)
    taken = Counter(r.label for r in sample.collect())
    assert sorted(counts) == names and taken == {name: 3 for name in names}
    net = langid.fit(docs, F.col("doc_id") % 100 > 0)
    assert net.languages == names
    got = langid.identify(docs.where("k = 0"), net).collect()
    rare = [r for r in got if r.lang >= "l64"]
    assert len(rare) == 6 and sum(r.lang == r.lang_pred for r in rare) >= 5

from collections import Counter
from math import log

import duckdb
import pytest
from pyspark.sql import functions as F

from billsift.llm import mixing
from billsift.llm.queries import op1_mixing, oracle_sql


def test_query_agrees_with_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = Counter(con.execute(oracle_sql()["op1_mixing"]).fetchall())
    got = op1_mixing(spark, folder)
    assert got.columns == ["doc_id", "source", "mix_epoch", "mix_key"]
    assert Counter(map(tuple, got.collect())) == want


def frame(spark):
    rows = [(i, "w " * 10, "big") for i in range(4000)] + [(9000 + i, "w " * 10, "mid") for i in range(400)]
    rows += [(20_000 + i, "w " * 10, None) for i in range(100)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_repetition_limit_and_whole_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 100)
    docs = frame(spark)
    got = Counter(r.source for r in mixing.mix(docs, repeats=3.0).select("source").collect())
    assert got["big"] == 4000 and abs(got[None] - 300) <= 20
    a = 1 - log(3) / log(40)
    assert abs(got["mid"] - 400 * 10 ** (1 - a)) <= 20
    assert mixing.mix(docs, repeats=3.0).select("doc_id").distinct().count() == 4500


def test_many_sources_give_the_same_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 100)
    few = Counter(mixing.mix(frame(spark), repeats=2.0).collect())
    monkeypatch.setattr(mixing, "FEW", 1)
    assert Counter(mixing.mix(frame(spark), repeats=2.0).collect()) == few


def test_budget_and_entropy(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 100)
    docs = frame(spark)
    rows = docs.withColumns({"k": mixing.source_key(F.col("source")), "n": F.lit(10)})
    weights = [r.weight for r in mixing.plan(rows, "n", "k", budget=30_000, entropy=0.5).collect()]
    assert abs(sum(weights) - 1) < 1e-9
    assert abs(-sum(w * log(w) for w in weights) / log(3) - 0.5) < 1e-6
    mixed = mixing.mix(docs, budget=30_000, repeats=1.5)
    assert abs(mixed.count() - 3000) < 60
    counts = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert max(counts.values()) <= 2
    keys = [r.mix_key for r in mixed.where("source = 'big'").select("mix_key").collect()]
    assert len(set(keys)) == len(keys)


def test_table_edges(spark):
    docs = spark.createDataFrame([(1, None, "a", 1), (2, "", "a", 2), (3, "x y", "", 3), (3, "x y", "", 3),
                                  (None, "z", None, 4)], "doc_id long, text string, source string, Mix_Epoch int")
    out = mixing.mix(docs, repeats=10.0)
    assert out.columns == ["doc_id", "text", "source", "mix_epoch", "mix_key"]
    counts = Counter((r.doc_id, r.source) for r in out.collect())
    assert counts == {(1, "a"): 1, (2, "a"): 1, (3, ""): 2, (None, None): 4}
    assert mixing.mix(docs.limit(0), repeats=2.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs)

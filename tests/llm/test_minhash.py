import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from billsift.llm import minhash
from billsift.llm.queries import op3_minhash


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(text, following):
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def test_query_against_true_likeness(spark, small):
    docs = sorted(spark.read.parquet(f"{small}/documents.parquet").collect(), key=lambda r: r.doc_id)
    rows = {r.doc_id: r for r in op3_minhash(spark, small).collect()}
    assert len(rows) == len(docs)
    off = []
    prints = {}
    for i, d in enumerate(docs):
        text, following = d.text or "", docs[(i + 1) % len(docs)].text or ""
        r, new = rows[d.doc_id], edited(text, following)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        prints.setdefault(text, set()).add(r.fingerprint)
        off += [r.near_edited - jaccard(text, new), r.near_next - jaccard(text, following)]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(p) == 1 for p in prints.values())
    assert len(set.union(*prints.values())) > 0.97 * len({frozenset(shingles(t)) for t in prints})
    assert max(map(abs, off)) < 0.2 and abs(sum(off) / len(off)) < 0.01
    assert sum(abs(x) for x in off) / len(off) < 0.03


@pytest.mark.parametrize("buckets", [2, 5, 40])
def test_next_across_ranges(spark, buckets):
    ids = [9, 1, 4, 4, 30, 7, None, 12, 8]
    df = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, text string")
    out = minhash.with_next(df, "doc_id", ["text"], lambda d: d, buckets).collect()
    order = [t for _, t in sorted((i if i is not None else 99, f"t{n}") for n, i in enumerate(ids))]
    assert {r.text: r.next_text for r in out} == dict(zip(order, order[1:] + order[:1]))


def test_next_across_ranges_of_large_ids(spark):
    rng = random.Random(4)
    ids = sorted({rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)})
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    out = minhash.with_next(df, "doc_id", ["text"], lambda d: d, 16).collect()
    assert {r.doc_id: r.next_text for r in out} == dict(zip(ids, map(str, ids[1:] + ids[:1])))


def test_table_edges(spark):
    rows = [(1, None, 3), (2, "", 4), (3, "a b", 5), (3, "a b", 6), (4, "x " * 30000, 7), (None, "é😀 wort", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = minhash.compare_edited(df).collect()
    assert len(got) == 6
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].fingerprint == by[2][0].fingerprint and by[1][0].near_next == 1.0
    assert by[1][0].edited_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[3][0].fingerprint == by[3][1].fingerprint and max(r.near_next for r in by[3]) == 1.0
    assert by[None][0].edited_sha256 == hashlib.sha256("é😀 wor".encode()).hexdigest()  # the next text is empty
    assert minhash.compare_edited(df.where(F.lit(False))).count() == 0


def test_no_python_in_the_plan(spark, small):
    plan = op3_minhash(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and plan.count("Exchange hashpartitioning") == 2

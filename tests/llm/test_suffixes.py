import hashlib
import random

import numpy as np
import pytest

from billsift.llm import suffixes
from billsift.llm.queries import op2_suffixes


def plain(docs):
    """(removed flags) of each text by remembering the first place of every string."""
    first, marks = {}, []
    for i, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            at = (i, p)
            if first.setdefault(data[p:p + 100], at) != at:
                gone[p:p + 100] = True
        marks.append((i, data, gone))
    return marks


def summary(marks):
    out = {}
    for i, data, gone in marks:
        edge = np.diff(gone.astype(np.int8), prepend=0)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[i] = (len(data), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_transform_sorts_suffixes():
    rng = random.Random(4)
    texts = [bytes(rng.choices(b"ab", k=rng.randint(1, 12))) for _ in range(40)] + [b"abab", b"abab"]
    owner, start, common = suffixes.transform([np.frombuffer(t, np.uint8) for t in texts])
    got = [texts[o][s:] for o, s in zip(owner, start)]
    # the ends of equal suffixes are ordered by text
    want = sorted((texts[o][s:], o) for o in range(len(texts)) for s in range(len(texts[o]) + 1))
    assert [(g, o) for g, o in zip(got, owner)] == want
    for r in range(1, len(got)):
        n = 0
        while n < min(len(got[r]), len(got[r - 1])) and got[r][n] == got[r - 1][n]:
            n += 1
        assert common[r] == n


def test_query_against_all_strings(spark, small):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op2_suffixes(spark, small).collect()}
    want = summary(plain(docs))
    assert rows == want
    assert sum(w[1] for w in want.values()) > 10_000


@pytest.mark.parametrize("hot", [4096, 3])
def test_passages_in_changing_contexts(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(8)

    def noise(n):
        return "".join(rng.choices("abcdefgh ", k=n))

    passages = [noise(n) for n in (99, 100, 101, 180, 400)]
    docs = []
    for i in range(60):
        docs.append((i * 3, noise(rng.randint(0, 90)) + rng.choice(passages) + noise(rng.randint(0, 150))))
    docs += [(500, "ha " * 400), (501, "x" + "ha " * 90), (502, passages[4] + passages[4]), (503, "é" * 200)]
    rows = suffixes.dedup(spark.createDataFrame(docs, "doc_id long, text string"), homes=7).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows}
    assert got == summary(plain(docs))


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefgh", k=4000))
    docs = [(1, long), (2, long[1234:3333]), (3, "zz" + long[600:900])]
    rows = suffixes.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows}
    assert got == summary(plain(docs))


def test_table_edges(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=300))
    rows = [(1, None, 1), (2, "", 2), (3, text, 3), (3, text, 4), (None, text, 5), (9, "short", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Kept int")
    out = suffixes.dedup(df)
    assert out.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept"]
    got = sorted((r.doc_id or 99, r.text, r.n_bytes, r.n_removed, bytes(r.kept)) for r in out.where("text <> ''").collect())
    data = text.encode()
    assert got == [(3, text, 300, 0, data), (3, text, 300, 0, data), (9, "short", 5, 0, b"short"), (99, text, 300, 300, b"")]
    assert out.count() == 6
    assert suffixes.dedup(df.limit(0)).count() == 0


def one_by_one(rows):
    """Kept bytes of each (id, text): texts of one id in the order of their hashes, rows without an id last."""
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (
        r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    marks = plain([(n, t) for n, (_, t) in enumerate(order)])
    return {order[n]: bytes(np.frombuffer(data, np.uint8)[~gone]) for n, data, gone in marks}


def dedup_pairs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.text or "", bytes(r.kept)) for r in suffixes.dedup(df).collect()), key=str)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_texts_of_one_id_whose_checksums_agree(spark, doc_id):
    import zlib
    seen, rng = {}, random.Random(21)
    while True:
        text = "".join(rng.choices("abcdefgh ", k=160))
        other = seen.setdefault(zlib.crc32(text.encode()) & ((1 << 22) - 1), text)
        if other != text:
            break
    shared = "".join(rng.choices("klmnopq ", k=130))
    rows = [(doc_id, text + shared), (doc_id, other + shared), (doc_id, text), (doc_id, other), (3, shared + "x"),
            (doc_id, text), (4, None), (doc_id, None), (doc_id, "")]
    want = one_by_one(rows)
    assert dedup_pairs(spark, rows) == sorted(((i, t or "", want[i, t or ""]) for i, t in rows), key=str)


def test_many_texts_without_an_id(spark):
    rng = random.Random(22)
    common = ["".join(rng.choices("abcdef ", k=120)) for _ in range(40)]
    rows = [(None, f"{n} {rng.choice(common)} {n * 7}") for n in range(20_000)]
    want = one_by_one(rows)
    assert dedup_pairs(spark, rows) == sorted(((i, t, want[i, t]) for i, t in rows), key=str)


def test_any_column_names(spark):
    names = ["id", "home", "number", "own", "text", "place", "mode", "rows", "mark", "_", "c0", "a.b"]
    shared = "shared words " * 12
    df = spark.createDataFrame([(1, shared + "one", *range(len(names))), (2, shared, *range(len(names)))],
                               ["doc_id", "body", *names])
    rows = sorted(suffixes.dedup(df, text="body").collect())
    assert [tuple(r)[2:-4] for r in rows] == [tuple(range(len(names)))] * 2
    assert rows[0].asDict().keys() == {"doc_id", "body", *names, "n_bytes", "n_removed", "n_spans", "kept"}
    assert rows[1].n_removed == len(shared)


def test_groups_grow_in_number_with_the_texts(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    want = sorted((r.doc_id, bytes(r.kept)) for r in suffixes.dedup(docs).collect())
    seen = []
    scan = suffixes.scan
    monkeypatch.setattr(suffixes, "PLACE", 1 << 10)
    monkeypatch.setattr(suffixes, "scan", lambda places: seen.append(places) or scan(places))
    assert sorted((r.doc_id, bytes(r.kept)) for r in suffixes.dedup(docs).collect()) == want
    size = sum(len((r.text or "").encode()) for r in docs.collect())
    assert seen[0] == -(-size // (1 << 10)) > 8


def test_equal_rows_go_to_a_home_once(spark, monkeypatch):
    rng = random.Random(23)
    shared = "".join(rng.choices("abcdefgh ", k=140))
    rows = [(5, shared + "hot")] * 3000 + [(None, shared + "none")] * 500 + [(2, "ab" + shared), (5, shared), (9, None), (9, "")]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n int").repartition(4)
    counted = spark.sparkContext.accumulator(0)
    carve = suffixes.carve

    def counting():
        run = carve()

        def counted_run(key, docs, told):
            counted.add(docs.num_rows)
            return run(key, docs, told)

        return counted_run

    monkeypatch.setattr(suffixes, "carve", counting)
    out = suffixes.dedup(df)
    assert out.columns == ["doc_id", "text", "n", "n_bytes", "n_removed", "n_spans", "kept"]
    got = sorted((r.n, r.doc_id, r.text, bytes(r.kept)) for r in out.collect())
    want = one_by_one(rows)
    assert got == [(n, i, t, want[i, t or ""]) for n, (i, t) in enumerate(rows)]
    assert counted.value == len({(i, t or "") for i, t in rows})

"""The committed store, single-write exports, bounded dedupe and dead letters."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billsift.operators.documents import extract_pages
from billsift.operators.store import status_rollup
from billsift.operators.validate import reconcile_long
from billsift.session import shared_dir
from billsift.sources import committed, sinks
from billsift.sources.committed import Commit, Folder, append_batch, commits, read_committed
from billsift.streaming import ingest


def batch(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, h string")


def stored(spark, path):
    return sorted((r.doc_id, r.h, r.batch, r.id) for r in read_committed(spark, path).collect())


def test_ids_run_on_over_batches(spark):
    path = shared_dir(spark, "store")
    assert read_committed(spark, path) is None and commits(spark, path) is None
    first = append_batch(spark.range(1000).selectExpr("id as doc_id", "cast(id % 700 as string) as h").repartition(7),
                         path, "one", "h", ["doc_id"])
    assert (first.n_rows, first.first_id, first.last_id) == (700, 1, 700)
    second = append_batch(spark.range(900).selectExpr("id + 5000 as doc_id", "cast(id as string) as h").repartition(5),
                          path, "two", "h", ["doc_id"])
    assert (second.n_rows, second.first_id, second.last_id) == (200, 701, 900)
    rows = stored(spark, path)
    assert sorted(r[3] for r in rows) == list(range(1, 901))
    assert {r[2] for r in rows if r[3] <= 700} == {"one"}
    assert stored(spark, path) == rows  # every read numbers alike


def test_repeated_batch_changes_nothing(spark):
    path = shared_dir(spark, "store")
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)]
    made = append_batch(batch(spark, rows), path, "x", "h", ["doc_id"])
    before = stored(spark, path)
    assert append_batch(batch(spark, [(9, "new")]), path, "x", "h", ["doc_id"]) == made
    assert stored(spark, path) == before and [r[:2] for r in before] == [(1, "a"), (2, "b"), (4, None), (5, None)]


def test_empty_batch_is_a_commit(spark):
    path = shared_dir(spark, "store")
    assert append_batch(batch(spark, []), path, "none", "h", ["doc_id"]) == append_batch(
        batch(spark, [(1, "a")]), path, "none", "h", ["doc_id"])
    assert read_committed(spark, path).count() == 0
    assert append_batch(batch(spark, [(1, "a")]), path, "some", "h", ["doc_id"]).first_id == 1


def test_unfinished_attempts_are_not_seen(spark):
    path = shared_dir(spark, "store")
    append_batch(batch(spark, [(1, "a")]), path, "x", "h", ["doc_id"])
    batch(spark, [(7, "half")]).withColumn("_row", F.lit(0).cast("long")).write.parquet(f"{path}/data/token=lost")
    assert [r[:2] for r in stored(spark, path)] == [(1, "a")]


def test_the_slower_of_two_writers_starts_anew(spark, monkeypatch):
    path = shared_dir(spark, "store")
    put, raced = Folder.put, []

    def put_late(self, text, *parts):
        if json.loads(text)["batch"] == "slow" and not raced:
            raced.append(1)  # another writer commits between this one's read and its commit
            append_batch(batch(spark, [(1, "a"), (2, "b")]), path, "fast", "h", ["doc_id"])
        return put(self, text, *parts)

    monkeypatch.setattr(Folder, "put", put_late)
    made = append_batch(batch(spark, [(3, "b"), (4, "c")]), path, "slow", "h", ["doc_id"])
    assert (made.n_rows, made.first_id) == (1, 3)
    assert [(r[0], r[2], r[3]) for r in stored(spark, path) if r[2] == "slow"] == [(4, "slow", 3)]
    assert sorted((r[0], r[2]) for r in stored(spark, path)) == [(1, "fast"), (2, "fast"), (4, "slow")]


def test_gives_up_after_many_races(spark, monkeypatch):
    monkeypatch.setattr(Folder, "put", lambda *a: False)
    monkeypatch.setattr(committed, "ATTEMPTS", 2)
    with pytest.raises(RuntimeError):
        append_batch(batch(spark, [(1, "a")]), shared_dir(spark, "store"), "x", "h", ["doc_id"])


def test_names_are_taken_once(spark):
    folder = Folder(spark, shared_dir(spark, "names"))
    assert folder.put("é1", "commits", "1") and not folder.put("2", "commits", "1")
    assert folder.get("commits", "1") == "é1" and folder.names("commits") == ["1"]
    assert folder.names("nothing") == [] and folder.names() == ["commits"]


def test_exports_write_rows_once(spark):
    path = shared_dir(spark, "export")
    parent = Folder(spark, path.rsplit("/", 1)[0])
    own = path.rsplit("/", 1)[1]
    one = spark.createDataFrame([(1, "a")], "i int, t string")
    assert sinks._write(one, path, "parquet", "overwrite") == 1
    assert sinks._write(one.limit(0), path, "parquet", "overwrite") == 0
    assert spark.read.parquet(path).count() == 1
    assert sinks._write(one.union(one), path, "parquet", "append") == 2
    assert spark.read.parquet(path).count() == 3
    assert sinks._write(one, path, "parquet", "overwrite") == 1
    assert spark.read.parquet(path).count() == 1
    assert [n for n in parent.names() if own in n] == [own]


EVENT = "i long, h string, ts timestamp"


def at(day):
    return datetime(2024, 1, day)


def fed(spark, parts, delay="5 days"):
    landing, out, log = (shared_dir(spark, n) for n in ("in", "out", "log"))
    for rows in parts:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(landing)
        ingest.dedupe_stream(spark.readStream.schema(EVENT).parquet(landing), out, log, "h", "ts", delay,
                             ["ts", "i"]).awaitTermination()
    rows = sorted((r.batch_id, r.i) for r in spark.read.parquet(f"{out}/rows").collect())
    counts = sorted((r.batch_id, r.n_rows, r.n_late, r.n_new) for r in spark.read.parquet(f"{out}/batches").collect())
    return rows, counts


def test_bounded_dedupe(spark):
    rows, counts = fed(spark, [
        [(1, "a", at(1)), (2, "a", at(2)), (3, "b", at(10)), (4, None, at(10)), (5, None, at(10))],
        # the mark is day 5: "a" of day 1 is forgotten, "b" is held, day 4 is late
        [(6, "a", at(6)), (7, "b", at(11)), (8, "c", at(4)), (9, "d", at(5)), (10, "d", at(20)), (11, "e", None)],
        # the mark is day 15: "d" was let through at day 5
        [(12, "d", at(16)), (13, "e", at(15)), (14, "b", at(14))]])
    assert rows == [(0, 1), (0, 3), (0, 4), (0, 5), (1, 6), (1, 9), (1, 11), (2, 12), (2, 13)]
    assert counts == [(0, 5, 0, 4), (1, 6, 1, 3), (2, 3, 1, 2)]


def test_bounded_dedupe_replays_a_batch(spark):
    landing, out = shared_dir(spark, "in"), shared_dir(spark, "out")
    spark.createDataFrame([(1, "a", at(1))], EVENT).write.parquet(landing)
    stream = spark.readStream.schema(EVENT).parquet(landing)
    for _ in range(2):  # the second run has no progress log: it does batch 0 again
        ingest.dedupe_stream(stream, out, shared_dir(spark, "log"), "h", "ts", "1 day", ["ts", "i"]).awaitTermination()
    assert [r.i for r in spark.read.parquet(f"{out}/rows").collect()] == [1]


def test_dead_letters(spark):
    landing, out, dead, log = (shared_dir(spark, n) for n in ("in", "out", "dead", "log"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    lines = ['{"a":1,"b":"x"}', '{"a":2}', "not json", '{"a":"text","b":"y"}', "", '{"a":3,"b":"é"', "[]"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(landing)
    for _ in range(2):
        ingest.json_stream(spark, landing, schema, out, dead, log).awaitTermination()
    good = sorted((r.a, r.b) for r in spark.read.parquet(out).collect() if r.a is not None)
    lost = sorted((r.line, r.file_name.startswith("part-")) for r in spark.read.parquet(dead).collect())
    assert good == [(1, "x"), (2, None)]
    assert {x for x, _ in lost} - {"[]"} == {'{"a":"text","b":"y"}', '{"a":3,"b":"é"', "not json"} and all(f for _, f in lost)


def test_rollup_counts_a_document_once_on_each_level(spark):
    rows = [("v", "OK", "1"), ("v", "OK", "1"), ("v", "BAD", "1"), ("w", "OK", "1"), ("w", "OK", None), ("w", "OK", None),
            (None, "OK", "2")]
    got = sorted(map(tuple, status_rollup(spark.createDataFrame(rows, "v string, status string, h string"), "h", "v")
                     .collect()), key=str)
    assert sorted(got, key=lambda r: (r[2], str(r[0]), str(r[1]))) == [
        (None, "OK", 0, 1, 1, 0), ("v", "BAD", 0, 1, 1, 0), ("v", "OK", 0, 2, 1, 1), ("w", "OK", 0, 3, 3, 0),
        (None, None, 1, 1, 1, 0), ("v", None, 1, 3, 1, 2), ("w", None, 1, 3, 3, 0), (None, None, 3, 7, 4, 3)]


def test_items_and_headers_that_lack_each_other(spark):
    items = spark.createDataFrame([(1, "5.00"), (1, "6.00"), (2, None), (3, "1.00"), (None, "9.00")], "k long, amount string")
    headers = spark.createDataFrame([(1, "11.00"), (2, "4.00"), (4, "2.00"), (5, None), (None, "9.00")],
                                    "k long, grand_total string").selectExpr("k", "cast(grand_total as decimal(18,2)) grand_total")
    got = sorted(((r.k, r.n_items, r.side, r.reconciles) for r in reconcile_long(items, headers, "k").collect()), key=str)
    assert got == sorted([(1, 2, "both", True), (2, 1, "both", None), (3, 1, "no header", None), (4, 0, "no items", None),
                          (5, 0, "no items", None), (None, 1, "no header", None), (None, 0, "no items", None)], key=str)


def test_extractor_in_bounded_batches(spark):
    def pages(content):
        for word in content.decode().split(","):
            if word == "boom":
                raise KeyError(word)
            yield word

    rows = [("a", b"one,two"), ("b", b"three,boom"), ("c", b"\xff"), ("d", None), ("e", b""), ("f", b"x" * 400)]
    files = spark.createDataFrame(rows, "path string, content binary").coalesce(1)
    got = extract_pages(files, pages, batch_bytes=100).collect()
    assert sorted(((r.path, r.page_no, r.page_text, r.error_reason) for r in got), key=str) == [
        ("a", 1, "one", None), ("a", 2, "two", None), ("b", None, None, "KeyError"),
        ("c", None, None, "UnicodeDecodeError"), ("d", None, None, "AttributeError"), ("e", 1, "", None),
        ("f", 1, "x" * 400, None)]
    assert extract_pages(files.limit(0), pages).count() == 0


def test_commit_is_plain_data():
    assert Commit(**vars(Commit("b", "t", 1, 2, 3))) == Commit("b", "t", 1, 2, 3)

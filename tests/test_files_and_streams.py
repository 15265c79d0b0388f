"""Sources, sinks and streams through real files."""

import csv
import glob
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from billsift import functions as B
from billsift.operators.documents import prepare
from billsift.operators.records import extract_record
from billsift.operators.store import to_store
from billsift.plans import invoices, queries
from billsift.schemas import RECORD_COLUMNS, STORE_EXPORT
from billsift.session import materialize
from billsift.sources import files, sinks
from billsift.streaming import ingest

RUN = datetime(2024, 1, 2, 3, 4)
INVOICE = "=Acme PVT LTD\nInvoice No: {}\nBill To\nBuyer, \"one\"\nGrand Total 1,250.00\nand some more text"


def put(folder, name, content):
    folder.mkdir(exist_ok=True)
    mode = "wb" if isinstance(content, bytes) else "w"
    with open(folder / name, mode, **({} if mode == "wb" else {"newline": ""})) as f:
        f.write(content)


def read_csv(path):
    out = []
    for part in sorted(glob.glob(f"{path}/part-*.csv")):
        with open(part, newline="") as f:
            out += list(csv.DictReader(f))
    return out


def test_scan_and_type_gate(spark, tmp_path):
    put(tmp_path / "in", "a.pdf", b"%PDF-1.7 x")
    put(tmp_path / "in", "fake.pdf", b"MZ")
    put(tmp_path / "in", "big.pdf", b"%PDF-" + b"x" * 100)
    put(tmp_path / "in", "note.txt", b"%PDF-")
    found = files.scan_files(spark, str(tmp_path / "in"), max_bytes=50)
    gated = files.type_gate(found).select(B.safe_path(F.col("path")).alias("n"), "type_ok", "error_reason")
    assert {tuple(r) for r in gated.collect()} == {
        ("a.pdf", True, None), ("fake.pdf", False, None), ("big.pdf", None, "FILE_TOO_LARGE")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,50)" in plan


def test_json_sources_take_one_object_or_an_array(spark, tmp_path):
    invoice = {"supplier": {"name": "A"}, "line_items": [{"description": "d", "qty": "1"}]}
    put(tmp_path / "s", "one.json", json.dumps(invoice, indent=1))
    put(tmp_path / "s", "many.json", json.dumps([invoice, invoice], indent=1))
    put(tmp_path / "s", "broken.json", "{ no")
    got = files.read_structured(spark, str(tmp_path / "s"), multi_line=True).cache()
    assert {(r.supplier and r.supplier.name, r.error_reason) for r in got.collect()} == {
        ("A", None), (None, "MALFORMED_JSON")}
    assert got.count() == 4
    raw = {"file": "f", "pages": [{"page": 1, "tables": [[["a", "b"]]], "text_blocks": ["t"]}]}
    put(tmp_path / "r", "raw.json", json.dumps(raw, indent=1))
    back = files.read_raw_extraction(spark, str(tmp_path / "r"), multi_line=True)
    assert back.first().pages[0].tables == [[["a", "b"]]]


def test_structured_sink_and_source_hold_every_row(spark, tmp_path):
    rows = spark.range(500).select(F.struct(F.concat(F.lit("A"), "id").alias("name")).alias("supplier"))
    sinks.write_structured(rows.coalesce(1), str(tmp_path / "out"))
    put(tmp_path / "out", "part-x.json", '{"supplier": {"name": "B"}}\n{ no\n')
    back = files.read_structured(spark, str(tmp_path / "out")).cache()
    assert back.count() == 502 and back.where("error_reason is null").count() == 501
    assert {r[0] for r in back.select("supplier.name").collect()} == {f"A{i}" for i in range(500)} | {"B", None}


def test_candidates_from_files(spark, tmp_path):
    put(tmp_path / "c", "page2_x.txt", "a\nb")
    put(tmp_path / "c", "page_2_x.txt", "skipped")
    put(tmp_path / "c", "page3_x.md", "skipped")
    got = files.read_candidates(spark, str(tmp_path / "c")).collect()
    assert [(r.file_name, r.page_no, r.text) for r in got] == [("page2_x.txt", 2, "a\nb")]


def test_candidate_sink_skips_blank(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a", "x"), (1, "b", " \n"), (2, "a", None)],
                                  "page_no int, variant string, text string")
    sinks.write_candidates(frame, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert [(r.page_no, r.variant) for r in back.collect()] == [(1, "a")]


@pytest.fixture
def landed(spark, tmp_path):
    folder = tmp_path / "land"
    for n, name in enumerate(("a", "b", "c")):
        put(folder, f"{name}.txt", INVOICE.format(n))
    put(folder, "copy.txt", INVOICE.format(0))
    put(folder, "short.txt", "x")
    put(folder, "bad.txt", INVOICE.format(9).replace("Bill To\n", "") + "\nBill To")
    return folder


def batch_records(spark, folder):
    docs = files.read_texts(spark, str(folder)).withColumn("fallback_text", F.lit(""))
    return extract_record(prepare(docs), RUN)


def test_exports(spark, tmp_path, landed):
    records = batch_records(spark, landed).drop("error_reason")
    sinks.export_records(records, str(tmp_path / "csv"))
    got = read_csv(tmp_path / "csv")
    assert len(got) == 6
    assert list(got[0]) == [h for c, h in RECORD_COLUMNS.items() if c != "payment_terms"]
    good = next(r for r in got if r["Filename"] == "b.txt")
    assert good["Vendor Name"] == "'=Acme PVT LTD" and good["Buyer Name"] == 'Buyer, "one"'
    assert good["Grand Total"] == "1250.00" and good["Raw OCR Text"].count("\n") == 5
    with pytest.raises(ValueError, match="No data to export"):
        sinks.export_records(records.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_store_roundtrip(spark, tmp_path, landed):
    key = B.key_column(spark, B.derive_key(b"k", b"s", rounds=1000))
    docs = files.read_texts(spark, str(landed)).withColumn("fallback_text", F.lit(""))
    hashed = prepare(docs).withColumn("file_hash", B.content_hash(F.col("raw_text")))
    records = extract_record(hashed, RUN, keys=("file_hash",)).drop("error_reason")
    stored = to_store(records, F.col("file_hash"), RUN, key, keys=())
    path = str(tmp_path / "store")
    sinks.append_to_store(stored, None, path, "file_hash", ["filename"])
    once = spark.read.parquet(path)
    assert once.count() == 5
    sinks.append_to_store(stored, once, path, "file_hash", ["filename"])
    back = spark.read.parquet(path)
    assert back.count() == 5
    assert {r.filename for r in back.where("invoice_number = '0'").collect()} == {"a.txt"}
    plain = back.where("filename = 'b.txt'").select(B.decrypt(F.col("json_data_enc"), key)).first()[0]
    assert json.loads(plain)["invoice_no"] == "1"
    assert sinks.export_store(back, str(tmp_path / "out")) == 5
    rows = read_csv(tmp_path / "out")
    assert len(rows) == 5 and list(rows[0]) == list(STORE_EXPORT.values())
    assert sinks.export_store(back.limit(0), str(tmp_path / "empty")) == 0
    assert not (tmp_path / "empty").exists()


def test_stream_equals_batch(spark, tmp_path, landed):
    docs = ingest.read_text_stream(spark, str(landed), max_files=2)
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    ingest.ingest_stream(docs, out, log, RUN).awaitTermination()
    want = batch_records(spark, landed)
    got = spark.read.parquet(out).select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    put(landed, "late.txt", INVOICE.format(77))
    ingest.ingest_stream(docs, out, log, RUN).awaitTermination()
    assert spark.read.parquet(out).count() == 7


def stream_of(spark, folder):
    docs = ingest.read_text_stream(spark, str(folder), max_files=1)
    return docs.select("path", B.content_hash(F.col("raw_text")).alias("h"))


def test_store_stream_keeps_the_first_across_runs(spark, tmp_path, landed):
    out, log = str(tmp_path / "store"), str(tmp_path / "log")
    ingest.store_stream(stream_of(spark, landed), out, log, "h", ["path"]).awaitTermination()
    assert spark.read.parquet(out).count() == 5
    put(landed, "again.txt", INVOICE.format(1))
    put(landed, "new.txt", INVOICE.format(50))
    ingest.store_stream(stream_of(spark, landed), out, log, "h", ["path"]).awaitTermination()
    back = spark.read.parquet(out)
    assert back.count() == 6 and back.select("h").distinct().count() == 6


def drain(df, out, log):
    (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", log)
     .trigger(availableNow=True).start().awaitTermination())


def test_first_seen(spark, tmp_path, landed):
    drain(ingest.first_seen(stream_of(spark, landed), "h"), str(tmp_path / "o"), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 5
    timed = stream_of(spark, landed).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000)))
    drain(ingest.first_seen(timed, "h", "at"), str(tmp_path / "o2"), str(tmp_path / "l2"))
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 5


def test_status_stream(spark, tmp_path, landed):
    docs = ingest.read_text_stream(spark, str(landed))
    counts = ingest.status_counts(extract_record(prepare(docs), RUN))
    query = (counts.writeStream.outputMode("complete").format("memory").queryName("counts")
             .option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("counts").collect()} == {("PROCESSED", 5), ("ERROR", 1)}


def test_materialize_keeps_rows_and_schema(spark):
    frame = spark.range(10).withColumn("x", F.col("id").cast("decimal(18,2)"))
    back = materialize(frame, "test")
    assert back.dtypes == frame.dtypes and back.count() == 10


@pytest.fixture
def tables(spark, tmp_path):
    day = datetime(2020, 1, 2)
    rows = {
        "orders": ([(k, k % 3 or None, day) for k in range(1, 90)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "lineitem": ([(k, n, k + n, k % 2 + 1, 2.0, 10.5 * n) for k in range(1, 80) for n in (1, 2)],
                     "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double"),
        "customer": ([(1, "C1", 5, "S"), (2, "C2", 6, "S"), (2, "C2 again", 7, "S")],
                     "c_custkey long, c_name string, c_nationkey long, c_mktsegment string"),
        "supplier": ([(1, "V1", 3)], "s_suppkey long, s_name string, s_nationkey long"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "t" / f"{name}.parquet"))
    return str(tmp_path / "t")


def test_ingested_texts_leave_the_disk_batch_by_batch(spark, tmp_path, tables, monkeypatch):
    monkeypatch.setattr(queries, "shared_dir", lambda _, purpose: str(tmp_path / purpose))
    monkeypatch.setattr(queries, "BATCH_BYTES", 1)  # a file a batch
    monkeypatch.setattr(queries, "invoice_text", lambda *a: invoices.invoice_text(*a).repartition(3))
    made = queries.stream_ingest(spark, tables)
    want = queries.extract_record_a(spark, tables).select(*made.columns)
    assert made.count() == want.count() > 100 and made.exceptAll(want).isEmpty()
    assert len([n for n in (tmp_path / "progress" / "commits").iterdir() if n.name.isdigit()]) > 2
    assert not (tmp_path / "landing").exists()
    assert all(n.name.endswith(".zstd.parquet") for n in (tmp_path / "records").glob("part-*"))


def test_a_landed_table_leaves_no_shuffle_files(spark, tmp_path, tables, monkeypatch):
    monkeypatch.setattr(queries, "shared_dir", lambda _, purpose: str(tmp_path / purpose))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(key), []
    monkeypatch.setattr(queries, "invoice_text", lambda *a: seen.append(spark.conf.get(key)) or invoices.invoice_text(*a))
    landed = spark.read.parquet(queries._landed_invoices(spark, tables))
    assert seen == ["true"] and spark.conf.get(key) == before
    assert landed.exceptAll(invoices.invoice_text(spark, tables)).isEmpty() and landed.count() > 100


def test_items_are_not_moved_by_customer(spark, tables):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = invoices.invoice_text(spark, tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    moved = plan.split("Exchange hashpartitioning(o_custkey")[1].split("Exchange hashpartitioning(c_custkey")[0]
    assert "collect_list" in plan and "collect_list" not in moved

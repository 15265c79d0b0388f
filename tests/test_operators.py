"""Operators over several rows, against brute force on small tables."""

import random
import statistics
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from billsift import functions as B
from billsift.operators import candidates, dedupe, documents, fraud, records, store, structured, validate
from billsift.schemas import RAW_EXTRACTION, STORE_DEFAULTS


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# ---- documents --------------------------------------------------------------

@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        [(1, 2, "b"), (1, 1, "a"), (1, 3, ""), (2, 1, None), (3, 1, "x"), (3, 2, "y"), (3, 3, "z"),
         (3, 4, "w")],
        "doc int, page int, text string",
    )


def test_fold_pages(pages):
    got = rows(documents.fold_pages(pages, "doc", "page", "text", max_pages=3), "doc")
    assert got == [(1, 3, "a\nb\n", None), (2, 1, "", None), (3, 4, None, "TOO_MANY_PAGES")]


def test_fold_pages_empty(pages):
    assert documents.fold_pages(pages.limit(0), "doc", "page", "text").count() == 0


def test_fold_pages_without_a_limit_and_over_blocks(spark, pages):
    got = rows(documents.fold_pages(pages, "doc", "page", "text"), "doc")
    assert got == [(1, 3, "a\nb\n", None), (2, 1, "", None), (3, 4, "x\ny\nz\nw\n", None)]
    many = [(1, n, str(n)) for n in range(3000, 0, -1)] + [(1, None, "first")]
    long = spark.createDataFrame(many, "doc int, page int, text string").repartition(5)
    row = documents.fold_pages(long, "doc", "page", "text").first()
    assert row.n_pages == 3001 and row.raw_text == "first\n" + "".join(f"{n}\n" for n in range(1, 3001))


def test_page_gate(pages):
    kept, rejected = documents.page_gate(pages, "doc", 3)
    assert {r.doc for r in kept.collect()} == {1, 2}
    assert rows(rejected, "doc") == [(3, 4)]
    kept, rejected = documents.page_gate(pages, "doc", 2)
    assert {r.doc for r in kept.collect()} == {2}
    assert rows(rejected, "doc") == [(1, 3), (3, 4)]


def test_route_with_pages(spark, pages):
    long = "t" * 50
    docs = spark.createDataFrame(
        [(1, "short", 7), (2, long, 8), (3, " " * 80, 9), (9, None, 1)],
        "doc int, body string, extra int",
    )
    turns = pages.withColumnRenamed("text", "page_text")
    got = documents.route_with_pages(docs, turns, "doc", "body", "page", "page_text")
    assert rows(got.select("doc", "body", "extra", "ocr_method"), "doc") == [
        (1, "shorta\nb\n", 7, "OCR"),
        (2, long, 8, "TEXT"),
        (3, " " * 80 + "x\ny\nz\nw\n", 9, "OCR"),
        (9, "", 1, "OCR"),
    ]


def test_extractor_hook_keeps_going(spark):
    files = spark.createDataFrame(
        [("a", b"one\ftwo"), ("b", b"\xff")], "path string, content binary"
    )
    got = documents.extract_pages(files, lambda content: content.decode().split("\f"))
    assert rows(got, "path", "page_no") == [
        ("a", 1, "one", None), ("a", 2, "two", None), ("b", None, None, "UnicodeDecodeError"),
    ]


def test_reasons_reach_the_record(spark):
    """Unreadable and refused files end as error records, the others as records."""
    files = spark.createDataFrame(
        [("in/a.pdf", bytearray(b"Acme PVT LTD\fInvoice No: 7 and enough text to be no scan at all"), None),
         ("in/b.pdf", bytearray(b"\xff"), None), ("in/c.pdf", None, "FILE_TOO_LARGE")],
        "path string, content binary, error_reason string")
    pages = documents.extract_pages(files, lambda content: content.decode().split("\f"))
    docs = documents.fold_pages(pages, "path", "page_no", "page_text").withColumn("fallback_text", F.lit(""))
    got = records.extract_record(documents.prepare(docs), datetime(2024, 1, 1)).orderBy("filename").collect()
    assert [(r.filename, r.status, r.vendor_name, r.invoice_no, r.error_reason) for r in got] == [
        ("a.pdf", "PROCESSED", "Acme PVT LTD", "7 and enough text to be no scan at all", None),
        ("b.pdf", "ERROR", "N/A", None, "UnicodeDecodeError"),
        ("c.pdf", "ERROR", "N/A", None, "FILE_TOO_LARGE")]
    kept = store.to_store(records.extract_record(documents.prepare(docs), datetime(2024, 1, 1)), F.lit("h"), datetime(2024, 1, 1))
    assert [r.filename for r in kept.collect()] == ["a.pdf"]


def test_fallback_reasons_are_kept(spark):
    docs = spark.createDataFrame([(1, "short"), (2, "x" * 60)], "doc int, body string")
    pages = spark.createDataFrame([(1, None, None, "BROKEN")], "doc int, page int, t string, error_reason string")
    got = documents.route_with_pages(docs, pages, "doc", "body", "page", "t").orderBy("doc").collect()
    assert [(r.doc, r.error_reason) for r in got] == [(1, "BROKEN"), (2, None)]


# ---- duplicates -------------------------------------------------------------

@pytest.fixture(scope="module")
def hashed(spark):
    data = [(i, "hot") for i in range(40)] + [(100, "b"), (101, "b"), (102, "c")]
    data += [(200 + i, None) for i in range(5)]
    return spark.createDataFrame(data, "id int, h string").repartition(4)


def test_first_by_hash_keeps_every_row_without_hash(hashed):
    got = {r.id for r in dedupe.first_by_hash(hashed, "h", ["id"]).collect()}
    assert got == {0, 100, 102, 200, 201, 202, 203, 204}


@pytest.mark.parametrize("skew", ["1b", "256m"])
def test_find_duplicates(spark, hashed, skew):
    keys = ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k) for k in keys]
    for key, value in zip(keys, (skew, "-1")):
        spark.conf.set(key, value)
    got = rows(dedupe.find_duplicates(hashed, "h"), "id")
    for key, value in zip(keys, before):
        spark.conf.set(key, value)
    assert got == [(i, "hot", 40) for i in range(40)] + [(100, "b", 2), (101, "b", 2)]


def test_blank_and_null_hashes_stay_apart(spark):
    batch = spark.createDataFrame([(1, ""), (2, None), (3, None)], "id int, h string")
    store_ = spark.createDataFrame([(9, None)], "id int, h string")
    assert {r.id for r in dedupe.append_new(batch, store_, "h", ["id"]).collect()} == {1, 2, 3}
    blank = spark.createDataFrame([(9, "")], "id int, h string")
    assert {r.id for r in dedupe.append_new(batch, blank, "h", ["id"]).collect()} == {2, 3}
    assert dedupe.find_duplicates(batch, "h").count() == 0
    assert dedupe.first_by_hash(batch, "h", ["id"]).count() == 3


def test_append_new_is_idempotent(hashed):
    first = dedupe.append_new(hashed, hashed.limit(0), "h", ["id"])
    assert first.count() == 8
    again = dedupe.append_new(hashed, first, "h", ["id"])
    assert {r.id for r in again.collect()} == {200, 201, 202, 203, 204}


def test_status_summary(spark):
    data = [("a", "PROCESSED")] * 5 + [("b", "PROCESSED"), ("c", "ERROR"), ("c", "ERROR")]
    data += [(None, "PROCESSED"), (None, "PROCESSED")]
    got = store.status_summary(spark.createDataFrame(data, "h string, status string"), "h")
    assert dict(rows(got, "status")) == {"PROCESSED": 4, "DUPLICATE": 4, "ERROR": 2}


# ---- checks -----------------------------------------------------------------

def money(spark, *data):
    return spark.createDataFrame(
        data, "id int, grand_total decimal(18,2), items array<struct<amount: decimal(18,2)>>"
    )


def test_reconcile_totals(spark):
    d = Decimal
    frame = money(spark, (1, d("3.00"), [(d("1.00"),), (d("2.00"),)]), (2, d("3.01"), [(d("3.00"),)]),
                  (3, None, []), (4, d("0.00"), []), (5, d("1.00"), [(None,), (d("1.00"),)]))
    exact = validate.reconcile_totals(frame).orderBy("id").collect()
    assert [r.reconciles for r in exact] == [True, False, None, True, True]
    loose = validate.reconcile_totals(frame, "0.01").orderBy("id").collect()
    assert [r.reconciles for r in loose] == [True, True, None, True, True]


def test_tax_check_and_future_date(spark):
    frame = spark.sql("""
        SELECT 1 AS id, 100.00BD AS subtotal, 9 AS cgst_rate, 9 AS sgst_rate,
          9.00BD AS cgst_amount, 9.02BD AS sgst_amount, DATE '2024-01-02' AS invoice_date
        UNION ALL SELECT 2, NULL, 9, NULL, 9.00BD, 1.00BD, NULL""")
    got = validate.future_dated(validate.tax_check(frame), date(2024, 1, 1)).orderBy("id")
    assert [(r.cgst_ok, r.sgst_ok, r.future_dated) for r in got.collect()] == [
        (True, False, True), (None, None, False)]


def test_fraud_bank_account(spark):
    seen = spark.createDataFrame(
        [(1, "g1", "5"), (2, "g1", "6"), (3, "g2", None), (4, "", "5")],
        "id int, vendor_gstin string, account_number string",
    )
    master = spark.createDataFrame(
        [("g1", "5"), ("g2", "9")], "gstin string, account_number string"
    )
    got = fraud.fraud_bank_account(seen, master).select("id", "bank_check")
    assert rows(got, "id") == [
        (1, "MATCH"), (2, "MISMATCH"), (3, "MISMATCH"), (4, "UNKNOWN_VENDOR")]


@pytest.mark.parametrize("bits", [2, 20])
def test_vendor_baseline_with_a_hot_vendor(spark, bits):
    rng = random.Random(7)
    data = [
        (k, "hot" if k % 3 else f"v{k % 5}", date(2024, 1, 1 + rng.randrange(4)),
         Decimal(rng.randrange(100, 100000)) / 100)
        for k in range(400)
    ]
    rng.shuffle(data)
    frame = spark.createDataFrame(data, "k bigint, v string, d date, a decimal(18,2)")
    got = fraud.vendor_baseline(frame.repartition(5), "v", "d", "k", "a", k=1.5, block_bits=bits)
    want = {}
    for k, v, d, a in data:
        earlier = [float(x[3]) for x in data if x[1] == v and (x[2], x[0]) < (d, k)]
        mean = statistics.fmean(earlier) if earlier else None
        dev = statistics.stdev(earlier) if len(earlier) > 1 else None
        want[k] = (len(earlier), mean, dev)
    for r in got.collect():
        n, mean, dev = want.pop(r.k)
        assert r.n_prior == n
        assert r.mean_prior == (pytest.approx(mean, abs=0.006) if n else None)
        assert r.stddev_prior == (pytest.approx(dev, abs=0.006) if n > 1 else None)
        flag = n > 1 and abs(float(r.a) - r.mean_prior) > 1.5 * r.stddev_prior
        assert r.out_of_line == flag
    assert not want


# ---- candidates -------------------------------------------------------------

def test_best_candidate(spark):
    data = [
        (1, "b", "good words"), (1, "a", "good words"), (1, "c", "##"),
        (2, "a", "###"), (2, "b", "####"),
        (3, "a", ""),
    ]
    frame = spark.createDataFrame(data, "page int, variant string, text string").repartition(3)
    got = rows(candidates.best_candidate(frame, ["page"], "variant", "text"), "page")
    assert got == [(1, 3, "a", 12, "good words"), (2, 2, "", -2, ""), (3, 1, "a", 0, "")]


def test_param_grid_and_names(spark):
    pages = spark.createDataFrame([(1,), (12,)], "page_no int")
    grid = candidates.param_grid(pages, "page_no")
    assert grid.count() == 2 * 432 and grid.select("variant").distinct().count() == 2 * 432
    assert grid.where(
        "variant = 'page12_dpi300_textline1_td0.5_bt0.7_prepclahe'").count() == 1
    named = grid.select(F.concat("variant", F.lit(".txt")).alias("file_name"))
    parsed = candidates.candidate_parse(named.unionByName(
        spark.createDataFrame([("page_1_oem.txt",), ("notes.txt",)], "file_name string")))
    assert {r.page_no for r in parsed.collect()} == {1, 12} and parsed.count() == 864


def test_engine_variants(spark):
    pages = spark.createDataFrame([(1,)], "page_no int")
    slugs = [r.slug for r in candidates.engine_variants(pages, "page_no").collect()]
    assert len(set(slugs)) == 13 and "oem_1_psm_6_-l_eng_osd" in slugs


# ---- store ------------------------------------------------------------------

def test_default_fill(spark):
    schema = ", ".join(f"{c} string" for c in STORE_DEFAULTS)
    frame = spark.createDataFrame([(None,) * 9, ("x",) * 9, ("",) * 9], schema)
    got = {tuple(r) for r in store.default_fill(frame).collect()}
    assert got == {tuple(STORE_DEFAULTS.values()), ("x",) * 9, ("",) * 9}


def test_column_widths(spark):
    frame = spark.createDataFrame([("a" * 80, None), ("b", None)], "short string, `a long name` string")
    assert rows(store.column_widths(frame), "position") == [(1, "short", 60), (2, "a long name", 13)]
    wide = spark.range(1).select(*[F.lit("x").alias(f"c{i}") for i in range(30)])
    assert store.column_widths(wide).count() == 26


def test_audit_log(spark):
    frame = spark.createDataFrame([("f", "t")], "name string, text string")
    got = store.audit_log(frame, F.col("name"), B.content_hash(F.col("text")), "EXTRACT",
                          datetime(2024, 1, 2, 3, 4)).first()
    assert got.filename == "f" and got.ts == "2024-01-02 03:04" and len(got.file_hash) == 64


def test_review_queue(spark):
    frame = spark.createDataFrame([(None, None, "ERROR")],
                                  "filename string, vendor_name string, status string")
    assert rows(store.review_queue(frame), "status") == [("Unknown", "Unknown", "ERROR")]


# ---- structured -------------------------------------------------------------

RAW = ("doc.pdf", [(1,
    [[["1 Bolt", "7318", "25 NOS", "40.50"]], [["Invoice No.", "77/A"], ["Only", "one"]]],
    ["For the BUYER", "Acme PVT LTD", "GSTIN 27ABCDE1234F1Z5 on 05-06-2024", "spare", "spare"])])


def test_raw_lines_and_structured(spark):
    frame = spark.createDataFrame([RAW], RAW_EXTRACTION)
    lined = frame.select("file", structured.raw_lines(F.col("pages")).alias("lines"))
    assert lined.first().lines == [
        "For the BUYER", "Acme PVT LTD", "GSTIN 27ABCDE1234F1Z5 on 05-06-2024", "spare", "spare",
        "1 Bolt 7318 25 NOS 40.50", "Invoice No. 77/A", "Only one",
    ]
    made = structured.structured_build(lined, ("file",))
    r = made.first()
    assert r.supplier.name == "Acme PVT LTD" and r.supplier.gstin == "27ABCDE1234F1Z5"
    assert r.buyer.name == "For the BUYER" and r.invoice_meta.invoice_no == "77/A"
    assert r.invoice_meta.invoice_date == "05-06-2024"
    assert r.invoice_meta.place_of_supply == "Unknown" and r.totals.amount_in_words == "Only one"
    assert [tuple(x) for x in r.line_items] == [
        ("1 Bolt 7318 25 NOS 40.50", "7318", "1", "", "1", "1")]
    assert r.declarations == ["GSTIN 27ABCDE1234F1Z5 on 05-06-2024", "spare", "spare",
                              "1 Bolt 7318 25 NOS 40.50", "Invoice No. 77/A"]
    flat = structured.structured_flatten(made, ("file",)).first()
    assert flat.vendor_name == "Acme PVT LTD" and flat.po_no == ""

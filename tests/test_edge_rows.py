"""Hand-written rows for the reading rules' edges."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from billsift import constants as K
from billsift import functions as B
from billsift.operators.documents import prepare
from billsift.operators.records import extract_record, split_errors, union_records
from billsift.schemas import record_columns

RUN = datetime(2024, 1, 2, 3, 4)


def one(spark, value, expression):
    frame = spark.createDataFrame([(value,)], "t string")
    return frame.select(expression(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize("line, parity, strict", [
    ("Grand Total 68062.50", "062.50", "68062.50"),
    ("Grand Total 1,23,456.00", "23456.00", "123456.00"),
    ("Grand Total 80,313.75", "80313.75", "80313.75"),
    ("grand total 9.50 10.25", "10.25", "10.25"),
    ("Grand Total 152.143.123.131", "3.13", ""),
    ("Grand Total none", "", ""),
    (None, "", ""),
])
def test_find_amount(spark, line, parity, strict):
    for mode, want in (("parity", parity), ("strict", strict)):
        got = one(spark, line, lambda t: B.find_amount(B.text_lines(t), "Grand Total", mode))
        assert got == want


def test_find_amount_skips_keyword_lines_without_amount(spark):
    text = "TAX INVOICE\nTaxable 5\nTotal tax 12.00 13.50"
    assert one(spark, text, lambda t: B.find_amount(B.text_lines(t), "Tax")) == "13.50"


@pytest.mark.parametrize("text, rate, amount", [
    ("CGST SGST 9% 9% 6125.63 6125.63", "9", "125.63"),
    ("CGST 9 % 10.00", "", "10.00"),
    ("cgst 2.5% 1.00", "5", "1.00"),
    ("CGST\nCGST 14%", "14", ""),
])
def test_percent(spark, text, rate, amount):
    assert one(spark, text, lambda t: B.find_percent(B.text_lines(t), "CGST")) == rate
    assert one(spark, text, lambda t: B.find_amount(B.text_lines(t), "CGST")) == amount


@pytest.mark.parametrize("text, label, want", [
    ("Due Date:\nnext line", "Due Date", "next line"),
    ("Due Date:", "Due Date", ":"),
    ("Due Date: ", "Due Date", ""),
    ("Due Date   ", "Due Date", ""),
    ("Invoice No. 14", "Invoice No", ". 14"),
    ("due date - 01/02/2024\r\nfoo", "Due Date", "01/02/2024"),
    ("DUE DATE : x y", "Due Date", "x y"),
    ("Due Date : é 5 ", "Due Date", "é 5"),
    ("nothing", "Due Date", ""),
    (None, "Due Date", ""),
])
def test_label_value(spark, text, label, want):
    assert one(spark, text, lambda t: B.label_value(t, label)) == want


def test_label_value_takes_the_first_label_that_matches(spark):
    text = "Order: 5\nRef: 7"
    assert one(spark, text, lambda t: B.label_value(t, "Missing", "Ref", "Order")) == "7"


@pytest.mark.parametrize("text, want", [
    ("Rs.5 Rs 5 ₹5", "INR 5 INR  5 INR 5"),
    ("â‚¹9 Rsx", "INR 9 INR x"),
    ("rs 5", "rs 5"),
    ("", ""),
    (None, None),
])
def test_normalize_currency(spark, text, want):
    assert one(spark, text, B.normalize_currency) == want


@pytest.mark.parametrize("value, want", [
    ("=1+1", "'=1+1"), ("-5", "'-5"), ("@x", "'@x"), ("+a", "'+a"), ("", ""), ("a=b", "a=b"),
    (None, None),
])
def test_sanitize_cell(spark, value, want):
    assert one(spark, value, B.sanitize_cell) == want


def test_lines_strip_every_kind_of_blank(spark):
    text = " a \r\n\n\t\x1c\n b　\n c d \n\x85"
    assert one(spark, text, B.text_lines) == ["a", "b", "c d"]
    assert one(spark, None, B.text_lines) == []
    assert one(spark, " \n ", B.text_lines) == []


def test_items(spark):
    text = "1 Pump 7308 1,250.00\nno item\nPipe 2 x 99.50\n9 % 12.34\n1.23.45.67"
    got = one(spark, text, lambda t: B.items(B.text_lines(t)))
    assert [(x.sr, x.description, x.hsn, x.qty, x.rate, x.amount) for x in got] == [
        (1, "1 Pump 7308 1,250.00", "", "1", "1250.00", "1250.00"),
        (2, "Pipe 2 x 99.50", "", "1", "99.50", "99.50"),
        (3, "9 % 12.34", "", "1", "12.34", "12.34"),
    ]


def test_parties(spark):
    text = "Head\nAcme pvt co\nB LTD\nto: INVOICE TO here\nBuyer\na\nb\nc\nd\ne\nBill to\nlast"
    lines = B.text_lines
    assert one(spark, text, lambda t: B.vendor_name(lines(t))) == "Acme pvt co"
    assert one(spark, text, lambda t: B.vendor_address(lines(t))) == (
        "Acme pvt co B LTD to: INVOICE TO here Buyer a")
    at = lambda t: B.anchor_position(lines(t))
    assert one(spark, text, at) == 4
    assert one(spark, text, lambda t: B.buyer_name(lines(t), at(t))) == "Buyer"
    assert one(spark, text, lambda t: B.buyer_address(lines(t), at(t))) == "a b c d"
    assert one(spark, "x\ny", at) == 0
    assert one(spark, "", at) == 0
    assert one(spark, "x\ny", lambda t: B.buyer_name(lines(t), at(t))) == ""


def test_buyer_gstin(spark):
    text = "GSTIN: 27ABCDE1234F1Z5\nx\nBuyer 29ABCDE1234F1Z5 27ABCDE1234F1Z5"
    lines = B.text_lines
    assert one(spark, text, lambda t: B.buyer_gstin(lines(t))) == "GSTIN: 27ABCDE1234F1Z5"
    assert one(spark, text, lambda t: B.buyer_gstin(lines(t), "strict")) == "29ABCDE1234F1Z5"
    assert one(spark, "none", lambda t: B.buyer_gstin(lines(t))) == ""


def test_find_contains_prefers_line_order_then_key_order(spark):
    lines = B.text_lines
    text = "a beta\nalpha beta"
    assert one(spark, text, lambda t: B.find_contains(lines(t), ("ALPHA", "BETA"))) == "BETA"
    assert one(spark, "beta alpha", lambda t: B.find_contains(lines(t), ("ALPHA", "BETA"))) == "ALPHA"
    assert one(spark, "tax invoice", lambda t: B.find_contains(lines(t), K.INVOICE_TYPE_KEYS)) == (
        "TAX INVOICE")


def test_typed_values(spark):
    assert str(one(spark, "1,234.50", B.to_money)) == "1234.50"
    assert one(spark, "x", B.to_money) is None
    assert str(one(spark, "05-06-2024", B.to_day)) == "2024-06-05"
    assert str(one(spark, "05/06/2024", B.to_day)) == "2024-06-05"
    assert one(spark, "31/31/2024", B.to_day) is None
    assert one(spark, "", B.to_rate) is None


def test_quality_score(spark):
    assert one(spark, "ab c", B.quality_score) == 2 + 4
    assert one(spark, "#é#", B.quality_score) == 1 - 3
    assert one(spark, "", B.quality_score) == 0
    assert one(spark, "a b", B.quality_score) == 2 + 3


def test_variant_slug(spark):
    setting = "--oem 1 --psm 6 -l eng+osd"
    assert one(spark, setting, B.variant_slug) == "oem_1_psm_6_-l_eng_osd"
    setting = "--oem 1 -c white=0123,."
    assert one(spark, setting, B.variant_slug) == "oem_1_-c_white0123."


def test_redact(spark):
    text = "mail a.b@c.org id 27ABCDE1234F1Z5 acc 123456789012 sum 1,234.50"
    assert one(spark, text, B.redact) == "mail [EMAIL] id [GSTIN] acc [ACCOUNT] sum [AMOUNT]"


def test_encryption(spark):
    key = B.key_column(spark, B.derive_key(b"pass", b"salt", rounds=1000))
    other = B.key_column(spark, B.derive_key(b"pass", b"other", rounds=1000))
    assert one(spark, "häß", lambda t: B.decrypt(B.encrypt(t, key), key)) == "häß"
    assert one(spark, "x", lambda t: B.decrypt(B.encrypt(t, key), other)) == K.DECRYPTION_FAILED
    assert one(spark, "junk", lambda t: B.decrypt(t.cast("binary"), key)) == K.DECRYPTION_FAILED
    assert one(spark, "", lambda t: B.encrypt(t, key)) == b""
    assert one(spark, None, lambda t: B.decrypt(B.encrypt(t, key), key)) == ""


def test_key_is_not_in_the_plan(spark):
    secret = b"0123456789abcdef0123456789abcdef"
    key = B.key_column(spark, secret)
    frame = spark.range(1).select(B.encrypt(F.col("id").cast("string"), key).alias("x"))
    plan = frame._jdf.queryExecution().toString()
    assert secret.hex().upper() not in plan.upper() and secret.decode() not in plan


def documents(spark, *rows):
    return spark.createDataFrame(
        [(i, f"in/{i}.txt", t, f) for i, (t, f) in enumerate(rows)],
        "doc_id int, path string, raw_text string, fallback_text string",
    )


def test_record_edges(spark):
    long = "Some company PVT LTD with a text that is long enough\nInvoice No: 7\n"
    docs = documents(
        spark, (long, None), (long + "Bill To", None), (None, None), ("   short ", "Invoice No: 8\n"),
        (" " * 60, "Branch: x"), ("", ""),
    )
    rows = {r.doc_id: r for r in extract_record(prepare(docs), RUN, keys=("doc_id",)).collect()}
    assert rows[0].invoice_no == "7" and rows[0].ocr_method == "TEXT" and rows[0].error_reason is None
    assert rows[0].processed_on == "02-01-2024 03:04" and rows[0].filename == "0.txt"
    failed = rows[1].asDict()
    assert failed["vendor_name"] == "N/A" and failed["status"] == "ERROR"
    known = {"doc_id", "filename", "vendor_name", "status", "error_reason"}
    assert all(v is None for k, v in failed.items() if k not in known)
    assert rows[2].status == "PROCESSED" and rows[2].raw_text == "" and rows[2].ocr_method == "OCR"
    assert rows[3].invoice_no == "8" and rows[3].ocr_method == "OCR"
    assert rows[4].branch == "x" and rows[5].item_sr_nos == ""


def test_record_shape(spark):
    docs = documents(spark, ("x", None))
    for profile, width in (("a", 38), ("b", 39)):
        record = extract_record(prepare(docs), RUN, profile)
        assert record.columns == record_columns(profile) + ["error_reason"]
        assert len(record_columns(profile)) == width
        assert extract_record(prepare(docs.limit(0)), RUN, profile).count() == 0


def test_profiles_differ(spark):
    text = (
        "A PRIVATE firm\nB LTD\nPAN: ZZ 1\nGSTIN 27ABCDE1234F1Z5\nBill To\nbuyer one\nx\n"
        "Invoice To\nbuyer two\nPayment Terms: 30\nTax 1.00\nTotal Tax 2.00\nTotal 3.00\n"
        "Sub Total 4.00\nCGST 9%\nBank Name: N\nAccount No: 77\nIFSC: CODE\n987654321"
    )
    docs = prepare(documents(spark, (text, None)))
    a, b = (extract_record(docs, RUN, p).first() for p in "ab")
    assert (a.vendor_name, b.vendor_name) == ("A PRIVATE firm", "B LTD")
    assert (a.buyer_name, b.buyer_name) == ("buyer one", "buyer two")
    assert (a.vendor_pan, b.vendor_pan) == ("ABCDE1234F", "ZZ 1")
    assert (a.total_tax, b.total_tax) == ("1.00", "2.00")
    assert (a.subtotal, b.subtotal) == ("4.00", "2.00")
    assert (a.sgst_rate, b.sgst_rate) == ("9", "")
    assert (a.bank_name, b.bank_name) == ("Name: N", "N")
    assert (a.account_number, b.account_number) == ("987654321", "77")
    assert (a.ifsc_code, b.ifsc_code) == ("", "CODE")
    assert b.payment_terms == "30"


def test_split_and_union(spark):
    docs = documents(spark, ("a text that is long enough to be read without fallback\nx", None),
                     ("another text that is long enough to be read, with an end\nBill to", None))
    good, bad = split_errors(extract_record(prepare(docs), RUN))
    merged = union_records(good, bad)
    assert merged.count() == 2
    assert merged.columns == record_columns("a") + ["error_reason"]
    error = merged.where("status = 'ERROR'").first()
    assert error.filename == "1.txt" and error.invoice_no is None


def test_label_value_searches_once(spark):
    frame = spark.createDataFrame([("Due Date:\nx",)], "t string").select(B.label_value(F.col("t"), "Due Date").alias("v"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 2 and plan.count("locate(") == 1  # plain and other texts

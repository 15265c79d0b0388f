"""Strict reading on hand-written lines, with the answers worked out by hand."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from billsift.functions import strict as S
from billsift.functions.text import text_lines


def ids(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    found = df.select(S.identifiers(text_lines(F.col("text"))).alias("f")).first()["f"]
    return [(r.line_no, r.kind, r.value) for r in found]


def parts(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    found = df.select(S.sections(text_lines(F.col("text"))).alias("f")).first()["f"]
    return [(r.section, r.first, list(r.lines)) for r in found]


def items(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    found = df.select(S.strict_items(S.sections(text_lines(F.col("text")))).alias("f")).first()["f"]
    return [tuple(r) for r in found]


@pytest.mark.parametrize("text, want", [
    ("GSTIN: 27ABCDE1234F1Z5", [(1, "gstin", "27ABCDE1234F1Z5")]),
    ("PAN ABCDE1234F", [(1, "pan", "ABCDE1234F")]),
    ("Phone: +91 98765 43210\nA/c 123456789012", [(1, "phone", "Phone: +91 98765 43210"), (2, "account", "123456789012")]),
    ("call +919876543210 now", [(1, "phone", "+919876543210")]),
    ("PO No: 700000123 dated 01/02/2024", [(1, "order", "PO No: 700000123"), (1, "date", "01/02/2024")]),
    ("Customer#000000001 and 12-345678901", []),
    ("IFSC: ABCD0123456, a.b@c.example", [(1, "ifsc", "ABCD0123456"), (1, "email", "a.b@c.example")]),
    ("Account 123456789, 987654321.", [(1, "account", "123456789"), (1, "account", "987654321")]),
    ("123456789012345678901", []),
    ("order4me and mail 9876543210@bank.example", [(1, "email", "9876543210@bank.example")]),
    ("", []),
    (None, []),
])
def test_identifiers(spark, text, want):
    assert ids(spark, text) == want


def test_places_count_from_the_line(spark):
    df = spark.createDataFrame([("x\n é 123456789 and 27ABCDE1234F1Z5 123456780",)], "text string")
    found = df.select(S.identifiers(text_lines(F.col("text"))).alias("f")).first()["f"]
    line = "é 123456789 and 27ABCDE1234F1Z5 123456780"
    assert [(r.kind, line[r.start:r.stop]) for r in found] == [
        ("account", "123456789"), ("gstin", "27ABCDE1234F1Z5"), ("account", "123456780")]
    assert all(r.value == line[r.start:r.stop] for r in found)


def test_many_matches_in_one_line(spark):
    text = " ".join(f"{100000000 + n}" for n in range(3000))
    assert [v for _, _, v in ids(spark, text)] == text.split(" ")


def test_each_pattern_is_sought_once_and_in_all_lines_at_a_time(spark):
    df = spark.createDataFrame([(["PO 1"],)], "l array<string>").select(S.identifiers(F.col("l")).alias("f"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(pattern) for _, pattern in S.IDENTIFIERS] == [1] * len(S.IDENTIFIERS)


def test_identifiers_of_any_lines(spark):
    rows = [(["PO 12", None, "x 12 345", "27ABCDE1234F1Z5 a@b.co1x@y.com"],), (["7\x01 123456789\n01/02/2024", "order 1@b.example"],),
            (["none", "Report po"],), ([],), ([None],), (None,)]
    df = spark.createDataFrame(rows, "l array<string>")
    found = [r[0] and [tuple(x) for x in r[0]] for r in df.select(S.identifiers(F.col("l"))).collect()]
    assert found == [
        [(1, 0, 5, "order", "PO 12"), (4, 0, 15, "gstin", "27ABCDE1234F1Z5"), (4, 16, 22, "email", "a@b.co"),
         (4, 22, 30, "email", "1x@y.com")],
        [(1, 3, 12, "account", "123456789"), (1, 13, 23, "date", "01/02/2024"), (2, 6, 17, "email", "1@b.example")],
        [], [], [], None]


def test_sections(spark):
    text = "ACME PVT LTD\nTAX INVOICE\nTotal pages 2\nBill To\nBob\nSr Description Qty Amount\n1 Total station 1.00\n" \
           "Sub Total 1.00\nCGST 9% 0.09\nBank: X\nAccount 1\nSr Particulars Amount\n2 y 3.00\nTotal 3.00"
    assert parts(spark, text) == [
        ("header", 0, ["ACME PVT LTD", "TAX INVOICE", "Total pages 2"]),
        ("buyer", 3, ["Bill To", "Bob"]),
        ("items", 5, ["Sr Description Qty Amount", "1 Total station 1.00"]),
        ("totals", 7, ["Sub Total 1.00", "CGST 9% 0.09"]),
        ("bank", 9, ["Bank: X", "Account 1"]),
        ("items", 11, ["Sr Particulars Amount", "2 y 3.00"]),
        ("totals", 13, ["Total 3.00"])]


def test_sections_of_short_texts(spark):
    assert parts(spark, None) == [] and parts(spark, " \n ") == []
    assert parts(spark, "Bill To") == [("buyer", 0, ["Bill To"])]
    assert parts(spark, "Sub Total 5.00") == [("header", 0, ["Sub Total 5.00"])]


def test_all_lines_stay_in_order(spark):
    lines = [f"{w} {n}.00" for n in range(500) for w in ("total", "bank", "plain")]
    text = "\n".join(["Description Amount", *lines])
    found = parts(spark, text)
    assert [x for _, _, own in found for x in own] == text.split("\n")
    assert [first for _, first, _ in found] == [sum(len(o) for _, _, o in found[:i]) for i in range(len(found))]


def test_items_by_their_header(spark):
    text = "Sr Description HSN Qty Rate Amount\n1 Pipe | 10 mm HSN 7306 2 NOS 10.00 20.00\n2. Bolt 731815 3 PCS 1.33 4.00\n" \
           "3 Nut 7318 3 NOS 1.33 5.00\ncontinued text\n4 no code 5 KG 1,000.00 5,000.00"
    d = Decimal
    assert items(spark, text) == [
        (1, "Pipe | 10 mm", "7306", d("2.00"), "NOS", d("10.00"), d("20.00"), True),
        (2, "Bolt", "731815", d("3.00"), "PCS", d("1.33"), d("4.00"), True),
        (3, "Nut", "7318", d("3.00"), "NOS", d("1.33"), d("5.00"), False),
        (4, "no code", None, d("5.00"), "KG", d("1000.00"), d("5000.00"), True)]


def test_items_of_other_headers(spark):
    d = Decimal
    assert items(spark, "Particulars Unit Quantity Total\nCement bags 50 bag 4 99,99,999.00") == [
        (None, "Cement bags 50", None, d("4.00"), "bag", None, d("9999999.00"), None)]
    assert items(spark, "Item Description Quantity Unit Price Amount\nRod 7 m 2.50 17.50") == [
        (None, "Rod", None, d("7.00"), "m", d("2.50"), d("17.50"), True)]
    assert items(spark, "Sr Description Amount") == [] and items(spark, "1 x 5.00") == []


def test_labelled_amounts(spark):
    rows = [(["Total Tax 5.00", "Tax 6.00"],), (["total tax", "Total Tax 1,23,456.70"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "t array<string>")
    got = [r[0] for r in df.select(S.labelled_amount(F.col("t"), r"^total tax\b")).collect()]
    assert got == [Decimal("5.00"), Decimal("123456.70"), None, None]

"""Steps that read a text stand once in a plan, and quick ways around a search change no result."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from billsift import functions as B
from billsift.functions.fields import first_index, joined
from billsift.operators import store, structured
from billsift.operators.documents import prepare
from billsift.operators.records import extract_record

WHOLE = "Acme PVT LTD\nUnit 1\nGSTIN: 27ABCDE1234F1Z5\nTAX INVOICE\nInvoice No: 7\nBill To\nBuyer\n1 Part 10.00\nGrand Total 10.00"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_store_tests_the_reason_after_the_record_is_made(spark):
    docs = spark.createDataFrame(
        [(1, "a.txt", WHOLE, ""), (2, "b.txt", WHOLE + "\nBill To", ""), (3, "c.txt", WHOLE.replace("Bill To", "Bill"), ""),
         (4, "d.txt", "Scan of a long enough text that is no invoice at all\nand ends with its anchor\nBill To", ""),
         (5, "e.txt", None, None)],
        "doc_id long, path string, raw_text string, fallback_text string").repartition(2)
    records = extract_record(prepare(docs), datetime(2024, 1, 2), keys=("doc_id",))
    stored = store.to_store(records, F.lit("h"), datetime(2024, 1, 2), keys=("doc_id",))
    filters = [line for line in _plan(stored.drop("id")).splitlines() if "Filter" in line]
    assert filters and not any("split(" in line for line in filters)
    rows = {r.doc_id: (r.vendor_name, r.grand_total) for r in stored.collect()}
    assert rows == {1: ("Acme PVT LTD", "10.00"), 2: ("Acme PVT LTD", "10.00"), 3: ("Acme PVT LTD", "10.00"), 5: ("", "")}


def test_structured_items_look_for_their_digits_once(spark):
    df = spark.createDataFrame([(["1 Part 7301 12 5.50 10.00", "no item 10.0", "2 B 1234 3 NOS 20.00"],)], "l array<string>")
    read = df.select(B.structured_items(F.col("l")).alias("i"))
    assert _plan(read).count(r"\b\d{1,3}\b") == 1
    assert [tuple(x) for x in read.first().i] == [
        ("1 Part 7301 12 5.50 10.00", "7301", "1", "", "1", "1"), ("2 B 1234 3 NOS 20.00", "1234", "2", "", "2", "2")]


@pytest.mark.parametrize("line, expected", [
    ("1 a 10.00", True), ("1 a 10.00\n", True), ("1 a 10.00 ", False), ("1 a 10.0", False), ("a 10.00", False),
    ("1 a ١٠.٠٠", True), ("", False), (None, None)])
def test_item_lines_end_in_an_amount(spark, line, expected):
    assert spark.createDataFrame([(line,)], "x string").select(B.is_item(F.col("x"))).first()[0] is expected


def test_a_missing_word_gives_a_line_past_any(spark):
    df = spark.createDataFrame([(["a", "b"], "b"), (["a"], "b"), ([], "b")], "l array<string>, w string")
    at = first_index(joined(F.col("l")), ("b",))
    assert [r[0] for r in df.select(F.get("l", at)).collect()] == ["b", None, None]
    assert [r[0] for r in df.select(B.anchor_position(F.col("l"), ("b",))).collect()] == [2, 0, 0]


@pytest.mark.parametrize("text, expected", [
    ("on ١٢/٠٣/٢٠٢٤", "١٢/٠٣/٢٠٢٤"), ("on 12/03/2024", "12/03/2024"), ("", ""), (None, "")])
def test_plain_and_wide_texts_match_alike(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(B.first_match(F.col("t"), r"\d{2}[/-]\d{2}[/-]\d{4}")).first()[0] == expected


def test_numbers_are_read_from_the_first_place_that_can_match(spark):
    lines = {1: ["Invoice No", "PO No. x", "po no: 77"], 2: ["INVOICE NO: é", "PO No 5"], 3: ["nothing"], 4: ["RUPEES ONLY", "commonly"]}
    df = spark.createDataFrame(list(lines.items()), "doc_id long, lines array<string>")
    rows = {r.doc_id: r for r in structured.structured_build(df, ("doc_id",)).collect()}
    assert [(rows[n].invoice_meta.invoice_no, rows[n].invoice_meta.po_no) for n in lines] == [
        ("PO", "77"), ("é", "5"), ("", ""), ("", "")]
    assert rows[4].totals.amount_in_words == "RUPEES ONLY"


def test_used_lines_are_taken_out_by_generated_code(spark):
    lines = {1: ["Acme LTD", "x", "Acme LTD", "Buyer b", "x", "", "CGST 1"], 2: ["x", "bank y", None, "x"], 3: [], 4: None}
    df = spark.createDataFrame(list(lines.items()), "doc_id long, lines array<string>")
    left = structured.structured_build(df, ("doc_id",)).select("doc_id", "declarations")
    assert "array_contains(" not in _plan(left) and "split(" not in _plan(left)
    assert {r[0]: r[1] for r in left.collect()} == {1: ["x", "x"], 2: ["x", "x"], 3: [], 4: None}


def test_the_line_breaks_ahead_of_a_word_are_counted_by_bytes(spark):
    df = spark.createDataFrame([("é\n₹\nb b\n",), ("b\n",), ("\n\n.b",), ("a",), ("",), (None,)], "t string")
    at = df.select(first_index(F.col("t"), ("b",)).alias("n"), first_index(F.col("t"), (".b", "₹")).alias("m"))
    assert "split(" not in _plan(at)
    past = (1 << 31) - 2
    assert [tuple(r) for r in at.collect()] == [(2, 1), (0, past), (2, 2), (past, past), (past, past), (past, past)]


def test_the_tail_of_an_item_line_is_sought_at_its_end_only(spark):
    df = spark.createDataFrame([("1 a 10.00",)], "x string")
    assert "RLIKE(x#" not in _plan(df.select(B.is_item(F.col("x")).alias("i"))).split(r"\d{2}\.\d{2}$")[0]

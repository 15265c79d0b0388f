"""What is found once per text is not sought again per line, label or column."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from billsift import functions as B
from billsift.operators.documents import is_short
from billsift.operators.records import extract_record, typed_record

TEXTS = [None, "", " \n\t\n", "a", " a \n\n\x85 b c　\n\x1cd", "Rs. 5\nRs5 ₹6 â‚¹7 R s",
         "xé \U0001f600\nInvoice No: é7\nInvoice No: 8", "INVOICE NO -\n\n 9\n", "Invoice No", "x" * 300]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, raw_text string")


def test_lines_run_nothing_per_line(texts):
    found = texts.select("raw_text", B.text_lines(F.col("raw_text")).alias("lines"))
    assert "lambda" not in plan_of(found)
    for text, lines in found.collect():
        assert lines == [line.strip() for line in (text or "").split("\n") if line.strip()]


def test_marks_that_are_not_there_are_not_replaced(texts):
    found = texts.select("raw_text", B.normalize_currency(F.col("raw_text")).alias("t"))
    assert "Contains" in plan_of(found)
    for text, made in found.collect():
        for mark in ("₹", "Rs.", "Rs", "â‚¹"):
            text = text and text.replace(mark, "INR ")
        assert made == text


def test_short_by_the_whole_text(texts):
    late = texts.select(F.concat(F.repeat(F.lit(" "), 500), "raw_text").alias("t"))
    assert [r[0] for r in late.select(is_short(F.col("t"))).collect()] == [len((t or "").strip()) < 50 for t in TEXTS]


@pytest.mark.parametrize("profile", ["a", "b"])
def test_a_record_counts_its_characters_once(texts, profile):
    docs = texts.withColumns({"path": F.lit("p"), "ocr_method": F.lit("TEXT")})
    plan = plan_of(extract_record(docs, datetime(2024, 1, 2), profile, keys=("doc_id",)))
    assert plan.count("octet_length") == 1 and "locate(" not in plan


def test_a_typed_record_counts_its_characters_once(texts):
    plan = plan_of(typed_record(texts.withColumn("path", F.lit("p")), ("doc_id",)))
    assert plan.count("octet_length") == 1 and "locate(" not in plan


def test_labels_in_plain_and_other_texts(texts):
    got = [r[0] for r in texts.select(B.label_value(F.col("raw_text"), "Invoice No")).collect()]
    assert got == ["", "", "", "", "", "", "é7", "9", "", ""]

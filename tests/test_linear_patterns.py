"""Patterns on very long texts, and the linear forms against the plain ones."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from billsift import constants as K
from billsift import functions as B

LONG = 1_000_000


@pytest.mark.parametrize("text", [
    "Due Date" + " " * LONG, "Due Date" + "\n" * LONG, "Due Date:" + " \n" * (LONG // 2) + "x", "7" * LONG,
    "a" * LONG, "a@" * (LONG // 2), "a@" + "b" * LONG, "111," * (LONG // 4), "111," * (LONG // 4) + "5 1.00",
    "CGST " + "7" * LONG, "CGST 1.00 " + "111," * (LONG // 4),
], ids=range(11))
def test_time_stays_linear(spark, text):
    frame = spark.createDataFrame([(text,)], "t string")
    lines = B.text_lines(F.col("t"))
    start = time.time()
    frame.select(
        B.label_value(F.col("t"), "Due Date"), B.redact(F.col("t")), B.find_amount(lines, "CGST"),
        B.find_percent(lines, "CGST"), B.find_amount(lines, "CGST", "strict"), B.first_match(F.col("t"), K.DATE),
    ).collect()
    assert time.time() - start < 15


def matches(spark, pattern, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = F.regexp_extract_all("t", F.lit(K.java_regex(pattern)), F.lit(0))
    return [r[1] for r in frame.select("i", found).orderBy("i").collect()]


@pytest.mark.parametrize("plain, linear, signs", [
    (K.AMOUNT, K.AMOUNT_ONCE, "11234,,,..x "), (K.PERCENT, K.PERCENT_ONCE, "12%% x٣"),
    (K.EMAIL, K.EMAIL_ONCE, "ab@@..-_co"),
])
def test_linear_forms_find_the_same(spark, plain, linear, signs):
    rng = random.Random(6)
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(20_000)]
    want = [[m.group(0) for m in re.finditer(plain, t)] for t in texts]
    assert matches(spark, linear, texts) == want
    assert sum(map(len, want)) > 1000


def test_label_at_the_end_of_the_text(spark):
    rng = random.Random(7)
    parts = ["Due Date", "due date", ":", "-", " ", "\n", "x", "\t", "é", "Due"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(8000)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in frame.select("i", B.label_value(F.col("t"), "Due Date")).orderBy("i").collect()]
    for text, value in zip(texts, got):
        found = re.search(r"Due Date\s*[:\-]?\s*(.+)", text, re.I)
        assert value == (found.group(1).strip() if found else ""), repr(text)

"""The reading rules stated in plain Python, against Spark on random texts."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from billsift import constants as K
from billsift import functions as B

PIECES = [
    "Tax", "TAX INVOICE", "Sub Total", "grand total", "CGST", "sgst", "Bill To", "invoice TO", "PVT",
    "ltd", "Private", "Due Date", "due date:", "Bank", "İ", "ß", "ſ", "é", "😀", "₹", "Rs.", "Rs",
    "1,234.50", "68062.50", "12", "9%", "9 %", "٣٤.٥٦", "1.2.3.4", "27ABCDE1234F1Z5", "01/02/2024",
    "123456789", ":", "-", " ", "  ", "\t", " ", " ", "\x1c", "\x85", "\r", "\n", "\n", "\r\n",
    "\n \n", "x", "A1",
]


def texts(n: int) -> list[str]:
    rng = random.Random(20240102)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def first(values, default=""):
    return next(iter(values), default)


def rows(t):
    return list(filter(None, map(str.strip, t.split("\n"))))


def amount(t, word):
    with_both = (re.findall(K.AMOUNT, r) for r in rows(t) if word in r.lower())
    return first(a[-1].replace(",", "") for a in with_both if a)


def percent(t, word):
    hits = (re.search(K.PERCENT, r) for r in rows(t) if word in r.lower())
    return first(h[1] for h in hits if h)


def label(t, name):
    hit = re.compile(name + r"\s*[:\-]?\s*(.+)", re.IGNORECASE).search(t)
    return hit[1].strip() if hit else ""


def item_lines(t):
    return [r for r in rows(t) if re.search(r"\d+\s+.*\d{2}\.\d{2}$", r)]


def vendor(t):
    return first(r for r in rows(t) if set(re.findall("PVT|LTD|PRIVATE", r.upper())))


def anchor(t):
    spots = [n for n, r in enumerate(rows(t), 1) if re.search("invoice to|bill to", r.lower())]
    return first(spots, 0)


def score(t):
    good = sum(1 for c in t if re.fullmatch(K.VALID_CHARACTER, c))
    return len(t.split()) + 2 * good - len(t)


def lines(c):
    return B.text_lines(c)


RULES = {
    "lines": (lines, rows),
    "amount tax": (lambda c: B.find_amount(lines(c), "Tax"), lambda t: amount(t, "tax")),
    "amount total": (lambda c: B.find_amount(lines(c), "Grand Total"),
                     lambda t: amount(t, "grand total")),
    "percent": (lambda c: B.find_percent(lines(c), "CGST"), lambda t: percent(t, "cgst")),
    "label due": (lambda c: B.label_value(c, "Due Date"), lambda t: label(t, "Due Date")),
    "label bank": (lambda c: B.label_value(c, "Bank"), lambda t: label(t, "Bank")),
    "items": (lambda c: F.transform(B.items(lines(c)), lambda x: x["description"]), item_lines),
    "item amounts": (lambda c: B.pipe_join(B.items(lines(c)), "amount"),
                     lambda t: "|".join(re.findall(K.AMOUNT, r)[-1].replace(",", "")
                                        for r in item_lines(t))),
    "vendor": (lambda c: B.vendor_name(lines(c)), vendor),
    "anchor": (lambda c: B.anchor_position(lines(c)), anchor),
    "gstin line": (lambda c: B.buyer_gstin(lines(c)),
                   lambda t: first(r for r in rows(t) if re.search(K.GSTIN, r))),
    "account": (lambda c: B.first_match(c, K.ACCOUNT), lambda t: first(re.findall(K.ACCOUNT, t))),
    "date": (lambda c: B.first_match(c, K.DATE), lambda t: first(re.findall(K.DATE, t))),
    "type": (lambda c: B.find_contains(lines(c), K.INVOICE_TYPE_KEYS),
             lambda t: "TAX INVOICE" if "TAX INVOICE" in t.upper() else ""),
    "score": (B.quality_score, score),
    "strip": (B.strip_ws, str.strip),
}


@pytest.fixture(scope="module")
def sample(spark):
    data = texts(3000)
    frame = spark.createDataFrame(list(enumerate(data)), "i int, t string").repartition(8)
    return data, frame.cache()


@pytest.mark.parametrize("rule", RULES)
def test_rule(sample, rule):
    data, frame = sample
    build, expected = RULES[rule]
    got = {r.i: r.v for r in frame.select("i", build(F.col("t")).alias("v")).collect()}
    wrong = [(t, got[i], expected(t)) for i, t in enumerate(data) if got[i] != expected(t)]
    assert not wrong, (len(wrong), wrong[0])


def test_record_agrees_with_the_single_rules(spark, sample):
    """The record shares work between columns; sharing must not change results."""
    from billsift.operators.records import extract_record

    data, frame = sample
    docs = frame.select(
        "i", F.lit("p/x").alias("path"), F.col("t").alias("raw_text"), F.lit("TEXT").alias("ocr_method")
    )
    for r in extract_record(docs, datetime(2024, 1, 1), keys=("i",)).collect():
        t = data[r.i]
        if anchor(t) and anchor(t) == len(rows(t)):
            assert r.status == "ERROR"
            continue
        assert r.total_tax == amount(t, "tax")
        assert r.grand_total == amount(t, "grand total")
        assert r.cgst_rate == percent(t, "cgst")
        assert r.vendor_name == vendor(t)
        assert r.due_date == label(t, "Due Date")
        assert r.item_descriptions == "|".join(item_lines(t))
        assert r.vendor_address == " ".join(rows(t)[1:6])

"""Line items out of a line array, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billsift import constants as K
from billsift.functions.fields import last_amount

ITEM_TAIL = K.java_regex(r"\d{2}\.\d{2}$")
ITEM_HEAD = K.java_regex(r"\d\s.*\d{2}\.\d{2}$")


def is_item(line: Column) -> Column:
    """A number, a blank, anything, then an amount at the line's end.

    The point near the end and the anchored tail are tested first; they are linear and turn most
    lines away, so the wider pattern never backtracks over a long line that cannot match.
    """
    # third from the end, or fourth where a line break ends the line
    near = F.contains(F.right(line, F.lit(4)), F.lit("."))
    # five signs, or six where a line break ends the line: the tail is sought nowhere else
    return near & F.right(line, F.lit(6)).rlike(ITEM_TAIL) & line.rlike(ITEM_HEAD)


def items(lines: Column, mode: str = "parity") -> Column:
    """``array<struct<sr, description, hsn, qty, rate, amount>>`` in line order.

    Rate and amount are the same value, picked once per item.
    """
    picked = F.transform(
        F.filter(lines, is_item),
        lambda line: F.struct(
            line.alias("description"), last_amount(line, mode).alias("amount")
        ),
    )
    return F.transform(
        picked,
        lambda x, i: F.struct(
            (i + 1).alias("sr"),
            x["description"].alias("description"),
            F.lit("").alias("hsn"),
            F.lit("1").alias("qty"),
            x["amount"].alias("rate"),
            x["amount"].alias("amount"),
        ),
    )


def pipe_join(item_array: Column, field: str) -> Column:
    """One item field as a ``|``-joined string."""
    return F.array_join(F.transform(item_array, lambda x: x[field].cast("string")), "|")


def structured_items(lines: Column) -> Column:
    """Items of the nested form: digits picked by width, all as text."""

    def read(line: Column) -> Column:
        return F.struct(
            line.alias("description"),
            F.regexp_extract(line, K.java_regex(r"\d{4,8}"), 0).alias("hsn"),
            F.regexp_extract(line, K.java_regex(r"\d+"), 0).alias("qty"),
            F.regexp_extract(line, K.java_regex(r"\b\d{1,3}\b"), 0).alias("short"),
        )

    # rate and amount are the same digits, looked for once
    return F.transform(F.transform(F.filter(lines, is_item), read), lambda x: F.struct(
        x["description"].alias("description"),
        x["hsn"].alias("hsn"),
        x["qty"].alias("qty"),
        F.lit("").alias("unit"),
        x["short"].alias("rate"),
        x["short"].alias("amount"),
    ))

"""Vendor and buyer blocks by keyword and by position.

The ``folded`` arguments take the joined, case-folded lines when the caller
has them already; all picks of one record can then share them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from billsift import constants as K
from billsift.functions.fields import extract, first_index, joined
from billsift.functions.text import or_blank


def vendor_name(lines: Column, keywords: tuple[str, ...] = K.VENDOR_KEYWORDS,
                folded: Column | None = None) -> Column:
    """The first line that holds a company keyword."""
    upper = F.upper(joined(lines)) if folded is None else folded
    return or_blank(F.get(lines, first_index(upper, keywords)))


def vendor_address(lines: Column) -> Column:
    """Lines two to six, whatever they hold."""
    return F.array_join(F.slice(lines, 2, 5), " ")


def anchor_position(lines: Column, anchors: tuple[str, ...] = K.BUYER_ANCHORS,
                    folded: Column | None = None) -> Column:
    """1-based position of the first line with a buyer anchor, 0 when none."""
    lower = F.lower(joined(lines)) if folded is None else folded
    spot = first_index(lower, anchors) + 1
    return F.when(spot <= F.size(lines), spot).otherwise(F.lit(0))


def anchor_is_last(lines: Column, position: Column) -> Column:
    """An anchor with no line after it: the document cannot be read."""
    return (position > 0) & (position == F.size(lines))


def buyer_name(lines: Column, position: Column) -> Column:
    """The line after the anchor."""
    return or_blank(F.when(position > 0, F.get(lines, position)))


def buyer_address(lines: Column, position: Column) -> Column:
    """The four lines after the buyer's name."""
    block = F.slice(lines, position + 2, F.lit(4))
    return or_blank(F.when(position > 0, F.array_join(block, " ")))


def buyer_gstin(lines: Column, mode: str = "parity", text: Column | None = None,
                plain: Column | None = None) -> Column:
    """Parity: the whole first line with a GSTIN, often the vendor's.

    Strict: the second distinct GSTIN of the document.
    """
    pattern = F.lit(K.java_regex(K.GSTIN))
    whole = joined(lines) if text is None else text
    if mode == "parity":
        token = extract(whole, K.GSTIN, 0, plain)
        before = F.call_function("substring_index", whole, token, F.lit(1))
        line = F.get(lines, F.array_size(F.split(before, "\n")) - 1)
        return or_blank(F.when(token != "", line))
    tokens = F.regexp_extract_all(whole, pattern, F.lit(0))
    return or_blank(F.get(F.array_distinct(tokens), F.lit(1)))

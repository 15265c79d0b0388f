"""Text to number and date, null when the text is not one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def to_money(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast(MONEY)


def to_rate(text: Column) -> Column:
    return text.try_cast("int")


def to_day(text: Column) -> Column:
    """Day-first dates with ``/`` or ``-``."""
    return F.try_to_timestamp(F.translate(text, "/", "-"), F.lit("dd-MM-yyyy")).cast("date")

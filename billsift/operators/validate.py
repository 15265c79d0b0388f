"""Checks inside one record: arithmetic, tax and date. No shuffle."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUM = "decimal(38,2)"


def reconcile_totals(typed: DataFrame, tol: Decimal | str = "0.00") -> DataFrame:
    """Does the sum of the item amounts equal the grand total?

    The sum folds the item array in place; null when the total is missing.
    """
    items_sum = F.aggregate(
        "items",
        F.lit("0.00").cast(SUM),
        lambda acc, x: (acc + F.coalesce(x["amount"], F.lit("0.00").cast(SUM))).cast(SUM),
    )
    summed = typed.withColumn("items_sum", items_sum)
    gap = F.abs(F.col("items_sum") - F.col("grand_total"))
    return summed.withColumn("reconciles", gap <= F.lit(str(tol)).cast(SUM))


def reconcile_long(items: DataFrame, headers: DataFrame, key: str, amount: str = "amount",
                   total: str = "grand_total", tol: Decimal | str = "0.00") -> DataFrame:
    """Items as a table of their own against the totals of their headers.

    Items are summed by key in each task before they meet, so a header with
    millions of items is a row per task. Headers without items and items without a header
    stay: ``side`` is ``both``, ``no items`` or ``no header``. Rows without a key meet nothing.
    ``reconciles`` is null where a side or the total is missing.
    """
    sums = items.groupBy(F.col(key).alias("_key")).agg(
        F.count("*").alias("n_items"), F.sum(F.col(amount).cast(SUM)).cast(SUM).alias("items_sum"))
    found = headers.join(sums, F.col(key) == F.col("_key"), "full_outer")
    side = F.when(F.col("n_items").isNull(), "no items").when(
        F.col("_key").isNotNull() & F.col(key).isNotNull(), "both").otherwise("no header")
    gap = F.abs(F.col("items_sum") - F.col(total))
    return found.select(
        F.coalesce(key, "_key").alias(key), total, F.coalesce("n_items", F.lit(0)).alias("n_items"), "items_sum",
        side.alias("side"), (gap <= F.lit(str(tol)).cast(SUM)).alias("reconciles"))


def tax_check(typed: DataFrame, tol: Decimal | str = "0.01") -> DataFrame:
    """Does each tax amount equal subtotal x rate, within the tolerance?"""

    def holds(amount: str, rate: str):
        expected = F.round(F.col("subtotal") * F.col(rate) / 100, 2)
        return F.abs(expected - F.col(amount)) <= F.lit(str(tol)).cast(SUM)

    return typed.withColumns({
        "cgst_ok": holds("cgst_amount", "cgst_rate"),
        "sgst_ok": holds("sgst_amount", "sgst_rate"),
    })


def future_dated(typed: DataFrame, run_date: date) -> DataFrame:
    """Is the invoice dated after the run? False when it has no readable date."""
    late = F.coalesce(F.col("invoice_date") > F.lit(run_date), F.lit(False))
    return typed.withColumn("future_dated", late)

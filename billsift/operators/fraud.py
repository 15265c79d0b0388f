"""Checks of a record against its vendor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDE = "decimal(38,4)"
BLOCK_BITS = 20


def fraud_bank_account(typed: DataFrame, vendor_master: DataFrame) -> DataFrame:
    """Compare the account on the invoice with the vendor's own record.

    ``vendor_master`` has one row per GSTIN. Spark broadcasts it while its size
    is under the session's threshold and else sorts and merges, where adaptive
    execution splits a vendor that holds too many invoices.
    """
    master = vendor_master.select(
        F.col("gstin").alias("vendor_gstin"),
        F.col("account_number").alias("master_account"),
    )
    joined = typed.join(master, "vendor_gstin", "left")
    known = F.col("master_account").isNotNull()
    same = F.col("account_number").eqNullSafe(F.col("master_account"))
    return joined.withColumn(
        "bank_check",
        F.when(~known, "UNKNOWN_VENDOR").when(same, "MATCH").otherwise("MISMATCH"),
    )


def _running(columns: list[str], keys: list[str], order: list[str]) -> dict[str, Column]:
    """Totals over all earlier rows of a window."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return {f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0).cast(WIDE)) for c in columns}


def vendor_baseline(df: DataFrame, vendor: str, day: str, key: str, amount: str,
                    k: float = 3.0, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Flag an amount far from the mean of that vendor's own earlier invoices.

    "Earlier" is by ``(day, key)``; ``key`` is a unique integer. One window
    per vendor would put a vendor with a third of all invoices in one task, so
    the running totals are built on three levels, each of bounded size: rows in
    a ``(vendor, day, block of keys)`` (at most 2^``block_bits``), blocks in a
    ``(vendor, day)``, and days in a vendor. A row's total is the sum of the
    three. All sums are exact decimals, so the result does not depend on it.

    Rows without a vendor (null or blank), day or amount stay with ``n_prior = 0``
    and count for no other row. ``df`` is read once.
    """
    totals = ["_n", "_s", "_q"]
    value = F.col(amount).cast("decimal(18,4)")
    spread = df.select(vendor, day, key, amount, F.shiftright(key, block_bits).alias("_block"))
    counts = (F.col(vendor) != "") & F.col(day).isNotNull() & F.col(amount).isNotNull()
    # One shuffle serves the rows' windows and both totals. The joins compare null-safe,
    # so that Spark sees no null filter to push into one branch and shuffles once.
    rows = spread.repartition(vendor, day, "_block").withColumn(
        "_counts", F.coalesce(counts, F.lit(False))
    ).withColumns({
        c: F.when(F.col("_counts"), v).otherwise(F.lit(0)).cast(WIDE)
        for c, v in zip(totals, (F.lit(1), value, value * value))
    })
    sums = [F.sum(c).cast(WIDE).alias(c) for c in totals]
    blocks = rows.groupBy(vendor, day, "_block").agg(F.min(key).alias("_first"), *sums)
    days = blocks.groupBy(vendor, day).agg(F.min("_first").alias("_first"), *sums)

    def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
        tests = [left[c].eqNullSafe(right[f"_r{c}"]) for c in names]
        return reduce(lambda a, b: a & b, tests)

    def renamed(level: DataFrame, names: list[str]) -> DataFrame:
        return level.withColumnsRenamed({c: f"_r{c}" for c in names})

    def lead_in(level: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
        running = level.withColumns(_running(totals, keys, order))
        return running.select(
            vendor, day, *[c for c in ("_block",) if c in level.columns],
            *[F.col(f"{c}_before").alias(f"{name}{c}") for c in totals],
        )

    day_start = lead_in(days, [vendor], [day, "_first"], "_day")
    block_start = lead_in(blocks, [vendor, day], ["_first"], "_blk")
    # Joining the two small levels first leaves one join on the rows' own key.
    day_start = renamed(day_start, [vendor, day])
    starts = block_start.join(day_start, same(block_start, day_start, [vendor, day])).select(
        vendor, day, "_block",
        *[(F.col(f"_blk{c}") + F.col(f"_day{c}")).cast(WIDE).alias(f"_start{c}") for c in totals],
    )
    starts = renamed(starts, [vendor, day, "_block"])
    own = rows.withColumns(_running(totals, [vendor, day, "_block"], [key]))
    full = own.join(starts, same(own, starts, [vendor, day, "_block"]))
    prior = {c: F.when(F.col("_counts"), F.col(f"{c}_before") + F.col(f"_start{c}"))
             .otherwise(F.lit(0)).cast(WIDE) for c in totals}
    n, s, q = (prior[c].cast("double") for c in totals)
    # The mean is divided as a decimal: half cents round the same everywhere.
    some = F.when(n > 0, prior["_n"].cast("decimal(13,0)"))
    mean = F.round(prior["_s"].cast("decimal(28,4)") / some, 2)
    variance = F.when(n > 1, F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1))
    stats = full.select(
        vendor, day, key, amount,
        n.cast("bigint").alias("n_prior"),
        F.when(n > 0, mean.cast("double")).alias("mean_prior"),
        F.when(n > 1, F.round(F.sqrt(variance), 2)).alias("stddev_prior"),
    )
    gap = F.abs(F.col(amount).cast("double") - F.col("mean_prior"))
    return stats.withColumn(
        "out_of_line", F.coalesce(gap > F.lit(k) * F.col("stddev_prior"), F.lit(False))
    )

"""Duplicate documents by content hash; a null hash never equals another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_hash(df: DataFrame, hash_col: str, order: list[str]) -> DataFrame:
    """The first row per hash, whole; rows without a hash are all kept.

    An aggregate and not ``row_number``: every task first cuts its copies of a
    document to one, so a hash with a third of all rows stays cheap. The last
    order column must be unique; it is the second key of rows without a hash.
    """
    alone = F.when(F.col(hash_col).isNull(), F.col(order[-1]))
    picked = df.groupBy(F.col(hash_col).alias("_hash"), alone.alias("_alone")).agg(
        F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    )
    return picked.select("_row.*")


def find_duplicates(df: DataFrame, hash_col: str) -> DataFrame:
    """Rows whose hash occurs more than once, with the number of copies.

    Copies are counted with partial counts per task; the counts of repeated
    hashes then meet the rows in a join, where adaptive execution splits a hash
    with too many rows.
    """
    copies = df.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(
        F.count("*").alias("copies")
    ).where(F.col("copies") > 1)
    return df.join(copies, hash_col).select(*df.columns, "copies")


def append_new(batch: DataFrame, store: DataFrame, hash_col: str, order: list[str]) -> DataFrame:
    """The rows of a batch that an idempotent append would add to the store.

    The first row per hash in the batch, unless the store has that hash. Rows
    without a hash are always new.
    """
    first = first_by_hash(batch, hash_col, order)
    return first.join(store.select(hash_col), hash_col, "left_anti").select(*batch.columns)

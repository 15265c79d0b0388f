"""The stored-invoice layout, the audit trail and batch summaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billsift import constants as K
from billsift.functions.secure import encrypt
from billsift.functions.text import run_stamp
from billsift.schemas import STORE_DEFAULTS, STORE_EXPORT

# Record column -> stored column.
STORE_COLUMNS = {
    "invoice_no": "invoice_number",
    "invoice_date": "invoice_date",
    "vendor_name": "vendor_name",
    "vendor_gstin": "vendor_gstin",
    "buyer_name": "buyer_name",
    "cgst_amount": "cgst",
    "sgst_amount": "sgst",
    "grand_total": "grand_total",
    "currency": "currency",
}


def default_fill(df: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """Missing values become the column's default; all filled columns are text."""
    filled = {
        c: F.coalesce(F.col(c).cast("string"), F.lit(d))
        for c, d in (defaults or STORE_DEFAULTS).items()
        if c in df.columns
    }
    return df.withColumns(filled)


def to_store(records: DataFrame, file_hash: Column, run_ts: datetime | Column,
             key: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Stored rows of extracted records; with a key, the whole record encrypted.

    Records with an ``error_reason`` are not stored; the audit log has them. ``id``
    is unique within the rows stored together, without any order or gap-free count.
    """
    if "error_reason" in records.columns:
        # as a generated column the reason is tested after the record is made: a plain filter is
        # moved below it, and all reading that the reason rests on would run several times a row
        reason = F.explode_outer(F.array("error_reason")).alias("_reason")
        records = records.select("*", reason).where(F.col("_reason").isNull()).drop("error_reason", "_reason")
    business = [F.col(c).alias(name) for c, name in STORE_COLUMNS.items()]
    payload = F.to_json(F.struct(*[c for c in records.columns if c not in keys]))
    extra = [encrypt(payload, key).alias("json_data_enc")] if key is not None else []
    stored = records.select(
        *keys,
        F.monotonically_increasing_id().alias("id"),
        file_hash.alias("file_hash"),
        "filename",
        run_stamp(run_ts, K.STORE_STAMP).alias("upload_date"),
        *business,
        *extra,
        F.lit("PROCESSED").alias("status"),
    )
    return default_fill(stored)


def store_export(store: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The exported columns of the store under their display headers."""
    return store.select(*keys, *[F.col(c).alias(header) for c, header in STORE_EXPORT.items()])


def audit_log(docs: DataFrame, filename: Column, file_hash: Column, action: str,
              ts: datetime | Column) -> DataFrame:
    """Rows to append to the audit trail: what was done to which content, when."""
    return docs.select(
        filename.alias("filename"),
        file_hash.alias("file_hash"),
        run_stamp(ts, K.STORE_STAMP).alias("ts"),
        F.lit(action).alias("action"),
    )


def review_queue(records: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """What a reviewer sees of each record."""
    return records.select(
        *keys,
        F.coalesce("filename", F.lit("Unknown")).alias("filename"),
        F.coalesce("vendor_name", F.lit("Unknown")).alias("vendor_name"),
        "status",
    )


def status_summary(records: DataFrame, hash_col: str) -> DataFrame:
    """Count of processed, duplicate and error documents.

    Copies collapse to one row per hash first, with partial counts in each
    task. A copy of a document that was processed counts as a duplicate.
    """
    per_hash = records.groupBy(hash_col, "status").agg(F.count("*").alias("n"))
    is_copy = (F.col("status") == "PROCESSED") & F.col(hash_col).isNotNull()
    parts = F.when(
        is_copy,
        F.array(
            F.struct(F.lit("PROCESSED").alias("status"), F.lit(1).cast("bigint").alias("n")),
            F.struct(F.lit("DUPLICATE").alias("status"), (F.col("n") - 1).alias("n")),
        ),
    ).otherwise(F.array(F.struct("status", "n")))
    long = per_hash.select(F.explode(parts).alias("p")).select("p.status", "p.n")
    return long.where(F.col("n") > 0).groupBy("status").agg(F.sum("n").alias("n_documents"))


def column_widths(df: DataFrame, cap: int = K.WIDTH_CAP) -> DataFrame:
    """Width of each of the first columns: longest value or header, padded, capped.

    One pass of ``max`` over the table; the single result row is then unpivoted.
    """
    names = df.columns[: K.WIDTH_COLUMNS]
    longest = df.agg(*[
        F.max(F.length(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")))).alias(f"w{i}")
        for i, c in enumerate(names)
    ])
    entry = F.array(*[
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(c).alias("column_name"),
            F.least(
                F.greatest(F.col(f"w{i}"), F.lit(len(c))) + K.WIDTH_PADDING, F.lit(cap)
            ).cast("int").alias("width"),
        )
        for i, c in enumerate(names)
    ])
    return longest.select(F.explode(entry).alias("e")).select("e.*")


def status_rollup(records: DataFrame, hash_col: str, group: str = "vendor_name") -> DataFrame:
    """Documents, different documents and copies by (group, status), by group and in all.

    Copies are cut to one row per group, status and hash in each task first; a document
    counts once on every level, in whatever groups it stands. Rows without a hash are documents of their
    own. ``level`` is 0 for a pair, 1 for a group, 3 for all.
    """
    per_hash = records.groupBy(group, "status", hash_col).agg(F.count("*").alias("n"))
    alone = F.sum(F.when(F.col(hash_col).isNull(), F.col("n")).otherwise(0))
    counted = per_hash.rollup(group, "status").agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n_documents"),
        (F.count_distinct(hash_col) + alone).alias("n_different"))
    return counted.withColumn("n_copies", F.col("n_documents") - F.col("n_different"))

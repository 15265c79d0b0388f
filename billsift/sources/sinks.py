"""Sinks: exports, the invoice store and candidate files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billsift.functions.text import sanitize_cell
from billsift.operators.candidates import non_blank
from billsift.operators.dedupe import append_new, first_by_hash
from billsift.operators.store import store_export
from billsift.schemas import RECORD_COLUMNS
from billsift.sources.committed import Folder


def sanitize(df: DataFrame) -> DataFrame:
    """Make every text cell safe to open in a spreadsheet."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: sanitize_cell(F.col(f"`{c}`")) for c in text})


def export_view(records: DataFrame, sanitized: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Records under their display headers, in record order."""
    rows = sanitize(records) if sanitized else records
    shown = [F.col(c).alias(h) for c, h in RECORD_COLUMNS.items() if c in records.columns]
    return rows.select(*keys, *shown)


def _write(df: DataFrame, path: str, fmt: str, mode: str) -> int:
    """Write rows once and return their number; no rows leave the target as it was.

    The rows are counted on their way into a folder beside the target, which then
    takes the target's place (``overwrite``) or gives it its files (``append``).
    """
    spark, seen = df.sparkSession, Observation()
    path = path.rstrip("/")
    staged = f"{path}._staged-{uuid.uuid4().hex}"
    writer = df.observe(seen, F.count("*").alias("n")).write.format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(staged)
    n, folder = seen.get["n"], Folder(spark, staged)
    target = folder.at(path)
    if n and mode == "overwrite":
        old = f"{path}._old-{uuid.uuid4().hex}"
        if folder.system.exists(target):
            folder.rename(path, old)
        folder.rename(staged, path)
        folder.system.delete(folder.at(old), True)
    elif n:
        for name in folder.names():
            if not name.startswith(("_", ".")):
                folder.rename(f"{staged}/{name}", f"{path}/{name}")
    folder.system.delete(folder.root, True)
    return n


def export_records(records: DataFrame, path: str, fmt: str = "csv", sanitized: bool = True,
                   mode: str = "overwrite") -> None:
    """Write the export; no records is an error, as nothing would be written."""
    if not _write(export_view(records, sanitized), path, fmt, mode):
        raise ValueError("No data to export")


def export_store(store: DataFrame, path: str, sanitized: bool = True) -> int:
    """Write the store as CSV and return its row count; 0 writes nothing."""
    view = store_export(store)
    return _write(sanitize(view) if sanitized else view, path, "csv", "overwrite")


def write_structured(invoices: DataFrame, path: str) -> None:
    """Nested invoices as JSON lines."""
    invoices.write.mode("overwrite").json(path)


def append_to_store(batch: DataFrame, store: DataFrame | None, path: str, hash_col: str,
                    order: list[str]) -> None:
    """Idempotent append: only rows whose hash the store lacks are added.

    ``store`` is the table at ``path`` as it is now; ``None`` on the first run.
    """
    if store is None:
        new = first_by_hash(batch, hash_col, order)
    else:
        new = append_new(batch, store, hash_col, order)
    new.write.mode("append").parquet(path)


def append_audit(log: DataFrame, path: str) -> None:
    """Add to the audit trail; nothing in it is ever rewritten."""
    log.write.mode("append").parquet(path)


def write_candidates(candidates: DataFrame, path: str, page: str = "page_no") -> None:
    """Non-blank candidates, foldered by page."""
    non_blank(candidates).write.mode("overwrite").partitionBy(page).parquet(path)

"""Every registered query: ``(spark, sf_dir) -> DataFrame`` over whole tables.

Money and dates leave the typed operators as double and ISO text here only so
that any client compares them alike.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billsift import constants as K
from billsift import functions as B
from billsift.operators import candidates, dedupe, documents, fraud, store, structured, validate
from billsift.operators.records import (
    explode_items,
    extract_record,
    typed_record,
    union_records,
    with_items,
    with_lines,
)
from billsift.plans import stores, strict
from billsift.plans.invoices import (
    invoice_text,
    prepared_invoices,
    table,
    vendor_master,
)
from billsift.schemas import RAW_EXTRACTION, STORE_DEFAULTS, STRUCTURED_INVOICE, record_columns
from billsift.session import shared_dir, shuffles_dropped
from billsift.sources import files, sinks
from billsift.sources.committed import Folder
from billsift.streaming import ingest

RUN_TS = datetime(2024, 1, 2, 3, 4)
RUN_DATE = date(2020, 1, 1)
ID = ("doc_id",)
#: Landed bytes that a batch of the ingest takes, and that stay on disk while it runs.
BATCH_BYTES = 2 << 30
Query = Callable[[SparkSession, str], DataFrame]


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _money(*names: str) -> list[Column]:
    return [F.col(n).cast("double").alias(n) for n in names]


def _iso(*names: str) -> list[Column]:
    return [F.col(n).cast("string").alias(n) for n in names]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_lines(prepared_invoices(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str, profile: str = "a") -> DataFrame:
    return extract_record(prepared_invoices(spark, sf_dir), RUN_TS, profile, keys=ID)


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_record(prepared_invoices(spark, sf_dir), ID)


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", B.content_hash(F.col("text")).alias("file_hash"))


# ---- sources and documents --------------------------------------------------

def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: bytes, length and a name."""
    content = F.col("html").cast("binary")
    return table(spark, sf_dir, "pages").select(
        "page_id", B.safe_path(F.col("url")).alias("name"), content.alias("content"),
        F.octet_length("html").cast("bigint").alias("length"),
    )


def size_gate(spark, sf_dir):
    gated = files.size_gate(_page_files(spark, sf_dir), max_bytes=2000)
    return gated.select("page_id", "name", "length", "size_ok")


def type_gate(spark, sf_dir):
    return files.type_gate(_page_files(spark, sf_dir), b"<!DOCTYPE").select("page_id", "type_ok")


def scan_files(spark, sf_dir):
    found = files.scan_files(spark, sf_dir, "*.parquet")
    return found.select(B.safe_path(F.col("path")).alias("name"), "length", "error_reason")


def fold_pages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return documents.fold_pages(turns, "conv_id", "turn", "text").drop("error_reason")


def page_gate(spark, sf_dir):
    """Pages within a limit, and a row for each document over it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    kept, refused = documents.page_gate(turns, "conv_id", max_pages=5)
    return union_records(kept, refused).select("conv_id", "turn", "n_pages")


def route_short_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), "turn", F.col("text").alias("page_text")
    )
    return documents.route_with_pages(docs, turns, "doc_id", "text", "turn", "page_text")


def text_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    long = docs.select("doc_id", F.posexplode_outer(B.text_lines(F.col("text"))))
    return long.where(F.col("col").isNotNull()).select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), F.col("col").alias("line")
    )


def normalize_currency(spark, sf_dir):
    return prepared_invoices(spark, sf_dir).select("doc_id", F.col("raw_text").alias("text"))


# ---- fields -----------------------------------------------------------------

def extract_record_a(spark, sf_dir):
    return _records(spark, sf_dir)


def extract_record_b(spark, sf_dir):
    return _records(spark, sf_dir, "b")


def extract_items(spark, sf_dir):
    items = explode_items(prepared_invoices(spark, sf_dir), ID)
    return items.withColumn("sr", F.col("sr").cast("bigint"))


def items_pipe(spark, sf_dir):
    items = F.col("items")
    return with_items(prepared_invoices(spark, sf_dir)).select(
        "doc_id",
        B.pipe_join(items, "sr").alias("sr_nos"),
        B.pipe_join(items, "description").alias("descriptions"),
        B.pipe_join(items, "hsn").alias("hsn_codes"),
        B.pipe_join(items, "qty").alias("quantities"),
        B.pipe_join(items, "rate").alias("rates"),
        B.pipe_join(items, "amount").alias("amounts"),
    )


def find_amounts(spark, sf_dir):
    lines = F.col("lines")
    return _lines(spark, sf_dir).select(
        "doc_id",
        B.find_amount(lines, "CGST").alias("cgst_amount"),
        B.find_amount(lines, "SGST").alias("sgst_amount"),
        B.find_amount(lines, "Tax").alias("total_tax"),
        B.find_amount(lines, "Sub Total").alias("subtotal"),
        B.find_amount(lines, "Grand Total").alias("grand_total"),
        B.find_amount(lines, "Grand Total", "strict").alias("grand_total_strict"),
    )


def tax_rates(spark, sf_dir):
    lines = F.col("lines")
    rates = _lines(spark, sf_dir).select(
        "doc_id",
        B.find_percent(lines, "CGST").alias("cgst_rate"),
        B.find_percent(lines, "SGST").alias("_sgst"),
    )
    sgst = F.coalesce(F.nullif("_sgst", F.lit("")), F.col("cgst_rate"))
    return rates.select("doc_id", "cgst_rate", sgst.alias("sgst_rate"))


def label_values(spark, sf_dir):
    raw = F.col("raw_text")
    labels = {
        "invoice_no": "Invoice No",
        "due_date": "Due Date",
        "place_of_supply": "Place of Supply",
        "payment_terms": "Payment Terms",
        "email": "Email",
        "amount_in_words": "Amount in Words",
        "bank_name": "Bank",
        "account_name": "Account Name",
        "account_no": "Account No",
        "branch": "Branch",
    }
    # all labels are sought in the one lower case
    folded = prepared_invoices(spark, sf_dir).select("doc_id", "raw_text", F.lower(raw).alias("_folded"))
    return folded.select("doc_id", *[
        B.label_value(raw, x, folded=F.col("_folded")).alias(name) for name, x in labels.items()])


def first_match_ids(spark, sf_dir):
    raw = F.col("raw_text")
    return prepared_invoices(spark, sf_dir).select(
        "doc_id",
        B.first_match(raw, K.DATE).alias("invoice_date"),
        B.first_match(raw, K.GSTIN).alias("gstin"),
        B.first_match(raw, K.PAN).alias("pan"),
        B.first_match(raw, K.ACCOUNT).alias("account"),
        B.first_match(raw, K.IFSC).alias("ifsc"),
    )


def vendor_block(spark, sf_dir):
    lines = F.col("lines")
    return _lines(spark, sf_dir).select(
        "doc_id",
        B.vendor_name(lines).alias("vendor_name"),
        B.vendor_address(lines).alias("vendor_address"),
    )


def buyer_block(spark, sf_dir):
    lines, at = F.col("lines"), F.col("at")
    return _lines(spark, sf_dir).withColumn("at", B.anchor_position(lines)).select(
        "doc_id",
        B.buyer_name(lines, at).alias("buyer_name"),
        B.buyer_address(lines, at).alias("buyer_address"),
    )


def buyer_gstin(spark, sf_dir):
    lines = F.col("lines")
    return _lines(spark, sf_dir).select(
        "doc_id",
        B.buyer_gstin(lines).alias("buyer_line"),
        B.buyer_gstin(lines, "strict").alias("buyer_gstin"),
    )


def invoice_type(spark, sf_dir):
    kind = B.find_contains(F.col("lines"), K.INVOICE_TYPE_KEYS)
    return _lines(spark, sf_dir).select("doc_id", kind.alias("invoice_type"))


def error_rows(spark, sf_dir):
    docs = documents.prepare(invoice_text(spark, sf_dir, max_lines=10))
    return extract_record(docs, RUN_TS).select(
        "filename", "status", "invoice_no", "vendor_name", "error_reason"
    )


# ---- typed checks -----------------------------------------------------------

def typed(spark, sf_dir):
    return _typed(spark, sf_dir).select(
        "doc_id",
        *_iso("invoice_date", "due_date"),
        *_money("subtotal", "cgst_amount", "sgst_amount", "total_tax", "grand_total"),
        *_long("cgst_rate", "sgst_rate"),
        F.size("items").cast("bigint").alias("n_items"),
    )


def reconcile_totals(spark, sf_dir):
    checked = validate.reconcile_totals(_typed(spark, sf_dir))
    return checked.select("doc_id", *_money("grand_total", "items_sum"), "reconciles")


def tax_check(spark, sf_dir):
    return validate.tax_check(_typed(spark, sf_dir)).select("doc_id", "cgst_ok", "sgst_ok")


def future_dated(spark, sf_dir):
    return validate.future_dated(_typed(spark, sf_dir), RUN_DATE).select("doc_id", "future_dated")


def fraud_bank_account(spark, sf_dir):
    seen = _typed(spark, sf_dir).select("doc_id", "vendor_gstin", "account_number")
    return fraud.fraud_bank_account(seen, vendor_master(spark, sf_dir)).select(
        "doc_id", "bank_check"
    )


def vendor_baseline(spark, sf_dir):
    wanted = _typed(spark, sf_dir).select("doc_id", "vendor_gstin", "invoice_date", "grand_total")
    scored = fraud.vendor_baseline(
        wanted, "vendor_gstin", "invoice_date", "doc_id", "grand_total", k=2.0
    )
    return scored.select(
        "doc_id", "vendor_gstin", F.col("grand_total").cast("double").alias("amount"),
        "n_prior", "mean_prior", "stddev_prior", "out_of_line",
    )


# ---- store and export -------------------------------------------------------

def _stored(spark: SparkSession, sf_dir: str, key: Column | None = None) -> DataFrame:
    prepared = prepared_invoices(spark, sf_dir)
    hashed = prepared.withColumn("file_hash", B.content_hash(F.col("raw_text")))
    records = extract_record(hashed, RUN_TS, keys=("doc_id", "file_hash"))
    return store.to_store(records, F.col("file_hash"), RUN_TS, key, keys=ID)


def default_fill(spark, sf_dir):
    return _stored(spark, sf_dir).select("doc_id", *STORE_DEFAULTS)


def store_export(spark, sf_dir):
    return store.store_export(_stored(spark, sf_dir), keys=ID)


def stored_record(spark, sf_dir):
    """The stored record decrypted again."""
    key = B.key_column(spark, secrets.token_bytes(32))
    plain = B.decrypt(F.col("json_data_enc"), key)
    wanted = ("filename", "invoice_no", "invoice_date", "vendor_name", "grand_total", "raw_text")
    fields = F.from_json(plain, ", ".join(f"{c} string" for c in wanted))
    stored = _stored(spark, sf_dir, key)
    return stored.select("doc_id", "file_hash", fields.alias("r")).select("doc_id", "file_hash", "r.*")


def store_ids(spark, sf_dir):
    """Rows of the store and distinct ids among them."""
    counts = _stored(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n"))
    return counts.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_ids"))


def export_count(spark, sf_dir):
    """What an export of the store says it wrote, and what can be read back."""
    path = shared_dir(spark, "export")
    n = sinks.export_store(_stored(spark, sf_dir), path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.agg(F.count("*").alias("n_read")).withColumn("n_written", F.lit(n).cast("bigint"))


def export_records(spark, sf_dir):
    return sinks.export_view(_records(spark, sf_dir), keys=ID)


def sanitize_cells(spark, sf_dir):
    return sinks.sanitize(_records(spark, sf_dir).select("doc_id", "vendor_name"))


def review_queue(spark, sf_dir):
    return store.review_queue(_records(spark, sf_dir))


def column_widths(spark, sf_dir):
    shown = sinks.export_view(_records(spark, sf_dir), sanitized=False)
    widths = store.column_widths(shown)
    return widths.select(*_long("position"), "column_name", *_long("width"))


def status_summary(spark, sf_dir):
    prepared = prepared_invoices(spark, sf_dir)
    hashed = prepared.withColumn("file_hash", B.content_hash(F.col("raw_text")))
    records = extract_record(hashed, RUN_TS, keys=("file_hash",))
    return store.status_summary(records.select("file_hash", "status"), "file_hash")


def audit_log(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("document_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return store.audit_log(docs, name, B.content_hash(F.col("text")), "EXTRACT", RUN_TS)


# ---- duplicates -------------------------------------------------------------

def content_hash(spark, sf_dir):
    return _hashed(spark, sf_dir).select("doc_id", "file_hash")


def first_by_hash(spark, sf_dir):
    return dedupe.first_by_hash(_hashed(spark, sf_dir), "file_hash", ["doc_id"])


def find_duplicates(spark, sf_dir):
    hashed = _hashed(spark, sf_dir).select("doc_id", "file_hash")
    return dedupe.find_duplicates(hashed, "file_hash")


def append_new(spark, sf_dir):
    hashed = _hashed(spark, sf_dir)
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    kept = hashed.join(labelled, "doc_id", "left_semi").select("file_hash")
    return dedupe.append_new(hashed, kept, "file_hash", ["doc_id"])


# ---- text functions ---------------------------------------------------------

def redact_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", B.redact(F.col("text")).alias("text"))


def quality_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", B.quality_score(F.col("text")).alias("score"))


def safe_path(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", B.safe_path(F.col("url")).alias("name"))


def run_stamp(spark, sf_dir):
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        B.run_stamp(at).alias("record_stamp"),
        B.run_stamp(at, K.STORE_STAMP).alias("store_stamp"),
    )


def encrypt_roundtrip(spark, sf_dir):
    key = B.key_column(spark, secrets.token_bytes(32))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sealed = docs.withColumn("token", B.encrypt(F.col("text"), key))
    return sealed.select(
        "doc_id",
        B.decrypt(F.col("token"), key).alias("decrypted"),
        B.decrypt(F.encode(F.lit("not a token, nor near one"), "utf-8"), key).alias("bad_token"),
        (F.octet_length("token") > 0).alias("has_token"),
    )


# ---- candidates -------------------------------------------------------------

def _page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", (F.col("page_id") + 1).alias("page_no"))


def param_grid(spark, sf_dir):
    grid = candidates.param_grid(_page_numbers(spark, sf_dir), "page_no", ("page_id",))
    return grid.select("page_id", "variant", *_long("dpi"), "prep")


def candidate_parse(spark, sf_dir):
    grid = candidates.param_grid(_page_numbers(spark, sf_dir), "page_no", ("page_id",))
    named = grid.select("page_id", F.concat("variant", F.lit(".txt")).alias("file_name"))
    return candidates.candidate_parse(named).select("page_id", "file_name", *_long("page_no"))


def variant_slug(spark, sf_dir):
    variants = candidates.engine_variants(_page_numbers(spark, sf_dir), "page_no", ("page_id",))
    return variants.select("page_id", "slug")


def best_candidate(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return candidates.best_candidate(turns, ["conv_id"], "turn", "text")


def candidate_sink(spark, sf_dir):
    """Turns written as candidates and read back: blank ones are not among them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    blank = turns.withColumn("text", F.when(F.col("turn") % 3 == 0, F.lit(" \n")).otherwise(F.col("text")))
    path = shared_dir(spark, "candidates")
    sinks.write_candidates(blank.withColumn("page_no", F.col("turn") % 16), path)
    back = spark.read.schema("conv_id bigint, turn bigint, text string, page_no bigint").parquet(path)
    return back.select("conv_id", "turn", "page_no", "text")


# ---- structured -------------------------------------------------------------

def _raw_extraction(spark: SparkSession, sf_dir: str, as_text: bool = True) -> DataFrame:
    """Rendered invoices as page extractions: items are the table, the rest text.

    As text they go through JSON, as a JSON source holds them.
    """
    marked = _lines(spark, sf_dir).select("doc_id", F.transform(
        "lines", lambda x: F.struct(B.is_item(x).alias("item"), x.alias("line"))).alias("m"))
    rows = F.transform(F.filter("m", lambda x: x["item"]), lambda x: F.split(x["line"], " "))
    blocks = F.transform(F.filter("m", lambda x: ~x["item"]), lambda x: x["line"])
    page = F.struct(
        F.lit(1).alias("page"), F.array(rows).alias("tables"), blocks.alias("text_blocks"))
    raw = F.struct(F.lit("f").alias("file"), F.array(page).alias("pages"))
    if as_text:
        raw = F.from_json(F.to_json(raw), RAW_EXTRACTION)
    parsed = marked.select("doc_id", raw.alias("raw"))
    return parsed.select("doc_id", structured.raw_lines(F.col("raw.pages")).alias("lines"))


def _structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.structured_build(_raw_extraction(spark, sf_dir, as_text=False), ID)


def raw_lines(spark, sf_dir):
    long = _raw_extraction(spark, sf_dir).select("doc_id", F.posexplode_outer("lines"))
    return long.where(F.col("col").isNotNull()).select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), F.col("col").alias("line")
    )


def structured_items(spark, sf_dir):
    long = _structured(spark, sf_dir).select("doc_id", F.explode_outer("line_items").alias("i"))
    return long.where(F.col("i").isNotNull()).select("doc_id", "i.*")


def leftover_lines(spark, sf_dir):
    long = _structured(spark, sf_dir).select("doc_id", F.explode_outer("declarations").alias("line"))
    return long.where(F.col("line").isNotNull())


def structured_flatten(spark, sf_dir):
    # through JSON lines text, as the structured source reads it
    text = structured_build(spark, sf_dir)
    nested = text.select("doc_id", F.from_json("invoice", STRUCTURED_INVOICE).alias("i")).select("doc_id", "i.*")
    flat = structured.structured_flatten(nested, ID)
    return flat.withColumns({
        "n_items": F.size("line_items").cast("bigint"),
        "n_declarations": F.size("declarations").cast("bigint"),
    }).drop("line_items", "declarations")


def structured_build(spark, sf_dir):
    nested = _structured(spark, sf_dir)
    parts = [c for c in nested.columns if c != "doc_id"]
    return nested.select("doc_id", F.to_json(F.struct(*parts)).alias("invoice"))


# ---- streams, drained to a table --------------------------------------------

def _stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """New files of a table; as a pattern, the path may be a file or a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).options(**options).parquet(path + "*")


def _document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _stream(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    return docs.select("doc_id", B.content_hash(F.col("text")).alias("file_hash"))


def _landed_invoices(spark: SparkSession, sf_dir: str) -> str:
    landing = shared_dir(spark, "landing")
    with shuffles_dropped(spark):
        invoice_text(spark, sf_dir).write.option("compression", "zstd").parquet(landing)
    return landing


def stream_ingest(spark, sf_dir):
    out, log = shared_dir(spark, "records"), shared_dir(spark, "progress")
    landing = _landed_invoices(spark, sf_dir)
    # what a batch has taken in is deleted, so texts and records never lie side by side in full
    docs = _stream(spark, landing, maxBytesPerTrigger=str(BATCH_BYTES), cleanSource="delete")
    ingest.ingest_stream(docs, out, log, RUN_TS, keys=ID).awaitTermination()
    folder = Folder(spark, landing)
    folder.system.delete(folder.root, True)
    return spark.read.parquet(out).select("doc_id", *record_columns("a"), "error_reason")


def _drain(df: DataFrame, out: str, log: str) -> None:
    writer = df.writeStream.format("parquet").option("path", out)
    writer.option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def stream_dedupe(spark, sf_dir):
    out, log = shared_dir(spark, "unique"), shared_dir(spark, "progress")
    _drain(ingest.first_seen(_document_stream(spark, sf_dir), "file_hash"), out, log)
    return spark.read.parquet(out).groupBy("file_hash").agg(F.count("*").alias("n"))


def stream_store(spark, sf_dir):
    out, log = shared_dir(spark, "store"), shared_dir(spark, "progress")
    for _ in range(2):  # the second run finds nothing new
        ingest.store_stream(
            _document_stream(spark, sf_dir), out, log, "file_hash", ["doc_id"]
        ).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "file_hash")


def stream_status(spark, sf_dir):
    out, log = shared_dir(spark, "status"), shared_dir(spark, "progress")
    docs = documents.prepare(_stream(spark, _landed_invoices(spark, sf_dir)))
    counts = ingest.status_counts(extract_record(docs, RUN_TS))

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    (
        counts.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(out)


def queries() -> dict[str, Query]:
    return {
        "scan_files": scan_files,
        "size_gate": size_gate,
        "type_gate": type_gate,
        "fold_pages": fold_pages,
        "page_gate": page_gate,
        "route_short_text": route_short_text,
        "text_lines": text_lines,
        "normalize_currency": normalize_currency,
        "extract_record": extract_record_a,
        "extract_record_b": extract_record_b,
        "extract_items": extract_items,
        "items_pipe": items_pipe,
        "find_amounts": find_amounts,
        "tax_rates": tax_rates,
        "label_values": label_values,
        "first_match_ids": first_match_ids,
        "vendor_block": vendor_block,
        "buyer_block": buyer_block,
        "buyer_gstin": buyer_gstin,
        "invoice_type": invoice_type,
        "error_rows": error_rows,
        "typed_record": typed,
        "reconcile_totals": reconcile_totals,
        "tax_check": tax_check,
        "future_dated": future_dated,
        "fraud_bank_account": fraud_bank_account,
        "vendor_baseline": vendor_baseline,
        "default_fill": default_fill,
        "store_export": store_export,
        "stored_record": stored_record,
        "store_ids": store_ids,
        "export_count": export_count,
        "export_records": export_records,
        "sanitize_cells": sanitize_cells,
        "review_queue": review_queue,
        "column_widths": column_widths,
        "status_summary": status_summary,
        "audit_log": audit_log,
        "content_hash": content_hash,
        "first_by_hash": first_by_hash,
        "find_duplicates": find_duplicates,
        "append_new": append_new,
        "redact_text": redact_text,
        "quality_score": quality_score,
        "safe_path": safe_path,
        "run_stamp": run_stamp,
        "encrypt_roundtrip": encrypt_roundtrip,
        "param_grid": param_grid,
        "candidate_parse": candidate_parse,
        "variant_slug": variant_slug,
        "best_candidate": best_candidate,
        "candidate_sink": candidate_sink,
        "raw_lines": raw_lines,
        "structured_items": structured_items,
        "leftover_lines": leftover_lines,
        "structured_flatten": structured_flatten,
        "structured_build": structured_build,
        "stream_ingest": stream_ingest,
        "stream_dedupe": stream_dedupe,
        "stream_store": stream_store,
        "stream_status": stream_status,
    } | strict.queries() | stores.queries()

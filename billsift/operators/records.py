"""The flat invoice record: one narrow projection, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billsift import constants as K
from billsift import functions as B
from billsift.functions.fields import is_ascii
from billsift.schemas import record_columns


@dataclass(frozen=True)
class Profile:
    """Arguments of the shared operators; ``None`` for a label means "by pattern"."""

    vendor_keywords: tuple[str, ...]
    buyer_anchors: tuple[str, ...]
    total_tax: str
    subtotal: str
    bank_name: str
    pan_label: str | None = None
    account_label: str | None = None
    ifsc_label: str | None = None
    sgst_from_cgst: bool = False


PROFILES = {
    "a": Profile(
        vendor_keywords=K.VENDOR_KEYWORDS,
        buyer_anchors=K.BUYER_ANCHORS,
        total_tax="Tax",
        subtotal="Sub Total",
        bank_name="Bank",
        sgst_from_cgst=True,
    ),
    "b": Profile(
        vendor_keywords=K.VENDOR_KEYWORDS_B,
        buyer_anchors=K.BUYER_ANCHORS_B,
        total_tax="Total Tax",
        subtotal="Total",
        bank_name="Bank Name",
        pan_label="PAN",
        account_label="Account No",
        ifsc_label="IFSC",
    ),
}


def with_lines(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add the line array; downstream columns share this one computation."""
    return df.withColumn("lines", B.text_lines(F.col(text)))


def blank_fallback(value: Column, other: Column) -> Column:
    """The other value where the first is blank."""
    return F.coalesce(F.nullif(value, F.lit("")), other)


def extract_record(df: DataFrame, run_ts: datetime | Column, profile: str = "a",
                   text: str = "raw_text", path: str = "path",
                   keys: tuple[str, ...] = ()) -> DataFrame:
    """One record per document, plus the key columns and ``error_reason``.

    ``df`` holds normalised text and ``ocr_method`` (see ``documents.prepare``).
    A document that comes with an ``error_reason``, or whose buyer anchor has no
    line after it, becomes an error row: only its name, ``vendor_name = 'N/A'``,
    a status and a reason.
    """
    p = PROFILES[profile]
    known = F.col("error_reason") if "error_reason" in df.columns else F.lit(None)
    source = df.select(
        *keys,
        B.safe_path(F.col(path)).alias("filename"),
        "ocr_method",
        F.coalesce(F.col(text), F.lit("")).alias("raw_text"),
        known.cast("string").alias("_reason"),
    )
    # Each step is used several times by the next, so Catalyst keeps them apart.
    split = source.withColumn("lines", B.text_lines(F.col("raw_text")))
    whole = split.withColumn("_whole", B.joined(F.col("lines")))
    folded = whole.withColumns({
        "_upper": F.upper("_whole"),
        "_lower": F.lower("_whole"),
        "_folded": F.lower("raw_text"),
        "_plain": is_ascii(F.col("raw_text")),
    })
    lines, raw, plain = F.col("lines"), F.col("raw_text"), F.col("_plain")
    shared = folded.withColumns({
        "_money": B.amount_lines(lines),
        "_percent": B.percent_lines(lines),
        "_anchor": B.anchor_position(lines, p.buyer_anchors, F.col("_lower")),
    }).withColumns({
        "_money_lower": F.lower(B.joined(F.col("_money"))),
        "_items": B.items(F.col("_money")),
        "_cgst": B.pick_percent(F.col("_percent"), "CGST"),
        "_sgst": B.pick_percent(F.col("_percent"), "SGST"),
    })

    def amount(keyword: str) -> Column:
        return B.pick_amount(F.col("_money"), keyword, folded=F.col("_money_lower"))

    items, anchor = F.col("_items"), F.col("_anchor")
    cgst, sgst = F.col("_cgst"), F.col("_sgst")
    ends = B.anchor_is_last(lines, anchor)
    failed = F.col("_reason").isNotNull() | ends

    def label(name: str) -> Column:
        return B.label_value(raw, name, folded=F.col("_folded"), plain=plain)

    def label_or_pattern(name: str | None, pattern: str) -> Column:
        return label(name) if name else B.first_match(raw, pattern, plain)

    fields = {
        "filename": F.col("filename"),
        "status": F.when(failed, F.lit("ERROR")).otherwise(F.lit("PROCESSED")),
        "processed_on": B.run_stamp(run_ts),
        "ocr_method": F.col("ocr_method"),
        "invoice_type": B.find_contains(lines, K.INVOICE_TYPE_KEYS, F.col("_upper")),
        "invoice_no": label("Invoice No"),
        "invoice_date": B.first_match(raw, K.DATE, plain),
        "due_date": label("Due Date"),
        "place_of_supply": label("Place of Supply"),
        "payment_terms": label("Payment Terms"),
        "currency": F.lit("INR"),
        "vendor_name": B.vendor_name(lines, p.vendor_keywords, F.col("_upper")),
        "vendor_address": B.vendor_address(lines),
        "vendor_gstin": B.first_match(raw, K.GSTIN, plain),
        "vendor_pan": label_or_pattern(p.pan_label, K.PAN),
        "vendor_email": label("Email"),
        "buyer_name": B.buyer_name(lines, anchor),
        "buyer_address": B.buyer_address(lines, anchor),
        # the lines of a plain text are plain
        "buyer_gstin": B.buyer_gstin(lines, text=F.col("_whole"), plain=plain),
        "item_sr_nos": B.pipe_join(items, "sr"),
        "item_descriptions": B.pipe_join(items, "description"),
        "hsn_sac_codes": B.pipe_join(items, "hsn"),
        "quantities": B.pipe_join(items, "qty"),
        "rates": B.pipe_join(items, "rate"),
        "item_amounts": B.pipe_join(items, "amount"),
        "cgst_rate": cgst,
        "cgst_amount": amount("CGST"),
        "sgst_rate": blank_fallback(sgst, cgst) if p.sgst_from_cgst else sgst,
        "sgst_amount": amount("SGST"),
        "total_tax": amount(p.total_tax),
        "subtotal": amount(p.subtotal),
        "grand_total": amount("Grand Total"),
        "amount_in_words": label("Amount in Words"),
        "bank_name": label(p.bank_name),
        "account_name": label("Account Name"),
        "account_number": label_or_pattern(p.account_label, K.ACCOUNT),
        "ifsc_code": label_or_pattern(p.ifsc_label, K.IFSC),
        "branch": label("Branch"),
        "raw_text": raw,
    }
    always = {"filename", "status"}
    columns = []
    for name in record_columns(profile):
        value = fields[name]
        if name == "vendor_name":
            value = F.when(failed, F.lit("N/A")).otherwise(value)
        elif name not in always:
            value = F.when(~failed, value)
        columns.append(value.alias(name))
    reason = F.coalesce("_reason", F.when(ends, F.lit("ANCHOR_ON_LAST_LINE"))).alias("error_reason")
    return shared.select(*keys, *columns, reason)


def split_errors(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records, and error rows cut to what is known about them.

    Both branches read ``records`` again: write or persist it first.
    """
    bad = F.col("error_reason").isNotNull()
    errors = records.where(bad).select("filename", "vendor_name", "status", "error_reason")
    return records.where(~bad).drop("error_reason"), errors


def error_rows(docs: DataFrame, filename: Column, reason: Column) -> DataFrame:
    """Error rows for documents that never reached extraction."""
    return docs.select(
        filename.alias("filename"),
        F.lit("N/A").alias("vendor_name"),
        F.lit("ERROR").alias("status"),
        reason.alias("error_reason"),
    )


def union_records(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_items(df: DataFrame, text: str = "raw_text", mode: str = "parity") -> DataFrame:
    """Add the item array."""
    return with_lines(df, text).withColumn("items", B.items(F.col("lines"), mode)).drop("lines")


def explode_items(df: DataFrame, keys: tuple[str, ...], text: str = "raw_text",
                  mode: str = "parity") -> DataFrame:
    """One row per item. The outer form spares a second and third evaluation of
    the array in derived filters; the null row it adds is dropped after."""
    item = F.explode_outer("items").alias("item")
    long = with_items(df.select(*keys, text), text, mode).select(*keys, item)
    return long.select(*keys, "item.*").where(F.col("sr").isNotNull())


def typed_record(df: DataFrame, keys: tuple[str, ...], text: str = "raw_text",
                 path: str = "path") -> DataFrame:
    """Numbers and dates, null for missing, whole amounts whatever the grouping."""
    split = with_lines(df.select(*keys, path, text), text)
    raw = F.col(text)
    # Item lines and lines with a whole amount are among those with any amount.
    likely = split.withColumns({
        "_likely": B.amount_lines(F.col("lines")),
        "_percent": B.percent_lines(F.col("lines")),
        "_folded": F.lower(raw),
        "_plain": is_ascii(raw),
    })
    shared = likely.withColumn("_money", B.amount_lines(F.col("_likely"), "strict")).withColumns({
        "_money_lower": F.lower(B.joined(F.col("_money"))),
        "items": F.transform(
            B.items(F.col("_likely"), "strict"),
            lambda x: x.withField("amount", B.to_money(x["amount"])),
        ),
        "_cgst": B.pick_percent(F.col("_percent"), "CGST"),
        "_sgst": B.pick_percent(F.col("_percent"), "SGST"),
    })

    def amount(keyword: str) -> Column:
        picked = B.pick_amount(F.col("_money"), keyword, "strict", F.col("_money_lower"))
        return B.to_money(picked)

    folded, plain = F.col("_folded"), F.col("_plain")
    return shared.select(
        *keys,
        B.safe_path(F.col(path)).alias("filename"),
        B.label_value(raw, "Invoice No", folded=folded, plain=plain).alias("invoice_no"),
        B.to_day(B.first_match(raw, K.DATE, plain)).alias("invoice_date"),
        B.to_day(B.label_value(raw, "Due Date", folded=folded, plain=plain)).alias("due_date"),
        B.first_match(raw, K.GSTIN, plain).alias("vendor_gstin"),
        B.label_value(raw, "Account No", folded=folded, plain=plain).alias("account_number"),
        B.to_rate(F.col("_cgst")).alias("cgst_rate"),
        B.to_rate(blank_fallback(F.col("_sgst"), F.col("_cgst"))).alias("sgst_rate"),
        amount("CGST").alias("cgst_amount"),
        amount("SGST").alias("sgst_amount"),
        amount("Total Tax").alias("total_tax"),
        amount("Sub Total").alias("subtotal"),
        amount("Grand Total").alias("grand_total"),
        "items",
    )

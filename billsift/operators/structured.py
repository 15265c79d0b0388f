"""Raw page extractions and the nested invoice form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billsift import constants as K
from billsift import functions as B
from billsift.functions.fields import is_ascii
from billsift.functions.text import or_blank

LOOSE_GSTIN = r"\b\d{2}[A-Z0-9]{13}\b"
INVOICE_NUMBER = r"(?i)Invoice No\.?\s*[:\-]?\s*(\S+)"
ORDER_NUMBER = r"(?i)PO No\.?\s*[:\-]?\s*(\d+)"


def raw_lines(pages: Column) -> Column:
    """Lines of a raw extraction: per page the text blocks, then the table rows.

    The cells of a row are joined by one blank.
    """

    def page(p: Column) -> Column:
        rows = F.flatten(F.transform(
            p["tables"], lambda table: F.transform(table, lambda row: F.array_join(row, " "))
        ))
        return F.concat(p["text_blocks"], rows)

    return F.flatten(F.transform(pages, page))


def leftover_lines(lines: Column, *used: Column) -> Column:
    """Lines not used elsewhere, with their repeats (``array_except`` drops those).

    Null lines go. The ``used`` lines (never null) are taken out one after the other, by generated
    code: in a lambda over the lines all of them would be interpreted, with the searches that find them.
    """
    return reduce(F.array_remove, used, F.array_compact(lines))


def structured_build(df: DataFrame, keys: tuple[str, ...], lines: str = "lines") -> DataFrame:
    """Nested invoice (``billsift.schemas.STRUCTURED_INVOICE``) out of a line array."""
    rows = F.col(lines)
    blank = F.lit("")

    def line(word: str) -> Column:
        return or_blank(B.first_with(rows, word, F.col("_lower")))

    picked = df.select(*keys, rows.alias(lines), B.joined(rows).alias("_text")).withColumns({
        "_lower": F.lower("_text"),
        "_upper": F.upper("_text"),
    }).withColumns({
        "_name": B.vendor_name(rows, folded=F.col("_upper")),
        "_buyer": line("buyer"),
        "_cgst": line("cgst"),
        "_sgst": line("sgst"),
        "_igst": line("igst"),
        "_words": or_blank(B.first_line(
            F.filter(rows, lambda x: F.contains(F.lower(x), F.lit("only"))), r"(?i)\bonly\b")),
        "_bank": line("bank"),
        "_money": B.amount_lines(rows),
    })
    text, money = F.col("_text"), F.col("_money")

    def group(start: str, pattern: str) -> Column:
        # a plain text is read from the first place that begins like a match; without one there is none
        at = F.locate(start, F.col("_lower"))
        plain = F.when(at > 0, F.regexp_extract(F.substring(text, at, F.length(text)), K.java_regex(pattern, "d"), 1))
        return or_blank(F.when(is_ascii(text), plain).otherwise(F.regexp_extract(text, K.java_regex(pattern), 1)))

    place = B.label_value(text, "Place of Supply", folded=F.col("_lower"))
    used = [F.col(c) for c in ("_name", "_buyer", "_cgst", "_sgst", "_igst", "_words", "_bank")]
    return picked.select(
        *keys,
        F.struct(
            F.col("_name").alias("name"),
            B.first_match(text, LOOSE_GSTIN).alias("gstin"),
            blank.alias("contact"),
        ).alias("supplier"),
        F.struct(
            F.col("_buyer").alias("name"),
            B.first_match(text, LOOSE_GSTIN).alias("gstin"),
            blank.alias("address"),
        ).alias("buyer"),
        F.struct(
            group("invoice no", INVOICE_NUMBER).alias("invoice_no"),
            B.first_match(text, K.DATE).alias("invoice_date"),
            group("po no", ORDER_NUMBER).alias("po_no"),
            F.when(place == "", "Unknown").otherwise(place).alias("place_of_supply"),
        ).alias("invoice_meta"),
        B.structured_items(rows).alias("line_items"),
        F.struct(
            F.col("_cgst").alias("cgst"),
            F.col("_sgst").alias("sgst"),
            F.col("_igst").alias("igst"),
        ).alias("taxes"),
        F.struct(
            B.pick_amount(money, "Taxable Value").alias("taxable_value"),
            B.pick_amount(money, "Total Tax").alias("total_tax"),
            B.pick_amount(money, "Grand Total").alias("grand_total"),
            F.col("_words").alias("amount_in_words"),
        ).alias("totals"),
        F.struct(
            F.col("_bank").alias("bank_name"),
            B.first_match(text, K.ACCOUNT).alias("account_no"),
            B.first_match(text, K.IFSC).alias("ifsc"),
        ).alias("bank_details"),
        leftover_lines(rows, *used).alias("declarations"),
    )


def structured_flatten(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Nested invoice to flat columns; items and declarations stay arrays."""
    return df.select(
        *keys,
        F.col("supplier.name").alias("vendor_name"),
        F.col("supplier.gstin").alias("vendor_gstin"),
        F.col("supplier.contact").alias("vendor_contact"),
        F.col("buyer.name").alias("buyer_name"),
        F.col("buyer.gstin").alias("buyer_gstin"),
        F.col("buyer.address").alias("buyer_address"),
        "invoice_meta.invoice_no",
        "invoice_meta.invoice_date",
        "invoice_meta.po_no",
        "invoice_meta.place_of_supply",
        "taxes.cgst",
        "taxes.sgst",
        "taxes.igst",
        "totals.taxable_value",
        "totals.total_tax",
        "totals.grand_total",
        "totals.amount_in_words",
        "bank_details.bank_name",
        "bank_details.account_no",
        "bank_details.ifsc",
        "line_items",
        "declarations",
    )

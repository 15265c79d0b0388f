"""Record layouts: names, order and types."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- Fixed values: record columns in order, with their export headers -------
RECORD_COLUMNS = {
    "filename": "Filename",
    "status": "Status",
    "processed_on": "Processed On",
    "ocr_method": "OCR Method",
    "invoice_type": "Invoice Type",
    "invoice_no": "Invoice No",
    "invoice_date": "Invoice Date",
    "due_date": "Due Date",
    "place_of_supply": "Place of Supply",
    "payment_terms": "Payment Terms",  # profile "b" only
    "currency": "Currency",
    "vendor_name": "Vendor Name",
    "vendor_address": "Vendor Address",
    "vendor_gstin": "Vendor GSTIN",
    "vendor_pan": "Vendor PAN",
    "vendor_email": "Vendor Email",
    "buyer_name": "Buyer Name",
    "buyer_address": "Buyer Address",
    "buyer_gstin": "Buyer GSTIN",
    "item_sr_nos": "Item Sr Nos",
    "item_descriptions": "Item Descriptions",
    "hsn_sac_codes": "HSN/SAC Codes",
    "quantities": "Quantities",
    "rates": "Rates",
    "item_amounts": "Item Amounts",
    "cgst_rate": "CGST Rate (%)",
    "cgst_amount": "CGST Amount",
    "sgst_rate": "SGST Rate (%)",
    "sgst_amount": "SGST Amount",
    "total_tax": "Total Tax",
    "subtotal": "Subtotal",
    "grand_total": "Grand Total",
    "amount_in_words": "Amount in Words",
    "bank_name": "Bank Name",
    "account_name": "Account Name",
    "account_number": "Account Number",
    "ifsc_code": "IFSC Code",
    "branch": "Branch",
    "raw_text": "Raw OCR Text",
}

# ---- Fixed values: stored columns, their defaults and export headers --------
STORE_DEFAULTS = {
    "invoice_number": "N/A",
    "invoice_date": "N/A",
    "vendor_name": "Unknown",
    "vendor_gstin": "N/A",
    "buyer_name": "Unknown",
    "cgst": "0",
    "sgst": "0",
    "grand_total": "0",
    "currency": "INR",
}
STORE_EXPORT = {
    "filename": "Filename",
    "invoice_number": "Invoice No",
    "invoice_date": "Invoice Date",
    "vendor_name": "Vendor Name",
    "vendor_gstin": "Vendor GSTIN",
    "buyer_name": "Buyer Name",
    "cgst": "CGST",
    "sgst": "SGST",
    "grand_total": "Grand Total",
    "currency": "Currency",
    "status": "Status",
    "upload_date": "Processed On",
}


def record_columns(profile: str = "a") -> list[str]:
    """Column names of a record; profile "b" adds the payment terms."""
    return [c for c in RECORD_COLUMNS if c != "payment_terms" or profile == "b"]


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RAW_EXTRACTION = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("pages", T.ArrayType(T.StructType([
        T.StructField("page", T.IntegerType()),
        T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))),
        T.StructField("text_blocks", T.ArrayType(T.StringType())),
    ]))),
])

STRUCTURED_INVOICE = T.StructType([
    T.StructField("supplier", _strings("name", "gstin", "contact")),
    T.StructField("buyer", _strings("name", "gstin", "address")),
    T.StructField("invoice_meta",
                  _strings("invoice_no", "invoice_date", "po_no", "place_of_supply")),
    T.StructField("line_items", T.ArrayType(
        _strings("description", "hsn", "qty", "unit", "rate", "amount"))),
    T.StructField("taxes", _strings("cgst", "sgst", "igst")),
    T.StructField("totals",
                  _strings("taxable_value", "total_tax", "grand_total", "amount_in_words")),
    T.StructField("bank_details", _strings("bank_name", "account_no", "ifsc")),
    T.StructField("declarations", T.ArrayType(T.StringType())),
])

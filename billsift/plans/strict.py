"""Strict reading over a layout with all that the plain rules get wrong, and its SQL.

The text is rendered from the order tables; the SQL computes the expected answer from
them by arithmetic, without the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billsift.functions import strict as S
from billsift.functions.text import text_lines
from billsift.plans.invoices import (
    account_number,
    buyer_gstin,
    grouped,
    order_items,
    order_lines,
    table,
    vendor_gstin,
)


def strict_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: one invoice per order that has items.

    Telephone and order numbers stand before the account, tax numbers hold others, customers
    end in nine digits, descriptions hold pipes, totals have item-like lines, headers differ,
    and bank and buyer blocks move with the order key.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").repartition("o_orderkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    bought = orders.join(order_items(order_lines(spark, sf_dir)), F.col("o_orderkey") == F.col("l_orderkey")) \
        .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left") \
        .join(supplier, F.col("suppkey") == F.col("s_suppkey"), "left")
    k, s, c, total = F.col("o_orderkey"), F.col("s_suppkey"), F.col("o_custkey"), F.col("total")
    tax = F.floor(total * 9 / 100).cast("bigint")
    grand = total + tax * 2

    def cat(*parts) -> F.Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))

    def row(i, x):
        mark = F.when(k % 5 == 0, F.lit("|A")).otherwise(F.lit(""))
        printed = grouped(x["cents"] + F.when(k % 11 == 0, F.lit(100)).otherwise(F.lit(0)))
        head = cat(i + 1, " Part ", x["l_partkey"], mark)
        code = x["l_partkey"] % 90 + 7300
        rate = grouped(F.floor((x["cents"] * 2 + x["qty"]) / (x["qty"] * 2)).cast("bigint"))
        return F.when(k % 3 == 0, cat(head, " ", code, " ", x["qty"], " ", printed)).otherwise(
            cat(head, " HSN ", code, " ", x["qty"], " NOS ", rate, " ", printed))

    buyer = F.concat_ws("\n", F.when(k % 2 == 0, F.lit("Bill To")).otherwise(F.lit("Invoice To")), "c_name",
                        cat("Street ", c), cat("GSTIN: ", buyer_gstin(c)))
    bank = F.concat_ws("\n", cat("Bank Name: Bank of Nation ", F.col("s_nationkey")), cat("Account Name: ", F.col("s_name")),
                       cat("Account No: ", account_number(s)),
                       cat("IFSC: ABCD0", F.lpad((s % 1000000).cast("string"), 6, "0")), F.lit("Branch: Main 12"))
    text = F.concat_ws(
        "\n",
        cat(F.col("s_name"), " PVT LTD"),
        cat("Unit ", s, " Industrial Estate"),
        cat("Phone: +91 9", F.lpad(s.cast("string"), 9, "0")),
        cat("GSTIN: ", vendor_gstin(s)),
        F.when(k % 2 == 0, cat("PAN: ", F.substring(vendor_gstin(s), 3, 10))),
        cat("Email: billing", s, "@vendor.example"),
        F.lit("TAX INVOICE"),
        cat("Invoice No: INV-", k),
        cat("PO No: ", k + 700000000),
        cat("Invoice Date: ", F.date_format("o_orderdate", "dd/MM/yyyy")),
        F.when(k % 13 != 0, buyer),
        F.when(k % 7 == 0, bank),
        F.when(k % 3 == 0, F.lit("Sr Particulars HSN/SAC Quantity Amount")).otherwise(
            F.lit("Sr Description HSN Qty Rate Amount")),
        F.array_join(F.transform("items", lambda x, i: row(i, x)), "\n"),
        F.when(k % 4 == 0, cat("Subtotal ", grouped(total))).otherwise(cat("Sub Total ", grouped(total))),
        cat("Taxable Value ", grouped(total)),
        cat("CGST 9% ", grouped(tax)),
        cat("SGST 9% ", grouped(tax)),
        cat("Total Tax ", grouped(tax * 2)),
        cat("Grand Total INR ", grouped(grand)),
        cat("Amount in Words: Rupees ", F.floor(grand / 100), " only"),
        F.when(k % 7 != 0, bank),
        F.when(k % 13 == 0, buyer),
    )
    return bought.select(k.alias("doc_id"), text.alias("text"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict_text(spark, sf_dir).select("doc_id", text_lines(F.col("text")).alias("lines"))


def strict_ids(spark, sf_dir):
    found = F.col("found")
    digits = r"\+?[\d ()-]+$"
    return _lines(spark, sf_dir).select("doc_id", S.identifiers(F.col("lines")).alias("found")).select(
        "doc_id",
        S.nth_of_kind(found, "gstin").alias("vendor_gstin"),
        S.nth_of_kind(found, "gstin", 1).alias("buyer_gstin"),
        S.nth_of_kind(found, "pan").alias("pan"),
        S.nth_of_kind(found, "account").alias("account"),
        S.nth_of_kind(found, "ifsc").alias("ifsc"),
        S.nth_of_kind(found, "email").alias("email"),
        F.trim(F.regexp_extract(S.nth_of_kind(found, "phone"), digits, 0)).alias("phone"),
        F.regexp_extract(S.nth_of_kind(found, "order"), r"\d+$", 0).alias("order_no"),
        F.array_join(F.transform(found, lambda x: x["kind"]), ",").alias("kinds"),
    )


def strict_lines(spark, sf_dir):
    long = _lines(spark, sf_dir).select("doc_id", F.posexplode(S.sections(F.col("lines"))))
    return long.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("place"), "col.section",
                       (F.col("col.first") + 1).cast("bigint").alias("first_line"),
                       F.size("col.lines").cast("bigint").alias("n_lines"))


def strict_totals(spark, sf_dir):
    """Amounts from the totals alone: no "TAX INVOICE", no item, "Subtotal" in either spelling."""
    own = _lines(spark, sf_dir).select("doc_id", S.section_lines(S.sections(F.col("lines")), "totals").alias("t"))
    t = F.col("t")
    wanted = {"subtotal": r"^sub ?total\b", "taxable": r"^taxable\b", "cgst": r"^cgst\b", "sgst": r"^sgst\b",
              "total_tax": r"^total tax\b", "grand_total": r"^grand total\b"}
    return own.select("doc_id", *[S.labelled_amount(t, p).cast("double").alias(name) for name, p in wanted.items()])


def strict_items(spark, sf_dir):
    items = _lines(spark, sf_dir).select("doc_id", F.explode_outer(S.strict_items(S.sections(F.col("lines")))).alias("i"))
    return items.where(F.col("i").isNotNull()).select(
        "doc_id", F.col("i.sr").cast("bigint").alias("sr"), "i.description", "i.hsn",
        F.col("i.qty").cast("bigint").alias("qty"), "i.unit", F.col("i.rate").cast("double").alias("rate"),
        F.col("i.amount").cast("double").alias("amount"), "i.amount_ok")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (strict_ids, strict_lines, strict_totals, strict_items)}


def oracle_sql(base: str) -> dict[str, str]:
    """SQL over ``base``, the common tables of an order ``d`` that the other queries use as well."""
    from_orders = f"WITH {base}, o AS (SELECT *, (total * 9) // 100 AS t9 FROM d WHERE copy = 0 AND NOT scanned)"
    return {
        "strict_ids": from_orders + """
            SELECT k AS doc_id, vgstin AS vendor_gstin, bgstin AS buyer_gstin,
              CASE WHEN k % 2 = 0 THEN substr(vgstin, 3, 10) ELSE '' END AS pan,
              CAST(500000000000 + s AS VARCHAR) AS account,
              'ABCD0' || lpad(CAST(s % 1000000 AS VARCHAR), 6, '0') AS ifsc,
              'billing' || s || '@vendor.example' AS email,
              '+91 9' || lpad(CAST(s AS VARCHAR), 9, '0') AS phone, CAST(700000000 + k AS VARCHAR) AS order_no,
              concat_ws(',', 'phone', 'gstin', CASE WHEN k % 2 = 0 THEN 'pan' END, 'email', 'order', 'date',
                CASE WHEN k % 13 <> 0 THEN 'gstin' END, 'account', 'ifsc',
                CASE WHEN k % 13 = 0 THEN 'gstin' END) AS kinds
            FROM o""",
        "strict_lines": from_orders + """, p AS (
              SELECT k, list_filter([
                {'section': 'header', 'n': 9 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END},
                CASE WHEN k % 13 <> 0 THEN {'section': 'buyer', 'n': 4} END,
                CASE WHEN k % 7 = 0 THEN {'section': 'bank', 'n': 5} END,
                {'section': 'items', 'n': CAST(n_lines + 1 AS INTEGER)},
                {'section': 'totals', 'n': 7},
                CASE WHEN k % 7 <> 0 THEN {'section': 'bank', 'n': 5} END,
                CASE WHEN k % 13 = 0 THEN {'section': 'buyer', 'n': 4} END], lambda x: x IS NOT NULL) AS parts FROM o)
            SELECT doc_id, place, section, n AS n_lines,
              CAST(1 + coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING
                AND 1 PRECEDING), 0) AS BIGINT) AS first_line
            FROM (SELECT k AS doc_id, CAST(i AS BIGINT) AS place, parts[i].section AS section, CAST(parts[i].n AS BIGINT) AS n
                  FROM p, range(1, 8) r(i) WHERE i <= len(parts))""",
        "strict_totals": from_orders + """
            SELECT k AS doc_id, total / 100.0::DOUBLE AS subtotal, total / 100.0::DOUBLE AS taxable,
              t9 / 100.0::DOUBLE AS cgst, t9 / 100.0::DOUBLE AS sgst, (2 * t9) / 100.0::DOUBLE AS total_tax,
              (total + 2 * t9) / 100.0::DOUBLE AS grand_total FROM o""",
        "strict_items": from_orders + """
            SELECT k AS doc_id, CAST(i AS BIGINT) AS sr, 'Part ' || items[i].p || CASE WHEN k % 5 = 0 THEN '|A' ELSE '' END
                AS description, CAST(items[i].p % 90 + 7300 AS VARCHAR) AS hsn, items[i].q AS qty,
              CASE WHEN k % 3 <> 0 THEN 'NOS' END AS unit,
              CASE WHEN k % 3 <> 0 THEN ((2 * items[i].c + items[i].q) // (2 * items[i].q)) / 100.0::DOUBLE END AS rate,
              (items[i].c + CASE WHEN k % 11 = 0 THEN 100 ELSE 0 END) / 100.0::DOUBLE AS amount,
              CASE WHEN k % 3 <> 0 THEN
                2 * abs(items[i].q * ((2 * items[i].c + items[i].q) // (2 * items[i].q)) - items[i].c
                  - CASE WHEN k % 11 = 0 THEN 100 ELSE 0 END) <= items[i].q END AS amount_ok
            FROM o, range(1, 200) r(i) WHERE i <= len(items)""",
    }

"""Invoice documents rendered from the order tables.

The tables hold orders, not texts, so this prepares the input the extractors
read: one text per order, and a second copy of some under another name. The
layout varies with the order key, so that every reading rule meets its edge
cases: missing keywords, labels on the line above, amounts without commas,
rates missing or spaced, wrong totals, dates ahead, foreign accounts,
formula-like names, an anchor with nothing after it, and texts too short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billsift.operators.documents import ERROR, page_gate, prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cents(money: Column) -> Column:
    return F.round(money * 100).cast("bigint")


def grouped(c: Column) -> Column:
    """Cents as ``1,234.50``."""
    return F.format_number(c.cast("double") / 100, 2)


def plain(c: Column) -> Column:
    """Cents as ``1234.50``."""
    return F.format_string("%.2f", c.cast("double") / 100)


def letters(n: Column) -> Column:
    """Five letters out of a number."""
    digits = F.lpad((n % 100000).cast("string"), 5, "0")
    return F.translate(digits, "0123456789", "ABCDEFGHIJ")


def digits4(n: Column) -> Column:
    return F.lpad((F.floor(n / 100000) % 10000).cast("string"), 4, "0")


def vendor_gstin(n: Column) -> Column:
    return F.concat(F.lit("27"), letters(n), digits4(n), F.lit("P1Z5"))


def buyer_gstin(n: Column) -> Column:
    return F.concat(F.lit("29"), letters(n), digits4(n), F.lit("C1Z7"))


def account_number(n: Column) -> Column:
    return (n + 500000000000).cast("string")


def vendor_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        vendor_gstin(s).alias("gstin"),
        F.col("s_name").alias("vendor_name"),
        account_number(s).alias("account_number"),
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("bigint").alias("qty"),
        cents(F.col("l_extendedprice")).alias("cents"),
    )


def order_items(kept: DataFrame) -> DataFrame:
    """Items per order, with the lowest supplier key as the vendor."""
    item = F.struct("l_linenumber", "l_partkey", "qty", "cents")
    return kept.groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("suppkey"),
        F.sum("cents").alias("total"),
        F.array_sort(F.collect_list(item)).alias("items"),
    )


def _choose(k: Column, n: int, options: dict[int, Column], default: Column) -> Column:
    cases = [F.when(k % n == value, result) for value, result in options.items()]
    return F.coalesce(*cases, default)


def invoice_text(spark: SparkSession, sf_dir: str, max_lines: int | None = None) -> DataFrame:
    """``doc_id, path, raw_text, fallback_text``: the rendered documents.

    With a limit, an order with more items has no text but an ``error_reason``.
    """
    lines = order_lines(spark, sf_dir)
    # The join on the order key needs this partitioning anyhow once the items
    # outgrow a broadcast; named here, the text work never runs in one task.
    # Customers are joined ahead of it, so that no item is moved by customer.
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate") \
        .join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").repartition("o_orderkey")
    refused = F.lit(False)
    if max_lines is not None:
        lines, rejected = page_gate(lines, "l_orderkey", max_lines)
        orders = orders.join(rejected.select(F.col("l_orderkey").alias("o_orderkey"), F.lit(
            "TOO_MANY_PAGES").alias(ERROR)), "o_orderkey", "left")
        refused = F.col(ERROR).isNotNull()
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    bought = (
        orders.join(order_items(lines), F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(supplier, F.col("suppkey") == F.col("s_suppkey"), "left")
    )
    k, s, c = F.col("o_orderkey"), F.col("s_suppkey"), F.col("o_custkey")
    rate = _choose(k, 3, {0: F.lit(9), 1: F.lit(6)}, F.lit(14))
    total = F.col("total")
    priced = bought.withColumn("rate", rate.cast("bigint")).withColumn(
        "sub", F.floor((total * 100 + 59) / (F.lit(100) + F.col("rate") * 2)).cast("bigint")
    ).withColumn("tax", F.floor((F.col("sub") * F.col("rate") + 50) / 100).cast("bigint"))
    sub, tax, pct = F.col("sub"), F.col("tax"), F.col("rate").cast("string")

    def cat(*parts: Column | str) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    def text(n: Column) -> Column:
        return n.cast("string")

    company = _choose(
        k, 6, {5: cat("=", F.col("s_name")), 4: cat("-", F.col("s_name"))}, F.col("s_name")
    )
    company = F.when(k % 23 == 0, cat(company, " Traders")).otherwise(cat(company, " PVT LTD"))
    issued = F.when(k % 29 == 0, F.add_months("o_orderdate", 480)).otherwise(
        F.col("o_orderdate").cast("date")
    )
    day = F.when(k % 2 == 1, F.date_format(issued, "dd-MM-yyyy")).otherwise(
        F.date_format(issued, "dd/MM/yyyy")
    )
    due = F.date_format(F.date_add(issued, 30), "dd/MM/yyyy")
    currency = _choose(k, 4, {0: F.lit("Rs."), 1: F.lit("₹"), 2: F.lit("Rs ")}, F.lit("INR "))
    grand = total + F.when(k % 17 == 0, F.lit(10000)).otherwise(F.lit(0))
    account = account_number(s + F.when(k % 31 == 0, F.lit(7)).otherwise(F.lit(0)))
    anchor_last = k % 37 == 0

    def line(i: Column, x: Column) -> Column:
        return cat(
            text(i + 1), " Part ", text(x["l_partkey"]), " HSN ",
            text(x["l_partkey"] % 90 + 7300), " ", text(x["qty"]), " NOS ", grouped(x["cents"]),
        )

    item_lines = F.array_join(F.transform(F.col("items"), lambda x, i: line(i, x)), "\n")
    buyer = F.concat_ws(
        "\n",
        _choose(k, 3, {0: F.lit("Invoice To"), 1: F.lit("Bill To")}, F.lit("BILL TO:")),
        F.col("c_name"),
        cat("Street ", text(c)),
        F.col("c_mktsegment"),
        cat("Nation ", text(F.col("c_nationkey"))),
        cat("GSTIN: ", buyer_gstin(c)),
    )
    full = F.concat_ws(
        "\n",
        company,
        cat("Unit ", text(s), " Industrial Estate"),
        cat("Nation ", text(F.col("s_nationkey"))),
        cat("GSTIN: ", vendor_gstin(s)),
        F.when(k % 2 == 0, cat("PAN: ", letters(s), digits4(s), "P")),
        cat("Email: billing", text(s), "@vendor.example"),
        F.when(k % 5 == 0, F.lit("INVOICE")).otherwise(F.lit("TAX INVOICE")),
        F.when(k % 13 == 0, cat("Invoice No. ", text(k))).otherwise(
            cat("Invoice No: INV-", text(k))
        ),
        cat("Invoice Date: ", day),
        F.when(k % 7 == 0, cat("Due Date:\n", due)).otherwise(cat("Due Date: ", due)),
        cat("Place of Supply: State ", text(F.col("c_nationkey"))),
        F.lit("Payment Terms - NET 30"),
        F.when(~anchor_last, buyer),
        F.lit("  Sr Description HSN Qty Amount  "),
        item_lines,
        F.lit(""),
        cat("Sub Total ", grouped(sub)),
        F.when(k % 19 == 0, cat("CGST @ ", pct, " % ", grouped(tax))).otherwise(
            cat("CGST ", pct, "% ", grouped(tax))
        ),
        F.when(k % 8 == 0, cat("SGST ", grouped(tax))).otherwise(
            cat("SGST ", pct, "% ", grouped(tax))
        ),
        cat("Total Tax ", grouped(tax * 2)),
        cat("Grand Total ", currency,
            F.when(k % 11 == 0, plain(grand)).otherwise(grouped(grand))),
        cat("Amount in Words: Rupees ", text(F.floor(grand / 100)), " only"),
        cat("Bank Name: Bank of Nation ", text(F.col("s_nationkey"))),
        cat("Account Name: ", F.col("s_name")),
        cat("Account No: ", account),
        cat("IFSC: ABCD0", F.lpad(text(s % 1000000), 6, "0")),
        cat("Branch: Main ", text(F.col("s_nationkey"))),
        F.when(anchor_last, F.lit("Bill To")),
        F.lit(""),
    )
    scanned = F.concat_ws(
        "\n",
        F.lit("TAX INVOICE"),
        cat("Invoice No: SCAN-", text(k)),
        F.lit("Bill To"),
        F.col("c_name"),
        F.lit(""),
    )
    copies = F.when(k % 41 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    empty = F.col("items").isNull() & ~refused
    reasons = [ERROR] if max_lines is not None else []
    texts = priced.select(
        k,
        F.when(empty, cat("Scan ", text(k), "\n")).when(~refused, full).alias("raw_text"),
        F.when(empty, scanned).alias("fallback_text"),
        *reasons,
    )
    name = F.when(F.col("copy") == 1, F.lit("copy_of_invoice_")).otherwise(F.lit("invoice_"))
    return texts.withColumn("copy", F.explode(copies)).select(
        (k * 2 + F.col("copy")).alias("doc_id"),
        F.concat(F.lit("inbox/"), name, text(k), F.lit(".txt")).alias("path"),
        "raw_text",
        "fallback_text",
        *reasons,
    )


def prepared_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered documents with the fallback applied and currency marks normalised."""
    return prepare(invoice_text(spark, sf_dir))

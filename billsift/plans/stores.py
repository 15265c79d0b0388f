"""Queries on the store under retries and several writers, bounded streams, the extractor hook, rollups and long items."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billsift import functions as B
from billsift.operators import documents, store, validate
from billsift.operators.records import extract_record
from billsift.plans import strict
from billsift.plans.invoices import prepared_invoices, table
from billsift.session import shared_dir
from billsift.sources import committed, files
from billsift.streaming import ingest

#: How far behind the latest event a row may come.
DELAY = "10 days"
TURN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                     T.StructField("text", T.StringType())])


# ---- the store --------------------------------------------------------------

def _appended(spark: SparkSession, sf_dir: str) -> str:
    """Documents appended in three batches; the first is sent again, between the others and at the end."""
    path = shared_dir(spark, "store")
    docs = table(spark, sf_dir, "documents").select("doc_id", B.content_hash(F.col("text")).alias("file_hash"))
    first, second = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 2")
    for name, batch in (("a", first), ("b", second), ("a", first), ("c", docs), ("a", first)):
        committed.append_batch(batch, path, name, "file_hash", ["doc_id"])
    return path


def store_appends(spark, sf_dir):
    """Every row of the store with the batch that brought it."""
    return committed.read_committed(spark, _appended(spark, sf_dir)).select("doc_id", "file_hash", "batch")


def store_batch_ids(spark, sf_dir):
    """Ids of each batch: as many as rows, without gaps, above those of the batch before."""
    rows = committed.read_committed(spark, _appended(spark, sf_dir))
    return rows.groupBy("batch").agg(
        F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.min("id").alias("first_id"),
        F.max("id").alias("last_id"))


def status_rollup(spark, sf_dir):
    prepared = prepared_invoices(spark, sf_dir)
    hashed = prepared.withColumn("file_hash", B.content_hash(F.col("raw_text")))
    records = extract_record(hashed, F.lit("2024-01-02").cast("timestamp"), keys=("file_hash",))
    return store.status_rollup(records.select("file_hash", "vendor_name", "status"), "file_hash")


def reconcile_long(spark, sf_dir):
    """Strictly read items and headers as two tables, each of which lacks some documents."""
    items = strict.strict_items(spark, sf_dir).where("doc_id % 10 <> 7").select(
        "doc_id", F.col("amount").cast("decimal(18,2)").alias("amount"))
    headers = strict.strict_totals(spark, sf_dir).where("doc_id % 10 <> 3").select(
        "doc_id", F.col("subtotal").cast("decimal(18,2)").alias("subtotal"))
    return validate.reconcile_long(items, headers, "doc_id", total="subtotal").withColumns(
        {c: F.col(c).cast("double") for c in ("subtotal", "items_sum")})


# ---- files ------------------------------------------------------------------

def scan_pages(spark, sf_dir):
    """Pages written as files of 16 folders and scanned: names, sizes and a reason for the large ones."""
    path = shared_dir(spark, "pages")
    pages = table(spark, sf_dir, "pages").select("html", (F.col("page_id") % 16).alias("bucket"))
    pages.repartition("bucket").write.partitionBy("bucket").text(path)
    found = files.scan_files(spark, path, "*.txt", max_bytes=36_000)
    bucket = F.regexp_extract("path", r"bucket=(\d+)", 1).cast("bigint")
    return found.groupBy(bucket.alias("bucket")).agg(
        F.sum("length").alias("length"), F.max("error_reason").alias("error_reason"),
        F.sum(F.octet_length("content")).cast("bigint").alias("n_read"))


def split_pages(content: bytes) -> Iterable[str]:
    """An extractor: a page per line of UTF-8."""
    return content.decode("utf-8").split("\n")


def extract_pages(spark, sf_dir):
    """The bytes of pages; some are no UTF-8, some were refused before."""
    content = F.col("html").cast("binary")
    broken = F.when(F.col("page_id") % 17 == 0, F.concat(content, F.unhex(F.lit("FF")))).otherwise(content)
    refused = F.when(F.col("page_id") % 19 == 0, F.lit("FILE_TOO_LARGE"))
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("path"), F.when(refused.isNull(), broken).alias("content"),
        refused.alias("error_reason"))
    return documents.extract_pages(pages, split_pages).select(
        F.col("path").cast("bigint").alias("page_id"), F.col("page_no").cast("bigint").alias("page_no"), "page_text",
        "error_reason")


# ---- streams ----------------------------------------------------------------

def _deduped(spark: SparkSession, sf_dir: str) -> str:
    """Events in two micro-batches, a fifth of them after all others."""
    landing, out, log = (shared_dir(spark, n) for n in ("landing", "unique", "progress"))
    key = F.concat_ws("|", F.col("user_id") % 200, "event_type")
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), B.content_hash(key).alias("file_hash"))
    for part in ("event_id % 5 <> 0", "event_id % 5 = 0"):
        events.where(part).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(events.schema).parquet(landing)
        ingest.dedupe_stream(stream, out, log, "file_hash", "ts", DELAY, ["ts", "event_id"]).awaitTermination()
    return out


def stream_first_seen(spark, sf_dir):
    rows = spark.read.parquet(f"{_deduped(spark, sf_dir)}/rows")
    return rows.select("event_id", "file_hash", F.col("batch_id").cast("bigint").alias("batch_id"))


def stream_late(spark, sf_dir):
    counts = spark.read.parquet(f"{_deduped(spark, sf_dir)}/batches")
    return counts.select(F.col("batch_id").cast("bigint").alias("batch_id"), "n_rows", "n_late", "n_new")


def stream_json(spark, sf_dir):
    """Turns as JSON lines, some cut off, some with a wrong type; a second run finds nothing new."""
    landing, out, dead, log = (shared_dir(spark, n) for n in ("landing", "turns", "dead", "progress"))
    case = (F.col("conv_id") + F.col("turn")) % 7
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    start = F.concat(F.lit('{"conv_id":'), F.col("conv_id"), F.lit(',"turn":'), F.col("turn"))
    line = F.when(case == 0, start).when(case == 1, F.concat(start, F.lit('.5,"text":"x"}'))).otherwise(
        F.to_json(F.struct("conv_id", "turn", "text")))
    turns.select(line.alias("value")).write.text(landing)
    for _ in range(2):
        ingest.json_stream(spark, landing, TURN, out, dead, log).awaitTermination()
    good = spark.read.parquet(out).select(*TURN.names, F.lit(None).cast("string").alias("line"))
    lost = spark.read.parquet(dead).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in TURN], "line")
    return good.unionByName(lost)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        store_appends, store_batch_ids, status_rollup, reconcile_long, scan_pages, extract_pages, stream_first_seen,
        stream_late, stream_json)}


BATCHES = """
h AS (SELECT doc_id, sha256(text) AS file_hash FROM documents),
x AS (SELECT doc_id, file_hash, batch FROM h, (VALUES ('a'), ('b'), ('c')) v(batch)
      WHERE batch = 'c' OR batch = 'b' AND doc_id % 3 <> 2 OR doc_id % 3 = 0),
s AS (SELECT file_hash, min(batch) AS batch FROM x GROUP BY file_hash),
r AS (SELECT min(doc_id) AS doc_id, file_hash, batch FROM x JOIN s USING (file_hash, batch) GROUP BY file_hash, batch)
"""
EVENTS = """
e AS (SELECT event_id, ts, sha256((user_id % 200) || '|' || event_type) AS file_hash, event_id % 5 = 0 AS second FROM events),
w AS (SELECT max(ts) - INTERVAL 10 DAYS AS mark FROM e WHERE NOT second),
a AS (SELECT * FROM e WHERE NOT second QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY ts, event_id) = 1),
b AS (SELECT e.* FROM e, w WHERE second AND ts >= mark
        AND file_hash NOT IN (SELECT file_hash FROM a, w WHERE a.ts >= mark)
      QUALIFY row_number() OVER (PARTITION BY file_hash ORDER BY ts, event_id) = 1)
"""


def oracle_sql(truth: Callable[[str], str]) -> dict[str, str]:
    """SQL of these queries; ``truth`` puts the orders' arithmetic (``d``) before a statement."""
    return {
        "store_appends": f"WITH {BATCHES} SELECT doc_id, file_hash, batch FROM r",
        "store_batch_ids": f"""
            WITH {BATCHES}, n AS (SELECT batch, count(*) AS n_rows FROM r GROUP BY batch)
            SELECT batch, n_rows, n_rows AS n_ids,
              CAST(sum(n_rows) OVER (ORDER BY batch) - n_rows + 1 AS BIGINT) AS first_id,
              CAST(sum(n_rows) OVER (ORDER BY batch) AS BIGINT) AS last_id FROM n""",
        "status_rollup": truth("""
            , v AS (SELECT CASE WHEN failed THEN 'N/A' WHEN scanned THEN ''
                      WHEN k % 23 = 0 THEN '' ELSE company END AS vendor_name,
                    CASE WHEN failed THEN 'ERROR' ELSE 'PROCESSED' END AS status, k FROM d)
            SELECT vendor_name, status, CAST(grouping(vendor_name, status) AS INTEGER) AS level,
              count(*) AS n_documents, count(DISTINCT k) AS n_different, count(*) - count(DISTINCT k) AS n_copies
            FROM v GROUP BY ROLLUP (vendor_name, status)"""),
        "reconcile_long": truth("""
            , i AS (SELECT k, total + CASE WHEN k % 11 = 0 THEN 100 * n_lines ELSE 0 END AS items_sum, n_lines FROM d
                    WHERE copy = 0 AND NOT scanned AND k % 10 <> 7),
            t AS (SELECT k, total FROM d WHERE copy = 0 AND NOT scanned AND k % 10 <> 3)
            SELECT coalesce(t.k, i.k) AS doc_id, total / 100.0::DOUBLE AS subtotal,
              coalesce(n_lines, 0) AS n_items, items_sum / 100.0::DOUBLE AS items_sum,
              CASE WHEN i.k IS NULL THEN 'no items' WHEN t.k IS NULL THEN 'no header' ELSE 'both' END AS side,
              total = items_sum AS reconciles
            FROM t FULL JOIN i ON t.k = i.k"""),
        "scan_pages": """
            SELECT page_id % 16 AS bucket, CAST(sum(strlen(html) + 1) AS BIGINT) AS length,
              CASE WHEN sum(strlen(html) + 1) > 36000 THEN 'FILE_TOO_LARGE' END AS error_reason,
              CASE WHEN sum(strlen(html) + 1) <= 36000 THEN CAST(sum(strlen(html) + 1) AS BIGINT) END AS n_read
            FROM pages GROUP BY 1""",
        "extract_pages": """
            SELECT page_id, CAST(i AS BIGINT) AS page_no, lines[i] AS page_text, NULL::VARCHAR AS error_reason
            FROM (SELECT page_id, string_split(html, chr(10)) AS lines FROM pages
                  WHERE page_id % 17 <> 0 AND page_id % 19 <> 0), range(1, 100000) r(i) WHERE i <= len(lines)
            UNION ALL
            SELECT page_id, NULL, NULL, CASE WHEN page_id % 19 = 0 THEN 'FILE_TOO_LARGE' ELSE 'UnicodeDecodeError' END
            FROM pages WHERE page_id % 17 = 0 OR page_id % 19 = 0""",
        "stream_first_seen": f"""
            WITH {EVENTS} SELECT event_id, file_hash, 0::BIGINT AS batch_id FROM a
            UNION ALL SELECT event_id, file_hash, 1 FROM b""",
        "stream_late": f"""
            WITH {EVENTS} SELECT 0::BIGINT AS batch_id, count(*) AS n_rows, 0::BIGINT AS n_late,
              (SELECT count(*) FROM a) AS n_new FROM e WHERE NOT second
            UNION ALL
            SELECT 1, count(*), count(*) FILTER (ts < mark), (SELECT count(*) FROM b) FROM e, w WHERE second""",
        "stream_json": """
            SELECT conv_id, turn, text, NULL::VARCHAR AS line FROM conversations WHERE (conv_id + turn) % 7 > 1
            UNION ALL
            SELECT NULL, NULL, NULL, '{"conv_id":' || conv_id || ',"turn":' || turn
              || CASE WHEN (conv_id + turn) % 7 = 1 THEN '.5,"text":"x"}' ELSE '' END
            FROM conversations WHERE (conv_id + turn) % 7 <= 1""",
    }

"""Documents: page limits, page folding and the short-text fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billsift import constants as K
from billsift.functions.text import normalize_currency, or_blank, strip_ws

# Pages of this many neighbouring numbers are brought together first.
PAGE_BLOCK_BITS = 10
ERROR = "error_reason"


def page_gate(pages: DataFrame, doc: str, max_pages: int) -> tuple[DataFrame, DataFrame]:
    """Split pages into those of documents within a limit and the refused documents.

    Only for callers that want a limit. Pages are counted on the key column alone,
    with partial counts per task; the refused side has one row per document:
    ``(doc, n_pages)``.
    """
    rejected = pages.groupBy(doc).agg(F.count("*").alias("n_pages")).where(
        F.col("n_pages") > max_pages
    )
    return pages.join(rejected.select(doc), doc, "left_anti"), rejected


def fold_pages(pages: DataFrame, doc: str, page: str, text: str,
               max_pages: int | None = None) -> DataFrame:
    """One row per document: its non-empty pages in order, each ended by a newline.

    Pages meet in two steps, by block of page numbers and then by document, so
    the pages of a long document are gathered in many tasks. A page's own
    ``error_reason`` becomes the document's, which then has no text. With a limit, a
    document over it stays as a row with a reason.
    """
    reasons = [ERROR] if ERROR in pages.columns else []
    kept, rejected = pages.select(doc, page, text, *reasons), None
    if max_pages is not None:
        kept, rejected = page_gate(kept, doc, max_pages)
    reason = F.max(ERROR) if reasons else F.lit(None).cast("string")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page), F.col(text))))
    filled = F.filter(ordered, lambda p: p[text] != "")
    joined = F.array_join(F.transform(filled, lambda p: F.concat(p[text], F.lit("\n"))), "")
    blocks = kept.groupBy(doc, F.shiftright(page, PAGE_BLOCK_BITS).alias("_block")).agg(
        F.count("*").alias("n_pages"), joined.alias("raw_text"), reason.alias(ERROR)
    )
    parts = F.array_sort(F.collect_list(F.struct("_block", "raw_text")))
    folded = blocks.groupBy(doc).agg(
        F.sum("n_pages").alias("n_pages"),
        F.array_join(F.transform(parts, lambda p: p["raw_text"]), "").alias("raw_text"),
        F.max(ERROR).alias(ERROR),
    ).withColumn("raw_text", F.when(F.col(ERROR).isNull(), F.col("raw_text")))
    if rejected is None:
        return folded
    refused = rejected.withColumn(ERROR, F.lit("TOO_MANY_PAGES"))
    return folded.unionByName(refused, allowMissingColumns=True)


def is_short(text: Column, min_chars: int = K.SHORT_TEXT_CHARS) -> Column:
    """Too little text to be a digital document; blanks at the ends do not count.

    Most texts hold enough in their first signs already; only others are trimmed whole.
    """
    known = or_blank(text)
    enough = F.length(strip_ws(F.left(known, F.lit(4 * min_chars)))) >= min_chars
    return F.when(enough, F.lit(False)).otherwise(F.length(strip_ws(known)) < min_chars)


def route_short_text(df: DataFrame, text: str, fallback: str,
                     min_chars: int = K.SHORT_TEXT_CHARS) -> DataFrame:
    """Append the fallback column to short texts and tag how the text was got."""
    short = is_short(F.col(text), min_chars)
    joined = F.concat(or_blank(F.col(text)), or_blank(F.col(fallback)))
    return df.withColumns({
        "ocr_method": F.when(short, F.lit("OCR")).otherwise(F.lit("TEXT")),
        text: F.when(short, joined).otherwise(F.col(text)),
    })


def route_with_pages(docs: DataFrame, fallback_pages: DataFrame, doc: str, text: str,
                     page: str, page_text: str,
                     min_chars: int = K.SHORT_TEXT_CHARS) -> DataFrame:
    """As ``route_short_text`` with the fallback in another table of pages.

    Only short documents take part in the join, and only their pages are
    folded; long texts are never shuffled. A reason on either side stays.
    """
    short = is_short(F.col(text), min_chars)
    long_docs = docs.where(~short).withColumn("ocr_method", F.lit("TEXT"))
    short_docs = docs.where(short)
    wanted = fallback_pages.join(short_docs.select(doc), doc, "left_semi")
    fallback = fold_pages(wanted, doc, page, page_text).select(
        doc, F.col("raw_text").alias("_fallback"), F.col(ERROR).alias("_reason")
    )
    routed = short_docs.join(fallback, doc, "left").select(
        *[c for c in docs.columns if c not in (text, ERROR)],
        F.coalesce(F.col(ERROR) if ERROR in docs.columns else F.lit(None), "_reason").alias(ERROR),
        F.concat(or_blank(F.col(text)), or_blank(F.col("_fallback"))).alias(text),
        F.lit("OCR").alias("ocr_method"),
    )
    if ERROR not in docs.columns and ERROR not in fallback_pages.columns:
        routed = routed.drop(ERROR)
    return long_docs.unionByName(routed, allowMissingColumns=True)


def prepare(docs: DataFrame, text: str = "raw_text", fallback: str = "fallback_text") -> DataFrame:
    """Route, then normalise currency marks: the text every extractor reads."""
    routed = route_short_text(docs, text, fallback).drop(fallback)
    return routed.withColumn(text, normalize_currency(F.col(text)))


def extract_pages(files: DataFrame, extractor: Callable[[bytes], Iterable[str]],
                  batch_bytes: int = 8 * 1024 * 1024) -> DataFrame:
    """Hook for any page-text extractor over ``binaryFile`` rows, in Arrow batches.

    A file's pages leave together; batches are closed at ``batch_bytes`` of text, so a
    task holds one file's pages and one batch. Contents come in batches that Spark bounds by
    ``spark.sql.execution.arrow.maxBytesPerBatch``. A file that the extractor
    cannot read, at whatever page, or that came with a reason, becomes one row with a reason, and
    the others go on. A file without pages has no row.
    """
    reason = F.col(ERROR) if ERROR in files.columns else F.lit(None).cast("string")
    schema = pa.schema([("path", pa.string()), ("page_no", pa.int32()), ("page_text", pa.string()), (ERROR, pa.string())])

    def pages(path: str, content: bytes, refused: str | None) -> list[tuple]:
        if refused is not None:
            return [(path, None, None, refused)]
        try:
            return [(path, n, text, None) for n, text in enumerate(extractor(content), 1)]
        except Exception as failure:  # any file may be broken in any way
            return [(path, None, None, type(failure).__name__)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def closed() -> pa.RecordBatch:
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for n in range(batch.num_rows):  # one file's bytes at a time
                for row in pages(*(batch.column(k)[n].as_py() for k in range(3))):
                    rows.append(row)
                    size += len(row[2] or "") + 64
                    if size >= batch_bytes:
                        yield closed()
                        rows, size = [], 0
        if rows:
            yield closed()

    return files.select("path", "content", reason.alias(ERROR)).mapInArrow(
        run, "path string, page_no int, page_text string, error_reason string")

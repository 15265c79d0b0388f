"""File sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billsift import constants as K
from billsift.operators.candidates import candidate_parse
from billsift.schemas import RAW_EXTRACTION, STRUCTURED_INVOICE


def size_gate(files: DataFrame, length: str = "length",
              max_bytes: int = K.MAX_FILE_BYTES) -> DataFrame:
    """Mark files within the size limit."""
    return files.withColumn("size_ok", F.col(length) <= max_bytes)


def scan_files(spark: SparkSession, path: str, glob: str = "*.pdf",
               max_bytes: int = K.MAX_FILE_BYTES) -> DataFrame:
    """Files as ``binaryFile`` rows with ``error_reason``.

    The limit is pushed into the scan: a larger file is never read, but stays as a
    row without content and with a reason.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
    )
    read = files.where(F.col("length") <= max_bytes).withColumn(
        "error_reason", F.lit(None).cast("string"))
    large = files.where(F.col("length") > max_bytes).select(
        "path", "modificationTime", "length", F.lit("FILE_TOO_LARGE").alias("error_reason"))
    return read.unionByName(large, allowMissingColumns=True)


def has_magic(content: Column, magic: bytes) -> Column:
    """Whether the content starts with the type's own bytes, whatever its name."""
    return F.substring(content, 1, len(magic)) == F.lit(magic)


def type_gate(files: DataFrame, magic: bytes = b"%PDF-") -> DataFrame:
    """Mark files whose first bytes are those of the expected type."""
    return files.withColumn("type_ok", has_magic(F.col("content"), magic))


def _read_json(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    fields = T.StructType([*schema.fields, T.StructField("error_reason", T.StringType())])
    found = spark.read.schema(fields).option("multiLine", multi_line).option(
        "columnNameOfCorruptRecord", "error_reason").json(path)
    return found.withColumn("error_reason", F.when(
        F.col("error_reason").isNotNull(), F.lit("MALFORMED_JSON")))


def read_raw_extraction(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested page extractions from JSON lines; with ``multi_line`` one object or array per file.

    A line or file that cannot be parsed is a row with ``error_reason``.
    """
    return _read_json(spark, path, RAW_EXTRACTION, multi_line)


def read_structured(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested invoices, read as ``read_raw_extraction`` does."""
    return _read_json(spark, path, STRUCTURED_INVOICE, multi_line)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate texts, one per file, with the page number from the file name."""
    texts = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(
        F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text")
    )
    return candidate_parse(texts)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as documents."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw_text")
    )

"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from billsift.operators.dedupe import append_new, first_by_hash
from billsift.operators.documents import prepare
from billsift.operators.records import extract_record

TEXT_GLOB = "*.txt"
NOTHING_STORED = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_text_stream(spark: SparkSession, path: str, max_files: int = 10_000) -> DataFrame:
    """Text files as they land, one document each."""
    files = spark.readStream.option("maxFilesPerTrigger", max_files).text(
        path, wholetext=True, pathGlobFilter=TEXT_GLOB
    )
    return files.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("raw_text"),
        F.lit("").alias("fallback_text"),
    )


def ingest_stream(docs: DataFrame, out_dir: str, checkpoint: str, run_ts: datetime,
                  profile: str = "a", keys: tuple[str, ...] = ()) -> StreamingQuery:
    """New documents become records; each trigger drains what has landed.

    Records hold their whole texts, so they are written in the denser compression.
    """
    records = extract_record(prepare(docs), run_ts, profile, keys=keys)
    return (
        records.writeStream.format("parquet")
        .option("path", out_dir)
        .option("compression", "zstd")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_seen(docs: DataFrame, hash_col: str, event_time: str | None = None,
               delay: str = "1 day") -> DataFrame:
    """The first row per hash of a stream.

    Without an event time the state keeps every hash for good. With one, a
    hash is forgotten once the watermark passes: bounded state, and a copy
    that comes later than ``delay`` is let through; the store refuses it.
    All copies of a hash meet in one state partition: where one document may
    make up much of a batch, use ``store_stream``, which reduces copies first.
    """
    if event_time is None:
        return docs.dropDuplicates([hash_col])
    return docs.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([hash_col])


def store_stream(docs: DataFrame, store_dir: str, checkpoint: str, hash_col: str,
                 order: list[str]) -> StreamingQuery:
    """First-wins append across runs, with no streaming state at all.

    Each micro-batch is compared with the store and written to its own folder,
    which a retry of the same batch overwrites: a lost executor or a restarted
    query neither repeats nor loses a row. The store is foldered by the first two
    signs of the hash (rows without one apart), and a batch reads only the folders
    of its own hashes: 257 at most, so their names may come to the driver.
    """
    prefix = F.coalesce(F.substring(hash_col, 1, 2), F.lit("none"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            own = [r[0] for r in batch.select(prefix).distinct().collect()]
            stored = spark.read.schema(f"{hash_col} string, batch_id bigint, prefix string").parquet(store_dir)
            store = stored.where((F.col("batch_id") != batch_id) & F.col("prefix").isin(own))
        except AnalysisException as failure:
            if failure.getCondition() not in NOTHING_STORED:
                raise
            store = batch.select(hash_col).limit(0)
        new = append_new(batch, store, hash_col, order)
        new.withColumn("prefix", prefix).write.mode("overwrite").partitionBy("prefix").parquet(
            f"{store_dir}/batch_id={batch_id}")

    return (
        docs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dedupe_stream(docs: DataFrame, out_dir: str, checkpoint: str, hash_col: str, event_time: str,
                  delay: str, order: list[str]) -> StreamingQuery:
    """The first row per hash of a stream, with bounded state and one row a task of a hot hash.

    The watermark of a micro-batch is the latest event time of the batches before it less
    ``delay`` (an interval, as ``10 days``). Rows behind it are late: counted, not let through. The others are cut
    to the first per hash in each task, then compared with the rows let through at or after the
    watermark; older ones are forgotten, and their files are skipped by their statistics. So
    the state that a batch reads is what came within ``delay``, however long the stream.

    ``out_dir/rows/batch_id=N`` holds the rows, ``out_dir/batches/batch_id=N`` one row of counts and the
    latest event time. A batch that runs again overwrites its own folders and reads only
    those before it, so a lost executor or a restart neither repeats nor loses a row.
    """

    def earlier(spark: SparkSession, name: str, schema: str, batch_id: int) -> DataFrame | None:
        try:
            found = spark.read.schema(f"{schema}, batch_id bigint").parquet(f"{out_dir}/{name}")
        except AnalysisException as failure:
            if failure.getCondition() not in NOTHING_STORED:
                raise
            return None
        return found.where(F.col("batch_id") < batch_id)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = earlier(spark, "batches", "latest timestamp", batch_id)
        latest = known.agg(F.max("latest").alias("t")).select(
            (F.col("t") - F.expr(f"INTERVAL {delay}")).alias("t"), F.col("t").alias("latest")).first() if known else None
        mark, before = (latest["t"], latest["latest"]) if latest else (None, None)
        time = F.col(event_time)
        on_time = F.lit(True) if mark is None else F.coalesce(time >= F.lit(mark), F.lit(True))
        batch = batch.persist()  # its source is read once
        try:
            new = first_by_hash(batch.where(on_time), hash_col, order)
            rows = earlier(spark, "rows", f"{hash_col} string, {event_time} timestamp", batch_id)
            if rows is not None:
                held = rows if mark is None else rows.where(time >= F.lit(mark))
                new = new.join(held.select(hash_col), hash_col, "left_anti").select(*batch.columns)
            seen = Observation()
            new.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out_dir}/rows/batch_id={batch_id}")
            counts = batch.agg(
                F.greatest(F.max(time), F.lit(before).cast("timestamp")).alias("latest"), F.count("*").alias("n_rows"),
                F.count_if(~on_time).alias("n_late"), F.lit(seen.get["n"]).cast("bigint").alias("n_new"))
            counts.write.mode("overwrite").parquet(f"{out_dir}/batches/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (
        docs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def json_stream(spark: SparkSession, path: str, schema: T.StructType, out_dir: str, dead_dir: str,
                checkpoint: str) -> StreamingQuery:
    """JSON lines as they land: rows of the schema, and what cannot be read apart, in the same micro-batch.

    A line that is no JSON, or whose values are not of the declared types, goes to ``dead_dir`` as it
    stands, with its file. Both sides are written per batch, and a batch that runs again overwrites
    its own, so a replay neither repeats nor loses a line.
    """
    fields = T.StructType([*schema.fields, T.StructField("_line", T.StringType())])
    lines = spark.readStream.schema(fields).option("columnNameOfCorruptRecord", "_line").json(path)
    lines = lines.select("*", F.col("_metadata.file_name").alias("_file"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # parsed once; both sides read it
        try:
            bad = F.col("_line").isNotNull()
            batch.where(~bad).drop("_line", "_file").write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
            batch.where(bad).select(F.col("_line").alias("line"), F.col("_file").alias("file_name")).write.mode(
                "overwrite").parquet(f"{dead_dir}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def status_counts(records: DataFrame) -> DataFrame:
    """Running count per status; write it in ``complete`` mode."""
    return records.groupBy("status").agg(F.count("*").alias("n_documents"))

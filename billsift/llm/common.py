"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SLICE_ROWS = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without the columns of these names, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[col(c) for c in df.columns if c.lower() not in taken])


def in_bucket(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder


def add_columns(
    df: DataFrame,
    text: str,
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[list[str]], Sequence[Sequence]]],
) -> DataFrame:
    """Append columns computed from one text column in Arrow batches, no shuffle.

    ``make`` builds a function once per task; it takes a list of texts (null as
    ``""``) and returns one list per new column. Existing columns of the same
    names are replaced. Long texts never meet in one piece: at most
    ``SLICE_ROWS`` of them are held as Python strings.
    """
    names = [f.name for f in fields]
    kept = without(df, [n for n in names if n.lower() != text.lower()])
    schema = T.StructType([f for f in kept.schema if f.name.lower() not in
                           {n.lower() for n in names}] + list(fields))
    types = [to_arrow_type(f.dataType) for f in fields]
    place = [f.name for f in kept.schema].index(text)
    keep = [i for i, f in enumerate(kept.schema)
            if f.name.lower() not in {n.lower() for n in names}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(start, SLICE_ROWS)
                texts = [t or "" for t in batch.column(place).to_pylist()]
                made = [pa.array(v, t) for v, t in zip(compute(texts), types, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in keep), *made],
                    names=[*(batch.schema.names[i] for i in keep), *names])

    return kept.mapInArrow(run, schema)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, per_label: int,
    doc_id: str = "doc_id", text: str = "text", most: int = 64,
) -> tuple[DataFrame, dict]:
    """(text, label) of at most ``per_label`` rows of each label, and each label's count.

    Every label is taken. More than ``most`` of them share the ``most * per_label``
    rows evenly, with one row each at least.

    A bounded sample to fit a model on: of the rows that ``allowed`` (on the
    id) leaves, those with the smallest hash of the id, so it does not depend on
    partitioning. Rows without id, label or document are no examples. The ids
    come to the driver (``most * per_label``, or one for each label, a bound free of the table's
    rows) and pick the texts in one scan, of rows that share an id the smallest; only
    those are shuffled. The caller reduces each text before it collects.
    """
    rows = labels.select(col(doc_id).cast("long").alias("_id"), col(label).alias("_label")).dropna()
    rows = rows.withColumnRenamed("_id", doc_id).where(allowed).withColumnRenamed(doc_id, "_id")
    counts = {r[0]: r[1] for r in rows.groupBy("_label").count().collect()}
    chosen = []
    if len(counts) <= most:
        for value in sorted(counts):
            best = rows.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(per_label)
            chosen += [(r[0], value) for r in best.select("_id").distinct().collect()]
    else:
        # one pass for many labels; each task passes on no more rows of a label than are wanted
        share = max(1, most * per_label // len(counts))
        order = Window.partitionBy("_label").orderBy(F.xxhash64("_id"), "_id")
        best = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= min(per_label, share))
        chosen = [tuple(r) for r in best.select("_id", "_label").distinct().collect()]
    kind = dict(rows.dtypes)["_label"]
    picked = docs.sparkSession.createDataFrame(chosen, f"_id long, _label {kind}")
    own = docs.select(col(doc_id).cast("long").alias("_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    found = own.join(F.broadcast(picked), "_id").groupBy("_id", "_label").agg(F.min("text").alias("text"))
    return found.select("_id", "text", F.col("_label").alias("label")), counts

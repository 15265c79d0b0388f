"""Corpus pipeline: documents in; filtered, deduplicated, mixed and encoded documents out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. Columns beside those of
documents pass through all stages, whatever their names. The stage ``simhash`` links the classes of the SimHash
operator after an exact check, and near copies that differ by more bits of a fingerprint
than its tables of distances can search by five-word shingles (see ``nearcopies``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billsift.llm import bpe, mixing, nearcopies, quality, suffixes
from billsift.llm.common import col, in_bucket, table
from billsift.llm.queries import VOCABULARY
from billsift.session import materialize

#: Score below which a document is rejected; times a source may be repeated in the mix.
LEAST_QUALITY, REPEATS = 0.3, 1.25


def sealed(docs: DataFrame, *shown: str, once: tuple[str, ...] = ()) -> DataFrame:
    """The columns that a stage reads, and all columns as one, which none of the stage's own can clash with.

    Those of ``once`` are shown only, so that tasks do not hold them twice.
    """
    whole = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in once])
    return docs.select(*shown, whole.alias("whole"))


def opened(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns again, some with new values."""
    return df.select(*[changed.get(c, F.col("whole").getField(f"c{i}")).alias(c) for i, c in enumerate(columns)])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose quality score is ``LEAST_QUALITY`` or more.

    The classifier learns as in ``op5_quality``, from labelled documents of
    ``docs`` itself.
    """
    own = docs.select("doc_id", "text")
    net = quality.fit(own, table(spark, sf_dir, "labels"), ~in_bucket(F.col("doc_id"), 5, 0))
    scored = quality.score(sealed(docs, "text", once=("text",)), net)
    return opened(scored.where(F.col("score") >= LEAST_QUALITY), docs.columns, text=F.col("text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of near copies, that of the smallest id.

    Near copies share 0.8 or more of their five-word shingles: SimHash classes and the rest,
    see ``nearcopies.roots``.
    Ids only choose within a class: rows that share an id but not a class each
    stay for their own, and rows without an id are in classes like any other, chosen
    where no row has one. Ties go to the smallest hash of the text, then of the row.
    """
    found = nearcopies.roots(docs.select("text"))
    rows = nearcopies.named(sealed(docs, "doc_id", "text"), "text").withColumn("_row", F.xxhash64("whole"))
    own = rows.select(F.col("_node").alias("node"), F.struct(
        F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col("_node").alias("node"), "_row").alias("place"))
    # exact copies are cut to one in each task, before the join
    own = own.groupBy("node").agg(F.min("place").alias("place"))
    own = own.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = own.groupBy("root").agg(F.min("place").alias("place")).select(
        F.col("place.doc_id").alias("_id"), F.col("place.node").alias("_node"), F.col("place._row").alias("_row"))
    same = (rows["_node"] == kept["_node"]) & (rows["_row"] == kept["_row"]) & rows["doc_id"].eqNullSafe(kept["_id"])
    return opened(rows.join(kept, same, "left_semi").dropDuplicates(["_node", "_row"]), docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out byte strings that stand in an earlier document; what is left is the text.

    Bytes of a sign that a cut has split are dropped; a U+FFFD of the document's own
    stays. Documents of which
    nothing is left go; those without repeats stay as they are.
    """
    left = suffixes.dedup(sealed(docs, "doc_id", "text")).where("n_removed = 0 or n_removed < n_bytes")
    rest = F.col("kept").cast("string")
    mended = rest
    # the document's own U+FFFD are marked while the repair makes others, which go
    for found, put in (("\0", "\0a"), ("\ufffd", "\0b"), (None, None), ("\ufffd", ""), ("\0b", "\ufffd"), ("\0a", "\0")):
        mended = F.replace(mended, F.lit(found), F.lit(put)) if found else F.make_valid_utf8(mended)
    text = F.coalesce(F.try_validate_utf8(rest), mended)
    made = left.withColumn("text", F.when(F.col("n_removed") == 0, F.col("text")).otherwise(text))
    return opened(made, docs.columns, text=F.col("text"), n_chars=F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat small sources up to ``REPEATS`` times; every document stays at least once."""
    return mixing.mix(docs, repeats=REPEATS).select(*[col(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Append token ids (little-endian unsigned 32-bit), their number and whether decoding gave the text back."""
    coded = bpe.round_trip(docs, VOCABULARY)
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return coded.withColumn("restored", same).drop("decoded")


STAGES = [
    ("quality", classify),
    ("simhash", drop_near_copies),
    ("suffixes", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: Trained and fingerprinted stages have no SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

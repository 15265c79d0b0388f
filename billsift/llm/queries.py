"""Registered queries of this subpackage, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import (
    alignment, bpe, langid, minhash, mixing, negatives, packing, pivots, quality, simhash, suffixes, toolcalls, toxicity)
from .common import in_bucket, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Put after each document in the files of op13.
END = 2


#: Times a source may be repeated in the mix of op1.
REPEATS = 1.25


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All tokens of the corpus as budget; one row per document and epoch."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    words = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0))
    budget = docs.agg(F.sum(words)).first()[0] or 0
    return mixing.mix(docs, budget=budget, repeats=REPEATS).select("doc_id", "source", "mix_epoch", "mix_key")


def op2_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffixes.dedup(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.compare_edited(table(spark, folder, "documents"))


def op4_toolcalls(spark: SparkSession, folder: str) -> DataFrame:
    """The user's and assistant's turns of ``conversations`` as calls and results.

    Turns of any other or a null role (system prompts) neither call nor answer; they
    have no row here, as in the SQL.
    """
    calls, results = toolcalls.from_turns(table(spark, folder, "conversations"))
    return toolcalls.link(calls, results, toolcalls.SCHEMAS)


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = in_bucket(F.col("doc_id"), 5, 0)
    net = quality.fit(docs, table(spark, folder, "labels"), ~held_out)
    return quality.score(docs.select("doc_id", "text"), net).select(
        "doc_id", held_out.alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_pivots(spark: SparkSession, folder: str) -> DataFrame:
    return pivots.link(table(spark, folder, "embeddings"))


def op7_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = in_bucket(F.col("doc_id"), 4, 2)
    net = langid.fit(docs, ~held_out)
    return langid.identify(docs.select("doc_id", "text"), net).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.classes(table(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = in_bucket(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, table(spark, folder, "labels"), ~held_out)
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, VOCABULARY).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    aligned = alignment.align(docs, VOCABULARY, PIECE_MODEL, digest=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")


def op12_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Every 50th vector as anchor; every 7th has its label moved on."""
    vectors = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Files of packed ids, written and read back."""
    path = shared_dir(spark, "ids")
    packing.write(table(spark, folder, "documents").select("doc_id", "text"), path, VOCABULARY, END)
    rows = packing.read(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return rows.join(packing.file_starts(spark, path), ["shard", "number"]).select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.mix_sql(REPEATS), "op4_toolcalls": toolcalls.SQL}

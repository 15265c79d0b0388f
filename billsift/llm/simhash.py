"""Near-duplicate classes by SimHash, found through tables of pivot distances."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .common import add_columns, col, without
from .components import star_roots

BITS, SEED, WORDS = 64, 42, 3
CHUNK = 1 << 16


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Bits set in more than half of the text's shingle hashes; 0 without words."""
    # bytes.lower and bytes.split treat A-Z and the six ASCII blanks only
    parts = text.encode().lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        shingles, n = iter([b" ".join(parts)]), 1
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
        n = len(parts) - words + 1
    hashed = (xxhash.xxh64_intdigest(s, seed) for s in shingles)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, CHUNK):
        block = np.fromiter(hashed, "<u8", min(CHUNK, n - start))
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Append the 64-bit fingerprint of each whole text as a signed long."""
    return add_columns(df, text, [T.StructField(out, T.LongType())],
                       lambda: lambda texts: [list(map(fingerprint, texts))])


def signed(value: int) -> int:
    value &= (1 << BITS) - 1
    return value - (1 << BITS) if value >> (BITS - 1) else value


def references(pairs: int = BITS // 2, spread: int = 24) -> tuple[list[int], list[int]]:
    """Reference fingerprints: one for each pair of neighbouring bits, and spread-out ones."""
    near = [signed(3 << (2 * i)) for i in range(pairs)]
    rng = np.random.default_rng(SEED)
    return near, [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, spread, np.int64)]


def distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(pivot).cast("long")))


def within(fps: DataFrame, radius: int = 2, groups: int = 5, cell: int = 16) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``radius`` bits.

    Each row of the pivot table holds a fingerprint's distances to the origin
    and to many references. The 32 references that hold two bits each move
    against the origin's distance by those bits alone: the differences fall
    into ``groups`` groups of bits, and two fingerprints within the radius
    agree on all coordinates of at least ``groups - radius`` groups. They meet
    in one cell for each choice of such groups, so no pair is lost. In a cell,
    a pair goes when any coordinate of the spread-out references differs by
    more than the radius (triangle inequality); survivors are verified.

    A cell of more than ``cell`` fingerprints, as near copies make them, would
    hold too many pairs. Its members go another exact way: two fingerprints are
    within two bits of each other just if both are within one bit of some third
    value, so all that share such a value are linked to the smallest of them.
    That is linear in the members, whatever the cell's size.
    """
    if radius != 2:
        raise ValueError("the way of large cells is made for two bits")
    near, spread = references()
    fp = F.col("fp")
    origin = F.bit_count(fp)
    step = [(i * groups) // len(near) for i in range(len(near))]
    code = []  # of each group: its coordinates as digits to base 3
    for g in range(groups):
        own = [(distance(fp, p) - origin + 2) / 2 for p, s in zip(near, step) if s == g]
        value = F.lit(0).cast("long")
        for digit in own:
            value = value * 3 + digit.cast("long")
        code.append(value.alias(f"g{g}"))
    table = fps.select("fp", *code, F.array(*[distance(fp, p).cast("byte") for p in spread]).alias("d"))
    choices = list(combinations(range(groups), groups - radius))
    keys = [F.struct(F.lit(n).alias("choice"), F.xxhash64(*[F.col(f"g{g}") for g in kept]).alias("key"))
            for n, kept in enumerate(choices)]
    cells = table.select("fp", "d", F.explode(F.array(*keys)).alias("k")).select("fp", "d", "k.*")
    sizes = cells.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    cells = cut(cells.join(sizes, ["choice", "key"]))

    few = cells.where(F.col("n") <= cell)
    pairs = few.alias("x").join(few.alias("y"), ["choice", "key"]).where("x.fp < y.fp")
    apart = F.exists(F.zip_with("x.d", "y.d", lambda p, q: F.abs(p - q)), lambda v: v > radius)
    pairs = pairs.where(~apart).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()

    many = cells.where(F.col("n") > cell).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)).cast("long") for i in range(BITS)])
    around = many.select("fp", F.explode(F.transform(flips, lambda m: fp.bitwiseXOR(m))).alias("mid"))
    least = around.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = around.join(least, "mid").where("fp > b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.union(stars)


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: id, ``fingerprint`` (16 hex digits), ``component_id``.

    Two fingerprints at most two bits apart are linked; ``component_id`` is the
    smallest id reachable. Equal fingerprints are one node throughout, so the
    links of thousands of copies are never written out.

    Null and empty texts have fingerprint zero and are linked like any other.
    Rows with a null id belong to their class and never name it (a class of
    such rows only has a null ``component_id``). Repeated ids or rows give a
    row each. Other columns are left out. An empty table gives an empty one.
    """
    own = df.select(col(doc_id).alias("_id"), col(text).alias("_text"))
    own = cut(without(fingerprints(own, "_text"), ["_text"]))
    nodes = own.groupBy("fp").agg(F.min("_id").alias("low"))
    roots = star_roots(within(nodes.select("fp"))).withColumnRenamed("node", "fp")
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    names = cut(nodes.join(named, "root").select("fp", "component_id"))
    return own.join(names, "fp").select(
        F.col("_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")

"""Near copies by word shingles: candidates from bands of minima, verified by exact Jaccard."""

from __future__ import annotations

from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .common import add_columns, col, without
from .components import star_roots
from .simhash import fingerprints, within

#: Words of a shingle; least share of common shingles, in percent.
WORDS, LEAST = 5, 80
#: Bands of so many minima: a pair at 0.8 shares none with chance (1 - 0.8^5)^24, 1 in 14,000.
BANDS, ROWS = 24, 5
#: Members of a cell that is compared whole at once; leaders that a larger cell is held against, and how often.
CELL, LEADERS, TURNS = 8, 4, 2
SEED, CHUNK = 42, 1 << 12

_draw = np.random.default_rng(SEED)
FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
MIXERS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of the text's shingles; fewer words make one, no words that of the empty text."""
    # bytes.lower and bytes.split treat A-Z and the six ASCII blanks only, as in the SimHash
    parts = text.encode().lower().split()
    whole = map(b" ".join, zip(*(parts[i:] for i in range(WORDS)))) if len(parts) >= WORDS else [b" ".join(parts)]
    n = max(1, len(parts) - WORDS + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in whole), np.uint64, n))


def bands(text: str) -> np.ndarray:
    """A key per band: the minima of ``ROWS`` orders of the shingles, mixed to a long."""
    own = shingles(text)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), CHUNK):
        turned = own[at:at + CHUNK, None] * FACTORS
        least = np.minimum(least, (turned ^ (turned >> np.uint64(32))).min(axis=0))
    least = (least ^ (least >> np.uint64(29))) * MIXERS
    return (least ^ (least >> np.uint64(32))).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64)


def alike(x: Column, y: Column) -> Column:
    """Whether two shingle sets share ``LEAST`` percent of all of theirs."""
    # a set under LEAST percent of the other's size cannot; this spares most intersections
    fits = (100 * F.size(x) >= LEAST * F.size(y)) & (100 * F.size(y) >= LEAST * F.size(x))
    both = F.size(F.array_intersect(x, y))
    return fits & (100 * both >= LEAST * (F.size(x) + F.size(y) - both))


def named(df: DataFrame, text: str) -> DataFrame:
    """Append ``_node``: 128 bits of hash of the text, null as empty."""
    own = F.coalesce(col(text), F.lit(""))
    return df.withColumn("_node", F.struct(F.xxhash64(own).alias("a"), F.xxhash64(F.lit(SEED), own).alias("b")))


def simhash_pairs(df: DataFrame, text: str = "text") -> DataFrame:
    """(a, b), a > b: each text of a SimHash class (see ``simhash.within``) and the least node of the class.

    Nodes are those of :func:`named`, so equal texts are one: the pairs are linear in the different texts.
    """
    own = named(fingerprints(df.select(col(text).alias("_text")), "_text"), "_text")
    own = cut(own.select(F.col("_node").alias("node"), "fp").distinct())
    tops = star_roots(within(own.select("fp").distinct())).withColumnRenamed("node", "fp")
    own = own.join(tops, "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    least = own.groupBy("root").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    return cut(own.join(least, "root").where("node > b").select(F.col("node").alias("a"), "b"))


def rare_pairs(members: DataFrame) -> DataFrame:
    """(a, b) of all texts of different roots that may be alike, from (node, root, s).

    Shingles are ordered by the number of members that hold them, rarest first, ties by
    value. Two alike sets share ``LEAST`` percent of the larger one, so one of the rarest
    rest, and one more, of each is in both: no alike pair is lost. What
    many texts have in common stands last in that order and makes no pair while it is less than ``LEAST``
    percent of a text. Left out are meetings after which too little of either set is left to be alike: of an alike
    pair the first common shingle has the whole intersection from its place on. For sets of one size what is
    in common thus makes no pair below 2 ``LEAST`` / (100 + ``LEAST``) of a text, 89 percent.
    """
    held = members.select("node", F.explode("s").alias("h"))
    counts = held.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    # a shingle of one text only counts for the size, so it need not travel
    shared = held.join(counts, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("r"))
    size = F.size("s")
    rarest = size - F.ceil(size * LEAST / 100).cast("int") + 1
    first = rarest - (size - F.size("r"))  # the unshared ones come before all others
    lists = members.join(shared, "node").where(first > 0).select(
        "node", "root", size.alias("n"), (size - F.size("r")).alias("alone"), F.posexplode(F.slice("r", F.lit(1), first)))
    lists = cut(lists.select("node", "root", "n", (F.col("n") - F.col("alone") - F.col("pos")).alias("rest"), F.col("col.h").alias("h")))
    x, y = lists.alias("x"), lists.alias("y")
    enough = (100 + LEAST) * F.least("x.rest", "y.rest") >= LEAST * (F.col("x.n") + F.col("y.n"))
    meet = [F.col("x.h") == F.col("y.h"), F.col("x.node") > F.col("y.node"), F.col("x.root") != F.col("y.root"), enough]
    return x.join(y, reduce(Column.__and__, meet)).select(
        *[F.col(f"{t}.{c}").alias(n + m) for t, n in (("x", "a"), ("y", "b")) for c, m in (("node", ""), ("root", "_root"))]).distinct()


def led_pairs(cells: DataFrame, turn: int) -> DataFrame:
    """(a, b) of different roots: the texts of each cell and its leaders of this turn, from (band, key, node, root).

    Leaders are the first by a hash of text and turn, one for each of its residues: partial minima, so no cell is gathered.
    """
    order = F.xxhash64("node.a", "node.b", F.lit(turn))
    own = F.struct(order.alias("o"), "node", "root")
    lead = cells.groupBy("band", "key").agg(*[
        F.min(F.when(F.pmod(order, F.lit(LEADERS)) == i, own)).alias(f"l{i}") for i in range(LEADERS)])
    stars = cells.join(lead, ["band", "key"]).select(
        "node", "root", F.explode(F.array(*[f"l{i}" for i in range(LEADERS)])).alias("l")).where("root != l.root")
    return stars.select(F.col("node").alias("a"), F.col("root").alias("a_root"), F.col("l.node").alias("b"),
                        F.col("l.root").alias("b_root")).distinct()


def joined(found: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame | None:
    """``found`` after the alike of ``pairs`` (a, a_root, b, b_root) are linked, by their roots; None if none is."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a") \
        .join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b").where(alike(F.col("x"), F.col("y")))
    links = cut(both.select(F.greatest("a_root", "b_root").alias("a"), F.least("a_root", "b_root").alias("b")).distinct())
    if links.isEmpty():
        return None
    new = cut(star_roots(links))
    moved = found.join(new.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select(
        "node", F.coalesce("top", "root").alias("root"))
    return cut(moved.unionByName(new.join(found, "node", "left_anti")))


def roots(df: DataFrame, text: str = "text") -> DataFrame:
    """(node, root) for the texts that have a near copy; other texts are their own root.

    Nodes are those of :func:`named`, so equal texts are one. Two texts are linked
    where the Jaccard likeness of their sets of five-word shingles (ASCII
    case and blanks apart) is 0.8 or more, and a class is all that links reach.

    SimHash classes come first: each of their texts is held against one of its class (``simhash_pairs``).
    Pairs that differ by more bits than tables of distances can search
    meet in the cells of ``BANDS`` keys of ``ROWS`` minima each, which miss
    a pair at 0.8 with chance 1 in 14,000 and closer ones more rarely; no pair is linked
    without its exact likeness. A cell of up to ``CELL`` texts is compared whole. Of
    a larger one all are first held against ``LEADERS`` of them, which links a
    group of near copies in steps linear in its size; while cells still hold several classes and that finds
    links, those classes are held against other leaders, ``TURNS`` times in all. The texts of cells that then
    hold several classes meet again by their rarest shingles (``rare_pairs``), so that
    many texts with half their words in common are not compared pair by pair. Shingles are hashed to 64 bits. Null, empty
    and blank texts are near copies of each other. An empty table gives an empty one.
    """
    own = named(df.select(col(text).alias("_text")), "_text")
    keys = without(add_columns(own, "_text", [T.StructField("keys", T.ArrayType(T.LongType()))],
                               lambda: lambda texts: [[bands(t) for t in texts]]), ["_text"])
    keys = cut(keys.distinct())
    posted = keys.select(F.col("_node").alias("node"), F.posexplode("keys").alias("band", "key"))
    sizes = posted.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    cells = cut(posted.join(sizes, ["band", "key"]))

    near = simhash_pairs(df, text)
    wanted = cells.select("node").union(near.select("a")).union(near.select("b")).toDF("_node").distinct()
    # copies are cut to one in each task before they are dealt by node
    texts = own.groupBy("_node").agg(F.min("_text").alias("_text")).join(wanted, "_node")
    sets = without(add_columns(texts, "_text", [T.StructField("s", T.ArrayType(T.LongType()))],
                               lambda: lambda texts: [[shingles(t).view(np.int64) for t in texts]]), ["_text"])
    sets = cut(sets.select(F.col("_node").alias("node"), "s"))

    few = cells.where(F.col("n") <= CELL)
    pairs = few.alias("x").join(few.alias("y"), ["band", "key"]).where("x.node > y.node") \
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    many = cells.where(F.col("n") > CELL)
    # one leader for each residue of the node's hash: partial minima, so that no cell is gathered
    lead = many.groupBy("band", "key").agg(*[F.min(F.when(
        F.pmod("node.b", F.lit(LEADERS)) == i, F.col("node"))).alias(f"l{i}") for i in range(LEADERS)])
    stars = many.join(lead, ["band", "key"]).select(
        F.col("node").alias("a"), F.explode(F.array(*[f"l{i}" for i in range(LEADERS)])).alias("b"))
    pairs = pairs.union(stars.where("a != b").select(F.greatest("a", "b"), F.least("a", "b")))
    pairs = pairs.union(near).distinct()
    links = pairs.join(sets.withColumnsRenamed({"node": "a", "s": "x"}), "a") \
        .join(sets.withColumnsRenamed({"node": "b", "s": "y"}), "b")
    links = cut(links.where(alike(F.col("x"), F.col("y"))).select("a", "b"))
    found = cut(star_roots(links))

    held = None
    for turn in range(1, TURNS + 1):
        now = many.select("band", "key", "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_cells = now.groupBy("band", "key").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p != q")
        many = cut(now.join(open_cells.select("band", "key"), ["band", "key"], "left_semi").select("band", "key", "node", "root"))
        if many.isEmpty():
            return found
        if held is None:
            held = cut(sets.join(many.select("node").distinct(), "node"))
        more = joined(found, led_pairs(many, turn), held) if turn < TURNS else None
        if more is None:
            break
        found = more
    members = cut(many.select("node", "root").distinct().join(held, "node"))
    return joined(found, rare_pairs(members), held) or found

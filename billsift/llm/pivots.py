"""Near-duplicate vectors through a pivot-permutation index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .common import col
from .components import star_roots

#: Reference points (the index's bounded sample), nearest of them that describe a vector,
#: those that list it in pairs, least shared ones of a candidate.
PIVOTS, DESCRIBED, LISTED, SHARED = 256, 8, 5, 4
#: Vectors that pivots are chosen from, and how alike two pivots may be.
SAMPLE, APART = 4096, 0.6
#: Likeness, once what all vectors share is taken off, from which the index can find a link, and from which on short lists do.
ALIKE, CLEAR = 0.8, 0.93
#: Rows of a list compared at once with another such block.
BLOCK = 512

NODE = "struct<id:bigint,h:bigint>"
FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "h", "links", "root_id", "root_h")])


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that huge or tiny components do no harm."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones filled with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8")
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    at = np.concatenate([[0], np.cumsum(sizes)])
    for i, n in enumerate(sizes):
        out[i, :min(n, width)] = flat[at[i]:at[i] + min(n, width)]
    return out


class Index:
    """Pivots of a sample, what is taken off vectors before they are compared with them, and list lengths."""

    def __init__(self, rows: list[list[float]], least: float):
        width = max(map(len, rows))
        sample = unit(np.array([r + [0.0] * (width - len(r)) for r in rows]))
        middle = sample.mean(axis=0)
        shared = float(middle @ middle)  # the mean cosine
        # how alike, without what all vectors share, those are that just link
        apart = (least - shared) / (1 - shared) if shared < 1 else 0.0
        self.middle = middle if apart >= ALIKE else np.zeros(width)
        self.described, self.listed = (DESCRIBED, LISTED) if apart >= CLEAR or apart < ALIKE else (DESCRIBED + 2, LISTED + 1)
        self.pivots = choose(self.turned(sample))

    def turned(self, rows: np.ndarray) -> np.ndarray:
        rows = rows - self.middle
        size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        return rows / np.where(size > 0, size, 1)


def choose(sample: np.ndarray) -> np.ndarray:
    """Pivots that lie apart: near ones would order a dense group by chance."""
    taken: list[int] = []
    for n, row in enumerate(sample):
        if not taken or (sample[taken] @ row).max() < APART:
            taken.append(n)
            if len(taken) == PIVOTS:
                break
    for n in range(len(sample)):  # too few directions: any further vectors
        if len(taken) >= LISTED + 1:
            break
        if n not in taken:
            taken.append(n)
    return sample[taken]


def describe(df: DataFrame, index: Index) -> DataFrame:
    """Append ``near``: the nearest pivots by angle, nearest first."""
    sent = df.sparkSession.sparkContext.broadcast((index.pivots, index.middle, index.described))
    schema = T.StructType([*df.schema, T.StructField("near", T.ArrayType(T.ShortType()))])
    place = df.columns.index("e")

    def run(batches):
        own, middle, described = sent.value
        k = min(described, len(own))
        for batch in batches:
            rows = unit(matrix(batch.column(place), own.shape[1]) + 0.0) if batch.num_rows else np.zeros((0, own.shape[1]))
            likeness = (np.nan_to_num(rows) - middle) @ own.T
            near = np.argsort(-likeness, axis=1, kind="stable")[:, :k].astype("i2")
            lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, k, dtype="i4"), near.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "near"])

    return df.mapInArrow(run, schema)


def local_roots(links: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row of a symmetric link matrix."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(least: float, shown: int):
    """Verify the candidates of two blocks of one list (or of one block)."""

    def run(key, table):
        pair, i, j = key[0].as_py(), key[1].as_py(), key[2].as_py()
        ids, hs = table.column("id").to_numpy(), table.column("h").to_numpy()
        weight, block = table.column("n").to_numpy(), table.column("block").to_numpy()
        vectors = table.column("e").combine_chunks()
        sizes = np.diff(vectors.offsets.to_numpy())
        near = np.stack(table.column("near").to_numpy())
        member = np.zeros((len(ids), PIVOTS), "f4")
        np.put_along_axis(member, near.astype(np.int64), 1, axis=1)
        listed = np.zeros((len(ids), PIVOTS), "f4")
        np.put_along_axis(listed, near[:, :shown].astype(np.int64), 1, axis=1)
        low, high = divmod(pair, PIVOTS)
        # candidates share enough pivots; each pair counts in the list of its two smallest shared ones
        good = member @ member.T >= min(SHARED, near.shape[1])
        good &= listed[:, :high] @ listed[:, :high].T == 1
        good &= sizes[:, None] == sizes[None, :]
        good &= (block[:, None] == i) & (block[None, :] == j) | (block[:, None] == j) & (block[None, :] == i)
        np.fill_diagonal(good, False)
        rows = unit(matrix(vectors, int(sizes.max())))
        good &= rows @ rows.T >= least
        linked = good.any(axis=1)
        order = np.lexsort((hs, ids))  # so that a root is the smallest node
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        root = order[local_roots(good[np.ix_(order, order)])[back]]
        links = good @ weight
        return pa.table({"id": ids[linked], "h": hs[linked], "links": links[linked].astype("i8"),
                         "root_id": ids[root][linked], "root_h": hs[root][linked]})

    return run


def link(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per row of ``df``: id, ``n_links``, ``component_id``, ``kept``.

    The pivots are vectors of a bounded sample (smallest hashes) that lie apart; every
    vector is described by its ``DESCRIBED`` nearest ones in order. It stands in the inverted
    list of each pair of its ``LISTED`` nearest, so that rows of a list share two
    pivots already; of those, pairs sharing ``SHARED`` of all are verified by the
    cosine in doubles and linked from ``least`` on. Recall is that of the lists; no
    link is below ``least``. What all vectors of the sample share, their mean, is taken off before the pivots
    are compared, and the lists are a little longer then; where pairs that just link would be less alike than ``ALIKE`` without it
    (a mean cosine over 0.75 at 0.95), it stays, few pivots lie apart and the lists hold nearly all pairs: slow, but whole.

    Equal vectors are one node with a weight. A list of more than ``BLOCK`` vectors is
    compared block by block in as many tasks; tasks return link counts and the
    roots of what they linked, never pairs.

    Null and zero vectors, and those with null or non-finite components, link with
    nothing: no links, a component of their own, kept. Vectors of different lengths
    do not link. Rows without an id link with nothing, have no component and are not kept.
    Rows of a repeated id are vectors each. An empty table gives an empty one.
    """
    spark = df.sparkSession
    own = df.select(col(vec_id).cast("long").alias("id"), F.transform(
        col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("e"))
    fine = F.coalesce(F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
                      & F.exists("e", lambda x: x != 0) & F.col("id").isNotNull(), F.lit(False))
    own = own.withColumn("h", F.when(fine, F.xxhash64("e")))
    # one node for equal vectors; the hash tells those of a repeated id apart
    nodes = cut(own.where("h is not null").groupBy("e", "h").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    chosen = [r["e"] for r in nodes.orderBy("h", "id").limit(SAMPLE).collect()]
    if len(chosen) < 2:
        lists = spark.createDataFrame([], FOUND)
    else:
        index = Index(chosen, least)
        listed = describe(nodes, index)
        first = F.slice("near", 1, index.listed)
        pairs = F.flatten(F.transform(first, lambda a: F.transform(
            F.filter(first, lambda b: b > a), lambda b: a.cast("int") * PIVOTS + b.cast("int"))))
        posted = cut(listed.withColumn("pair", F.explode(pairs)))
        sizes = posted.groupBy("pair").agg(F.count("*").alias("m")).where("m > 1")
        blocks = F.ceil(F.col("m") / BLOCK)
        dealt = posted.join(sizes, "pair").withColumn("block", F.pmod(F.xxhash64("h", "id"), blocks).cast("int"))
        other = F.sequence(F.lit(0), (blocks - 1).cast("int"))
        dealt = dealt.withColumn("with", F.explode(other)).withColumns(
            {"i": F.least("block", "with"), "j": F.greatest("block", "with")})
        lists = dealt.select("pair", "i", "j", "id", "h", "n", "e", "near", "block") \
            .groupBy("pair", "i", "j").applyInArrow(compare(least, index.listed), FOUND)
    lists = cut(lists)
    counts = lists.groupBy("id", "h").agg(F.sum("links").alias("links"))
    node = F.struct("id", "h").cast(NODE)
    edges = lists.select(node.alias("a"), F.struct(
        F.col("root_id").alias("id"), F.col("root_h").alias("h")).cast(NODE).alias("b"))
    roots = star_roots(edges).select(F.col("node.id").alias("id"), F.col("node.h").alias("h"),
                                     F.col("root.id").alias("root"))
    told = cut(nodes.join(counts, ["id", "h"], "left").join(roots, ["id", "h"], "left").select(
        "e", "h", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "id").alias("component_id")))
    alone = own.where("h is null").select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    rows = own.join(told, ["h", "e"]).select("id", "n_links", "component_id").union(alone)
    return rows.select(F.col("id").alias(vec_id), "n_links", "component_id",
                       F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))

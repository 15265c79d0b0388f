"""Hard negatives from Hilbert-ordered blocks of vectors with zone maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut, materialize
from .common import col
from .pivots import matrix

#: Rows of a block; blocks read together; zone maps looked at together; anchors handled together.
BLOCK, GROUP, SHEET, CHUNK = 512, 16, 4096, 2048
#: Vectors that the curve's directions are fitted on, directions, bits of each.
SAMPLE, DIRECTIONS, BITS = 4096, 8, 7
#: Scores beyond this count as this, so that they fit a long.
MOST = 1 << 62

PACKED = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("number", T.LongType()),
    T.StructField("n_anchors", T.LongType()), T.StructField("anchors_before", T.LongType()),
    T.StructField("least", T.LongType()), T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("low", T.ArrayType(T.DoubleType())), T.StructField("high", T.ArrayType(T.DoubleType())),
    T.StructField("uid", T.ArrayType(T.LongType())), T.StructField("id", T.ArrayType(T.LongType())),
    T.StructField("label", T.ArrayType(T.StringType())), T.StructField("anchor", T.ArrayType(T.BooleanType())),
    T.StructField("kind", T.StringType()), T.StructField("data", T.BinaryType())])
ARROW = to_arrow_schema(PACKED)
WINDOW = "array<struct<w:int,lo:bigint,hi:bigint,score:bigint,id:bigint>>"
HITS = "uid bigint, w int, found bigint, id bigint, score bigint"


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each row of whole coordinates below ``2 ** bits``.

    Per level, from the coarsest: where a coordinate has the level's bit the first one is
    mirrored below it, else the two swap their lower bits; the result is Gray-coded.
    """
    x = x.astype(np.int64)
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(dims):
            on = (x[:, i] & bit) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & below)
            x[:, 0] ^= np.where(on, below, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[:, i] >> level & 1)
    return key


def directions(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The directions in which a sample varies most, and its least and largest place in each."""
    centred = rows / max(1.0, float(np.abs(rows).max(initial=0)))
    _, vectors = np.linalg.eigh(np.cov(centred.T, bias=True).reshape(rows.shape[1], -1))
    main = vectors[:, ::-1][:, :DIRECTIONS]
    spots = rows @ main
    return main, spots.min(axis=0), spots.max(axis=0)


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held in doubles, exact."""
    size = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    if size < 1 << 53:
        return (anchors @ rows.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    found = whole(anchors).astype(object) @ whole(rows).astype(object).T
    return np.clip(found, -MOST, MOST).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: higher scores first, then smaller ids."""
    spots = np.arange(len(score))
    if len(score) > 4 * k:
        spots = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return spots[np.lexsort((ids[spots], -score[spots]))][:k]


def pack(rows: DataFrame, width: int, scale: int, fitted) -> DataFrame:
    """Blocks of ``BLOCK`` rows in the order of the curve, with their zone maps."""
    sent = rows.sparkSession.sparkContext.broadcast(fitted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        main, low, high = sent.value
        top = (1 << BITS) - 1
        for batch in batches:
            whole = np.floor(matrix(batch.column(4), width) * scale)
            part = (whole @ main - low) / np.where(high > low, high - low, 1)
            key = hilbert(np.clip(np.nan_to_num(part) * top, 0, top), BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=[*batch.schema.names, "key"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, before, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK - size)
                held.append(part)
                size, at = size + part.num_rows, at + part.num_rows
                if size == BLOCK:
                    made, anchors = block(held, shard, number, before)
                    yield made
                    number, before, held, size = number + 1, before + anchors, [], 0
        if held:
            yield block(held, shard, number, before)[0]

    def block(held, shard, number, before):
        table = pa.Table.from_batches(held)
        whole = np.floor(matrix(table.column(4).combine_chunks(), width) * scale)
        kind = "<i2" if np.abs(whole).max(initial=0) < 1 << 15 else "<f8"
        anchors = sum(table.column(3).to_pylist())
        labels = table.column(2).to_pylist()
        ids = table.column(1).to_pylist()
        values = [shard, number, anchors, before, min(ids), sorted(set(labels)), whole.min(axis=0).tolist(),
                  whole.max(axis=0).tolist(), table.column(0).to_pylist(), ids, labels, table.column(3).to_pylist(),
                  kind, whole.astype(kind).tobytes()]
        return pa.RecordBatch.from_pylist([dict(zip(PACKED.names, values))], schema=ARROW), anchors

    keyed = rows.mapInArrow(place, T.StructType([*rows.schema, T.StructField("key", T.LongType())]))
    order = ["key", "id", "uid"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(close, PACKED)


def unpacked(kind: str, data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, kind).astype("f8").reshape(-1, width)


def hits(targets: pa.Table, blocks: pa.Table, width: int, same: bool, k: int, own: bool) -> pa.Table:
    """The ``k`` best rows of ``blocks`` in each window of each target, and no worse than what it has."""
    out: list[tuple] = []
    if targets.num_rows and blocks.num_rows:
        anchors = np.stack([np.frombuffer(v, "<f8") for v in targets.column("vec").to_pylist()])
        rows = np.concatenate([unpacked(x, d, width) for x, d in zip(
            blocks.column("kind").to_pylist(), blocks.column("data").to_pylist())])
        ids, uids = (np.array([i for one in blocks.column(c).to_pylist() for i in one], np.int64) for c in ("id", "uid"))
        names = blocks.column("label").to_pylist()
        home = np.repeat(blocks.column("block").to_numpy(), list(map(len, names)))
        known: dict[str, int] = {}
        label = np.array([known.setdefault(x, len(known)) for one in names for x in one])
        found = scores(anchors, rows)
        for n, (uid, of, block, windows) in enumerate(zip(*(
                targets.column(c).to_pylist() for c in ("uid", "label", "block", "windows")))):
            fits = (label == known.get(of, -1)) == same
            fits &= (uids != uid) & ((home == block) == own)
            at = np.flatnonzero(fits)
            score, names_ = found[n, at], ids[at]
            for x in windows:
                inside = (score >= x["lo"]) & (score <= x["hi"])
                if x["score"] is not None:
                    inside &= (score > x["score"]) | (score == x["score"]) & (names_ <= x["id"])
                if inside.any():
                    spots = np.flatnonzero(inside)
                    for i in spots[best(score[spots], names_[spots], k)]:
                        out.append((uid, x["w"], int(uids[at[i]]), int(names_[i]), int(score[i])))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)],
                    names=["uid", "w", "found", "id", "score"])


def wanted(targets: pa.Table, zones: pa.Table, same: bool) -> np.ndarray:
    """Which blocks (columns) each target (rows) must read, by interval arithmetic.

    The score of a row lies between the sums, over the components, of the smaller and of
    the larger product of the anchor's component with the zone's ends. A block is left out where no
    score between these lies in a window or is better than what the window has already.
    """
    anchors = np.stack([np.frombuffer(v, "<f8") for v in targets.column("vec").to_pylist()])
    low, high = (np.array(zones.column(c).to_pylist()) for c in ("low", "high"))
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    slack = np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T * 1e-12  # of rounding, for huge components
    most = up @ high.T + down @ low.T + slack
    fewest = up @ low.T + down @ high.T - slack
    least = zones.column("least").to_numpy()
    labels = zones.column("labels").to_pylist()
    of = targets.column("label").to_pylist()
    holds = {x: np.array([x in own if same else own != [x] for own in labels]) for x in set(of)}
    need = np.zeros(most.shape, bool)
    for n, windows in enumerate(targets.column("windows").to_pylist()):
        for x in windows:
            top = np.minimum(most[n], x["hi"])
            fits = (top >= x["lo"]) & (fewest[n] <= x["hi"])
            if x["score"] is not None:
                fits &= (top > x["score"]) | (top >= x["score"]) & (least <= x["id"])
            need[n] |= fits
        need[n] &= holds[of[n]]
    return need


def first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each window with their rank; each task cuts its own to ``k`` before the shuffle."""
    order = Window.partitionBy("uid", "w").orderBy(F.desc("score"), "id", "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(targets: DataFrame, blocks: DataFrame, width: int, same: bool, k: int) -> DataFrame:
    """(uid, w, found, id, score, rank): the ``k`` best rows of the same (or of any other) label in each window.

    ``targets``: chunk, block (the anchor's own), uid, label, vec, windows. The own block is read
    first; the worst of ``k`` rows found there is what rows of other blocks must beat, so
    the zone maps can leave blocks out.
    """
    zones = blocks.select("block", "sheet", "least", "labels", "low", "high")
    data = blocks.select("block", "group", "uid", "id", "label", "kind", "data")

    def own(key, left, right):
        return hits(left, right, width, same, k, True)

    def rest(key, left, right):
        return hits(left, right, width, same, k, False)

    def choose(key, left, right):
        chunk = key[0].as_py()
        need = wanted(left, right, same).any(axis=0) if left.num_rows and right.num_rows else np.zeros(0, bool)
        chosen = right.column("block").to_numpy()[need] if len(need) else np.zeros(0, np.int64)
        return pa.table({"chunk": pa.array(np.full(len(chosen), chunk), pa.int64()), "block": pa.array(chosen, pa.int64())})

    seeds = cut(first(targets.groupBy("block").cogroup(data.groupBy("block")).applyInArrow(own, HITS), k))
    worst = seeds.where(F.col("rank") == k).groupBy("uid").agg(F.map_from_entries(F.collect_list(
        F.struct("w", F.struct("score", "id")))).alias("worst"))
    beat = F.transform("windows", lambda x: F.struct(
        x["w"].alias("w"), x["lo"].alias("lo"), x["hi"].alias("hi"),
        F.try_element_at("worst", x["w"])["score"].alias("score"),
        F.try_element_at("worst", x["w"])["id"].alias("id")))
    targets = cut(targets.join(worst, "uid", "left").withColumn("windows", beat.cast(WINDOW)).drop("worst"))
    # a stated query set against all rows, chunk by sheet of zone maps
    n_sheets = (zones.agg(F.max("sheet")).first()[0] or 0) + 1
    tiled = targets.withColumn("sheet", F.explode(F.sequence(F.lit(0), F.lit(n_sheets - 1)).cast("array<bigint>")))
    n_chunks = (targets.agg(F.max("chunk")).first()[0] or 0) + 1
    maps = zones.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)).cast("array<bigint>")))
    need = cut(tiled.groupBy("chunk", "sheet").cogroup(maps.groupBy("chunk", "sheet")).applyInArrow(
        choose, "chunk bigint, block bigint"))
    reads = need.join(data, "block")
    asked = targets.join(reads.select("chunk", F.col("group").alias("part")).distinct(), "chunk")
    more = asked.groupBy("chunk", "part").cogroup(reads.groupBy("chunk", "group")).applyInArrow(rest, HITS)
    return first(seeds.drop("rank").unionByName(more), k)


def mine(df: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
         scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of each anchor's positives.

    Each component becomes ``floor(scale * x)``; a score is the whole inner product with the
    anchor, higher first, ties by the smaller id. ``anchors`` tells the anchors among the rows. An anchor's
    positives are its first ``positives`` other rows of its label; for each, the first
    ``negatives`` rows of any other label follow whose score is from ``low`` to ``high`` hundredths
    of the positive's: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows lie in blocks of ``BLOCK`` along a Hilbert curve through the ``DIRECTIONS`` in which a
    sample of ``SAMPLE`` vectors (smallest hashes) varies most, written as Parquet with each block's
    least and largest value of every component. For a chunk of neighbouring anchors, interval
    arithmetic on these picks the blocks to read; results are exact whatever they leave out.

    Rows without an id, label or vector, and those with a component that is null or not finite (before
    or after scaling), take no part. Shorter vectors count as filled with zeros. Rows of a repeated id are
    rows each; a repeated anchor has rows each. Scores beyond 2 ** 62 count as that. An empty table,
    or one without anchors, gives an empty result. Columns of any other name are not read.
    """
    own = df.select(
        F.monotonically_increasing_id().alias("uid"), col(vec_id).cast("long").alias("id"),
        col(label).cast("string").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.transform(col(vector), lambda x: x.cast("double")).alias("e"))
    own = own.where("id is not null and label is not null").where(F.coalesce(F.forall("e", lambda x: (
        x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))), F.lit(False)))
    width = max(1, own.agg(F.max(F.size("e"))).first()[0] or 0)
    sample = [r["e"] for r in own.select("e", F.xxhash64("e", "id").alias("h"), "uid").orderBy("h", "uid").limit(
        SAMPLE).collect()] or [[0.0]]
    rows = np.zeros((len(sample), width))
    for n, one in enumerate(sample):
        rows[n, :len(one)] = one
    packed = materialize(pack(own, width, scale, directions(np.floor(rows * scale))), "blocks")
    # numbers of blocks and anchors run on from shard to shard; there are as many shards as tasks wrote
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = packed.groupBy("shard").agg(F.count("*").alias("n"), F.sum("n_anchors").alias("a")).select(
        "shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("blocks_before"),
        F.coalesce(F.sum("a").over(ahead), F.lit(0)).alias("base"))
    blocks = packed.join(bases, "shard").withColumn("block", F.col("blocks_before") + F.col("number")).withColumns({
        "group": F.floor(F.col("block") / GROUP), "sheet": F.floor(F.col("block") / SHEET)})

    def anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                data = unpacked(b["kind"], b["data"], width)
                at = np.flatnonzero(b["anchor"]).tolist()
                place = b["base"] + b["anchors_before"] + np.arange(len(at))
                yield pa.RecordBatch.from_arrays([
                    pa.array(place // CHUNK, pa.int64()), pa.array([b["block"]] * len(at), pa.int64()),
                    pa.array([b["uid"][i] for i in at], pa.int64()), pa.array([b["id"][i] for i in at], pa.int64()),
                    pa.array([b["label"][i] for i in at], pa.string()),
                    pa.array([data[i].tobytes() for i in at], pa.binary())],
                    names=["chunk", "block", "uid", "anchor_id", "label", "vec"])

    targets = cut(blocks.where("n_anchors > 0").select(
        "block", "base", "anchors_before", "uid", "id", "label", "anchor", "kind", "data").mapInArrow(
        anchors_of, "chunk bigint, block bigint, uid bigint, anchor_id bigint, label string, vec binary"))
    whole = F.array(F.struct(F.lit(0).alias("w"), F.lit(-MOST).alias("lo"), F.lit(MOST).alias("hi"),
                             F.lit(None).alias("score"), F.lit(None).alias("id"))).cast(WINDOW)
    near = cut(search(targets.withColumn("windows", whole), blocks, width, True, positives))

    # in whole numbers: low * positive <= 100 * negative <= high * positive
    score = F.col("score").cast("decimal(20,0)")
    lo = F.ceil(score * low / 100).cast("long")
    hi = F.floor(score * high / 100).cast("long")
    windows = near.select("uid", F.struct(F.col("rank").alias("w"), lo.alias("lo"), hi.alias("hi"),
                                          F.lit(None).alias("score"), F.lit(None).alias("id")).alias("x"))
    windows = windows.where("x.lo <= x.hi").groupBy("uid").agg(F.collect_list("x").cast(WINDOW).alias("windows"))
    far = search(targets.join(windows, "uid"), blocks, width, False, negatives)
    pairs = near.select("uid", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.select("uid", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")) \
        .join(pairs, ["uid", "w"]).join(targets.select("uid", "anchor_id"), "uid").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score",
            "negative_score")

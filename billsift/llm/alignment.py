"""Alignment of the tokens of two vocabularies by pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut, shared_dir
from .common import SLICE_ROWS, col, without
from .tokens import Encoder, met, token_bytes

#: Most pairs of ids whose counts are sent to every task; all others meet theirs in a join.
SENT = 1 << 18
#: Links gathered in a task before their pairs are counted.
GATHERED = 1 << 21
OUT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


class Pieces:
    """Ids of a sentencepiece model, and the bytes that each stands for."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        self.bytes = [bytes([int(self.model.id_to_piece(i)[3:-1], 16)]) if self.model.is_byte(i)
                      else self.model.id_to_piece(i).replace("▁", " ").encode()
                      for i in range(self.model.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def terminals(a_at: np.ndarray, b_at: np.ndarray, a_of: np.ndarray, b_of: np.ndarray) -> np.ndarray:
    """The last token of each token's group; A tokens are numbered first, then B tokens.

    ``a_at`` and ``b_at`` tell at which stretch each token ends, ``a_of`` and ``b_of`` which tokens cover each
    stretch. Every token points to the one that reaches farthest right of those that overlap
    it: of the other vocabulary that which holds its last byte, and at a common end the
    B token, which points to itself. Successors are doubled until none moves.
    """
    n = len(a_at)
    over = a_of[b_at]
    last = a_at[over] == b_at
    to = np.concatenate([n + b_of[a_at], np.where(last, n + np.arange(len(b_at)), over)])
    going = np.arange(len(to))
    while len(going):
        further = to[to[going]]
        moved = further != to[going]
        # reading all before writing any keeps the rounds a doubling
        to[going] = further
        going = going[moved]
    return to


def stretches(a_ids: np.ndarray, b_ids: np.ndarray, a_len: np.ndarray, b_len: np.ndarray):
    """(a_at, b_at, a_of, b_of) of texts that lie end to end: between neighbouring ends of
    tokens lies a stretch that one token of either side covers, which is one link."""
    a_end, b_end = np.cumsum(a_len[a_ids]), np.cumsum(b_len[b_ids])
    mark = np.zeros(int(a_end[-1]) if len(a_end) else 0, "u1")
    mark[a_end - 1] = 1
    mark[b_end - 1] |= 2
    spot = mark[np.flatnonzero(mark)]
    ends_a, ends_b = spot & 1, spot >> 1
    return (np.flatnonzero(ends_a), np.flatnonzero(ends_b), np.cumsum(ends_a, dtype=np.int64) - ends_a,
            np.cumsum(ends_b, dtype=np.int64) - ends_b)


class Digits:
    """Ids as decimal text, side by side in rows of one width."""

    def __init__(self, size: int):
        self.length = np.array([len(str(i)) for i in range(size)])
        width = int(self.length.max())
        self.signs = np.array([f"{i:<{width}}," for i in range(size)], f"S{width + 1}").view("u1").reshape(size, -1)

    def write(self, ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each id and its mark, end to end, and where each ends."""
        signs, length = self.signs[ids], self.length[ids]
        signs[np.arange(len(ids)), length] = marks
        return signs[np.arange(signs.shape[1]) <= length[:, None]], np.cumsum(length + 1)


def group_texts(a_ids, b_ids, a_docs, b_docs, parts, digits) -> tuple[list[int], list[str]]:
    """Number of groups of each document, and ``a1,a2|b1;a3|b2,b3``, from ids, tokens a
    document, and ``stretches``."""
    to = terminals(*parts)
    n = len(a_ids)
    own = to[n:] == n + np.arange(len(b_ids))
    group_of_terminal = np.cumsum(own) - 1
    group = group_of_terminal[to - n]
    a_group, b_group = group[:n], group[n:]
    total = int(own.sum())
    a_many, b_many = np.bincount(a_group, minlength=total), np.bincount(b_group, minlength=total)
    a_place = np.arange(n) + (np.cumsum(b_many) - b_many)[a_group]
    b_place = np.arange(len(b_ids)) + np.cumsum(a_many)[b_group]
    ids, marks = np.empty(n + len(b_ids), np.int64), np.full(n + len(b_ids), ord(","), "u1")
    ids[a_place], ids[b_place] = a_ids, b_ids
    marks[a_place[np.cumsum(a_many) - 1]], marks[b_place[np.cumsum(b_many) - 1]] = ord("|"), ord(";")
    signs, ends = digits.write(ids, marks)
    text, ends = signs.tobytes().decode("ascii"), np.append(0, ends)
    tokens = np.cumsum([0, *(np.asarray(a_docs) + np.asarray(b_docs))])
    first = np.cumsum([0, *b_docs])
    counts = np.append(0, np.cumsum(own))
    n_groups = np.diff(counts[first]).tolist()
    return n_groups, [text[ends[b]:max(ends[b], ends[e] - 1)] for b, e in zip(tokens[:-1], tokens[1:])]


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column, and the ids of each row."""
    values = column.to_pylist()
    size = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(values), kind).astype(np.int64), np.array([len(v) // size for v in values], np.int64)


def tokenize(df: DataFrame, text: str, vocabulary: str, model: str, kinds: tuple[str, str]) -> DataFrame:
    """Append the ids of both sides, none where a side's bytes are not those of the text."""
    with open(vocabulary, encoding="utf-8") as file:
        spec = file.read()
    sent = df.sparkSession.sparkContext.broadcast((spec, Path(model).read_bytes()))
    place = df.columns.index("text")
    kept = [i for i, c in enumerate(df.columns) if c != "text"]
    schema = T.StructType([df.schema[i] for i in kept] + [
        T.StructField(n, T.BinaryType()) for n in ("a", "b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, model = sent.value
        first, first_bytes = Encoder(spec, False, met(spec, False)), token_bytes(spec)
        second = Pieces(model)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                texts = [t or "" for t in batch.column(place).to_pylist()]
                a, b = [], []
                for one, ids, other in zip(texts, first.encode([" " + t for t in texts]), second.encode(texts)):
                    data = (" " + one).encode()
                    numbers = np.frombuffer(ids, "<u4")
                    fits = one != "" and b"".join(map(second.bytes.__getitem__, other)) == data and b"".join(
                        map(first_bytes.__getitem__, numbers.tolist())) == data
                    a.append(numbers.astype(kinds[0]).tobytes() if fits else b"")
                    b.append(np.array(other, kinds[1]).tobytes() if fits else b"")
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in kept), pa.array(a, pa.binary()), pa.array(b, pa.binary())],
                    names=schema.names)

    return df.mapInArrow(run, schema)


def pair_counts(tokens: DataFrame, lengths, kinds, b_size: int) -> DataFrame:
    """(pair, n): how many links of the corpus hold each pair of ids, as ``a * b_size + b``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_len, b_len = lengths.value
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                a, _ = flat(batch.column(0), kinds[0])
                b, _ = flat(batch.column(1), kinds[1])
                if len(a):
                    _, _, a_of, b_of = stretches(a, b, a_len, b_len)
                    held.append(a[a_of] * b_size + b[b_of])
                    size += len(a_of)
                if size >= GATHERED:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    found = tokens.select("a", "b").mapInArrow(run, "pair long, n long")
    return found.groupBy("pair").agg(F.sum("n").alias("n"))


def by_document(a, b, a_docs, b_docs, parts, b_size: int):
    """Distinct (pair, document) of a slice in order, with their links; links of each document."""
    a_at, b_at, a_of, b_of = parts
    # the last stretch of a document ends its last token
    ends = np.append(0, a_at + 1)[np.cumsum([0, *a_docs])]
    docs = np.repeat(np.arange(len(a_docs)), np.diff(ends))
    key = np.sort(((a[a_of] * b_size + b[b_of]) << 8) | docs)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(new)
    key = key[head]
    return key >> 8, key & 255, np.diff(head, append=len(docs)), np.diff(ends)


def align(df: DataFrame, vocabulary: str, model: str, text: str = "text", digest: bool = False,
          sent: int = SENT) -> DataFrame:
    """Align the tokens of a byte-level BPE vocabulary (A, of space + text) with those of a sentencepiece model (B).

    Returns the columns of ``df`` but the text, and ``n_a``, ``n_b`` (tokens), ``n_groups``,
    ``n_links``, ``n_best``, ``count_sum`` and ``groups``: ``a1,a2|b1;a3|b2,b3``, the decimal ids of the
    smallest runs of tokens that cover the same bytes. With ``digest``, ``groups`` is the lower-case
    hex of its SHA-256 (``''`` without tokens), taken before rows travel. Columns of these
    names are replaced, whatever their case.

    A link is a pair of tokens, one of either side, whose bytes overlap. A pair of ids counts
    as often as it is linked in all rows; ``count_sum`` adds these counts over a
    row's links, ``n_best`` are the links whose count is the highest of their B id, ties included.

    Ids are written once to the shared folder (two bytes each) and read again for counts,
    scores and groups. Groups come from pointer jumping (``terminals``) over all rows of a slice
    at once. Pairs are counted in each task, then by key. The counts of at most ``sent`` pairs
    go to every task, the most frequent (those from a power of two on); links of
    all other pairs are counted by row and meet their counts in a join, so nothing that is
    sent grows with the corpus.

    Rows whose text is null or empty, or whose tokens' bytes differ from space + text (signs that
    a vocabulary rewrites), have no tokens: zeros and ``''``. Special tokens written in a
    text are plain text. Long texts are encoded whole by their task. Repeated rows count each.
    An empty table gives an empty one.
    """
    spark = df.sparkSession
    spec, pieces = Path(vocabulary).read_text(encoding="utf-8"), Pieces(Path(model).read_bytes())
    a_bytes = token_bytes(spec)
    a_size, b_size = len(a_bytes), len(pieces.bytes)
    kinds = tuple("<u2" if n <= 1 << 16 else "<u4" for n in (a_size, b_size))
    lengths = spark.sparkContext.broadcast((np.array(list(map(len, a_bytes))), np.array(list(map(len, pieces.bytes)))))

    kept = [c for c in without(df, OUT).columns if c != text]
    own = F.struct(F.lit(0).alias("_"), *[col(c).alias(f"c{i}") for i, c in enumerate(kept)]).alias("own")
    rows = df.select(own, F.monotonically_increasing_id().alias("row"), col(text).alias("text"))
    coded = tokenize(rows, "text", vocabulary, model, kinds)
    path = shared_dir(spark, "tokens")
    coded.write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(coded.schema).parquet(path)

    counts = cut(pair_counts(tokens, lengths, kinds, b_size))
    best = np.zeros(b_size, np.int64)  # one number for each B id, whatever the corpus
    for b, n in counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("n")).collect():
        best[b] = n
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()
    room, least = sent, 64
    for k, n in sorted(((r[0], r[1]) for r in sizes), reverse=True):
        if n > room:
            break
        room, least = room - n, k
    from_here = 1 << min(least, 62)
    common = counts.where(F.col("n") >= from_here).sort("pair").toArrow()
    known = spark.sparkContext.broadcast((common["pair"].to_numpy(), common["n"].to_numpy(), best))
    rest = any(r[0] < least for r in sizes)

    def look_up(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each pair's count was sent, and that count."""
        keys, n, _ = known.value
        at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
        there = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
        return there, n[at[there]]

    fields = [T.StructField(n, T.LongType()) for n in OUT[:-1]] + [T.StructField("groups", T.StringType())]
    shown = T.StructType([f for f in coded.schema if f.name in ("own", "row")] + fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = Digits(max(a_size, b_size))
        a_len, b_len = lengths.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                a, a_docs = flat(batch.column(2), kinds[0])
                b, b_docs = flat(batch.column(3), kinds[1])
                many = batch.num_rows
                made = [a_docs, b_docs, *([0] * many for _ in range(4)), [""] * many]
                if len(a):
                    parts = stretches(a, b, a_len, b_len)
                    pairs, docs, n, links = by_document(a, b, a_docs, b_docs, parts, b_size)
                    there, count = look_up(pairs)
                    pairs, docs, n = pairs[there], docs[there], n[there]
                    top = n * (count == known.value[2][pairs % b_size])
                    # sums of integers, exact beyond 2^53 too
                    order = np.argsort(docs, kind="stable")
                    edge = np.searchsorted(docs[order], np.arange(many + 1))
                    total, ahead = np.append(0, np.cumsum((n * count)[order])), np.append(0, np.cumsum(top[order]))
                    n_groups, groups = group_texts(a, b, a_docs, b_docs, parts, digits)
                    made = [a_docs, b_docs, n_groups, links, np.diff(ahead[edge]), np.diff(total[edge]), groups]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1),
                     *(pa.array(v, to_arrow_type(f.dataType)) for v, f in zip(made, fields))], names=shown.names)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_len, b_len = lengths.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                a, a_docs = flat(batch.column(1), kinds[0])
                b, b_docs = flat(batch.column(2), kinds[1])
                if len(a):
                    parts = stretches(a, b, a_len, b_len)
                    pairs, docs, n, _ = by_document(a, b, a_docs, b_docs, parts, b_size)
                    left = ~look_up(pairs)[0]
                    ids = batch.column(0).to_numpy()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[docs[left]]), pa.array(pairs[left]), pa.array(n[left])], names=["row", "pair", "links"])

    scored = tokens.select("own", "row", "a", "b").mapInArrow(score, shown)
    if digest:
        scored = scored.withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    if rest:
        tops = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("n").alias("top"))
        rare = counts.where(F.col("n") < from_here).withColumn("b", F.col("pair") % b_size).join(tops, "b")
        found = tokens.select("row", "a", "b").mapInArrow(others, "row long, pair long, links long")
        more = found.join(rare, "pair").groupBy("row").agg(
            F.sum(F.col("links") * F.col("n")).alias("more_sum"),
            F.sum(F.when(F.col("n") == F.col("top"), F.col("links")).otherwise(0)).alias("more_best"))
        scored = scored.join(more, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
            "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return scored.select(*[F.col("own").getField(f"c{i}").alias(c) for i, c in enumerate(kept)], *OUT)

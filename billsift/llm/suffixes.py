"""Removal of repeated byte strings with Burrows-Wheeler transforms built column by column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut
from .common import col, without

#: Length of a repeated string, of an anchor, most string starts in a piece.
WIDTH, GRAM, RUN = 100, 64, 64
#: Bytes of text whose pieces meet in one group, and of the documents of one home.
PLACE = 1 << 26
#: An anchor with more different pieces is resolved string by string; pieces of one transform.
HOT, COLLECTION = 4096, 2000
#: Bytes worked on at once in a task; longer texts are read in overlapping parts.
BLOCK = 1 << 19
NO_ID = (1 << 63) - 1
#: A string's place: its text's number among those of one id, then its start.
START_BITS = 32
DUP, SHIP, SPLIT = 0, 1, 2

_rng = np.random.default_rng(100)
BYTE = _rng.integers(1, 1 << 63, 256, np.uint64)
BYTE2 = _rng.integers(1, 1 << 63, 256, np.uint64)
STEPS = _rng.integers(1, 1 << 63, 16, np.uint64) | np.uint64(1)
BASE = int(_rng.integers(1, 1 << 63)) | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.ones(max(1, n), np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


POWER, UNPOWER = powers(BASE, BLOCK + 4 * WIDTH), powers(INVERSE, BLOCK + 4 * WIDTH)


def grams(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes (a power of two) from each place."""
    h = BYTE[data]
    size, step = 1, 0
    while size < length:
        h = h[:-size] * STEPS[step] + h[size:]
        size, step = size * 2, step + 1
    return mixed(h)


def lowest(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    size, m = 1, h
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[:len(m) - (width - size)], m[width - size:]) if width > size else m


def stretches(data: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A hash of each byte range, from one running sum."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * POWER[:len(data)], out=total[1:])
    return mixed((total[start + length] - total[start]) * UNPOWER[start] + length.astype(np.uint64))


def pieces(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor, hash, start, length of every piece of texts that lie end to end, and whether
    its anchor stands in it more than once (just then it can hold a string twice).

    The anchor of a string of ``WIDTH`` bytes is the smallest hash of ``GRAM``
    bytes in it. Neighbouring strings of one anchor, ``RUN`` at most, make a piece;
    equal strings have equal anchors wherever they stand.
    """
    none = np.zeros(0, np.int64)
    if len(data) < WIDTH:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    hashes = grams(data, GRAM)
    anchor = lowest(hashes, WIDTH - GRAM + 1)
    last = np.repeat(ends, np.diff(ends, prepend=0))[:len(anchor)]
    inside = np.arange(len(anchor)) + WIDTH <= last
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (last[1:] != last[:-1])
    begin = np.flatnonzero(fresh)
    place = np.arange(len(anchor)) - np.repeat(begin, np.diff(begin, append=len(anchor)))
    begin = np.flatnonzero((place % RUN == 0))
    stop = np.append(begin[1:], len(anchor))
    room = np.maximum(0, np.minimum(stop, last[begin] - WIDTH + 1) - begin)
    keep = inside[begin] & (room > 0)
    start, length = begin[keep], room[keep] + WIDTH - 1
    if not len(start):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    n = length - GRAM + 1
    head = np.cumsum(n) - n
    inner = hashes[np.arange(n.sum()) + np.repeat(start - head, n)] == np.repeat(anchor[start], n)
    twice = np.add.reduceat(inner.astype(np.int16), head) > 1
    return anchor[start], stretches(data, start, length, BYTE2), start, length, twice


class Rows:
    """Columns of pieces, packed into one binary value to travel."""

    KIND = (("a", "<u8"), ("s", "<u8"), ("doc", "<i8"), ("pos", "<i8"), ("len", "u1"), ("home", "<u4"), ("own", "u1"))

    def __init__(self, **columns: np.ndarray):
        self.__dict__.update({n: np.asarray(columns[n]).astype(t, copy=False) for n, t in self.KIND})

    def __len__(self) -> int:
        return len(self.a)

    def take(self, which: np.ndarray) -> Rows:
        return Rows(**{n: getattr(self, n)[which] for n, _ in self.KIND})

    def pack(self, columns=KIND) -> bytes:
        """Column by column, the bytes of a column by their significance: near values compress well."""
        return b"".join(getattr(self, n).view("u1").reshape(len(self), -1).T.tobytes() for n, _ in columns)

    @classmethod
    def unpack(cls, blobs: list[bytes], columns=KIND) -> Rows:
        size = sum(np.dtype(t).itemsize for _, t in columns)
        sizes = [len(b) // size for b in blobs]
        out = {n: np.zeros(sum(sizes), t) for n, t in cls.KIND}
        done = 0
        for blob, rows in zip(blobs, sizes):
            at = 0
            for n, t in columns:
                width = np.dtype(t).itemsize
                part = np.frombuffer(blob, "u1", rows * width, at).reshape(width, rows)
                out[n][done:done + rows] = np.ascontiguousarray(part.T).view(t).ravel()
                at += rows * width
            done += rows
        return cls(**out)


#: What travels of a repeat.
FOUND = tuple(k for k in Rows.KIND if k[0] in ("doc", "pos", "len", "home"))


def firsts(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (a, s, doc, pos); for each in that order: its group, whether it stands at the group's first place."""
    order = np.lexsort((rows.pos, rows.doc, rows.s, rows.a))
    a, s, doc, pos = rows.a[order], rows.s[order], rows.doc[order], rows.pos[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    first = (doc == doc[head][group]) & (pos == pos[head][group]) if len(order) else new
    return order, group, first


def dealt(rows: Rows, place: np.ndarray, mode: int) -> Iterator[tuple[int, int, bytes]]:
    """(mode, place, packed rows) for each place."""
    order = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.diff(place[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield mode, int(place[part[0]]), rows.take(part).pack(FOUND if mode == DUP else Rows.KIND)


def asked(rows: Rows, places: int, mode: int) -> Iterator[tuple[int, int, bytes]]:
    """Of equal pieces met here one goes on by its anchor; the later ones are repeats already."""
    order, group, first = firsts(rows)
    once = np.zeros(len(order), bool)
    once[np.unique(group, return_index=True)[1]] = True
    ask = rows.take(np.sort(order[once]))  # as they stand in the texts
    yield from dealt(ask, ask.a % np.uint64(places), mode)
    later = rows.take(np.sort(order[~first]))
    yield from dealt(later, later.home % np.uint32(places), DUP)


def answered(rows: Rows, ship: bool) -> Iterator[tuple[int, int, bytes]]:
    """What each home learns of its pieces: a repeat, or to send the text of a first piece.

    The pieces that differ under one anchor are sent, each once, and those that
    hold their anchor twice; they may share strings. Of an anchor with more than ``HOT`` of them, the strings are sent
    as hashes instead, so no anchor gathers in one task.
    """
    order, group, first = firsts(rows)
    later = rows.take(np.sort(order[~first]))
    yield from dealt(later, later.home, DUP)
    if ship and len(order):
        head = order[np.unique(group, return_index=True)[1]]
        heads = rows.take(head)
        _, back, many = np.unique(heads.a, return_inverse=True, return_counts=True)
        several = (many[back] > 1) | (heads.own > 0)
        for mode, which in ((SHIP, several & (many[back] <= HOT)), (SPLIT, many[back] > HOT)):
            part = heads.take(np.flatnonzero(which))
            yield from dealt(part, part.home, mode)


def transform(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of a collection: (text, start, common prefix with the one before).

    Column-wise construction: texts are aligned at their ends, and each round
    puts one more symbol of every text in front of its suffix. A new suffix's
    row follows from counting its symbol in the transform above the row of the
    suffix without it; its common prefix with a neighbour in its pile is one more
    than the smallest common prefix between their rows a round ago. Each round
    reads transform and common prefixes once from front to back and writes
    them anew with the new rows in place.
    """
    m = len(texts)
    used = np.unique(np.concatenate(texts))
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(1, len(used) + 1)
    size = np.array([len(t) for t in texts])
    longest = int(size.max())
    column = np.zeros((longest + 1, m), np.uint8)  # row j: the symbol in front of the suffix of length j
    for i, t in enumerate(texts):
        column[:len(t), i] = code[t[::-1]]
    symbols = column[0].copy()  # the transform; 0 where a text begins
    common = np.zeros(m, np.uint8)
    row = np.arange(m)  # of each text's newest suffix
    alive = np.arange(m)

    def piles(symbols):
        """Rows in the order of their symbols, each row's place in it, and where a pile begins."""
        counts = np.bincount(symbols, minlength=len(used) + 1)
        by_symbol = np.argsort(symbols, kind="stable")[counts[0]:]
        place = np.zeros(len(symbols), np.int32)
        place[by_symbol] = np.arange(len(by_symbol), dtype=np.int32)
        return by_symbol, place, np.cumsum(counts) - counts - counts[0]

    for j in range(1, longest + 1):
        alive = alive[size[alive] >= j]
        by_symbol, place, begin = piles(symbols)
        at = place[row[alive]]
        fresh = m + at  # below the rows of the texts' ends
        # common prefixes of new rows and of the rows below them
        near = np.zeros(len(by_symbol) + 1, bool)
        near[at] = near[at + 1] = True
        spot = np.flatnonzero(near[:-1])
        inner = spot > begin[symbols[by_symbol[spot]]]
        ends = np.column_stack([by_symbol[spot[inner] - 1] + 1, by_symbol[spot[inner]] + 1]).ravel()
        least = np.zeros(len(spot), np.int64)
        if len(ends):
            least[inner] = np.minimum.reduceat(np.append(common, np.uint8(0)), ends)[::2].astype(np.int64) + 1
        old = np.ones(len(symbols) + len(alive), bool)
        old[fresh] = False
        new_symbols, new_common = np.empty(len(old), np.uint8), np.empty(len(old), np.uint8)
        new_symbols[old], new_common[old] = symbols, common
        new_symbols[fresh] = column[j, alive]
        new_common[m + spot] = np.minimum(least, 255)
        symbols, common = new_symbols, new_common
        row[alive] = fresh

    # every suffix's row, from the ends of the texts to their beginnings
    owner, depth = np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
    place = piles(symbols)[1]
    row, alive = np.arange(m), np.arange(m)
    for j in range(1, longest + 1):
        going = size[alive] >= j
        alive = alive[going]
        row = m + place[row[going]]
        owner[row], depth[row] = alive, j
    return owner, size[owner] - depth, common


def repeats(rows: Rows, texts: list[np.ndarray]) -> Rows:
    """Strings of ``WIDTH`` bytes in a collection of pieces that occur at an earlier place."""
    owner, start, common = transform(texts)
    full = rows.len[owner].astype(np.int64) - start >= WIDTH
    joined = full & (common >= WIDTH)
    group = np.cumsum(~joined)
    owner, start, group = owner[full], start[full], group[full]
    doc, pos = rows.doc[owner], rows.pos[owner] + start
    order = np.lexsort((pos, doc, group))
    owner, start, group, doc, pos = owner[order], start[order], group[order], doc[order], pos[order]
    _, head, back = np.unique(group, return_index=True, return_inverse=True)
    later = (doc != doc[head][back]) | (pos != pos[head][back])
    owner, start = owner[later], start[later]
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    begin = np.ones(len(owner), bool)
    begin[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(begin)
    n = np.diff(at, append=len(owner))
    found = rows.take(owner[at])
    found.pos, found.len = found.pos + start[at], (n + WIDTH - 1).astype("u1")
    return found


def resolved(blobs: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Repeats among pieces sent by their anchors, in collections of bounded size."""
    parts, texts = [], []
    for blob in blobs:
        head = int.from_bytes(blob[:8], "little")
        rows = Rows.unpack([blob[8:8 + head]])
        data = np.frombuffer(blob, np.uint8, offset=8 + head)
        texts += np.split(data, np.cumsum(rows.len.astype(np.int64))[:-1])
        parts.append(rows)
    rows = Rows(**{n: np.concatenate([getattr(p, n) for p in parts]) for n, _ in Rows.KIND})
    order = np.argsort(rows.a, kind="stable")
    held: list[int] = []
    for part in np.split(order, np.flatnonzero(np.diff(rows.a[order])) + 1):
        held += part.tolist()
        if len(held) >= COLLECTION:
            found = repeats(rows.take(np.array(held)), [texts[i] for i in held])
            yield from dealt(found, found.home, DUP)
            held = []
    if held:
        found = repeats(rows.take(np.array(held)), [texts[i] for i in held])
        yield from dealt(found, found.home, DUP)


OUT = T.StructType([T.StructField("mode", T.IntegerType()), T.StructField("place", T.LongType()),
                    T.StructField("rows", T.BinaryType())])
OUT_ARROW = to_arrow_schema(OUT)


def packed(found: Iterator[tuple[int, int, bytes]]) -> pa.Table:
    rows = list(found)
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(OUT_ARROW)],
                                schema=OUT_ARROW)


def scan(places: int):
    """Ask for all pieces of a batch of (id, home, number, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            data = np.frombuffer(b"".join(h[3] for h in held), np.uint8)
            ends = np.cumsum([len(h[3]) for h in held])
            a, s, start, length, twice = pieces(data, ends)
            own = np.searchsorted(ends, start, side="right")
            begins = np.append(0, ends[:-1])
            base = np.array([h[1] for h in held], np.int64)
            rows = Rows(a=a, s=s, doc=np.array([h[0] for h in held], np.int64)[own],
                        pos=base[own] + start - begins[own], len=length,
                        home=np.array([h[2] for h in held], np.int64)[own], own=twice)
            return packed(asked(rows, places, SHIP)).to_batches()

        for batch in batches:
            for i in range(batch.num_rows):
                doc, home, number, text = (batch.column(k)[i].as_py() for k in range(4))
                data = (text or "").encode()
                place = number << START_BITS
                for at in range(0, max(0, len(data) - WIDTH + 1), BLOCK):
                    part = data[at:at + BLOCK + WIDTH - 1]
                    if size + len(part) > BLOCK + WIDTH and held:
                        yield from flush()
                        held, size = [], 0
                    held.append((NO_ID if doc is None else doc, place + at, home, part))
                    size += len(part)
        if held:
            yield from flush()

    return run


def by_key(table: pa.Table) -> dict[tuple[int, int], bytes]:
    out = {}
    for doc, number, text in zip(*(table.column(c).to_pylist() for c in ("id", "number", "text")), strict=True):
        out[NO_ID if doc is None else doc, number << START_BITS] = (text or "").encode()
    return out


def answer(key, table):
    def found():
        modes = table.column("mode").to_numpy()
        blobs = table.column("rows").to_pylist()
        yield from answered(Rows.unpack([b for m, b in zip(modes, blobs) if m == SHIP]), True)
        done = Rows.unpack([b for m, b in zip(modes, blobs) if m == DUP], FOUND)
        yield from dealt(done, done.home, DUP)

    return packed(found())


def send(places: int):
    """Send the texts of pieces that were asked for, or the hashes of their strings."""

    def run(key, docs, wanted):
        def found():
            modes, blobs = wanted.column("mode").to_numpy(), wanted.column("rows").to_pylist()
            texts = by_key(docs) if (modes != DUP).any() else {}
            rows = Rows.unpack([b for m, b in zip(modes, blobs) if m == SHIP])
            mask = (1 << START_BITS) - 1

            def text(r, i):
                at = int(r.pos[i]) & mask
                return texts[int(r.doc[i]), int(r.pos[i]) & ~mask][at:at + int(r.len[i])]

            place = rows.a % np.uint64(places)
            order = np.argsort(place, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else []:
                head = rows.take(part).pack()
                yield SHIP, int(place[part[0]]), len(head).to_bytes(8, "little") + head + b"".join(
                    text(rows, i) for i in part)
            hot = Rows.unpack([b for m, b in zip(modes, blobs) if m == SPLIT])
            for at in range(0, len(hot), 2000):
                part = hot.take(np.arange(at, min(len(hot), at + 2000)))
                data = np.frombuffer(b"".join(text(part, i) for i in range(len(part))), np.uint8)
                length = part.len.astype(np.int64)
                starts = length - WIDTH + 1
                own = np.repeat(np.arange(len(part)), starts)
                inner = np.arange(len(own)) - np.repeat(np.cumsum(starts) - starts, starts)
                begin = (np.cumsum(length) - length)[own] + inner
                width = np.full(len(own), WIDTH)
                strings = Rows(a=stretches(data, begin, width, BYTE), s=stretches(data, begin, width, BYTE2),
                               doc=part.doc[own], pos=part.pos[own] + inner, len=width, home=part.home[own],
                               own=np.zeros(len(own), np.uint8))
                yield from asked(strings, places, SPLIT)

        return packed(found())

    return run


def resolve(key, table):
    def found():
        modes, blobs = table.column("mode").to_numpy(), table.column("rows").to_pylist()
        sent = [b for m, b in zip(modes, blobs) if m == SHIP]
        if sent:
            yield from resolved(sent)
        yield from answered(Rows.unpack([b for m, b in zip(modes, blobs) if m == SPLIT]), False)
        done = Rows.unpack([b for m, b in zip(modes, blobs) if m == DUP], FOUND)
        yield from dealt(done, done.home, DUP)

    return packed(found())


def spans(n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Maximal covered runs of n bytes as rows (start, end)."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, start + length, -1)
    edge = np.diff((np.cumsum(change[:-1]) > 0).astype(np.int8), prepend=0, append=0)
    return np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)])


def carve():
    """Cut the repeats out of each text of a home."""
    mask = (1 << START_BITS) - 1

    def run(key, docs, told):
        blobs = [b for m, b in zip(told.column("mode").to_numpy(), told.column("rows").to_pylist()) if m == DUP]
        rows = Rows.unpack(blobs, FOUND)
        order = np.lexsort((rows.pos, rows.doc))
        doc, pos, length = rows.doc[order], rows.pos[order], rows.len[order].astype(np.int64)
        text_place = pos & ~np.int64(mask)
        cuts = np.flatnonzero((doc[1:] != doc[:-1]) | (text_place[1:] != text_place[:-1])) + 1
        edges = [0, *cuts.tolist(), len(doc)]
        own = {(int(doc[b]), int(text_place[b])): (b, e) for b, e in zip(edges, edges[1:]) if e > b}
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for i, number, t in zip(*(docs.column(c).to_pylist() for c in ("id", "number", "text")), strict=True):
            data = (t or "").encode()
            b, e = own.get((NO_ID if i is None else i, number << START_BITS), (0, 0))
            runs = spans(len(data), pos[b:e] & mask, length[b:e]) if e > b else np.zeros((0, 2), np.int64)
            edge = [0, *runs.ravel().tolist(), len(data)]
            kept.append(b"".join(data[x:y] for x, y in zip(edge[::2], edge[1::2])))
            n_bytes.append(len(data))
            n_spans.append(len(runs))
            n_removed.append(len(data) - len(kept[-1]))
        made = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                pa.array(kept, pa.binary())]
        given = ["id", "number", "own", "text"]
        return pa.Table.from_arrays([*[docs.column(c) for c in given], *made],
                                    names=[*given, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def numbered(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Append ``number``: 0, or the place of a text among the different texts of its id.

    Texts are told apart and ordered by 128 bits of hash. Only ids of several rows are
    numbered, in parts by the beginning of the hash, so an id that many texts share is many groups.
    Also returns, if there are any, the rows that stand in the table more than once; the first table then
    holds one of each, without ``own``.
    """
    marked = df.select("id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("mark"))
    several = cut(marked.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("own_id")))
    if several.isEmpty():
        return df.withColumn("number", F.lit(0).cast("long")), None
    marks = marked.join(several, F.col("id").eqNullSafe(F.col("own_id")), "left_semi").groupBy("id", "mark").agg(
        F.count("*").alias("copies")).withColumn("part", F.substring("mark", 1, 3))
    ahead = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = marks.groupBy("id", "part").agg(F.count("*").alias("n")).select(
        F.col("id").alias("own_id"), F.col("part").alias("own_part"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("id", "part").orderBy("mark"))
    numbers = cut(marks.withColumn("place", place).join(
        parts, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("part") == F.col("own_part"))).select(
        "own_id", F.col("mark").alias("own_mark"), "copies", (F.col("before") + F.col("place") - 1).cast("long").alias("number")))
    whole = df.withColumn("mark", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark"))
    found = whole.join(numbers, same, "left").select(
        *df.columns, F.coalesce("number", F.lit(0)).cast("long").alias("number"), "copies")
    once = found.where("coalesce(copies, 1) = 1").drop("copies")
    if numbers.where("copies > 1").isEmpty():
        return once, None
    copies = found.where("copies > 1").drop("copies")
    one = copies.select("id", "number", "text").dropDuplicates(["id", "number"])
    return once.unionByName(one, allowMissingColumns=True), copies


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", homes: int | None = None) -> DataFrame:
    """Remove each byte covered by a string of 100 bytes that also starts earlier.

    Earlier is a smaller id, or the same document at an earlier start; strings are
    judged on the input and never cross documents. Adds ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (binary, the
    remaining bytes); columns of these names are replaced, all others kept.

    Equal strings share their anchor, the smallest hash of 64 bytes in them, so
    pieces around one anchor (163 bytes at most) meet at one place and only there can
    strings be equal. Equal pieces enter once (each task sends one, the rest are
    repeats at once), so thousands of copies of a passage, or one in a third of
    all documents, are a row per task. Different pieces of an anchor form a
    collection whose suffixes are sorted with common prefixes column by
    column (``transform``); neighbours with 100 bytes in common are equal
    strings. An anchor with over ``HOT`` different pieces is dealt out again by
    the strings themselves, exactly. Texts travel to their home once.

    Null texts count as empty. Rows without an id come after all others. Rows of one id (or
    without one) with different texts are told apart and ordered by 128 bits of hash; equal rows are one document, which
    goes through all this once, and lose the same bytes. Long texts are read in overlapping parts. Columns may bear any names. An
    empty table gives an empty one.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # groups are tables in a task's memory: they grow in number with the texts, not in size
    size = df.agg(F.sum(F.octet_length(col(text)))).first()[0] or 0
    places = max(parts, -(-size // PLACE))
    homes = homes or 4 * places
    out = ["n_bytes", "n_removed", "n_spans", "kept"]
    names = without(df, out).columns
    # the caller's columns travel as one, so that none can clash with ours
    own = F.struct(F.lit(0).alias("_"), *[col(c).alias(f"c{i}") for i, c in enumerate(names) if c != text])
    keyed, copies = numbered(df.select(col(doc_id).cast("long").alias("id"), col(text).alias("text"), own.alias("own")))
    keyed = keyed.withColumn("home", F.pmod(F.xxhash64("id", "number"), F.lit(homes)))
    asks = keyed.select("id", "home", "number", "text").mapInArrow(scan(places), OUT)
    told = cut(asks.groupBy("place").applyInArrow(answer, OUT))
    # the same columns as for carving, so that one shuffle of the texts serves both
    sent = keyed.groupBy("home").cogroup(told.groupBy("place")).applyInArrow(send(places), OUT)
    late = sent.groupBy("place").applyInArrow(resolve, OUT)
    all_told = told.where(F.col("mode") == DUP).union(late)
    schema = T.StructType([*[keyed.schema[c] for c in ("id", "number", "own", "text")], *[T.StructField(n, T.LongType()) for n in out[:3]],
                           T.StructField("kept", T.BinaryType())])
    cleared = keyed.groupBy("home").cogroup(all_told.groupBy("place")).applyInArrow(carve(), schema)
    if copies is not None:
        cleared = cut(cleared)
        of = cleared.where("own is null").select(F.col("id").alias("own_id"), F.col("number").alias("own_number"), *out)
        same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("number") == F.col("own_number"))
        cleared = cleared.where("own is not null").unionByName(copies.join(of, same).drop("own_id", "own_number"))
    return cleared.select(*[(F.col("text") if c == text else F.col("own").getField(f"c{i}")).alias(c)
                            for i, c in enumerate(names)], *out)

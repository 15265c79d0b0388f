"""BPE encoding and decoding with a published byte-level vocabulary."""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

# How byte-level vocabularies cut a text before merging.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# The same for texts of Latin-1 signs only, spelled out so that the faster engine can read them.
LETTERS, NUMBERS, BLANKS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_PIECES = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+"
    rf"|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
)
#: Distinct pieces remembered per task, and the longest one that is.
MEMORY, LONGEST = 500_000, 64


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a vocabulary, to the byte.

    Printable Latin-1 signs stand for themselves, all others for the signs from
    U+0100 on, in byte order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        signs = byte_signs()
        self.first = [0] * 256
        for sign, byte in signs.items():
            self.first[byte] = vocab[sign]
        self.merged = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merged[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.strings = {i: bytes(map(signs.__getitem__, s)) for s, i in vocab.items()}
        self.special = {}
        for token in model.get("added_tokens", []):
            if token["lstrip"] or token["rstrip"] or token["single_word"]:
                raise ValueError("added tokens must stand for their exact text")
            self.special[token["content"]] = int(token["id"]).to_bytes(4, "little")
            self.strings[token["id"]] = token["content"].encode()
        longest_first = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") \
            if longest_first else None
        self.pieces, self.latin = regex.compile(PIECES), re.compile(LATIN_PIECES)
        self.known = Known(self)

    def merge(self, data: bytes) -> list[int]:
        """Merge one piece: a queue of (rank, place) over doubly linked symbols."""
        symbols = [self.first[b] for b in data]
        size = len(symbols)
        before = list(range(-1, size - 1))
        after = list(range(1, size + 1))
        merged = self.merged
        queue = []
        for i in range(size - 1):
            found = merged.get((symbols[i], symbols[i + 1]))
            if found:
                queue.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapify(queue)
        while queue:
            _, i, left, right, new = heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= size or symbols[j] != right:
                continue  # stale: a side was merged since
            symbols[i], symbols[j] = new, -1
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if found := merged.get((new, symbols[k])):
                    heappush(queue, (found[0], i, new, symbols[k], found[1]))
            if (h := before[i]) >= 0 and (found := merged.get((symbols[h], new))):
                heappush(queue, (found[0], h, symbols[h], new, found[1]))
        return [s for s in symbols if s >= 0]

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pieces.findall(text)
        return self.latin.findall(text)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.marks is None or not self.marks.search(text):
            return b"".join(map(self.known.__getitem__, self.split(text)))
        return b"".join(
            self.special[part] if part in self.special else
            b"".join(map(self.known.__getitem__, self.split(part)))
            for part in self.marks.split(text))

    def decode(self, ids: bytes) -> str:
        strings = map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return b"".join(strings).decode("utf-8", "replace")


class Known(dict):
    """Ids of the pieces met so far; emptied when full, so its memory is bounded."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.codec.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = ids
        return ids


def round_trip(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Encode each whole text and decode its ids again, one pass and no shuffle.

    Adds ``ids`` (binary: ids as little-endian unsigned 32-bit integers),
    ``n_tokens`` and ``decoded``; columns of these names are replaced, all
    others kept. Special tokens written in a text become their ids, as the
    public library does it. Bytes that do not form UTF-8 decode to U+FFFD.

    ``vocabulary`` is the path of a byte-level BPE file in JSON; the driver
    reads it and sends its text (its size is that of the vocabulary, whatever
    the corpus) to the tasks.

    Null and empty texts have no ids and decode to ``""``. A piece of any
    length merges in n log n steps. Repeated rows are encoded each; an empty
    table gives an empty one.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = df.sparkSession.sparkContext.broadcast(file.read())

    def make():
        codec = Codec(spec.value)

        def compute(texts):
            ids = [codec.encode(t) for t in texts]
            return ids, [len(i) // 4 for i in ids], [codec.decode(i) for i in ids]

        return compute

    fields = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()),
              T.StructField("decoded", T.StringType())]
    return add_columns(df, text, fields, make)

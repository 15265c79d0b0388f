"""Ids of a published byte-level vocabulary by the public library, pieces met before remembered."""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib

import numpy as np
import regex

from .bpe import LATIN_PIECES, LONGEST, PIECES, byte_signs

#: Distinct pieces remembered by a task.
MEMORY = 300_000


def met(spec: str, marks: bool) -> dict[str, bytes]:
    """The pieces that this worker process has met in its tasks so far, for an ``Encoder``.

    Code that travels with a task has no globals that outlast it; the process's table of modules
    does. Losing it costs time only.
    """
    home = sys.modules.setdefault("_pieces_met", types.ModuleType("_pieces_met"))
    return vars(home).setdefault(f"{zlib.crc32(spec.encode())}-{marks}", {})


class Encoder:
    """The ids that the public library gives, as little-endian unsigned 32-bit integers.

    A byte-level vocabulary cuts a text into pieces that never share a token, so each
    distinct piece goes to the library's model once; ``MEMORY`` short ones are remembered (in ``known``,
    where one is given). With ``marks``, special tokens written in a text become their ids, as in the library;
    without, their strings are plain text. A vocabulary that cuts in another way is
    encoded text by text.
    """

    def __init__(self, spec: str, marks: bool, known: dict[str, bytes] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = not marks
        model = json.loads(spec)
        cut = model.get("pre_tokenizer") or {}
        self.by_piece = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not (
            cut.get("add_prefix_space") or model.get("normalizer"))
        added = [t for t in model.get("added_tokens", []) if marks]
        self.by_piece &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        contents = sorted((t["content"] for t in added), key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, contents)) + ")") if contents else None
        self.pieces, self.latin = regex.compile(PIECES), re.compile(LATIN_PIECES)
        self.model = self.library.model
        self.signs = {byte: sign for sign, byte in byte_signs().items()}
        self.known = {} if known is None else known
        self.known.update((t["content"], int(t["id"]).to_bytes(4, "little")) for t in added)

    def split(self, text: str) -> list[str]:
        if self.marks is not None and self.marks.search(text):
            return [piece for part in self.marks.split(text)
                    for piece in ([part] if self.marks.fullmatch(part) else self.cut(part))]
        return self.cut(text)

    def cut(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pieces.findall(text)
        return self.latin.findall(text)

    def ask(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def ask_pieces(self, pieces: list[str]) -> list[bytes]:
        """The same for pieces, which the library's model need not cut again."""
        ids: list[int] = []
        cut = [0]
        for piece in pieces:
            signs = piece.encode().decode("latin-1").translate(self.signs)
            ids += [token.id for token in self.model.tokenize(signs)]
            cut.append(4 * len(ids))
        data = np.array(ids, "<u4").tobytes()
        return [data[b:e] for b, e in zip(cut, cut[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self.ask(texts)
        out = []
        for text in texts:
            pieces = self.split(text)
            ids = list(map(self.known.get, pieces))
            if None in ids:
                new = list({p for p, i in zip(pieces, ids) if i is None})
                found = dict(zip(new, self.ask_pieces(new), strict=True))
                ids = [found[p] if i is None else i for p, i in zip(pieces, ids)]
                room = max(0, MEMORY - len(self.known))  # frequent pieces come early and stay
                self.known.update((p, found[p]) for p in new[:room] if len(p) <= LONGEST)
            out.append(b"".join(ids))
        return out


def vocabulary_size(spec: str) -> int:
    """One more than the largest id."""
    model = json.loads(spec)
    return 1 + max([*model["model"]["vocab"].values(), *(t["id"] for t in model.get("added_tokens", []))])


def token_bytes(spec: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; unused ids have none."""
    model, signs = json.loads(spec), byte_signs()
    out = [b""] * vocabulary_size(spec)
    for text, i in model["model"]["vocab"].items():
        if all(s in signs for s in text):
            out[i] = bytes(map(signs.__getitem__, text))
    return out

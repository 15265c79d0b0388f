import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from billsift.llm.bpe import Codec, round_trip
from billsift.llm.queries import op10_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as file:
        return Codec(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(codec, library, texts):
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = codec.encode(text)
        assert list(memoryview(ids).cast("I")) == want.ids, text[:80]
        assert codec.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_random_texts_match_the_library(codec, library):
    rng = random.Random(3)
    signs = list("abceES'rtm  \n\t.,!?019é中ßü　\x85\x1c​\xa0😀́") + [
        "<|endoftext|>", "'ll", "'re", " the", "\r\n", "  "]
    same(codec, library, ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(4000)])


def test_latin_texts_match_the_library(codec, library):
    rng = random.Random(4)
    signs = [chr(i) for i in range(256)] + list("aé1 ' \n") * 20
    same(codec, library, ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(6000)])


def test_long_pieces_and_marks(codec, library):
    same(codec, library, ["", "a" * 5000, " " * 3000 + "x", "<|endoftext|>" * 3, "<|endoftext|",
                          "ab" * 4000 + "é" * 900, "1" * 3000, "-" * 2999, "\n" * 2000])


def test_table_edges(spark):
    rows = [(1, None, 5), (2, "", 6), (2, "", 6), (None, "hello <|endoftext|>", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_Tokens int")
    out = round_trip(df, PATH)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    got = sorted(out.collect(), key=lambda r: (r.n_tokens, r.doc_id or 0))
    assert [(r.doc_id, r.n_tokens, r.decoded) for r in got] == [
        (1, 0, ""), (2, 0, ""), (2, 0, ""), (None, 3, "hello <|endoftext|>")]
    assert round_trip(df.limit(0), PATH).count() == 0


def test_query_matches_the_library(spark, small, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op10_bpe(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(data).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from billsift.llm import packing
from billsift.llm.queries import END, op13_packing
from billsift.llm.tokens import Encoder
from billsift.session import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def stored(spark, df, **options):
    path = shared_dir(spark, "ids")
    packing.write(df, path, PATH, END, **options)
    rows = packing.read(spark, path).join(packing.file_starts(spark, path), ["shard", "number"]).collect()
    return sorted(((r.before + r.place, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows), key=lambda r: r[0])


@pytest.mark.parametrize("width", [1, 3, 7, 8, 12, 15, 16, 17, 24, 32])
def test_packed_ids_come_back(width):
    rng = np.random.default_rng(width)
    ids = rng.integers(0, 1 << width, 1001).astype("<u4")
    data = packing.pack(ids, width)
    assert len(data) == (1001 * width + 7) // 8
    assert (packing.unpack(np.frombuffer(data, "u1"), 1001, width) == ids).all()
    assert packing.pack(ids[:0], width) == b""


def test_fewest_bits():
    assert [packing.bits_for(n) for n in (1, 2, 3, 4, 5, 50257, 65536, 65537)] == [1, 1, 2, 2, 3, 16, 16, 17]


@pytest.mark.parametrize("width", [13, 16])
def test_any_range_of_a_file(width, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 64)
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 1 << width, n).astype("<u4") for n in (0, 1, 63, 64, 65, 300, 0, 129)]
    file = packing.Reader(packing.build([3, None, -5, 6, 7, 8, 9, 1 << 60], docs, width, 4, 2) + b"\n")
    flat = np.concatenate(docs)
    assert (file.shard, file.number, file.n_ids) == (4, 2, len(flat))
    assert file.doc_ids == [3, None, -5, 6, 7, 8, 9, 1 << 60]
    for n, one in enumerate(docs):
        assert (file.document(n) == one).all() and len(file.document(n)) == len(one)
    for _ in range(200):
        b, e = sorted(rng.integers(0, len(flat) + 1, 2))
        assert (file.ids(b, e) == flat[b:e]).all()
    with pytest.raises(ValueError):
        packing.Reader(b"x" * 200)


def test_library_by_pieces(library):
    rng = random.Random(8)
    signs = list("abce 'st\n0é中　\x85\x1c​\xa0😀") + ["<|endoftext|>", "'ll", " the", "\r\n", "  "]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 80))) for _ in range(3000)] + ["a" * 3000, "", " " * 999 + "x"]
    for marks in (True, False):
        library.encode_special_tokens = not marks
        encoder = Encoder(open(PATH, encoding="utf-8").read(), marks)
        assert encoder.by_piece
        for at in range(0, len(texts), 200):
            part = texts[at:at + 200]
            want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
            assert [np.frombuffer(i, "<u4").tolist() for i in encoder.encode(part)] == want
    library.encode_special_tokens = False


def test_memory_stays_bounded(monkeypatch):
    monkeypatch.setattr("billsift.llm.tokens.MEMORY", 50)
    encoder = Encoder(open(PATH, encoding="utf-8").read(), True)
    for n in range(40):
        encoder.encode([f"w{n}a w{n}b w{n}c {'x' * 70}{n}"])
        assert len(encoder.known) <= 51 and not any(len(p) > 64 for p in encoder.known)


def test_table_edges(spark, library, monkeypatch):
    long = "word and more, " * 20_000
    rows = [(5, None, 1), (2, "", 2), (2, "b text", 3), (2, "b text", 3), (None, "no id <|endoftext|>", 4),
            (-7, long, 5), (9, "last one", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `shard` int")
    got = stored(spark, df)
    want = {t: [*library.encode(t or "", add_special_tokens=False).ids, END] for _, t, _ in rows}
    assert [g[1] for g in got] == [-7, 2, 2, 2, 5, 9, None]
    assert sorted((g[1] is None, g[1] or 0, g[2]) for g in got) == sorted((i is None, i or 0, want[t]) for i, t, _ in rows)
    at = 0
    for start, _, ids in got:
        assert start == at
        at += len(ids)
    assert stored(spark, df.limit(0)) == []
    named = df.select(df.doc_id.alias("Doc.Id"), df.text.alias("the text"))
    assert [g[2] for g in stored(spark, named, doc_id="Doc.Id", text="the text")] == [g[2] for g in got]


def test_many_files_of_one_id(spark, library):
    df = spark.range(4000).selectExpr("7L as doc_id", "concat('text of row ', id % 50) as text")
    got = stored(spark, df)
    assert len(got) == 4000 and [g[0] for g in got] == np.cumsum([0, *[len(g[2]) for g in got]]).tolist()[:-1]


def test_query(spark, small, library):
    docs = sorted(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    want, at = [], 0
    for r in docs:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    assert sorted(map(tuple, op13_packing(spark, small).collect())) == want

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from billsift.llm.alignment import align, terminals
from billsift.llm.queries import PIECE_MODEL, VOCABULARY, op11_alignment
from billsift.llm.tokens import token_bytes


@pytest.fixture(scope="module")
def sides():
    first = Tokenizer.from_file(VOCABULARY)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    a_bytes = token_bytes(open(VOCABULARY, encoding="utf-8").read())

    def b_bytes(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(text):
        whole = (" " + (text or "")).encode()
        a, b = first.encode(whole.decode(), add_special_tokens=False).ids, second.encode(text or "")
        a_own, b_own = [a_bytes[i] for i in a], [b_bytes(i) for i in b]
        if not text or b"".join(a_own) != whole or b"".join(b_own) != whole:
            return [], [], [], []
        return a, b, np.cumsum(list(map(len, a_own))).tolist(), np.cumsum(list(map(len, b_own))).tolist()

    return tokens


def brute(sides, texts):
    """Every pair of tokens by its ranges; groups by common ends."""
    made, count = [], Counter()
    for text in texts:
        a, b, a_end, b_end = sides(text)
        a_at, b_at = [0, *a_end][:-1], [0, *b_end][:-1]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b))
                 if a_at[i] < b_end[j] and b_at[j] < a_end[i]] if len(a) < 300 else None
        if links is None:
            links, i, j = [], 0, 0
            while i < len(a) and j < len(b):
                links.append((a[i], b[j]))
                x, y = a_end[i], b_end[j]
                i, j = i + (x <= y), j + (y <= x)
        groups, before = [], 0
        for end in sorted(set(a_end) & set(b_end)):
            groups.append(",".join(str(t) for t, e in zip(a, a_end) if before < e <= end) + "|"
                          + ",".join(str(t) for t, e in zip(b, b_end) if before < e <= end))
            before = end
        count.update(links)
        made.append((a, b, groups, links))
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return [(len(a), len(b), len(groups), len(links), sum(count[x] == top[x[1]] for x in links),
             sum(count[x] for x in links), ";".join(groups)) for a, b, groups, links in made]


TEXTS = [None, "", " ", "a", "Hello world, an unbelievable thing", "Hello world, an unbelievable thing",
         "  two  blanks ", "tab\tand\nline\r\nends", "été 中文 😀 ✓", "has ▁ in it", "<|endoftext|> and <s> </s> <unk> <0x41>",
         "ﬁ ligature ①", "x" * 500, "zero\0byte", "trailing  ", "１２３ wide", "naïve café " * 40]


@pytest.mark.parametrize("sent", [0, 20, 1 << 18])
def test_against_all_ranges(spark, sides, sent):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string")
    got = [tuple(r)[1:] for r in sorted(align(df, VOCABULARY, PIECE_MODEL, sent=sent).collect())]
    assert got == brute(sides, TEXTS)
    assert sum(g[0] > 0 for g in got) >= 10 and got[0] == (0, 0, 0, 0, 0, 0, "")


def test_pointers_reach_the_last_token_of_a_group():
    # A ends at 3, 6, 9, 10; B ends at 2, 5, 8, 10: one chain; then one token each
    a_end, b_end = np.array([3, 6, 9, 10, 12]), np.array([2, 5, 8, 10, 12])
    ends = np.union1d(a_end, b_end)
    a_of, b_of = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    to = terminals(np.searchsorted(ends, a_end), np.searchsorted(ends, b_end), a_of, b_of)
    assert to.tolist() == [8, 8, 8, 8, 9, 8, 8, 8, 8, 9]


def test_long_chain_and_long_text(spark, sides):
    texts = ["unbelievably" * 3000, "plain words of a long text. " * 4000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = [tuple(r)[1:] for r in sorted(align(df, VOCABULARY, PIECE_MODEL).collect())]
    for (n_a, n_b, n_groups, n_links, _, _, groups), text in zip(got, texts):
        a, b, a_end, b_end = sides(text)
        assert (n_a, n_b, n_links) == (len(a), len(b), len(set(a_end) | set(b_end)))
        assert n_groups == len(set(a_end) & set(b_end)) == groups.count(";") + 1


def test_table_edges(spark):
    df = spark.createDataFrame([(1, "some text", 5, 6), (1, "some text", 5, 6), (None, None, None, None)],
                               "`doc.id` int, text string, N_A int, own int")
    out = align(df, VOCABULARY, PIECE_MODEL, digest=True)
    assert out.columns == ["doc.id", "own", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    rows = sorted(map(tuple, out.collect()), key=str)
    assert rows[0] == rows[1] and rows[0][:2] == (1, 6) and len(rows[0][-1]) == 64
    assert rows[2] == (None, None, 0, 0, 0, 0, 0, 0, "")
    assert rows[0][7] == 2 * rows[0][5]  # each pair stands in both rows
    assert align(df.limit(0), VOCABULARY, PIECE_MODEL).count() == 0
    assert align(df.select("text"), VOCABULARY, PIECE_MODEL).count() == 3


def test_query(spark, small, sides):
    docs = sorted(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    want = brute(sides, [r.text for r in docs])
    got = [tuple(r) for r in sorted(op11_alignment(spark, small).collect())]
    assert got == [(r.doc_id, *w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[0] else "")
                   for r, w in zip(docs, want)]

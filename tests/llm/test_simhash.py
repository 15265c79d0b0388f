import random

import xxhash
from pyspark.sql import functions as F

from billsift.llm import simhash
from billsift.llm.components import star_roots
from billsift.llm.queries import op8_simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        low = low.replace(blank, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps):
    """Smallest id reachable over links of at most two bits; ids are the list's places."""
    own = list(range(len(fps)))

    def top(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((top(i), top(j)))
                own[b] = a
    return [top(i) for i in range(len(fps))]


def test_query_against_all_pairs(spark, small):
    docs = sorted(spark.read.parquet(f"{small}/documents.parquet").collect(), key=lambda r: r.doc_id)
    fps = [plain_fingerprint(r.text) for r in docs]
    want = {r.doc_id: (f"{f:016x}", docs[c].doc_id) for r, f, c in zip(docs, fps, plain_classes(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op8_simhash(spark, small).collect()} == want


def test_links_in_small_and_large_cells(spark):
    rng = random.Random(5)
    fps = set()
    for size in (1, 1, 3, 60):  # the last makes cells that are split another way
        seed = rng.getrandbits(64)
        fps |= {seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(size * 3)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    signed = {simhash.signed(f): i for i, f in enumerate(fps)}
    root = {signed[r.node]: signed[r.root] for r in star_roots(simhash.within(frame)).collect()}
    groups = {}
    for i, c in enumerate(plain_classes(fps)):
        groups.setdefault(c, set()).add(i)
    got = {}
    for i in range(len(fps)):
        got.setdefault(root.get(i, i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000), (None, 3)]
    rows = star_roots(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == (
        {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {5000: 5000})


def test_table_edges(spark):
    rows = [(5, None, 1), (7, "", 2), (7, "", 2), (None, "a b c d e", 3), (9, "A b\tC d E", 4), (None, "zz yy", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.classes(df).collect())
    both, lone = (f"{plain_fingerprint(t):016x}" for t in ("a b c d e", "zz yy"))
    zero = "0" * 16
    assert got == sorted([(5, zero, 5), (7, zero, 5), (7, zero, 5), (0, both, 9), (9, both, 9), (0, lone, None)],
                         key=lambda x: (x[0], x[1]))
    assert simhash.classes(df.where(F.lit(False))).count() == 0

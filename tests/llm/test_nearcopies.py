import random
from itertools import combinations

from billsift.llm import nearcopies, simhash
import corpus_pipeline as pipeline


def plain_set(text):
    words = [w for w in (text or "").encode().lower().split()]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def plain_tops(texts):
    """Smallest place reachable over pairs of Jaccard 0.8 or more, by comparing all pairs."""
    own, sets = list(range(len(texts))), [plain_set(t) for t in texts]

    def top(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            own[b] = a
    return [top(i) for i in range(len(texts))]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")


def survivors(spark, texts):
    return sorted(r.doc_id for r in pipeline.drop_near_copies(spark, frame(spark, texts), "").collect())


def test_stage_on_a_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    tops = plain_tops([r.text for r in rows])
    got = pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(got) == [r for i, r in enumerate(rows) if tops[i] == i]


def test_groups_chains_and_common_passages(spark):
    rng = random.Random(3)

    def words(n):
        return [f"w{rng.getrandbits(24)}" for _ in range(n)]

    texts = ["", None, " \t", "a b", "A  b", "a b c", "A b c d e f", "a b c d e f"]
    for share in (0.5, 0.7, 0.75, 0.8, 0.85, 0.9):  # pairs on both sides of the bound
        for _ in range(12):
            base = words(150)
            texts += [" ".join(base), " ".join(base[:int(150 * share)] + words(int(150 * (1 - share))))]
    base = words(200)
    for _ in range(60):  # a group of near copies in large cells
        own = list(base)
        own[rng.randrange(200)] = "x%d" % rng.getrandbits(30)
        texts.append(" ".join(own))
    chain = words(120)
    for i in range(40):  # each text only near its neighbours
        texts.append(" ".join(chain))
        chain = chain[6:] + words(6)
    passage = words(120)
    for _ in range(40):  # large cells whose members are not near copies, but for pairs of them
        own = passage + words(60)
        texts += [" ".join(own), " ".join(own[:-4] + words(4))]
    rng.shuffle(texts)
    tops = plain_tops(texts)
    assert survivors(spark, texts) == [i for i, t in enumerate(tops) if t == i]


def test_rows_are_chosen_not_ids(spark):
    def text(letter):
        return " ".join(f"{letter}{i}" for i in range(30))

    a, b, c, d = map(text, "abcd")
    rows = [(5, a), (5, b), (2, b), (None, b), (None, c), (None, c), (None, c + " end"), (7, d), (7, d), (None, d)]
    rows += [(9, text(f"z{n}.")) for n in range(20)]  # an id that many texts share
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 7):
        got = [(r.doc_id, r.text) for r in pipeline.drop_near_copies(spark, docs.repartition(parts), "").collect()]
        assert [g for g in got if g[0] is None] in ([(None, c)], [(None, c + " end")])
        assert sorted(g for g in got if g[0] is not None) == sorted([(5, a), (2, b), (7, d)] + rows[10:])


def members(spark, sets):
    return spark.createDataFrame([(i, i, sorted(s)) for i, s in enumerate(sets)], "node long, root long, s array<long>")


def test_rare_pairs_hold_all_that_are_alike(spark):
    rng = random.Random(5)
    sets = [{1}, {1}, {1, 2}, set(range(100, 105)), set(range(100, 104)), set(range(100, 106))]
    for size in (4, 5, 9, 10, 37, 100):
        for _ in range(8):
            base = {rng.randrange(300) for _ in range(size)}
            sets += [base, base | {rng.randrange(300)}, set(list(base)[size // 8:]) | {rng.getrandbits(40)}]
    got = {(r.a, r.b) for r in nearcopies.rare_pairs(members(spark, sets)).collect()}
    want = {(j, i) for i, j in combinations(range(len(sets)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(want) > 50
    assert want <= got
    one = members(spark, sets).selectExpr("node", "0L root", "s")
    assert nearcopies.rare_pairs(one).isEmpty()
    assert nearcopies.rare_pairs(one.limit(0)).isEmpty()


def test_pairs_of_texts_with_half_their_words_in_common(spark):
    rng = random.Random(6)
    passage = [rng.getrandbits(60) for _ in range(100)]
    for n in (200, 400):
        sets = [set(passage) | {rng.getrandbits(60) for _ in range(100)} for _ in range(n)]
        sets += [set(list(s)[5:]) | {rng.getrandbits(60) for _ in range(5)} for s in sets[:n // 4]]
        got = {(r.a, r.b) for r in nearcopies.rare_pairs(members(spark, sets)).collect()}
        assert {(n + i, i) for i in range(n // 4)} <= got
        assert len(got) <= len(sets)  # and not its square


def test_pairs_of_texts_with_most_of_their_words_in_common(spark):
    rng = random.Random(7)
    passage = [rng.getrandbits(60) for _ in range(170)]  # 85 percent
    sets = [set(passage) | {rng.getrandbits(60) for _ in range(30)} for _ in range(300)]
    sets += [set(list(s)[5:]) | {rng.getrandbits(60) for _ in range(5)} for s in sets[:60]]
    got = {(r.a, r.b) for r in nearcopies.rare_pairs(members(spark, sets)).collect()}
    assert {(300 + i, i) for i in range(60)} <= got
    assert len(got) <= len(sets)


def test_large_groups_are_joined_by_turns_of_leaders(spark, monkeypatch):
    rng = random.Random(8)

    def words(n):
        return [f"w{rng.getrandbits(24)}" for _ in range(n)]

    base, texts = words(300), []
    for _ in range(400):  # alike to many of the others, not to all
        own = list(base)
        for at in rng.sample(range(300), rng.randint(2, 4)):
            own[at] = "x%d" % rng.getrandbits(30)
        texts.append(" ".join(own))
    texts += [" ".join(words(100)) for _ in range(50)]
    compared = []
    rare = nearcopies.rare_pairs
    monkeypatch.setattr(nearcopies, "rare_pairs", lambda m: compared.append(rare(m).count()) or rare(m))
    tops = plain_tops(texts)
    assert survivors(spark, texts) == [i for i, t in enumerate(tops) if t == i]
    assert sum(compared) <= 20 * len(texts)


def test_simhash_classes_are_held_against_each_other(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.getrandbits(24)}" for _ in range(4000)]
    texts = [" ".join(base[:i] + ["x"] + base[i + 1:]) for i in range(0, 40, 4)]
    texts += [" ".join(f"w{rng.getrandbits(24)}" for _ in range(50)) for _ in range(20)] + ["", " ", texts[0]]
    prints = [simhash.fingerprint(t) for t in texts]
    tops = list(range(len(texts)))
    for _ in texts:
        tops = [min(tops[j] for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 2 or i == j)
                for i in range(len(texts))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    nodes = {r.text: r._node for r in nearcopies.named(df, "text").collect()}
    pairs = nearcopies.simhash_pairs(df).collect()
    classes = {}
    for text, top in zip(texts, tops):
        classes.setdefault(top, set()).add(nodes[text])
    assert {(r.a, r.b) for r in pairs} == {(n, min(c)) for c in classes.values() for n in c if n != min(c)}
    assert len(pairs) >= 5 and nearcopies.simhash_pairs(df.limit(0)).isEmpty()

    asked, found = [], nearcopies.simhash_pairs
    monkeypatch.setattr(nearcopies, "simhash_pairs", lambda *a: asked.append(1) or found(*a))
    tops = plain_tops(texts)
    assert survivors(spark, texts) == [i for i, t in enumerate(tops) if t == i] and asked

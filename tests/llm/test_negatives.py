import numpy as np
import pytest

from billsift.llm import negatives
from billsift.llm.negatives import best, hilbert, mine, scores
from billsift.llm.queries import op12_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=3, every=50):
    """Every anchor against every row, in Python's own integers."""
    fine = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e], lab) for i, e, lab in rows
            if i is not None and lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for n, (a, e, lab) in enumerate(fine):
        if a % every:
            continue
        # ties beyond the id go by the row's place
        scored = sorted(((-sum(x * y for x, y in zip(e, f)), i, m, other)
                         for m, (i, f, other) in enumerate(fine) if m != n), key=lambda r: r[:3])
        for ps, p, _, _ in [r for r in scored if r[3] == lab][:positives]:
            near = [(i, -s) for s, i, _, other in scored if other != lab and -50 * ps <= -100 * s <= -95 * ps]
            out += [(a, p, k + 1, i, -ps, s) for k, (i, s) in enumerate(near[:negatives])]
    return sorted(out)


def mined(spark, rows, **options):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, mine(df, F.col("vec_id") % 50 == 0, **options).collect()))


def vectors(n, seed, spread=1.0, width=16, centres=4, copies=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, width))
    own = rng.integers(0, centres, n)
    e = middle[own] * (1 - spread) + rng.normal(size=(n, width)) * spread
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    e[n - copies:] = e[0]
    return [(int(i), [float(x) for x in v], int(lab)) for i, v, lab in zip(
        rng.permutation(n), e.astype("f4"), rng.integers(0, 4, n))]


@pytest.mark.parametrize("spread, copies", [(1.0, 0), (0.2, 0), (0.5, 400)])
def test_against_every_row(spark, monkeypatch, spread, copies):
    rows = vectors(1500, 3, spread, copies=copies)
    want = brute(rows)
    assert mined(spark, rows) == want and len(want) > 20


def test_zone_maps_leave_blocks_out_and_lose_nothing():
    import pyarrow as pa
    rng = np.random.default_rng(4)
    rows = np.floor(256 * rng.normal(size=(4000, 4)))
    key = hilbert(np.clip((rows + 700) / 1400 * 127, 0, 127), 7)
    rows = rows[np.argsort(key)]
    blocks = [rows[i:i + 50] for i in range(0, 4000, 50)]
    zones = pa.table({"least": [i * 50 for i in range(80)], "labels": [["x"]] * 80,
                      "low": [b.min(axis=0).tolist() for b in blocks], "high": [b.max(axis=0).tolist() for b in blocks]})
    asked, lost = 0, 0
    for i in range(0, 4000, 97):
        found = scores(rows[i:i + 1], rows)[0]
        worst = int(np.sort(found)[-6])
        windows = [{"w": 0, "lo": -negatives.MOST, "hi": negatives.MOST, "score": worst, "id": 4000}]
        targets = pa.table({"vec": [rows[i].tobytes()], "label": ["x"], "windows": [windows]})
        need = negatives.wanted(targets, zones, True)[0]
        asked += need.sum()
        lost += sum(not need[j // 50] for j in np.flatnonzero(found >= worst))
    assert lost == 0 and asked < 0.4 * 80 * 42


def test_curve_steps_to_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    order = np.argsort(hilbert(grid, 3))
    assert sorted(hilbert(grid, 3)) == list(range(512))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_exact_scores_of_huge_components():
    a, b = np.array([[2.0 ** 30, 1.0]]), np.array([[2.0 ** 30, 1.0], [2.0 ** 30, 2.0], [2.0 ** 40, 0.0], [-2.0 ** 40, 0]])
    assert scores(a, b).tolist() == [[2 ** 60 + 1, 2 ** 60 + 2, 1 << 62, -(1 << 62)]]
    assert best(np.array([3, 5, 5, 1, 5]), np.array([0, 9, 2, 1, 4]), 2).tolist() == [2, 4]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = vectors(300, 6)
    bad = [(None, good[0][1], 1), (1000, None, 1), (1050, [0.1] * 16, None), (1001, [nan] * 16, 1),
           (1002, [inf] * 16, 2), (1003, [None] * 16, 2), (1100, [], 3), (1150, [0.0] * 16, 3), (1200, [0.5], 0)]
    assert mined(spark, good + bad) == brute(good + bad)
    assert mined(spark, []) == []
    assert mined(spark, bad[:6]) == []
    assert mined(spark, [r for r in good if r[0] % 50]) == []


def test_repeated_rows_few_rows_and_negative_scores(spark):
    rows = vectors(40, 7, width=3)
    rows += [(0, [0.1, 0.2, 0.3], 1), (0, [0.1, 0.2, 0.3], 1), (50, [-1.0, 0.0, 0.0], 9), (51, [1.0, 0.0, 0.0], 9)]
    assert mined(spark, rows) == brute(rows)


def test_other_names(spark):
    from pyspark.sql import functions as F
    rows = vectors(200, 9)
    df = spark.createDataFrame(rows, "`a.id` long, vec array<double>, kind int").selectExpr(
        "*", "1 as uid", "'x' as block", "2 as chunk", "3 as data")
    got = mine(df, F.col("`a.id`") % 50 == 0, vec_id="a.id", vector="vec", label="kind")
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_query(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    moved = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in rows]
    got = op12_negatives(spark, small)
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
                                "positive_score": "bigint", "negative_score": "bigint"}
    assert sorted(map(tuple, got.collect())) == brute(moved)

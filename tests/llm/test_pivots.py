import numpy as np
import pytest

from billsift.llm import pivots
from billsift.llm.queries import op6_pivots


def brute(rows, least=0.95):
    """id -> (links, smallest id reachable) over all pairs."""
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], "f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= least
    np.fill_diagonal(links, False)
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(ids)).min(axis=1))
        if (new == label).all():
            break
        label = new
    low = {r: min(i for i, l in zip(ids, label) if l == r) for r in set(label.tolist())}
    return {i: (int(links[n].sum()), low[int(label[n])]) for n, i in enumerate(ids)}


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(11)
    rows = []
    for size in [1] * 300 + [2] * 40 + [3] * 20 + [40] * 2 + [700]:
        centre = rng.normal(size=64)
        for _ in range(size):
            rows.append((len(rows), (centre + 0.1 * rng.normal(size=64)).astype("f4").tolist()))
    rows += [(5000 + i, rows[3][1]) for i in range(5)]
    return rows


def test_recall_and_counts(spark, clusters):
    want = brute(clusters)
    got = {r.vec_id: r for r in pivots.link(spark.createDataFrame(
        clusters, "vec_id long, embedding array<float>")).collect()}
    assert set(got) == set(want)
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    right = sum(got[i].component_id == c for i, (_, c) in want.items())
    assert right >= 0.98 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_query_on_whole_table(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in op6_pivots(spark, small).collect()}
    assert got == want


def test_table_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, None, 1), (5, [0.0, 0.0], 1),
            (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [], 1), (None, [1.0, 0.0], 1),
            (10, [1.0, 0.0, 0.0], 1), (11, [0.0, 1e-30], 1), (11, [0.0, 5.0], 1), (12, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in pivots.link(df).collect())
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (12, 3, 1, False)]
                         + [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10)]
                         + [(11, 1, 11, True), (11, 1, 11, True), (0, 0, None, False)])
    assert pivots.link(df.limit(0)).count() == 0


def shared_direction(n, strength, seed):
    """Vectors with a common direction; a fifth are near copies of others, down to the limit."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 64)) / 8
    v[:, 0] += strength
    m = n // 5
    v[n - m:] = v[rng.integers(0, n - m, m)] + rng.normal(size=(m, 64)) / 8 * rng.uniform(
        0, 0.32 * np.sqrt(1 + strength ** 2), (m, 1))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("strength", [1.0, 1.5])
def test_common_direction_is_no_comparison_of_all_pairs(spark, strength):
    v = shared_direction(4000, strength, 3)
    index = pivots.Index(v.tolist(), 0.95)
    assert len(index.pivots) == pivots.PIVOTS and index.middle.any()
    near = np.argsort(-(index.turned(v) @ index.pivots.T), axis=1)[:, :index.listed]
    lists = np.bincount((near[:, :, None] * pivots.PIVOTS + near[:, None, :])[:, ~np.eye(index.listed, dtype=bool)].ravel())
    assert (lists.astype(float) ** 2).sum() / 4 < 0.03 * 4000 ** 2 / 2
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    want = brute(rows)
    got = {r.vec_id: r.n_links for r in pivots.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] <= n for i, (n, _) in want.items())
    assert sum(got.values()) >= 0.95 * sum(n for n, _ in want.values()) > 300


def test_direction_too_strong_to_take_off_stays(spark):
    v = shared_direction(600, 3.0, 4)
    assert not pivots.Index(v.tolist(), 0.95).middle.any()
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    want = brute(rows)
    got = {r.vec_id: r.n_links for r in pivots.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got.values()) >= 0.99 * sum(n for n, _ in want.values())

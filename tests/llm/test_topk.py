import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewright.llm.topk import LEAST, MOST, cover_tree, dual_search, saturated, top_k


def clusters(rng, n, d, spread=8):
    centers = rng.integers(-200, 200, (6, d))
    return centers[rng.integers(0, 6, n)] + rng.integers(-spread, spread + 1, (n, d))


def brute(q, x, k):
    s = q @ x.T
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), s.shape), -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), order


def test_cover_tree_covers_every_point_once():
    x = clusters(np.random.default_rng(0), 900, 5).astype(float)
    todo, seen = [cover_tree(x, 20)], []
    while todo:
        n = todo.pop()
        assert np.linalg.norm(x[n.points] - n.center, axis=1).max() <= n.radius + 1e-9
        if n.children:
            assert sorted(np.concatenate([c.points for c in n.children])) == sorted(n.points)
            todo += n.children
        else:
            seen += n.points.tolist()
    assert sorted(seen) == list(range(900))


@pytest.mark.parametrize(("n", "m", "d", "k"), [(1, 1, 3, 5), (4, 3, 2, 5), (700, 40, 6, 5), (3000, 100, 3, 6), (500, 33, 40, 5)])
def test_dual_search_equals_brute_force(n, m, d, k):
    rng = np.random.default_rng(n)
    x, q = clusters(rng, n, d), clusters(rng, m, d)
    s, i, scored = dual_search(q, x, k)
    bs, bi = brute(q, x, k)
    assert (s[:, : bs.shape[1]] == bs).all() and (i[:, : bi.shape[1]] == bi).all() and (i[:, bi.shape[1] :] == -1).all()
    if n == 3000:
        assert scored < n * m / 2  # node pairs are pruned


def test_large_components_stay_exact():
    x = np.array([[2**27, 3], [2**27, 4], [-(2**27), 5]])
    s, i, _ = dual_search(x[:1], x, 2)
    assert s[0].tolist() == [2**54 + 12, 2**54 + 9] and i[0].tolist() == [1, 0]
    with pytest.raises(OverflowError):
        dual_search(x[:1] * 2**30, x, 1)


def test_query_with_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(0, 0.3, 4).astype(np.float32)], "s") for i in range(200)]
    rows += [(200 + i, rows[7][1], "copy") for i in range(60)]
    rows += [(300, None, ""), (301, [1.0, None, 0.0, 0.0], ""), (302, [float("nan")] * 4, ""), (350, [float("inf"), 0.0, 0.0, 0.0], ""), (None, rows[0][1], ""), (400, [1.0, 2.0], ""), (401, [0.5, -2.0], ""), (450, [], "")]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    got = {}
    for r in top_k(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    good = {(i, tuple(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int))) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = {}
    for q, v in good:
        if q % 50 == 0:
            copies = [(i, w) for i, w in good for _ in range(1 + (i is not None and i in (1, 2)))]
            best = sorted((-int(np.dot(v, w)), i) for i, w in copies if i != q and len(w) == len(v))[:5]
            if best:
                want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want
    assert top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_components_of_any_size(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 3)]) for i in range(60)]
    rows += [(100, [1e300, 1.0, -2.0]), (101, [-1e300, 0.0, 1.0]), (102, [1.7e308, -1.7e308, 1.7e308]), (103, [3e8, -3e8, 5.0]), (104, [3e8, -3e8, 5.0]), (150, [1e17, 1e16, 0.0]), (151, [2.0**55, 1.0, 0.5])]
    whole = {i: [int(np.floor(256.0 * x)) if abs(x) < 1e300 else int(x) * 256 for x in v] for i, v in rows}
    got = {}
    for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    want = {}
    for q in (0, 50, 100, 150):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        want[q] = [(i, max(LEAST, min(MOST, -s))) for s, i in best]
    assert got == want


def test_order_of_scores_beyond_64_bits():
    scores = sorted([0, 5, -7, MOST - 1, MOST, MOST + 1, 2**64, 2**200, 2**200 + 1, LEAST + 1, LEAST, LEAST - 1, -(2**64), -(2**200)])
    assert sorted(scores, key=saturated) == scores

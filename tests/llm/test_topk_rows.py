"""Top-k where one id has different vectors, and where scores need exact integers."""

import math

import numpy as np

from gustline.llm import topk


def brute(rows, k, every):
    rows = sorted({(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows})
    out = []
    for q in {i for i, _ in rows if i % every == 0}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for i, v in rows if i == q for j, w in rows if j != q)
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_an_id_with_different_vectors_keeps_each(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 40, np.round(rng.normal(size=3), 1).tolist()) for i in range(160)] + [(0, [9.0, 9.0, 9.0]), (0, [9.5, 9.0, 9.0]), (10, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, query_every=10).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 10)


def test_wide_integers_use_the_trees(spark, monkeypatch):
    rng = np.random.default_rng(6)
    q, c = (rng.integers(-(2**29), 2**29, size=(n, 3)) for n in (60, 900))
    c[:300] = c[0] + rng.integers(-3, 4, size=(300, 3))  # scores that float64 can't tell apart
    search = topk.DualSearch(q, c, [np.array([i]) for i in range(len(c))], 4, object)
    seen = []
    leaves = topk.DualSearch.leaves
    monkeypatch.setattr(topk.DualSearch, "leaves", lambda self, a, b: (seen.append(len(a.points) * len(b.points)), leaves(self, a, b)))
    search.run()
    for row, v in enumerate(q.tolist()):
        want = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in enumerate(c.tolist()))[:4]
        assert [(-s, i) for s, i in zip(search.score[row], search.id[row])] == want
    assert sum(seen) < len(q) * len(c)


def test_components_of_any_size(spark):
    rows = [(i, v) for i, v in enumerate([[2e8, 1.0], [3e8, -1.0], [1e30, 2.0], [1e30, 2.5], [-1e300, 1.5e308], [1.7e308, 1.7e308], [5e-324, -0.0], [0.5, 0.25], [-3e8, 7.0], [2.0**45, 2.0**45 - 1 / 256]])]
    rows += [(20, v) for v in ([1e30, 2.0], [4.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, query_every=1, k=4).collect())
    from fractions import Fraction

    whole = {(i, tuple(math.floor(Fraction(x) * 256) for x in v)) for i, v in rows}
    want = []
    for q in {i for i, _ in rows}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for i, v in whole if i == q for j, w in whole if j != q)
        want += [(q, n + 1, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(scores[:4])]
    assert got == sorted(want)


def test_sort_keys():
    values = [-(10**40), -(2**63) - 1, -(2**63), -5, -1, 0, 1, 2**62, 2**63 - 1, 2**63, 2**70, 10**40, -(256**9), -(256**9) - 1, -(256**9) + 1]
    assert sorted(values, key=topk.sort_key) == sorted(values)


def test_far_blocks_are_not_searched(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=8) * 0.05 + 10 * np.eye(8)[i % 8] * (1 + i % 3)).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    centers = topk.top_centers(df.selectExpr("embedding AS vec"))
    assert len(centers) == 16
    blocks = {b: (1.0, 1) for b in range(len(centers))}
    import pyarrow as pa

    asked = pa.RecordBatch.from_pylist([{"dim": 8, "block": 0, "set": 0, "far": 1.0, "worst": 65536.0 * float(centers[0] @ centers[0]) * 0.8}])
    reached = next(topk._in_reach(centers, blocks)(iter([asked])))
    assert reached.num_rows < 8
    got = topk.top_k(df, query_every=10).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 10)

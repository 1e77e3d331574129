import math

import numpy as np
import pytest

from gustline.llm import neardup, topk

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, rep int"


def frame(spark, rows):
    floats = lambda v: v if v is None else [x if x is None else float(x) for x in v]
    return spark.createDataFrame([(i, floats(v), 0, 1) for i, v in rows], SCHEMA)


def brute_groups(rows):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, label = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    pairs = [(a, b) for k, (a, x) in enumerate(good) for b, y in good[k + 1 :] if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (links[i], label[i], label[i] == i) for i in links}


def test_groups_odd_rows(spark):
    rows = [(1, [1.0, 0, 0]), (7, [1.0, 0, 0]), (3, [2.0, 0.1, 0]), (4, None), (5, [0.0, 0, 0]), (6, [NAN, 1, 0]), (8, [INF, 1, 0]), (9, [None, 1.0, 0]), (10, []), (11, [0, 1e-30, 0]), (12, [0, 1e30, 0]), (13, [1.0, 0]), (14, [-1.0, 0, 0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.embedding_groups(frame(spark, rows)).collect()}
    assert got == brute_groups(rows)
    repeated = neardup.embedding_groups(frame(spark, [(1, [1.0, 0]), (1, [1.0, 0]), (None, [1.0, 0])])).collect()
    assert sorted((str(r.vec_id), r.n_links, r.kept) for r in repeated) == [("1", 1, True), ("1", 1, True), ("None", 0, False)]
    assert neardup.embedding_groups(frame(spark, [])).count() == 0
    assert neardup.embedding_groups(frame(spark, [(1, None)])).collect()[0].component_id == 1


def test_large_leaf_in_blocks_and_a_hot_group(spark, monkeypatch):
    rng = np.random.default_rng(0)
    center = rng.normal(size=16)
    rows = [(i, (center + rng.normal(size=16) * (0.25 if i < 200 else 3)).tolist()) for i in range(400)]
    monkeypatch.setattr(neardup, "LEAF_BLOCK", 40)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.embedding_groups(frame(spark, rows)).collect()}
    want = brute_groups(rows)
    assert sum(v[0] for v in got.values()) >= 0.97 * sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.normal(size=a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    c = rng.uniform(0.901, 0.93, (3000, 1))
    x = np.vstack([a, c * a + np.sqrt(1 - c * c) * o])
    got = neardup.embedding_groups(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])).where("n_links > 0").count()
    assert got >= 0.97 * len(x)


def test_check_table_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = df.toPandas()
    want = brute_groups(list(zip(x.vec_id, [list(map(float, v)) for v in x.embedding])))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.embedding_groups(df).collect()}
    assert got == want


def brute_top(rows, k, every):
    good = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in good:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def top(spark, rows, k=5, every=50):
    out = topk.top_k(frame(spark, rows), k=k, query_every=every).select("query_id", "rank", "vec_id", "score")
    return sorted(map(tuple, out.collect()))


def test_top_k_with_ties_copies_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, np.round(rng.normal(size=4), 1).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)] + [(2000, None), (2050, [NAN, 0, 0, 0]), (2100, [INF, 0, 0, 0]), (2150, [None, 0.0, 0, 0]), (2200, [0.0, 0, 0, 0]), (2250, [1.0, 2.0]), (2300, []), (None, [1.0, 0, 0, 0]), (rows[5][0], rows[5][1])]
    assert top(spark, rows) == brute_top(rows, 5, 50)
    assert top(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert top(spark, []) == []


def test_top_k_in_many_blocks_and_with_wide_integers(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * (1 + i % 3)).tolist()) for i in range(500)]
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    assert top(spark, rows, every=10) == brute_top(rows, 5, 10)
    wide = [(i, [float(2**20 + i), float(2**18)]) for i in range(120)]
    assert top(spark, wide) == brute_top(wide, 5, 50)


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 8))
    stack = [topk.cover_tree(x)]

    def below(n):
        return [n.points] if n.points is not None else [p for c in n.children for p in below(c)]

    other = topk.cover_tree(rng.normal(size=(1, 8)) + 2)
    while stack:
        n = stack.pop()
        points = np.concatenate(below(n))
        assert (np.linalg.norm(x[points] - n.center, axis=1) <= n.radius + 1e-9).all()
        assert (x[points] @ other.center).max() <= topk.bound(n, other)
        stack += n.children


@pytest.mark.parametrize("table", ["sf0.1"])
def test_top_k_of_a_table(spark, table):
    x = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    p = x.toPandas()
    rows = list(zip(p.vec_id, [list(map(float, v)) for v in p.embedding]))
    got = sorted(map(tuple, topk.top_k(x).select("query_id", "rank", "vec_id", "score").collect()))
    v = np.floor(np.array([r[1] for r in rows]) * 256).astype(np.int64)
    want = []
    for q in range(0, len(rows), 50):
        s = v @ v[q]
        order = [i for i in sorted(range(len(rows)), key=lambda i: (-s[i], i)) if i != q][:5]
        want += [(q, n + 1, i, int(s[i])) for n, i in enumerate(order)]
    assert got == sorted(want)

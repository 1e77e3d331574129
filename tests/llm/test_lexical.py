import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gustline.llm import lexical


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in {*items}:
        scores = []
        for i, c, size in counted:
            m = 10 + 90 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in {*terms(text)} if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r, None if nameless else i, -s) for r, (s, nameless, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def got(spark, docs, items, **options):
    a = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, rank long").withColumn("a.b", F.lit(1))
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score long")
    return sorted(map(tuple, lexical.rank_documents(a.repartition(3), b, **options).collect()), key=repr)


def made(seed, docs=300, words=60):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % words}"
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(docs)]
    return texts, [(i, " ".join(word() for _ in range(rng.randint(0, 15)))) for i in range(12)]


ODD = [(1, "One ONE Éé 42"), (2, None), (3, ""), (4, "... !"), (None, "one two"), (None, "one two"), (5, "one two"), (5, "one two"), (6, "two three one"), (7, "éé one " * 300_000), (8, "Éé")]


def test_odd_rows_against_brute_force(spark):
    items = [(1, "one Éé"), (1, "two"), (2, None), (3, "  "), (4, "unknown"), (None, "two three"), (5, "one two"), (5, "one two")]
    want = brute(ODD, items)
    assert got(spark, ODD, items) == want and len(want) > 20
    assert got(spark, ODD, items, k=2) == brute(ODD, items, 2)
    assert got(spark, [], items) == [] and got(spark, ODD, []) == [] and got(spark, ODD, [(1, "zzz")]) == []


@pytest.mark.parametrize("seed", [0, 1])
def test_small_nodes_against_brute_force(seed, monkeypatch):
    """The search alone, with treaps of many nodes and over several batches, and documents in the order of their impact too."""
    monkeypatch.setattr(lexical, "NODE", 2)
    monkeypatch.setattr(lexical, "LEAF", 4)
    monkeypatch.setattr(lexical, "HELD", 900)
    docs, items = made(seed)
    if seed:
        docs = [(i, t) for i, (_, t) in enumerate(sorted(docs, key=lambda d: len(d[1])))]
    own = [({*terms(t)}) for _, t in items]
    vocabulary = sorted(set.union(*own))

    class Held:
        def __init__(self, value):
            self.value = value

    batches = pa.table({"id": [i for i, _ in docs], "text": [t for _, t in docs]}).to_batches(max_chunksize=70)
    counted = [*lexical._count(Held(pa.array([t.encode() for t in vocabulary], pa.binary())))(batches)]
    n, total = sum(bool(terms(t)) for _, t in docs), sum(len(terms(t)) for _, t in docs)
    df = Counter(t for _, text in docs for t in {*terms(text)})
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) if df[t] else 0 for t in vocabulary])
    queries = [np.array([vocabulary.index(t) for t in q], np.int64) for q in own]
    found = pa.Table.from_batches(lexical._search(Held((queries, weight)), n, total, 10)(counted)).to_pylist()
    want = [(item, i, s) for item, _, i, s in brute(docs, items)]
    assert sorted((items[r["query"]][0], r["id"], r["score"]) for r in found) == sorted(want)


def test_treaps_are_heaps_and_prune(monkeypatch):
    monkeypatch.setattr(lexical, "NODE", 4)
    monkeypatch.setattr(lexical, "LEAF", 16)
    rng = np.random.default_rng(0)
    doc = np.concatenate([np.sort(rng.choice(4000, 1500, replace=False)) for _ in range(3)])
    term, share = np.repeat(np.arange(3), 1500), rng.integers(1, 1000, 4500)
    share[[100, 1600, 3100]] = 10**6
    treaps = lexical.Treaps(doc, term, share, 4000, 3)
    for x in range(len(treaps.impact) - 1):
        for below in (treaps.left[x], treaps.right[x]):
            assert treaps.impact[below] <= treaps.impact[x]
    scored = []
    monkeypatch.setattr(lexical.Treaps, "_score", lambda self, at, count, *rest, f=lexical.Treaps._score: (scored.append(int(count.sum())), f(self, at, count, *rest)))
    best = lexical.Best(1)
    treaps.search(np.arange(3), np.ones(3, np.int64), best, np.zeros(4000, bool), np.arange(4000))
    want = np.bincount(doc, share)
    assert (best.scores[0], best.ids[0]) == (want.max(), want.argmax())
    assert sum(scored) < 450  # of 4,500 postings


def test_queries_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PASS_TERMS", 120)
    docs, items = made(3, docs=80)
    assert got(spark, docs, items[:9]) == brute(docs, items[:9])

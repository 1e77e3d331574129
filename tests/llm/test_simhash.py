import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gustline.llm import simhash
from gustline.llm.components import connected_components


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(ids, fps, bits=4):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in zip(ids, fps):
        for b, y in zip(ids, fps):
            if bin(x ^ y).count("1") <= bits:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \n\tÉ\x85z", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("one two thrée four",)], "s string").select(F.xxhash64("s")).first()
    assert row[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest("one two thrée four".encode(), 42)


def test_trie_links_are_all_and_only_those_within_the_budget():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 7)).astype(np.uint64), initial=np.uint64(0)) for _ in range(400)])
    values = np.unique(base[rng.integers(0, 40, 400)] ^ flips)
    found = set()
    for i, j in simhash.trie_links(values, np.zeros(len(values), np.int64), 0, 4):
        found |= {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if bin(int(values[a]) ^ int(values[b])).count("1") <= 4}
    assert found == want and want


def test_hamming_links_with_hot_buckets(spark):
    rng = np.random.default_rng(1)
    fps = np.unique(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (300, 3)).astype(np.uint64), axis=1)).view(np.int64)
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    labels = {r.node: r.label for r in connected_components(simhash.hamming_links(df, 4, block=32)).collect()}
    want = classes([int(f) for f in fps], [int(f) & (1 << 64) - 1 for f in fps])
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups({f: labels.get(f, f) for f in want}) == groups(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 50), (50, 200), (7, 7), (None, 3)] + [(1000, 1000 + i) for i in range(1, 40)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 100: 50, 50: 50, 200: 50, **{1000 + i: 1000 for i in range(40)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_groups_against_brute_force_and_odd_rows(spark):
    long = "word " * 30_000
    rows = [(5, "a b c d e f g", 1), (3, "A b C d e f g", 2), (9, "x y z", 3), (1, "", 4), (2, None, 5), (8, "x y z", 6), (8, "x y z", 6), (None, "x y z", 7), (11, long, 8), (12, long + "end", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")  # fp: a name that is used inside, too
    got = simhash.simhash_groups(df).toPandas()
    fps = {i: plain_fingerprint(t or "") for i, t, _ in rows if i is not None}
    want = classes(list(fps), list(fps.values()))
    known = got[got.doc_id.notna()]
    assert len(got) == len(rows)
    assert dict(zip(known.doc_id.astype(int), known.component_id)) == want
    assert dict(zip(known.doc_id.astype(int), known.fingerprint)) == {i: f"{f:016x}" for i, f in fps.items()}
    assert got[got.doc_id.isna()].component_id.tolist() == [8] and not got[got.doc_id.isna()].kept.any()
    assert simhash.simhash_groups(df.where("doc_id < 0")).count() == 0


def test_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs, got = df.toPandas(), simhash.simhash_groups(df).toPandas()
    want = classes(docs.doc_id.tolist(), [plain_fingerprint(t) for t in docs.text])
    assert dict(zip(got.doc_id, got.component_id)) == want
    assert isinstance(got, pd.DataFrame)


def test_cells_are_joined_a_few_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    values = np.unique(np.r_[base, near]).view(np.int64)
    table = pa.table({"band": np.zeros(len(values), np.int32), "cell": np.sort(rng.integers(0, 40, len(values))), "fp": values})
    plan = simhash.tries(4, 10, 2048)[:1]
    plan = [(plan[0][0], 0)]
    links = lambda: sorted((a, b) for x in simhash._trie_join(4, plan)(table.to_batches(max_chunksize=7)) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist()))
    whole = links()
    monkeypatch.setattr(simhash, "HELD_ROWS", 20)
    assert links() == whole

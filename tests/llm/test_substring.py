import random

import pytest

from gustline.llm import substring


def brute(rows, window):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - window + 1):
            key = b" ".join(words[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if i is not None and first[b" ".join(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out, key=str)


def run(spark, rows, window):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, anchor string")
    return sorted(((r.doc_id, r.n_words, r.n_removed, b" ".join((r.text or "").encode().split()).decode()) for r in substring.substring_dedup(df, window=window).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_random_copies(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "日本", "a.b"]
    docs = []
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            if docs:
                source = rng.choice(docs)[1].split()
                a = rng.randint(0, max(len(source) - 1, 0))
                at = rng.randint(0, len(words))
                words[at:at] = source[a : a + rng.randint(5, 80)]
        docs.append((rng.randint(0, 10_000), rng.choice([" ", "\n", " \t "]).join(words)))
    assert run(spark, docs, 20) == brute(docs, 20)


def test_windows_across_factors_and_second_sources(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [
        (1, " ".join(a)),
        (2, " ".join(b)),
        (3, " ".join(a[-15:] + b[:15])),  # the window across the seam is new here
        (4, " ".join(a[-15:] + b[:15])),  # and a repeat there
        (5, " ".join(a[20:40] + ["x"] + a[20:40])),
        (6, " ".join(a[:19])),
        (7, " ".join(["same"] * 100)),
        (8, " ".join(["same"] * 60)),
    ]
    assert run(spark, rows, 20) == brute(rows, 20)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None), (4, ""), (5, " \n "), (6, "w " * 40_000), (7, "w " * 30_000)]
    got = run(spark, rows, 50)
    want = brute(rows, 50)
    assert got == want
    assert run(spark, [], 50) == []
    with pytest.raises(ValueError):
        run(spark, rows, 5)


def test_longest_match_takes_the_best_place():
    import numpy as np

    reference = np.array([1, 2, 3, 9, 1, 2, 3, 4, 5, 6], np.uint64)
    words = np.array([1, 2, 3, 4, 5, 7], np.uint64)
    assert substring._longest(words, 0, reference, np.array([0, 4])) == 5


def test_carried_columns(spark):
    df = spark.createDataFrame([(1, "a b", "src", None)], "doc_id long, text string, source string, key int")
    row = substring.substring_dedup(df, carry=["source", "key"]).first()
    assert (row.rest.source, row.rest.key, row.text) == ("src", None, "a b")


def test_bytes_around_what_goes_stay(spark):
    odd = "line one\n    indented line\n\nlast \u3000 é "
    passage = "\n".join(f"w{i}" for i in range(60))
    rows = [(1, odd), (2, f"head\t{passage}  \n tail\n"), (3, f"\tother \n{passage}\nend  here\n\n"), (4, None), (5, f" {passage}\n "), (3, f"x {passage}"), (3, "x  y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in substring.substring_dedup(df).collect()), key=repr)
    assert got == sorted([(1, odd), (2, rows[1][1]), (3, "\tother \nend  here\n\n"), (4, None), (5, " \n "), (3, "x "), (3, "x  y")], key=repr)


def test_factors_give_nearly_all_and_boundaries_the_rest():
    import numpy as np

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 1 << 60, 300).astype(np.uint64), rng.integers(0, 1 << 60, 300).astype(np.uint64)
    seam = np.concatenate([a[100:200], b[40:140]])
    reference = substring.reference_text([a, b, np.concatenate([a[170:200], b[40:70]])])
    covered = np.zeros(200, bool)
    for s, e in substring.duplicate_spans(seam, reference, 50):
        covered[s:e] = True
    assert covered.all()
    assert substring.duplicate_spans(seam, substring.reference_text([a[:120]]), 50) == []

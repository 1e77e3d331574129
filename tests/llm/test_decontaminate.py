import random
import re

import pytest
from pyspark.sql import functions as F

from gustline.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, window=10):
    owners = {}
    for item, text in items:
        own = words(text)
        k = min(window, len(own))
        for s in range(len(own) - k + 1 if k else 0):
            owners.setdefault(tuple(own[s : s + k]), set()).add(item)
    out = []
    for doc, text in docs:
        own, hit, who = words(text), set(), set()
        for k in {len(w) for w in owners}:
            for s in range(len(own) - k + 1):
                if found := owners.get(tuple(own[s : s + k])):
                    hit |= {*range(s, s + k)}
                    who |= found
        out.append((doc, len(own), len(hit), len(who), sorted(str(i) for i in who if i is not None), bool(hit)))
    return sorted(out, key=repr)


def got(spark, docs, items, **options):
    a = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start long").withColumn("a.b", F.lit(1))
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    return sorted((tuple(list(x) if isinstance(x, list) else x for x in r) for r in D.contaminated(a, b, **options).collect()), key=repr)


PASSAGE = "One two THREE four-five six; seven eight nine ten eleven twelve"
ITEMS = [(1, PASSAGE), (2, "zwei Wörter"), (3, "Éclair"), (4, None), (5, "  ...  "), (6, PASSAGE), (None, "no name here at all"), (6, PASSAGE), (7, "a a a a a a a a a a a a")]
DOCS = [(1, "x " + PASSAGE.upper() + " y " + PASSAGE), (2, "two zwei wörter"), (2, "one row more"), (3, None), (4, ""), (5, "..."), (None, "No name, here AT all!"), (7, "éclair"), (8, "Éclair"), (9, "a " * 25), (1, "x " + PASSAGE.upper() + " y " + PASSAGE)]
DOCS += [(10, "one two three four five six seven eight nine"), (11, "éclairs a a a a a a a a a"), (12, "ten eleven twelve one two three four five six seven eight nine ten")]


def test_cases_against_brute_force(spark):
    want = brute(DOCS, ITEMS)
    assert got(spark, DOCS, ITEMS) == want
    assert sum(r[-1] for r in want) == 7
    for gram in (1, 2, 12):
        assert got(spark, DOCS, ITEMS, gram=gram) == want
    assert got(spark, DOCS, ITEMS, window=4) == brute(DOCS, ITEMS, 4)


@pytest.mark.parametrize("seed", [0, 1])
def test_few_words_against_brute_force(spark, seed):
    rng = random.Random(seed)
    text = lambda n: rng.choice(["", "."]) + " ".join(rng.choice("ab") for _ in range(n)) + rng.choice(["", "!"])
    items = [(i, text(rng.randint(0, 8))) for i in range(25)]
    docs = [(i, text(rng.randint(0, 40))) for i in range(120)]
    assert got(spark, docs, items, window=6) == brute(docs, items, 6)


def test_many_passes_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(D, "PASS_BYTES", 900)
    assert got(spark, DOCS, ITEMS) == brute(DOCS, ITEMS)


def test_empty_tables_and_long_texts(spark):
    assert got(spark, [], ITEMS) == []
    assert got(spark, DOCS, []) == brute(DOCS, [])
    long = [(1, "w " * 1_500_000 + PASSAGE), (2, "x" * 6_000_000 + " " + PASSAGE)]
    assert [r[:4] for r in got(spark, long, ITEMS)] == [(1, 1_500_012, 12, 2), (2, 13, 12, 2)]


def test_no_python_and_no_exchange_of_texts(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string").withColumns({"t1": F.lit(1).cast("long"), "t2": F.lit(1).cast("long")})
    windows, _ = D.item_windows(spark.createDataFrame(ITEMS, "item_id long, text string"), "item_id", "text", 10)
    plan = D.window_hits(docs, windows, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan

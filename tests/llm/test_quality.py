import zlib

import numpy as np
from pyspark.sql import functions as F

from gustline.llm import quality


def one_by_one(net, text):
    """The network's definition, position by position."""
    data = text.encode() + bytes(quality.WIDTH)
    length = len(text.encode())
    pooled = []
    for start in quality.chunk_starts(length):
        stop = max(min(start + quality.CHUNK, length) - quality.WIDTH, start) + 1
        z = [sum(net.taps[j, data[t + j]] for j in range(quality.WIDTH)) for t in range(start, stop)]
        pooled.append(np.maximum(np.max(z, axis=0) + net.bias, 0))
    x = np.mean(pooled, axis=0) @ net.mean + np.max(pooled, axis=0) @ net.most + net.shift
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def net():
    rng = np.random.default_rng(3)
    return quality.Network(rng.normal(0, 0.3, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), np.zeros(quality.FILTERS, np.float32), rng.normal(size=quality.FILTERS).astype(np.float32), rng.normal(size=quality.FILTERS).astype(np.float32), 0.1)


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 480, 481, 5000):
        starts = quality.chunk_starts(n)
        covered = np.zeros(n, bool)
        for s in starts:
            covered[s : s + quality.CHUNK] = True
        assert covered.all() and (n == 0 or starts[-1] < n)


def test_scores_against_the_definition(spark):
    texts = ["", None, "a", "abcdef", "word " * 200, "é" * 300, "x" * 256, "y" * 257, "z" * 10_000]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)] + [(None, "a", 0.1)], "doc_id long, text string, score double")
    got = quality.quality_scores(df, net()).toPandas()
    known = got[got.doc_id.notna()].set_index("doc_id")
    for i, t in enumerate(texts):
        assert abs(known.score[i] - one_by_one(net(), t or "")) < 1e-4
        assert known.held_out[i] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert len(got) == len(texts) + 1 and not got[got.doc_id.isna()].held_out.any()
    assert quality.quality_scores(df.where("false"), net()).count() == 0


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumn("label", F.lit("clash"))
    fitted = quality.fit(docs, labels)
    rows = quality.quality_scores(docs, fitted).join(labels, "doc_id").where("held_out").toPandas()
    assert ((rows.predicted == rows.quality).mean()) > 0.97
    wrong = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs, wrong)  # labels of held-out rows change nothing
    assert np.array_equal(again.taps, fitted.taps)


def test_no_labels_and_odd_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_scores(docs, quality.fit(docs, none)).toPandas().score.tolist() == [0.5, 0.5]
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 7), (99, 1), (1, 1), (1, 1)], "doc_id long, quality int")
    assert quality.quality_scores(docs, quality.fit(docs, odd)).count() == 2


def test_keep_good_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a", None, 3), (2, None, "s", None)], "doc_id long, text string, source string, n_chars long")
    out = quality.keep_good(df, quality.Network(net().taps * 0, net().bias, net().mean, net().most, 1.0))
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))


def test_whole_texts_are_learned_from_and_accuracy_holds_at_all_lengths(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_scores(docs, quality.fit(docs, labels)).join(labels, "doc_id").join(docs.select("doc_id", F.length("text").alias("size")), "doc_id").where("held_out").toPandas()
    right = rows.predicted == rows.quality
    for low, high in ((0, 500), (500, 2000), (2000, 20_000), (20_000, 1 << 40)):
        some = (rows["size"] >= low) & (rows["size"] < high)
        print(low, high, some.sum(), right[some].mean())
        assert right[some].mean() >= 0.97
    text = bytes(range(1, 256)) * 30
    assert {*quality.chunk_grid(text)[-1][:10]} != {0} and quality.chunk_grid(b"").shape == (1, quality.CHUNK)


def test_a_repeated_id_gives_one_network_in_any_order(spark):
    rows = [(i % 40, f"{'good text' if i % 2 else 'bad bad'} {i} " * (i % 5 + 1)) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    nets = [quality.fit(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 5))]
    assert np.array_equal(nets[0].taps, nets[1].taps)


def test_the_bound_is_on_rows_and_never_cuts_a_text(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda chunks, labels: seen.append([len(c) for c in chunks]))
    docs = spark.createDataFrame([(i, "x" * (100_000 if i == 4 else 5000)) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    quality.fit(docs, labels, sample_bytes=50_000)
    whole = len(quality.chunk_starts(5000))
    assert 4 <= len(seen[0]) <= 10 and {*seen[0]} == {whole}

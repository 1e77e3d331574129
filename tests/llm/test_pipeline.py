import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from gustline.llm import quality, queries, simhash  # noqa: E402
from gustline.llm.common import stored  # noqa: E402
from tests.llm.test_simhash import classes, plain_fingerprint  # noqa: E402
from tests.llm.test_substring import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    (_, good), (_, unique), (_, fresh), (_, packed) = corpus_pipeline.STAGES
    a = good(spark, docs, SF)
    net = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in quality.quality_scores(docs, net).where("predicted = 1").collect()}
    rows_a = a.toPandas()
    assert a.columns == columns and set(rows_a.doc_id) == kept
    b = unique(spark, a, SF)
    component = classes(rows_a.doc_id.tolist(), [plain_fingerprint(t) for t in rows_a.text])
    rows_b = b.toPandas()
    assert b.columns == columns and set(rows_b.doc_id) == {i for i in component if component[i] == i}
    c = fresh(spark, b, SF)
    rows_c = c.toPandas()
    assert c.columns == columns and [(x[0], x[3]) for x in brute(list(zip(rows_b.doc_id, rows_b.text)), 50)] == sorted(((i, " ".join(t.split())) for i, t in zip(rows_c.doc_id, rows_c.text)), key=str)
    same = {i for i, n in zip(rows_b.doc_id, rows_b.text) if n in set(rows_c.text)}
    assert {x[0] for x in brute(list(zip(rows_b.doc_id, rows_b.text)), 50) if x[2] == 0} <= same  # without repeats: byte by byte as it was
    assert (rows_c.n_chars == rows_c.text.str.len()).all()
    pieces = packed(spark, c, SF).toPandas()
    assert set(pieces.doc_id) == set(rows_c.doc_id)
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    whole = corpus_pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert whole.groupby("doc_id").length.sum().to_dict() == pieces.groupby("doc_id").length.sum().to_dict() and set(key) <= set(whole.columns)


def test_stages_take_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = spark.createDataFrame([(1, None, None, None, None), (None, "a b", None, "s", 3), (2, "", "en", None, 0), (2, "", "en", None, 0)], schema)
    for table in (rows, rows.where("false")):
        docs = table
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == table.columns
        left = sorted((r.doc_id is None, r.doc_id, r.text, r.n_chars) for r in docs.collect())
        if table is rows:  # null and empty texts are one class, whose smallest id stays; nulls stay null
            assert [x[1:] for x in left] == [(1, None, None), (None, "a b", 3)]
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
        assert len(pieces) == len(left)


def test_every_operator_is_registered():
    found = {int(n[2:].split("_")[0]) for n in queries.QUERIES}
    assert found == set(range(1, 14)) and np.all([callable(f) for f in queries.QUERIES.values()]) and simhash


def test_columns_of_any_name_come_through_every_stage(spark):
    names = ["_text", "_row", "_", "a.b", "row", "text_1", "rest", "id", "key", "fp", "label", "t1", "spans", "x y`"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = docs.select("*", *(F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")).alias(n) for k, n in enumerate(names)))
    names = [n for n in names if "`" not in n]
    table = table.select(*docs.columns, *(F.col(f"`{n}`") for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stored(stage(spark, table, SF), name)
        assert table.columns == [*docs.columns, *names]
        for k, n in enumerate(names):
            assert table.where(F.col(f"`{n}`") != F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string"))).isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() >= table.count() > 50


def test_long_texts_pass_every_stage(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    long = [(1, "word " * 2_000_000), (2, "x" * 10_000_000), (3, "Other words stand here. " * 80_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in long], "doc_id long, text string, lang string, source string, n_chars long")
    assert quality.quality_scores(docs, quality.fit(docs, labels)).count() == 3
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stored(stage(spark, docs, SF), "long")
    assert {r.doc_id: r.n_chars for r in docs.select("doc_id", "n_chars").collect()} == {i: len(t) for i, t in long}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    assert len(pieces) == 3 and all(r.n == r.doc_tokens for r in pieces)

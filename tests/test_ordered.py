"""Ordered sinks and hashes."""

import os

import pytest
from pyspark.sql import functions as F

from gustline.functions import scalars as S
from gustline.operators.checks import ContractError
from gustline.sources import ordered


@pytest.fixture(scope="module")
def rows(spark):
    """Ten thousand rows, a third of them with one hour, in no order."""
    out = spark.range(10_000).withColumns({"hour": F.when(F.col("id") % 3 == 0, 77).otherwise(F.xxhash64("id") % 500), "plant": F.concat(F.lit("p"), F.xxhash64("id", F.lit(1)) % 9), "x": F.col("id") / 7})
    return out.repartition(5).cache()


def parts_of(path, end):
    folder = path.removeprefix("file://")
    return [os.path.join(folder, n) for n in sorted(os.listdir(folder)) if n.endswith(end)]


def test_parts_by_name_are_in_order(spark, rows, tmp_path):
    import pyarrow.parquet as pq

    path = f"file://{tmp_path}/out"
    ordered.write_ordered(rows, path, ["hour", "plant"])
    lie = [(r["hour"], r["plant"]) for f in parts_of(path, ".parquet") for r in pq.read_table(f, columns=["hour", "plant"]).to_pylist()]
    assert len(lie) == 10_000 and lie == sorted(lie)
    placed = {r["position"]: (r["hour"], r["plant"]) for r in ordered.read_ordered(spark, path).collect()}
    assert [placed[k + 1] for k in range(10_000)] == lie
    assert [r["fault"] for r in ordered.order_faults(spark, path, ["hour", "plant"]).collect() if r["fault"]] == []
    with pytest.raises(ContractError):
        ordered.write_ordered(rows, path, ["hour"])


def test_faults_are_named(spark, rows, tmp_path):
    path = f"file://{tmp_path}/out"
    rows.coalesce(1).sortWithinPartitions(F.desc("hour")).write.parquet(path)
    ordered.part_bounds(spark, path, ["hour"]).write.parquet(f"{path}.bounds")
    faults = lambda: {r["fault"] for r in ordered.order_faults(spark, path, ["hour"]).collect()}
    assert faults() == {"unsorted"}
    rows.where("id < 10").coalesce(1).write.mode("append").parquet(path)
    assert "unknown" in faults()
    two = f"file://{tmp_path}/two"
    rows.where("hour > 100").coalesce(1).sortWithinPartitions("hour").write.parquet(two)
    rows.where("hour > 100").coalesce(1).sortWithinPartitions("hour").write.mode("append").parquet(two)
    ordered.part_bounds(spark, two, ["hour"]).write.parquet(f"{two}.bounds")
    assert {r["fault"] for r in ordered.order_faults(spark, two, ["hour"]).collect()} == {None, "overlap"}
    os.remove(parts_of(two, ".parquet")[0])
    spark.catalog.refreshByPath(two)
    assert "missing" in {r["fault"] for r in ordered.order_faults(spark, two, ["hour"]).collect()}


def test_nulls_ties_odd_names_and_empty_tables(spark, tmp_path):
    odd = spark.createDataFrame([(None, 2), (1, 1), (1, 1), (None, 1), (0, None)], "`a.b` int, `_` int")
    places = [(r["a.b"], r["_"]) for r in sorted(ordered.with_positions(odd, ["a.b"]).collect(), key=lambda r: r["position"])]
    assert places == [(None, 1), (None, 2), (0, None), (1, 1), (1, 1)]
    path = f"file://{tmp_path}/odd"
    ordered.write_ordered(odd, path, ["a.b"])
    assert sorted(r["position"] for r in ordered.read_ordered(spark, path).collect()) == [1, 2, 3, 4, 5]
    empty = odd.where("false")
    ordered.write_ordered(empty, f"{path}2", ["a.b"])
    assert ordered.read_ordered(spark, f"{path}2").count() == 0
    assert ordered.ordered_hash(empty, ["a.b"], ["_"]).first()["rows"] == 0
    with pytest.raises(ContractError):
        ordered.with_positions(odd.withColumn("position", F.lit(1)), ["_"])


def test_hash_knows_the_order_but_not_the_parts(spark, rows):
    of = lambda df, order, columns=("plant", "x"): ordered.ordered_hash(df, order, list(columns)).first()["digest"]
    first = of(rows, ["id"])
    assert of(rows.repartition(13), ["id"]) == of(rows.coalesce(1), ["id"]) == first
    swapped = rows.withColumn("id", F.when(F.col("id") == 4, 5).when(F.col("id") == 5, 4).otherwise(F.col("id")))
    assert of(swapped, ["id"]) != first
    assert of(rows, ["hour", "id"]) != first
    assert of(rows.withColumn("x", F.col("x") * (1 + 1e-13)), ["id"]) == first
    assert of(rows.withColumn("x", F.col("x") * (1 + 1e-7)), ["id"]) != first


def test_significant_digits_as_in_c(spark):
    values = [0.0, -0.0, 1.0, -100.0, 123.456, 1e-4, 9.99e-5, 1e-300, 123456789.0, 999999999.4, 999999999.6, 1e9, 1.5e22, -2.5e-7, 1 / 3, 2e8 / 3, float("nan"), float("inf"), float("-inf"), 2.5e-307]
    got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double").orderBy("k").select(S.significant(F.col("x"))).collect()]
    assert got == ["0" if v == 0 else f"{v:.9g}" for v in values]


def test_lines_are_one_file_with_its_header_first(rows, tmp_path):
    path = f"file://{tmp_path}/lines"
    ordered.write_lines(rows, path, ["hour", "plant"], F.concat_ws(",", "hour", "plant", "id"), "hour,plant,id")
    lines = [line for f in parts_of(path, ".txt") for line in open(f).read().splitlines()]
    assert lines[0] == "hour,plant,id" and len(lines) == 10_001
    keys = [(int(h), p) for h, p, _ in (x.split(",") for x in lines[1:])]
    assert keys == sorted(keys)
    with pytest.raises(ContractError):
        ordered.write_lines(rows.withColumn("hour", F.nullif("hour", F.lit(77))), f"{path}2", ["hour"], F.lit("x"), "h")

"""Declared blocks, scopes of jobs, and acceptance."""

import datetime

import pytest
from pyspark.sql import functions as F

from gustline.operators import roles
from gustline.operators.checks import ContractError

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame([("0", "train", START, START + 2 * DAY), ("0", "evaluation", START + 2 * DAY, START + 3 * DAY), ("reserved", "final_test", START + 9 * DAY, START + 10 * DAY)], "fold string, role string, block_start timestamp_ntz, block_end timestamp_ntz")


@pytest.fixture(scope="module")
def rows(spark):
    hours = [(p, START + datetime.timedelta(hours=h), float(h)) for p, n in (("a", 72), ("b", 30)) for h in range(n)]
    return spark.createDataFrame(hours, "plant string, hour timestamp_ntz, x double")


def segments(spark, *found):
    return spark.createDataFrame(list(found), "plant string, valid_from timestamp_ntz, valid_to timestamp_ntz")


def test_blocks_by_registered_hours(spark, blocks, rows):
    half = datetime.timedelta(minutes=30)
    validity = segments(spark, ("a", START, START + DAY + half), ("a", START + 2 * DAY, START + 20 * DAY), ("b", START, START + DAY), ("c", START - DAY, START + 2 * DAY))
    got = {(r["fold"], r["role"]): r for r in roles.block_coverage(rows, blocks, validity, "plant", "hour", 24, 2, 0.5).collect()}
    train, evaluation, final = got["0", "train"], got["0", "evaluation"], got["reserved", "final_test"]
    assert (train["rows"], train["plants"], train["hours"], train["expected"], train["fault"]) == (78, 2, 48, 24 + 24 + 48, None)
    assert (evaluation["rows"], evaluation["expected"], evaluation["coverage"], evaluation["fault"]) == (24, 24, 1.0, "plants")
    assert (final["rows"], final["expected"], final["coverage"], final["fault"]) == (0, 24, 0.0, "empty")
    assert all(r["fault"] == "empty" for r in roles.block_coverage(rows.where("false"), blocks, validity.where("false"), "plant", "hour").collect())


def test_segments_that_cannot_be(spark, blocks, rows):
    for bad in ([("a", START, START)], [("a", None, START)], [("a", START, START + 2 * DAY), ("a", START + DAY, START + 3 * DAY)], [("a", START, START + DAY)]):
        with pytest.raises(ContractError):
            roles.block_coverage(rows, blocks, segments(spark, *bad), "plant", "hour")


def test_scope_is_exact(spark, blocks, rows):
    frozen = roles.assignments(rows, blocks, ["plant", "hour"], "hour", ["plant", "hour", "x"]).cache()
    train = rows.where(F.col("hour") < START + 2 * DAY)
    args = (["train"], ["plant", "hour"], ["plant", "hour", "x"])
    assert roles.require_scope(train, frozen, *args) is train
    at = lambda h: F.col("hour") == START + datetime.timedelta(hours=h)
    job = train.where(~at(0)).withColumn("x", F.when(at(1), None).otherwise(F.col("x"))).unionByName(train.where(at(2))).unionByName(rows.where(at(60))).unionByName(train.where(at(3)).withColumn("hour", F.lit(None).cast("timestamp_ntz")))
    twice = frozen.unionByName(frozen.where(at(4)).withColumn("fingerprint", F.lit("other")))
    found = {(r["plant"], r["hour"] and (r["hour"] - START).total_seconds() / 3600): r["fault"] for r in roles.scope_faults(job, twice, *args).collect()}
    both = {(p, float(h)): f for p in "ab" for h, f in ((0, "missing"), (1, "changed"), (2, "repeated"), (4, "ambiguous"))}
    assert found == both | {("a", 60.0): "unauthorised", ("a", None): "unauthorised", ("b", None): "unauthorised"}
    with pytest.raises(ContractError, match="changed"):
        roles.require_scope(job, frozen, *args)
    assert {r["fault"] for r in roles.scope_faults(train.where("false"), frozen, *args).collect()} == {"missing"}


def test_acceptance_asks_all_that_is_named(spark):
    rows = spark.range(400).select(F.when(F.col("id") < 200, "calibration").otherwise("final_test").alias("role"), F.lit("6-9").alias("band"), (F.col("id") % 200 + 100.0).alias("actual"), (F.col("id") % 200 + 130.0).alias("before"), (F.col("id") % 200 + 90.0 + F.col("id") % 21).alias("after"), F.lit(8.0).alias("wind"), F.lit(450.0).alias("cap"), F.lit(1.0).alias("avail"))
    names = [F.col(c) for c in ("actual", "before", "after", "wind", "cap", "avail")]
    judge = lambda criteria, df=rows: roles.acceptance(df, F.col("role"), "band", *names, criteria).first()
    out = judge({"most_mae": 6.0, "better_than_base": True, "least_inside": 0.85})
    assert out["approved"] and out["rows"] == 200 and out["base_mae"] == 30.0 and 5 < out["mae"] < 5.5 and out["inside"] > 0.85
    assert not judge({})["approved"] and not judge({"most_mae": 5.0, "better_than_base": True})["approved"] and not judge({"better_than_base": True, "least_inside": 0.99})["approved"]
    assert not judge({"better_than_base": True}, rows.where("role = 'calibration'"))["approved"]
    with pytest.raises(ContractError):
        judge({"least_coverage": 1})

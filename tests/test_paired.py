"""Estimates compared by fold."""

import pytest
from pyspark.sql import functions as F

from gustline.functions import wind as W
from gustline.operators import fitted, paired
from gustline.operators.checks import ContractError


@pytest.fixture(scope="module")
def rows(spark):
    """40 days of three plants; what the curve misses is 0.02 u + 0.01 (w - 8); a fourth plant comes late, one row lacks u."""
    out = spark.range(960).select(F.col("id").alias("hour")).withColumn("plant", F.explode(F.array(*map(F.lit, "abcd")))).where("plant <> 'd' OR hour > 900")
    u = F.pmod(F.xxhash64("hour", "plant"), F.lit(5)).cast("double")  # no estimate leaves the physical bounds
    w = 8 + F.pmod(F.xxhash64("plant", "hour", F.lit(2)), F.lit(3)).cast("double") + u / 10
    out = out.withColumns({"u": u, "w": w, "cap": F.lit(100.0), "avail": F.lit(1.0)}).withColumn("base", W.power(F.col("w"), F.col("cap"), F.col("avail")))
    out = out.withColumn("gen", F.col("base") + 100 * (0.02 * F.col("u") + 0.01 * (F.col("w") - 8)))
    return out.withColumn("residual", (F.col("gen") - F.col("base")) / 100).withColumn("u", F.when((F.col("hour") != 950) | (F.col("plant") != "a"), F.col("u"))).cache()


def judged(rows):
    return paired.fold_estimates(rows, "hour", "plant", fitted.expanding(rows, "hour", 3, 6), "residual", "w", ["u"], penalty=1e-6)


def test_the_effect_is_found_and_the_rest_keeps_the_curve(rows):
    got = judged(rows).cache()
    reasons = {(r["plant"], r["reason"]): r["count"] for r in got.groupBy("plant", "reason").count().collect()}
    assert reasons == {("a", "model"): 719, ("a", "incomplete"): 1, ("b", "model"): 720, ("c", "model"): 720, ("d", "unknown_group"): 59}
    assert got.where("reason = 'model'").agg(F.max(F.abs(F.col("effect") - F.col("gen")))).first()[0] < 0.05
    assert got.where("reason <> 'model' AND (ridge <> base OR effect <> base)").count() == 0


def test_pairs_share_rows_and_later_hours_change_nothing(rows):
    out = paired.fold_comparison(judged(rows).where("reason = 'model'"), "fold", "hour", "gen", ["base", "ridge", "effect"], samples=50)
    got = {(r["fold"], r["before"], r["after"]): r for r in out.collect()}
    assert len(got) == 12 and {r["rows"] for k, r in got.items() if k[0] == 0} == {2159}
    assert all(r["gain"] > 0.5 and r["low"] <= r["gain"] <= r["high"] for k, r in got.items() if k[2] == "effect")
    assert [got[f, "base", "effect"]["underpowered"] for f in range(4)] == [False] * 4
    holes = judged(rows).withColumn("ridge", F.when(F.col("hour") != 500, F.col("ridge")))
    assert {r["rows"] for r in paired.fold_comparison(holes, "fold", "hour", "gen", ["base", "ridge", "effect"], samples=5).where("fold = 0").collect()} == {2219 - 3}
    folds = fitted.expanding(rows, "hour", 3, 6)
    later = rows.withColumn("residual", F.when(F.col("hour") >= folds[0].train_end, 9.0).otherwise(F.col("residual")))
    both = [paired.fold_estimates(r, "hour", "plant", folds, "residual", "w", ["u"]).where("fold = 1").agg(F.sum("effect")).first()[0] for r in (rows, later)]
    assert both[0] == pytest.approx(both[1], rel=1e-12)


def test_a_treatment_that_the_features_determine_has_no_effect_and_empty_training_is_refused(rows):
    flat = rows.where("u IS NOT NULL").withColumn("w2", F.col("u") * 2 + 1)
    got = paired.fold_estimates(flat, "hour", "plant", fitted.expanding(flat, "hour", 3, 6), "residual", "w2", ["u"], penalty=0.0)
    assert got.agg(F.max(F.abs(F.col("effect") - F.col("ridge")))).first()[0] < 1e-9
    with pytest.raises(ContractError):
        paired.fold_estimates(rows.withColumn("residual", F.lit(None).cast("double")), "hour", "plant", fitted.expanding(rows, "hour", 3, 6), "residual", "w", ["u"])

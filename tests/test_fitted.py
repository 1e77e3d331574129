"""Models fitted over time: sums of products, effects with fitted nuisances, tuning by folds, boosting that validation ends."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustline.operators import fitted, ml
from gustline.operators.checks import ContractError


def panel(spark, hours=400, plants=3, noise=0.3, seed=1, theta=0.8):
    """y = 0.8 t + 2 a - b + plant noise; t = a - 0.5 b + noise: the effect of t is known."""
    rng = np.random.default_rng(seed)
    n = hours * plants
    a, b = rng.normal(size=n), rng.normal(size=n)
    t = a - 0.5 * b + noise * rng.normal(size=n)
    y = theta * t + 2 * a - b + 0.3 * rng.normal(size=n)
    rows = [(int(k // plants), f"p{k % plants}", float(a[k]), float(b[k]), float(t[k]), float(y[k])) for k in range(n)]
    return spark.createDataFrame(rows, "h long, plant string, a double, b double, t double, y double")


def test_folds_are_apart_and_behind_each_other(spark):
    rows = panel(spark, hours=103, plants=2)
    for stopping in (False, True):
        folds = fitted.expanding(rows, "h", 3, 4, stopping)
        assert [f.number for f in folds] == [1, 2, 3] and folds[-1].end == 102
        for f, following in zip(folds, [*folds[1:], None]):
            assert f.train_end <= f.stop_start <= f.stop_end == f.start - 4 and f.start <= f.end
            assert (f.stop_start - f.train_end == 4) == stopping
            assert following is None or following.start == f.end + 1
    with pytest.raises(ContractError, match="too few"):
        fitted.expanding(rows.where("h < 3"), "h", 3, 4)


def test_sums_of_products_and_ridge_against_numpy(spark):
    rows = panel(spark, hours=120)
    local = rows.toPandas()
    edges = [50, 90, 50, 120]
    sums = fitted.products(rows, ["a", "b"], ["y", "t"], "h", edges)
    for edge, s in zip(edges, sums):
        own = local[local.h < edge]
        x = np.column_stack([np.ones(len(own)), own.a, own.b])
        assert np.allclose(s, np.column_stack([x, own.y, own.t]).T @ np.column_stack([x, own.y, own.t]))
        for k, target in enumerate(("y", "t")):
            want = np.linalg.solve(x.T @ x + np.diag([0, 2.5, 2.5]), x.T @ own[target])
            assert np.allclose(fitted.ridge(s, 2, k, 2.5), want)
            assert np.allclose(fitted.ridge(s, 2, k, 0.0), np.linalg.lstsq(x, own[target], rcond=None)[0])


def test_a_known_effect_is_found(spark):
    rows = panel(spark)
    e = fitted.fitted_effect(rows, "h", "y", "t", ["a", "b"], folds=3, group="plant")
    assert abs(e.theta - 0.8) < 0.1 and e.low < 0.8 < e.high and e.rows >= 800 and 0.2 < e.treatment_std < 0.4
    naive = rows.agg(F.regr_slope("y", "t")).first()[0]
    assert abs(naive - 0.8) > 0.5  # without controls it isn't
    out = rows.withColumn("p", e.predict(rows)).agg(F.sqrt(F.avg((F.col("p") - F.col("y")) ** 2)).alias("rmse")).first()
    assert 0.25 < out.rmse < 0.35
    with_null = rows.withColumn("a", F.when(F.col("h") % 7 != 0, F.col("a")))
    assert abs(fitted.fitted_effect(with_null, "h", "y", "t", ["a", "b"], folds=3).theta - 0.8) < 0.1


def test_effects_that_must_be_refused(spark):
    rows = panel(spark)
    with pytest.raises(ContractError, match="overlap"):
        fitted.fitted_effect(rows.withColumn("t", F.col("a") - F.col("b") / 2), "h", "y", "t", ["a", "b"], folds=3)
    with pytest.raises(ContractError, match="out-of-fold"):
        fitted.fitted_effect(rows, "h", "y", "t", ["a", "b"], folds=3, least_rows=10_000)
    with pytest.raises(ContractError, match="too few"):
        fitted.fitted_effect(rows.where("false"), "h", "y", "t", ["a", "b"])
    e = fitted.fitted_effect(rows, "h", "y", "t", ["a", "b"], folds=3, group="plant")
    for stranger in ("px", None):
        with pytest.raises(ContractError, match="know"):
            e.predict(rows.limit(5).withColumn("plant", F.lit(stranger).cast("string")))


def curve(spark, hours=240, noise=5.0, seed=2):
    rng = np.random.default_rng(seed)
    w = rng.uniform(4, 20, hours)
    rows = [(int(k), "p", float(x), float(100 + 10 * x), 450.0, 1.0, float(np.clip(140 + 8 * x + noise * rng.normal(), 0, 450))) for k, x in enumerate(w)]
    return spark.createDataFrame(rows, "hour_idx long, plant string, w double, base double, cap double, avail double, gen double").withColumn("residual", (F.col("gen") - F.col("base")) / F.col("cap"))


def test_tuning_gives_every_candidate_in_every_fold_and_can_be_checked(spark):
    rows = curve(spark)
    folds = fitted.expanding(rows, "hour_idx", 3, 2, stopping=True)
    found = fitted.ridge_path(rows, "hour_idx", folds, "residual", ["w"], {"b": 0.0, "a": 0.0, "stiff": 1e9})
    out = fitted.ranked(found).toPandas()
    assert len(out) == 9 and out.groupby("candidate")["rank"].first().to_dict() == {"a": 1, "b": 2, "stiff": 3}  # ties by name
    assert out[out.candidate == "a"].mae.max() < 6 < 1.2 * out[out.candidate == "stiff"].mae.min()
    digest = fitted.selection_digest(found, folds)
    assert fitted.checked_selection(found.repartition(5), folds, digest, ["a", "b", "stiff"]) == "a"
    for bad in (found.where("NOT (candidate = 'b' AND fold = 2)"), found.unionAll(found.limit(1)), found.withColumn("mae", F.col("mae") * 1.001), found.withColumn("mae", F.lit(float("nan")))):
        with pytest.raises(ContractError):
            fitted.checked_selection(bad, folds, digest, ["a", "b", "stiff"])
    with pytest.raises(ContractError):
        fitted.checked_selection(found, fitted.expanding(rows, "hour_idx", 3, 3, stopping=True), digest, ["a", "b", "stiff"])


def test_training_hours_alone_decide_and_judged_hours_never_do(spark):
    rows = curve(spark)
    folds = fitted.expanding(rows, "hour_idx", 1, 2, stopping=True)
    f = folds[0]
    changed = rows.withColumn("gen", F.when(F.col("hour_idx") >= f.train_end, 0.0).otherwise(F.col("gen"))).withColumn("residual", (F.col("gen") - F.col("base")) / F.col("cap"))
    a, b = (fitted.products(r, ["w"], ["residual"], "hour_idx", [f.train_end]) for r in (rows, changed))
    assert np.array_equal(a, b)


def test_validation_ends_boosting_far_below_the_cap_and_a_refit_makes_the_median(spark):
    rows = curve(spark).withColumns({"u": F.col("w"), "v": F.lit(0.0), "hour": F.timestamp_seconds(F.col("hour_idx") * 3600)})
    model, name, rounds, found, digest = ml.refit(rows, {"flat": {"depth": 1}, "deep": {"depth": 2}})
    each = {r["candidate"]: [] for r in found.collect()}
    for r in found.collect():
        each[r["candidate"]].append(r["rounds"])
        assert 1 <= r["rounds"] < fitted.MOST_ROUNDS // 10
    assert rounds == fitted.refit_rounds(each[name]) == model.getNumTrees
    assert len(digest) == 64 and fitted.refit_rounds([9, 4, 5]) == 5 and fitted.refit_rounds([4, 7], least=6) == 6 and fitted.refit_rounds([90], most=50) == 50

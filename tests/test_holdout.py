"""Frozen models on unseen periods: refusals, fallbacks, cohorts, and months."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gustline.operators import holdout
from gustline.operators.checks import ContractError

SCHEMA = "plant string, h long, x double, gen double, base double, cap double, avail double, w double, residual double"


def rows(spark, plants, hours, seed=0, slope=0.1):
    rng = np.random.default_rng(seed)
    out = []
    for p in plants:
        for h in hours:
            x, base = float(rng.uniform(-1, 1)), 200.0
            residual = slope * x + 0.02
            out.append((p, h, x, base + residual * 450, base, 450.0, 1.0, 10.0, residual))
    return spark.createDataFrame(out, SCHEMA)


def test_a_later_period_is_estimated_and_strangers_fall_back(spark):
    early, late = rows(spark, ["a", "b"], range(100)), rows(spark, ["a", "b", "new"], range(120, 160), seed=1)
    late = late.withColumn("x", F.when(F.col("h") != 130, F.col("x")))
    out = holdout.independent_holdout(early, late, "plant", "h", ["x"], "residual", penalty=0.0)
    got = out.toPandas()
    assert len(got) == 120 and got.reason.value_counts().to_dict() == {"model": 78, "unknown_group": 40, "incomplete": 2}
    known = got[got.reason == "model"]
    assert np.allclose(known.hybrid, known.gen) and (got[got.reason != "model"].hybrid == 200).all()
    cohorts = holdout.cohort_metrics(out, "h", "gen", "base", "hybrid").toPandas().set_index("cohort")
    assert cohorts.rows.to_dict() == {"all": 120, "known": 78} and cohorts.hours.to_dict() == {"all": 40, "known": 39}
    assert cohorts.mae_after["known"] < 1e-6 < cohorts.mae_before["known"] and cohorts.mae_after["all"] < cohorts.mae_before["all"]
    assert abs(cohorts.mae_before["all"] - (got.base - got.gen).abs().mean()) < 1e-9


def test_the_purge_keeps_the_last_training_hours_out(spark):
    early = rows(spark, ["a"], range(90)).unionAll(rows(spark, ["a"], range(90, 100), seed=2, slope=-5.0))
    late = rows(spark, ["a"], range(100, 120), seed=3)
    out = holdout.independent_holdout(early, late, "plant", "h", ["x"], "residual", penalty=0.0, purge_hours=10).toPandas()
    assert np.allclose(out.hybrid, out.gen)


def test_periods_that_must_be_refused(spark):
    early, late = rows(spark, ["a"], range(50)), rows(spark, ["a"], range(60, 70))
    run = lambda a, b, **o: holdout.independent_holdout(a, b, "plant", "h", ["x"], "residual", **o)
    with pytest.raises(ContractError, match="overlap"):
        run(early, rows(spark, ["a"], range(40, 70)))
    with pytest.raises(ContractError, match="before training"):
        run(early, rows(spark, ["z"], range(30, 70)))
    with pytest.raises(ContractError, match="no row"):
        run(early, late, purge_hours=1000)
    with pytest.raises(ContractError, match="rows"):
        run(early.where("false"), late)
    with pytest.raises(ContractError, match="rows"):
        run(early, late.where("false"))


def test_months_with_missing_keys_are_refused_and_targets_switch(spark):
    days = [dt.date(2024, 2, 1) + dt.timedelta(days=k) for k in range(29 + 31 + 30)]
    table = [(f"{d:%Y-%m}", d, p, 100.0 + k % 7, 80.0, 110.0, 100.0 + (k % 3)) for k, d in enumerate(days) for p in ("a", "b") if not (p == "b" and d == dt.date(2024, 3, 9)) and d != dt.date(2024, 4, 30)]
    df = spark.createDataFrame(table, "month string, day date, plant string, gen double, verified double, base double, pred double")
    got = {(r.month, r.target): r for r in holdout.month_backtest(df, "month", "day", "plant", ["gen", "verified"], "base", "pred").collect()}
    assert {k: r.status for k, r in got.items()} == {(m, t): "complete" if m == "2024-02" else "incomplete" for m in ("2024-02", "2024-03", "2024-04") for t in ("gen", "verified")}
    assert got["2024-03", "gen"].gain is None and got["2024-03", "gen"].low is None and got["2024-04", "gen"].days == 29
    feb = df.where("month = '2024-02'").toPandas()
    for target in ("gen", "verified"):
        daily = feb.groupby("day")[[target, "base", "pred"]].sum()
        before, after = ((daily[c] - daily[target]).abs().sum() / daily[target].abs().sum() for c in ("base", "pred"))
        r = got["2024-02", target]
        assert np.allclose([r.wape_before, r.wape_after, r.gain], [before, after, before - after]) and r.low <= r.gain <= r.high and r.keys == 58
    assert got["2024-02", "gen"].gain != got["2024-02", "verified"].gain
    assert holdout.month_backtest(df.where("false"), "month", "day", "plant", ["gen"], "base", "pred").count() == 0

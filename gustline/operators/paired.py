"""Estimates of the same rows against each other, fold by fold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions.scalars import ratio
from gustline.operators import checks, fitted


def fold_estimates(rows: DataFrame, hour: str, group: str, folds: list[fitted.Fold], outcome: str, treatment: str, features: list[str], penalty: float = 1.0) -> DataFrame:
    """Judged rows with fold, three estimates and ``reason``: base (the power curve), ridge (corrected by the features) and effect (ridge plus the treatment's effect).

    ``outcome`` is what the curve misses, in shares of capacity. Each fold learns from the hours before its cutoff only. The effect is the slope, over those hours, of what the features leave of the outcome on what
    they leave of the treatment; where they leave nothing it is zero. reason: unknown_group (the group has no hour before the cutoff) or incomplete (an input is missing) rows keep the curve in all three;
    the others are ``model``. All models of all folds come from one aggregation of products, of which the driver gets a row for each span between cutoffs.
    """
    complete = " AND ".join(f"`{c}` IS NOT NULL" for c in [treatment, *features])
    learned = rows.where(f"`{outcome}` IS NOT NULL AND {complete}")
    sums = fitted.products(learned, features, [outcome, treatment], hour, [f.train_end for f in folds])
    if any(s[0, 0] == 0 for s in sums):
        raise checks.ContractError("a fold has no rows to train on")
    p, models = len(features) + 1, {}
    for f, s in zip(folds, sums):
        y, d = (fitted.ridge(s, len(features), k, penalty) for k in (0, 1))
        left_y, left_d = np.concatenate([-y, [1.0, 0.0]]), np.concatenate([-d, [0.0, 1.0]])
        spread = left_d @ s @ left_d
        models[f.number] = (y, d, float(left_d @ s @ left_y / spread) if spread > 1e-9 * s[p + 1, p + 1] else 0.0)
    each = lambda value: fitted.of_fold(folds, hour, value)
    ridge = each(lambda f: fitted.linear(models[f.number][0], features))
    effect = each(lambda f: fitted.linear(models[f.number][0], features) + models[f.number][2] * (F.col(treatment) - fitted.linear(models[f.number][1], features)))
    since = learned.groupBy(group).agg(F.min(hour).alias("_since"))
    judged = rows.withColumn("fold", each(lambda f: F.lit(f.number))).where("fold IS NOT NULL").join(since, group, "left")
    known = F.coalesce(F.col("_since") < each(lambda f: F.lit(f.train_end)), F.lit(False))
    judged = judged.withColumn("reason", F.when(~known, "unknown_group").when(~F.expr(complete), "incomplete").otherwise("model")).drop("_since")
    used = lambda x: F.when(F.col("reason") == "model", fitted.bounded_estimate(x)).otherwise(F.col("base"))
    return judged.withColumns({"ridge": used(ridge), "effect": used(effect)})


def fold_comparison(rows: DataFrame, fold: str, hour: str, actual: str, estimates: list[str], samples: int = 200, least_days: int = 10) -> DataFrame:
    """(fold, before, after, rows, days, mae_before, mae_after, gain, low, high, underpowered) for each pair of estimates in each fold, and in all together (fold 0).

    Pairs follow the list: each estimate against every one before it. Only rows that have the actual value and every estimate count, so all pairs of a fold are judged by the same rows. gain is the share
    of the earlier one's absolute error that the later one saves; its interval holds the middle 95 percent of draws of the fold's days with replacement (an integer hash of sample and slot, as any engine can repeat).
    A fold of fewer than ``least_days`` days is marked. Rows become sums by fold and day, which is all that is shuffled.
    """
    whole = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [fold, hour, actual, *estimates]))
    pairs = [(a, b) for k, b in enumerate(estimates) for a in estimates[:k]]
    daily = whole.groupBy(F.col(fold).cast("int").alias("own"), F.floor(F.col(hour) / 24).alias("day")).agg(F.count("*").alias("n"), *(F.sum(F.abs(F.col(e) - F.col(actual))).alias(f"e{k}") for k, e in enumerate(estimates)))
    lines = F.array(*(F.struct(F.lit(a).alias("before"), F.lit(b).alias("after"), F.col(f"e{estimates.index(a)}").alias("ea"), F.col(f"e{estimates.index(b)}").alias("eb")) for a, b in pairs))
    daily = daily.select("own", "day", "n", F.explode(lines).alias("x")).select("own", "day", "n", "x.*").withColumn("fold", F.explode(F.array("own", F.lit(0))))
    key = ["fold", "before", "after"]
    of = Window.partitionBy(*key)
    slots = daily.withColumns({"slot": F.row_number().over(of.orderBy("own", "day")) - 1, "days": F.count("*").over(of)})
    total = slots.groupBy(*key).agg(F.sum("n").alias("rows"), F.count("*").alias("days"), (F.sum("ea") / F.sum("n")).alias("mae_before"), (F.sum("eb") / F.sum("n")).alias("mae_after"), ratio(F.sum("ea") - F.sum("eb"), F.sum("ea")).alias("gain"))
    drawn = slots.select(*key, "days", F.col("slot").alias("place")).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    pick = ((F.col("sample").cast("long") * 7919 + F.col("place") * 104729 + 12345) * 48271 % 2147483647 % F.col("days")).cast("int")
    drawn = drawn.select(*key, "sample", pick.alias("slot")).join(slots.select(*key, "slot", "ea", "eb"), [*key, "slot"])
    gains = drawn.groupBy(*key, "sample").agg(ratio(F.sum("ea") - F.sum("eb"), F.sum("ea")).alias("g")).groupBy(*key).agg(F.percentile("g", 0.025).alias("low"), F.percentile("g", 0.975).alias("high"))
    return total.join(gains, key).withColumn("underpowered", F.col("days") < least_days).select(*key, "rows", "days", "mae_before", "mae_after", "gain", "low", "high", "underpowered")

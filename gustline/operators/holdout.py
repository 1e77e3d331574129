"""Frozen models on periods that they have not seen: an independent hold-out, and a back-test by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions.scalars import ratio
from gustline.operators import checks, fitted


def independent_holdout(training: DataFrame, holdout: DataFrame, group: str, hour: str, features: list[str], target: str, penalty: float = 1.0, purge_hours: int = 6) -> DataFrame:
    """Hold-out rows with ``hybrid`` and ``reason``: a ridge correction of the power curve, fitted on the training period alone.

    Refused: keys (group, hour) that both tables have, and a hold-out that begins before training has ended. Training rows within the purge before the hold-out are not learned from. Where the model may
    not be used the estimate is the power curve itself: reason unknown_group (none of its rows was learned from), incomplete (a feature is missing), else model. The groups
    that are known come by a join, however many there are.
    """
    checks.require_disjoint(training, holdout, [group, hour])
    (start,), (end,) = holdout.agg(F.min(hour)).first(), training.agg(F.max(hour)).first()
    if start is None or end is None:
        raise checks.ContractError("both periods must have rows")
    if start <= end:
        raise checks.ContractError("the hold-out begins before training has ended")
    learned = training.where((F.col(hour) < start - purge_hours) & F.col(target).isNotNull()).where(" AND ".join(f"`{f}` IS NOT NULL" for f in features))
    (sums,) = fitted.products(learned, features, [target], hour, [int(start)])
    if sums[0, 0] == 0:
        raise checks.ContractError("no row is left to train on")
    correction = fitted.linear(fitted.ridge(sums, len(features), 0, penalty), features)
    known = learned.select(group).distinct().withColumn("_known", F.lit(True))
    whole = F.lit(True)
    for f in features:
        whole = whole & F.col(f).isNotNull()
    reason = F.when(F.col("_known").isNull(), "unknown_group").when(~whole, "incomplete").otherwise("model")
    out = holdout.join(known, group, "left").withColumn("reason", reason).drop("_known")
    return out.withColumn("hybrid", F.when(F.col("reason") == "model", fitted.bounded_estimate(correction)).otherwise(F.col("base")))


def cohort_metrics(judged: DataFrame, hour: str, actual: str, before: str, after: str) -> DataFrame:
    """(cohort, rows, hours, mae and hourly WAPE of both estimates): over all rows, and over those that the model was used for. One pass by hour, then over hours."""
    used = F.col("reason") == "model"
    of = {"all": F.lit(True), "known": used}
    sums = [x.alias(f"{c}_{n}") for c, mine in of.items() for n, x in (("n", F.count_if(mine)), *((s, F.sum(F.when(mine, F.col(col)))) for s, col in (("y", actual), ("b", before), ("a", after))), *((s, F.sum(F.when(mine, F.abs(F.col(col) - F.col(actual))))) for s, col in (("eb", before), ("ea", after))))]
    hourly = judged.groupBy(hour).agg(*sums)
    line = lambda c: F.struct(
        F.lit(c).alias("cohort"), F.sum(f"{c}_n").alias("rows"), F.count_if(F.col(f"{c}_n") > 0).alias("hours"), ratio(F.sum(f"{c}_eb"), F.sum(f"{c}_n")).alias("mae_before"), ratio(F.sum(f"{c}_ea"), F.sum(f"{c}_n")).alias("mae_after"),
        ratio(F.sum(F.abs(F.col(f"{c}_b") - F.col(f"{c}_y"))), F.sum(F.abs(f"{c}_y"))).alias("wape_before"), ratio(F.sum(F.abs(F.col(f"{c}_a") - F.col(f"{c}_y"))), F.sum(F.abs(f"{c}_y"))).alias("wape_after"),
    )
    return hourly.agg(F.array(*map(line, of)).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def month_backtest(rows: DataFrame, month: str, day: str, plant: str, targets: list[str], before: str, after: str, samples: int = 200) -> DataFrame:
    """(month, target, status, days, keys, wape_before, wape_after, gain, low, high): a frozen estimate against another, month by month, for each target in turn.

    A month is refused (status incomplete, no figures) unless every plant that it has comes on every day of the calendar month. Figures are over daily totals. The interval of the
    gain is the 2.5 and 97.5 percent point of draws of the month's days with replacement; a draw is an integer hash of (sample, slot), as any engine can repeat. Rows are read once: they become a row for
    each plant and day, then for each day, then for each month and sample.
    """
    value = lambda c: F.sum(F.col(c)).alias(c)
    each = rows.groupBy(month, day, plant).agg(*map(value, (*targets, before, after)))
    daily = each.groupBy(month, day).agg(F.count("*").alias("plants"), F.collect_set(plant).alias("_p"), *map(value, (*targets, before, after)))
    lines = F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in targets))
    daily = daily.select(month, day, "plants", "_p", before, after, F.explode(lines).alias("x")).select(month, day, "plants", "_p", "x.target", F.abs("x.y").alias("size"), F.abs(F.col(before) - F.col("x.y")).alias("eb"), F.abs(F.col(after) - F.col("x.y")).alias("ea"))
    of = Window.partitionBy(month, "target")
    slots = daily.withColumns({"slot": F.row_number().over(of.orderBy(day)) - 1, "n": F.count("*").over(of)})
    length = F.day(F.last_day(F.to_date(F.concat(F.col(month), F.lit("-01")))))
    total = slots.groupBy(month, "target").agg(F.count("*").alias("days"), F.sum("plants").alias("keys"), F.size(F.array_distinct(F.flatten(F.collect_set("_p")))).cast("long").alias("_plants"), F.sum("size").alias("size"), F.sum("eb").alias("eb"), F.sum("ea").alias("ea"))
    total = total.withColumn("status", F.when((F.col("days") == length) & (F.col("keys") == F.col("_plants") * length), "complete").otherwise("incomplete"))
    good = total.where("status = 'complete'").select(month, "target")
    draws = slots.join(good, [month, "target"], "left_semi").select(month, "target", "n", F.col("slot").alias("place")).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    draw = ((F.col("sample").cast("long") * 7919 + F.col("place") * 104729 + 12345) * 48271 % 2147483647 % F.col("n")).cast("int")
    drawn = draws.select(month, "target", "sample", draw.alias("slot")).join(slots.select(month, "target", "slot", "size", "eb", "ea"), [month, "target", "slot"])
    gains = drawn.groupBy(month, "target", "sample").agg(ratio(F.sum("eb") - F.sum("ea"), F.sum("size")).alias("g")).groupBy(month, "target").agg(F.percentile("g", 0.025).alias("low"), F.percentile("g", 0.975).alias("high"))
    out = total.join(gains, [month, "target"], "left")
    shown = lambda x: F.when(F.col("status") == "complete", x)
    return out.select(month, "target", "status", "days", "keys", shown(ratio(F.col("eb"), F.col("size"))).alias("wape_before"), shown(ratio(F.col("ea"), F.col("size"))).alias("wape_after"), shown(ratio(F.col("eb") - F.col("ea"), F.col("size"))).alias("gain"), "low", "high")

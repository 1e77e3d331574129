"""Searches and effects over time: adaptation splits, residual stages, cross-fitted effects, checks of folds and periods, exact quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions import wind as W
from gustline.functions.scalars import ratio
from gustline.operators.checks import few
from gustline.operators.splits import block_of, ranked_hours


def adaptation_parts(rows: DataFrame, hour_index: str, train_percent: int, gap_hours: int) -> DataFrame:
    """Adds ``part``: train, validation (the last hours), or purged (within the gap before validation starts). Distinct hours are cut, never one hour."""
    ranks = ranked_hours(rows, hour_index)
    edge = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(F.col("n") * train_percent / 100)))
    start = ranks.where(F.col("rank") == edge).select(F.col(hour_index).alias("_start"))
    out = rows.join(F.broadcast(start))  # one row of one number
    early = F.col(hour_index) < F.col("_start") - gap_hours
    return out.withColumn("part", F.when(F.col(hour_index) >= F.col("_start"), "validation").when(early, "train").otherwise("purged")).drop("_start")


def quantile_hour(rows: DataFrame, hour: str, percent: int) -> DataFrame:
    """One row: the distinct hour at the position floor(n percent / 100), counted from 0."""
    ranks = ranked_hours(rows, hour)
    return ranks.where(F.col("rank") == F.floor(F.col("n") * percent / 100)).select(F.col(hour).alias("cut"))


def fold_faults(folds: DataFrame, order: str) -> DataFrame:
    """Folds with ``fault``: another start than the first's, or a training end before the last evaluation's end; folds are a few declared rows."""
    before = Window.orderBy(order)
    start, end = F.lag("train_start").over(before), F.lag("evaluation_end").over(before)
    fault = F.when(start.isNull(), None).when(F.col("train_start") != start, "start").when(F.col("train_end") < end, "evaluation_not_in_training")
    return folds.withColumn("fault", fault)


def period_faults(rows: DataFrame, period: str, order: str, time: str, keys: list[str]) -> DataFrame:
    """(period, start, end, fault): periods that don't begin after the one before has ended, or that share keys with another."""
    spans = rows.groupBy(order, period).agg(F.min(time).alias("start"), F.max(time).alias("end"))
    shared = rows.select(*keys, period).distinct().groupBy(*keys).agg(F.count("*").alias("_n"), F.collect_set(period).alias("_p")).where("_n > 1")
    shared = shared.select(F.explode("_p").alias(period)).distinct().withColumn("_shared", F.lit(True))
    spans = spans.withColumn("_last", F.lag("end").over(Window.orderBy(order)))  # a row for each period
    fault = F.when(F.col("start") <= F.col("_last"), "order").when(F.col("_shared"), "overlap")
    return spans.join(shared, period, "left").withColumn("fault", fault).select(period, "start", "end", "fault")


def residual_search(rows: DataFrame, hour: str, prior: str, candidates: list[str], scales: list[float]) -> DataFrame:
    """(candidate, scale, hourly_wape, plant_hour_wape, rank) of every correction at every scale, and of none.

    Rows: gen, prior, the candidates' corrections in shares of capacity, w, cap, avail. One pass: each row gives its error under every choice as columns, which are
    summed by hour and then over hours, so nothing is copied for a choice. Ties go to the better error by plant and hour, then to the name, then to the smaller scale.
    """
    choices = [("no_correction", 0.0)] + [(c, s) for c in candidates for s in scales]
    guess = lambda c, s: F.col(prior) if c == "no_correction" else W.scaled(F.col(prior), F.col(c), s, F.col("w"), F.col("cap"), F.col("avail"))
    each = rows.select(hour, "gen", *(guess(c, s).alias(f"p{k}") for k, (c, s) in enumerate(choices)))
    hourly = each.groupBy(hour).agg(F.sum("gen").alias("gen"), F.sum(F.abs("gen")).alias("size"), *(x for k in range(len(choices)) for x in (F.sum(f"p{k}").alias(f"p{k}"), F.sum(F.abs(F.col(f"p{k}") - F.col("gen"))).alias(f"e{k}"))))
    total = hourly.agg(F.sum(F.abs("gen")).alias("base"), F.sum("size").alias("size"), *(x for k in range(len(choices)) for x in (F.sum(F.abs(F.col(f"p{k}") - F.col("gen"))).alias(f"h{k}"), F.sum(f"e{k}").alias(f"e{k}"))))
    lines = F.array(*(F.struct(F.lit(c).alias("candidate"), F.lit(float(s)).alias("scale"), F.round(ratio(F.col(f"h{k}"), F.col("base")), 9).alias("hourly_wape"), F.round(ratio(F.col(f"e{k}"), F.col("size")), 9).alias("plant_hour_wape")) for k, (c, s) in enumerate(choices)))
    best = Window.orderBy(F.asc_nulls_last("hourly_wape"), F.asc_nulls_last("plant_hour_wape"), "candidate", "scale")
    return total.select(F.explode(lines).alias("x")).select("x.*").withColumn("rank", F.row_number().over(best))


def cross_fitted(rows: DataFrame, hour_index: str, folds: int, gap_hours: int, outcome: str, treatment: str, group: str) -> DataFrame:
    """Rows of the evaluation blocks with fold, y and d: outcome and treatment less what earlier hours of their group predict.

    Nuisances are means by group over all hours before the fold's cutoff, so no row is predicted from its own time or later. Sums by group and block are
    small; they are added up over the blocks before a fold, and the hours between the last block and the cutoff are taken off again.
    """
    ranks = ranked_hours(rows, hour_index).withColumn("fold", block_of(F.col("rank"), F.col("n"), folds + 1).cast("int")).select(hour_index, "fold")
    own = rows.join(ranks, hour_index)
    starts = ranks.groupBy("fold").agg(F.min(hour_index).alias("_start")).where("fold > 0").withColumn("_cutoff", F.col("_start") - gap_hours)
    by_hour = own.groupBy(group, hour_index).agg(F.sum(outcome).alias("_y"), F.sum(treatment).alias("_d"), F.count("*").alias("_n"))
    past = by_hour.join(few(starts.select(F.col("fold").alias("_fold"), "_cutoff")), F.col(hour_index) < F.col("_cutoff"))
    means = past.groupBy(F.col("_fold").alias("fold"), group).agg((F.sum("_y") / F.sum("_n")).alias("_my"), (F.sum("_d") / F.sum("_n")).alias("_md"))
    return own.join(means, ["fold", group]).withColumns({"y": F.col(outcome) - F.col("_my"), "d": F.col(treatment) - F.col("_md")}).drop("_my", "_md")


def frozen(predictions: DataFrame, snapshot: DataFrame, keys: list[str], targets: list[str]) -> DataFrame:
    """Predictions joined to the snapshot's targets; targets that the predictions carry along are dropped first, so that none is believed."""
    return predictions.drop(*targets).join(snapshot.select(*keys, *targets), keys)


def traced(sample: DataFrame, source: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Sampled rows with the source's value and whether both agree; a row that the source lacks does not."""
    out = sample.join(source.select(*keys, F.col(value).alias("_source")), keys, "left")
    return out.withColumn("agrees", F.coalesce(F.abs(F.col(value) - F.col("_source")) <= tolerance, F.lit(False))).withColumnRenamed("_source", "source")


def exact_quantiles(rows: DataFrame, x: str, shares: list[float]) -> DataFrame:
    """(share, value): interpolated quantiles of a column, whatever the number of distinct values: no task holds more than a range of them.

    Values are counted first, dealt into sorted ranges, and only the ranks asked for are read. Nulls don't count.
    """
    from gustline.shared import shared_dir

    shared_dir(rows.sparkSession)
    counted = rows.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("value")).count()
    dealt = counted.repartitionByRange("value").sortWithinPartitions("value").withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("_part").agg(F.sum("count").alias("_size"))
    sizes = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_base"), F.sum("_size").over(Window.partitionBy(F.lit(0))).alias("_total"))  # a row for each range
    own = Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("_upto", F.sum("count").over(own)).join(F.broadcast(sizes), "_part").withColumn("_upto", F.col("_upto") + F.col("_base"))
    place = lambda q: F.lit(float(q)) * (F.col("_total") - 1)
    holds = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("count") <= rank)
    asked = F.filter(F.array(*(F.struct(F.lit(float(q)).alias("share"), place(q).alias("place"), holds(F.floor(place(q))).alias("lo"), holds(F.ceil(place(q))).alias("hi")) for q in shares)), lambda s: s["lo"] | s["hi"])
    found = placed.select("value", F.explode(asked).alias("s")).select("value", "s.*")
    ends = found.groupBy("share").agg(F.max(F.when(F.col("lo"), F.col("value"))).alias("a"), F.max(F.when(F.col("hi"), F.col("value"))).alias("b"), F.max("place").alias("place"))
    return ends.select("share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.floor("place"))).alias("value"))


def month_errors(rows: DataFrame, month: Column, hour: str, actual: str, guesses: list[str]) -> DataFrame:
    """(month, hours, and for each guess its WAPE over hourly totals)."""
    hourly = rows.groupBy(month.alias("month"), hour).agg(*(F.sum(c).alias(c) for c in (actual, *guesses)))
    return hourly.groupBy("month").agg(F.count("*").alias("hours"), F.sum(actual).alias(actual), *(F.round(ratio(F.sum(F.abs(F.col(g) - F.col(actual))), F.sum(F.abs(actual))), 9).alias(f"wape_{g}") for g in guesses))

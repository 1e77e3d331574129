"""Grid searches, bootstrap and effects, as joins with small parameter tables and one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions.scalars import ratio


def scalar_grid(rows: DataFrame, actual: Column, predicted: Column, most: Column, lo: int = 70, hi: int = 140) -> DataFrame:
    """(factor_pct, wape, rank) for every factor lo..hi percent: one pass with a sum for each factor, so no row is copied."""
    scaled = lambda f: F.least(F.greatest(predicted * f / 100, F.lit(0.0)), most)
    sums = rows.agg(F.sum(F.abs(actual)).alias("base"), *(F.sum(F.abs(scaled(f) - actual)).alias(f"f{f}") for f in range(lo, hi + 1)))
    scored = sums.select("base", F.explode(F.array(*(F.struct(F.lit(f).alias("factor_pct"), F.col(f"f{f}").alias("error")) for f in range(lo, hi + 1)))).alias("x"))
    scored = scored.select("x.factor_pct", F.round(ratio(F.col("x.error"), F.col("base")), 9).alias("wape"))
    best = Window.orderBy("wape", F.abs(F.col("factor_pct") - 100), "factor_pct")  # a row for each factor
    return scored.withColumn("rank", F.row_number().over(best))


def calendar_coverage(rows: DataFrame, plant: str, hour: str) -> DataFrame:
    """(plant, day, observed, expected, coverage) for every day of the calendar between the first and the last hour, those without a row too."""
    day = F.to_date(hour)
    days = rows.agg(F.min(day).alias("a"), F.max(day).alias("z")).select(F.explode(F.sequence("a", "z")).alias("day"))
    counted = rows.groupBy(plant, day.alias("day")).agg(F.count("*").alias("n"))
    # every plant by every day is what is asked for; both are dimensions
    out = rows.select(plant).distinct().join(days).join(counted, [plant, "day"], "left").withColumn("observed", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select(plant, "day", "observed", F.lit(24).cast("long").alias("expected"), (F.col("observed") / 24).alias("coverage"))


def fold_gates(rows: DataFrame, by: list[str], plant: str, hour_index: str, least_hours: int, least_plants: int) -> DataFrame:
    """(by, rows, plants, hours, enough): whether each fold and role has the hours and plants that a run demands."""
    out = rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_distinct(plant).alias("plants"), F.count_distinct(hour_index).alias("hours"))
    return out.withColumn("enough", (F.col("hours") >= least_hours) & (F.col("plants") >= least_plants))


def day_bootstrap(rows: DataFrame, day: str, actual: Column, before: Column, after: Column, samples: int = 200) -> DataFrame:
    """(sample, gain): the gain in WAPE over days drawn with replacement, by draws that any engine can repeat.

    Rows are first summed by day; a draw is an integer hash of (sample, slot) modulo the number of days.
    """
    days = rows.groupBy(day).agg(F.sum(F.abs(actual)).alias("base"), F.sum(F.abs(before - actual)).alias("before"), F.sum(F.abs(after - actual)).alias("after"))
    days = days.withColumn("slot", F.row_number().over(Window.orderBy(day)) - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    draws = days.select(F.col("slot").alias("place"), "n").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    draw = ((F.col("sample").cast("long") * 7919 + F.col("place") * 104729 + 12345) * 48271 % 2147483647 % F.col("n")).cast("int")
    drawn = draws.select("sample", draw.alias("slot")).join(days.drop("n"), "slot")
    return drawn.groupBy("sample").agg(ratio(F.sum("before") - F.sum("after"), F.sum("base")).alias("gain"))


def interval_95(samples: DataFrame, value: str) -> DataFrame:
    return samples.agg(F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"))


def day_interval(rows: DataFrame, day: str, actual: Column, before: Column, after: Column, samples: int = 2000) -> DataFrame:
    """One row: the gain in WAPE over all rows, and its 95 percent interval and count over draws of days (as many as the reference takes)."""
    gain = ratio(F.sum(F.abs(before - actual)) - F.sum(F.abs(after - actual)), F.sum(F.abs(actual)))
    draws = day_bootstrap(rows, day, actual, before, after, samples)
    count = draws.agg(F.count("*").alias("draws"))
    return rows.agg(gain.alias("gain")).join(F.broadcast(interval_95(draws, "gain"))).join(F.broadcast(count))  # one row each


def orthogonal_effect(rows: DataFrame, outcome: Column, treatment: Column, hour_index: str, cluster_hours: int = 24) -> DataFrame:
    """One row: theta = sum(d y) / sum(d d) and its standard error clustered by blocks of hours.

    The score of a block is linear in theta, so blocks are summed once: sum(d y) and sum(d d) by block give everything.
    """
    origin = rows.agg(F.min(hour_index).alias("origin"))
    blocks = rows.join(F.broadcast(origin)).groupBy(F.floor((F.col(hour_index) - F.col("origin")) / cluster_hours).alias("block"))  # one row of one number
    sums = blocks.agg(F.sum(treatment * outcome).alias("dy"), F.sum(treatment * treatment).alias("dd"), F.count("*").alias("n"))
    total = sums.agg(F.sum("dy").alias("dy"), F.sum("dd").alias("dd"), F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("dy") * F.col("dy")).alias("yy"), F.sum(F.col("dy") * F.col("dd")).alias("yd"), F.sum(F.col("dd") * F.col("dd")).alias("ddd"))
    theta = F.col("dy") / F.nullif(F.col("dd"), F.lit(0.0))
    squares = F.col("yy") - 2 * theta * F.col("yd") + theta * theta * F.col("ddd")
    variance = F.col("k") / F.nullif(F.col("k") - 1, F.lit(0)) * squares / F.nullif(F.col("dd") * F.col("dd"), F.lit(0.0))
    out = total.withColumn("theta", theta).withColumn("se", F.sqrt(F.greatest(variance, F.lit(0.0))))
    return out.select("theta", "se", (F.col("theta") - 1.96 * F.col("se")).alias("low"), (F.col("theta") + 1.96 * F.col("se")).alias("high"), F.col("k").alias("blocks"), F.col("n").alias("rows"))

"""From source rows to an hourly panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions import scalars as S


def hourly_sum(rows: DataFrame, key: list[str], time: str, value: str) -> DataFrame:
    """Sums by key and full hour; exact copies of a row count once, and a sum of nulls only is null."""
    return rows.dropDuplicates().withColumn("hour", S.hour_floor(F.col(time))).groupBy(*key, "hour").agg(F.sum(value).alias(value), F.count("*").alias("n"))


def half_hours_to_hours(halves: DataFrame, key: list[str], time: str, values: list[str], intervals: int = 2) -> DataFrame:
    """Means by hour of half-hourly rows; hours with fewer than ``intervals`` half hours go."""
    hours = halves.withColumn("hour", S.hour_floor(F.col(time)))
    return hours.groupBy(*key, "hour").agg(*(F.avg(v).alias(v) for v in values), F.count_distinct(time).cast("long").alias("intervals")).where(F.col("intervals") >= intervals)


def pairwise_mean(x: Column, samples: int = 2) -> Column:
    """The mean, only where all samples are there and valid."""
    return F.when(F.count(x) == samples, F.avg(x))


def three_valued_any(flag: Column, samples: int = 2) -> Column:
    """True or false where all samples are known, else null."""
    return F.when((F.count("*") == samples) & (F.count(flag) == samples), F.bool_or(flag))


def count_reasons(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """One row: how many rows there are, how many each reason hits (a row may have several), how many none hits."""
    none = ~F.greatest(*(F.coalesce(c, F.lit(False)) for c in reasons.values()))
    return rows.agg(F.count("*").alias("rows"), *(F.count_if(c).alias(n) for n, c in reasons.items()), F.count_if(none).alias("valid"))


def whole_group_rejection(rows: DataFrame, key: list[str], bad: Column) -> DataFrame:
    """Rows whose whole group has no bad row."""
    bad_keys = rows.where(bad).select(*key).distinct()
    return rows.join(bad_keys, key, "left_anti")


def keep_one(rows: DataFrame, key: list[str], order: str, last: bool = True) -> DataFrame:
    """Of each key the row that comes last (or first) by an explicit order."""
    by = F.desc(order) if last else F.asc(order)
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(by))).where("_rn = 1").drop("_rn")


def null_profile(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, nulls, null_rate) in one pass."""
    counted = rows.agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    long = counted.select("rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns))).alias("x"))
    return long.select("x.column", "rows", "x.nulls", S.ratio(F.col("x.nulls").cast("double"), F.col("rows").cast("double")).alias("null_rate"))


def prefer_final(x: Column, version: Column, final: int = 1, provisional: int = 5) -> tuple[Column, Column]:
    """Aggregates over versions of one value: the final one, else the provisional one, and which it was."""
    best, spare = F.max(F.when(version == final, x)), F.max(F.when(version == provisional, x))
    return F.coalesce(best, spare), F.when(best.isNotNull(), final).when(spare.isNotNull(), provisional)


def weather_quality(weather: DataFrame, key: list[str], time: str, values: dict[str, tuple[float, float]], expected: int | None = None, least: float = 0.99) -> DataFrame:
    """One row: counts of repeated keys, nulls, values out of range and times off the hour; coverage; and whether all is well."""
    t = F.col(time)
    base = weather.agg(
        F.count("*").alias("rows"),
        (F.count("*") - F.count_distinct(*key, time)).alias("repeated"),
        *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in values),
        *(F.count_if(~F.col(c).between(lo, hi)).alias(f"range_{c}") for c, (lo, hi) in values.items()),
        F.count_if(t != S.hour_floor(t)).alias("off_hour"),
        F.count_distinct(time).alias("hours"),
    )
    faults = sum((F.col(c) for c in base.columns if c.startswith(("null_", "range_"))), F.col("repeated") + F.col("off_hour"))
    cover = S.ratio(F.col("hours").cast("double"), F.lit(float(expected))) if expected else F.lit(1.0)
    return base.withColumn("coverage", cover).withColumn("valid", (faults == 0) & (F.col("rows") > 0) & (F.col("coverage") >= least))

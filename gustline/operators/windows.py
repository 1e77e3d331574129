"""Ordered analytics by exact hours: frames are RANGEs over an hour index, so gaps are never bridged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hours_back(key: list[str], hour: str, first: int, last: int):
    return Window.partitionBy(*key).orderBy(hour).rangeBetween(-first, -last)


def exact_lag(value: Column, key: list[str], hour: str, hours: int) -> Column:
    """The value exactly so many hours before; null across a gap."""
    return F.max(value).over(hours_back(key, hour, hours, hours))


def gradient(value: Column, key: list[str], hour: str, hours: int) -> Column:
    return (value - exact_lag(value, key, hour, hours)) / hours


def rolling(rows: DataFrame, key: list[str], hour: str, values: list[str], hours: int) -> DataFrame:
    """Adds mean and population deviation over exactly the last ``hours`` hours (null unless all are there), and whether they are."""
    frame = hours_back(key, hour, hours - 1, 0)
    complete = F.lit(True)
    for v in values:
        complete = complete & (F.count(v).over(frame) == hours)
    rows = rows.withColumn(f"complete_{hours}h", complete.cast("int"))
    done = F.col(f"complete_{hours}h") == 1
    return rows.withColumns({f"{v}_{n}_{hours}h": F.when(done, f(v).over(frame)) for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))})


def context_complete(key: list[str], hour: str, value: str, hours: tuple[int, ...] = (3, 6), lags: tuple[int, ...] = (1, 3, 6)) -> Column:
    """1 where all windows are complete and all lags are there."""
    ok = F.lit(True)
    for h in hours:
        ok = ok & (F.count(value).over(hours_back(key, hour, h - 1, 0)) == h)
    for h in lags:
        ok = ok & exact_lag(F.col(value), key, hour, h).isNotNull()
    return ok.cast("int")


def gaps(rows: DataFrame, key: list[str], hour: str) -> DataFrame:
    """By key: rows, gaps, and hours missing in them."""
    step = F.col(hour) - F.lag(hour).over(Window.partitionBy(*key).orderBy(hour))
    each = rows.withColumn("_step", step)
    return each.groupBy(*key).agg(F.count("*").alias("rows"), F.count_if(F.col("_step") > 1).alias("gaps"), F.coalesce(F.sum(F.when(F.col("_step") > 1, F.col("_step") - 1)), F.lit(0)).alias("missing_hours"))


def overlapping_segments(segments: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Segments that begin before an earlier one of their key has ended."""
    before = Window.partitionBy(*key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("_last", F.max(end).over(before)).where(F.col(start) < F.col("_last")).drop("_last")


def stratified_sample(rows: DataFrame, outer: str, inner: str, order: list[Column], n: int) -> DataFrame:
    """n rows spread over strata: rank within (outer, inner), then within outer, then the lowest ranks."""
    first = F.row_number().over(Window.partitionBy(outer, inner).orderBy(*order))
    second = F.row_number().over(Window.partitionBy(outer).orderBy("inner_rank", inner, *order))
    # no stratum gives more than n rows, so the rest is left out before the second ranking, and already before the first one's shuffle
    ranked = rows.withColumn("inner_rank", first).where(F.col("inner_rank") <= n).withColumn("outer_rank", second).where(F.col("outer_rank") <= n)
    return ranked.orderBy("outer_rank", outer, inner).limit(n)


def positions(n_rows: Column, rank: Column, count: int) -> Column:
    """Whether a zero-based rank is among ``count`` evenly spaced ones, from the first to the last."""
    whole = F.greatest(n_rows - 1, F.lit(1))
    step = F.lit(max(count - 1, 1))
    return (n_rows <= count) | (F.floor((rank * step) / whole) != F.floor(((rank - 1) * step) / whole)) | (rank == 0)


def carry_forward(value: Column, order: str, key: list[str]) -> Column:
    """The last known value up to each row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))

"""Allocation of plant values to buses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gustline.functions.scalars import ratio
from gustline.operators.checks import ContractError


def allocation_shares(members: DataFrame, plant: str, bus: str, capacity: str) -> DataFrame:
    """(plant, bus, capacity, share): shares of a plant's capacity; they sum to one."""
    each = members.groupBy(plant, bus).agg(F.sum(capacity).alias(capacity))
    return each.withColumn("share", ratio(F.col(capacity), F.sum(capacity).over(Window.partitionBy(plant))))


def check_shares(shares: DataFrame, plant: str, tolerance: float = 1e-6) -> DataFrame:
    """Plants whose shares don't sum to one."""
    return shares.groupBy(plant).agg(F.sum("share").alias("total")).where(F.abs(F.col("total") - 1) > tolerance)


def accumulate(values: DataFrame, shares: DataFrame, plant: str, bus: str, value: str) -> DataFrame:
    """(bus, value, plants): each plant's value dealt by its shares and summed by bus."""
    dealt = values.join(shares, plant)
    return dealt.groupBy(bus).agg(F.sum(F.col(value) * F.col("share")).alias(value), F.count_distinct(plant).alias("plants"))


def recomputed(submitted: DataFrame, values: DataFrame, shares: DataFrame, plant: str, bus: str, value: str, tolerance: float = 1e-6, relative: float | None = None) -> DataFrame:
    """(bus, submitted, value, fault) of every bus that either side names: the value that counts is the one dealt here, never the submitted one.

    The fault is null where both agree within a tolerance relative to the larger of 1 and the value, or, where ``relative`` is given, within the larger of an absolute tolerance and that part of the value; else missing (not submitted), unknown (no plant deals to it), repeated (submitted several times) or differs. A
    submitted value that is null or not finite differs.
    """
    mine = accumulate(values, shares, plant, bus, value).select(F.col(bus), F.col(value), F.lit(True).alias("_dealt"))
    theirs = submitted.groupBy(bus).agg(F.sum(value).alias("submitted"), F.count("*").alias("_n"))
    out = mine.join(theirs, bus, "full")
    close = F.abs(F.col("submitted") - F.col(value)) <= F.greatest(F.lit(tolerance), F.abs(F.col(value)) * (tolerance if relative is None else relative))
    fault = F.when(F.col("_n").isNull(), "missing").when(F.col("_dealt").isNull(), "unknown").when(F.col("_n") > 1, "repeated").when(~F.coalesce(close & ~F.isnan("submitted"), F.lit(False)), "differs")
    return out.select(bus, "submitted", value, fault.alias("fault"))


def require_one_state(rows: DataFrame, bus: str, state: str) -> DataFrame:
    """Rows, if no bus has more than one state."""
    if not rows.groupBy(bus).agg(F.count_distinct(state).alias("n")).where("n > 1").isEmpty():
        raise ContractError(f"a {bus} has several values of {state}")
    return rows


def mapping_coverage(members: DataFrame, plant: str, bus: str, capacity: str) -> DataFrame:
    """(plant, coverage, buses): the percentage of a plant's capacity that has a bus."""
    mapped = F.sum(F.when(F.col(bus).isNotNull(), F.col(capacity)).otherwise(F.lit(0.0)))
    return members.groupBy(plant).agg((ratio(mapped, F.sum(capacity)) * 100).alias("coverage"), F.count_distinct(bus).alias("buses"))


def bus_states(rows: DataFrame, bus: str, value: str, state: str) -> DataFrame:
    """(bus, value, consistent, state): sums by bus, and the state where all its rows have the same."""
    one = F.min(state) == F.max(state)
    return rows.groupBy(bus).agg(F.sum(value).alias(value), F.coalesce(one, F.lit(False)).alias("consistent"), F.when(one, F.min(state)).alias(state))

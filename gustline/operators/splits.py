"""Splits in time: by share, expanding folds, calendar blocks, and their coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.operators.checks import few


def ranked_hours(rows: DataFrame, hour: str) -> DataFrame:
    """(hour, rank from 0, n): distinct hours only, so ordering them is small whatever the number of rows."""
    hours = rows.select(hour).distinct()
    return hours.withColumn("rank", F.row_number().over(Window.orderBy(hour)).cast("long") - 1).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))


def share_split(rows: DataFrame, hour: str, first: int = 70, second: int = 85) -> DataFrame:
    """Adds ``part`` (train, validation, test) by shares of distinct hours; an hour is never split."""
    ranks = ranked_hours(rows, hour)
    train = F.greatest(F.lit(1), F.floor(F.col("n") * first / 100))
    valid = F.least(F.greatest(train + 1, F.floor(F.col("n") * second / 100)), F.col("n") - 1)
    part = F.when(F.col("rank") < train, "train").when(F.col("rank") < valid, "validation").otherwise("test")
    return rows.join(ranks.select(hour, part.alias("part")), hour)


def block_of(rank: Column, n: Column, blocks: int) -> Column:
    """Which of ``blocks`` nearly equal runs a rank lies in; the first n mod blocks are one longer."""
    size, longer = F.floor(n / blocks), n % blocks
    edge = longer * (size + 1)
    return F.when(rank < edge, F.floor(rank / (size + 1))).otherwise(longer + F.floor((rank - edge) / F.nullif(size, F.lit(0))))


def expanding_folds(rows: DataFrame, hour: str, hour_index: str, folds: int, gap_hours: int) -> DataFrame:
    """(fold, start, end, cutoff): evaluation blocks behind a warm-up block; a fold trains on what lies before its cutoff."""
    ranks = ranked_hours(rows, hour_index).withColumn("fold", block_of(F.col("rank"), F.col("n"), folds + 1))
    return ranks.where("fold > 0").groupBy("fold").agg(F.min(hour_index).alias("start"), F.max(hour_index).alias("end")).withColumn("cutoff", F.col("start") - gap_hours)


def fold_rows(rows: DataFrame, folds: DataFrame, hour_index: str) -> DataFrame:
    """(fold, train_rows, evaluation_rows); there are as many folds as the caller asked for."""
    both = rows.join(few(folds), (F.col(hour_index) < F.col("cutoff")) | F.col(hour_index).between(F.col("start"), F.col("end")))
    return both.groupBy("fold").agg(F.count_if(F.col(hour_index) < F.col("cutoff")).alias("train_rows"), F.count_if(F.col(hour_index).between(F.col("start"), F.col("end"))).alias("evaluation_rows"))


def assign_blocks(rows: DataFrame, blocks: DataFrame, time: str) -> DataFrame:
    """Rows with the fold and role of the calendar block [block_start, block_end) they lie in; the block table is a few declared rows."""
    return rows.join(few(blocks), (F.col(time) >= F.col("block_start")) & (F.col(time) < F.col("block_end")))


def contiguous_months(months: DataFrame, month: str, expected: int = 12) -> DataFrame:
    """One row: how many months there are and whether they are that many without a gap."""
    step = F.months_between(F.to_date(F.concat(F.col(month), F.lit("-01"))), F.to_date(F.concat(F.lag(month).over(Window.orderBy(month)), F.lit("-01"))))
    each = months.select(month).distinct().withColumn("step", step)
    return each.agg(F.count("*").alias("months"), ((F.count("*") == expected) & (F.coalesce(F.max("step"), F.lit(1)) == 1) & (F.coalesce(F.min("step"), F.lit(1)) == 1)).alias("contiguous"))


def purge(train: DataFrame, start: Column, hour_index: str, gap_hours: int) -> DataFrame:
    """Training rows that end more than the gap before validation begins."""
    return train.where(F.col(hour_index) < start - gap_hours)

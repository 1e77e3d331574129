"""Contracts of tables: required columns, unique keys, cardinalities, subsets."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table breaks its contract."""


def few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """The table, marked for broadcast if a count shows that it has at most so many rows; larger ones are left to the planner."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ContractError(f"missing columns: {missing}")
    return df


def find_name(have: list[str], names: list[str]) -> str:
    """The one of what is there that has one of the names, whatever its case, marks on letters or outer space."""
    flat = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).strip().casefold()
    known = {flat(c): c for c in have}
    for name in names:
        if flat(name) in known:
            return known[flat(name)]
    raise ContractError(f"none of {names} in {have}")


def find_column(df: DataFrame, names: list[str]) -> str:
    """The column that has one of the names, as ``find_name`` finds it."""
    return find_name(df.columns, names)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    out = df.withColumnsRenamed(names)
    if len(set(out.columns)) < len(out.columns) or not all(out.columns):
        raise ContractError(f"names must be unique and not empty: {out.columns}")
    return out


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(keys).agg(F.count("*").alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if not duplicates(df, keys).isEmpty():
        raise ContractError(f"keys repeat: {keys}")
    return df


def require_subset(some: DataFrame, whole: DataFrame, keys: list[str]) -> None:
    if not some.join(whole, keys, "left_anti").isEmpty():
        raise ContractError(f"{keys}: not a subset")


def require_disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    if not a.join(b, keys, "left_semi").isEmpty():
        raise ContractError(f"{keys}: the tables overlap")


def set_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes of both sets of keys, of what they share, and of what only one has."""
    tagged = a.distinct().withColumn("in_a", F.lit(1)).unionByName(b.distinct().withColumn("in_b", F.lit(1)), allowMissingColumns=True)
    each = tagged.groupBy(a.columns).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return each.agg(one(F.col("in_a").isNotNull()).alias("in_a"), one(F.col("in_b").isNotNull()).alias("in_b"), one(both).alias("in_both"), one(F.col("in_b").isNull()).alias("only_a"), one(F.col("in_a").isNull()).alias("only_b"))

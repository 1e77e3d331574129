"""Tables in and out: Parquet and delimited text, immutable outputs, logical hashes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.functions.scalars import fingerprint
from gustline.operators.joins import union_all


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Parquet, or delimited text with a header, whose delimiter is the commonest of ``; , tab |`` in its first line; all text columns stay text."""
    low = path.lower().rstrip("/")
    if low.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif low.endswith((".csv", ".txt")):
        head = spark.read.text(path).first()
        line = head[0] if head else ""
        sep = max(";,\t|", key=line.count)
        df = spark.read.csv(path, header=True, sep=sep, inferSchema=False, encoding=encoding)
        df = df.withColumnsRenamed({c: c.lstrip("﻿").strip() for c in df.columns})
    else:
        raise ValueError(f"not a table: {path}")
    return df.select(*columns) if columns else df


def read_many(spark: SparkSession, paths: list[str], columns: list[str] | None = None) -> DataFrame:
    return union_all([read_table(spark, p, columns) for p in paths])


def write_once(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Writes Parquet; an output that is there already is an error. Spark's commit makes it appear as a whole."""
    df.write.mode("errorifexists").partitionBy(*(partition_by or [])).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Writes only the partitions that the table holds, over what they had (late corrections)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def logical_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (rows, digest): a hash that doesn't depend on the order of rows, in constant space: sums of four parts of each row's SHA-256."""
    row = fingerprint(*(F.col(c) for c in columns))
    parts = [F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    sums = df.agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(p), F.lit(0)).alias(f"s{k}") for k, p in enumerate(parts)))
    return sums.select("rows", F.sha2(F.concat_ws("|", "rows", *(F.col(f"s{k}").cast("string") for k in range(4))), 256).alias("digest"))


def canonical_json(value) -> str:
    """JSON with sorted keys, without spaces, NaN or infinity."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False)

"""Registered queries, and the tables that most of them start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.functions import scalars as S
from gustline.functions import wind as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CAPACITY, AVAILABILITY = 450.0, 0.95

PANEL = """panel AS (
  SELECT event_type AS plant, date_trunc('hour', ts) AS hour, sum(value) AS gen, count(*) AS n,
         2.0::DOUBLE * ((min(event_id) * 7) % 31 - 15) AS u, 1.0::DOUBLE * ((min(event_id) * 11) % 23 - 11) AS v,
         CAST(epoch(date_trunc('hour', ts)) / 3600 AS BIGINT) AS hour_idx
  FROM events GROUP BY event_type, date_trunc('hour', ts))"""
_CURVE = "CASE WHEN w < 3 OR w >= 25 THEN 0.0::DOUBLE WHEN w < 12 THEN 427.5::DOUBLE * (pow(w, 3) - 27) / 1701 ELSE 427.5::DOUBLE END"
SCORED = f"""{PANEL}, winds AS (SELECT *, sqrt(u * u + v * v) AS w FROM panel), scored AS (
  SELECT *, {_CURVE} AS base,
         CASE WHEN w < 3 OR w >= 25 THEN 0.0::DOUBLE ELSE least(greatest({_CURVE} + 10, 0), 427.5::DOUBLE) END AS pred,
         CASE WHEN w < 3 THEN '<3' WHEN w < 6 THEN '3-6' WHEN w < 9 THEN '6-9' WHEN w < 12 THEN '9-12' WHEN w < 25 THEN '12-25' ELSE '>=25' END AS band
  FROM winds)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL it is held against."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour: a plant-hour panel with wind made from the smallest event id."""
    events = table(spark, sf_dir, "events")
    out = events.groupBy(F.col("event_type").alias("plant"), S.hour_floor(F.col("ts")).alias("hour")).agg(F.sum("value").alias("gen"), F.count("*").alias("n"), F.min("event_id").alias("first"))
    u, v = ((F.col("first") * k) % m - s for k, m, s in ((7, 31, 15), (11, 23, 11)))
    return out.select("plant", "hour", "gen", "n", (u * F.lit(2.0)).alias("u"), (v * F.lit(1.0)).alias("v"), S.hour_index(F.col("hour")).alias("hour_idx"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with wind speed, band, the power curve's estimate and a bounded correction of it."""
    rows = panel(spark, sf_dir).withColumn("w", W.speed(F.col("u"), F.col("v")))
    rows = rows.withColumns({"cap": F.lit(CAPACITY), "avail": F.lit(AVAILABILITY), "band": W.band(F.col("w"))})
    rows = rows.withColumn("base", W.power(F.col("w"), F.col("cap"), F.col("avail")))
    return rows.withColumn("pred", W.bounded(F.col("base"), F.lit(10.0), F.col("w"), F.col("cap"), F.col("avail")))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, so that engines that add in another order agree."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)

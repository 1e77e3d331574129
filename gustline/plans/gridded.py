"""Gridded files: written from events, read back as long rows, and as weather at the places of plants."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustline.functions import scalars as S
from gustline.plans.registry import query, rounded, table
from gustline.shared import fresh_path
from gustline.sources import grids

_VARIABLES = {"u100": ["u100", "100m_u_component_of_wind"], "temperature_2m": ["temperature_2m", "t2m"]}

_GRID = """c AS (SELECT date_trunc('hour', ts) AS t, -5 - 0.25::DOUBLE * (event_id % 3) AS latitude, 324 + 0.25::DOUBLE * (user_id % 4) AS longitude, count(CASE WHEN event_id % 5 <> 0 THEN 1 END) AS n1, sum(CASE WHEN event_id % 5 <> 0 THEN value END) AS u1, count(*) AS n5, sum(value) AS u5 FROM events GROUP BY 1, 2, 3),
a AS (SELECT DISTINCT t FROM c), la AS (SELECT DISTINCT CAST(t AS DATE) AS d, latitude FROM c), lo AS (SELECT DISTINCT CAST(t AS DATE) AS d, longitude FROM c),
grid AS (SELECT a.t, la.latitude, lo.longitude, CASE WHEN n1 > 0 THEN 1 WHEN n5 > 0 THEN 5 END AS version, coalesce(u1, u5) AS u100, 280 + 0.5::DOUBLE * CASE WHEN n1 > 0 THEN n1 ELSE n5 END AS temperature_2m
FROM a JOIN la ON la.d = CAST(a.t AS DATE) JOIN lo ON lo.d = la.d LEFT JOIN c USING (t, latitude, longitude))"""


def _written(spark, sf_dir) -> str:
    """A file a day: sums of events by hour and cell, in a final version that lacks some events and a provisional one that has all; a third variable that nobody asks for."""
    events = table(spark, sf_dir, "events")
    lat, lon = F.lit(-5.0) - F.col("event_id") % 3 * 0.25, F.lit(324.0) + F.col("user_id") % 4 * 0.25
    versions = F.when(F.col("event_id") % 5 != 0, F.array(F.lit(1), F.lit(5))).otherwise(F.array(F.lit(5)))
    rows = events.select(S.hour_floor(F.col("ts")).alias("t"), lat.alias("latitude"), lon.alias("longitude"), F.explode(versions).alias("version"), "value")
    cells = rows.groupBy("t", "latitude", "longitude", "version").agg(F.sum("value").alias("u100"), (F.count("*") * 0.5 + 280).alias("t2m"), F.max("value").alias("gust"))
    folder = fresh_path(spark, "grids")
    grids.write_grids(cells.withColumn("day", F.date_format("t", "yyyy-MM-dd")), folder, "day", ["u100", "t2m", "gust"], {"t2m": (0.5, 1000.0)}).count()
    return folder


@query(f"WITH {_GRID} SELECT t, latitude, longitude, version, round(u100, 6) AS u100, round(temperature_2m, 6) AS temperature_2m FROM grid")
def gridded_rows(spark, sf_dir):
    """All cells of all files; those that no version has are null."""
    return rounded(grids.read_grids(spark, _written(spark, sf_dir), _VARIABLES).drop("file"))


@query(f"""WITH {_GRID}, p AS (SELECT s_nationkey AS plant, s_suppkey AS place, -5 - 0.1::DOUBLE * (s_suppkey % 6) AS lat, -36 + 0.08::DOUBLE * (s_suppkey % 10) AS lon, CASE WHEN s_suppkey % 9 <> 0 AND s_acctbal > 0 THEN CAST(s_acctbal AS DOUBLE) ELSE 1 END AS w,
CASE WHEN s_suppkey % 3 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 20 AS INTEGER)) END AS "start", CASE WHEN s_suppkey % 4 <> 0 THEN TIMESTAMP '2024-01-06' + to_days(CAST(s_suppkey % 20 AS INTEGER)) END AS "end" FROM supplier),
n AS (SELECT *, -5 - 0.25::DOUBLE * least(round((s.place % 6) * 0.1 / 0.25), 2) AS near_lat, -36 + 0.25::DOUBLE * least(round((s.place % 10) * 0.08 / 0.25), 3) AS near_lon FROM p s),
k AS (SELECT *, 2 * 6371.0088 * asin(sqrt(pow(sin(radians(near_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(near_lat)) * pow(sin(radians(near_lon - lon) / 2), 2))) AS km FROM n),
m AS (SELECT k.*, g.t, g.u100, g.temperature_2m AS t2, g.version FROM k JOIN grid g ON g.latitude = near_lat AND g.longitude = near_lon + 360 WHERE ("start" IS NULL OR g.t >= "start") AND ("end" IS NULL OR g.t < "end" + INTERVAL 1 DAY))
SELECT plant, t, round(sum(u100 * w) / sum(CASE WHEN u100 IS NOT NULL THEN w END), 6) AS u100, round(sum(t2 * w) / sum(CASE WHEN t2 IS NOT NULL THEN w END), 6) AS temperature_2m, round(sum(near_lat * w) / sum(w), 6) AS grid_latitude, round(sum(near_lon * w) / sum(w), 6) AS grid_longitude,
round(sum(km * w) / sum(w), 6) AS km, max(version) AS version, count(*) AS places FROM m GROUP BY 1, 2""")
def gridded_weather(spark, sf_dir):
    """Suppliers as places of nations, each with the nearest cell while its relation lasts, weighted by capacity."""
    k = F.col("s_suppkey")
    day = lambda first: F.lit(first).cast("timestamp_ntz") + F.make_dt_interval((k % 20).cast("int"))
    places = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("plant"), k.alias("place"), (F.lit(-5.0) - k % 6 * 0.1).alias("latitude"), (F.lit(-36.0) + k % 10 * 0.08).alias("longitude"), F.when(k % 9 != 0, F.col("s_acctbal")).alias("capacity"),
        F.when(k % 3 != 0, day("2024-01-01")).alias("start"), F.when(k % 4 != 0, day("2024-01-06")).alias("end"),
    )
    folder = _written(spark, sf_dir)
    grid = grids.read_grids(spark, folder, _VARIABLES)
    return rounded(grids.weather_at(grid, grids.read_axes(spark, folder), places, list(_VARIABLES), 0.25))

"""Sinks in one order, and hashes that the order is part of."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustline.plans.registry import PANEL, panel, query, rounded, table
from gustline.shared import fresh_path
from gustline.sources import ordered


def _written(spark, sf_dir):
    path = fresh_path(spark, "ordered")
    ordered.write_ordered(panel(spark, sf_dir).select("plant", "hour", "gen"), path, ["hour", "plant"])
    return path


@query(f"WITH {PANEL} SELECT plant, hour, round(gen, 6) AS gen, row_number() OVER (ORDER BY hour, plant) AS position FROM panel")
def ordered_sink(spark, sf_dir):
    """The panel written in the order of hour and plant; places are read off the parts' names and the rows as they lie."""
    return rounded(ordered.read_ordered(spark, _written(spark, sf_dir)))


@query(f"WITH {PANEL} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS faults FROM panel")
def ordered_sink_faults(spark, sf_dir):
    """The written panel's rows, and the parts that are out of order or not as recorded: none."""
    return ordered.order_faults(spark, _written(spark, sf_dir), ["hour", "plant"]).agg(F.sum("rows").alias("rows"), F.count("fault").alias("faults"))


_ORDERED = """p AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS k, event_id, event_type, value FROM events),
h AS (SELECT sha256('=' || k || '|=' || event_id || '|=' || event_type || '|=' || printf('%.9g', value)) AS h FROM p),
d AS (SELECT count(*) AS rows, sum(CAST('0x' || h[1:8] AS UBIGINT)) AS a, sum(CAST('0x' || h[9:16] AS UBIGINT)) AS b, sum(CAST('0x' || h[17:24] AS UBIGINT)) AS c, sum(CAST('0x' || h[25:32] AS UBIGINT)) AS e FROM h)"""


@query(f"WITH {_ORDERED} SELECT rows, sha256(rows || '|' || CAST(a AS BIGINT) || '|' || CAST(b AS BIGINT) || '|' || CAST(c AS BIGINT) || '|' || CAST(e AS BIGINT)) AS digest FROM d")
def ordered_hash(spark, sf_dir):
    """Events in the order of time and id, values with nine significant digits."""
    return ordered.ordered_hash(table(spark, sf_dir, "events"), ["ts", "event_id"], ["event_id", "event_type", "value"])

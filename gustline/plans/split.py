"""Splits in time, assignments and their coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustline.functions import scalars as S
from gustline.operators import joins, splits
from gustline.operators.checks import set_comparison
from gustline.plans.registry import PANEL, panel, query, rounded, table

_RANKS = f"{PANEL}, hours AS (SELECT DISTINCT hour_idx FROM panel), ranks AS (SELECT hour_idx, row_number() OVER (ORDER BY hour_idx) - 1 AS rank, count(*) OVER () AS n FROM hours)"


@query(f"""WITH {_RANKS}, b AS (SELECT *, greatest(1, n * 70 // 100) AS a FROM ranks), c AS (SELECT *, least(greatest(a + 1, n * 85 // 100), n - 1) AS z FROM b)
SELECT CASE WHEN rank < a THEN 'train' WHEN rank < z THEN 'validation' ELSE 'test' END AS part, count(*) AS rows, min(hour_idx) AS first_hour, max(hour_idx) AS last_hour FROM panel JOIN c USING (hour_idx) GROUP BY 1""")
def temporal_split_701515(spark, sf_dir):
    rows = splits.share_split(panel(spark, sf_dir), "hour_idx")
    return rows.groupBy("part").agg(F.count("*").alias("rows"), F.min("hour_idx").alias("first_hour"), F.max("hour_idx").alias("last_hour"))


_FOLDS = f"""{_RANKS}, blocks AS (SELECT hour_idx, CASE WHEN rank < (n % 5) * (n // 5 + 1) THEN rank // (n // 5 + 1) ELSE n % 5 + (rank - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM ranks),
folds AS (SELECT CAST(fold AS BIGINT) AS fold, min(hour_idx) AS start, max(hour_idx) AS "end", min(hour_idx) - 6 AS cutoff FROM blocks WHERE fold > 0 GROUP BY 1)"""


@query(f"""WITH {_FOLDS} SELECT fold, count(CASE WHEN hour_idx < cutoff THEN 1 END) AS train_rows, count(CASE WHEN hour_idx BETWEEN start AND "end" THEN 1 END) AS evaluation_rows FROM panel, folds GROUP BY 1""")
def expanding_splits(spark, sf_dir):
    rows = panel(spark, sf_dir)
    folds = splits.expanding_folds(rows, "hour", "hour_idx", 4, 6)
    return splits.fold_rows(rows, folds, "hour_idx")


_CALENDAR = [("train", "2024-01-01", "2024-01-15"), ("validation", "2024-01-15", "2024-01-22"), ("test", "2024-01-22", "2024-02-01")]
_BLOCKS = "blocks(block, block_start, block_end) AS (VALUES " + ", ".join(f"('{r}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for r, a, b in _CALENDAR) + ")"


def _blocks(spark):
    rows = spark.createDataFrame(_CALENDAR, "block string, a string, b string")
    return rows.select("block", F.col("a").cast("timestamp_ntz").alias("block_start"), F.col("b").cast("timestamp_ntz").alias("block_end"))


@query(f"WITH {PANEL}, {_BLOCKS} SELECT plant, block, count(*) AS rows, round(sum(gen), 6) AS gen FROM panel JOIN blocks ON hour >= block_start AND hour < block_end GROUP BY 1, 2")
def fold_assignments(spark, sf_dir):
    rows = splits.assign_blocks(panel(spark, sf_dir), _blocks(spark), "hour")
    return rounded(rows.groupBy("plant", "block").agg(F.count("*").alias("rows"), F.sum("gen").alias("gen")))


@query(f"""WITH {PANEL}, {_BLOCKS}, seg AS (SELECT plant, min(hour) AS valid_from, max(hour) + INTERVAL 1 HOUR AS valid_to FROM panel GROUP BY 1),
e AS (SELECT block, sum(greatest(epoch(least(block_end, valid_to)) - epoch(greatest(block_start, valid_from)), 0) / 3600) AS hours FROM blocks JOIN seg ON valid_from < block_end AND valid_to > block_start GROUP BY 1),
o AS (SELECT block, count(*) AS observed FROM panel JOIN blocks ON hour >= block_start AND hour < block_end GROUP BY 1)
SELECT block, round(hours, 6) AS expected, observed, round(observed / nullif(hours, 0), 6) AS coverage FROM e JOIN o USING (block)""")
def fold_coverage(spark, sf_dir):
    rows, blocks = panel(spark, sf_dir), _blocks(spark)
    seg = rows.groupBy("plant").agg(F.min("hour").alias("valid_from"), (F.max("hour") + F.make_dt_interval(F.lit(0), F.lit(1))).alias("valid_to"))
    expected = joins.expected_hours(blocks, seg)
    observed = splits.assign_blocks(rows, blocks, "hour").groupBy("block").agg(F.count("*").alias("observed"))
    out = expected.join(observed, "block").withColumn("coverage", S.ratio(F.col("observed").cast("double"), F.col("hours")))
    return rounded(out.select("block", F.col("hours").alias("expected"), "observed", "coverage"))


_MONTHS = "m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders)"


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS rows, count(DISTINCT o_custkey) AS customers, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, min(CAST(o_orderdate AS DATE)) AS f FROM orders GROUP BY 1)
SELECT month, rows, customers, days, round(days::DOUBLE / day(last_day(f)), 6) AS coverage FROM m""")
def month_inventory(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("month", S.month_label(F.col("o_orderdate"))).withColumn("day", F.to_date("o_orderdate"))
    m = rows.groupBy("month").agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("customers"), F.count_distinct("day").alias("days"), F.min("day").alias("first"))
    return rounded(m.select("month", "rows", "customers", "days", (F.col("days") / F.dayofmonth(F.last_day("first"))).alias("coverage")))


@query("""WITH x AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_custkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45) AS matched FROM orders)
SELECT month, count(*) AS rows, count(DISTINCT o_custkey) AS customers, count(CASE WHEN matched THEN 1 END) AS matched FROM x GROUP BY 1""")
def coverage_by_month(spark, sf_dir):
    large = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(1))
    rows = table(spark, sf_dir, "orders").join(large, "o_orderkey", "left")
    return rows.groupBy(S.month_label(F.col("o_orderdate")).alias("month")).agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("customers"), F.count("hit").alias("matched"))


@query(f"""WITH {_MONTHS}, s AS (SELECT month, datediff('month', strptime(lag(month) OVER (ORDER BY month), '%Y-%m'), strptime(month, '%Y-%m')) AS step FROM m)
SELECT count(*) AS months, count(*) = 12 AND max(coalesce(step, 1)) = 1 AS contiguous FROM s""")
def contiguous_months(spark, sf_dir):
    months = table(spark, sf_dir, "orders").select(S.month_label(F.col("o_orderdate")).alias("month")).distinct()
    return splits.contiguous_months(months, "month")


@query("""WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT (SELECT count(*) FROM a) AS in_a, (SELECT count(*) FROM b) AS in_b, (SELECT count(*) FROM a JOIN b USING (k)) AS in_both,
(SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_a, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_b""")
def set_equality_checks(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return set_comparison(a, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")))


@query("""SELECT 'customer' AS origin, c_custkey AS key, c_nationkey AS nation, CAST(NULL AS BIGINT) AS user_id FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, NULL FROM supplier
UNION ALL SELECT 'event', event_id, NULL, user_id FROM events""")
def union_outer_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    e = table(spark, sf_dir, "events").select(F.lit("event").alias("origin"), F.col("event_id").alias("key"), "user_id")
    return joins.union_all([c, s, e])

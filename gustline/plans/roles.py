"""Coverage of declared blocks, a job's rows against what it was given, and the final block judged by frozen intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustline.operators import roles
from gustline.plans.registry import SCORED, query, rounded, scored, table

#: Blocks of two folds and the reserve, in days of January 2024, the last not included.
_DAYS = [("0", "train", 1, 8), ("0", "early_stopping", 9, 11), ("0", "evaluation", 12, 15), ("1", "train", 1, 15), ("1", "early_stopping", 16, 18), ("1", "evaluation", 19, 21), ("reserved", "calibration", 21, 25), ("reserved", "final_test", 25, 31), ("reserved", "unused", 31, 32)]
_BLOCKS = "blocks(fold, role, a, z) AS (VALUES " + ", ".join(f"('{f}', '{r}', {a}, {z})" for f, r, a, z in _DAYS) + "), bl AS (SELECT fold, role, TIMESTAMP '2024-01-01' + to_days(a - 1) AS block_start, TIMESTAMP '2024-01-01' + to_days(z - 1) AS block_end FROM blocks)"


def _blocks(spark):
    day = lambda c: F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col(c).cast("int") - 1)
    return spark.createDataFrame(_DAYS, "fold string, role string, a int, z int").select("fold", "role", day("a").alias("block_start"), day("z").alias("block_end"))


@query(f"""WITH {_BLOCKS}, ev AS (SELECT user_id AS plant, date_trunc('hour', ts) AS hour FROM events GROUP BY 1, 2), span AS (SELECT plant, min(hour) AS f, max(hour) + INTERVAL 1 HOUR AS l FROM ev GROUP BY 1),
seg AS (SELECT plant, f AS a, least(l, f + INTERVAL 254 HOUR + INTERVAL 30 MINUTE) AS z FROM span UNION ALL SELECT plant, f + INTERVAL 264 HOUR, l FROM span WHERE l > f + INTERVAL 264 HOUR),
e AS (SELECT fold, role, CAST(sum(floor((epoch(least(block_end, z)) - epoch(greatest(block_start, a))) / 3600)) AS BIGINT) AS expected FROM bl JOIN seg ON a < block_end AND z > block_start GROUP BY 1, 2),
o AS (SELECT fold, role, count(*) AS rows, count(DISTINCT plant) AS plants, count(DISTINCT hour) AS hours FROM ev JOIN bl ON hour >= block_start AND hour < block_end GROUP BY 1, 2),
r AS (SELECT fold, role, coalesce(rows, 0) AS rows, coalesce(plants, 0) AS plants, coalesce(hours, 0) AS hours, coalesce(expected, 0) AS expected, coalesce(rows / nullif(expected, 0), 0) AS coverage FROM bl LEFT JOIN o USING (fold, role) LEFT JOIN e USING (fold, role))
SELECT fold, role, rows, plants, hours, expected, round(coverage, 6) AS coverage, CASE WHEN rows = 0 THEN 'empty' WHEN hours < 50 THEN 'hours' WHEN plants < 100 THEN 'plants' WHEN coverage < 0.09 THEN 'coverage' END AS fault FROM r""")
def block_coverage(spark, sf_dir):
    """Users as plants, each registered from its first hour to its last but for half a day or so in between."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("plant"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).distinct()
    hours = lambda h, m=0: F.make_dt_interval(F.lit(0), F.lit(h), F.lit(m))
    span = rows.groupBy("plant").agg(F.min("hour").alias("f"), (F.max("hour") + hours(1)).alias("l"))
    first = F.struct(F.col("f").alias("valid_from"), F.least(F.col("l"), F.col("f") + hours(254, 30)).alias("valid_to"))
    second = F.struct((F.col("f") + hours(264)).alias("valid_from"), F.col("l").alias("valid_to"))
    validity = span.select("plant", F.explode(F.array(first, second)).alias("s")).select("plant", "s.*").where("valid_from < valid_to")
    return rounded(roles.block_coverage(rows, _blocks(spark), validity, "plant", "hour", 50, 100, 0.09))


@query("""WITH ev AS (SELECT user_id AS plant, date_trunc('hour', ts) AS hour, count(*) AS n, epoch(date_trunc('hour', ts)) // 3600 + user_id AS k FROM events WHERE ts >= TIMESTAMP '2024-01-21' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1, 2),
r AS (SELECT *, hour < TIMESTAMP '2024-01-25' AS mine FROM ev) SELECT plant, hour, CASE WHEN NOT mine THEN 'unauthorised' WHEN k % 7 = 0 THEN 'missing' WHEN k % 13 = 0 THEN 'repeated' WHEN k % 17 = 0 THEN 'ambiguous' ELSE 'changed' END AS fault FROM r
WHERE CASE WHEN mine THEN k % 7 = 0 OR k % 13 = 0 OR k % 17 = 0 OR k % 5 = 0 ELSE k % 11 = 0 END""")
def scope_faults(spark, sf_dir):
    """A calibration job that lacks some of its rows, has some twice, changed some and reads some of the final block; some of its rows were frozen with two contents."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("plant"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    rows = rows.withColumn("k", F.floor(F.unix_timestamp(F.col("hour").cast("timestamp")) / 3600) + F.col("plant"))
    k = F.col("k")
    reserve = _blocks(spark).where("fold = 'reserved'")
    frozen = roles.assignments(rows, reserve, ["plant", "hour"], "hour", ["plant", "hour", "n"])
    frozen = frozen.unionByName(roles.assignments(rows.where(k % 17 == 0).withColumn("n", F.col("n") + 5), reserve, ["plant", "hour"], "hour", ["plant", "hour", "n"]))
    day = lambda d: F.lit(f"2024-01-{d}").cast("timestamp_ntz")
    own, last = F.col("hour").between(day(21), day(24) + F.make_dt_interval(F.lit(0), F.lit(23))), (F.col("hour") >= day(25)) & (F.col("hour") < day(31))
    job = rows.where((own & (k % 7 != 0)) | (last & (k % 11 == 0))).withColumn("n", F.when(k % 5 == 0, F.col("n") + 1).otherwise(F.col("n")))
    job = job.unionByName(job.where(own & (k % 13 == 0)))
    return roles.scope_faults(job, frozen, ["calibration"], ["plant", "hour"], ["plant", "hour", "n"])


@query(f"""WITH {SCORED}, c AS (SELECT *, (gen - pred) / 450 AS e FROM scored WHERE hour >= TIMESTAMP '2024-01-10' AND hour < TIMESTAMP '2024-01-20'), f AS (SELECT * FROM scored WHERE hour >= TIMESTAMP '2024-01-20'),
each AS (SELECT band, count(*) AS n, quantile_cont(e, 0.05) AS a, quantile_cont(e, 0.95) AS b FROM c GROUP BY 1), whole AS (SELECT quantile_cont(e, 0.05) AS a, quantile_cont(e, 0.95) AS b FROM c),
i AS (SELECT f.*, CASE WHEN each.n >= 50 THEN each.a ELSE whole.a END AS p05, CASE WHEN each.n >= 50 THEN each.b ELSE whole.b END AS p95 FROM f LEFT JOIN each USING (band), whole),
b AS (SELECT *, CASE WHEN w < 3 OR w >= 25 THEN 0 ELSE least(greatest(pred + p05 * 450, 0), 427.5) END AS lo, CASE WHEN w < 3 OR w >= 25 THEN 0 ELSE least(greatest(pred + p95 * 450, 0), 427.5) END AS hi FROM i),
m AS (SELECT count(*) AS rows, avg(abs(base - gen)) AS base_mae, avg(abs(pred - gen)) AS mae, avg(CASE WHEN gen BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) AS inside, avg(hi - lo) AS width FROM b)
SELECT rows, round(base_mae, 6) AS base_mae, round(mae, 6) AS mae, round(inside, 6) AS inside, round(width, 6) AS width, mae <= 400 AND inside >= 0.4 AS approved FROM m""")
def final_acceptance(spark, sf_dir):
    """Intervals of ten days of January judge the days that follow."""
    day = lambda d: F.lit(f"2024-01-{d}").cast("timestamp_ntz")
    role = F.when((F.col("hour") >= day(10)) & (F.col("hour") < day(20)), "calibration").when(F.col("hour") >= day(20), "final_test")
    names = [F.col(c) for c in ("gen", "base", "pred", "w", "cap", "avail")]
    return rounded(roles.acceptance(scored(spark, sf_dir), role, "band", *names, {"most_mae": 400.0, "least_inside": 0.4}, least=50))

"""Metrics, intervals and calibration on the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustline.functions.scalars import ratio
from gustline.operators import calibrate, clean, metrics
from gustline.plans.registry import SCORED, query, rounded, scored, table

_REG = """count(*) AS rows, round(avg(abs(pred - gen)), 6) AS mae, round(sqrt(avg((pred - gen) * (pred - gen))), 6) AS rmse, round(avg(abs((pred - gen) / 450)), 6) AS nmae,
round(sum(abs(pred - gen)) / nullif(sum(abs(gen)), 0), 6) AS wape, round(avg(pred - gen), 6) AS bias, round(avg((pred - gen) / 450), 6) AS normalized_bias,
round(quantile_cont(abs(pred - gen), 0.95), 6) AS p95_abs, round(quantile_cont(abs((pred - gen) / 450), 0.95), 6) AS p95_normalized"""


def _reg():
    return metrics.regression(F.col("gen"), F.col("pred"), F.col("cap"))


@query(f"WITH {SCORED} SELECT {_REG} FROM scored")
def regression_metrics(spark, sf_dir):
    return rounded(scored(spark, sf_dir).agg(*_reg()))


_R2 = "round(1 - sum((pred - gen) * (pred - gen)) / nullif(var_pop(gen) * count(gen), 0), 6) AS r2, round(covar_pop(gen, pred) / nullif(stddev_pop(gen) * stddev_pop(pred), 0), 6) AS pearson"
_EXT = (
    _R2
    + ", round(sum(gen), 6) AS actual_total, round(sum(pred), 6) AS predicted_total, round(sum(pred - gen), 6) AS signed_difference, round(sum(pred - gen) / nullif(sum(gen), 0), 6) AS signed_fraction, "
    + "round(avg(CASE WHEN gen <> 0 THEN abs(pred - gen) / abs(gen) END), 6) AS mape, count(CASE WHEN gen = 0 THEN 1 END) AS zero_rows, "
    + ", ".join(f"round(quantile_cont(abs(pred - gen), {q / 100}), 6) AS p{q}_abs, round(quantile_cont(CASE WHEN gen <> 0 THEN abs(pred - gen) / abs(gen) END, {q / 100}), 6) AS p{q}_ape" for q in (50, 90, 95, 99))
)


@query(f"WITH {SCORED} SELECT {_EXT} FROM scored")
def extended_metrics(spark, sf_dir):
    return rounded(scored(spark, sf_dir).agg(*metrics.extended(F.col("gen"), F.col("pred"))))


@query(f"""WITH {SCORED}, d AS (SELECT *, strftime(hour, '%Y-%m-%d') AS day FROM scored)
SELECT band, plant, day, CAST(grouping(band) AS INTEGER) AS all_band, CAST(grouping(plant) AS INTEGER) AS all_plant, CAST(grouping(day) AS INTEGER) AS all_day, {_REG}
FROM d GROUP BY GROUPING SETS ((), (band), (plant), (day))""")
def metrics_grouping_sets(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("day", F.date_format("hour", "yyyy-MM-dd"))
    return rounded(metrics.slices(rows, _reg(), ["band", "plant", "day"]))


_HOURLY = f"{SCORED}, hourly AS (SELECT hour, hour_idx, sum(gen) AS gen, sum(pred) AS pred, sum(base) AS base FROM scored GROUP BY 1, 2)"


def _hourly(spark, sf_dir):
    return metrics.by_hour(scored(spark, sf_dir), "hour_idx", ["gen", "pred", "base"])


@query(f"""WITH {_HOURLY} SELECT count(*) AS hours, round(avg(abs(pred - gen)), 6) AS mae, round(sum(abs(pred - gen)) / nullif(sum(abs(gen)), 0), 6) AS wape, {_R2} FROM hourly""")
def hourly_grid_total_metrics(spark, sf_dir):
    y, p = F.col("gen"), F.col("pred")
    return rounded(_hourly(spark, sf_dir).agg(F.count("*").alias("hours"), F.avg(F.abs(p - y)).alias("mae"), ratio(F.sum(F.abs(p - y)), F.sum(F.abs(y))).alias("wape"), metrics.r2(y, p).alias("r2"), metrics.pearson(y, p).alias("pearson")))


@query(f"""WITH {_HOURLY}, r AS (SELECT hour_idx, round(gen, 6) AS gen, round(pred, 6) AS pred FROM hourly), a AS (SELECT *, CASE WHEN abs(gen) > 1e-9 THEN abs(pred - gen) / abs(gen) END AS ape FROM r)
SELECT {_R2}, round(quantile_cont(ape, 0.5), 6) AS median_ape, round(quantile_cont(ape, 0.9), 6) AS p90_ape, {", ".join(f"round(avg(CASE WHEN ape <= {x / 100} THEN 1.0 WHEN ape IS NOT NULL THEN 0.0 END), 6) AS within_{x}" for x in (5, 10, 15, 20))},
max(gen) AS actual_peak, (SELECT pred FROM r ORDER BY gen DESC, hour_idx LIMIT 1) AS predicted_at_peak, (SELECT hour_idx FROM r ORDER BY gen DESC, hour_idx LIMIT 1) AS peak_hour, max(pred) AS predicted_peak,
(SELECT hour_idx FROM r ORDER BY pred DESC, hour_idx LIMIT 1) AS predicted_peak_hour FROM a""")
def grid_user_metrics(spark, sf_dir):
    rows = rounded(_hourly(spark, sf_dir))
    return rounded(rows.agg(*metrics.grid_user(F.col("gen"), F.col("pred"), F.col("hour_idx"))))


@query(f"""WITH {SCORED}, h AS (SELECT strftime(hour, '%Y-%m-%d') AS period, hour, sum(gen) AS gen, sum(pred) AS pred, sum(base) AS base FROM scored GROUP BY 1, 2),
m AS (SELECT period, round(sum(abs(pred - gen)) / nullif(sum(abs(gen)), 0), 6) AS wape, round(sum(abs(base - gen)) / nullif(sum(abs(gen)), 0), 6) AS base_wape FROM h GROUP BY 1)
SELECT count(*) AS periods, count(CASE WHEN wape < base_wape THEN 1 END) AS better, (SELECT period FROM m ORDER BY wape, period LIMIT 1) AS best, (SELECT period FROM m ORDER BY wape DESC, period LIMIT 1) AS worst,
round(median(wape), 6) AS median_wape FROM m""")
def monthly_metrics(spark, sf_dir):
    rows = scored(spark, sf_dir).groupBy(F.date_format("hour", "yyyy-MM-dd").alias("period"), "hour").agg(*(F.sum(c).alias(c) for c in ("gen", "pred", "base")))
    wape = lambda c: F.round(ratio(F.sum(F.abs(F.col(c) - F.col("gen"))), F.sum(F.abs("gen"))), 6)
    m = rows.groupBy("period").agg(wape("pred").alias("wape"), wape("base").alias("base_wape"))
    return rounded(
        m.agg(
            F.count("*").alias("periods"),
            F.count_if(F.col("wape") < F.col("base_wape")).alias("better"),
            F.min_by("period", F.struct("wape", "period")).alias("best"),
            F.min_by("period", F.struct(-F.col("wape"), F.col("period"))).alias("worst"),
            F.median("wape").alias("median_wape"),
        )
    )


@query(f"""WITH {SCORED} SELECT strftime(hour - INTERVAL 3 HOUR, '%Y-%m-%d') AS day, round(sum(gen), 6) AS gen, round(sum(pred), 6) AS pred, round(sum(abs(pred - gen)) / nullif(sum(abs(gen)), 0), 6) AS wape
FROM scored GROUP BY 1""")
def daily_local_rollup(spark, sf_dir):
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/Sao_Paulo"), F.col("hour"))
    rows = scored(spark, sf_dir).groupBy(F.date_format(local, "yyyy-MM-dd").alias("day"))
    return rounded(rows.agg(F.sum("gen").alias("gen"), F.sum("pred").alias("pred"), ratio(F.sum(F.abs(F.col("pred") - F.col("gen"))), F.sum(F.abs("gen"))).alias("wape")))


_BANDS = "bands AS (SELECT unnest(['<3', '3-6', '6-9', '9-12', '12-25', '>=25']) AS band)"
_TABLE = f"""{_BANDS}, each AS (SELECT band, count(*) AS n, quantile_cont((gen - pred) / 450, 0.05) AS a, quantile_cont((gen - pred) / 450, 0.95) AS b FROM scored GROUP BY 1),
whole AS (SELECT quantile_cont((gen - pred) / 450, 0.05) AS a, quantile_cont((gen - pred) / 450, 0.95) AS b FROM scored),
intervals AS (SELECT band, coalesce(n, 0) AS n, CASE WHEN n >= 100 THEN each.a ELSE whole.a END AS p05, CASE WHEN n >= 100 THEN each.b ELSE whole.b END AS p95, CASE WHEN n >= 100 THEN 'band' ELSE 'all' END AS source
FROM bands LEFT JOIN each USING (band), whole)"""


def _intervals(rows):
    return metrics.interval_table(rows, "band", (F.col("gen") - F.col("pred")) / F.col("cap"), least=100)


@query(f"WITH {SCORED}, {_TABLE} SELECT band, CAST(n AS BIGINT) AS n, round(p05, 6) AS p05, round(p95, 6) AS p95, source FROM intervals")
def interval_table_fallback(spark, sf_dir):
    return rounded(_intervals(scored(spark, sf_dir)).withColumn("n", F.col("n").cast("long")))


@query(f"""WITH {SCORED}, {_TABLE}, b AS (SELECT s.*, CASE WHEN w < 3 OR w >= 25 THEN 0 ELSE least(greatest(pred + p05 * 450, 0), 427.5) END AS lo, CASE WHEN w < 3 OR w >= 25 THEN 0 ELSE least(greatest(pred + p95 * 450, 0), 427.5) END AS hi
FROM scored s JOIN intervals USING (band)) SELECT count(*) AS rows, round(avg(CASE WHEN gen BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS inside, round(avg(hi - lo), 6) AS width FROM b""")
def interval_coverage(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rounded(metrics.interval_coverage(rows, _intervals(rows), "band", F.col("gen"), F.col("pred"), F.col("w"), F.col("cap"), F.col("avail")))


@query(f"""WITH {SCORED}, g AS (SELECT unnest(range(70, 141)) AS factor_pct), e AS (SELECT factor_pct, round(sum(abs(least(greatest(pred * factor_pct / 100, 0), 427.5) - gen)) / nullif(sum(abs(gen)), 0), 9) AS wape FROM scored, g GROUP BY 1)
SELECT CAST(factor_pct AS INTEGER) AS factor_pct, round(wape, 6) AS wape, CAST(row_number() OVER (ORDER BY wape, abs(factor_pct - 100), factor_pct) AS INTEGER) AS rank FROM e""")
def scalar_calibration_grid(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rounded(calibrate.scalar_grid(rows, F.col("gen"), F.col("pred"), F.col("cap") * F.col("avail")))


@query(f"""WITH {SCORED}, c AS (SELECT plant, 'base' AS candidate, round(avg(abs(base - gen)), 6) AS mae FROM scored GROUP BY 1 UNION ALL SELECT plant, 'corrected', round(avg(abs(pred - gen)), 6) FROM scored GROUP BY 1 UNION ALL SELECT plant, 'zero', round(avg(abs(gen)), 6) FROM scored GROUP BY 1)
SELECT plant, candidate, mae, CAST(row_number() OVER (PARTITION BY plant ORDER BY mae, candidate) AS INTEGER) AS rank FROM c""")
def candidate_ranking(spark, sf_dir):
    from pyspark.sql import Window

    rows = scored(spark, sf_dir).groupBy("plant").agg(*(F.round(F.avg(F.abs(p - F.col("gen"))), 6).alias(n) for n, p in (("base", F.col("base")), ("corrected", F.col("pred")), ("zero", F.lit(0.0)))))
    long = rows.unpivot("plant", ["base", "corrected", "zero"], "candidate", "mae")
    return rounded(long.withColumn("rank", F.row_number().over(Window.partitionBy("plant").orderBy("mae", "candidate"))))


@query(f"""WITH {SCORED}, d AS (SELECT CAST(floor(hour_idx / 24) AS BIGINT) AS day, sum(abs(gen)) AS base, sum(abs(base - gen)) AS b, sum(abs(pred - gen)) AS a FROM scored GROUP BY 1),
s AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS slot, count(*) OVER () AS n FROM d), t AS (SELECT unnest(range(0, 200)) AS sample),
r AS (SELECT sample, ((sample * 7919 + slot * 104729 + 12345) * 48271 % 2147483647) % n AS pick FROM t, s)
SELECT CAST(sample AS INTEGER) AS sample, round((sum(b) - sum(a)) / nullif(sum(base), 0), 6) AS gain FROM r JOIN s ON s.slot = r.pick GROUP BY 1""")
def day_block_bootstrap(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("day", F.floor(F.col("hour_idx") / 24))
    return rounded(calibrate.day_bootstrap(rows, "day", F.col("gen"), F.col("base"), F.col("pred")))


@query(f"""WITH {SCORED}, d AS (SELECT CAST(floor(hour_idx / 24) AS BIGINT) AS day, sum(abs(gen)) AS base, sum(abs(base - gen)) AS b, sum(abs(pred - gen)) AS a FROM scored GROUP BY 1),
s AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS slot, count(*) OVER () AS n FROM d), t AS (SELECT unnest(range(0, 2000)) AS sample),
r AS (SELECT sample, ((sample * 7919 + slot * 104729 + 12345) * 48271 % 2147483647) % n AS pick FROM t, s),
g AS (SELECT sample, (sum(b) - sum(a)) / nullif(sum(base), 0) AS gain FROM r JOIN s ON s.slot = r.pick GROUP BY 1)
SELECT (SELECT round((sum(b) - sum(a)) / nullif(sum(base), 0), 6) FROM d) AS gain, round(quantile_cont(gain, 0.025), 6) AS low, round(quantile_cont(gain, 0.975), 6) AS high, count(*) AS draws FROM g""")
def day_block_interval(spark, sf_dir):
    """The point gain with its interval over 2,000 draws; day_block_bootstrap gives the gains of 200 draws."""
    rows = scored(spark, sf_dir).withColumn("day", F.floor(F.col("hour_idx") / 24))
    return rounded(calibrate.day_interval(rows, "day", F.col("gen"), F.col("base"), F.col("pred")))


_THETA = f"""{SCORED}, x AS (SELECT hour_idx, (gen - (SELECT avg(gen) FROM scored)) AS y, (w - (SELECT avg(w) FROM scored)) AS d FROM scored), t AS (SELECT sum(d * y) / sum(d * d) AS theta FROM x),
k AS (SELECT floor((hour_idx - (SELECT min(hour_idx) FROM x)) / 24) AS block, sum(d * (y - theta * d)) AS s FROM x, t GROUP BY 1)"""


def _effect(spark, sf_dir):
    rows = scored(spark, sf_dir)
    means = rows.agg(F.avg("gen").alias("mg"), F.avg("w").alias("mw"))
    rows = rows.join(F.broadcast(means))  # one row of two numbers
    return calibrate.orthogonal_effect(rows, F.col("gen") - F.col("mg"), F.col("w") - F.col("mw"), "hour_idx")


@query(f"""WITH {_THETA} SELECT round(sqrt((count(*) / nullif(count(*) - 1, 0)) * sum(s * s) / pow((SELECT sum(d * d) FROM x), 2)), 5) AS se, count(*) AS blocks FROM k""")
def cluster_robust_se(spark, sf_dir):
    return rounded(_effect(spark, sf_dir).select("se", "blocks"), 5)


@query(f"WITH {_THETA} SELECT round(theta, 5) AS theta, (SELECT count(*) FROM x) AS rows FROM t")
def orthogonal_theta(spark, sf_dir):
    return rounded(_effect(spark, sf_dir).select("theta", "rows"), 5)


@query("""WITH q AS (SELECT quantile_cont(value, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS e FROM events), b AS (SELECT value, user_id, len(list_filter(e, lambda x: x < value)) AS bin FROM events, q)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS rows, round(avg(value), 6) AS mean_value, round(avg(user_id), 6) AS mean_user_id FROM b GROUP BY 1""")
def equal_frequency_response(spark, sf_dir):
    return rounded(metrics.equal_frequency(table(spark, sf_dir, "events"), "value", "user_id"))


@query("""SELECT 'event_id' AS "column", count(*) AS rows, count(*) - count(event_id) AS nulls, round((count(*) - count(event_id)) / nullif(count(*), 0), 6) AS null_rate FROM events
UNION ALL SELECT 'large_value', count(*), count(CASE WHEN value <= 50 THEN 1 END), round(count(CASE WHEN value <= 50 THEN 1 END) / nullif(count(*), 0), 6) FROM events
UNION ALL SELECT 'props', count(*), count(*) - count(props), round((count(*) - count(props)) / nullif(count(*), 0), 6) FROM events""")
def null_rate_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("large_value", F.when(F.col("value") > 50, F.col("value")))
    return rounded(clean.null_profile(rows, ["event_id", "large_value", "props"]))


@query("""WITH x AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS a, sum(CAST(l_extendedprice AS DOUBLE)) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT count(*) AS rows, round(sum(a), 2) AS total_a, round(sum(b), 2) AS total_b, round(sum(a - b) / nullif(sum(b), 0), 6) AS gap_fraction, round(avg(CASE WHEN a - b > 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS above,
round(avg(CASE WHEN abs(a - b) <= 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS equal, round(avg(CASE WHEN a - b < -1e-9 THEN 1.0 ELSE 0.0 END), 6) AS below, round(avg(abs(a - b)), 2) AS mae FROM x""")
def reference_gap(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("double")).alias("b"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("a")).join(sums, "o_orderkey")
    out = rows.agg(*metrics.reference_gap(F.col("a"), F.col("b")), metrics.reconciliation(F.col("a"), F.col("b"))[0])
    return rounded(out.withColumns({c: F.round(c, 2) for c in ("total_a", "total_b", "mae")}))

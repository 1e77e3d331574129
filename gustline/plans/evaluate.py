"""Evaluation by month, splits with gaps, searches, effects, frozen predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustline.functions import scalars as S
from gustline.operators import calibrate, metrics, stages
from gustline.plans.metric import _REG
from gustline.plans.registry import PANEL, SCORED, panel, query, rounded, scored, table

# lines of orders as a panel that spans 80 months: what was charged against what the list price says
_SALES = """sales AS (SELECT l_orderkey, l_linenumber, l_suppkey % 5 AS plant, l_shipdate AS hour, strftime(l_shipdate, '%Y-%m') AS month, l_returnflag AS condition, l_extendedprice / 100 AS gen, l_quantity * (900 + l_partkey % 1000 / 10.0::DOUBLE) / 100 AS base, l_quantity * (900 + l_partkey % 1000 / 10.0::DOUBLE) * (1 - l_discount) / 100 AS pred, 450.0::DOUBLE AS cap, CASE WHEN l_quantity < 10 THEN '<10' WHEN l_quantity < 30 THEN '10-30' ELSE '>=30' END AS band FROM lineitem)"""


def _sales(spark, sf_dir):
    listed = F.col("l_quantity") * (F.col("l_partkey") % 1000 / 10 + 900)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_suppkey") % 5).alias("plant"),
        F.col("l_shipdate").alias("hour"),
        S.month_label(F.col("l_shipdate")).alias("month"),
        F.col("l_returnflag").alias("condition"),
        (F.col("l_extendedprice") / 100).alias("gen"),
        (listed / 100).alias("base"),
        (listed * (1 - F.col("l_discount")) / 100).alias("pred"),
        F.lit(450.0).alias("cap"),
        F.when(F.col("l_quantity") < 10, "<10").when(F.col("l_quantity") < 30, "10-30").otherwise(">=30").alias("band"),
    )


@query(f"""WITH {_SALES} SELECT band, plant, month, condition, CAST(grouping(band) AS INTEGER) AS all_band, CAST(grouping(plant) AS INTEGER) AS all_plant, CAST(grouping(month) AS INTEGER) AS all_month, CAST(grouping(condition) AS INTEGER) AS all_condition, {_REG}
FROM sales GROUP BY GROUPING SETS ((), (band), (plant), (month), (condition))""".replace(", 6) AS", ", 4) AS"))
def metrics_by_slice(spark, sf_dir):
    of = F.col("gen"), F.col("pred"), F.col("cap")
    return rounded(metrics.slices_with_quantiles(_sales(spark, sf_dir), metrics.regression_means(*of), metrics.regression_quantiles(*of), ["band", "plant", "month", "condition"]), 4)


_MONTHLY = f"""{_SALES}, h AS (SELECT month, hour, sum(gen) AS gen, sum(pred) AS pred, sum(base) AS base FROM sales GROUP BY 1, 2), mt AS (SELECT month, count(*) AS hours, sum(gen) AS gen, round(sum(abs(pred - gen)) / nullif(sum(abs(gen)), 0), 9) AS wape_pred, round(sum(abs(base - gen)) / nullif(sum(abs(gen)), 0), 9) AS wape_base FROM h GROUP BY 1)"""


def _monthly(spark, sf_dir):
    return stages.month_errors(_sales(spark, sf_dir), F.col("month"), "hour", "gen", ["pred", "base"])


@query(f"WITH {_MONTHLY} SELECT month, hours, round(gen, 4) AS gen, round(wape_pred, 6) AS wape_pred, round(wape_base, 6) AS wape_base, wape_pred < wape_base AS better FROM mt")
def monthly_table(spark, sf_dir):
    return rounded(_monthly(spark, sf_dir).withColumns({"better": F.col("wape_pred") < F.col("wape_base"), "gen": F.round("gen", 4)}))


@query(f"""WITH {_MONTHLY} SELECT count(*) AS months, count(CASE WHEN wape_pred < wape_base THEN 1 END) AS better, (SELECT month FROM mt ORDER BY wape_pred, month LIMIT 1) AS best, (SELECT month FROM mt ORDER BY wape_pred DESC, month LIMIT 1) AS worst, round(median(wape_pred), 6) AS median_wape FROM mt""")
def monthly_summary(spark, sf_dir):
    rows = _monthly(spark, sf_dir)
    best, worst = F.min_by("month", F.struct("wape_pred", "month")), F.min_by("month", F.struct(-F.col("wape_pred"), F.col("month")))
    return rounded(rows.agg(F.count("*").alias("months"), F.count_if(F.col("wape_pred") < F.col("wape_base")).alias("better"), best.alias("best"), worst.alias("worst"), F.median("wape_pred").alias("median_wape")))


_HOURS = f"{PANEL}, hours AS (SELECT DISTINCT hour_idx FROM panel), ranks AS (SELECT hour_idx, row_number() OVER (ORDER BY hour_idx) - 1 AS rank, count(*) OVER () AS n FROM hours)"


@query(f"""WITH {_HOURS}, e AS (SELECT hour_idx AS start FROM ranks WHERE rank = greatest(1, least(n - 1, n * 80 // 100))) SELECT CASE WHEN hour_idx >= start THEN 'validation' WHEN hour_idx < start - 24 THEN 'train' ELSE 'purged' END AS part, count(*) AS rows, min(hour_idx) AS first_hour, max(hour_idx) AS last_hour FROM panel, e GROUP BY 1""")
def adaptation_split(spark, sf_dir):
    rows = stages.adaptation_parts(panel(spark, sf_dir), "hour_idx", 80, 24)
    return rows.groupBy("part").agg(F.count("*").alias("rows"), F.min("hour_idx").alias("first_hour"), F.max("hour_idx").alias("last_hour"))


@query(f"""WITH {_HOURS}, c AS (SELECT hour_idx AS cut FROM ranks WHERE rank = n * 80 // 100) SELECT hour_idx >= cut AS held, count(*) AS rows, round(sum(gen), 6) AS gen FROM panel, c GROUP BY 1""")
def quantile_cut(spark, sf_dir):
    rows = panel(spark, sf_dir)
    cut = rows.join(F.broadcast(stages.quantile_hour(rows, "hour_idx", 80)))  # one row
    return rounded(cut.groupBy((F.col("hour_idx") >= F.col("cut")).alias("held")).agg(F.count("*").alias("rows"), F.sum("gen").alias("gen")))


_DECLARED = "f AS (SELECT p_size AS fold, TIMESTAMP '1995-01-01' + to_days(CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END) AS train_start, TIMESTAMP '1995-06-01' + to_days(30 * p_size) AS train_end, TIMESTAMP '1995-06-01' + to_days(30 * p_size + CASE WHEN p_size % 5 = 0 THEN 45 ELSE 20 END) AS evaluation_end FROM (SELECT DISTINCT p_size FROM part))"


@query(f"""WITH {_DECLARED}, g AS (SELECT *, lag(train_start) OVER (ORDER BY fold) AS s, lag(evaluation_end) OVER (ORDER BY fold) AS e FROM f) SELECT fold, CASE WHEN s IS NULL THEN NULL WHEN train_start <> s THEN 'start' WHEN train_end < e THEN 'evaluation_not_in_training' END AS fault FROM g""")
def fold_faults(spark, sf_dir):
    p = F.col("p_size")
    day = lambda start, n: F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(n)
    folds = table(spark, sf_dir, "part").select(p).distinct().select(p.alias("fold"), day("1995-01-01", F.when(p % 7 == 0, 1).otherwise(0)).alias("train_start"), day("1995-06-01", p * 30).alias("train_end"), day("1995-06-01", p * 30 + F.when(p % 5 == 0, 45).otherwise(20)).alias("evaluation_end"))
    return stages.fold_faults(folds, "fold").select("fold", "fault")


@query("""WITH r AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS period, o_orderdate + INTERVAL 1 DAY * (CASE WHEN year(o_orderdate) = 1998 THEN -40 ELSE 0 END) AS t, o_custkey % 7 + 10 * year(o_orderdate) + CASE WHEN year(o_orderdate) = 2000 THEN -10 ELSE 0 END AS k FROM orders),
s AS (SELECT period, min(t) AS "start", max(t) AS "end" FROM r GROUP BY 1), o AS (SELECT *, lag("end") OVER (ORDER BY period) AS last FROM s), d AS (SELECT DISTINCT period FROM r WHERE k IN (SELECT k FROM r GROUP BY 1 HAVING count(DISTINCT period) > 1))
SELECT o.period, "start", "end", CASE WHEN "start" <= last THEN 'order' WHEN d.period IS NOT NULL THEN 'overlap' END AS fault FROM o LEFT JOIN d ON d.period = o.period""")
def period_faults(spark, sf_dir):
    year = F.year("o_orderdate")
    t = F.col("o_orderdate") - F.make_dt_interval(F.when(year == 1998, 40).otherwise(0))
    rows = table(spark, sf_dir, "orders").select(year.alias("period"), year.alias("_order"), t.alias("t"), (F.col("o_custkey") % 7 + year * 10 - F.when(year == 2000, 10).otherwise(0)).alias("k"))
    return stages.period_faults(rows, "period", "_order", "t", ["k"])


def _guess(c: str, s: float) -> str:
    return f"CASE WHEN w < 3 OR w >= 25 THEN 0 ELSE least(greatest(base + {c} * {s} * 450, 0), 427.5) END"


_CHOICES = [("no_correction", 0.0, "base")] + [(n, s, _guess(c, s)) for n, c in (("flat", "0.05"), ("windy", "(w - 10) / 100")) for s in (0.25, 0.5, 1.0)]
_EACH = " UNION ALL ".join(f"SELECT '{n}' AS candidate, {s}::DOUBLE AS scale, hour_idx, gen, {g} AS p FROM scored" for n, s, g in _CHOICES)


@query(f"""WITH {SCORED}, e AS ({_EACH}), h AS (SELECT candidate, scale, hour_idx, sum(gen) AS gen, sum(p) AS p, sum(abs(gen)) AS size, sum(abs(p - gen)) AS err FROM e GROUP BY 1, 2, 3), t AS (SELECT candidate, scale, round(sum(abs(p - gen)) / sum(abs(gen)), 9) AS hw, round(sum(err) / sum(size), 9) AS pw FROM h GROUP BY 1, 2)
SELECT candidate, scale, round(hw, 6) AS hourly_wape, round(pw, 6) AS plant_hour_wape, CAST(row_number() OVER (ORDER BY hw, pw, candidate, scale) AS INTEGER) AS rank FROM t""")
def residual_search(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumns({"flat": F.lit(0.05), "windy": (F.col("w") - 10) / 100})
    return rounded(stages.residual_search(rows, "hour_idx", "base", ["flat", "windy"], [0.25, 0.5, 1.0]))


_FOLD = f"""{SCORED}, hrs AS (SELECT DISTINCT hour_idx FROM scored), rk AS (SELECT hour_idx, row_number() OVER (ORDER BY hour_idx) - 1 AS rank, count(*) OVER () AS n FROM hrs),
bl AS (SELECT hour_idx, CASE WHEN rank < (n % 5) * (n // 5 + 1) THEN rank // (n // 5 + 1) ELSE n % 5 + (rank - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM rk), st AS (SELECT fold, min(hour_idx) - 6 AS cutoff FROM bl WHERE fold > 0 GROUP BY 1),
mn AS (SELECT fold, plant, avg(gen) AS my, avg(w) AS md FROM scored, st WHERE hour_idx < cutoff GROUP BY 1, 2), cf AS (SELECT s.hour_idx, b.fold, s.plant, s.gen - my AS y, s.w - md AS d FROM scored s JOIN bl b ON b.hour_idx = s.hour_idx JOIN mn ON mn.fold = b.fold AND mn.plant = s.plant),
th AS (SELECT sum(d * y) / sum(d * d) AS theta FROM cf), ks AS (SELECT floor((hour_idx - (SELECT min(hour_idx) FROM cf)) / 24) AS block, sum(d * (y - theta * d)) AS s FROM cf, th GROUP BY 1)"""


@query(f"""WITH {_FOLD}, r AS (SELECT (SELECT theta FROM th) AS theta, sqrt((count(*) / nullif(count(*) - 1, 0)) * sum(s * s) / pow((SELECT sum(d * d) FROM cf), 2)) AS se, count(*) AS blocks FROM ks)
SELECT round(theta, 5) AS theta, round(se, 5) AS se, round(theta - 1.96 * se, 5) AS low, round(theta + 1.96 * se, 5) AS high, blocks, (SELECT count(*) FROM cf) AS rows FROM r""")
def cross_fitted_effect(spark, sf_dir):
    """Generation on wind speed, both less what earlier hours of the plant predict; errors clustered by day."""
    rows = stages.cross_fitted(scored(spark, sf_dir), "hour_idx", 4, 6, "gen", "w", "plant")
    return rounded(calibrate.orthogonal_effect(rows, F.col("y"), F.col("d"), "hour_idx"), 5)


@query(f"WITH {SCORED} SELECT plant, hour, round(pred, 6) AS pred, round(gen, 6) AS gen FROM scored")
def frozen_predictions(spark, sf_dir):
    """Predictions that carry a wrong target along."""
    rows = scored(spark, sf_dir)
    predictions = rows.select("plant", "hour", "pred", F.lit(-1.0).alias("gen"))
    return rounded(stages.frozen(predictions, rows.select("plant", "hour", "gen"), ["plant", "hour"], ["gen"]))


@query(f"""WITH {PANEL}, s AS (SELECT plant, hour, gen, row_number() OVER (PARTITION BY strftime(hour, '%Y-%m-%d') ORDER BY hour, plant) AS rn FROM panel)
SELECT plant, hour, round(gen, 6) AS gen, round(CASE WHEN hour('2024-01-01'::TIMESTAMP) = 0 AND rn % 5 = 0 THEN gen + 1 ELSE gen END, 6) AS source, rn % 5 <> 0 AS agrees FROM s""")
def sample_trace(spark, sf_dir):
    from pyspark.sql import Window

    own = Window.partitionBy(F.to_date("hour")).orderBy("hour", "plant")
    rows = panel(spark, sf_dir).select("plant", "hour", "gen", F.row_number().over(own).alias("rn"))
    source = rows.select("plant", "hour", F.when(F.col("rn") % 5 == 0, F.col("gen") + 1).otherwise(F.col("gen")).alias("gen"))
    return rounded(stages.traced(rows.drop("rn"), source, ["plant", "hour"], "gen"))


@query("WITH q AS (SELECT quantile_cont(value, [0.0, 0.05, 0.5, 0.95, 1.0]) AS v FROM events) SELECT unnest([0.0, 0.05, 0.5, 0.95, 1.0])::DOUBLE AS share, round(unnest(v), 6) AS value FROM q")
def exact_quantiles(spark, sf_dir):
    return rounded(stages.exact_quantiles(table(spark, sf_dir, "events"), "value", [0.0, 0.05, 0.5, 0.95, 1.0]))


@query("""WITH x AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders), h AS (SELECT sha256('=' || o_orderkey || '|=' || o_custkey || '|=' || o_orderstatus) AS h FROM x),
d AS (SELECT count(*) AS rows, sum(CAST('0x' || h[1:8] AS UBIGINT)) AS a, sum(CAST('0x' || h[9:16] AS UBIGINT)) AS b, sum(CAST('0x' || h[17:24] AS UBIGINT)) AS c, sum(CAST('0x' || h[25:32] AS UBIGINT)) AS e FROM h)
SELECT rows, sha256(rows || '|' || CAST(a AS BIGINT) || '|' || CAST(b AS BIGINT) || '|' || CAST(c AS BIGINT) || '|' || CAST(e AS BIGINT)) AS digest FROM d""")
def logical_hash(spark, sf_dir):
    from gustline.sources.tables import logical_hash as of

    return of(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query(f"""WITH {PANEL}, c AS (SELECT plant, CAST(hour AS DATE) AS day, count(*) AS hours FROM panel GROUP BY 1, 2), cal AS (SELECT CAST(unnest(generate_series(min(hour)::DATE, max(hour)::DATE, INTERVAL 1 DAY)) AS DATE) AS day FROM panel), pl AS (SELECT DISTINCT plant FROM panel)
SELECT plant, day, coalesce(hours, 0) AS observed, CAST(24 AS BIGINT) AS expected, round(coalesce(hours, 0) / 24, 6) AS coverage FROM (SELECT plant, day FROM pl, cal) x LEFT JOIN c USING (plant, day)""")
def calendar_coverage(spark, sf_dir):
    return rounded(calibrate.calendar_coverage(panel(spark, sf_dir), "plant", "hour"))


@query(f"""WITH {PANEL}, b AS (SELECT *, CAST((hour_idx - (SELECT min(hour_idx) FROM panel)) // 240 AS BIGINT) AS fold FROM panel), r AS (SELECT fold, CASE WHEN gen > 100 THEN 'train' ELSE 'evaluation' END AS role, count(*) AS rows, count(DISTINCT plant) AS plants, count(DISTINCT hour_idx) AS hours FROM b GROUP BY 1, 2)
SELECT fold, role, rows, plants, hours, hours >= 200 AND plants >= 5 AS enough FROM r""")
def fold_role_gates(spark, sf_dir):
    rows = panel(spark, sf_dir)
    first = rows.agg(F.min("hour_idx").alias("_m"))
    rows = rows.join(F.broadcast(first)).select("plant", "hour_idx", F.floor((F.col("hour_idx") - F.col("_m")) / 240).alias("fold"), F.when(F.col("gen") > 100, "train").otherwise("evaluation").alias("role"))  # one row
    return calibrate.fold_gates(rows, ["fold", "role"], "plant", "hour_idx", 200, 5)

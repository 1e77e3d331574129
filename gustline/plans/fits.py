"""Effects with fitted nuisances and tuning by folds, as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gustline.functions import wind as W
from gustline.operators import fitted, holdout, paired, splits, stored
from gustline.plans.evaluate import _SALES, _sales
from gustline.plans.registry import SCORED, query, rounded, scored
from gustline.shared import fresh_path

_BLOCK = lambda k: f"CASE WHEN rank < (n % {k}) * (n // {k} + 1) THEN rank // (n // {k} + 1) ELSE n % {k} + (rank - (n % {k}) * (n // {k} + 1)) // (n // {k}) END"
_RANK = f"{SCORED}, hrs AS (SELECT DISTINCT hour_idx FROM scored), rk AS (SELECT hour_idx, row_number() OVER (ORDER BY hour_idx) - 1 AS rank, count(*) OVER () AS n FROM hrs)"


def _solved(t: str, lam: str) -> list[str]:
    """Intercept and two coefficients of a ridge regression by Cramer's rule, from sums n, s1, s2, s11, s12, s22 and {t}0, {t}1, {t}2."""
    a, b = f"(s11 + {lam})", f"(s22 + {lam})"
    det = f"(n * ({a} * {b} - s12 * s12) - s1 * (s1 * {b} - s12 * s2) + s2 * (s1 * s12 - {a} * s2))"
    tops = [
        f"{t}0 * ({a} * {b} - s12 * s12) - s1 * ({t}1 * {b} - s12 * {t}2) + s2 * ({t}1 * s12 - {a} * {t}2)",
        f"n * ({t}1 * {b} - s12 * {t}2) - {t}0 * (s1 * {b} - s12 * s2) + s2 * (s1 * {t}2 - {t}1 * s2)",
        f"n * ({a} * {t}2 - {t}1 * s12) - s1 * (s1 * {t}2 - {t}1 * s2) + {t}0 * (s1 * s12 - {a} * s2)",
    ]
    return [f"({x}) / {det}" for x in tops]


_SUMS = "CAST(count(*) AS DOUBLE) AS n, sum(u) AS s1, sum(v) AS s2, sum(u * u) AS s11, sum(u * v) AS s12, sum(v * v) AS s22"
_TARGET = lambda t, x: f"sum({x}) AS {t}0, sum(u * {x}) AS {t}1, sum(v * {x}) AS {t}2"
_FITTED = f"""{_RANK}, bl AS (SELECT hour_idx, {_BLOCK(5)} AS fold FROM rk), st AS (SELECT fold, min(hour_idx) AS a, max(hour_idx) AS z, min(hour_idx) - 6 AS cutoff FROM bl WHERE fold > 0 GROUP BY 1),
sm AS (SELECT fold, {_SUMS}, {_TARGET("y", "gen")}, {_TARGET("d", "w")} FROM scored, st WHERE hour_idx < cutoff GROUP BY 1),
be AS (SELECT fold, {", ".join(f"{x} AS {t}b{k}" for t in "yd" for k, x in enumerate(_solved(t, "1.0")))} FROM sm),
cf AS (SELECT s.hour_idx, gen - (yb0 + yb1 * u + yb2 * v) AS y, w - (db0 + db1 * u + db2 * v) AS d FROM scored s JOIN st ON s.hour_idx BETWEEN a AND z JOIN be ON be.fold = st.fold),
th AS (SELECT sum(d * y) / sum(d * d) AS theta FROM cf), ks AS (SELECT floor((hour_idx - (SELECT min(hour_idx) FROM cf)) / 24) AS block, sum(d * (y - theta * d)) AS s FROM cf, th GROUP BY 1)"""


@query(f"""WITH {_FITTED}, r AS (SELECT (SELECT theta FROM th) AS theta, sqrt((count(*) / nullif(count(*) - 1, 0)) * sum(s * s) / pow((SELECT sum(d * d) FROM cf), 2)) AS se, count(*) AS blocks FROM ks)
SELECT round(theta, 5) AS theta, round(se, 5) AS se, round(theta - 1.96 * se, 5) AS low, round(theta + 1.96 * se, 5) AS high, blocks, (SELECT count(*) FROM cf) AS rows, (SELECT round(stddev_samp(d), 5) FROM cf) AS treatment_std FROM r""")
def fitted_effect(spark, sf_dir):
    """Generation on wind speed, both less what ridge models of both wind components say of them, each fold by earlier hours; errors clustered by day."""
    e = fitted.fitted_effect(scored(spark, sf_dir), "hour_idx", "gen", "w", ["u", "v"], penalty=1.0)
    row = (e.theta, e.se, e.low, e.high, e.blocks, e.rows, e.treatment_std)
    return rounded(spark.createDataFrame([row], "theta double, se double, low double, high double, blocks long, rows long, treatment_std double"), 5)


_PENALTIES = {"free": 0.0, "light": 100.0, "strong": 10000.0}
_TUNED = f"""{_RANK}, bl AS (SELECT hour_idx, {_BLOCK(5)} AS b FROM rk), ed AS (SELECT b, min(hour_idx) AS first, max(hour_idx) AS last FROM bl GROUP BY 1),
fo AS (SELECT e.b - 1 AS fold, e.first AS a, e.last AS z, p.first - 6 AS train_end FROM ed e JOIN ed p ON p.b = e.b - 1 WHERE e.b > 1),
sm AS (SELECT fold, {_SUMS}, {_TARGET("t", "((gen - base) / 450)")} FROM scored, fo WHERE hour_idx < train_end GROUP BY 1),
ca(candidate, lam) AS (VALUES {", ".join(f"('{c}', {p}::DOUBLE)" for c, p in _PENALTIES.items())}),
be AS (SELECT fold, candidate, {", ".join(f"{x} AS b{k}" for k, x in enumerate(_solved("t", "lam")))} FROM sm, ca),
pr AS (SELECT candidate, fo.fold, s.gen, CASE WHEN w < 3 OR w >= 25 THEN 0.0::DOUBLE ELSE least(greatest(base + (b0 + b1 * u + b2 * v) * 450, 0), 427.5::DOUBLE) END AS p FROM scored s JOIN fo ON s.hour_idx BETWEEN a AND z JOIN be ON be.fold = fo.fold),
re AS (SELECT candidate, CAST(fold AS INTEGER) AS fold, count(*) AS rows, avg(abs(p - gen)) AS mae FROM pr GROUP BY 1, 2), me AS (SELECT *, avg(mae) OVER (PARTITION BY candidate) AS mean_mae FROM re)"""


def _residuals(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("residual", (F.col("gen") - F.col("base")) / F.col("cap"))


@query(f"WITH {_TUNED} SELECT candidate, fold, 1 AS rounds, rows, round(mae, 6) AS mae, round(mean_mae, 6) AS mean_mae, CAST(dense_rank() OVER (ORDER BY round(mean_mae, 12), candidate) AS INTEGER) AS rank FROM me")
def walk_forward_tuning(spark, sf_dir):
    """Three ridge corrections of the power curve over three folds that share hours, each with a stopping block between training and judgement."""
    rows = _residuals(spark, sf_dir)
    folds = fitted.expanding(rows, "hour_idx", 3, 6, stopping=True)
    return rounded(fitted.ranked(fitted.ridge_path(rows, "hour_idx", folds, "residual", ["u", "v"], _PENALTIES)))


_HELD = f"""{_RANK}, sp AS (SELECT hour_idx AS start FROM rk WHERE rank = n * 70 // 100), late AS (SELECT max(plant) AS late FROM scored),
sm AS (SELECT {_SUMS}, {_TARGET("t", "((gen - base) / 450)")} FROM scored, sp, late WHERE hour_idx < start - 6 AND plant <> late), be AS (SELECT {", ".join(f"{x} AS b{k}" for k, x in enumerate(_solved("t", "1.0")))} FROM sm),
ju AS (SELECT plant, hour_idx, gen, base, CASE WHEN plant = late THEN 'unknown_group' ELSE 'model' END AS reason, CASE WHEN plant = late THEN base WHEN w < 3 OR w >= 25 THEN 0.0::DOUBLE ELSE least(greatest(base + (b0 + b1 * u + b2 * v) * 450, 0), 427.5::DOUBLE) END AS hybrid
FROM scored, sp, late, be WHERE hour_idx >= start)"""


def _start_and_late(rows):
    (start,) = splits.ranked_hours(rows, "hour_idx").where(F.col("rank") == F.floor(F.col("n") * 70 / 100)).select("hour_idx").first()
    (late,) = rows.agg(F.max("plant")).first()
    return start, late


def _held_out(spark, sf_dir):
    """The last 30 percent of hours; one plant has no earlier rows."""
    rows = _residuals(spark, sf_dir)
    start, late = _start_and_late(rows)
    training, later = rows.where((F.col("hour_idx") < start) & (F.col("plant") != late)), rows.where(F.col("hour_idx") >= start)
    return holdout.independent_holdout(training, later, "plant", "hour_idx", ["u", "v"], "residual")


@query(f"WITH {_HELD} SELECT plant, hour_idx, reason, round(base, 6) AS base, round(hybrid, 6) AS hybrid FROM ju")
def independent_holdout(spark, sf_dir):
    """A correction fitted on the first 70 percent of hours, on the rest, with a plant that it does not know."""
    return rounded(_held_out(spark, sf_dir).select("plant", "hour_idx", "reason", "base", "hybrid"))


_KEPT = f"""{_HELD}, er AS (SELECT count(*) AS rows, avg(abs(base - gen)) AS base_mae, avg(abs(hybrid - gen)) AS hybrid_mae FROM ju)"""


def _stored(spark, sf_dir):
    """A model that was fitted on the first 70 percent of hours, without one plant, written and loaded again; and all rows."""
    rows = _residuals(spark, sf_dir)
    start, late = _start_and_late(rows)
    path = fresh_path(spark, "model")
    stored.save(rows.where((F.col("hour_idx") < start - 6) & (F.col("plant") != late)), rows.where(F.col("hour_idx") >= start), path, "plant", "hour_idx", ["u", "v"], "residual")
    return stored.load(spark, path), rows


@query(f"""WITH {_KEPT}, al AS (SELECT plant, hour_idx, base, CASE WHEN hybrid_mae >= base_mae THEN 'not_approved' WHEN plant = late THEN 'unknown_group' ELSE 'model' END AS reason, CASE WHEN w < 3 OR w >= 25 THEN 0.0::DOUBLE ELSE least(greatest(base + (b0 + b1 * u + b2 * v) * 450, 0), 427.5::DOUBLE) END AS p FROM scored, late, be, er)
SELECT plant, hour_idx, reason, round(CASE WHEN reason = 'model' THEN p ELSE base END, 6) AS hybrid FROM al""")
def stored_estimates(spark, sf_dir):
    """A stored correction, checked and loaded, over all rows."""
    model, rows = _stored(spark, sf_dir)
    return rounded(model.estimate(rows, "plant").select("plant", "hour_idx", "reason", "hybrid"))


@query(f"WITH {_KEPT} SELECT rows, round(base_mae, 6) AS base_mae, round(hybrid_mae, 6) AS hybrid_mae FROM er")
def stored_reevaluation(spark, sf_dir):
    """The stored correction judged again on the rows that its evaluation recorded."""
    model, rows = _stored(spark, sf_dir)
    return rounded(stored.reevaluate(model, rows, "plant", "hour_idx"))


_USED = "reason = 'model'"
_LEVEL = lambda c, where: f"SELECT '{c}' AS cohort, CAST(sum(n) AS BIGINT) AS rows, count(*) AS hours, sum(eb) / sum(n) AS mae_before, sum(ea) / sum(n) AS mae_after, sum(abs(b - y)) / sum(abs(y)) AS wape_before, sum(abs(a - y)) / sum(abs(y)) AS wape_after FROM (SELECT hour_idx, count(*) AS n, sum(gen) AS y, sum(base) AS b, sum(hybrid) AS a, sum(abs(base - gen)) AS eb, sum(abs(hybrid - gen)) AS ea FROM ju WHERE {where} GROUP BY 1)"


@query(f"WITH {_HELD}, c AS ({_LEVEL('all', 'true')} UNION ALL {_LEVEL('known', _USED)}) SELECT cohort, rows, hours, round(mae_before, 6) AS mae_before, round(mae_after, 6) AS mae_after, round(wape_before, 6) AS wape_before, round(wape_after, 6) AS wape_after FROM c")
def holdout_metrics(spark, sf_dir):
    """The hold-out's errors, over all rows and over those that the model was used for."""
    return rounded(holdout.cohort_metrics(_held_out(spark, sf_dir), "hour_idx", "gen", "base", "hybrid"))


_MONTHS = f"""{_SALES}, two AS (SELECT *, base * 0.98 AS verified FROM sales), ea AS (SELECT month, CAST(hour AS DATE) AS d, plant, sum(gen) AS gen, sum(verified) AS verified, sum(base) AS b, sum(pred) AS a FROM two GROUP BY 1, 2, 3),
da AS (SELECT month, d, count(*) AS plants, sum(gen) AS gen, sum(verified) AS verified, sum(b) AS b, sum(a) AS a FROM ea GROUP BY 1, 2),
tg AS (SELECT month, d, plants, 'gen' AS target, abs(gen) AS size, abs(b - gen) AS eb, abs(a - gen) AS er FROM da UNION ALL SELECT month, d, plants, 'verified', abs(verified), abs(b - verified), abs(a - verified) FROM da),
sl AS (SELECT *, row_number() OVER (PARTITION BY month, target ORDER BY d) - 1 AS slot, count(*) OVER (PARTITION BY month, target) AS n FROM tg),
pl AS (SELECT month, count(DISTINCT plant) AS p FROM ea GROUP BY 1), tot AS (SELECT month, target, count(*) AS days, CAST(sum(plants) AS BIGINT) AS keys, sum(size) AS size, sum(eb) AS eb, sum(er) AS er FROM sl GROUP BY 1, 2),
st AS (SELECT tot.*, CASE WHEN days = day(last_day(CAST(month || '-01' AS DATE))) AND keys = p * days THEN 'complete' ELSE 'incomplete' END AS status FROM tot JOIN pl USING (month)),
dr AS (SELECT s.month, s.target, k.sample, (k.sample * 7919 + s.slot * 104729 + 12345) * 48271 % 2147483647 % s.n AS slot FROM sl s JOIN st ON st.month = s.month AND st.target = s.target AND status = 'complete', (SELECT unnest(range(200)) AS sample) k),
ga AS (SELECT dr.month, dr.target, dr.sample, (sum(eb) - sum(er)) / sum(size) AS g FROM dr JOIN sl ON sl.month = dr.month AND sl.target = dr.target AND sl.slot = dr.slot GROUP BY 1, 2, 3),
iv AS (SELECT month, target, quantile_cont(g, 0.025) AS low, quantile_cont(g, 0.975) AS high FROM ga GROUP BY 1, 2)"""


@query(f"""WITH {_MONTHS} SELECT month, target, status, days, keys, CASE WHEN status = 'complete' THEN round(eb / size, 6) END AS wape_before, CASE WHEN status = 'complete' THEN round(er / size, 6) END AS wape_after, CASE WHEN status = 'complete' THEN round((eb - er) / size, 6) END AS gain, round(low, 6) AS low, round(high, 6) AS high
FROM st LEFT JOIN iv USING (month, target)""")
def month_backtest(spark, sf_dir):
    """What lines were charged after their discount against their list price, month by month, judged by the charge and by another target in its place."""
    rows = _sales(spark, sf_dir).withColumns({"verified": F.col("base") * 0.98, "day": F.to_date("hour")})
    return rounded(holdout.month_backtest(rows, "month", "day", "plant", ["gen", "verified"], "base", "pred"))


_PAIRS = [("base", "ridge"), ("base", "effect"), ("ridge", "effect")]
_THREE = f"""{_RANK}, bl AS (SELECT hour_idx, {_BLOCK(4)} AS fold FROM rk), st AS (SELECT fold, min(hour_idx) AS a, max(hour_idx) AS z, min(hour_idx) - 6 AS cutoff FROM bl WHERE fold > 0 GROUP BY 1),
sm AS (SELECT fold, {_SUMS}, {_TARGET("y", "((gen - base) / 450)")}, {_TARGET("d", "w")} FROM scored, st WHERE hour_idx < cutoff GROUP BY 1),
be AS (SELECT fold, {", ".join(f"{x} AS {t}b{k}" for t in "yd" for k, x in enumerate(_solved(t, "1.0")))} FROM sm),
lo AS (SELECT st.fold, (gen - base) / 450 - (yb0 + yb1 * u + yb2 * v) AS y, w - (db0 + db1 * u + db2 * v) AS d FROM scored JOIN st ON hour_idx < cutoff JOIN be ON be.fold = st.fold), th AS (SELECT fold, sum(d * y) / sum(d * d) AS theta FROM lo GROUP BY 1),
kn AS (SELECT plant, min(hour_idx) AS since FROM scored GROUP BY 1),
co AS (SELECT s.plant, s.hour_idx, st.fold, s.gen, s.base, w, CASE WHEN since < cutoff THEN 'model' ELSE 'unknown_group' END AS reason, yb0 + yb1 * u + yb2 * v AS r, yb0 + yb1 * u + yb2 * v + theta * (w - (db0 + db1 * u + db2 * v)) AS e
FROM scored s JOIN st ON s.hour_idx BETWEEN a AND z JOIN be ON be.fold = st.fold JOIN th ON th.fold = st.fold JOIN kn ON kn.plant = s.plant),
es AS (SELECT plant, hour_idx, CAST(fold AS INTEGER) AS fold, gen, reason, base, CASE WHEN reason <> 'model' THEN base WHEN w < 3 OR w >= 25 THEN 0.0::DOUBLE ELSE least(greatest(base + r * 450, 0), 427.5::DOUBLE) END AS ridge,
CASE WHEN reason <> 'model' THEN base WHEN w < 3 OR w >= 25 THEN 0.0::DOUBLE ELSE least(greatest(base + e * 450, 0), 427.5::DOUBLE) END AS effect FROM co)"""


def _three(spark, sf_dir):
    rows = _residuals(spark, sf_dir)
    return paired.fold_estimates(rows, "hour_idx", "plant", fitted.expanding(rows, "hour_idx", 3, 6), "residual", "w", ["u", "v"])


@query(f"WITH {_THREE} SELECT plant, hour_idx, fold, reason, round(base, 6) AS base, round(ridge, 6) AS ridge, round(effect, 6) AS effect FROM es")
def fold_estimates(spark, sf_dir):
    """The power curve, a ridge correction of it and one with the wind's effect, on the same later rows of three folds."""
    return rounded(_three(spark, sf_dir).select("plant", "hour_idx", "fold", "reason", "base", "ridge", "effect"))


@query(f"""WITH {_THREE}, dy AS (SELECT fold AS own, hour_idx // 24 AS day, count(*) AS n, sum(abs(base - gen)) AS e_base, sum(abs(ridge - gen)) AS e_ridge, sum(abs(effect - gen)) AS e_effect FROM es GROUP BY 1, 2),
pa AS ({" UNION ALL ".join(f"SELECT own, day, n, '{a}' AS before, '{b}' AS after, e_{a} AS ea, e_{b} AS eb FROM dy" for a, b in _PAIRS)}), lv AS (SELECT own AS fold, * FROM pa UNION ALL SELECT 0, * FROM pa),
sl AS (SELECT *, row_number() OVER (PARTITION BY fold, before, after ORDER BY own, day) - 1 AS slot, count(*) OVER (PARTITION BY fold, before, after) AS days FROM lv),
tt AS (SELECT fold, before, after, CAST(sum(n) AS BIGINT) AS rows, count(*) AS days, sum(ea) / sum(n) AS mae_before, sum(eb) / sum(n) AS mae_after, (sum(ea) - sum(eb)) / sum(ea) AS gain FROM sl GROUP BY 1, 2, 3),
dr AS (SELECT fold, before, after, k.sample, (k.sample * 7919 + slot * 104729 + 12345) * 48271 % 2147483647 % days AS slot FROM sl, (SELECT unnest(range(200)) AS sample) k),
ga AS (SELECT fold, before, after, sample, (sum(ea) - sum(eb)) / sum(ea) AS g FROM dr JOIN sl USING (fold, before, after, slot) GROUP BY 1, 2, 3, 4),
iv AS (SELECT fold, before, after, quantile_cont(g, 0.025) AS low, quantile_cont(g, 0.975) AS high FROM ga GROUP BY 1, 2, 3)
SELECT fold, before, after, rows, days, round(mae_before, 6) AS mae_before, round(mae_after, 6) AS mae_after, round(gain, 6) AS gain, round(low, 6) AS low, round(high, 6) AS high, days < 10 AS underpowered FROM tt JOIN iv USING (fold, before, after)""")
def fold_comparison(spark, sf_dir):
    """Each of the three estimates against those before it, by fold and over all folds, with intervals over days."""
    return rounded(paired.fold_comparison(_three(spark, sf_dir), "fold", "hour_idx", "gen", ["base", "ridge", "effect"]))


@query()
def boosted_tuning(spark, sf_dir):
    """Two boosted corrections over two folds, each ended by its stopping block, the rounds they took, and the rounds that a refit of the better one would make."""
    s, c = W.cycle(F.hour("hour"), 24)
    rows = _residuals(spark, sf_dir).withColumns({"hour_sin": s, "hour_cos": c})
    folds = fitted.expanding(rows, "hour_idx", 2, 6, stopping=True)
    found = fitted.boosted_path(rows, "hour_idx", folds, "residual", ["w", "u", "v", "hour_sin", "hour_cos"], {"flat": {"depth": 2}, "deep": {"depth": 4}})
    out = fitted.ranked(spark.createDataFrame(found, "candidate string, fold int, rounds int, rows long, mae double"))
    return out.withColumn("refit_rounds", F.greatest(F.lit(1), F.floor(F.median("rounds").over(Window.partitionBy("candidate"))).cast("int")))

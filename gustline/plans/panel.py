"""Cleaning, joins in time and windows on the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustline.functions import scalars as S
from gustline.functions import wind as W
from gustline.operators import clean, joins, windows
from gustline.plans.registry import PANEL, SCORED, panel, query, rounded, scored, table


@query(f"WITH {PANEL} SELECT plant, hour, round(gen, 6) AS gen, n, u, v, hour_idx FROM panel")
def hourly_panel_sum(spark, sf_dir):
    return rounded(panel(spark, sf_dir))


_HALVES = """halves AS (SELECT event_type AS plant, time_bucket(INTERVAL 30 MINUTE, ts) AS half, sum(value) AS gen, max(value) AS top, bool_or(value > 90) AS high FROM events GROUP BY 1, 2)"""


def _halves(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("plant"), S.half_hour_floor(F.col("ts")).alias("half")).agg(F.sum("value").alias("gen"), F.max("value").alias("top"), F.bool_or(F.col("value") > 90).alias("high"))


@query(f"""WITH {_HALVES} SELECT plant, date_trunc('hour', half) AS hour, round(avg(gen), 6) AS gen, round(avg(top), 6) AS top, count(DISTINCT half) AS intervals
FROM halves GROUP BY 1, 2 HAVING count(DISTINCT half) >= 2""")
def half_hour_to_hour_mean(spark, sf_dir):
    return rounded(clean.half_hours_to_hours(_halves(spark, sf_dir), ["plant"], "half", ["gen", "top"]))


@query(f"""WITH {_HALVES} SELECT plant, date_trunc('hour', half) AS hour, round(CASE WHEN count(CASE WHEN top > 20 THEN gen END) = 2 THEN avg(CASE WHEN top > 20 THEN gen END) END, 6) AS gen
FROM halves GROUP BY 1, 2""")
def pairwise_complete_mean(spark, sf_dir):
    valid = F.when(F.col("top") > 20, F.col("gen"))
    return rounded(_halves(spark, sf_dir).groupBy("plant", S.hour_floor(F.col("half")).alias("hour")).agg(clean.pairwise_mean(valid).alias("gen")))


@query(f"""WITH {_HALVES} SELECT plant, date_trunc('hour', half) AS hour,
CASE WHEN count(*) = 2 AND count(CASE WHEN top > 20 THEN high END) = 2 THEN bool_or(CASE WHEN top > 20 THEN high END) END AS high FROM halves GROUP BY 1, 2""")
def three_valued_any(spark, sf_dir):
    flag = F.when(F.col("top") > 20, F.col("high"))
    return _halves(spark, sf_dir).groupBy("plant", S.hour_floor(F.col("half")).alias("hour")).agg(clean.three_valued_any(flag).alias("high"))


@query("""SELECT count(*) AS rows, count(CASE WHEN event_type NOT LIKE '%c%' THEN 1 END) AS out_of_scope, count(CASE WHEN value < 10 THEN 1 END) AS too_small,
count(CASE WHEN minute(ts) NOT IN (0, 30) THEN 1 END) AS off_grid, count(CASE WHEN event_type LIKE '%c%' AND NOT value < 10 AND minute(ts) IN (0, 30) THEN 1 END) AS valid FROM events""")
def scope_filter_counts(spark, sf_dir):
    reasons = {"out_of_scope": ~F.contains("event_type", F.lit("c")), "too_small": F.col("value") < 10, "off_grid": ~F.minute("ts").isin(0, 30)}
    return clean.count_reasons(table(spark, sf_dir, "events"), reasons)


@query("""SELECT l_orderkey, l_linenumber, round(CAST(l_extendedprice AS DOUBLE), 6) AS price, CAST(NULL AS DOUBLE) AS bad FROM lineitem""")
def brazil_number_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    text = F.translate(F.format_string("%,.2f", F.col("l_extendedprice").cast("double")), ",.", ".,")
    bad = F.concat(F.lit("x"), text)
    return rounded(rows.select("l_orderkey", "l_linenumber", S.local_number(text).alias("price"), S.local_number(bad).alias("bad")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE regexp_replace(upper(trim(p_brand)) || '.' || p_partkey, '\\.\\d+$', '') END AS root,
upper(trim(translate(p_name, 'aeo', 'aeo'))) AS folded FROM part""")
def text_root_extract(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    code = F.when(F.col("p_partkey") % 7 == 0, " - ").otherwise(F.concat(F.lit(" "), "p_brand", F.lit("."), F.col("p_partkey").cast("string"), F.lit(" ")))
    return rows.select("p_partkey", S.code_root(code).alias("root"), S.fold(F.translate("p_name", "aeo", "áéõ")).alias("folded"))


_MEMBERS = """members AS (SELECT event_type AS plant, user_id AS member, date_trunc('hour', ts) AS hour, count(*) AS records, sum(value) AS gen FROM events GROUP BY 1, 2, 3)"""


def _members(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("plant"), F.col("user_id").alias("member"), S.hour_floor(F.col("ts")).alias("hour")).agg(F.count("*").alias("records"), F.sum("value").alias("gen"))


@query(f"""WITH {_MEMBERS} SELECT plant, hour, count(*) AS members, round(sum(gen), 6) AS gen FROM members m
WHERE NOT EXISTS (SELECT 1 FROM members b WHERE b.plant = m.plant AND b.hour = m.hour AND b.records > 1) GROUP BY 1, 2""")
def whole_hour_rejection(spark, sf_dir):
    good = clean.whole_group_rejection(_members(spark, sf_dir), ["plant", "hour"], F.col("records") > 1)
    return rounded(good.groupBy("plant", "hour").agg(F.count("*").alias("members"), F.sum("gen").alias("gen")))


@query("""SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def dedupe_keep_last(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return rounded(clean.keep_one(rows, ["user_id", "event_type"], "event_id"))


@query(f"""WITH {PANEL}, users AS (SELECT event_type AS plant, date_trunc('hour', ts) AS hour, count(DISTINCT user_id) AS users FROM events WHERE value > 50 GROUP BY 1, 2)
SELECT (SELECT count(*) FROM panel) AS left_rows, (SELECT count(*) FROM users) AS right_rows, count(*) AS matched, round(count(*)::DOUBLE / (SELECT count(*) FROM panel), 6) AS share
FROM panel JOIN users USING (plant, hour)""")
def one_to_one_join_coverage(spark, sf_dir):
    users = _users(spark, sf_dir)
    return rounded(joins.coverage(panel(spark, sf_dir), users, ["plant", "hour"]))


def _users(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("value > 50")
    return events.groupBy(F.col("event_type").alias("plant"), S.hour_floor(F.col("ts")).alias("hour")).agg(F.count_distinct("user_id").alias("users"))


_USERS = "users AS (SELECT event_type AS plant, date_trunc('hour', ts) AS hour, count(DISTINCT user_id) AS users FROM events WHERE value > 50 GROUP BY 1, 2)"


@query(f"WITH {PANEL}, {_USERS} SELECT plant, hour, round(gen, 6) AS gen, users FROM panel LEFT JOIN users USING (plant, hour)")
def left_join_nullable_audit(spark, sf_dir):
    out = joins.many_to_one(panel(spark, sf_dir), _users(spark, sf_dir), ["plant", "hour"])
    return rounded(out.select("plant", "hour", "gen", "users"))


@query(f"WITH {PANEL}, {_USERS} SELECT plant, count(*) AS unmatched FROM panel p WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.plant = p.plant AND u.hour = p.hour) GROUP BY 1")
def anti_join_unmatched(spark, sf_dir):
    return panel(spark, sf_dir).join(_users(spark, sf_dir), ["plant", "hour"], "left_anti").groupBy("plant").agg(F.count("*").alias("unmatched"))


@query(f"WITH {PANEL}, {_USERS} SELECT plant, count(*) AS assigned, round(sum(gen), 6) AS gen FROM panel p WHERE EXISTS (SELECT 1 FROM users u WHERE u.plant = p.plant AND u.hour = p.hour AND u.users >= 2) GROUP BY 1")
def semi_join_assigned(spark, sf_dir):
    own = _users(spark, sf_dir).where("users >= 2")
    return rounded(panel(spark, sf_dir).join(own, ["plant", "hour"], "left_semi").groupBy("plant").agg(F.count("*").alias("assigned"), F.sum("gen").alias("gen")))


@query(f"""WITH {PANEL}, w AS (SELECT plant, hour, hour_idx, gen, u, max(gen) OVER l1 AS g1, max(gen) OVER l3 AS g3, max(gen) OVER l6 AS g6 FROM panel
WINDOW l1 AS (PARTITION BY plant ORDER BY hour_idx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), l3 AS (PARTITION BY plant ORDER BY hour_idx RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING),
l6 AS (PARTITION BY plant ORDER BY hour_idx RANGE BETWEEN 6 PRECEDING AND 6 PRECEDING))
SELECT plant, hour, round(g1, 6) AS lag_1, round(gen - g1, 6) AS gradient_1, round((gen - g3) / 3, 6) AS gradient_3, round((gen - g6) / 6, 6) AS gradient_6 FROM w""")
def exact_lag_gradient(spark, sf_dir):
    rows, key, gen = panel(spark, sf_dir), ["plant"], F.col("gen")
    grads = [windows.gradient(gen, key, "hour_idx", h).alias(f"gradient_{h}") for h in (1, 3, 6)]
    return rounded(rows.select("plant", "hour", windows.exact_lag(gen, key, "hour_idx", 1).alias("lag_1"), *grads))


def _frames(h: int) -> str:
    f = f"(PARTITION BY plant ORDER BY hour_idx RANGE BETWEEN {h - 1} PRECEDING AND CURRENT ROW)"
    ok = f"count(*) OVER {f} = {h}"
    parts = [f"CAST({ok} AS INTEGER) AS complete_{h}h"]
    for c in ("w", "u", "v"):
        parts += [f"round(CASE WHEN {ok} THEN avg({c}) OVER {f} END, 6) AS {c}_mean_{h}h", f"round(CASE WHEN {ok} THEN stddev_pop({c}) OVER {f} END, 6) AS {c}_std_{h}h"]
    return ", ".join(parts)


@query(f"WITH {SCORED} SELECT plant, hour, {_frames(3)}, {_frames(6)} FROM scored")
def rolling_3h_6h(spark, sf_dir):
    rows = scored(spark, sf_dir)
    for h in (3, 6):
        rows = windows.rolling(rows, ["plant"], "hour_idx", ["w", "u", "v"], h)
    return rounded(rows.select("plant", "hour", *(c for c in rows.columns if c.endswith(("_3h", "_6h")))))


@query(f"""WITH {PANEL}, c AS (SELECT plant, hour, CASE WHEN count(*) OVER (PARTITION BY plant ORDER BY hour_idx RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) = 7 THEN 1 ELSE 0 END AS complete FROM panel)
SELECT plant, hour, CAST(complete AS INTEGER) AS complete FROM c""")
def context_complete(spark, sf_dir):
    return panel(spark, sf_dir).select("plant", "hour", windows.context_complete(["plant"], "hour_idx", "gen").alias("complete"))


@query(f"""WITH {PANEL}, s AS (SELECT plant, hour_idx - lag(hour_idx) OVER (PARTITION BY plant ORDER BY hour_idx) AS step FROM panel)
SELECT plant, count(*) AS rows, count(CASE WHEN step > 1 THEN 1 END) AS gaps, CAST(coalesce(sum(CASE WHEN step > 1 THEN step - 1 END), 0) AS BIGINT) AS missing_hours FROM s GROUP BY 1""")
def gap_inventory(spark, sf_dir):
    return windows.gaps(panel(spark, sf_dir), ["plant"], "hour_idx")


@query("""WITH seg AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderdate AS a, o_orderdate + INTERVAL 60 DAY AS b FROM orders),
m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM seg)
SELECT k, count(*) AS overlaps FROM m WHERE a < before GROUP BY 1""")
def validity_overlap(spark, sf_dir):
    seg = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(60))).alias("b"))
    return windows.overlapping_segments(seg, ["k"], "a", "b").groupBy("k").agg(F.count("*").alias("overlaps"))


@query(f"""WITH {PANEL}, a AS (SELECT *, strftime(hour, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(hour, '%Y-%m-%d'), plant ORDER BY hour) AS inner_rank FROM panel),
b AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY inner_rank, plant, hour) AS outer_rank FROM a)
SELECT day, plant, hour, CAST(inner_rank AS INTEGER) AS inner_rank, CAST(outer_rank AS INTEGER) AS outer_rank FROM b ORDER BY b.outer_rank, day, plant LIMIT 30""")
def stratified_sample_30(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumn("day", F.date_format("hour", "yyyy-MM-dd"))
    return windows.stratified_sample(rows, "day", "plant", [F.col("hour")], 30).select("day", "plant", "hour", "inner_rank", "outer_rank")


@query(f"""WITH {SCORED} SELECT plant, hour, round(w, 6) AS speed, round((degrees(atan2(0 - u, 0 - v)) + 360) - 360 * floor((degrees(atan2(0 - u, 0 - v)) + 360) / 360), 6) AS blows_from,
round(sin(atan2(u, v)), 6) + 0.0 AS heading_sine, round(cos(atan2(u, v)), 6) + 0.0 AS heading_cosine FROM scored""")
def wind_speed_direction(spark, sf_dir):
    u, v = F.col("u"), F.col("v")
    return rounded(scored(spark, sf_dir).select("plant", "hour", F.col("w").alias("speed"), W.blows_from(u, v).alias("blows_from"), W.heading_sine(u, v).alias("heading_sine"), W.heading_cosine(u, v).alias("heading_cosine")))


@query(f"""WITH {PANEL} SELECT plant, hour, round((95000 + u * 10) / (287.05::DOUBLE * (290 + v)), 6) AS density, round(sin(hour(hour) * 2 * pi() / 24), 6) + 0.0 AS hour_sin, round(cos(hour(hour) * 2 * pi() / 24), 6) + 0.0 AS hour_cos,
round(sin(dayofyear(hour) * 2 * pi() / 365.25), 6) + 0.0 AS day_sin, round(cos(dayofyear(hour) * 2 * pi() / 365.25), 6) + 0.0 AS day_cos FROM panel""")
def air_density_calendar(spark, sf_dir):
    hs, hc = W.cycle(F.hour("hour"), 24)
    ds, dc = W.cycle(F.dayofyear("hour"), 365.25)
    density = W.air_density(F.col("u") * 10 + 95000, F.col("v") + 290)
    return rounded(panel(spark, sf_dir).select("plant", "hour", density.alias("density"), hs.alias("hour_sin"), hc.alias("hour_cos"), ds.alias("day_sin"), dc.alias("day_cos")))


_PSI = "CASE WHEN {z} > 0 THEN -5 * ({z}) WHEN {z} < 0 THEN 2 * ln((1 + pow(1 - 16 * ({z}), 0.25)) / 2) + ln((1 + sqrt(1 - 16 * ({z}))) / 2) - 2 * atan(pow(1 - 16 * ({z}), 0.25)) + pi() / 2 ELSE 0 END"


def _psi(z: str) -> str:
    return _PSI.format(z=z)


@query(f"""WITH {SCORED}, p AS (SELECT plant, hour, w, 80.0::DOUBLE + u AS hub, 0.05::DOUBLE AS z0, CASE WHEN v = 0 THEN 2e5::DOUBLE ELSE 50 * v END AS l FROM scored),
s AS (SELECT *, hub BETWEEN 10 AND 300 AS valid, ln(hub / z0) - CASE WHEN abs(l) >= 1e5 THEN 0 ELSE {_psi("hub / l")} - {_psi("z0 / l")} END AS a, ln(100 / z0) - CASE WHEN abs(l) >= 1e5 THEN 0 ELSE {_psi("100 / l")} - {_psi("z0 / l")} END AS b FROM p)
SELECT plant, hour, round(CASE WHEN valid AND a / b > 0 THEN w * (a / b) ELSE w END, 6) AS hub_speed, CASE WHEN valid AND a / b > 0 THEN 1 ELSE 0 END AS applied FROM s""")
def most_hub_wind(spark, sf_dir):
    rows = scored(spark, sf_dir)
    length = F.when(F.col("v") == 0, 2e5).otherwise(F.col("v") * 50)
    speed, applied = W.hub_speed(F.col("w"), F.col("u") + 80.0, F.lit(0.05), length)
    return rounded(rows.select("plant", "hour", speed.alias("hub_speed"), applied.alias("applied")))


@query(f"WITH {SCORED} SELECT plant, hour, round(base, 6) AS base, w <= 50 AS possible FROM scored")
def physical_curve(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("plant", "hour", "base", W.physical(F.col("w"), F.col("cap"), F.col("avail")).alias("possible")))


@query(f"WITH {SCORED} SELECT plant, hour, round(pred, 6) AS pred FROM scored")
def bounded_correction(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("plant", "hour", "pred"))

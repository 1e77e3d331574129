"""Preparation of observed hours, contracts, eligibility, features and estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustline.functions import scalars as S
from gustline.functions import wind as W
from gustline.operators import checks, clean, eligible, joins, metrics, observed, windows
from gustline.plans.panel import _psi
from gustline.plans.registry import PANEL, SCORED, panel, query, rounded, scored, table

_SRC = """one AS (SELECT event_id, CASE WHEN event_id % 41 = 0 THEN ' - ' WHEN event_id % 43 = 0 THEN NULL ELSE ' P' || (user_id % 10) || ' ' END AS id, CASE WHEN event_id % 17 = 0 THEN 'S' ELSE ' ne' END AS area,
CASE WHEN event_id % 19 = 0 THEN 'Hydro' ELSE 'Eol farm' END AS kind, CASE WHEN event_id % 23 = 0 THEN ts ELSE date_trunc('hour', ts) END + INTERVAL 3 HOUR AS t, CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 31 = 0 THEN -value ELSE value END AS gen FROM events),
src AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE event_id % 13 = 0), flags AS (SELECT *, trim(id) AS plant, upper(trim(area)) = 'NE' AND upper(kind) LIKE '%EOL%' AS scope, coalesce(trim(id) NOT IN ('', '-'), false) AS named FROM src),
ok AS (SELECT DISTINCT plant, t, gen FROM flags WHERE scope AND named AND gen >= 0 AND t = date_trunc('hour', t))"""
_MEM = """mem AS (SELECT 'P' || (s_suppkey % 12) AS plant, s_suppkey AS member, abs(s_acctbal) AS cap, CASE WHEN s_suppkey % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 20 AS INTEGER)) END AS "start",
CASE WHEN s_suppkey % 3 <> 0 THEN TIMESTAMP '2024-01-05' + to_days(CAST(s_suppkey % 20 AS INTEGER)) END AS "end" FROM supplier)"""
_ACTIVE = '("start" IS NULL OR "start" <= t) AND ("end" IS NULL OR t < "end" + INTERVAL 1 DAY)'


def _records(spark, sf_dir):
    """Events as a source that says the same twice, with odd areas, ids, times and numbers among them; text as a file has it."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        k,
        F.when(k % 41 == 0, " - ").when(k % 43 != 0, F.concat(F.lit(" P"), (F.col("user_id") % 10).cast("string"), F.lit(" "))).alias("id"),
        F.when(k % 17 == 0, "S").otherwise(" ne").alias("area"),
        F.when(k % 19 == 0, "Hydro").otherwise("Eol farm").alias("kind"),
        F.when(k % 23 == 0, F.col("ts")).otherwise(S.hour_floor(F.col("ts"))).alias("local"),
        F.when(k % 29 == 0, "x").when(k % 31 == 0, F.concat(F.lit("-"), F.translate(F.col("value").cast("string"), ".", ","))).otherwise(F.translate(F.col("value").cast("string"), ".", ",")).alias("value"),
    )
    return observed.source_records(rows.unionAll(rows.where("event_id % 13 = 0")), "America/Sao_Paulo", "NE", "EOL")


def _members(spark, sf_dir):
    k = F.col("s_suppkey")
    day = lambda start: F.lit(start).cast("timestamp_ntz") + F.make_dt_interval((k % 20).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("P"), (k % 12).cast("string")).alias("plant"), k.alias("member"), F.abs("s_acctbal").alias("cap"), F.when(k % 5 != 0, day("2024-01-01")).alias("start"), F.when(k % 3 != 0, day("2024-01-05")).alias("end")
    )


_HOURLY = f"""{_SRC}, {_MEM}, hourly AS (SELECT plant, t, sum(gen) AS gen, count(*) AS records FROM ok GROUP BY 1, 2),
caps AS (SELECT plant, t, sum(cap) AS cap FROM hourly JOIN mem USING (plant) WHERE {_ACTIVE} GROUP BY 1, 2), observed AS (SELECT plant, t, gen, records, cap, gen / cap AS factor FROM hourly JOIN caps USING (plant, t) WHERE cap > 0)"""


def _observed(spark, sf_dir):
    return observed.generation_hourly(_records(spark, sf_dir), _members(spark, sf_dir))


@query(f"WITH {_HOURLY} SELECT plant, t, round(gen, 6) AS gen, records, round(cap, 2) AS cap, round(factor, 6) AS factor FROM observed")
def generation_hourly(spark, sf_dir):
    return rounded(_observed(spark, sf_dir).withColumn("cap", F.round("cap", 2)))


@query(f"""WITH {_SRC} SELECT count(*) AS rows, count(CASE WHEN NOT scope THEN 1 END) AS out_of_scope, count(CASE WHEN scope AND NOT named THEN 1 END) AS without_id, count(CASE WHEN scope AND named AND t IS NULL THEN 1 END) AS bad_time,
count(CASE WHEN scope AND named AND gen IS NULL THEN 1 END) AS no_number, count(CASE WHEN scope AND named AND gen < 0 THEN 1 END) AS negative, count(CASE WHEN scope AND named AND gen >= 0 AND t <> date_trunc('hour', t) THEN 1 END) AS off_hour,
count(CASE WHEN scope AND named AND gen >= 0 AND t = date_trunc('hour', t) THEN 1 END) AS valid FROM flags""")
def generation_report(spark, sf_dir):
    names = ["out_of_scope", "without_id", "bad_time", "no_number", "negative", "off_hour", "valid"]
    return _records(spark, sf_dir).agg(F.count("*").alias("rows"), *(F.count_if(n).alias(n) for n in names))


@query(f"WITH {_SRC} SELECT event_id, plant, t, round(gen, 6) AS gen FROM flags WHERE scope AND named AND gen >= 0 AND t = date_trunc('hour', t)")
def valid_source_records(spark, sf_dir):
    return rounded(_records(spark, sf_dir).where("valid").select("event_id", "plant", "t", "gen"))


@query(f'WITH {_SRC} SELECT plant, t, count(*) AS "values" FROM ok GROUP BY 1, 2 HAVING count(*) > 1')
def conflicting_records(spark, sf_dir):
    return observed.conflicting_records(_records(spark, sf_dir))


_HALF = """half AS (SELECT 'P' || (user_id % 10) AS plant, time_bucket(INTERVAL 30 MINUTE, ts) AS half, value AS gen, value * 8 AS avail FROM events),
each AS (SELECT plant, half, max(gen) AS gen, max(avail) AS avail, count(DISTINCT gen) AS n FROM half GROUP BY 1, 2), hours AS (SELECT plant, date_trunc('hour', half) AS t, avg(gen) AS gen, avg(avail) AS avail, count(*) AS intervals, max(n) > 1 AS conflict FROM each GROUP BY 1, 2)"""


def _halves(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select(F.concat(F.lit("P"), (F.col("user_id") % 10).cast("string")).alias("plant"), S.half_hour_floor(F.col("ts")).alias("half"), F.col("value").alias("gen"), (F.col("value") * 8).alias("avail"))


@query(f"""WITH {_HALF}, {_MEM}, caps AS (SELECT plant, t, sum(cap) AS cap FROM hours JOIN mem USING (plant) WHERE {_ACTIVE} GROUP BY 1, 2)
SELECT plant, t AS hour, round(gen, 6) AS gen, round(avail, 6) AS avail, intervals, conflict, round(cap, 2) AS cap, round(least(avail / cap, 1), 6) AS availability FROM hours JOIN caps USING (plant, t) WHERE intervals >= 2 AND cap > 0 AND avail / cap BETWEEN 0 AND 1.05""")
def restriction_hourly(spark, sf_dir):
    out = observed.restriction_hourly(_halves(spark, sf_dir), _members(spark, sf_dir), ["gen", "avail"], "avail")
    return rounded(out.withColumn("cap", F.round("cap", 2)))


_TIMES = """r AS (SELECT CASE WHEN event_id % 31 = 0 THEN ' -' ELSE 'P' || user_id % 10 END AS id, CASE WHEN event_id % 37 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN time_bucket(INTERVAL 30 MINUTE, ts) WHEN event_id % 3 = 1 THEN time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 7 SECOND ELSE date_trunc('minute', ts) END END AS t, value FROM events),
f AS (SELECT *, trim(id) AS plant, CASE WHEN trim(id) = '-' THEN 'without_id' WHEN t IS NULL THEN 'bad_time' WHEN t <> time_bucket(INTERVAL 30 MINUTE, t) THEN 'off_grid' END AS fault, minute(t) IN (0, 30) AS by_minute FROM r)"""


def _timed(spark, sf_dir):
    """A third of the events at half hours, a third seven seconds behind, the others at any minute; some without an id or a time."""
    k, half = F.col("event_id"), S.half_hour_floor(F.col("ts"))
    at = F.when(k % 3 == 0, half).when(k % 3 == 1, half + F.make_dt_interval(secs=F.lit(7))).otherwise(F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select(F.when(k % 31 == 0, " -").otherwise(F.concat(F.lit("P"), (F.col("user_id") % 10).cast("string"))).alias("id"), F.when(k % 37 != 0, at).alias("t"), F.col("value").alias("gen"))


@query(f"""WITH {_TIMES} SELECT plant, count(*) AS rows, count(CASE WHEN fault = 'without_id' THEN 1 END) AS without_id, count(CASE WHEN fault = 'bad_time' THEN 1 END) AS bad_time, count(CASE WHEN fault = 'off_grid' THEN 1 END) AS off_grid, count(CASE WHEN fault = 'off_grid' AND by_minute THEN 1 END) AS by_minute FROM f GROUP BY 1""")
def half_hour_report(spark, sf_dir):
    """Records off the half hours, and how many of them a look at the minute alone would let pass."""
    out = observed.half_hour_records(_timed(spark, sf_dir), "id", "t")
    off = F.col("fault") == "off_grid"
    counts = [F.count_if(F.col("fault") == c).alias(c) for c in ("without_id", "bad_time", "off_grid")]
    return out.groupBy("plant").agg(F.count("*").alias("rows"), *counts, F.count_if(off & observed.on_half_hours(F.col("t"), exact=False)).alias("by_minute"))


@query(f"""WITH {_TIMES}, {_MEM}, each AS (SELECT plant, t AS half, max(value) AS gen, count(DISTINCT value) AS n FROM f WHERE fault IS NULL GROUP BY 1, 2), hours AS (SELECT plant, date_trunc('hour', half) AS t, avg(gen) AS gen, count(*) AS intervals, max(n) > 1 AS conflict FROM each GROUP BY 1, 2),
caps AS (SELECT plant, t, sum(cap) AS cap FROM hours JOIN mem USING (plant) WHERE {_ACTIVE} GROUP BY 1, 2)
SELECT plant, t AS hour, round(gen, 6) AS gen, intervals, conflict, round(cap, 2) AS cap, round(least(gen / cap, 1), 6) AS availability FROM hours JOIN caps USING (plant, t) WHERE intervals >= 2 AND cap > 0 AND gen / cap BETWEEN 0 AND 1.05""")
def restriction_on_grid(spark, sf_dir):
    """Hours of the records that lie on half hours."""
    rows = observed.half_hour_records(_timed(spark, sf_dir), "id", "t").where("fault IS NULL")
    return rounded(observed.restriction_hourly(rows, _members(spark, sf_dir), ["gen"], "gen").withColumn("cap", F.round("cap", 2)))


_WEATHER = f"{PANEL}, weather AS (SELECT plant, hour, u, v, 280 + v * 8 AS temperature, 95000 + u * 900 AS pressure FROM panel)"
_POSSIBLE = "sqrt(u * u + v * v) <= 50 AND temperature BETWEEN 150 AND 350 AND pressure BETWEEN 50000 AND 120000"


def _weather(spark, sf_dir):
    return panel(spark, sf_dir).select("plant", "hour", "u", "v", (F.col("v") * 8 + 280).alias("temperature"), (F.col("u") * 900 + 95000).alias("pressure"))


def _ok_weather():
    return observed.possible_weather(*(F.col(c) for c in ("u", "v", "temperature", "pressure")))


@query(f"WITH {_WEATHER} SELECT * FROM weather WHERE {_POSSIBLE}")
def weather_range_filter(spark, sf_dir):
    return _weather(spark, sf_dir).where(_ok_weather())


@query(f"WITH {_WEATHER}, users AS (SELECT DISTINCT event_type AS plant, date_trunc('hour', ts) AS hour FROM events WHERE value > 50) SELECT count(*) AS invalid_matched FROM users JOIN weather USING (plant, hour) WHERE NOT ({_POSSIBLE})")
def invalid_weather_overlap(spark, sf_dir):
    keys = table(spark, sf_dir, "events").where("value > 50").select(F.col("event_type").alias("plant"), S.hour_floor(F.col("ts")).alias("hour")).distinct()
    return keys.join(_weather(spark, sf_dir).where(~_ok_weather()), ["plant", "hour"], "left_semi").agg(F.count("*").alias("invalid_matched"))


@query(f"""WITH {_SRC}, k AS (SELECT trim(id) AS id, t, count(*) OVER (PARTITION BY trim(id), t) AS n FROM src), r AS (SELECT count(*) AS rows, count(CASE WHEN id IS NULL OR id IN ('', '-') THEN 1 END) AS without_id, count(CASE WHEN t IS NULL THEN 1 END) AS without_time,
count(CASE WHEN t <> date_trunc('hour', t) THEN 1 END) AS off_hour, count(CASE WHEN n > 1 THEN 1 END) AS repeated FROM k) SELECT *, without_id + without_time + off_hour + repeated = 0 AS holds FROM r""")
def keyed_contract(spark, sf_dir):
    return observed.keyed_report(_records(spark, sf_dir), "id", "t")


@query("""WITH k AS (SELECT o_custkey, o_orderdate FROM orders), h AS (SELECT sha256('=' || o_custkey || '|=' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')) AS h FROM k),
d AS (SELECT count(*) AS rows, sum(CAST('0x' || h[1:8] AS UBIGINT)) AS a, sum(CAST('0x' || h[9:16] AS UBIGINT)) AS b, sum(CAST('0x' || h[17:24] AS UBIGINT)) AS c, sum(CAST('0x' || h[25:32] AS UBIGINT)) AS e FROM h)
SELECT (SELECT count(*) FROM k) AS rows, (SELECT count(DISTINCT o_orderdate) FROM k) AS hours, (SELECT count(DISTINCT o_custkey) FROM k) AS plants, (SELECT min(o_orderdate) FROM k) AS "start", (SELECT max(o_orderdate) FROM k) AS "end",
sha256(rows || '|' || CAST(a AS BIGINT) || '|' || CAST(b AS BIGINT) || '|' || CAST(c AS BIGINT) || '|' || CAST(e AS BIGINT)) AS digest FROM d""")
def cohort_identity(spark, sf_dir):
    return observed.cohort(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@query(f"""WITH {_HOURLY}, {_HALF}, x AS (SELECT o.plant, o.t, o.gen, h.gen AS other FROM observed o LEFT JOIN hours h ON h.plant = o.plant AND h.t = o.t)
SELECT count(other) AS paired_rows, round(avg(abs(gen - other)), 6) AS mae, round(max(abs(gen - other)), 6) AS max_abs, count(CASE WHEN abs(gen - other) > 0.001 THEN 1 END) AS rows_beyond FROM x""")
def source_reconciliation(spark, sf_dir):
    halves = _halves(spark, sf_dir).groupBy("plant", "half").agg(F.max("gen").alias("gen"))
    other = halves.groupBy("plant", S.hour_floor(F.col("half")).alias("t")).agg(F.avg("gen").alias("other"))
    rows = _observed(spark, sf_dir).join(other, ["plant", "t"], "left")
    return rounded(rows.agg(F.count("other").alias("paired_rows"), *metrics.reconciliation(F.col("gen"), F.col("other"))))


@query(f"WITH {PANEL} SELECT plant, hour, round(gen, 6) AS gen FROM panel WHERE hour < (SELECT min(hour) FROM panel) + INTERVAL 7 DAY")
def experiment_window(spark, sf_dir):
    return rounded(observed.window_of_days(panel(spark, sf_dir), "hour", 7).select("plant", "hour", "gen"))


@query(f"WITH {PANEL} SELECT plant, hour, round(gen, 6) AS gen FROM panel WHERE hour = TIMESTAMP '2024-01-10 12:00:00'")
def instant_slice(spark, sf_dir):
    return rounded(panel(spark, sf_dir).where(F.col("hour") == F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")).select("plant", "hour", "gen"))


@query("""WITH x AS (SELECT o_orderkey, o_orderdate AS t, CASE WHEN o_custkey % 50 = 0 THEN 1.2 ELSE o_custkey % 50 / 50.0 END AS a FROM orders)
SELECT CASE WHEN t < TIMESTAMP '1995-02-01' THEN 'too_early' WHEN t > TIMESTAMP '2001-06-30' THEN 'in_future' WHEN a > 1 THEN 'availability' ELSE 'ok' END AS verdict, count(*) AS rows FROM x GROUP BY 1""")
def date_guards(spark, sf_dir):
    k = F.col("o_custkey") % 50
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("t"), F.when(k == 0, 1.2).otherwise(k / 50).alias("a"))
    return rows.groupBy(S.date_guard(F.col("t"), "1995-02-01", "2001-06-30", F.col("a")).alias("verdict")).agg(F.count("*").alias("rows"))


_FAULT = "CASE WHEN target IS NULL THEN 'null' WHEN target < 0 THEN 'negative' WHEN target > 450 THEN 'above_capacity' WHEN target > available + 1e-9 THEN 'above_available' ELSE 'eligible' END"


@query(f"""WITH {PANEL}, x AS (SELECT CASE WHEN hour_idx % 11 = 0 THEN NULL WHEN hour_idx % 13 = 0 THEN -gen ELSE gen * 3 END AS target, 450.0 * 0.6 AS available FROM panel)
SELECT {_FAULT} AS fault, count(*) AS rows, round(sum(target), 4) AS total FROM x GROUP BY 1""")
def target_eligibility(spark, sf_dir):
    i = F.col("hour_idx")
    rows = panel(spark, sf_dir).select(F.when(i % 11 == 0, None).when(i % 13 == 0, -F.col("gen")).otherwise(F.col("gen") * 3).alias("target"))
    fault = F.coalesce(eligible.target_fault(F.col("target"), F.lit(450.0), F.lit(450.0) * 0.6), F.lit("eligible"))
    return rounded(rows.groupBy(fault.alias("fault")).agg(F.count("*").alias("rows"), F.round(F.sum("target"), 4).alias("total")))


def _window(h: int) -> str:
    return f"(PARTITION BY plant ORDER BY hour_idx RANGE BETWEEN {h - 1} PRECEDING AND CURRENT ROW)"


def _lag(c: str, h: int) -> str:
    return f"max({c}) OVER (PARTITION BY plant ORDER BY hour_idx RANGE BETWEEN {h} PRECEDING AND {h} PRECEDING)"


_PRE = f"""{PANEL}, inputs AS (SELECT plant, hour, hour_idx, gen, u, v, CASE WHEN n % 5 <> 0 THEN 290 + v END AS temperature, 95000 + u * 10 AS pressure, CASE WHEN hour_idx % 7 <> 0 THEN 0.95::DOUBLE END AS availability, 80 + u AS hub, 0.05::DOUBLE AS z0,
CASE WHEN v = 0 THEN 2e5::DOUBLE ELSE 50 * v END AS l, CASE WHEN n % 4 <> 0 THEN 1.0::DOUBLE * n END AS km, sqrt(u * u + v * v) AS w100 FROM panel),
parts AS (SELECT *, ln(hub / z0) - CASE WHEN abs(l) >= 1e5 THEN 0 ELSE {_psi("hub / l")} - {_psi("z0 / l")} END AS a, ln(100 / z0) - CASE WHEN abs(l) >= 1e5 THEN 0 ELSE {_psi("100 / l")} - {_psi("z0 / l")} END AS b FROM inputs),
hubs AS (SELECT *, CASE WHEN hub BETWEEN 10 AND 300 AND a / b > 0 THEN 1 ELSE 0 END AS applied, CASE WHEN hub BETWEEN 10 AND 300 AND a / b > 0 THEN w100 * (a / b) ELSE w100 END AS wh FROM parts),
lagged AS (SELECT *, count(*) OVER {_window(3)} = 3 AS c3, count(*) OVER {_window(6)} = 6 AS c6, {_lag("wh", 1)} AS l1, {_lag("wh", 3)} AS l3, {_lag("wh", 6)} AS l6 FROM hubs)"""


def _means(h: int) -> str:
    w = _window(h)
    return f"""round(CASE WHEN c{h} THEN avg(wh) OVER {w} END, 6) AS wind_speed_mean_{h}h, round(CASE WHEN c{h} THEN stddev_pop(wh) OVER {w} END, 6) AS wind_speed_std_{h}h, round(CASE WHEN c{h} THEN avg(u) OVER {w} END, 6) AS u_mean_{h}h,
round(CASE WHEN c{h} THEN avg(v) OVER {w} END, 6) AS v_mean_{h}h, CAST(c{h} AS INTEGER) AS history_complete_{h}h"""


_CONTEXT = "CAST(c3 AND c6 AND l1 IS NOT NULL AND l3 IS NOT NULL AND l6 IS NOT NULL AS INTEGER)"


@query(f"""WITH {_PRE} SELECT plant, hour, round(w100, 6) AS wind_speed_100m, round(wh, 6) AS wind_speed_hub_m, applied AS most_applied, 1 - applied AS most_missing, round(sin(atan2(u, v)), 6) + 0.0 AS wind_dir_sin, round(cos(atan2(u, v)), 6) + 0.0 AS wind_dir_cos,
round(pressure / (287.05::DOUBLE * temperature), 6) AS air_density_kg_m3, round(sin(hour(hour) * 2 * pi() / 24), 6) + 0.0 AS hour_sin, round(cos(hour(hour) * 2 * pi() / 24), 6) + 0.0 AS hour_cos, round(sin(dayofyear(hour) * 2 * pi() / 365.25), 6) + 0.0 AS doy_sin,
round(cos(dayofyear(hour) * 2 * pi() / 365.25), 6) + 0.0 AS doy_cos, 450.0::DOUBLE AS capacity_mw, availability, CAST(temperature IS NULL AS INTEGER) AS temperature_missing, 0 AS pressure_missing, CAST(availability IS NULL AS INTEGER) AS availability_missing,
km AS grid_distance_km, CAST(km IS NOT NULL AS INTEGER) AS grid_distance_known, {_means(3)}, {_means(6)}, round(wh - l1, 6) + 0.0 AS wind_speed_gradient_1h, round((wh - l3) / 3, 6) + 0.0 AS wind_speed_gradient_3h, round((wh - l6) / 6, 6) + 0.0 AS wind_speed_gradient_6h,
{_CONTEXT} AS temporal_context_complete FROM lagged""")
def feature_matrix(spark, sf_dir):
    return rounded(_features(spark, sf_dir))


def _inputs(spark, sf_dir):
    n, i = F.col("n"), F.col("hour_idx")
    return panel(spark, sf_dir).withColumns(
        {
            "temperature": F.when(n % 5 != 0, F.col("v") + 290),
            "pressure": F.col("u") * 10 + 95000,
            "capacity_mw": F.lit(450.0),
            "availability": F.when(i % 7 != 0, 0.95),
            "hub": F.col("u") + 80,
            "roughness": F.lit(0.05),
            "length": F.when(F.col("v") == 0, 2e5).otherwise(F.col("v") * 50),
            "grid_distance_km": F.when(n % 4 != 0, n.cast("double")),
        }
    )


def _features(spark, sf_dir):
    return eligible.feature_matrix(_inputs(spark, sf_dir), ["plant"], "hour", "hour_idx")


@query(f"WITH {_PRE} SELECT plant, hour, round(wh, 6) AS wind_speed_hub_m FROM lagged WHERE {_CONTEXT} = 1")
def context_eligibility(spark, sf_dir):
    return rounded(_features(spark, sf_dir).where("temporal_context_complete = 1").select("plant", "hour", "wind_speed_hub_m"))


@query("""SELECT sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS value_missing, sum(CASE WHEN props IS NULL THEN 1 ELSE 0 END)::BIGINT AS props_missing, count(*) AS rows FROM events""")
def missing_indicators(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value"))).withColumn("props_length", F.length("props").cast("double"))
    flagged = rows.withColumns(eligible.missing_flags({"value_missing": "value", "props_missing": "props_length"}))
    return flagged.agg(F.sum("value_missing").alias("value_missing"), F.sum("props_missing").alias("props_missing"), F.count("*").alias("rows"))


_CUT = "cutoff AS (SELECT min(hour_idx) + 480 AS h FROM panel)"
_TRAIN = f"{PANEL}, {_CUT}, train AS (SELECT * FROM panel, cutoff WHERE hour_idx < h AND plant <> (SELECT min(plant) FROM panel)), rest AS (SELECT * FROM panel, cutoff WHERE hour_idx >= h)"


def _split(spark, sf_dir):
    rows = panel(spark, sf_dir)
    facts = rows.agg((F.min("hour_idx") + 480).alias("_h"), F.min("plant").alias("_p"))
    rows = rows.join(F.broadcast(facts))  # one row
    drop = lambda df: df.drop("_h", "_p")
    return drop(rows.where("hour_idx < _h AND plant <> _p")), drop(rows.where("hour_idx >= _h"))


@query(f"""WITH {_TRAIN} SELECT * FROM (SELECT 'gen' AS "column", round(min(gen), 6) AS least, round(max(gen), 6) AS most FROM train UNION ALL SELECT 'u', min(u), max(u) FROM train UNION ALL SELECT 'v', min(v), max(v) FROM train)""")
def training_domain(spark, sf_dir):
    return rounded(eligible.input_domain(_split(spark, sf_dir)[0], ["gen", "u", "v"]))


@query(f"""WITH {_TRAIN}, lim AS (SELECT min(gen) AS lo, max(gen) AS hi, min(u) AS ulo, max(u) AS uhi FROM train), k AS (SELECT plant, hour, plant IN (SELECT plant FROM train) AS known, gen BETWEEN lo AND hi AND u BETWEEN ulo AND uhi AS inside FROM rest, lim)
SELECT plant, hour, known, known AND inside AS in_domain, CASE WHEN NOT known THEN 'unknown_plant' WHEN NOT inside THEN 'incomplete_temporal_context' ELSE 'none' END AS fallback_reason FROM k""")
def domain_guard(spark, sf_dir):
    train, rest = _split(spark, sf_dir)
    out = eligible.inside_domain(rest, train, "plant", ["gen", "u"])
    return out.select("plant", "hour", "known", "in_domain", eligible.fallback_reason(F.col("known"), F.col("in_domain")).alias("fallback_reason"))


@query("""WITH m AS (SELECT c_nationkey AS plant, CASE WHEN c_acctbal < -900 THEN 'review_required' ELSE 'matched' END AS status, TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 40 AS INTEGER)) AS "start", CASE WHEN c_custkey % 4 <> 0 THEN TIMESTAMP '2024-01-20' + to_days(CAST(c_custkey % 30 AS INTEGER)) END AS "end" FROM customer)
SELECT plant, count(*) AS members FROM m WHERE "start" <= TIMESTAMP '2024-01-25 06:00:00' AND ("end" IS NULL OR TIMESTAMP '2024-01-25 06:00:00' < "end" + INTERVAL 1 DAY) GROUP BY 1 HAVING bool_and(status = 'matched')""")
def fully_matched_at(spark, sf_dir):
    k = F.col("c_custkey")
    day = lambda start, n: F.lit(start).cast("timestamp_ntz") + F.make_dt_interval((k % n).cast("int"))
    status = F.when(F.col("c_acctbal") < -900, "review_required").otherwise("matched")
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("plant"), status.alias("status"), day("2024-01-01", 40).alias("start"), F.when(k % 4 != 0, day("2024-01-20", 30)).alias("end"))
    return eligible.fully_matched(members, "plant", "status", F.lit("2024-01-25 06:00:00").cast("timestamp_ntz"))


@query(f"""WITH {PANEL}, x AS (SELECT plant, hour, gen / 40 * 100 AS factor, CASE WHEN n % 3 = 0 THEN 0.0 WHEN n % 3 = 1 THEN 60.0 ELSE 100.0 END AS share FROM panel)
SELECT plant, hour, round(factor, 6) AS factor, concat_ws(',', CASE WHEN factor > 105 THEN 'above_capacity' END, CASE WHEN share = 0 THEN 'no_bus' WHEN share < 100 THEN 'partial_bus' END) AS notes FROM x""")
def capacity_warnings(spark, sf_dir):
    n = F.col("n") % 3
    factor, notes = eligible.capacity_warnings(F.col("gen"), F.lit(40.0), F.when(n == 0, 0.0).when(n == 1, 60.0).otherwise(100.0))
    return rounded(panel(spark, sf_dir).select("plant", "hour", factor.alias("factor"), F.concat_ws(",", notes).alias("notes")))


_BANDQ = "bq AS (SELECT band, quantile_cont((gen - pred) / 450, 0.05) AS p05, quantile_cont((gen - pred) / 450, 0.95) AS p95, count(*) AS n FROM scored GROUP BY 1), aq AS (SELECT quantile_cont((gen - pred) / 450, 0.05) AS a05, quantile_cont((gen - pred) / 450, 0.95) AS a95 FROM scored), iv AS (SELECT band, CASE WHEN n >= 100 THEN p05 ELSE a05 END AS p05, CASE WHEN n >= 100 THEN p95 ELSE a95 END AS p95 FROM bq, aq)"


@query(f"""WITH {SCORED}, {_BANDQ}, e AS (SELECT *, hour_idx % 3 = 0 AS used, w < 3 OR w >= 25 AS idle FROM scored), f AS (SELECT *, CASE WHEN idle THEN 0 ELSE least(greatest(base + CASE WHEN used THEN 22.5 ELSE 0 END, 0), 427.5) END AS estimate FROM e),
g AS (SELECT f.*, CASE WHEN used THEN CASE WHEN idle THEN 0 ELSE least(greatest(estimate + p05 * 450, 0), 427.5) END END AS lower, CASE WHEN used THEN CASE WHEN idle THEN 0 ELSE least(greatest(estimate + p95 * 450, 0), 427.5) END END AS upper FROM f JOIN iv USING (band))
SELECT plant, hour, round(base, 6) AS base, round(estimate - base, 6) AS correction, round(estimate, 6) AS estimate, round(lower, 6) AS lower, round(upper, 6) AS upper, CASE WHEN used THEN 'medium' ELSE 'low' END AS confidence,
concat_ws(',', CASE WHEN used THEN 'empirical_interval' ELSE 'no_interval' END, CASE WHEN NOT used THEN 'physical_curve' END, CASE WHEN idle THEN 'outside_operating_range' END) AS notes FROM g""")
def predict_records(spark, sf_dir):
    rows = scored(spark, sf_dir)
    intervals = metrics.interval_table(rows, "band", (F.col("gen") - F.col("pred")) / F.col("cap"), least=100)
    out = eligible.estimates(rows, F.lit(0.05), intervals, F.col("hour_idx") % 3 == 0)
    return rounded(out.select("plant", "hour", "base", (F.col("estimate") - F.col("base")).alias("correction"), "estimate", "lower", "upper", "confidence", F.concat_ws(",", "notes").alias("notes")))


@query(f"""WITH {PANEL} SELECT count(*) AS rows, 0 AS repeated, 0 AS null_u, 0 AS null_v, count(CASE WHEN u NOT BETWEEN -20 AND 20 THEN 1 END) AS range_u, count(CASE WHEN v NOT BETWEEN -50 AND 50 THEN 1 END) AS range_v, 0 AS off_hour, count(DISTINCT hour) AS hours,
round(count(DISTINCT hour) / 720.0, 6) AS coverage, false AS valid FROM panel""")
def weather_partition_quality(spark, sf_dir):
    return rounded(clean.weather_quality(panel(spark, sf_dir), ["plant"], "hour", {"u": (-20, 20), "v": (-50, 50)}, expected=720)).withColumns({c: F.col(c).cast("int") for c in ("repeated", "null_u", "null_v", "off_hour")})


@query("""WITH v AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 5 END AS version, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS x FROM orders), a AS (SELECT k, max(CASE WHEN version = 1 THEN x END) AS best, max(CASE WHEN version = 5 THEN x END) AS spare FROM v GROUP BY 1)
SELECT k, round(coalesce(best, spare), 6) AS x, CASE WHEN best IS NOT NULL THEN 1 WHEN spare IS NOT NULL THEN 5 END AS version FROM a""")
def version_resolve(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.when(k % 3 == 0, 1).otherwise(5).alias("version"), F.when(k % 7 != 0, F.col("o_totalprice")).alias("x"))
    x, version = clean.prefer_final(F.col("x"), F.col("version"))
    return rounded(rows.groupBy("k").agg(x.alias("x"), version.alias("version")))


@query(f"""WITH {PANEL}, r AS (SELECT plant, hour, row_number() OVER (PARTITION BY plant ORDER BY hour) - 1 AS rank, count(*) OVER (PARTITION BY plant) AS n FROM panel)
SELECT plant, hour FROM r WHERE n <= 168 OR rank = 0 OR rank * 167 // (n - 1) <> (rank - 1) * 167 // (n - 1)""")
def even_positions(spark, sf_dir):
    from pyspark.sql import Window

    own = Window.partitionBy("plant")
    rows = panel(spark, sf_dir).select("plant", "hour", (F.row_number().over(own.orderBy("hour")) - 1).alias("rank"), F.count("*").over(own).alias("n"))
    return rows.where(windows.positions(F.col("n"), F.col("rank"), 168)).select("plant", "hour")


@query(f"""WITH {PANEL}, s AS (SELECT plant, hour, CASE WHEN gen > 300 THEN gen END AS mark FROM panel) SELECT plant, hour, round(last_value(mark IGNORE NULLS) OVER (PARTITION BY plant ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS carried FROM s""")
def carry_forward(spark, sf_dir):
    mark = F.when(F.col("gen") > 300, F.col("gen"))
    return rounded(panel(spark, sf_dir).select("plant", "hour", windows.carry_forward(mark, "hour", ["plant"]).alias("carried")))


#: First days and first days after of summer time in the zone of the query below (fixed values).
_SUMMERS = [("1995-10-15", "1996-02-11"), ("1996-10-06", "1997-02-16"), ("1997-10-06", "1998-03-01"), ("1998-10-11", "1999-02-21"), ("1999-10-03", "2000-02-27"), ("2000-10-08", "2001-02-18")]
_IN_SUMMER = " OR ".join(f"(t > TIMESTAMP '{a}' AND t < TIMESTAMP '{b}')" for a, b in [("1994-10-16", "1995-02-19"), *_SUMMERS])


@query(f"""SELECT o_orderkey, CASE WHEN t IN ({", ".join(f"TIMESTAMP '{a}'" for a, _ in _SUMMERS)}) THEN NULL WHEN {_IN_SUMMER} THEN t + INTERVAL 2 HOUR ELSE t + INTERVAL 3 HOUR END AS utc FROM (SELECT o_orderkey, o_orderdate AS t FROM orders)""")
def strict_local_time(spark, sf_dir):
    """Midnights of order dates as wall-clock times of a zone whose summer time begins at midnight: there is none on those days."""
    return table(spark, sf_dir, "orders").select("o_orderkey", S.to_utc_strict(F.col("o_orderdate"), "America/Sao_Paulo").alias("utc"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN date_trunc('hour', ts) + INTERVAL 3 HOUR WHEN minute(ts) = 0 AND second(ts) = 0 THEN date_trunc('second', ts) END AS t FROM events""")
def strict_iso_hour(spark, sf_dir):
    k, ts = F.col("event_id") % 3, F.col("ts")
    hour, minute = F.date_format(S.hour_floor(ts), "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(k == 0, hour).when(k == 1, F.concat(hour, F.lit("-03:00"))).otherwise(F.concat(minute, F.lit("Z")))
    parsed = F.to_timestamp_ntz(F.date_format(S.strict_iso_hour(text), "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("t"))


@query("""SELECT c_mktsegment AS name, count(*) AS rows FROM customer GROUP BY 1""")
def column_aliases(spark, sf_dir):
    """A column found under another case, with marks and outer space, and renamed."""
    rows = table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", " Ségmento ")
    rows = checks.rename(checks.require(rows, ["c_custkey"]), {checks.find_column(rows, ["name", "SEGMENTO"]): "name"})
    return rows.groupBy("name").agg(F.count("*").alias("rows"))


@query("""SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers, true AS subset, true AS disjoint""")
def set_contracts(spark, sf_dir):
    """Order customers are customers; open and filled orders share no key."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    checks.require_subset(orders.select(F.col("o_custkey").alias("c_custkey")), customers, ["c_custkey"])
    checks.require_disjoint(orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus = 'F'"), ["o_orderkey"])
    return orders.agg(F.count("*").alias("orders")).join(customers.agg(F.count("*").alias("customers"))).withColumns({"subset": F.lit(True), "disjoint": F.lit(True)})


@query(f"WITH {PANEL}, w AS (SELECT DISTINCT plant FROM panel WHERE gen > 400) SELECT plant, count(*) AS rows FROM panel WHERE plant IN (SELECT plant FROM w) GROUP BY 1")
def small_set_membership(spark, sf_dir):
    rows = panel(spark, sf_dir)
    return joins.among(rows, rows.where("gen > 400").select("plant").distinct(), "plant").groupBy("plant").agg(F.count("*").alias("rows"))


@query(f"""WITH {SCORED} SELECT plant, hour, round((gen - base) / 450, 6) AS residual, round(gen / 450, 6) AS target, round(CASE WHEN w < 3 OR w >= 25 THEN 0 ELSE least(greatest(base + 0.5 * ((gen - base) / 450) * 450, 0), 427.5) END, 6) AS scaled FROM scored""")
def residual_targets(spark, sf_dir):
    residual, target = W.capacity_factors(F.col("gen"), F.col("base"), F.col("cap"))
    rows = scored(spark, sf_dir).withColumns({"residual": residual, "target": target})
    return rounded(rows.select("plant", "hour", "residual", "target", W.scaled(F.col("base"), F.col("residual"), 0.5, F.col("w"), F.col("cap"), F.col("avail")).alias("scaled")))


@query(f"WITH {PANEL} SELECT plant, hour, round(gen, 6) AS gen, n FROM panel")
def hourly_sum_of_copies(spark, sf_dir):
    """A source that has a part of its rows twice gives the panel of the rows themselves."""
    rows = table(spark, sf_dir, "events").withColumnsRenamed({"event_type": "plant", "value": "gen"})
    return rounded(clean.hourly_sum(rows.unionAll(rows.where("event_id % 13 = 0")), ["plant"], "ts", "gen"))


@query(f"""WITH {_SRC}, k AS (SELECT *, count(*) OVER (PARTITION BY event_id) AS n FROM flags) SELECT count(*) AS rows, count(CASE WHEN n > 1 THEN 1 END) AS repeated, round(count(CASE WHEN gen IS NULL THEN 1 END) / count(*), 6) AS null_rate, round(count(CASE WHEN scope AND named AND gen >= 0 AND t = date_trunc('hour', t) THEN 1 END) / count(*), 6) AS valid_share,
(SELECT count(*) FROM (SELECT DISTINCT plant, t FROM ok)) AS plant_hours, round((SELECT count(*) FROM (SELECT DISTINCT plant, t FROM ok)) / ((SELECT count(DISTINCT plant) FROM ok) * (SELECT count(DISTINCT t) FROM ok)), 6) AS coverage FROM k""")
def dataset_profile(spark, sf_dir):
    return rounded(observed.profile(_records(spark, sf_dir), "event_id"))


@query(f"""WITH {_HOURLY} SELECT strftime(t - INTERVAL 3 HOUR, '%Y-%m-%d') AS day, round(sum(gen), 9) AS gen, round(avg(cap), 9) AS mean_capacity, count(*) AS plant_hours FROM observed GROUP BY 1""")
def daily_capacity_rollup(spark, sf_dir):
    day = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("America/Sao_Paulo"), F.col("t")), "yyyy-MM-dd")
    return rounded(_observed(spark, sf_dir).groupBy(day.alias("day")).agg(F.sum("gen").alias("gen"), F.avg("cap").alias("mean_capacity"), F.count("*").alias("plant_hours")), 9)

"""Months, requests, sinks, files of users, and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustline.functions import scalars as S
from gustline.plans.registry import PANEL, panel, query, rounded, table
from gustline.shared import fresh_path
from gustline.sources import periods, tables

_MONTHS = "m AS (SELECT CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS DATE) AS d FROM orders)"


def _months(spark, sf_dir):
    bounds = table(spark, sf_dir, "orders").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    return periods.month_range(bounds, "a", "b")


_FIXED = '{"area":[-1.5,-47.0,-18.5,-34.0],"dataset":"hourly","variable":["u","v"]'
_REQ = f"""{_MONTHS}, req AS (SELECT strftime(d, '%Y-%m') AS label, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, CAST(day(last_day(d)) AS INTEGER) AS days, CAST(day(last_day(d)) * 24 AS INTEGER) AS expected_hours FROM m),
reqs AS (SELECT *, '{_FIXED},"days":' || days || ',"month":"' || label || '"}}' AS payload FROM req)"""


def _requests(spark, sf_dir):
    return periods.plan_requests(_months(spark, sf_dir), "hourly", ["u", "v"], [-1.5, -47.0, -18.5, -34.0])


@query(f"WITH {_REQ} SELECT *, sha256(payload) AS request_hash FROM reqs")
def request_plan(spark, sf_dir):
    return _requests(spark, sf_dir)


@query(f"WITH {_REQ}, done AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS label FROM orders WHERE o_totalprice > 495000) SELECT label, sha256(payload) AS request_hash FROM reqs WHERE label NOT IN (SELECT label FROM done)")
def skip_done_requests(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    done = table(spark, sf_dir, "orders").where("o_totalprice > 495000").select(S.month_label(F.col("o_orderdate")).alias("label")).distinct().join(requests, "label")
    return periods.not_done(requests, done, ["request_hash"]).select("label", "request_hash")


@query(f"WITH {_MONTHS} SELECT strftime(d, '%Y-%m') AS month, strftime(d + INTERVAL 1 MONTH, '%Y-%m') AS after, strftime(d - INTERVAL 1 MONTH, '%Y-%m') AS before, strftime(d + INTERVAL 14 MONTH, '%Y-%m') AS later FROM m")
def month_arithmetic(spark, sf_dir):
    d = F.col("month_start")
    return _months(spark, sf_dir).select(S.month_label(d).alias("month"), periods.next_month(d).alias("after"), periods.next_month(d, -1).alias("before"), periods.next_month(d, 14).alias("later"))


@query(f"""WITH {_MONTHS} SELECT strftime(d, '%Y-%m') AS month, CASE WHEN year(d) >= 1997 THEN printf('https://data.example/generation/%d_%02d.csv', year(d), month(d)) END AS url FROM m""")
def source_urls(spark, sf_dir):
    d = F.col("month_start")
    return _months(spark, sf_dir).select(S.month_label(d).alias("month"), periods.source_url("https://data.example", "generation", F.year(d), F.month(d), 1997).alias("url"))


@query(f"WITH {_MONTHS} SELECT strftime(d, '%Y-%m') AS month, unnest([strftime(d, '%Y-%m'), strftime(d + INTERVAL 1 MONTH, '%Y-%m')]) AS utc_month FROM m")
def spill_partitions(spark, sf_dir):
    return periods.months_touched(_months(spark, sf_dir).select(S.month_label(F.col("month_start")).alias("month")), "month", 3)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) <= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 5 AND CAST(o_orderdate AS DATE) > (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 15")
def recent_days(spark, sf_dir):
    return periods.recent(table(spark, sf_dir, "orders"), "o_orderdate", 10, 5).select("o_orderkey", "o_orderdate")


@query("""WITH a AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-31 12:00:00', TIMESTAMP '2024-01-02 11:00:00', INTERVAL 1 HOUR)) AS hour) SELECT hour, hour IN (SELECT date_trunc('hour', ts) FROM events) AS present FROM a""")
def hour_present(spark, sf_dir):
    first = F.lit("2023-12-31 12:00:00").cast("timestamp_ntz")
    asked = spark.range(48).select((first + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("hour"))
    return periods.present_hours(table(spark, sf_dir, "events"), "ts", asked, "hour")


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders")
def month_partitions(spark, sf_dir):
    path = fresh_path(spark, "months")
    rows = table(spark, sf_dir, "orders").withColumns({"year": F.year("o_orderdate"), "month": F.month("o_orderdate")})
    tables.write_once(rows.repartition("year", "month"), path, ["year", "month"])
    return periods.month_partitions(spark, path)


@query("SELECT event_type, count(*) AS rows, round(sum(CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN value * 2 ELSE value END), 4) AS value FROM events GROUP BY 1")
def late_partition_replace(spark, sf_dir):
    """A partition written again with corrected values; the others stay."""
    path, rows = fresh_path(spark, "late"), table(spark, sf_dir, "events").select("event_id", "value", "event_type")
    tables.write_once(rows, path, ["event_type"])
    first = rows.agg(F.min("event_type").alias("event_type"))
    tables.replace_partitions(rows.join(first, "event_type", "left_semi").withColumn("value", F.col("value") * 2).select("event_id", "value", "event_type"), path, ["event_type"])
    return rounded(spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("rows"), F.sum("value").alias("value")), 4)


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice FROM orders")
def staged_table(spark, sf_dir):
    path = fresh_path(spark, "staged")
    periods.staged(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path)
    return rounded(tables.read_table(spark, path + "/*.parquet"))


@query("""SELECT 'data' AS part, count(*) AS rows, sum(c_custkey)::BIGINT AS keys FROM customer UNION ALL SELECT 'manifest', count(*), sum(c_custkey)::BIGINT FROM customer""")
def csv_with_manifest(spark, sf_dir):
    path, rows = f"{fresh_path(spark, 'assigned')}.csv", table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    facts = rows.agg(F.count("*").alias("rows"), F.sum("c_custkey").alias("keys"))
    periods.with_manifest(rows, path, facts, header=True)
    data = tables.read_table(spark, path).agg(F.lit("data").alias("part"), F.count("*").alias("rows"), F.sum(F.col("c_custkey").try_cast("long")).alias("keys"))
    return data.unionAll(spark.read.json(f"{path}.manifest").select(F.lit("manifest").alias("part"), "rows", "keys"))


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status FROM orders")
def delimited_round_trip(spark, sf_dir):
    """All text columns stay text, leading zeros too."""
    path = f"{fresh_path(spark, 'text')}.txt"
    table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(F.col("o_custkey").cast("string"), 12, "0").alias("customer"), F.col("o_orderstatus").alias("status")).write.csv(path, header=True, sep="|")
    rows = tables.read_table(spark, path, ["o_orderkey", "customer", "status"])
    return rows.select(F.col("o_orderkey").try_cast("long").alias("o_orderkey"), F.nullif(F.regexp_replace("customer", "^0{1,11}", ""), F.lit("")).alias("customer"), "status")


@query(f"""WITH {PANEL}, f AS (SELECT plant, count(*) AS hours, printf('%.2f', sum(gen)) AS total FROM panel GROUP BY 1), b AS (SELECT row_number() OVER (ORDER BY plant) + 3 AS position, '| ' || plant || ' | ' || hours || ' | ' || total || ' |' AS line FROM f)
SELECT CAST(0 AS BIGINT) AS position, '# Plants' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, '| plant | hours | total |' UNION ALL SELECT 3, '| --- | --- | --- |' UNION ALL SELECT position, line FROM b""")
def markdown_report(spark, sf_dir):
    facts = panel(spark, sf_dir).groupBy("plant").agg(F.count("*").alias("hours"), F.format_string("%.2f", F.round(F.sum("gen"), 6)).alias("total"))
    return periods.report_lines(facts, "Plants", ["plant", "hours", "total"])


@query(f"""WITH {PANEL} SELECT plant || ',' || strftime(hour, '%Y-%m-%dT%H:%M:%SZ') || ',' || printf('%.3f', u) || ',' || printf('%.3f', v) || ',0.9500' AS line FROM panel""")
def weather_file(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumn("availability", F.lit(0.95))
    return rows.select(periods.weather_lines(rows).alias("line"))


_FILE = """f AS (SELECT event_id + 2 AS row, CASE WHEN event_id % 31 = 0 THEN '' ELSE 'p' || event_id % 700 END AS plant, date_trunc('hour', ts) AS hour, CASE WHEN event_id % 37 = 0 THEN NULL ELSE value / 3 END AS u, CASE WHEN event_id % 41 = 0 THEN 1.5 ELSE 0.5 END AS a, event_id % 43 = 0 AS naive, event_id % 47 = 0 AS longer, CASE WHEN event_id % 53 = 0 THEN 400.0::DOUBLE WHEN event_id % 2 = 0 THEN 290.0::DOUBLE END AS temperature FROM events),
g AS (SELECT *, min(row) OVER (PARTITION BY plant, CASE WHEN NOT naive THEN hour END) AS first FROM f)"""


@query(f"""WITH {_FILE} SELECT row, plant, CASE WHEN NOT naive THEN hour + INTERVAL 3 HOUR END AS hour, round(u, 4) AS u, 2.0::DOUBLE AS v, a::DOUBLE AS availability, temperature, CASE WHEN row > 50001 THEN 'too_many_rows' WHEN longer THEN 'columns' WHEN naive THEN 'hour' WHEN plant = '' THEN 'plant' WHEN row > first THEN 'repeated' WHEN u IS NULL THEN 'u'
WHEN sqrt(u * u + 4) > 50 OR a NOT BETWEEN 0 AND 1 THEN 'range' WHEN temperature NOT BETWEEN 150 AND 350 THEN 'temperature' END AS error FROM g""")
def user_file_check(spark, sf_dir):
    k = F.col("event_id")
    hour = F.date_format(S.hour_floor(F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss")
    cells = [F.when(k % 31 == 0, "").otherwise(F.concat(F.lit("p"), (k % 700).cast("string"))), F.when(k % 43 == 0, hour).otherwise(F.concat(hour, F.lit("-03:00"))), F.when(k % 37 == 0, "?").otherwise((F.col("value") / 3).cast("string")), F.lit(" 2"), F.when(k % 41 == 0, "1.5").otherwise("0.5")]
    cells.append(F.when(k % 53 == 0, "400").when(k % 2 == 0, "290").otherwise(""))
    lines = table(spark, sf_dir, "events").select((k + 2).alias("row"), F.concat(F.concat_ws(";", *cells), F.when(k % 47 == 0, ";x").otherwise("")).alias("line"))
    return rounded(periods.check_lines(lines, "plant; hour;u;v;availability;temperature"), 4)


@query("SELECT user_id, count(*) AS rows, count(*) > 80 AS too_many FROM events GROUP BY 1")
def record_limit(spark, sf_dir):
    return periods.record_limit(table(spark, sf_dir, "events"), ["user_id"], 80)


@query("""SELECT o_orderkey, sha256('{"customer":' || o_custkey || ',"status":"' || o_orderstatus || '"}') AS json_sha256 FROM orders""")
def canonical_json_hash(spark, sf_dir):
    """Sorted keys, no spaces."""
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.to_json(F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"))), 256).alias("json_sha256"))


@query("""SELECT o_orderkey, '12.' || o_orderkey % 5 || '.' || o_custkey % 3 AS version_normal, o_orderkey % 5 = 3 AND o_custkey % 3 = 0 AS known FROM orders""")
def version_normalise(spark, sf_dir):
    text = F.concat(F.lit("12.0"), (F.col("o_orderkey") % 5).cast("string"), F.lit(".0"), (F.col("o_custkey") % 3).cast("string"))
    normal = S.version_normal(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", normal.alias("version_normal"), (normal == "12.3.0").alias("known"))

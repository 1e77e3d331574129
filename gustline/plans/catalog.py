"""Catalog reconciliation, validity, geography, buses, records, and the two queries without SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustline.functions import scalars as S
from gustline.functions import wind as W
from gustline.operators import buses, joins, metrics
from gustline.plans.registry import query, rounded, scored, table
from gustline.sources import fixedwidth

_REL = """rel AS (SELECT c_nationkey AS nation, c_custkey AS member, abs(CAST(c_acctbal AS DOUBLE)) AS cap, min(o_orderdate) AS "start", max(o_orderdate) AS "end" FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2, 3)"""


def _relations(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    rows = table(spark, sf_dir, "customer").join(orders, "c_custkey")
    return rows.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("member"), F.abs(F.col("c_acctbal").cast("double")).alias("cap"), "start", "end")


@query(f"""WITH {_REL}, t AS (SELECT DISTINCT s_nationkey AS nation, date_trunc('month', l_shipdate) AS month FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT nation, CAST(month AS TIMESTAMP) AS month, round(sum(cap), 2) AS cap, count(*) AS members FROM t JOIN rel USING (nation) WHERE "start" <= month AND month < "end" + INTERVAL 1 DAY GROUP BY 1, 2""")
def capacity_by_validity(spark, sf_dir):
    month = F.to_timestamp_ntz(F.concat(S.month_label(F.col("l_shipdate")), F.lit("-01")))
    ships = table(spark, sf_dir, "lineitem").select("l_suppkey", month.alias("month")).distinct()
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    out = joins.capacity_by_validity(ships.join(nations, "l_suppkey"), _relations(spark, sf_dir), ["nation"], "month", "member", "cap")
    return rounded(out, 2)


@query("""WITH u AS (SELECT DISTINCT user_id * 11 AS k FROM events), o AS (SELECT c_custkey AS k FROM customer)
SELECT CASE WHEN u.k IS NULL THEN 'left_only' WHEN o.k IS NULL THEN 'right_only' ELSE 'both' END AS side, count(*) AS rows FROM o FULL OUTER JOIN u ON o.k = u.k GROUP BY 1""")
def full_outer_coverage_audit(spark, sf_dir):
    """All customers against all users of events, two whole tables whose keys differ by nature."""
    users = table(spark, sf_dir, "events").select((F.col("user_id") * 11).alias("k")).distinct()
    return joins.coverage_audit(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), users, ["k"])


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), o AS (SELECT o_orderkey AS k FROM orders)
SELECT CASE WHEN l.k IS NULL THEN 'left_only' WHEN o.k IS NULL THEN 'right_only' ELSE 'both' END AS side, count(*) AS rows FROM o FULL OUTER JOIN l ON o.k = l.k GROUP BY 1""")
def whole_coverage_audit(spark, sf_dir):
    """All orders against the orders of all lines."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    return joins.coverage_audit(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), items, ["k"])


@query("""WITH reg AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'X' || s_suppkey % 20 ELSE 'S' || s_suppkey || '.1' END AS code FROM supplier),
rows AS (SELECT p_partkey AS part, CASE WHEN p_partkey % 4 = 0 THEN 'X' || p_partkey % 40 ELSE 'S' || p_partkey % 300 || CASE WHEN p_partkey % 3 = 0 THEN '.1' ELSE '.2' END END AS code FROM part),
e AS (SELECT code, count(*) AS n, min(id) AS id FROM reg GROUP BY 1), r AS (SELECT regexp_replace(code, '\\.\\d+$', '') AS root, count(*) AS n, min(id) AS id FROM reg GROUP BY 1)
SELECT part, CASE WHEN e.n = 1 THEN 'exact' WHEN e.n > 1 THEN 'unresolved' WHEN r.n = 1 THEN 'root' ELSE 'unresolved' END AS match_method,
CASE WHEN e.n = 1 THEN 'matched' WHEN e.n > 1 THEN 'review_required' WHEN r.n = 1 THEN 'matched' WHEN r.n > 1 THEN 'review_required' ELSE 'unresolved' END AS match_status,
CASE WHEN e.n = 1 THEN '' WHEN e.n > 1 THEN 'ambiguous_exact' WHEN r.n = 1 THEN '' WHEN r.n > 1 THEN 'ambiguous_root' ELSE 'not_found' END AS match_reason,
CASE WHEN e.n = 1 THEN e.id WHEN e.n > 1 THEN NULL WHEN r.n = 1 THEN r.id END AS matched
FROM rows LEFT JOIN e USING (code) LEFT JOIN r ON r.root = regexp_replace(rows.code, '\\.\\d+$', '')""")
def priority_lookup_reconcile(spark, sf_dir):
    k, p = F.col("s_suppkey"), F.col("p_partkey")
    code = F.when(k % 4 == 0, F.concat(F.lit("X"), (k % 20).cast("string"))).otherwise(F.concat(F.lit("S"), k.cast("string"), F.lit(".1")))
    registry = table(spark, sf_dir, "supplier").select(k.alias("id"), code.alias("code"))
    mine = F.when(p % 4 == 0, F.concat(F.lit("X"), (p % 40).cast("string"))).otherwise(F.concat(F.lit("S"), (p % 300).cast("string"), F.when(p % 3 == 0, ".1").otherwise(".2")))
    rows = table(spark, sf_dir, "part").select(p.alias("part"), mine.alias("code"))
    steps = [("exact", F.col("code"), F.col("code")), ("root", S.code_root(F.col("code")), S.code_root(F.col("code")))]
    return joins.priority_match(rows, registry, "id", steps).drop("code")


@query("""SELECT n_nationkey AS nation, coalesce(s_suppkey, n_nationkey) AS location, s_suppkey IS NOT NULL AS is_group FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND n_nationkey % 3 = 0""")
def group_expand_members(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.when(F.col("n_nationkey") % 3 == 0, "-").otherwise(F.col("n_name")).alias("code"))
    members = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("member"))
    return joins.expand_groups(rows, members, "nation", "member", F.col("code")).drop("code")


@query("""WITH p AS (SELECT c_custkey, -16 + (c_custkey * 37 % 1500) / 100.0::DOUBLE AS lat, 315 + (c_custkey * 53 % 1000) / 100.0::DOUBLE AS lon FROM customer), g AS (SELECT unnest(range(0, 61)) AS i),
a AS (SELECT c_custkey, lat, lon, -16 + i * 0.25::DOUBLE AS glat FROM p, g QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY abs(-16 + i * 0.25::DOUBLE - lat), i) = 1)
SELECT c_custkey, glat AS nearest_lat, round(lon + 180 - 360 * floor((lon + 180) / 360) - 180, 6) AS lon,
round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(glat - lat) / 2), 2))), 6) AS km FROM a""")
def nearest_axis_match(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, (F.lit(-16.0) + (k * 37 % 1500) / 100).alias("lat"), (F.lit(315.0) + (k * 53 % 1000) / 100).alias("lon"))
    axis = spark.range(61).select((F.lit(-16.0) + F.col("id") * 0.25).alias("point"))
    near = joins.nearest_on_axis(rows, "lat", axis, "point", 0.25)
    km = W.haversine_km(F.col("lat"), F.col("lon"), F.col("nearest_lat"), F.col("lon"))
    return rounded(near.select("c_custkey", "nearest_lat", W.longitude_180(F.col("lon")).alias("lon"), km.alias("km")))


@query("""WITH x AS (SELECT c_nationkey AS nation, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 100 AS DOUBLE) END AS x, CAST(c_acctbal AS DOUBLE) AS w FROM customer)
SELECT nation, round(sum(CASE WHEN x IS NOT NULL AND w > 0 THEN x * w END) / nullif(sum(CASE WHEN x IS NOT NULL AND w > 0 THEN w END), 0), 6) AS mean, count(*) AS members FROM x GROUP BY 1""")
def weighted_group_mean(spark, sf_dir):
    x = F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 100).cast("double"))
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"))
    return rounded(rows.agg(metrics.weighted_mean(x, F.col("c_acctbal").cast("double")).alias("mean"), F.count("*").alias("members")))


@query("""WITH x AS (SELECT s_nationkey AS nation, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey * 37 % 1500) / 100.0::DOUBLE END AS lat, (s_suppkey * 53 % 1000) / 100.0::DOUBLE AS lon, CAST(s_acctbal AS DOUBLE) AS w FROM supplier)
SELECT nation, round(sum(CASE WHEN lat IS NOT NULL AND w > 0 THEN lat * w END) / nullif(sum(CASE WHEN lat IS NOT NULL AND w > 0 THEN w END), 0), 6) AS lat, round(sum(CASE WHEN w > 0 THEN lon * w END) / nullif(sum(CASE WHEN w > 0 THEN w END), 0), 6) AS lon FROM x GROUP BY 1""")
def weighted_centroid_nulls(spark, sf_dir):
    k, w = F.col("s_suppkey"), F.col("s_acctbal").cast("double")
    lat, lon = F.when(k % 5 != 0, (k * 37 % 1500) / 100), (k * 53 % 1000) / 100
    rows = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation"))
    return rounded(rows.agg(metrics.weighted_mean(lat, w).alias("lat"), metrics.weighted_mean(lon, w).alias("lon")))


@query("""WITH p AS (SELECT s_nationkey AS nation, bool_and(s_acctbal > 0) AS located FROM supplier GROUP BY 1) SELECT count(*) AS nations, count(CASE WHEN located THEN 1 END) AS located, round(avg(CASE WHEN located THEN 1.0 ELSE 0.0 END), 6) AS share FROM p""")
def fully_located_plants(spark, sf_dir):
    each = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.bool_and(F.col("s_acctbal") > 0).alias("located"))
    return rounded(each.agg(F.count("*").alias("nations"), F.count_if("located").alias("located"), F.avg(F.col("located").cast("double")).alias("share")))


@query("""WITH x AS (SELECT c_nationkey AS nation, -16 + (c_custkey * 37 % 1500) / 100.0::DOUBLE AS lat, -45 + (c_custkey * 53 % 1000) / 100.0::DOUBLE AS lon FROM customer)
SELECT nation, ceil((max(lat) + 0.25) / 0.25) * 0.25::DOUBLE AS north, floor((min(lon) - 0.25) / 0.25) * 0.25::DOUBLE AS west, floor((min(lat) - 0.25) / 0.25) * 0.25::DOUBLE AS south, ceil((max(lon) + 0.25) / 0.25) * 0.25::DOUBLE AS east FROM x GROUP BY 1""")
def spatial_bounds_snap(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), (F.lit(-16.0) + (k * 37 % 1500) / 100).alias("lat"), (F.lit(-45.0) + (k * 53 % 1000) / 100).alias("lon"))
    return rows.groupBy("nation").agg(*metrics.snapped_bounds(F.col("lat"), F.col("lon")))


_SHARES = """shares AS (SELECT c_nationkey AS nation, c_custkey % 6 AS bus, sum(abs(CAST(c_acctbal AS DOUBLE))) AS cap FROM customer GROUP BY 1, 2), alloc AS (SELECT nation, bus, cap, cap / nullif(sum(cap) OVER (PARTITION BY nation), 0) AS share FROM shares)"""


def _shares(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 6).alias("bus"), F.abs(F.col("c_acctbal").cast("double")).alias("cap"))
    return buses.allocation_shares(rows, "nation", "bus", "cap")


@query(f"WITH {_SHARES} SELECT nation, bus, round(cap, 2) AS cap, round(share, 6) AS share FROM alloc")
def allocation_shares(spark, sf_dir):
    return rounded(_shares(spark, sf_dir).withColumn("cap", F.round("cap", 2)))


@query(f"""WITH {_SHARES}, v AS (SELECT s_nationkey AS nation, sum(CAST(s_acctbal AS DOUBLE)) AS mw FROM supplier GROUP BY 1)
SELECT bus, round(sum(mw * share), 4) AS mw, count(DISTINCT nation) AS plants FROM v JOIN alloc USING (nation) GROUP BY 1""")
def bus_accumulation(spark, sf_dir):
    values = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.sum(F.col("s_acctbal").cast("double")).alias("mw"))
    return rounded(buses.accumulate(values, _shares(spark, sf_dir), "nation", "bus", "mw"), 4)


@query("""SELECT o_orderkey, sha256('=' || o_orderkey || '|=' || o_custkey || '|' || CASE WHEN o_orderkey % 9 = 0 THEN '~' ELSE '=' || o_orderstatus END) AS fingerprint FROM orders""")
def row_fingerprint_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderstatus"))
    return rows.select("o_orderkey", S.fingerprint(F.col("o_orderkey"), F.col("o_custkey"), status).alias("fingerprint"))


@query("""SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 12, ' ') || lpad(printf('%.2f', o_custkey / 4.0::DOUBLE), 10, ' ') AS record, o_orderkey AS parsed_key, round(o_custkey / 4.0::DOUBLE, 6) AS parsed_value,
CAST(o_custkey % 10 || '.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS DOUBLE) AS implied FROM orders""")
def fixed_width_codec(spark, sf_dir):
    key, value = F.col("o_orderkey"), F.col("o_custkey") / 4
    text = F.concat(F.lpad(key.cast("string"), 12, " "), S.fixed_number(value, 10, (2,)))
    digits = F.concat((F.col("o_custkey") % 10).cast("string"), F.lpad((key % 1000).cast("string"), 3, "0"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("record"), S.implied_decimal(digits, 1).alias("implied"))
    record = F.col("record")
    return rounded(rows.select("o_orderkey", "record", fixedwidth.field(record, 0, 12).try_cast("long").alias("parsed_key"), fixedwidth.field(record, 12, 10).try_cast("double").alias("parsed_value"), "implied"))


@query()
def mllib_residual_model(spark, sf_dir):
    """A boosted model of what the power curve misses, trained on the first 70 percent of hours; bounded predictions for the rest."""
    from gustline.operators.ml import residual_model

    return residual_model(scored(spark, sf_dir))


@query()
def model_approval(spark, sf_dir):
    """Whether the boosted correction of mllib_residual_model beats the power curve on the last 15 percent of hours."""
    from gustline.operators.ml import approval, residual_model

    return approval(residual_model(scored(spark, sf_dir)))


@query()
def refit_approval(spark, sf_dir):
    """The better of two boosted corrections over folds, fitted again on the first 85 percent of hours, and whether it beats the power curve on the rest."""
    from gustline.operators.ml import refit_approval as run

    return run(scored(spark, sf_dir), {"flat": {"depth": 2}, "deep": {"depth": 4}})


@query()
def streaming_hourly_panel(spark, sf_dir):
    """Events as a stream of files into hourly sums (an extension)."""
    from gustline.streaming.hourly import events_by_hour

    return events_by_hour(spark, sf_dir)

"""Registers, memberships, mappings and shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustline.functions import wind as W
from gustline.operators import buses, joins, metrics
from gustline.plans.registry import query, rounded, table
from gustline.shared import fresh_path
from gustline.sources import registers, sheets, tables


def _comma(x, digits=2):
    return F.translate(F.format_string(f"%,.{digits}f", x.cast("double")), ",.", ".,")


_REGISTER = """register AS (SELECT s_suppkey AS id, ' eol.cv.' || s_nationkey || '.0' || (s_suppkey % 40) || CASE WHEN s_suppkey % 2 = 0 THEN '.1' ELSE '.2' END AS raw, s_name AS name, CAST(s_nationkey AS VARCHAR) AS state, -10 - (s_suppkey % 700) / 100.0::DOUBLE AS lat, -40 + (s_suppkey % 300) / 50.0::DOUBLE AS lon,
CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE abs(s_acctbal) END AS inspected, abs(s_acctbal) * 2 AS granted FROM supplier), reg AS (SELECT id, trim(raw) AS code, upper(trim(raw)) AS code_normal, regexp_replace(upper(trim(raw)), '\\.\\d+$', '') AS code_root, name, state, lat, lon, CASE WHEN inspected > 0 THEN inspected ELSE granted END / 1000 AS capacity_mw FROM register)"""


def _register(spark, sf_dir):
    k = F.col("s_suppkey")
    code = F.concat(F.lit(" eol.cv."), F.col("s_nationkey").cast("string"), F.lit(".0"), (k % 40).cast("string"), F.when(k % 2 == 0, ".1").otherwise(".2"))
    rows = table(spark, sf_dir, "supplier").select(
        k.alias("id"), code.alias("code"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("state"), _comma(F.lit(-10.0) - k % 700 / 100).alias("lat"), _comma(F.lit(-40.0) + k % 300 / 50).alias("lon"),
        F.when(k % 3 == 0, "0").otherwise(_comma(F.abs("s_acctbal"))).alias("inspected_kw"), _comma(F.abs("s_acctbal") * 2).alias("granted_kw"),
    )
    return rows


@query(f"WITH {_REGISTER} SELECT code, code_normal, code_root, name, state, round(lat, 6) AS lat, round(lon, 6) AS lon, round(capacity_mw, 6) AS capacity_mw FROM reg")
def register_read(spark, sf_dir):
    """Written as delimited text with decimal commas, and read back."""
    path = f"{fresh_path(spark, 'register')}.csv"
    _register(spark, sf_dir).drop("id").write.csv(path, header=True, sep=";")
    return rounded(registers.read_register(tables.read_table(spark, path)))


@query("""SELECT DISTINCT 'U' || o_custkey % 400 AS id, 'plant ' || o_custkey % 400 AS name, 'x.' || o_custkey % 400 || '.3' AS code, 'X.' || o_custkey % 400 || '.3' AS code_normal, 'X.' || o_custkey % 400 AS code_root, 'BA' AS state, CAST(1 AS BIGINT) AS codes FROM orders WHERE o_orderpriority LIKE '%U%' AND o_orderstatus <> 'P'""")
def universe_read(spark, sf_dir):
    k = (F.col("o_custkey") % 400).cast("string")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit(" U"), k).alias("ID Único"), F.concat(F.lit("plant "), k).alias("NOME"), F.concat(F.lit("x."), k, F.lit(".3 ")).alias("cod_code"), F.when(F.col("o_orderstatus") == "P", "S").otherwise(" ne ").alias("Subsistema"), F.lit("BA").alias("estado"), F.col("o_orderpriority").alias("tipo"))
    aliases = {"id": ["id", "id unico"], "name": ["nome", "name"], "code": ["code", "cod_code"], "area": ["area", "subsistema"], "state": ["uf", "estado"], "kind": ["kind", "TIPO"]}
    return registers.require_one_code(registers.read_universe(rows, aliases, "NE", "u"))


@query("""SELECT 'G' || c_nationkey AS "group", 'M' || c_custkey AS member, 'c' || c_custkey AS code, TIMESTAMP '2020-01-01' + to_days(CAST(c_custkey % 900 AS INTEGER)) AS "start", CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '2022-01-01' + to_days(CAST(c_custkey % 900 AS INTEGER)) END AS "end" FROM customer WHERE c_custkey % 5 <> 0""")
def membership_read(spark, sf_dir):
    k = F.col("c_custkey")
    day = lambda start: F.date_format(F.lit(start).cast("timestamp_ntz") + F.make_dt_interval((k % 900).cast("int")), "yyyy-MM-dd")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit(" G"), F.col("c_nationkey").cast("string")).alias("group"), F.concat(F.lit("M"), k.cast("string"), F.lit(" ")).alias("member"), F.concat(F.lit("c"), k.cast("string")).alias("code"), F.when(k % 5 == 0, "S").otherwise("Ne").alias("area"), day("2020-01-01").alias("start"), F.when(k % 3 == 0, "never").otherwise(day("2022-01-01")).alias("end"))
    return registers.read_membership(rows, "NE")


_RECON = f"""{_REGISTER}, rows AS (SELECT p_partkey AS part, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'EOL.CV.' || p_partkey % 25 || '.0' || p_partkey % 40 || '.1' END AS code_normal, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'EOL.CV.' || p_partkey % 25 || '.0' || p_partkey % 40 END AS code_root FROM part),
ov AS (SELECT p_partkey AS part, upper(trim(raw)) AS override FROM part JOIN register ON id = p_partkey % 97 WHERE p_partkey % 7 = 0),
e AS (SELECT code_normal, count(*) AS n, min(id) AS id FROM reg GROUP BY 1), r AS (SELECT code_root, count(*) AS n, min(id) AS id FROM reg GROUP BY 1), m AS (SELECT rows.part, o.n AS ovn, o.id AS ovid, e.n AS en, e.id AS eid, r.n AS rn, r.id AS rid FROM rows LEFT JOIN ov USING (part) LEFT JOIN e o ON o.code_normal = ov.override LEFT JOIN e ON e.code_normal = rows.code_normal LEFT JOIN r ON r.code_root = rows.code_root),
recon AS (SELECT part, CASE WHEN ovn = 1 THEN 'override' WHEN ovn > 1 THEN 'unresolved' WHEN en = 1 THEN 'exact' WHEN en > 1 THEN 'unresolved' WHEN rn = 1 THEN 'root' ELSE 'unresolved' END AS match_method,
CASE WHEN ovn = 1 THEN 'matched' WHEN ovn > 1 THEN 'review_required' WHEN en = 1 THEN 'matched' WHEN en > 1 THEN 'review_required' WHEN rn = 1 THEN 'matched' WHEN rn > 1 THEN 'review_required' ELSE 'unresolved' END AS match_status,
CASE WHEN ovn = 1 THEN '' WHEN ovn > 1 THEN 'ambiguous_override' WHEN en = 1 THEN '' WHEN en > 1 THEN 'ambiguous_exact' WHEN rn = 1 THEN '' WHEN rn > 1 THEN 'ambiguous_root' ELSE 'not_found' END AS match_reason,
CASE WHEN ovn = 1 THEN ovid WHEN ovn > 1 THEN NULL WHEN en = 1 THEN eid WHEN en > 1 THEN NULL WHEN rn = 1 THEN rid END AS matched FROM m)"""


def _recon(spark, sf_dir):
    k = F.col("p_partkey")
    raw = _register(spark, sf_dir)
    reg = raw.select("id", F.upper(F.trim("code")).alias("code_normal")).withColumn("code_root", F.regexp_replace("code_normal", r"\.\d+$", ""))
    root = F.concat(F.lit("EOL.CV."), (k % 25).cast("string"), F.lit(".0"), (k % 40).cast("string"))
    rows = table(spark, sf_dir, "part").select(k.alias("part"), F.when(k % 5 == 0, "").otherwise(F.concat(root, F.lit(".1"))).alias("code_normal"), F.when(k % 5 == 0, "").otherwise(root).alias("code_root"))
    overrides = table(spark, sf_dir, "part").where("p_partkey % 7 = 0").select(k.alias("part"), (k % 97).alias("id")).join(raw.select("id", F.col("code").alias("override")), "id")
    return registers.reconcile(rows, reg, overrides, "id", "part").select("part", "match_method", "match_status", "match_reason", "matched")


@query(f"WITH {_RECON} SELECT * FROM recon")
def override_reconcile(spark, sf_dir):
    return _recon(spark, sf_dir)


@query(f"""WITH {_RECON} SELECT 'match_method' AS "column", match_method AS value, count(*) AS rows FROM recon GROUP BY 2 UNION ALL SELECT 'match_status', match_status, count(*) FROM recon GROUP BY 2 UNION ALL SELECT 'match_reason', match_reason, count(*) FROM recon GROUP BY 2""")
def match_frequencies(spark, sf_dir):
    return registers.frequencies(_recon(spark, sf_dir), ["match_method", "match_status", "match_reason"])


@query("""WITH m AS (SELECT c_nationkey AS plant, c_custkey AS place, 'R' || c_custkey % 50 AS code_root, abs(c_acctbal) AS capacity FROM customer), x AS (SELECT 'R' || s_suppkey % 45 AS code_root, s_suppkey % 30 AS bus, CASE WHEN s_suppkey % 4 <> 0 THEN 'S' || s_suppkey % 3 END AS state, abs(s_acctbal) AS share_mw FROM supplier),
j AS (SELECT m.*, x.bus, x.state, x.share_mw FROM m LEFT JOIN x USING (code_root)), st AS (SELECT plant, count(*) AS places, count(CASE WHEN ok THEN 1 END) AS mapped FROM (SELECT plant, place, bool_or(bus IS NOT NULL) AS ok FROM j GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT plant, place, bus, state, round(sum(share_mw), 4) AS share_mw, round(min(capacity), 4) AS capacity, min(code_root) AS code_root FROM j WHERE bus IS NOT NULL GROUP BY 1, 2, 3, 4) SELECT * FROM g JOIN st USING (plant)""")
def bus_mapping(spark, sf_dir):
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("plant"), F.col("c_custkey").alias("place"), F.concat(F.lit("R"), (F.col("c_custkey") % 50).cast("string")).alias("code_root"), F.abs("c_acctbal").alias("capacity"))
    k = F.col("s_suppkey")
    sheet = table(spark, sf_dir, "supplier").select(F.concat(F.lit("R"), (k % 45).cast("string")).alias("code_root"), (k % 30).alias("bus"), F.when(k % 4 != 0, F.concat(F.lit("S"), (k % 3).cast("string"))).alias("state"), F.abs("s_acctbal").alias("share_mw"))
    return rounded(registers.bus_mapping(members, sheet), 4)


_SHEET = {"bus": ["numero da barra", "bus"], "code": ["CEG"], "kind": ["tipo da usina"], "state": ["Estado"], "share_mw": ["potencia (MW)"]}


@query("""WITH m AS (SELECT c_nationkey AS plant, c_custkey AS place, 'EOL.CV.R.0' || c_custkey % 50 AS code_root, abs(c_acctbal) AS capacity FROM customer),
x AS (SELECT 'EOL.CV.R.0' || p_partkey % 30 AS code_root, p_partkey % 40 AS bus, CASE WHEN p_partkey % 4 <> 0 THEN 'S' || p_partkey % 3 END AS state, p_retailprice AS share_mw FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 40 > 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0),
j AS (SELECT m.*, x.bus, x.state, x.share_mw FROM m LEFT JOIN x USING (code_root)), st AS (SELECT plant, count(*) AS places, count(CASE WHEN ok THEN 1 END) AS mapped FROM (SELECT plant, place, bool_or(bus IS NOT NULL) AS ok FROM j GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT plant, place, bus, state, round(sum(share_mw), 4) AS share_mw, round(min(capacity), 4) AS capacity, min(code_root) AS code_root FROM j WHERE bus IS NOT NULL GROUP BY 1, 2, 3, 4) SELECT * FROM g JOIN st USING (plant)""")
def sheet_bus_mapping(spark, sf_dir):
    """Parts written as workbooks of a thousand rows, read back by their headers, and mapped onto the buses of each nation's places."""
    k = F.col("p_partkey")
    share = F.when(k % 11 == 0, F.lit("n/d")).when(k % 13 == 0, F.lit("-1")).otherwise(F.col("p_retailprice").cast("string"))
    rows = table(spark, sf_dir, "part").select(
        F.floor(k / 1000).alias("book"), k.alias("_order"), (k % 40).alias("bus"), F.when(k % 5 == 0, "UFV").otherwise(" eol ").alias("kind"), F.concat(F.lit("eol.cv.r.0"), (k % 30).cast("string"), F.lit(".1")).alias("code"),
        F.when(k % 4 != 0, F.concat(F.lit("S"), (k % 3).cast("string"))).alias("state"), share.alias("share_mw"),
    )
    folder = fresh_path(spark, "books")
    headers = {"state": "Estado", "bus": " Número da Barra", "code": "CEG", "kind": "Tipo da Usina ", "share_mw": "Potência (MW)"}
    sheets.write_sheets(rows, folder, "book", headers, ["_order"], "Usinas").count()
    sheet = registers.read_bus_sheet(sheets.read_sheets(spark, folder, _SHEET, "Usinas"), "eol")
    c = F.col("c_custkey")
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("plant"), c.alias("place"), F.concat(F.lit("EOL.CV.R.0"), (c % 50).cast("string")).alias("code_root"), F.abs("c_acctbal").alias("capacity"))
    return rounded(registers.bus_mapping(members, sheet), 4)


@query("""WITH m AS (SELECT c_nationkey AS plant, abs(c_acctbal) AS cap, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 8 END AS bus FROM customer) SELECT plant, round(100 * sum(CASE WHEN bus IS NOT NULL THEN cap ELSE 0 END) / nullif(sum(cap), 0), 6) AS coverage, count(DISTINCT bus) AS buses FROM m GROUP BY 1""")
def mapping_coverage(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("plant"), F.abs("c_acctbal").alias("cap"), F.when(k % 6 != 0, k % 8).alias("bus"))
    return rounded(buses.mapping_coverage(rows, "plant", "bus", "cap"))


@query("""WITH x AS (SELECT c_custkey % 20 AS bus, abs(c_acctbal) AS mw, CASE WHEN c_custkey % 20 < 12 THEN 'A' ELSE c_mktsegment END AS state FROM customer) SELECT bus, round(sum(mw), 4) AS mw, count(DISTINCT state) = 1 AS consistent, CASE WHEN count(DISTINCT state) = 1 THEN min(state) END AS state FROM x GROUP BY 1""")
def bus_state_consistency(spark, sf_dir):
    k = F.col("c_custkey") % 20
    rows = table(spark, sf_dir, "customer").select(k.alias("bus"), F.abs("c_acctbal").alias("mw"), F.when(k < 12, "A").otherwise(F.col("c_mktsegment")).alias("state"))
    return rounded(buses.bus_states(rows, "bus", "mw", "state"), 4)


@query("""WITH s AS (SELECT c_nationkey AS plant, CASE WHEN c_nationkey % 4 = 0 THEN 1.1 ELSE 1.0 END * abs(c_acctbal) / sum(abs(c_acctbal)) OVER (PARTITION BY c_nationkey) AS share FROM customer) SELECT plant, round(sum(share), 6) AS total FROM s GROUP BY 1 HAVING abs(sum(share) - 1) > 1e-6""")
def share_faults(spark, sf_dir):
    shares = buses.allocation_shares(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("plant"), F.col("c_custkey").alias("bus"), F.abs("c_acctbal").alias("cap")), "plant", "bus", "cap")
    shares = shares.withColumn("share", F.when(F.col("plant") % 4 == 0, 1.1).otherwise(1.0) * F.col("share"))
    return rounded(buses.check_shares(shares, "plant"))


@query("""WITH d AS (SELECT c_custkey % 300 AS bus, sum(abs(c_acctbal)) AS mw FROM customer WHERE c_custkey % 300 <> 7 GROUP BY 1), s AS (SELECT bus, CASE WHEN bus % 5 = 0 THEN mw + 1 ELSE mw END AS submitted FROM d WHERE bus % 4 <> 0 UNION ALL SELECT 1000 + bus, 5.0 FROM d WHERE bus % 50 = 1)
SELECT bus, round(CASE WHEN bus % 9 = 1 AND bus < 1000 THEN 2 * submitted ELSE submitted END, 4) AS submitted, round(mw, 4) AS mw, CASE WHEN submitted IS NULL THEN 'missing' WHEN mw IS NULL THEN 'unknown' WHEN bus % 9 = 1 THEN 'repeated' WHEN bus % 5 = 0 THEN 'differs' END AS fault FROM d FULL JOIN s USING (bus)""")
def recomputed_buses(spark, sf_dir):
    """Nations' balances dealt to buses by shares, against a submission that lacks some buses, invents some, repeats some and changes some."""
    own = table(spark, sf_dir, "customer").where("c_custkey % 300 <> 7").select(F.col("c_nationkey").alias("plant"), (F.col("c_custkey") % 300).alias("bus"), F.abs("c_acctbal").alias("mw"))
    values, shares = own.groupBy("plant").agg(F.sum("mw").alias("mw")), buses.allocation_shares(own, "plant", "bus", "mw").drop("mw")
    bus, dealt = F.col("bus"), own.groupBy("bus").agg(F.sum("mw").alias("mw"))
    sent = dealt.where(bus % 4 != 0).withColumn("mw", F.when(bus % 5 == 0, F.col("mw") + 1).otherwise(F.col("mw")))
    sent = sent.unionByName(sent.where(bus % 9 == 1)).unionByName(dealt.where(bus % 50 == 1).select((bus + 1000).alias("bus"), F.lit(5.0).alias("mw")))
    # absolute, as the reference holds MW against each other: a MW too much is a fault at any size; the relative part is what sums in another order differ by
    return rounded(buses.recomputed(sent, values, shares, "plant", "bus", "mw", 1e-5, 1e-12), 4)


@query("""WITH p AS (SELECT c_custkey, -16 + (c_custkey * 37 % 1500) / 100.0::DOUBLE AS lat, -45 + (c_custkey * 53 % 1000) / 100.0::DOUBLE AS lon FROM customer), g AS (SELECT unnest(range(0, 61)) AS i), h AS (SELECT unnest(range(0, 1440)) AS j),
a AS (SELECT c_custkey, lat, lon, i FROM p, g QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY abs(-16 + i * 0.25::DOUBLE - lat), i) = 1), b AS (SELECT c_custkey, j FROM p, h QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY abs(j * 0.25::DOUBLE - (lon + 360)), j) = 1),
n AS (SELECT c_custkey, lat, lon, -16 + i * 0.25::DOUBLE AS near_lat, CASE WHEN j * 0.25::DOUBLE >= 180 THEN j * 0.25::DOUBLE - 360 ELSE j * 0.25::DOUBLE END AS near_lon FROM a JOIN b USING (c_custkey))
SELECT c_custkey, near_lat, near_lon, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians(near_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(near_lat)) * pow(sin(radians(near_lon - lon) / 2), 2))), 6) AS km FROM n""")
def nearest_grid_point(spark, sf_dir):
    """Both axes; the grid counts longitudes from 0 to 360, the plants from -180 to 180."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, (F.lit(-16.0) + k * 37 % 1500 / 100).alias("lat"), (F.lit(-45.0) + k * 53 % 1000 / 100).alias("lon")).withColumn("x", W.longitude_360(F.col("lon")))
    lats = spark.range(61).select((F.lit(-16.0) + F.col("id") * 0.25).alias("point"))
    lons = spark.range(1440).select((F.col("id") * 0.25).alias("point"))
    near = joins.nearest_on_axis(joins.nearest_on_axis(rows, "lat", lats, "point", 0.25), "x", lons, "point", 0.25)
    lon = W.longitude_180(F.col("nearest_x"))
    return rounded(near.select("c_custkey", F.col("nearest_lat").alias("near_lat"), lon.alias("near_lon"), W.haversine_km(F.col("lat"), F.col("lon"), F.col("nearest_lat"), lon).alias("km")))


@query("""WITH m AS (SELECT event_type AS plant, date_trunc('hour', ts) AS hour, event_id, user_id + 1 AS w, value, CASE WHEN event_id % 6 <> 0 THEN 290 + value / 10 END AS temperature FROM events)
SELECT plant, hour, round(sum(value * w) / sum(w), 8) AS value, round(sum(CASE WHEN temperature IS NOT NULL THEN temperature * w END) / sum(CASE WHEN temperature IS NOT NULL THEN w END), 8) AS temperature, min_by(event_id, event_id) AS first_member, max(w) AS most, count(DISTINCT w) AS members FROM m GROUP BY 1, 2""")
def hourly_weather_by_capacity(spark, sf_dir):
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("plant"), F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour"), k, (F.col("user_id") + 1).alias("w"), "value", F.when(k % 6 != 0, F.col("value") / 10 + 290).alias("temperature"))
    return rounded(metrics.weighted_hours(rows, ["plant", "hour"], ["value", "temperature"], "w", "event_id"), 8)


@query("""WITH x AS (SELECT s_nationkey AS nation, s_suppkey AS k, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS name, (s_suppkey * 37 % 1500) / 100.0::DOUBLE AS lat, CAST(s_acctbal AS DOUBLE) AS w FROM supplier)
SELECT nation, round(sum(CASE WHEN w > 0 THEN lat * w END) / nullif(sum(CASE WHEN w > 0 THEN w END), 0), 6) AS lat, arg_min(name, CASE WHEN name IS NOT NULL THEN k END) AS name FROM x GROUP BY 1""")
def centroid_attributes(spark, sf_dir):
    k, name = F.col("s_suppkey"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name"))
    rows = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation"))
    return rounded(rows.agg(metrics.weighted_mean(k * 37 % 1500 / 100, F.col("s_acctbal")).alias("lat"), metrics.first_known(name, k).alias("name")))


@query("""SELECT c_nationkey AS nation, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY a NULLS FIRST, c_custkey) AS INTEGER) AS position FROM (SELECT *, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS a FROM customer)""")
def nulls_first_order(spark, sf_dir):
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "customer").withColumn("a", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")))
    order = Window.partitionBy("c_nationkey").orderBy(F.asc_nulls_first("a"), "c_custkey")
    return rows.select(F.col("c_nationkey").alias("nation"), "c_custkey", F.row_number().over(order).alias("position"))


@query("""SELECT o_custkey, max_by(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS newest FROM orders GROUP BY 1""")
def newest_resource(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))

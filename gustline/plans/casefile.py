"""Case files made of suppliers (a file for each nation), read, patched and written."""

from __future__ import annotations

from pyspark.sql import functions as F

from gustline.functions import scalars as S
from gustline.plans.registry import query, rounded, table
from gustline.sources import case, fixedwidth

_BUS = """lpad(CAST(k AS VARCHAR), 5, ' ') || CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'M' ELSE ' ' END || CASE WHEN k % 4 = 0 THEN 'D' ELSE 'L' END || (k % 4) || CASE k % 3 WHEN 0 THEN 'A ' WHEN 1 THEN 'B ' ELSE '  ' END || rpad('BUS ' || k, 12, ' ') || '  '
 || CASE k % 3 WHEN 0 THEN '1000' WHEN 1 THEN '.985' ELSE '    ' END || lpad(CAST(k % 90 AS VARCHAR), 4, ' ') || lpad(printf('%.1f', (k * 7 % 1000) / 10.0::DOUBLE), 5, ' ')"""
#: Suppliers of all nations in a row that share one file for each nation, so that a file has about a thousand of them and bus numbers don't repeat in it, however large the table.
FILE_SUPPLIERS = 25_000
_FILES = f"heads AS (SELECT n_nationkey FROM nation UNION SELECT CAST(s_nationkey + 25 * (s_suppkey // {FILE_SUPPLIERS}) AS INTEGER) FROM supplier)"
_LINES = f"""{_FILES}, s AS (SELECT CAST(s_nationkey + 25 * (s_suppkey // {FILE_SUPPLIERS}) AS INTEGER) AS nation, s_suppkey % {FILE_SUPPLIERS} AS k FROM supplier), lines AS (
SELECT n_nationkey AS nation, CAST(0 AS BIGINT) AS ord, '(Versao do Anarede: 12.03.0' || (n_nationkey % 4) AS text FROM heads UNION ALL SELECT n_nationkey, 1, 'TITU' FROM heads UNION ALL SELECT n_nationkey, 2, '( a note' FROM heads
UNION ALL SELECT n_nationkey, 3, 'Study ANO ' || (2000 + n_nationkey % 25) || ' base' FROM heads UNION ALL SELECT n_nationkey, 4, 'DGBT' FROM heads UNION ALL SELECT n_nationkey, 5, '(G ( kV)' FROM heads UNION ALL SELECT n_nationkey, 6, 'A   69.0' FROM heads
UNION ALL SELECT n_nationkey, 7, 'B  138.0' FROM heads UNION ALL SELECT n_nationkey, 8, '99999' FROM heads UNION ALL SELECT n_nationkey, 9, 'DBAR' FROM heads UNION ALL SELECT n_nationkey, 10, '{case.BUS_HEAD}' FROM heads
UNION ALL SELECT nation, 1000000 + k, {_BUS} FROM s UNION ALL SELECT n_nationkey, 2000000, '99999' FROM heads UNION ALL SELECT n_nationkey, 2000001, 'DGER' FROM heads
UNION ALL SELECT nation, 3000000 + k, lpad(CAST(k AS VARCHAR), 5, ' ') || '   ' || lpad('1.5', 6, ' ') || ' ' || lpad(printf('%.1f', 20.0::DOUBLE + k % 50), 6, ' ') FROM s WHERE k % 2 = 1 UNION ALL SELECT n_nationkey, 4000000, '99999' FROM heads UNION ALL SELECT n_nationkey, 4000001, 'DGEI' FROM heads
UNION ALL SELECT nation, 5000000 + 2 * k + g, rpad(lpad(CAST(k AS VARCHAR), 5, ' ') || ' A' || CASE WHEN g = 1 THEN 'S' ELSE 'N' END || ' ' || lpad(CAST(g + 1 AS VARCHAR), 2, ' ') || ' ' || CASE WHEN k % 4 = 0 THEN 'D' ELSE 'L' END || lpad(CAST(k % 9 AS VARCHAR), 3, ' ') || '  1  1' || lpad(printf('%.1f', g + 0.5::DOUBLE), 5, ' '), 69, ' ')
 || CASE WHEN g = 1 THEN '99999' ELSE '12345' END || '  40.5' FROM s, range(0, 2) t(g) WHERE k % 3 = 0 UNION ALL SELECT n_nationkey, 6000000, '99999' FROM heads UNION ALL SELECT n_nationkey, 6000001, 'FIM' FROM heads)"""


def _suppliers(spark, sf_dir):
    """(nation, k): the number of each supplier's file (the nation's, plus 25 for each run of suppliers before), and its number there."""
    run = F.floor(F.col("s_suppkey") / FILE_SUPPLIERS)
    return table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + run * 25).cast("int").alias("nation"), (F.col("s_suppkey") % FILE_SUPPLIERS).alias("k"))


def _files(spark, sf_dir):
    """(nation, body): the text of each file, of about a thousand suppliers of a nation."""
    rows = _suppliers(spark, sf_dir)
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation")).union(rows.select("nation")).distinct()
    k = F.col("k")
    text = lambda c, n: F.lpad(c.cast("string"), n, " ")
    one = lambda x, n: F.lpad(F.format_string("%.1f", x.cast("double")), n, " ")
    pick = lambda *options: F.when(k % 3 == 0, options[0]).when(k % 3 == 1, options[1]).otherwise(options[2])
    n = F.col("nation")
    fixed = [(0, F.concat(F.lit("(Versao do Anarede: 12.03.0"), (n % 4).cast("string"))), (1, F.lit("TITU")), (2, F.lit("( a note")), (3, F.concat(F.lit("Study ANO "), (n % 25 + 2000).cast("string"), F.lit(" base"))), (4, F.lit("DGBT")), (5, F.lit("(G ( kV)")), (6, F.lit("A   69.0")), (7, F.lit("B  138.0"))]
    fixed += [(8, F.lit("99999")), (9, F.lit("DBAR")), (10, F.lit(case.BUS_HEAD)), (2000000, F.lit("99999")), (2000001, F.lit("DGER")), (4000000, F.lit("99999")), (4000001, F.lit("DGEI")), (6000000, F.lit("99999")), (6000001, F.lit("FIM"))]
    head = nations.select("nation", F.explode(F.array(*(F.struct(F.lit(o).cast("long").alias("ord"), t.alias("text")) for o, t in fixed))).alias("x")).select("nation", "x.*")
    state = F.when(k % 4 == 0, "D").otherwise("L")
    bus = F.concat(text(k, 5), pick("A", "M", " "), state, (k % 4).cast("string"), pick("A ", "B ", "  "), F.rpad(F.concat(F.lit("BUS "), k.cast("string")), 12, " "), F.lit("  "), pick("1000", ".985", "    "), text(k % 90, 4), one(k * 7 % 1000 / 10, 5))
    limit = F.concat(text(k, 5), F.lit("   "), F.lpad(F.lit("1.5"), 6, " "), F.lit(" "), one(k % 50 + 20, 6))
    g = F.col("g")
    group = F.concat(text(k, 5), F.lit(" A"), F.when(g == 1, "S").otherwise("N"), F.lit(" "), text(g + 1, 2), F.lit(" "), state, text(k % 9, 3), F.lit("  1  1"), one(g + 0.5, 5))
    group = F.concat(F.rpad(group, 69, " "), F.when(g == 1, "99999").otherwise("12345"), F.lit("  40.5"))
    body = rows.select("nation", (k + 1000000).alias("ord"), bus.alias("text")).unionAll(rows.where("k % 2 = 1").select("nation", (k + 3000000).alias("ord"), limit.alias("text")))
    body = body.unionAll(rows.where("k % 3 = 0").withColumn("g", F.explode(F.array(F.lit(0), F.lit(1)))).select("nation", (k * 2 + g + 5000000).alias("ord"), group.alias("text")))
    whole = head.unionAll(body).groupBy("nation").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("all"))
    return whole.select("nation", F.concat(F.array_join(F.transform("all", lambda x: x["text"]), "\r\n"), F.lit("\r\n")).alias("body"))


def _lines(spark, sf_dir):
    return fixedwidth.split_lines(_files(spark, sf_dir), "nation", "body")


@query(f"""WITH {_LINES} SELECT nation, CAST(row_number() OVER w - 1 AS INTEGER) AS line, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY nation ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", text, 'CRLF' AS ending FROM lines WINDOW w AS (PARTITION BY nation ORDER BY ord)""")
def case_lines(spark, sf_dir):
    return _lines(spark, sf_dir)


@query(f"""WITH {_LINES}, n AS (SELECT nation, count(*) AS lines, sum(length(text) + 2) - max_by(length(text) + 2, ord) AS last_offset FROM lines GROUP BY 1) SELECT nation, CAST(lines AS INTEGER) AS lines, CAST(last_offset AS BIGINT) AS last_offset, 'CRLF' AS ending FROM n""")
def case_line_endings(spark, sf_dir):
    return case.line_endings(_lines(spark, sf_dir), "nation")


@query(f"""WITH {_FILES} SELECT n_nationkey AS nation, '12.03.0' || (n_nationkey % 4) AS version, n_nationkey % 4 = 0 AS compatible, 'Study ANO ' || (2000 + n_nationkey % 25) || ' base' AS title, 2000 + n_nationkey % 25 AS year, true AS complete FROM heads""")
def case_header(spark, sf_dir):
    return case.headers(_lines(spark, sf_dir), "nation")


@query(f"""WITH {_LINES}, p AS (SELECT nation, ord, row_number() OVER (PARTITION BY nation ORDER BY ord) - 1 AS line FROM lines), b AS (SELECT nation, line, CASE WHEN ord = 3 THEN 'TITU' WHEN ord BETWEEN 6 AND 7 THEN 'DGBT' WHEN ord BETWEEN 1000000 AND 1999999 THEN 'DBAR' WHEN ord BETWEEN 3000000 AND 3999999 THEN 'DGER' WHEN ord BETWEEN 5000000 AND 5999999 THEN 'DGEI' END AS block FROM p)
SELECT nation, block, count(*) AS records, CAST(min(line) AS INTEGER) AS first, CAST(max(line) AS INTEGER) AS last FROM b WHERE block IS NOT NULL GROUP BY 1, 2""")
def case_blocks(spark, sf_dir):
    return case.running_block(_lines(spark, sf_dir), "nation")


_FIELDS = """CAST(k AS INTEGER) AS bus, CASE k % 3 WHEN 1 THEN 'M' ELSE 'A' END AS operation, CASE WHEN k % 4 = 0 THEN 'D' ELSE 'L' END AS state, CAST(k % 4 AS INTEGER) AS type, CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS base_group, 'BUS ' || k AS bus_name,
CASE k % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.985::DOUBLE END AS voltage, 1.0::DOUBLE * (k % 90) AS angle, (k * 7 % 1000) / 10.0::DOUBLE AS pg, CASE k % 3 WHEN 0 THEN 69.0::DOUBLE WHEN 1 THEN 138.0::DOUBLE END AS kv, CASE WHEN k % 2 = 1 THEN 1.5::DOUBLE END AS least, CASE WHEN k % 2 = 1 THEN 20.0::DOUBLE + k % 50 END AS most"""


@query(f"WITH {_LINES} SELECT nation, {_FIELDS} FROM s")
def case_buses(spark, sf_dir):
    return rounded(case.buses(_lines(spark, sf_dir), "nation").drop("line", "pg_offset"))


@query(f"""WITH {_LINES} SELECT nation, CAST(k AS INTEGER) AS bus, CAST(g + 1 AS INTEGER) AS "group", 'A' AS operation, g = 1 AS automatic, CASE WHEN k % 4 = 0 THEN 'off' ELSE 'on' END AS status, CAST(k % 9 AS INTEGER) AS units, 1 AS online, 1 AS least_online, g + 0.5::DOUBLE AS pg,
CASE WHEN g = 1 THEN 99999.0::DOUBLE ELSE 123.45::DOUBLE END AS apparent, 40.5::DOUBLE AS mechanical FROM s, range(0, 2) t(g) WHERE k % 3 = 0""")
def case_groups(spark, sf_dir):
    return rounded(case.groups(_lines(spark, sf_dir), "nation"))


@query(f"""WITH {_LINES}, b AS (SELECT nation, k, {_FIELDS} FROM s) SELECT nation, bus, type, kv, pg, least, most, state <> 'D' AND type <> 2 AS editable, CASE WHEN k % 3 = 0 THEN '1,2' END AS "groups", CAST(CASE WHEN k % 3 = 0 THEN 2 END AS BIGINT) AS online FROM b WHERE type IN (1, 2) OR pg <> 0 OR k % 3 = 0""")
def generation_targets(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    out = case.generation_targets(case.buses(lines, "nation"), case.groups(lines, "nation"), "nation")
    groups = F.when(F.col("groups").isNotNull(), F.array_join(F.transform("groups", lambda x: x.cast("string")), ","))
    return rounded(out.select("nation", "bus", "type", "kv", "pg", "least", "most", "editable", groups.alias("groups"), "online"))


def _values(spark, sf_dir, extra: bool):
    rows = _suppliers(spark, sf_dir).select("nation", F.col("k").cast("int").alias("bus"))
    if extra:
        rows = rows.unionAll(rows.where("bus % 10 = 3").withColumn("bus", F.col("bus") + 50000))
    return rows.withColumn("mw", F.col("bus") * 11 % 500 / 10)


@query(f"""WITH {_LINES}, v AS (SELECT nation, k AS bus FROM s UNION ALL SELECT nation, k + 50000 FROM s WHERE k % 10 = 3), x AS (SELECT nation, CAST(bus AS INTEGER) AS bus, (bus * 11 % 500) / 10.0::DOUBLE AS mw FROM v)
SELECT nation, bus, mw, CASE WHEN bus >= 50000 THEN 'missing' WHEN bus % 4 = 0 OR bus % 4 = 2 THEN 'not_editable' WHEN bus % 2 = 1 AND mw > 20 + bus % 50 + 1e-6 THEN 'above_limit' END AS fault FROM x""")
def case_change_faults(spark, sf_dir):
    return rounded(case.change_faults(_values(spark, sf_dir, True), case.buses(_lines(spark, sf_dir), "nation"), "nation"))


@query(f"""WITH {_LINES}, p AS (SELECT nation, ord, CASE WHEN ord BETWEEN 1000000 AND 1999999 AND (ord - 1000000) % 4 IN (1, 3) THEN substr(text, 1, 5) || 'E1' || substr(text, 8, 25) || lpad(printf('%.1f', ((ord - 1000000) * 11 % 500) / 10.0::DOUBLE), 5, ' ') ELSE text END AS text FROM lines)
SELECT nation, sha256(string_agg(text || chr(13) || chr(10), '' ORDER BY ord)) AS body_sha256, CAST(sum(length(text) + 2) AS INTEGER) AS bytes FROM p GROUP BY 1""")
def case_patch(spark, sf_dir):
    values = _values(spark, sf_dir, False).where("bus % 4 IN (1, 3)").withColumns({"operation": F.lit("E"), "state": F.lit("1")})
    out = case.assembled(case.patched(_lines(spark, sf_dir), values, "nation"), "nation")
    return out.select("nation", F.sha2("body", 256).alias("body_sha256"), F.length("body").alias("bytes"))


@query(f"""WITH {_LINES}, r AS (SELECT nation, k, lpad(CAST(k AS VARCHAR), 5, ' ') || 'M0   ' || rpad(CASE WHEN k % 5 = 0 THEN 'BARRA ' || k ELSE 'Sitio ' || k END, 12, ' ') || repeat(' ', 10) || lpad(printf('%.1f', (k * 11 % 500) / 10.0::DOUBLE), 5, ' ') AS text FROM s)
SELECT nation, 'DBAR' || chr(13) || chr(10) || '{case.BUS_HEAD}' || chr(13) || chr(10) || string_agg(text, chr(13) || chr(10) ORDER BY k) || chr(13) || chr(10) || '99999' || chr(13) || chr(10) || chr(13) || chr(10) || 'FIM' || chr(13) || chr(10) AS body FROM r GROUP BY 1""")
def case_change_file(spark, sf_dir):
    name = F.when(F.col("bus") % 5 != 0, F.concat(F.lit("Sítio "), F.col("bus").cast("string")))
    values = _values(spark, sf_dir, False).withColumns({"bus_name": name, "operation": F.lit(None).cast("string"), "state": F.lit(None).cast("string")})
    return case.change_files(values, "nation")


@query("""SELECT p_partkey, regexp_replace('acao_' || p_name || '/' || p_partkey, '[^A-Za-z0-9._-]+', '_', 'g') AS stem, 1990 + p_partkey % 30 AS year FROM part""")
def safe_file_names(spark, sf_dir):
    name = F.concat(F.lit("ação_"), "p_name", F.lit("/"), F.col("p_partkey").cast("string"))
    year = S.year_in(F.concat(F.lit("case-"), (F.col("p_partkey") % 30 + 1990).cast("string"), F.lit(".pwf")), case._IN_NAME)
    return table(spark, sf_dir, "part").select("p_partkey", S.safe_stem(name).alias("stem"), year.cast("long").alias("year"))

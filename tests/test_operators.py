"""Operators, functions and sources that no query over the star-schema tables shows, on small fixtures."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gustline.functions import scalars as S
from gustline.functions import wind as W
from gustline.operators import buses, checks, clean, joins, observed, splits, windows
from gustline.sources import fixedwidth, periods, tables


def one(df):
    return df.collect()[0]


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_local_numbers(spark):
    got = values(spark, S.local_number(F.col("t")), [("1.234,5",), ("1234.5",), (" 7 ",), ("x",), (None,), ("NaN",), ("",)], "t string")
    assert got == [1234.5, 1234.5, 7.0, None, None, None, None]


def test_code_roots_and_folding(spark):
    got = values(spark, S.code_root(F.col("t")), [(" eol.cv.12 ",), ("-",), (None,), ("",), ("a.b",)], "t string")
    assert got == ["EOL.CV", "", "", "", "A.B"]
    assert values(spark, S.fold(F.col("t")), [(" São João ",)], "t string") == ["SAO JOAO"]
    assert values(spark, S.safe_stem(F.col("t")), [("Usina Nº 1/ção.pwf",)], "t string") == ["Usina_N_1_cao.pwf"]
    assert values(spark, S.version_normal(F.col("t")), [("12.03.04",)], "t string") == ["12.3.4"]


def test_wall_clock_to_utc_is_null_where_it_is_not_unique(spark):
    rows = [(dt.datetime(2018, 6, 1, 12),), (dt.datetime(2018, 11, 4, 0, 30),), (dt.datetime(2018, 2, 17, 23, 30),)]
    got = values(spark, S.to_utc_strict(F.col("t"), "America/Sao_Paulo"), rows, "t timestamp_ntz")
    assert got == [dt.datetime(2018, 6, 1, 15), None, None]


def test_strict_iso_hours(spark):
    got = values(spark, S.strict_iso_hour(F.col("t")).cast("string"), [("2024-01-01T03:00:00-03:00",), ("2024-01-01T03:00:00",), ("2024-01-01T03:10:00Z",), ("no",)], "t string")
    assert got == ["2024-01-01 06:00:00", None, None, None]


def test_active_through_the_whole_last_day(spark):
    day = dt.datetime(2024, 5, 1)
    rows = [(day + dt.timedelta(hours=23), None, day), (day + dt.timedelta(hours=24), None, day), (day, day + dt.timedelta(hours=1), None)]
    assert values(spark, S.active_at(F.col("t"), F.col("a"), F.col("b")), rows, "t timestamp_ntz, a timestamp_ntz, b timestamp_ntz") == [True, False, False]


def test_fixed_numbers_keep_what_fits(spark):
    got = values(spark, S.fixed_number(F.col("x"), 5), [(1.5,), (123.4,), (12345.6,), (-123456.0,), (None,)], "x double")
    assert got == ["1.500", "123.4", "12346", None, None]
    assert values(spark, S.implied_decimal(F.col("t"), 1), [("1025",), ("",)], "t string") == [1.025, None]


@pytest.mark.parametrize("wind,want", [(2.99, 0.0), (3.0, 0.0), (12.0, 95.0), (24.9, 95.0), (25.0, 0.0), (None, None)])
def test_power_curve_branches(spark, wind, want):
    assert values(spark, W.power(F.col("w"), F.lit(100.0), F.lit(0.95)), [(wind,)], "w double") == [want]


def test_power_rises_between_start_and_full_power(spark):
    got = values(spark, W.power(F.col("w"), F.lit(1.0), F.lit(1.0)), [(float(w),) for w in range(3, 13)], "w double")
    assert got == sorted(got) and got[-1] == 1.0 and math.isclose(got[3], (6**3 - 27) / (12**3 - 27))


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, `Código ` string")
    assert checks.find_column(df, ["codigo"]) == "Código "
    with pytest.raises(checks.ContractError):
        checks.require(df, ["absent"])
    with pytest.raises(checks.ContractError):
        checks.require_unique(df, ["k"])
    with pytest.raises(checks.ContractError):
        checks.rename(df, {"Código ": "k"})
    with pytest.raises(checks.ContractError):
        checks.require_subset(df.select("k"), df.select("k").where("k > 1"), ["k"])
    with pytest.raises(checks.ContractError):
        checks.require_disjoint(df.select("k"), df.select("k"), ["k"])


def test_hourly_sums_count_exact_copies_once_and_keep_null_sums(spark):
    t = dt.datetime(2024, 1, 1, 5, 30)
    rows = spark.createDataFrame([("a", t, 1.0), ("a", t, 1.0), ("a", t, 2.0), ("b", t, None)], "k string, t timestamp_ntz, x double")
    got = {r.k: (r.x, r.n) for r in clean.hourly_sum(rows, ["k"], "t", "x").collect()}
    assert got == {"a": (3.0, 2), "b": (None, 1)}


def test_final_values_go_before_provisional_ones(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 5, 2.0), ("b", 5, 3.0), ("c", 1, None)], "k string, v int, x double")
    best, which = clean.prefer_final(F.col("x"), F.col("v"))
    got = {r.k: (r.best, r.which) for r in rows.groupBy("k").agg(best.alias("best"), which.alias("which")).collect()}
    assert got == {"a": (1.0, 1), "b": (3.0, 5), "c": (None, None)}


def test_weather_quality_names_every_fault(spark):
    hour = dt.datetime(2024, 1, 1)
    rows = [("a", hour, 280.0), ("a", hour, 281.0), ("a", hour + dt.timedelta(minutes=30), None), ("a", hour + dt.timedelta(hours=1), 900.0)]
    got = one(clean.weather_quality(spark.createDataFrame(rows, "k string, t timestamp_ntz, kelvin double"), ["k"], "t", {"kelvin": (150, 350)}, 4))
    assert (got.rows, got.repeated, got.null_kelvin, got.range_kelvin, got.off_hour, got.hours, got.valid) == (4, 1, 1, 1, 1, 3, False)
    good = spark.createDataFrame([("a", hour, 280.0)], "k string, t timestamp_ntz, kelvin double")
    assert one(clean.weather_quality(good, ["k"], "t", {"kelvin": (150, 350)}, 1)).valid is True


def test_lags_never_bridge_gaps(spark):
    rows = spark.createDataFrame([("a", h, float(h)) for h in (1, 2, 4, 5, 6)], "k string, h long, x double")
    lag = rows.select("h", windows.exact_lag(F.col("x"), ["k"], "h", 1).alias("lag"))
    assert {r.h: r.lag for r in lag.collect()} == {1: None, 2: 1.0, 4: None, 5: 4.0, 6: 5.0}
    rolled = {r.h: r.x_mean_3h for r in windows.rolling(rows, ["k"], "h", ["x"], 3).collect()}
    assert rolled == {1: None, 2: None, 4: None, 5: None, 6: 5.0}


def test_evenly_spaced_positions(spark):
    rows = spark.range(1000).select(F.col("id").alias("r"), windows.positions(F.lit(1000), F.col("id"), 168).alias("p")).where("p").collect()
    assert len(rows) == 168 and rows[0].r == 0 and rows[-1].r == 999


@pytest.mark.parametrize("n,blocks", [(10, 5), (11, 5), (14, 5), (3, 3)])
def test_blocks_of_ranks(spark, n, blocks):
    got = [r.b for r in spark.range(n).select(splits.block_of(F.col("id"), F.lit(n), blocks).alias("b")).collect()]
    longer = n % blocks
    want = [k for k in range(blocks) for _ in range(n // blocks + (k < longer))]
    assert got == want


def test_priority_match_stops_at_an_ambiguous_value(spark):
    registry = spark.createDataFrame([(1, "A.1"), (2, "B"), (3, "B"), (4, "C.1"), (5, "C.2")], "id int, code string")
    rows = spark.createDataFrame([("A.1",), ("A.9",), ("B",), ("C.3",), ("",), (None,)], "code string")
    steps = [("exact", F.col("code"), F.col("code")), ("root", S.code_root(F.col("code")), S.code_root(F.col("code")))]
    got = {r.code: (r.match_method, r.match_status, r.match_reason, r.matched) for r in joins.priority_match(rows, registry, "id", steps).collect()}
    assert got["A.1"] == ("exact", "matched", "", 1)
    assert got["A.9"] == ("root", "matched", "", 1)
    assert got["B"] == ("unresolved", "review_required", "ambiguous_exact", None)
    assert got["C.3"] == ("unresolved", "review_required", "ambiguous_root", None)
    assert got[""][1:] == got[None][1:] == ("unresolved", "not_found", None)


def test_an_ambiguous_override_is_not_replaced_by_a_later_step(spark):
    registry = spark.createDataFrame([(1, "A", "X"), (2, "B", "X"), (3, "C", "Y"), (4, "D", "Z")], "id int, code string, name string")
    rows = spark.createDataFrame([("A", "X"), ("A", "Y"), ("A", ""), ("E", "W")], "code string, name string")
    steps = [("name", F.col("name"), F.col("name")), ("exact", F.col("code"), F.col("code"))]
    got = {(r.code, r.name): (r.match_method, r.match_status, r.match_reason, r.matched) for r in joins.priority_match(rows, registry, "id", steps).collect()}
    assert got == {
        ("A", "X"): ("unresolved", "review_required", "ambiguous_name", None),
        ("A", "Y"): ("name", "matched", "", 3),
        ("A", ""): ("exact", "matched", "", 1),
        ("E", "W"): ("unresolved", "unresolved", "not_found", None),
    }


def test_shares_sum_to_one(spark):
    rows = spark.createDataFrame([("p", 1, 3.0), ("p", 2, 1.0), ("q", 1, 2.0)], "plant string, bus int, cap double")
    shares = buses.allocation_shares(rows, "plant", "bus", "cap")
    assert buses.check_shares(shares, "plant").isEmpty()
    dealt = buses.accumulate(spark.createDataFrame([("p", 8.0), ("q", 1.0)], "plant string, mw double"), shares, "plant", "bus", "mw")
    assert {r.bus: r.mw for r in dealt.collect()} == {1: 7.0, 2: 2.0}
    with pytest.raises(checks.ContractError):
        buses.require_one_state(spark.createDataFrame([(1, "a"), (1, "b")], "bus int, state string"), "bus", "state")


def test_lines_blocks_and_patches_of_fixed_width_files(spark, tmp_path):
    body = "TITU\r\ncase\r\nDBAR\r\n(Num\r\n    1  10\r\n    2  20\r\n99999\r\nFIM\n"
    (tmp_path / "case.pwf").write_bytes(body.encode("latin-1"))
    lines = fixedwidth.read_lines(spark, str(tmp_path))
    rows = lines.orderBy("line").collect()
    assert [r.ending for r in rows] == ["CRLF"] * 7 + ["LF"]
    assert all(body[r.offset :].startswith(r.text) for r in rows)
    buses_ = fixedwidth.block_records(lines, "path", ["DBAR"])
    got = buses_.select(fixedwidth.int_field(F.col("text"), 0, 5).alias("bus"), fixedwidth.int_field(F.col("text"), 5, 4).alias("p"), fixedwidth.patch(F.col("text"), 5, 4, F.lit("  99")).alias("new")).orderBy("bus").collect()
    assert [(r.bus, r.p, r.new) for r in got] == [(1, 10, "    1  99"), (2, 20, "    2  99")]


def test_tables_in_and_out(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;x\n001;1,5\n")
    (tmp_path / "b.csv").write_text("id,y\n002,7\n")
    got = {r.id: (r.x, r.y) for r in tables.read_many(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()}
    assert got == {"001": ("1,5", None), "002": (None, "7")}
    with pytest.raises(ValueError):
        tables.read_table(spark, "table.xlsx")
    out = str(tmp_path / "out.parquet")
    tables.write_once(spark.range(3), out)
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_once(spark.range(3), out)


def test_late_partitions_replace_only_themselves(spark, tmp_path):
    out = str(tmp_path / "late.parquet")
    tables.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "x int, month string"), out, ["month"])
    tables.replace_partitions(spark.createDataFrame([(9, "b")], "x int, month string"), out, ["month"])
    assert {(r.month, r.x) for r in spark.read.parquet(out).collect()} == {("a", 1), ("b", 9)}


def test_logical_hash_ignores_order(spark):
    rows = [(1, "a"), (2, None), (3, "")]
    a, b = (one(tables.logical_hash(spark.createDataFrame(r, "k int, t string"), ["k", "t"])) for r in (rows, rows[::-1]))
    other = one(tables.logical_hash(spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "k int, t string"), ["k", "t"]))
    assert a == b and a.rows == 3 and other.digest != a.digest
    assert tables.canonical_json({"b": 1, "a": [None]}) == '{"a":[null],"b":1}'


def test_the_residual_model_is_bounded_and_tested_on_later_hours(spark):
    from gustline.operators.ml import residual_model
    from gustline.plans.registry import scored

    rows = scored(spark, "/root/testdata/sf0.01")
    hours = sorted({r.hour_idx for r in rows.select("hour_idx").collect()})
    out = residual_model(rows).toPandas()
    held = rows.where(F.col("hour_idx") >= hours[len(hours) * 85 // 100]).count()
    assert len(out) == held and out.hybrid.between(0, 427.5).all()
    assert (out.hybrid - out.gen).abs().mean() <= (out.base - out.gen).abs().mean()


def test_capacity_counts_overlapping_relations_once(spark):
    day = dt.datetime(2024, 1, 1)
    at = lambda n: day + dt.timedelta(days=n)
    members = spark.createDataFrame([("p", 1, 5.0, at(0), at(9)), ("p", 1, 7.0, at(4), at(5)), ("p", 2, 2.0, None, at(3)), ("p", 3, None, at(1), None), ("q", 1, 1.0, at(5), at(2))], "plant string, member int, cap double, start timestamp_ntz, end timestamp_ntz")
    asked = spark.createDataFrame([("p", at(n)) for n in range(-1, 12)] + [("q", at(4))], "plant string, t timestamp_ntz")
    got = {r.t: (r.cap, r.members) for r in joins.capacity_by_validity(asked, members, ["plant"], "t", "member", "cap").collect()}
    want = {at(-1): (2.0, 1), at(0): (7.0, 2)} | {at(n): (7.0, 3) for n in (1, 2, 3)} | {at(n): (7.0, 2) for n in (4, 5)} | {at(n): (5.0, 2) for n in (6, 7, 8, 9)} | {at(n): (0.0, 1) for n in (10, 11)}
    assert got == want


def test_staged_outputs_appear_once(spark, tmp_path):
    from gustline.sources import periods

    df = spark.range(5)
    periods.staged(df, f"file://{tmp_path}/a/out")
    assert spark.read.parquet(f"file://{tmp_path}/a/out").count() == 5
    with pytest.raises(checks.ContractError):
        periods.staged(df, f"file://{tmp_path}/a/out")


def test_implied_numbers_and_marks(spark):
    rows = [("1000",), (".985",), ("99999",), ("-9999",), ("    ",), ("1E2 ",), ("x",)]
    assert values(spark, S.implied_number(F.col("t"), 1), rows, "t string") == [1.0, 0.985, 99999.0, -9999.0, None, 100.0, None]


def test_exact_quantiles_with_ties_and_nulls(spark):
    from gustline.operators import stages

    df = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 2, 5, 5, 9]] + [(None,)], "x double")
    got = {r.share: r.value for r in stages.exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.25: 1.0, 0.5: 2.0, 0.9: pytest.approx(6.6), 1.0: 9.0}
    assert stages.exact_quantiles(df.where("x IS NULL"), "x", [0.5]).count() == 0


def test_memberships_without_an_id_are_an_error(spark):
    from gustline.sources import registers

    rows = spark.createDataFrame([(None, "m", "c", "NE", "2024-01-01", None)], "group string, member string, code string, area string, start string, end string")
    with pytest.raises(Exception, match="without an id"):
        registers.read_membership(rows, "NE").collect()


def test_years_in_titles_and_names(spark):
    from gustline.functions import scalars as S
    from gustline.sources import case

    rows = [("Study ANO 2030 base", 2030), ("ano: 1999", 1999), ("ANO 20301", None), ("ANO 3050 ANO 2040", 2040), ("PLANO 2030", None), ("", None), (None, None)]
    names = [("case-2031.pwf", 2031), ("a1234b2020.pwf", 2020), ("20201.pwf", None), ("x", None), (None, None)]
    for pattern, cases in ((case._STUDY, rows), (case._IN_NAME, names)):
        df = spark.createDataFrame(cases, "text string, want int")
        assert all(r.got == r.want for r in df.withColumn("got", S.year_in(F.col("text"), pattern)).collect())


def test_marks_of_any_form_fold(spark):
    texts = ["Ca\u0303o", "\u1ea4\u0219\u0111", "N\u00ba 2\u00b2", "\uff37\uff49", "\u0418\u0439", None, ""]
    assert values(spark, S.fold(F.col("t")), [(t,) for t in texts], "t string") == ["CAO", "AS\u0110", "NO 22", "WI", "\u0418\u0419", None, ""]
    assert checks.find_name(["N\u00famero\u00a0", "\ufb01m"], ["numero"]) == "N\u00famero\u00a0" and checks.find_name(["\ufb01m"], ["FIM"]) == "\ufb01m"


def test_half_hours_are_named_not_floored(spark):
    rows = [("a", "2024-01-01 00:30:00"), ("a", "2024-01-01 00:30:00.000001"), ("a", "2024-01-01 00:15:00"), (" - ", "2024-01-01 00:00:00"), ("a", None), (None, None)]
    df = spark.createDataFrame(rows, "id string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    exact = [r["fault"] for r in observed.half_hour_records(df, "id", "t").collect()]
    assert exact == [None, "off_grid", "off_grid", "without_id", "bad_time", "without_id"]
    assert [r["fault"] for r in observed.half_hour_records(df, "id", "t", exact=False).collect()] == [None, None, *exact[2:]]


def test_user_files_are_refused_by_their_size(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_bytes("\ufeffplant; hour;u;v;availability\r\na;2024-01-01T00:00:00Z;1;2;0.5\r\n\r\na;2024-01-01T00:00:00Z;1;2;0.5\r\nb;2024-01-01T01:00:00Z;x;2;0.5".encode())
    got = [(r["row"], r["plant"], r["error"]) for r in periods.check_file(spark, str(path)).orderBy("row").collect()]
    assert got == [(2, "a", None), (4, "a", "repeated"), (5, "b", "u")]
    with pytest.raises(checks.ContractError):
        periods.check_file(spark, str(path), most_bytes=100)
    (tmp_path / "empty.csv").touch()
    with pytest.raises(checks.ContractError):
        periods.check_file(spark, str(tmp_path / "empty.csv"))


def test_submitted_buses_are_dealt_again(spark):
    shares = spark.createDataFrame([("a", 1, 0.25), ("a", 2, 0.75), ("b", 2, 1.0), ("b", 3, 0.0), ("c", 4, 1.0)], "plant string, bus int, share double")
    values = spark.createDataFrame([("a", 100.0), ("b", 1e9), ("c", 1.0)], "plant string, mw double")
    sent = spark.createDataFrame([(1, 25.0001), (2, 1e9 + 75.5), (4, float("nan")), (9, 1.0)], "bus int, mw double")
    got = {r["bus"]: (r["mw"], r["fault"]) for r in buses.recomputed(sent, values, shares, "plant", "bus", "mw").collect()}
    assert got == {1: (25.0, "differs"), 2: (1e9 + 75.0, None), 3: (0.0, "missing"), 4: (1.0, "differs"), 9: (None, "unknown")}
    twice = buses.recomputed(sent.unionByName(sent.where("bus = 2")), values, shares, "plant", "bus", "mw").where("bus = 2").first()
    assert twice["fault"] == "repeated" and buses.recomputed(sent.where("false"), values, shares, "plant", "bus", "mw").where("fault <> 'missing'").isEmpty()


def test_a_submitted_megawatt_too_much_is_a_fault_of_a_large_bus(spark, tmp_path):
    from gustline import plans

    rows = [(k, k % 25, 2e8 + k / 100) for k in range(600)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["bus"]: r["fault"] for r in plans.QUERIES["recomputed_buses"](spark, str(tmp_path)).collect()}
    assert [got[b] for b in (5, 10, 15)] == ["differs", "repeated", "differs"] and got[2] is None


def test_quantiles_of_slices_are_exact_and_hold_no_slice_in_a_task(spark, tmp_path, monkeypatch):
    import numpy as np

    from gustline import plans
    from gustline.operators import metrics

    lines = spark.range(2000).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id * 7 AS l_partkey", "id AS l_suppkey", "TIMESTAMP_NTZ '1995-01-01' + make_dt_interval(CAST(id % 90 AS INT)) AS l_shipdate", "IF(id % 4 = 0, NULL, 'R') AS l_returnflag", "CAST(id * id % 9999 AS DOUBLE) AS l_extendedprice", "CAST(id % 50 AS DOUBLE) AS l_quantity", "0.05D AS l_discount")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = plans.QUERIES["metrics_by_slice"](spark, str(tmp_path))
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["all_condition"], r["condition"]): r["rows"] for r in got.where("all_band + all_plant + all_month = 3").collect()} == {(1, None): 2000, (0, None): 500, (0, "R"): 1500}

    for name in ("CELLS", "FEW_ROWS"):
        monkeypatch.setattr(metrics, name, 4)
    odd = [0.0, -0.0, 1e300, -1e300, 5e-324, 1.5, 1.5, None]
    rows = [(k % 3 or None, "ab"[k % 2], odd[k] if k < len(odd) else k * k % 611 / 7 - 20, 7.0 if k % 2 else None) for k in range(900)]
    table = spark.createDataFrame(rows, "plant int, kind string, x double, y double")
    asked = {"x50": (F.col("x"), 0.5), "x95": (F.col("x"), 0.95), "x100": (F.col("x"), 1.0), "y10": (F.col("y"), 0.1)}
    out = metrics.slices_with_quantiles(table, [F.count("*").alias("rows")], asked, ["plant", "kind"]).collect()
    assert len(out) == 1 + 3 + 2
    for r in out:
        own = [x for x in rows if (r["all_plant"] or x[0] == r["plant"]) and (r["all_kind"] or x[1] == r["kind"])]
        assert r["rows"] == len(own)
        for name, (at, q) in {"x50": (2, 0.5), "x95": (2, 0.95), "x100": (2, 1.0), "y10": (3, 0.1)}.items():
            held = [x[at] for x in own if x[at] is not None]
            assert r[name] == (pytest.approx(np.quantile(held, q), rel=1e-12) if held else None)

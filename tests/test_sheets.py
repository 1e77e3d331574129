"""Workbooks: parts made by hand, workbooks that this library wrote, and what is refused."""

import zipfile

import pytest

from gustline.sources import registers, sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def by_hand(path):
    """Two sheets, the second under an absolute target; shared strings with runs and a reading; cells out of place, a truth value, an error, a formula's text, a gap of rows."""
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{LINK}"><sheets><sheet name="Other" sheetId="1" r:id="a"/><sheet name="Plants &amp; more" sheetId="2" r:id="b"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/one.xml"/><Relationship Id="b" Target="/xl/worksheets/two.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst {MAIN}><si><t>Código </t></si><si><r><t>Na</t></r><r><t>me</t></r><rPh><t>reading</t></rPh></si><si><t>x &lt; y</t></si></sst>')
        book.writestr("xl/worksheets/one.xml", f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>name</t></is></c></row></sheetData></worksheet>')
        rows = (
            '<row r="3"><c r="B3" t="s"><v>0</v></c><c r="AB3" t="s"><v>1</v></c></row><row r="4"/>'
            '<row r="7"><c r="B7"><v>101</v></c><c r="AB7" t="s"><v>2</v></c></row>'
            '<row r="8"><c r="B8" t="b"><v>1</v></c><c r="C8"><v>5</v></c><c r="AB8" t="e"><v>#N/A</v></c></row>'
            '<row><c r="B9" t="str"><f>1+1</f><v>two</v></c></row>'
        )
        book.writestr("xl/worksheets/two.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")


def test_parts_made_by_hand(spark, tmp_path):
    by_hand(tmp_path / "a.xlsx")
    got = sheets.read_sheets(spark, str(tmp_path), {"code": ["CODIGO"], "name": ["name"]}, "Plants & more").orderBy("row").collect()
    assert [(r["row"], r["code"], r["name"]) for r in got] == [(7, "101", "x < y"), (8, "1", "#N/A"), (9, "two", None)]
    assert sheets.read_sheets(spark, f"file://{tmp_path}/a.xlsx", {"name": ["NAME"]}).collect() == []


def test_round_trip_of_odd_values_and_orders_of_headers(spark, tmp_path):
    rows = [("a", 1, "x & <y> \"z\" 'é'", 1.5), ("a", 2, None, None), ("a", 3, "  two  spaces ", -2e-7), ("b", 1, "", 3.0), ("b", 5000, "last", 0.1)]
    table = spark.createDataFrame(rows, "book string, n long, text string, x double")
    done = sheets.write_sheets(table.where("book = 'a'"), str(tmp_path), "book", {"n": "N", "text": "Text", "x": "X"}, ["n"]).collect()
    assert [r["rows"] for r in done] == [3]
    sheets.write_sheets(table.where("book = 'b'"), f"file://{tmp_path}", "book", {"x": "X", "n": "N", "text": "Text"}, ["n"]).collect()
    got = sheets.read_sheets(spark, str(tmp_path), {"n": ["n"], "text": ["text"], "x": ["x"]})
    back = {(r["file"][-6], int(r["n"]), r["text"] or "", None if r["x"] is None else float(r["x"])) for r in got.collect()}
    assert back == {(b, n, t or "", x) for b, n, t, x in rows}


def test_many_rows_come_in_batches(spark, tmp_path):
    n = 2 * sheets.BATCH_ROWS + 1
    sheets.write_sheets(spark.range(n).selectExpr("1 AS book", "id"), str(tmp_path), "book", {"id": "id"}, ["id"]).collect()
    found = sheets.read_sheets(spark, str(tmp_path), {"id": ["id"]}).selectExpr("count(*) AS n", "sum(CAST(id AS LONG)) AS s", "max(row) AS last").first()
    assert tuple(found) == (n, n * (n - 1) // 2, n + 1)


def test_faults_end_the_job(spark, tmp_path):
    by_hand(tmp_path / "a.xlsx")
    with pytest.raises(Exception, match="no sheet"):
        sheets.read_sheets(spark, str(tmp_path), {"name": ["name"]}, "Missing").collect()
    with pytest.raises(Exception, match="none of"):
        sheets.read_sheets(spark, str(tmp_path), {"x": ["power"]}).collect()
    with pytest.raises(ValueError):
        sheets.read_sheets(spark, str(tmp_path), {"row": ["row"]})
    (tmp_path / "b.xlsx").write_bytes(b"PK no workbook")
    with pytest.raises(Exception, match="not an XLSX"):
        sheets.read_sheets(spark, str(tmp_path / "b.xlsx"), {"name": ["name"]}).collect()


def test_sheet_rows_that_can_be_mapped(spark):
    rows = [("eol.cv.1", " eol", "BA", "101", "60"), ("eol.cv.1", "UFV", "BA", "102", "60"), ("-", "EOL", "BA", "103", "60"), ("x.2", "EOL", "BA", "0", "60"), ("x.3", "EOL", "BA", "104", "n/d"), ("x.4", "EOL", None, "105.0", "1"), ("x.5", "EOL", "BA", None, "1"), ("x.6", None, "BA", "7", "1"), ("x.7", "EOL", "BA", "8", "-1")]
    got = registers.read_bus_sheet(spark.createDataFrame(rows, "code string, kind string, state string, bus string, share_mw string"), "EOL").collect()
    assert {tuple(r) for r in got} == {("EOL.CV", 101, "BA", 60.0), ("X", 105, None, 1.0)}


def most_rows(df):
    """The largest count of rows that a node of the plan made when it ran."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind, metrics = node.getClass().getSimpleName(), node.metrics()
        if metrics.contains("numOutputRows"):
            most = max(most, metrics.apply("numOutputRows").value())
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(k) for k in range(node.children().size())]
    return most


def test_rows_of_a_sheet_are_summed_before_they_meet_the_members(spark):
    members = spark.range(400).selectExpr("id % 2 AS plant", "id % 300 AS place", "CASE WHEN id % 300 < 250 THEN 'R' ELSE 'other' END AS code_root", "CAST(id AS DOUBLE) AS capacity")
    sheet = spark.range(3000).selectExpr("CASE WHEN id % 10 = 9 THEN 'other' ELSE 'R' END AS code_root", "CASE WHEN id % 10 < 9 THEN id % 3 END AS bus", "CASE WHEN id % 3 > 0 THEN 'S' END AS state", "1.0D AS share_mw")
    got = registers.bus_mapping(members, sheet)
    assert most_rows(got) <= 3000
    rows = {(r["place"], r["bus"]): (r["plant"], r["state"], r["share_mw"], r["capacity"], r["code_root"], r["places"], r["mapped"]) for r in got.collect()}
    assert len(rows) == got.count() == 250 * 3
    assert rows[(5, 0)] == (1, None, 900.0 * 2, 5.0, "R", 150, 125) and rows[(200, 2)] == (0, "S", 900.0, 200.0, "R", 150, 125)


def test_parts_in_workbooks_are_summed_before_they_meet_the_places(spark, tmp_path):
    from gustline import plans

    spark.range(3000).selectExpr("id AS p_partkey", "CAST(100 AS DOUBLE) AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(600).selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey", "CAST(id AS DOUBLE) AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    got = plans.QUERIES["sheet_bus_mapping"](spark, str(tmp_path))
    assert most_rows(got) <= 3000
    own = [k for k in range(3000) if k % 30 == 1 and k % 40 == 31 and k % 11 and k % 13]
    assert [(r["share_mw"], r["state"]) for r in got.where("place = 51 AND bus = 31").collect()] == [(100.0 * len(own), "S1")]


def test_a_sheet_is_read_once_for_a_mapping(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    members = spark.range(40).selectExpr("id % 2 AS plant", "id AS place", "CONCAT('R', id % 4) AS code_root", "CAST(id AS DOUBLE) AS capacity")
    sheet = spark.range(300).selectExpr("CONCAT('R', id % 3) AS code_root", "id % 5 AS bus", "'S' AS state", "1.0D AS share_mw").mapInArrow(counted, "code_root string, bus long, state string, share_mw double")
    rows = registers.bus_mapping(members, sheet).collect()
    assert read.value == 300
    # places 3, 7, 11 and so on are of R3, which the sheet lacks: all of the odd plant
    assert len(rows) == 30 * 5 and {(r["plant"], r["share_mw"], r["places"], r["mapped"]) for r in rows} == {(0, 20.0, 20, 20), (1, 20.0, 20, 10)}


def test_small_workbooks_share_tasks(spark, tmp_path):
    sheets.write_sheets(spark.range(60).selectExpr("id % 30 AS book", "id"), str(tmp_path), "book", {"id": "id"}, ["id"]).collect()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = sheets.read_sheets(spark, str(tmp_path), {"id": ["id"]})
        assert got.rdd.getNumPartitions() <= 30
        assert sorted(int(r["id"]) for r in got.collect()) == list(range(60))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_sheet_parsed_at_once_equals_one_parsed_by_rows(tmp_path, monkeypatch):
    by_hand(tmp_path / "a.xlsx")
    (tmp_path / "b.xlsx").write_bytes(sheets.encoded([["N", "Text"], [1, " x <&> \t"], [None, "a  b"], [True, "a b"], [2.5], [None, None]], "s"))
    whole = [list(sheets.sheet_rows(tmp_path / n, s)) for n, s in (("a.xlsx", "Plants & more"), ("b.xlsx", None))]
    assert whole[1] == [(1, ["N", "Text"]), (2, ["1", " x <&> \t"]), (3, [None, "a  b"]), (4, ["True", "a b"]), (5, ["2.5"])]
    monkeypatch.setattr(sheets, "WHOLE_BYTES", 0)
    assert whole == [list(sheets.sheet_rows(tmp_path / n, s)) for n, s in (("a.xlsx", "Plants & more"), ("b.xlsx", None))]

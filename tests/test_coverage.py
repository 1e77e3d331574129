"""Every order enters the whole audit, whatever its key."""

from gustline import plans


def test_whole_audit_leaves_no_order_out(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(1, 11)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(k, 5.0) for k in range(1, 9)] + [(k, 20.0) for k in (5, 10, 11)]
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.side: r.rows for r in plans.QUERIES["whole_coverage_audit"](spark, str(tmp_path)).collect()}
    assert got == {"both": 9, "left_only": 1, "right_only": 1}

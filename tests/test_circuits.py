"""Circuit predicates on literal rows."""

from pyspark.sql import functions as F

from loomgrid.operators import circuits


def column(spark, schema, rows, made):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(made).collect()]


def test_spare_circuits(spark):
    rows = [("备用", "", "C65N", ""), (" 备 用 回路", None, None, "LC1"), ("备用", None, " ", None), ("备用照明", "备用开关", "C65N", None), (None, "备用", "C65N", None), ("预留", None, "C65N", None), ("备用", "仅 预留", "C65N", None), ("插座", "未装", "x", None), ("插座", "未装饰", "x", None), (None, None, None, None)]
    made = circuits.spare_disposition(F.col("l"), F.col("n"), F.col("b"), F.col("c"))
    want = ["installed_spare", "installed_spare", "reserved", "active", "installed_spare", "installed_spare", "reserved", "reserved", "active", "active"]
    assert column(spark, "l string, n string, b string, c string", rows, made) == want


def test_labels_and_incomers(spark):
    rows = [("WL1", "x", ""), ("", "备用", "L1"), (None, "备用", None), ("", "灯", "L1"), (None, None, "L2"), (" 进线 ", "", ""), ("W1", " 进线柜", "")]
    schema = "n string, l string, p string"
    assert column(spark, schema, rows, circuits.circuit_label(F.col("n"), F.col("l"), F.col("p"))) == ["WL1", "备用(L1)", "备用", "灯", "未编号回路", " 进线 ", "W1"]
    assert column(spark, schema, rows, circuits.is_incoming(F.col("n"), F.col("l"))) == [False] * 5 + [True, True]


def test_quantities_phases_and_gates(spark):
    rows = [("3", True), ("2.9", None), ("0", True), ("-1", True), ("4", False), ("x", True), (None, None)]
    assert column(spark, "q string, c boolean", rows, circuits.box_multiplier(F.col("q"), F.col("c"))) == [3, 2, 1, 1, 1, 1, 1]
    phases = [(x,) for x in ("", None, "L1", "l1,l2,l3", "L1/N/PE", "L1~L3", "L123NPE", "三相", "abc", "L4", "L1L2", "AC", "-")]
    assert column(spark, "p string", phases, circuits.valid_phase(F.col("p"))) == [True] * 9 + [False, False, False, False]
    gates = [(80, 1), (80, 2), (79, 0), (None, None)]
    assert column(spark, "g int, t int", gates, circuits.thin_text(F.col("g"), F.col("t"))) == [True, False, False, False]
    assert column(spark, "e int, f boolean", [(0, True), (0, False), (1, True), (None, True)], circuits.conversion_accepted(F.col("e"), F.col("f"))) == [True, False, False, False]

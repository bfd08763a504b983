"""Schedule tables on literal grids."""

from pyspark.sql import functions as F

from loomgrid.operators import schedules

LABELS = ["低压配电柜编号", "低压配电柜型号", "空气开关", "交流接触器", "电流互感器", "热继电器", "设备容量 kW", "回路编号", "导线型号及规格", "计算电流 A", "回路名称", "二次图编号", "启动方式"]
CELLS = "t string, row int, col int, text string, ruled boolean, top double, bottom double"


def grid(spark, columns, open_borders=(), tall=None, t="t"):
    rows = len(columns[0])
    y = [float(i + (tall is not None and i > tall)) for i in range(rows + 1)]
    return spark.createDataFrame([(t, r, c, columns[c][r], (r, c) not in open_borders, y[r], y[r + 1]) for c in range(len(columns)) for r in range(rows)], CELLS)


def circuits(df):
    return {(r["code"], r["circuit_no"]): r for r in schedules.schedule_circuits(df, "t").collect()}


def columns(n):
    return [list(LABELS), *([""] * len(LABELS) for _ in range(n))]


def test_merged_cells(spark):
    c = columns(4)
    c[1][0], c[1][1], c[1][6], c[1][8] = "C01", "GGD", "281kW", "进 电"
    c[2][0], c[2][2], c[2][7] = "C02", "MCCB-250MA/200A/3P", "S-1a-P"
    c[3][2], c[3][7], c[3][10] = "MCCB-250MA/200A/3P", "S-1b-P", "喷淋泵"
    got = circuits(grid(spark, c, {(0, 3), (10, 3), (6, 3), (2, 4)}))
    assert set(got) == {("C01", ""), ("C02", "S-1a-P"), ("C02", "S-1b-P")}
    assert got["C01", ""]["cable"] == "进电" and got["C02", "S-1a-P"]["load"] == got["C02", "S-1b-P"]["load"] == "喷淋泵" and got["C01", ""]["power"] == "281kW"


def test_a_double_row_moves_texts_up(spark):
    c = columns(2)
    c[0] = LABELS[:9] + ["", "计算电流 A", "回路名称", "二次图编号"]
    c[1][0], c[1][7], c[1][8], c[1][9], c[1][11], c[1][12] = "C02", "S-1a-P", "YJV-4×70-SC80", "YJV-3×70-SC80", "喷淋泵", "详图"
    c[2][0], c[2][7], c[2][8], c[2][9], c[2][11] = "C03", "X-1-P", "YJV-5×6-SC32", "167", "潜污泵控制箱"
    got = circuits(grid(spark, c, tall=8))
    assert (got["C02", "S-1a-P"]["cable"], got["C02", "S-1a-P"]["load"]) == ("YJV-4×70-SC80\nYJV-3×70-SC80", "喷淋泵")
    assert (got["C03", "X-1-P"]["cable"], got["C03", "X-1-P"]["load"]) == ("YJV-5×6-SC32", "潜污泵控制箱")
    assert circuits(grid(spark, c))["C03", "X-1-P"]["cable"] == "YJV-5×6-SC32"


def test_tables_without_names_or_codes(spark):
    assert circuits(grid(spark, [["回路编号", "回路名称", "导线"], ["W1", "灯", "BV"]])) == {}
    assert circuits(grid(spark, [["编号", "x", "导线"], ["C1", "灯", "BV"]])) == {}
    same = circuits(grid(spark, [["编号", "回路编号", "导线"], ["", "W1", "BV"], ["C9", "W2", "YJV\\n x"]], {(0, 1)}))
    assert {k: r["cable"] for k, r in same.items()} == {("C9", "W2"): "YJV\nx"}


def test_bands_and_chains(spark):
    rules = spark.createDataFrame([("p", i * 0.03) for i in range(12)] + [("p", 0.6 + i * 0.03) for i in range(5)], "page string, y double")
    assert [tuple(r) for r in schedules.rule_bands(rules, ["page"], "y").groupBy("page", "island").agg(F.count("*")).collect()] == [("p", 1, 12)]
    xs = [0.0, 0.05, 0.1, 0.3, 0.35, 0.4, 0.405, 0.5, 0.55, 0.6]
    got = schedules.column_chain(spark.createDataFrame([("p", x) for x in xs], "page string, x double"), ["page"], "x")
    assert sorted(r["x"] for r in got.collect()) == [0.405, 0.5, 0.55, 0.6]

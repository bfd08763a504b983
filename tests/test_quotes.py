"""Enclosures, bars, quotations and replacements on literal rows."""

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import quotes, replacements

BOXES = "code string, size string, box_type string, install string, ip_rating string, note string, material string, thickness string, n_circuits int"
ENCLOSURES = {
    ("plain", "600x800x250", None, "", "IP30", "", None, None, 8): ("unfolded", "安装板", quotes.COLD, 15.0, 36247), ("type", None, "600x800x250", "", "IP30", "", None, None, 8): ("unfolded", "安装板", quotes.COLD, 15.0, 36247),
    ("steel", "800*1800*600", None, "落地式", "IP55", "304不锈钢室外动力柜，柜内配安装立板及支架", None, None, 12): ("unfolded", "立板+支架", quotes.STEEL_304, 20.0, 578989),
    ("plate", "600x800x250", None, "", "", "箱内装设镀锌安装立板", None, None, 1): ("unfolded", "立板", quotes.COLD, 15.0, 36247), ("thick", "600x800x250", None, "", "", "厚度2.5mm", None, None, 1): ("unknown_material", "安装板", quotes.COLD, 25.0, 0),
    ("stated", "400x300x150", None, "", "", "304", "201不锈钢", "1.5", 1): ("unfolded", "安装板", quotes.STEEL_201, 15.0, 21453), ("few", None, None, "", "IP30", "", None, None, 8): ("circuits", "安装板", quotes.COLD, 12.0, 36000),
    ("floor", None, None, "落地", "IP55", "", None, None, 28): ("circuits", "安装板+支架+封板", quotes.COLD, 20.0, 195750), ("none", None, None, None, None, None, None, None, None): ("circuits", "安装板", quotes.COLD, 12.0, 22000),
}


def test_enclosures(spark):
    out = quotes.enclosure(spark.createDataFrame(list(ENCLOSURES), BOXES)).collect()
    got = {r["code"]: (r["enclosure_basis"], r["structure_used"], r["material_used"], r["thickness_tenths"], r["enclosure"]) for r in out}
    assert got == {k[0]: v for k, v in ENCLOSURES.items()}


@pytest.mark.parametrize("text, want", [("800*600*200", (800, 600, 200)), ("GGD 800×2200×600", (800, 2200, 600)), ("XL-21 800x1800x600", (800, 1800, 600)), ("600x400x400", (600, 400, 400)), ("JXF", None), (None, None)])
def test_dimensions(spark, text, want):
    got = spark.createDataFrame([(text,)], "s string").select(quotes.dimensions(F.col("s")).alias("d")).first()["d"]
    assert (got and tuple(got)) == want


@pytest.mark.parametrize("amps, cabinet, want", [(250, False, ("TM-30x4", 5980, 45747)), (1600, True, ("TM-100x10", 106800, 817020)), (630, True, ("TM-60x6", 38448, 294127)), (160, True, ("TM-25x3", 3740, 28611)), (9000, False, ("TM-100x10", 49840, 381276)), (0, True, ("", 0, 0)), (None, False, ("", 0, 0))])
def test_busbar(spark, amps, cabinet, want):
    assert tuple(spark.range(1).select(quotes.busbar(F.lit(amps).cast("int"), F.lit(800), F.lit(cabinet)).alias("b")).first()["b"]) == want


def priced(spark):
    prices = spark.createDataFrame([], "code string, brand string, category string, model string, remark string, price long")
    return prices, spark.createDataFrame([("MCB-1P-16A", 4800), ("MCB-3P-32A", 21000), ("MCCB-3P-125A", 68000), ("ATS-4P-160A", 390000)], "key string, list_price long"), {}


def test_quotation(spark):
    box = spark.createDataFrame([(1, "AP1", "600x800x250", "IP30"), (1, "AL1", "PZ30", ""), (1, "AE", "", "")], "job int, code string, box_type string, ip_rating string")
    rows = [(1, "AP1", "incoming", "", "进线", "MCCB-3P-125A"), (1, "AP1", "outgoing", "", "照明1", "MCB-C16A/1P"), (1, "AP1", "outgoing", "", "动力1", "MCB-C32A/3P"), (1, "AL1", "outgoing", "", "照明1", "MCB-C16A/1P"), (1, "AL1", "outgoing", "", "照明2", "-"), (1, "XX", "outgoing", "", "", "MCB-C16A/1P")]
    circuits = spark.createDataFrame(rows, "job int, code string, kind string, circuit_no string, load_name string, breaker string")
    parts = spark.createDataFrame([(1, "AP1", "塑壳断路器", "MCCB-3P-125A", 1), (1, "AP1", "微断", "MCB-C16A/1P", 0), (1, "AP1", "微断", "MCB-C32A/3P", 1), (1, "AP1", "电能表", "M1", 2)], "job int, code string, name string, spec string, quantity int")
    quoted = quotes.quotations(box, circuits, parts, *priced(spark), brands=quotes.COMPARED)
    got = {(r["code"], r["brand"]): r for r in quoted.collect()}
    assert len(got) == 9
    r = got["AP1", "正泰"]  # list prices times 55 % (small) or 50 % (moulded) times 58 %
    material = 19720 + 1531 + 6699
    assert (r["material"], r["n_open"], r["main_amps"], r["bar"], r["busbar"], r["enclosure"]) == (material, 1, 125, "TM-25x3", quotes_cost(600, 668), 36247)
    auxiliary, labour = (material * 65 + 500) // 1000, 12000 + 2 * 4500
    before = material + auxiliary + labour + r["busbar"] + r["enclosure"]
    factory = before + (before * 20 + 500) // 1000
    assert (r["auxiliary"], r["labour"], r["factory"], r["final"]) == (auxiliary, labour, factory, (factory * 1080 * 1130 + 500_000) // 1_000_000)
    aux = (material * 167 + 500) // 1000
    assert (r["ab_auxiliary"], r["ab_assembly"]) == (aux, ((material + aux) * 197 + 500) // 1000) and r["ab_total"] == material + r["ab_auxiliary"] + r["ab_assembly"] + r["enclosure"] + r["busbar"]
    assert got["AP1", "施耐德"]["ab_auxiliary"] == (got["AP1", "施耐德"]["material"] * 120 + 500) // 1000
    r = got["AL1", "正泰"]
    assert (r["material"], r["busbar"], r["labour"], r["n_circuits"], r["main_amps"]) == (1531, 0, 9000, 2, None)
    assert (got["AE", "正泰"]["material"], got["AE", "正泰"]["n_circuits"], got["AE", "正泰"]["enclosure"]) == (0, 0, 22000)
    wide = {r["code"]: r for r in quotes.brand_matrix(quoted).collect()}
    a, b = got["AP1", "施耐德"]["final"], got["AP1", "正泰"]["final"]
    assert wide["AP1"]["施耐德"] == a and wide["AP1"]["saving"] == int((a - b) * 1000 / a + 0.5) > 0


def quotes_cost(width, grams):
    tens = (((width + 400) * 3 + (width + 200) * 2) * grams + 5000) // 10000
    return (tens * 7650 + 50) // 100


MODELS = {
    ("微型断路器", "施耐德 iC65N 1P C16A", "正泰"): ("MCB", "施耐德", "NXB-63", "NXB-63 C16/1P", 40, "cost_saving"), ("漏电断路器", "施耐德 iDPN Vigi 1P+N C20A 30mA", "德力西"): ("RCBO", "施耐德", "CDB6LE-63", "CDB6LE-63 C20/1P+N 30mA", None, "missing_price"),
    ("塑壳断路器", "ABB XT1N 160 TMD 100A 3P", "良信"): ("MCCB", "ABB", "NDM1-125S", "NDM1-125S/3300 100A 3P", None, "missing_price"), ("微型断路器", "施耐德 iC65H C32/2P 10kA", "正泰"): ("MCB", "施耐德", "NXB-63H", "NXB-63H C32/2P", None, "missing_price"),
    ("微型断路器", "DZ47-63", "良信"): ("MCB", "通用/国标", "NDB1-63", "NDB1-63系列（待核定电流）", None, "missing_price"), ("交流接触器", "LC1D 9A", "无名"): ("KM", "施耐德", "CJX2s", "CJX2s-09 交流接触器", None, "missing_price"),
    ("浪涌保护器", "40kA 4P", "正泰"): ("SPD", "通用/国标", "NU6-II", "NU6-II/40kA/4P 浪涌保护器", None, "missing_price"), ("电能表", None, "正泰"): ("OTHER", "通用/国标", "", "正泰 优质匹配型号 (电能表)", None, "missing_price"),
}


def test_replacements(spark):
    prices = spark.createDataFrame([("a", "正泰", "小型断路器", "NXB-63 1P C16", "", 2400), ("b", "施耐德", "小型断路器", "iC65N 1P C16A", "", 4000), ("c", "正泰", "小型断路器", "NXB-63 C20/1P", "", 5000), ("d", "施耐德", "小型断路器", "iC65N 1P C20A", "", 4100)], "code string, brand string, category string, model string, remark string, price long")
    devices = spark.createDataFrame([(*k, 2.0, 1) for k in MODELS] + [("微断", "施耐德 iC65N 1P C20A", "正泰", None, 1)], "name string, spec string, target string, quantity double, job int")
    out = replacements.recommend(devices, prices, {"MCB": ["小型断路器"]})
    got = {(r["name"], r["spec"], r["target"]): (r["kind"], r["from_brand"], r["series"], r["model"], r["saving"], r["status"]) for r in out.collect()}
    dearer = got.pop(("微断", "施耐德 iC65N 1P C20A", "正泰"))
    assert got == MODELS and dearer[4:] == (0, "cost_increase")
    assert replacements.replacement_report(out, ["job"]).first().asDict() == {"job": 1, "items": 9, "total": 17.0, "replaceable": 2.0, "dearer": 1.0, "unquoted": 14.0, "saving": 5}
    assert replacements.recommend(devices.where("false"), prices, {}).count() == 0

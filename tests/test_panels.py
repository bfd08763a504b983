"""Panel codes, ranges, brands and categories on literal texts."""

import pytest
from pyspark.sql import functions as F

from loomgrid.functions import panels, specs


def parsed(spark, made, texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(made(F.col("t"))).collect()]


RANGES = {
    "JX1~JX21": [f"JX{i}" for i in range(1, 22)], "1AL1~5": [f"1AL{i}" for i in range(1, 6)], "2AP1-4": ["2AP1", "2AP2", "2AP3", "2AP4"], "1AL1, 1AL2, 2AP1": ["1AL1", "1AL2", "2AP1"],
    "3~10RDAL": [f"{i}RDAL" for i in range(3, 11)], "AW1/2/3/4-CDZ 单相电表箱": ["AW1/2/3/4-CDZ"], "AP1/AP2/AP3": ["AP1", "AP2", "AP3"], "9KX3 排风机控制箱": ["9KX3"],
    "01B-03 动力配电箱系统图(三) JX1~JX3": ["JX1", "JX2", "JX3"], "DQHZ01~DQHZ05": ["DQHZ01", "DQHZ02", "DQHZ03", "DQHZ04", "DQHZ05"], "2AP9 1AL1~2": ["1AL1", "1AL2", "2AP9"],
}
NOISE = [
    "BV-3x2.5-PC20-WC，CC", "WDZ-YJY-5x16-CT/PC50-WC,FC", "分集水器控制面板与接线盒之间预留一根PC20管", "600/5A*3 0.5/10P20", "ATSE-63A", "ATSE-63A/4P", "AC220V", "12~18", "XLP000-25A", "XLP000-25A/3P",
    "SC50", "20A", "C16A/1P", "YJV-4x35", "IP65", "DN65~DN150", "",
]


def test_ranges_and_noise(spark):
    texts = [*RANGES, *NOISE, None]
    got = dict(zip(texts, parsed(spark, panels.panel_range, texts), strict=True))
    assert {t: got[t] for t in RANGES} == RANGES
    assert {t: got[t] for t in [*NOISE, None]} == {t: [] for t in [*NOISE, None]}


def test_codes(spark):
    texts = {
        "2SAL2 照明配电箱": "2SAL2", "AW1 配电箱": "AW1", "消防XFDT-AT": "XFDT-AT", "B1ATPY1": "B1ATPY1", "C01 柜": "C01", "10RDAL:WL1": "10RDAL", "备注：AL1": None, "see 1al1 and 2ap3": "1AL1",
        "380/220V": None, "DC36V": None, "220V": None, "50Hz": None, "4X6A": None, "3X2.5": None, "150kVar": None, "1000kVA": None, "A116": None, "PK306": None, "WL1": None, "N12": None, "2-WP3": None,
        "1AL-WL2": None, "K1-1": None, "D01-C1": None, "L1": None, "L123": None, "09D101-6": None, "LC1-D09C": None, "HND07E3Y/K": None, "RS485": None, "MCB-63/C16A": None, "TMY-4X": None, "40R": None, "AL12345": None, "-AL1": None, None: None,
    }
    assert dict(zip(texts, parsed(spark, panels.first_panel_code, texts), strict=True)) == texts
    assert parsed(spark, panels.panel_codes, ["1AL1、2AP1 1AL1/3AP2 WL1"]) == [["1AL1", "2AP1", "1AL1/3AP2"]]
    assert parsed(spark, panels.feed_code, ["1AL1", " 1 AL 1：WL2", "配电 1AL1", "63A", None]) == ["1AL1", "1AL1", None, None, None]


def test_each_reason_has_a_token(spark):
    tokens = {"123": "no letter", "AL12345": "long number", "09D101": "standard", "AC220V": "quantity", "L123": "phase", "WL1": "circuit", "C16A": "rating", "4X6B": "product", "XPC20Z": "conduit", "BVAL1": "not a panel", "GLAL1": "device", "AB1-D09C": "frame", "HND07E3Y": "sample", "A116": "shape", "1AL1": None}
    assert dict(zip(tokens, parsed(spark, panels.token_fault, tokens), strict=True)) == tokens
    assert {name for name, _, _ in panels.RULES} | {panels.SHAPE} == set(tokens.values()) - {None}
    assert dict(zip(tokens, parsed(spark, panels.is_token_code, tokens), strict=True)) == {t: fault is None for t, fault in tokens.items()}


@pytest.mark.parametrize("parser, texts", [
    (specs.brand, {"iC65N-C16": "施耐德", "Tmax XT2": "ABB", "S203": "ABB", "5SY6": "西门子", "nxb-63": "正泰", "CDB6s": "德力西", "NDM3": "良信", "CM1-100": "常熟开关", "MCB-63": "通用/国标", None: "通用/国标"}),
    (specs.breaker_category, {"MCB-63/C16": "微型断路器", "RCB-63": "剩余电流动作断路器", "MCCB-100": "塑壳断路器", "ATSE-63": "双电源自动转换开关", "DS-50/3P": "隔离开关", "DZ47LE-63/2P": "剩余电流动作断路器", "NM1-125S": "塑壳断路器", "HR17": "隔离开关", "iC65N": "微型断路器", "C63/3P": "微型断路器", "D160": "塑壳断路器", "C63": "微型断路器", "QF1": "断路器（其他）", None: "断路器（其他）"}),
    (specs.rated_amps, {"C63": 63, "D100": 100, "B16": 16, "C16/2P": 16, "/C63/3P": 63, "In=63A": 63, "In: 100A": 100, "63A": 63, "100/3P": 100, "63": 63, "32.5": 32.5, "MCB-63/C16A/1P": 16, "DZ47-63 C10A 1P": 10, "NXB-63-D32A/3P": 32, "Unknown": None, "": None, None: None, "ABC/XYZ": None}),
])
def test_named_and_numbered(spark, parser, texts):
    assert dict(zip(texts, parsed(spark, parser, texts), strict=True)) == texts


def test_breaker_and_cable_parameters(spark):
    b = parsed(spark, specs.breaker, ["iC65N-C16/2P 6kA", "NM1-125S/3300 100A 3P 30mA", "C16A/1P", "C10A", "DZ47-63 C10A 1P", "NXB-63-D32A/3P"])
    assert [(x["manufacturer"], x["series"], x["curve"], x["amps"], x["pole_text"], x["leakage_ma"], x["breaking_ka"]) for x in b] == [
        ("施耐德", "IC65N", "C", 16.0, "2P", None, 6.0), ("正泰", "NM1-125S", None, 100.0, "3P", 30, None), (None, None, "C", 16.0, "1P", None, None), (None, None, "C", 10.0, None, None, None), (None, "DZ47-63", "C", 10.0, "1P", None, None), ("正泰", "NXB-63", "D", 32.0, "3P", None, None)]
    c = parsed(spark, specs.cable, ["WDZ-BYJ-3x2.5+E2.5 -SC20-CC", "ZR-YJV-4x35+1x16 CT", "4 x 25 + 1 x 16", "BV-4mm2"])
    assert [tuple(x) for x in c] == [("WDZ-BYJ", 3, 2.5, 1, 2.5, "SC20-CC"), ("ZR-YJV", 4, 35.0, 1, 16.0, "CT"), (None, 4, 25.0, 1, 16.0, None), ("BV", 1, 4.0, None, None, None)]

"""Boxes, circuits and devices assembled into a bill of material, on literal lists."""

from loomgrid.operators import assembly

BOXES = "job string, ord int, code string, name string, size string, install string, ip_rating string, location string, quantity string, quantity_confirmed boolean"
CIRCUITS = "job string, ord int, box string, circuit_no string, phase string, breaker string, contactor string, ct string, thermal string, load_name string, note string, cable string, power_kw string"
DEVICES = "job string, ord int, name string, spec string, unit string, quantity double, used_in string, note string"


def assembled(spark, boxes, circuits=(), devices=()):
    b = spark.createDataFrame([("j", i, *(r.get(k) for k in ("code", "name", "size", "install", "ip", "location")), r.get("quantity"), r.get("confirmed")) for i, r in enumerate(boxes)], BOXES)
    c = spark.createDataFrame([("j", i, *(r.get(k) for k in ("box", "no", "phase", "breaker", "contactor", "ct", "thermal", "load", "note", "cable", "kw"))) for i, r in enumerate(circuits)], CIRCUITS)
    d = spark.createDataFrame([("j", i, *r) for i, r in enumerate(devices)], DEVICES)
    components, issues, release = assembly.assemble(b, c, d)
    return {(r["name"], r["spec"]): r for r in components.collect()}, sorted(r["text"] for r in issues.collect()), release.first()


def test_boxes_multiply_and_combos_split(spark):
    got, issues, release = assembled(spark, [{"code": "AW1/2/3/4", "quantity": "4"}], [{"box": "AW1/2/3/4", "breaker": "MCB-63/C25A/3P×2+ATSE-63 32A/4P/PC/R", "contactor": "3×145A"}], [("电能表", "M1", "块", 1.0, "AW1/2/3/4 进线侧", None)])
    assert {k: r["quantity"] for k, r in got.items()} == {("配电箱体", "AW1/2/3/4"): 4, ("微型断路器", "MCB-63/C25A/3P"): 8, ("双电源自动转换开关", "ATSE-63 32A/4P/PC/R"): 4, ("交流接触器", "145A"): 12, ("电能表", "M1"): 4}
    assert got["微型断路器", "MCB-63/C25A/3P"]["used_in"] == "AW1/2/3/4 未编号回路" and issues == [] and release["released"] and release["total"] == 4


def test_what_cannot_be_split_stays(spark):
    got, issues, _ = assembled(spark, [{"code": "AL1", "quantity": "2"}], [{"box": "AL1", "breaker": "MCB 1P+N"}, {"box": "AL1", "no": "WL1", "breaker": "MCB-63/C16A/1P+Vigi 30mA"}, {"box": "AL1", "no": "WL2", "breaker": "DZ47LE-63/2P"}, {"box": "AL1", "no": "WL3", "breaker": "CDM1-100/3300"}], [("电气火灾监控探测器", "", None, 1.0, "", None)])
    row = got["微型断路器", "MCB 1P+N"]
    assert row["quantity"] == 2 and assembly.AS_WRITTEN in row["note"] and got["微型断路器", "MCB-63/C16A/1P+Vigi 30mA"]["quantity"] == 2
    assert {s for _, s in got} >= {"DZ47LE-63/2P", "CDM1-100/3300", assembly.NO_SPEC}
    assert [any(x in i for i in issues) for x in ("无法安全拆分", "规格未标注")] == [True, True]


def test_spares_and_unknown_boxes(spark):
    got, issues, _ = assembled(spark, [{"code": "AL1", "confirmed": True}], [{"box": "AL1", "load": "备用"}, {"box": "AL1", "no": "W2", "load": "备用", "breaker": "MCB-63/C16A/3P"}, {"box": "AL1", "no": "W3", "load": "备用照明", "breaker": "MCB-63/C16A/3P"}, {"box": "AL2", "no": "W4", "breaker": "MCB-63/C16A/3P"}])
    assert got["微型断路器", "MCB-63/C16A/3P"]["quantity"] == 2 and got["微型断路器", "MCB-63/C16A/3P"]["note"] == assembly.INSTALLED_SPARE and len(got) == 2
    assert [any(x in i for i in issues) for x in ("不计入采购数量", "箱体 AL2 数量无法确认")] == [True, True]


def test_quantities_places_and_release(spark):
    got, issues, release = assembled(spark, [{"code": "AL01", "quantity": "3", "confirmed": False, "ip": "IP44"}, {"code": "AL02", "quantity": "2", "confirmed": True}], [{"box": "AL01", "breaker": "MCB-63/C16A/1P"}])
    assert got["配电箱体", "AL01"]["quantity"] == 1 and got["配电箱体", "AL01"]["note"] == f"IP44，{assembly.CANDIDATE}" and got["微型断路器", "MCB-63/C16A/1P"]["quantity"] == 1
    assert not release["released"] and release["blocked"] == ["AL01"] and release["reasons"] == [f"AL01：{assembly.UNCONFIRMED}"]
    rows = [{"code": "AL1", "name": "箱", "quantity": "2", "confirmed": True, "location": "一层电井"}, {"code": "AL1", "name": "照明配电箱", "quantity": "2", "location": "二层电井"}, {"code": "控制箱"}, {"code": "PY-1"}, {"code": "", "name": "配电箱"}]
    got, issues, release = assembled(spark, rows)
    assert list(got) == [("配电箱体", "AL1")] and not release["released"] and any("不同安装位置（一层电井 / 二层电井）" in i for i in issues)
    got, _, release = assembled(spark, [{"code": "A1", "quantity": "x", "confirmed": False}, {"code": "A1", "quantity": "5", "confirmed": True}])
    assert got["配电箱体", "A1"]["quantity"] == 5 and release["released"]


def test_repeats(spark):
    same = {"box": "AL1", "no": "W1", "phase": "L1", "breaker": "MCB-63/C16A/1P", "load": "灯"}
    got, issues, _ = assembled(spark, [{"code": "AL1"}], [same, dict(same), dict(same, no=""), dict(same, no="")], [("表", "M", "块", 1.0, "AL1", ""), ("表", "M", "块", 1.0, "AL1", "")])
    assert got["微型断路器", "MCB-63/C16A/1P"]["quantity"] == 3 and got["表", "M"]["quantity"] == 1
    assert issues == ["疑似重复回路 AL1 W1（断路器 MCB-63/C16A/1P）已去重保留一条，请核对"]

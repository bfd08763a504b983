"""Named checks on literal lists."""

from loomgrid.operators import checks
from loomgrid.plans.queries import QUERIES

BOXES, COMPONENTS = "job string, code string, quantity long", "job string, ord long, name string, spec string, unit string, quantity double"
CIRCUITS = "job string, ord long, box string, circuit_no string, phase string, breaker string, power_kw string, load_name string"


def found(spark, boxes=(), circuits=(), components=()):
    b = spark.createDataFrame([("j", *r) for r in boxes], BOXES)
    c = spark.createDataFrame([("j", i, *r) for i, r in enumerate(circuits)], CIRCUITS)
    p = spark.createDataFrame([("j", i, *r) for i, r in enumerate(components)], COMPONENTS)
    return sorted((r["rule_code"], r["detail"]) for r in checks.all_findings(b, c, p).collect())


def test_counts_times_boxes(spark):
    got = found(spark, [("AL1", 4)], [("AL1", "1", "", "MCB-63/C16A/1P", "", ""), ("AL1", "2", "", "QF1+QF2", "", "")], [("微型断路器", "mcb-63 /C16A/1P", "只", 3.0)])
    assert got == [("BREAKER_COUNT_MISMATCH", "断路器 MCB-63/C16A/1P：回路逐条计数 4 只，元器件汇总 3 只，请核对")]
    assert found(spark, [("A", 1)], [("A", "1", "L1", "DS-50/3P", "", ""), ("A", "2", "", "MCB-63/C16A/1P", "", "")], [("隔离开关", "DS-50/3P", "只", 1.0), ("微型断路器", "MCB-63/C16A/1P", "只", 1.0)]) == []


def test_references_and_quantities(spark):
    got = found(spark, [("AL1", 1), ("", 0)], [("AL2", "1", "L9", "", "", "")], [("", "M1", "箱", 0.0), ("表", "", None, float("nan")), ("x", "", "只", None)])
    assert [code for code, _ in got] == ["BOX_NOT_FOUND", "BOX_QTY_INVALID", "COMPONENT_QTY_INVALID", "COMPONENT_QTY_INVALID", "COMPONENT_QTY_INVALID", "COMPONENT_UNIT_SUSPECT", "PHASE_INVALID"]
    assert got[0][1] == "第 1 条回路引用箱体 AL2，箱体清单中未找到，请核对" and got[1][1] == "箱体 (未编号) 数量为 0，请核对"


def test_loads_and_cascades(spark):
    loads = [("AL1", "1", "L1", "", "3kW", ""), ("AL1", "2", "L2", "", "2.0", ""), ("AL1", "3", "l3", "", "2", ""), ("AL1", "4", "3P", "", "Pe=3kW", ""), ("AL2", "5", "L1", "", "9", "")]
    assert [d for c, d in found(spark, [("AL1", 1), ("AL2", 1)], loads) if c == "PHASE_UNBALANCE"] == ["三相负荷平衡核验（AL1）：L1=4.0kW, L2=3.0kW, L3=3.0kW，三相负荷不平衡度达 25.0%（超出国标15%限值），存在偏载风险，请核对配电分配"]
    rows = [("AL1", "进线", "", "MCCB-100A/3P", "", ""), ("AL1", "W1", "", "C125A", "", ""), ("AL1", "W2", "", "C63", "", ""), ("", "", "", "C200", "", "")]
    got = [d for c, d in found(spark, [("AL1", 1)], rows) if c == "CASCADE_OVERCURRENT"]
    assert got == ["开关级配核验（AL1）：出线 W1 额定电流 125A（C125A）大于进线主开关 100A，存在越级跳闸风险，请核对图纸"]


def test_evidence(spark):
    evidence = spark.createDataFrame([("j", "box.location.AL1", "MODEL", "model_vision"), ("j", "circuit.AL1.W1.breaker", "TEXT", "cad_native"), ("j", "e3", "TEXT", "model_vision")], "job string, evidence_id string, evidence_type string, origin string")
    policy = spark.createDataFrame([("box.location", ["TEXT", "TABLE_CELL"]), ("box.code", ["TEXT"])], "field_path string, allowed array<string>")
    claims = spark.createDataFrame([("j", "a", ["e3"], "CONFIRMED"), ("j", "b", ["circuit.AL1.W1.breaker", "e3"], "CONFIRMED"), ("j", "c", [], "CONFIRMED"), ("j", "d", ["e3"], "PARSED_OK")], "job string, field_path string, value_evidence_ids array<string>, review_status string")
    got = sorted((r["rule_code"], r["target"]) for r in checks.evidence_findings(evidence, claims, policy).collect())
    assert got == [("EVIDENCE_POLICY_VIOLATION", "box.location"), ("EVIDENCE_STATUS_MISMATCH", "a"), ("EVIDENCE_STATUS_MISMATCH", "c")]


def test_catalogue_severities(spark):
    items = spark.createDataFrame([("j", "S", d, s, [f"P{i}" for i in range(n)]) for d, s, n in (("system", "MISSING", 7), ("system", "PARTIAL", 2), ("plan", "MISSING", 1), ("plan", "PARTIAL", 1), ("plan", "COVERED", 0))], "job string, sheet_title string, deficit string, status string, missing array<string>")
    got = sorted((r["severity"], r["rule_code"]) for r in checks.catalogue_findings(items).collect())
    assert got == [("ERROR", "CATALOG_RANGE_MISSING"), ("INFO", "CATALOG_RANGE_PARTIAL"), ("WARNING", "CATALOG_RANGE_PARTIAL"), ("WARNING", "CATALOG_RANGE_PARTIAL")]
    assert [r["detail"] for r in checks.catalogue_findings(items).where("severity = 'ERROR'").collect()] == ["【范围缺失】《S》[P0, P1, P2, P3, P4 等共 7 台]"]


def test_coverage_of_parts_with_large_keys(spark, tmp_path):
    spark.createDataFrame([(499_999,), (500_000,), (1_234_567,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(500_001, "A"), (500_003, "N"), (1_234_571, "A"), (1_234_568, "A"), (1_234_569, "A"), (1_234_570, "A")], "l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in QUERIES["reconcile_coverage"](spark, str(tmp_path)).select("item", "n_declared", "n_matched", "missing", "status").collect())
    assert got == [(499_999, 4, 0, "999JXA500,999JXA501,999JXA502,999JXA503", "MISSING"), (500_000, 4, 1, "1000JXA2,1000JXA3,1000JXA4", "PARTIAL"), (1_234_567, 4, 4, "", "COVERED")]

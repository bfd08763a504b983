"""Distribution trees on literal box and circuit lists."""

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import topology

BOXES, CIRCUITS = "job string, ord long, code string, name string, note string", "job string, ord long, box string, circuit_no string, load_name string, note string, secondary_ref string, power_kw string"


def tree(spark, boxes, circuits):
    b = spark.createDataFrame([("j", i, *r) for i, r in enumerate(boxes)], BOXES)
    c = spark.createDataFrame([("j", i, *r) for i, r in enumerate(circuits)], CIRCUITS)
    return topology.distribution_tree(b, c).orderBy("path").collect()


def test_feeders_and_control_drawings(spark):
    got = tree(spark, [("01AL2-2", "潜水泵控制原理图", None), ("01AL2", "潜水泵动力箱", None), ("01AL1", "一层照明箱", ""), ("01ALZ1", "动力总柜", "")], [("01ALZ1", "WL1", "至01AL1照明箱", None, None, "3kW"), ("01ALZ1", "WP1", "送01AL2动力箱", "", "", "Pe=1.25kW x 2"), ("01AL1", "WL1-1", "走廊照明", "", "", ""), ("01AL2", "WP2-1", "1#潜水泵", "", "01AL2-2", "x"), ("01AL2", "WP2-2", "备用泵", "", "D-7", "7.5")])
    assert [(r["code"], r["type"], r["parent"], r["feed"], r["circuits"], r["depth"], r["virtual"]) for r in got] == [
        ("01ALZ1", "cabinet", "", "", 2, 0, False), ("01AL1", "box", "01ALZ1", "WL1", 1, 1, False), ("01AL2", "box", "01ALZ1", "WP1", 2, 1, False), ("01AL2-2", "secondary", "01AL2", "", 0, 2, False), ("D-7", "secondary", "01AL2", "WP2-2", 0, 2, True)]
    assert [str(r["kw"]) for r in got] == ["4.3", "None", "7.5", "None", "7.5"] and got[4]["name"] == "备用泵 控制原理图"


def test_upstream_named_and_not(spark):
    got = {r["code"]: r for r in tree(spark, [("00AL01", "道路照明配电箱", ""), ("01LBZ3", "配电箱", ""), ("1AL1", "照明配电箱", "进线详上级配电箱系统图"), ("2AL1", "照明配电箱", "")], [("00AL01", "N11", "室外景观照明预留", "由01LBZ3引来", "", ""), ("1AL1", "进线", "进线", "进线详上级配电箱系统图", "", ""), ("2AL1", "WL1", "走廊照明", "", "", "")])}
    assert (got["00AL01"]["parent"], got["00AL01"]["feed"], got["01LBZ3"]["parent"], got["01LBZ3"]["type"]) == ("01LBZ3", "N11", "", "box")
    assert [topology.NO_UPSTREAM in got[c]["note"] for c in ("00AL01", "1AL1", "2AL1")] == [False, True, False]


def test_first_claim_cycles_and_dangling_boxes(spark):
    got = tree(spark, [("AP1", "箱", ""), ("AP10", "箱", ""), ("AP2", "箱", ""), ("AP3", "箱", ""), ("AP4", "箱", "")], [("AP1", "1", "AP10 配电箱", "", "", ""), ("AP2", "2", "供AP10", "", "", ""), ("AP3", "3", "AP4", "", "", ""), ("AP4", "4", "AP3", "", "", ""), ("GHOST", "5", "AP2", "", "", "")])
    assert [(r["code"], r["parent"], r["type"], r["virtual"]) for r in got] == [("AP1", "", "cabinet", False), ("AP10", "AP1", "box", False), ("GHOST", "", "cabinet", True), ("AP2", "GHOST", "box", False)]


@pytest.mark.parametrize("code, name, want", [("3GGD2", "x", "cabinet"), ("1ALZ", "x", "cabinet"), ("AL1", "低压配电屏", "cabinet"), ("AL1", "总箱二次接线", "secondary"), ("AL1", "箱", "box")])
def test_types(spark, code, name, want):
    assert spark.range(1).select(topology.box_type(F.lit(code), F.lit(name))).first()[0] == want


def test_nothing_in(spark):
    assert tree(spark, [], []) == []

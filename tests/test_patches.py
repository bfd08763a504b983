"""Edits on literal lists: every reason, and what the accepted ones leave."""

from loomgrid.operators import patches

CIRCUITS = "job string, ord int, box string, circuit_no string, phase string, breaker string, cable string, power_kw string, load_name string"
BOXES = "job string, code string, name string, ip_rating string, install string, location string, size string, quantity int, note string"
DEVICES = "job string, name string, spec string, unit string, quantity double, used_in string, note string"
EDITS = [
    ("circuit", "", "WL1", "breaker", " C20 ", None, "C20"), ("", None, "灯", "cable", "BV-4", None, "BV-4"), ("circuit", "", "", "breaker", "x", "no_target", None), ("circuit", "", "WL9", "breaker", "x", "ambiguous_number", None), ("circuit", "", "备用", "breaker", "x", "ambiguous_name", None),
    ("circuit", "", "nothing", "breaker", "x", "unknown_circuit", None), ("circuit", "", "WL1", "box", "x", "field", None), ("circuit", "", "WL1", "breaker", " ", "empty", None), ("circuit", "", "WL1", "phase", "L1", "unchanged", None), ("circuit", "", "WL1", "breaker", "C25", None, "C25"),
    ("box", "", "AL1", "quantity", "3.0", None, "3"), ("box", "", "AL1", "quantity", "many", "not_a_number", None), ("box", "", "AL1", "quantity", "-1", "not_a_number", None), ("box", "", "AL1", "code", "AL2", "code_is_fixed", None), ("box", "", "AL9", "name", "x", "unknown_box", None),
    ("device", "add", "浪涌", "", "SPD", None, "SPD"), ("device", "add", "电表", "", "x", "exists", None), ("device", "add", "", "", "x", "no_name", None), ("device", "remove", "旧|R1", "", "", None, None), ("device", "remove", "none", "", "", "unknown_device", None), ("device", "", "电表", "quantity", "2.5", None, "2.5"),
]


def lists(spark):
    c = [("j", 0, "AL1", "WL1", "L1", "C16", "BV-2.5", "1", "灯"), ("j", 1, "AL1", "WL9", "", "", "", "", "备用"), ("j", 2, "AL1", "WL9", "", "", "", "", "备用"), ("k", 0, "AL1", "WL1", "L3", "C16", "", "", "别")]
    return spark.createDataFrame(c, CIRCUITS), spark.createDataFrame([("j", "AL1", "箱", "", "", "", "", 1, None)], BOXES), spark.createDataFrame([("j", "电表", "M1", "块", 1.0, "", ""), ("j", "旧", "R1", "套", 1.0, "", "")], DEVICES)


def test_judged_and_applied(spark):
    c, b, d = lists(spark)
    patch = spark.createDataFrame([("j", n, *e[:5]) for n, e in enumerate(EDITS)], "job string, n int, kind string, action string, target string, field string, value string")
    judged = patches.judge(patch, c, b, d)
    assert [(r["reason"], r["new"]) for r in judged.orderBy("n").collect()] == [e[5:] for e in EDITS]
    circuits, boxes, devices = patches.apply(judged, c, b, d)
    assert [(r["job"], r["ord"], r["breaker"], r["cable"], r["phase"]) for r in circuits.orderBy("job", "ord").collect()] == [("j", 0, "C25", "BV-4", "L1"), ("j", 1, "", "", ""), ("j", 2, "", "", ""), ("k", 0, "C16", "", "L3")]
    assert [(r["quantity"], r["name"], r["note"]) for r in boxes.collect()] == [(3, "箱", None)]
    assert sorted((r["name"], r["spec"], r["unit"], r["quantity"]) for r in devices.collect()) == [("浪涌", "SPD", "套", 1.0), ("电表", "M1", "块", 2.5)]


def test_no_edits(spark):
    c, b, d = lists(spark)
    none = spark.createDataFrame([], "job string, n int, kind string, action string, target string, field string, value string")
    assert [x.count() for x in patches.apply(patches.judge(none, c, b, d), c, b, d)] == [4, 1, 2]


def test_allowed_columns(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, note string, name string")
    changes = spark.createDataFrame([(1, "A", "no"), (2, None, "no"), (3, "C", "no")], "id int, note string, name string")
    assert sorted(tuple(r) for r in patches.patch_columns(rows, changes, "id", ["note", "status"]).collect()) == [(1, "A", "x"), (2, "b", "y")]

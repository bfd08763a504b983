"""Nested blocks, risers and scores on literal rows."""

from pyspark.sql import functions as F

from loomgrid.operators import drawings
from loomgrid.sources import dxf

TEXTS, INSERTS = "block string, id int, x double, y double", "insert_id string, owner string, block string, x double, y double, sx double, sy double, deg double, bx double, by double"


def inserts(spark, rows):
    return spark.createDataFrame(rows, INSERTS).select("insert_id", "owner", "block", drawings.insert_matrix(*(F.col(c) for c in ("x", "y", "sx", "sy", "deg", "bx", "by"))).alias("m")).select("insert_id", "owner", "block", "m.*")


def test_nested_inserts_are_composed(spark):
    texts = spark.createDataFrame([("A", 1, 1.0, 2.0), ("B", 2, 0.0, 1.0), ("C", 3, 1.0, 0.0), ("unused", 4, 0.0, 0.0)], TEXTS)
    ins = inserts(spark, [("b1", "A", "B", 10.0, 0.0, 2.0, 2.0, 90.0, None, None), ("c1", "B", "C", 0.0, 5.0, None, None, None, 1.0, 0.0), ("m1", None, "A", 100.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0), ("m2", None, "A", 0.0, 0.0, -1.0, 1.0, 180.0, 0.0, 0.0)])
    got = sorted((r["id"], "/".join(r["path"]), round(r["x"], 6), round(r["y"], 6)) for r in drawings.explode_blocks(texts, ins).collect())
    assert got == [(1, "m1", 101.0, 2.0), (1, "m2", 1.0, -2.0), (2, "m1/b1", 108.0, 0.0), (2, "m2/b1", 8.0, 0.0), (3, "m1/b1/c1", 100.0, 0.0), (3, "m2/b1/c1", 0.0, 0.0)]


def test_cycles_and_depth(spark):
    texts = spark.createDataFrame([("B0", 0, 0.0, 0.0), *((f"B{i}", i, 0.0, 0.0) for i in range(1, 8))], TEXTS)
    chain = [(f"i{i}", f"B{i - 1}", f"B{i}", 1.0, 0.0, None, None, None, None, None) for i in range(1, 8)] + [("back", "B1", "B0", 0.0, 0.0, None, None, None, None, None), ("m", None, "B0", 0.0, 0.0, None, None, None, None, None)]
    got = sorted((r["id"], r["x"]) for r in drawings.explode_blocks(texts, inserts(spark, chain)).collect())
    assert got == [(i, float(i)) for i in range(5)]


def test_block_bounds(spark):
    bounds = spark.createDataFrame([("A", 0.0, 0.0, 1.0, 1.0), ("B", 0.0, 0.0, 4.0, 2.0), ("B", 1.0, -1.0, 2.0, 0.0)], "block string, x0 double, y0 double, x1 double, y1 double")
    got = {r["block"]: tuple(round(r[c], 6) for c in ("x0", "y0", "x1", "y1")) for r in drawings.block_bounds(bounds, inserts(spark, [("i", "A", "B", 10.0, 0.0, 1.0, 1.0, 90.0, None, None)])).collect()}
    assert got == {"A": (0.0, 0.0, 11.0, 4.0), "B": (0.0, -1.0, 4.0, 2.0)}


def test_risers(spark):
    column = [(c, 500.0, float(y)) for c, y in zip(("1RDAL", "3RDAL", "4RDAL", "5RDAL", "6RDAL"), (1000, 840, 760, 680, 600), strict=True)]
    others = [("9KX3", 2000.0, 1000.0), *((f"AL{i}", 900.0, float(y)) for i, y in enumerate((0, 80, 300, 380, 460))), *((f"AP{i % 3}", 1400.0, 80.0 * i) for i in range(6)), *((f"AT{i}", 1700.0 + 15 * i, 90.0 * i) for i in range(8)), ("AT8", 1700.0, 1.0)]
    df = spark.createDataFrame([("d", *r, 10.0) for r in column + others] + [("e", *r, 10.0) for r in column[:3]], "k string, code string, x double, y double, h double")
    got = {r["code"] for r in drawings.risers(df, ["k"], "code", "x", "y", "h").collect()}
    assert got == {c for c, _, _ in column}


def test_steps():
    gaps = [(10.0, 10.0), (20.0, 10.0), (13.4, 10.0), (13.6, 10.0), (30.0, 10.0), (3.0, 10.0), (5.0, 0.0), (25.0, 10.0)]
    assert [drawings.step_matches(g, s, 0.35) for g, s in gaps] == [True, True, True, False, False, False, False, False]


ROWS = "d string, i int, number string, box string, kw string"
GOLD = [("a", 1, "WL1", "2 SAL2", "3"), ("a", 2, "WL2", "2SAL2", "4"), ("a", 3, "", "2SAL2", "5"), ("a", 4, None, "2SAL2", "6"), ("a", 5, "WX1", "2SAL2", "1")]


def test_scores(spark):
    gold = spark.createDataFrame(GOLD, ROWS)
    perfect = drawings.score_rows(gold, gold, "d", "i", "number", "box", ["kw"]).first().asDict()
    assert {k: perfect[k] for k in ("gold", "split", "content", "extra", "content_recall", "content_precision")} == {"gold": 5, "split": 5, "content": 5, "extra": 0, "content_recall": 1.0, "content_precision": 1.0}
    said = spark.createDataFrame([("a", 10, "wl 1", "2sal2", "9"), ("a", 11, "WX1", "2SAL3", "1"), ("a", 12, "", "2SAL2", "5"), ("a", 13, "", "2SAL9", "6"), ("b", 14, "x", "y", "z")], ROWS)
    assert sorted(tuple(r) for r in drawings.match_rows(gold, said, "d", "i", "number", "box").collect()) == [("a", 1, 10, 1), ("a", 3, 12, 3), ("a", 5, 11, 2)]
    r = {x["d"]: x for x in drawings.score_rows(gold, said, "d", "i", "number", "box", ["kw"]).collect()}
    assert (r["a"]["split"], r["a"]["content"], r["a"]["extra"], r["a"]["split_recall"], r["a"]["content_precision"]) == (2, 1, 1, 0.4, 0.5)
    assert (r["b"]["gold"], r["b"]["extra"], r["b"]["split_recall"], r["b"]["split_precision"]) == (0, 1, 1.0, 0.0)


def test_a_row_taken_early_is_gone(spark):
    gold = spark.createDataFrame([("a", 1, "W1", "X", ""), ("a", 2, "W1", "Y", "")], ROWS)
    said = spark.createDataFrame([("a", 7, "W1", "Y", "")], ROWS)
    assert [tuple(r) for r in drawings.match_rows(gold, said, "d", "i", "number", "box").collect()] == [("a", 1, 7, 2)]


def test_texts_of_a_drawing_with_nested_blocks(spark, tmp_path):
    text = lambda x, y, t: [(0, "TEXT"), (5, f"T{t}"), (8, "L"), (10, x), (20, y), (40, 3), (1, t)]
    insert = lambda name, handle, x, y, sx=1, deg=0: [(0, "INSERT"), (5, handle), (2, name), (10, x), (20, y), (41, sx), (42, sx), (50, deg)]
    block = lambda name, bx, by, *inner: [(0, "BLOCK"), (2, name), (10, bx), (20, by), *(p for i in inner for p in i), (0, "ENDBLK")]
    pairs = [(0, "SECTION"), (2, "BLOCKS"), *block("IN", 1, 1, text(2, 1, "%%065L1")), *block("OUT", 0, 0, text(0, 0, "o"), insert("IN", "a", 10, 0, 2, 90)), (0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES"), *text(5, 5, "%%c20 a%%176"), *insert("OUT", "b", 100, 0), *insert("OUT", "c", 0, 50, 2), *insert("LOST", "d", 0, 0), (0, "ENDSEC"), (0, "EOF")]
    (tmp_path / "a.dxf").write_text("\n".join(f"{c}\n{v}" for c, v in pairs))
    got = sorted((r["text"], "/".join(r["insert_path"]), round(r["x"], 6), round(r["y"], 6)) for r in dxf.drawing_texts(spark, str(tmp_path)).collect())
    assert got == [("AL1", "OUT@b/IN@a", 110.0, 2.0), ("AL1", "OUT@c/IN@a", 20.0, 54.0), ("o", "OUT@b", 100.0, 0.0), ("o", "OUT@c", 0.0, 50.0), ("Ø20 a°", "", 5.0, 5.0)]
    assert [r["text"] for r in dxf.text_entities(spark, str(tmp_path)).collect()] == ["Ø20 a°"]
    files = dxf.drawing_files(spark, str(tmp_path)).collect()
    assert len(files) == 1 and files[0]["sound"] and len(files[0]["sha256"]) == 64


def test_equal_devices_are_counted_before_they_are_read(spark):
    from loomgrid.plans.queries import QUERIES

    plan = QUERIES["brands_and_breakers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2

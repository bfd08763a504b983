"""Operators on small literal tables."""

import time

from pyspark.sql import functions as F

from loomgrid.functions import columns as C
from loomgrid.functions import panels, specs
from loomgrid.operators import bom, hierarchy, rules, spatial, store
from loomgrid.sources import dxf
from loomgrid.streaming import ledger


def values(df):
    return sorted(tuple(r) for r in df.collect())


def parsed(spark, parser, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(parser(F.col("t"))).collect()]


def test_devices(spark):
    got = parsed(spark, specs.devices, ["3xMCB", "MCB X3", "MCB-63/C25A/3P", "A＋B", "0×A", "MCB-1+VM", "", None, "3*A", "MCB+MCB"])
    pairs = [None if x is None else [tuple(y) for y in x] for x in got]
    assert pairs == [[("MCB", 3)], [("MCB", 3)], [("MCB-63/C25A/3P", 1)], None, None, [("MCB-1+VM", 1)], [], None, [("A", 3)], None]
    both = parsed(spark, lambda c: specs.devices(c, combos=True), ["3×MCB+RCB×2", "MCB++RCB"])
    assert [tuple(x) for x in both[0]] == [("MCB", 3), ("RCB", 2)] and both[1] is None


def test_breakers(spark):
    texts = {
        "MCB-63/C25A/3P": ("MCB-63", "C", 25.0, "3P", None), "NXB-63 C 16/1P+N 30mA": ("NXB-63", "C", 16.0, "1P+N", 30), "In: 100A": ("100A", None, 100.0, None, None), "100/3P": (None, None, 100.0, "3P", None),
        "D32A/3P": (None, "D", 32.0, "3P", None), "动力型 63A": ("63A", "D", 63.0, None, None), "照明型": (None, "C", None, None, None), "NM1-125S/3300": ("NM1-125S", None, None, "3P", None), "iC65N-C16/2P": ("IC65N", "C", 16.0, "2P", None), "": (None,) * 5,
    }
    got = parsed(spark, specs.breaker, texts)
    assert {t: (b["series"], b["curve"], b["amps"], b["pole_text"], b["leakage_ma"]) for t, b in zip(texts, got, strict=True)} == texts
    assert parsed(spark, specs.rated_amps, ["C63", "C16A/1P", "63A", "In=63A", "x", None]) == [63.0, 16.0, 63.0, 63.0, None, None]


def test_cables(spark):
    texts = {
        "3x2.5+E2.5": (None, 3, 2.5, 1, 2.5, None), "BV-2.5": ("BV", 1, 2.5, None, None, None), "YJV-4x35+1x16-SC50/FC": ("YJV", 4, 35.0, 1, 16.0, "SC50/FC"),
        "WDZ-BYJ-3*16+2*10": ("WDZ-BYJ", 3, 16.0, 2, 10.0, None), "5×6": (None, 5, 6.0, None, None, None), "": (None,) * 6,
    }
    assert {t: tuple(c) for t, c in zip(texts, parsed(spark, specs.cable, texts), strict=True)} == texts


def test_ranges(spark):
    texts = {
        "JX1~JX3": ["JX1", "JX2", "JX3"], "1AL1~3": ["1AL1", "1AL2", "1AL3"], "AP08-10": ["AP08", "AP09", "AP10"], "1AL1, 1AL2, 2AP1": ["1AL1", "1AL2", "2AP1"], "3~5RDAL": ["3RDAL", "4RDAL", "5RDAL"],
        "1AL1至3": ["1AL1", "1AL2", "1AL3"], "AP01–03": ["AP01", "AP02", "AP03"], "JX1~JX2、JX5 ~ JX6": ["JX1", "JX2", "JX5", "JX6"], "12-13": [], "JX5~JX2": ["JX5", "JX2"], "JX2~JX2": ["JX2"], "plain": [], "AP1/AP2/AP3": ["AP1", "AP2", "AP3"], "DN65": [], "": [],
    }
    assert dict(zip(texts, parsed(spark, panels.panel_range, texts), strict=True)) == texts
    assert len(parsed(spark, panels.panel_range, ["JXA1~JXA151"])[0]) == 151 and len(parsed(spark, panels.panel_range, ["JXA1~JXA152"])[0]) == 2


def test_contained_claims_of_any_length(spark):
    claims = spark.createDataFrame([(1, ""), (2, "b"), (3, "the quick brown fox"), (4, None), (5, "quick brown"), (6, "zz")], "c int, claim string")
    corpus = spark.createDataFrame([(1, "see the quick brown fox run"), (2, "b"), (3, None), (4, ""), (5, "quick brow")], "t int, text string")
    want = [(2, 1), (2, 2), (2, 5), (3, 1), (5, 1)]
    assert values(rules.contained(claims, corpus, "claim", "text", "c", "t")) == want


def test_claims_in_a_long_text(spark):
    text = "".join(f"{i:x}, " for i in range(200_000)) + "\u4e2d\u6587 end of it"
    claims = spark.createDataFrame([(1, text[700_000:700_040]), (2, text[-9:]), (3, text[500_001:500_012]), (4, text[-40:]), (5, "not in this text, whatever one does")], "c int, claim string")
    corpus = spark.createDataFrame([(1, text)], "t int, text string")
    began = time.time()
    assert values(rules.contained(claims, corpus, "claim", "text", "c", "t")) == [(1, 1), (2, 1), (3, 1), (4, 1)]
    assert len(text) > 1_300_000 and time.time() - began < 30


def test_size_issue_and_forms(spark):
    df = spark.createDataFrame([("600x200*800", "箱A：数量不明 [WARNING]", " a－b "), ("600x800", "no head", None)], "s string, i string, c string")
    r = df.select(specs.box_size(F.col("s")).alias("s"), specs.issue(F.col("i")).alias("i"), C.code_of(F.col("c")).alias("c")).collect()
    assert tuple(r[0]["s"]) == (600.0, 800.0, 200.0) and r[1]["s"] is None
    assert tuple(r[0]["i"]) == ("箱A", "数量不明", "WARNING", False) and tuple(r[1]["i"]) == ("", "no head", "", False)
    assert r[0]["c"] == "A－B" and r[1]["c"] == ""


def test_rollup_keeps_order_and_nulls(spark):
    df = spark.createDataFrame([(2, "a", 1, "y"), (1, "a", 2, "x"), (3, "a", 1, "y"), (4, None, 5, "")], "o int, k string, q int, u string")
    assert values(bom.rollup_bom(df.where("k IS NOT NULL"), ["k"], F.col("q"), {"uses": "u"}, F.col("o"))) == [("a", 4, "x、y")]
    assert values(bom.rollup_bom(df.where("k IS NULL"), ["k"], F.col("q"), {"uses": "u"}, F.col("o"))) == [(None, 5, "")]


def test_sightings_fold(spark):
    df = spark.createDataFrame([("c", 1, 0.0, 10.0), ("c", 2, 4.0, 14.0), ("c", 3, 9.0, 19.0), ("d", 4, 0.0, 1.0)], "k string, o int, lo double, hi double")
    assert values(bom.merge_sightings(df, ["k"], "lo", "hi", F.col("o"))) == [("c", 1, 0.0, 10.0), ("c", 3, 9.0, 19.0), ("d", 4, 0.0, 1.0)]


def test_tree_leaves_cycles_out(spark):
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "node string, parent string")
    assert values(hierarchy.tree_paths(edges).select("node", "depth")) == [("a", 0), ("b", 1), ("c", 2)]


def test_anchored_rows(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (1, 2, 9.5), (1, 3, 9.0), (1, 4, 8.9)], "page int, o int, y double")
    assert values(spatial.anchored_rows(df, ["page"], "y", 1.0, "o").select("o", "row")) == [(1, 1), (2, 1), (3, 1), (4, 2)]


def test_both_ways_of_containment_agree(spark):
    claims = spark.createDataFrame([(1, "needle in the hay"), (2, "another one here")], "i int, c string")
    texts = spark.createDataFrame([(1, "a needle in the haystack"), (2, "nothing"), (3, "x another one here x needle in the hay")], "d int, t string")
    near = values(rules.contained(claims, texts, "c", "t", "i", "d"))
    assert near == values(rules.contained(claims, texts, "c", "t", "i", "d", anchor=3)) == [(1, 1), (1, 3), (2, 3)]


def test_dxf_texts(spark, tmp_path):
    pairs = [(0, "SECTION"), (0, "TEXT"), (8, "L"), (10, "1.5"), (20, "2"), (40, "3"), (1, "%%c20"), (0, "MTEXT"), (8, "L"), (10, "0"), (20, "9"), (40, "3"), (1, "{\\fArial;AL1}"), (0, "EOF")]
    (tmp_path / "a.dxf").write_text("\n".join(f"{c}\n{v}" for c, v in pairs))
    rows = dxf.text_entities(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["ord"], r["text"]) for r in rows] == [(1, "AL1"), (2, "Ø20")]


def test_stream_matches_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id*7) AS ts, concat('t', id % 2) AS kind, id AS v FROM range(200)")
    df.write.parquet(src)
    stream = ledger.tumbling(ledger.read_events(spark, src, "ts timestamp, kind string, v long"), "ts", "1 hour", ["kind"], F.col("v"))
    ledger.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = values(spark.read.parquet(str(tmp_path / "out")))
    want = values(df.groupBy(F.window("ts", "1 hour"), "kind").agg(F.count("*").alias("calls"), F.sum("v").alias("amount")).select("window.start", "kind", "calls", "amount"))
    assert got and set(got) <= set(want)


def test_drained_streams_in_many_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.sql("SELECT id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id*7) AS ts, concat('t', id % 3) AS kind, id AS v FROM range(300)")
    for i in range(4):
        df.where(f"id div 75 = {i}").coalesce(1).write.parquet(f"{src}/{i}.parquet")
    stream = lambda: spark.readStream.schema("id long, ts timestamp, kind string, v long").option("maxFilesPerTrigger", 1).parquet(f"{src}/*.parquet")
    got = ledger.drain(ledger.tumbling(stream(), "ts", "10 minutes", ["kind"], F.col("v")), ["window_start", "kind"])
    want = df.groupBy(F.window("ts", "10 minutes"), "kind").agg(F.count("*").alias("calls"), F.sum("v").alias("amount")).select("window.start", "kind", "calls", "amount")
    assert values(got) == values(want)
    whole = ledger.drain(ledger.sessions(stream(), "ts", "30 minutes", ["kind"], F.col("v")), ["kind"], "complete")
    assert values(whole.select("kind", "calls", "amount")) == values(df.groupBy("kind").agg(F.count("*"), F.sum("v")))
    assert ledger.drain(stream().where("id < 0").select("id"), ["id"]).count() == 0


def test_job_states_and_recovery(spark, tmp_path):
    steps = ["queued", "rendering", "converting", "rendering", "extracting", "building_excel", "done", "failed", "queued", "failed"]
    rows = [(i, 1, s) for i, s in enumerate(steps)] + [(50, 2, "done"), (51, 2, "queued"), (52, 2, "converting")]
    df = spark.createDataFrame(rows, "id long, job long, status string").withColumn("ts", F.timestamp_seconds("id"))
    for i, cond in enumerate(("id < 4", "id >= 4 AND id < 9", "id >= 9")):
        df.where(cond).coalesce(1).write.parquet(f"{tmp_path}/in/{i}.parquet")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    got = ledger.drain(ledger.job_states(stream, "job", "ts", "id", "status"), ["job"])
    assert values(got) == [(1, "failed", 8, 2), (2, "converting", 2, 1)]
    again = store.mark_interrupted(got, "status", ledger.IN_FLIGHT)
    assert values(again.select("job", "status")) == [(1, "failed"), (2, "interrupted")]


def test_equal_texts_are_parsed_once(spark):
    from loomgrid.functions import specs
    from loomgrid.sources.staged import parsed_once

    df = spark.createDataFrame([(i, ["MCB-63/C16A/2P", "MCB-63/D20A/3P", None][i % 3]) for i in range(30)], "i int, t string")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        calls.add(1)
        return (t or "").lower()

    assert sorted(tuple(r) for r in parsed_once(df, F.col("t"), counted, "low").select("i", "low").collect()) == [(i, ["mcb-63/c16a/2p", "mcb-63/d20a/3p", ""][i % 3]) for i in range(30)]
    assert calls.value == 3
    got = parsed_once(df, F.col("t"), specs.breaker, "b").select("i", "b.amps", "b.poles")
    assert sorted(tuple(r) for r in got.collect()) == [(i, [16.0, 20.0, None][i % 3], [2, 3, None][i % 3]) for i in range(30)]

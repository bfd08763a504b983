"""Project operators on odd rows."""

from pyspark.sql import functions as F

from loomgrid.operators import projects


def test_nothing_is_overwritten(spark):
    had = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2), (None, 4)], "k string, v int")
    assert sorted(map(tuple, projects.insert_or_ignore(had, new, "k").collect())) == [("a", 1), ("b", 2)]
    same = projects.rename({"t": had}, "k", "t", "zz", "y")
    assert same["t"].first()["k"] == "a" and projects.rename({"t": had}, "k", "t", "a", "y")["t"].first()["k"] == "y"
    assert projects.new_issues(had, spark.createDataFrame([("", 1), (None, 2), ("c", 5), ("c", 4), ("a", 6)], "k string, v int"), "k", "v").collect() == [("c", 4)]


def test_codes_fields_and_costs(spark):
    row = spark.createDataFrame([(" A1、B2,C3 A1 ", None, "x")], "u string, e string, f string")
    got = row.select(projects.used_codes(F.col("u")), projects.used_codes(F.col("e")), projects.call_cost(F.lit(10), F.lit(99), F.lit(-1), (20, 1000, 4000)), projects.call_cost(F.lit(10), F.lit(None).cast("int"), F.lit(1), (20, 1000, 4000))).first()
    assert list(got) == [["A1", "B2", "C3", "A1、B2,C3 A1"], [], 200, 14000]
    times = spark.createDataFrame([("2026-09-11 09:00:00",), ("2026-09-11 12:00:00",), ("2026-09-12 10:00:00",)], "t string")
    assert [r[0] for r in times.select(projects.in_peak(F.col("t").cast("timestamp"), ((540, 720), (840, 1080)))).collect()] == [True, False, False]
    rows = spark.createDataFrame([(1, 2, "late", ""), (1, 1, "", None)], "k int, o int, a string, b string")
    assert projects.first_filled(rows, "k", ["a", "b"], ["o"]).first() == (1, "late", None)


def test_model_costs(spark):
    card = {"deepseek-flash": {"off_peak": (20, 1000, 4000), "peak": (40, 2000, 8000), "windows": ((540, 720), (840, 1080))}}
    rows = [("deepseek-flash", "2026-09-07 00:00:00"), ("DeepSeek-V4-Flash", "2026-09-07 01:00:00"), ("deepseek-flash", "2026-09-06 01:00:00"), ("mystery", "2026-09-07 00:00:00"), (None, None)]
    df = spark.createDataFrame(rows, "m string, t string")
    cost = projects.model_cost(F.col("m"), F.lit(1_000_000), F.lit(0), F.lit(1_000_000), F.col("t").cast("timestamp"), card, {"deepseek-v4-flash": "deepseek-flash"})
    got = [(r["status"], r["peak"], r["cost"] / 1e9) for (r,) in df.coalesce(1).select(cost.alias("c")).collect()]
    assert got == [("priced", False, 5.0), ("priced", True, 10.0), ("priced", False, 5.0), ("unavailable", False, 0.0), ("unavailable", False, 0.0)]

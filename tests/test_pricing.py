"""The price ladder on a literal price table."""

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import pricing

SYNONYMS = {"MCB": ["微型断路器", "小型断路器"], "MCCB": ["塑壳"], "ATS": ["双电源"]}
PRICES = [
    ("a1", "正泰", "小型断路器", "NXB-63 1P C16", "", 900), ("a2", "正泰", "小型断路器", "NXB-63 1P C16 住宅专供", "", 700), ("a3", "正泰", "小型断路器附件", "OF C16 1P", "", 1), ("a4", "正泰", "小型断路器", "NXB-63H 3P C16", "", 5000), ("a5", "正泰", "小型断路器", "NXB-63 3P C16", "", 3000),
    ("b1", "施耐德", "小型断路器", "iC65N 1P C16A", "", 4000), ("b2", "施耐德", "小型断路器", "iC65N 1P C160A", "", 10), ("b3", "施耐德", "小型断路器", "EA9 1P C16", "", 0), ("c1", "正泰", "塑壳断路器", "NM1-125S/3300 3P", "35kA", 20000), ("c2", "正泰", "塑壳断路器", "NM1-125S/4300 3P 100A", "25kA", 10000),
    ("d1", "正泰", "双电源", "NZ7-160 160A 4P", "", 90000), ("d2", "正泰", "双电源", "NZ7-160 160A 4P", "", 80000), ("d3", "正泰", "双电源电子式", "NZ7E-160 160A 4P", "", 70000), ("e1", "施耐德", "小型断路器", "X9", "", 777),
]
ASKED = {
    ("MCB-C16A/1P", "正泰"): ("matched", "a1", 900), ("MCB-C16A/1P", "施耐德"): ("matched", "b1", 4000), ("MCB-C16A/3P 10kA", "正泰"): ("matched", "a4", 5000), ("MCB-C16A/3P 15kA", "正泰"): ("unknown", None, 0), ("MCB-C16A/3P", "正泰"): ("matched", "a4", 5000),
    ("MCCB-100A/3P/3300", "正泰"): ("matched", "c1", 20000), ("MCCB-100A/3P 50kA", "正泰"): ("unknown", None, 0), ("ATS-160A/4P", "正泰"): ("matched", "d2", 80000), ("nxb 63_1p/c16", "正泰"): ("exact", "a1", 900),
    ("MCB-1P", "正泰"): ("no_amps", None, 0), ("-", "正泰"): ("no_spec", None, 0), (None, "正泰"): ("no_spec", None, 0), ("X9", "施耐德"): ("no_amps", None, 0), ("MCB-C16A/1P", "ABB"): ("catalogue", None, 1835), ("MCB-C16A/1P", "西门子"): ("catalogue", None, 2007), ("MCB-C14A/1P", "德力西"): ("catalogue", None, 1399), ("KM-18A", "正泰"): ("unknown", None, 0),
}


def test_ladder(spark):
    prices = spark.createDataFrame(PRICES, "code string, brand string, category string, model string, remark string, price long")
    base = spark.createDataFrame([("MCB-1P-16A", 4800), ("MCB-1P-10A", 4700)], "key string, list_price long")
    demand = spark.createDataFrame([(s, b, 1) for s, b in [*ASKED, ("MCB-C16A/1P", "正泰")]], "spec string, brand string, score int")
    got = {(r["spec"], r["brand"]): (r["basis"], r["price_code"], r["cost"]) for r in pricing.unit_prices(demand, prices, base, SYNONYMS).collect()}
    assert got == ASKED
    assert pricing.unit_prices(demand, prices, base, SYNONYMS).count() == len(ASKED) + 1
    assert {r["basis"] for r in pricing.unit_prices(demand, prices.where("false"), base.where("false"), SYNONYMS).collect()} == {"unknown", "no_amps", "no_spec"}


@pytest.mark.parametrize("spec, want", [("MCB-C16A/1P", ("MCB", "1P", 16, 6, "C")), ("MCCB-160MA/125A/3P 35kA", ("MCCB", "3P", 125, 35, "C")), ("ATS-160A/4P", ("ATS", "4P", 160, 6, "C")), ("D20", ("MCB", "1P", 20, 6, "D")), ("浪涌保护器", ("SPD", "4P", None, 6, "C")), ("DZ47LE C32", ("RCBO", "1P", 32, 6, "C"))])
def test_features(spark, spec, want):
    f = spark.createDataFrame([(spec,)], "s string").select(pricing.features(F.col("s")).alias("f")).first()["f"]
    assert (f["kind"], f["poles"], f["amps"], f["breaking_ka"], f["curve"]) == want

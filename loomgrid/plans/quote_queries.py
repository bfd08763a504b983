"""Enclosures, quotations and replacements on the sample tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quotes, replacements
from ..sources.tables import table
from .queries import cents, query


def text(prefix, c):
    return F.concat(F.lit(prefix), c.cast("string"))


def pick(n, *names):
    return F.get(F.array(*map(F.lit, names)), n.cast("int"))


@query("""WITH b AS (SELECT p_partkey AS k, p_partkey % 7 <> 0 AS sized, 200 + 10 * p_size + p_partkey % 11 * 100 AS w, 300 + p_partkey % 16 * 100 AS h, p_partkey % 40 AS n, p_partkey % 5 = 0 AS fl, p_partkey % 6 AS s, p_partkey % 4 AS m, p_partkey % 3 AS ip, p_partkey % 13 = 0 AS thick FROM part),
d AS (SELECT *, CASE WHEN sized THEN least(w, h, 150) END AS d, CASE WHEN sized THEN greatest(w, h) ELSE 0 END AS longest FROM b),
c AS (SELECT *, CASE m WHEN 1 THEN '304#不锈钢板' WHEN 2 THEN '201#不锈钢板' ELSE '冷轧钢板' END AS mat, CASE WHEN thick THEN 25 WHEN fl OR longest >= 1600 THEN 20 WHEN longest <= 450 THEN 12 ELSE 15 END AS t,
CASE s WHEN 1 THEN '立板+支架' WHEN 2 THEN '立板+支架+封板' WHEN 3 THEN '双门' WHEN 4 THEN '安装板+帽子' WHEN 5 THEN '隔板' ELSE CASE WHEN fl OR longest >= 1600 THEN '安装板+支架+封板' ELSE '安装板' END END AS st FROM d),
p AS (SELECT *, CASE WHEN t = 25 THEN NULL ELSE CASE mat WHEN '304#不锈钢板' THEN map {12: 30500, 15: 37000, 20: 46000}[t] WHEN '201#不锈钢板' THEN map {12: 23504, 15: 28815, 20: 37290}[t] ELSE map {12: 12995, 15: 14690, 20: 18080}[t] END END::BIGINT AS price, map {'立板+支架': 28, '立板+支架+封板': 35, '双门': 28, '安装板+帽子': 30, '隔板': 20, '安装板+支架+封板': 35, '安装板': 20}[st]::BIGINT AS a FROM c),
e AS (SELECT *, CASE WHEN NOT sized THEN CASE WHEN n >= 25 THEN 145000 WHEN n >= 13 THEN 58000 WHEN n >= 7 THEN 36000 ELSE 22000 END WHEN price IS NULL THEN 0 ELSE
((w + 50) * (h + 50) * a * price + 5000000) // 10000000 + ((w + h + 100) * (d + 20) * 2 * price + 500000) // 1000000 + ((w + 50) * (h + 50) * price + 500000) // 1000000 END AS base FROM p)
SELECT k AS p_partkey, st AS structure, mat AS material, t::DOUBLE AS tenths, CASE WHEN NOT sized THEN 'circuits' WHEN price IS NULL THEN 'unknown_material' ELSE 'unfolded' END AS basis, CAST((base * CASE ip WHEN 1 THEN 115 WHEN 2 THEN 135 ELSE 100 END + 50) // 100 AS BIGINT) AS enclosure FROM e""")
def box_enclosures(spark, d):
    k = F.col("p_partkey")
    w, h = 200 + 10 * F.col("p_size") + k % 11 * 100, 300 + k % 16 * 100
    size = F.when(k % 7 != 0, F.concat(text("箱 ", w), text("×", h), F.lit(" * 150")))
    note = F.concat(pick(k % 6, "", "立板及支架", "立板加支架带封板", "内设双门", "室外防雨檐", ""), F.when(k % 13 == 0, " 厚度2.5mm").otherwise(""))
    boxes = table(spark, d, "part").select(k, size.alias("size"), note.alias("note"), F.when(k % 6 == 5, "隔板").alias("structure"), pick(k % 4, None, "不锈钢304", "201不锈钢", "冷轧板").alias("material"), F.when(k % 5 == 0, "落地安装").alias("install"), pick(k % 3, "IP30", "ip44", "IP65").alias("ip_rating"), (k % 40).alias("n_circuits"))
    return quotes.enclosure(boxes).select("p_partkey", F.col("structure_used").alias("structure"), F.col("material_used").alias("material"), F.col("thickness_tenths").alias("tenths"), F.col("enclosure_basis").alias("basis"), "enclosure")


_QUOTED = """x AS (SELECT c_custkey AS code, c_custkey % 4 = 0 AS cab, c_custkey % 3 AS parts FROM customer),
amps AS (SELECT [16, 63, 160, 400, 630] AS a), brands AS (SELECT * FROM (VALUES ('施耐德', 40, 38, 100), ('良信', 48, 45, 72), ('正泰', 55, 50, 58)) AS t(brand, small, large, times)),
c AS (SELECT o_custkey AS code, o_orderkey % 9 = 0 AS main, CASE WHEN o_orderkey % 9 = 0 THEN a[o_orderkey % 5 + 1] END AS amps, CASE WHEN o_orderkey % 9 = 0 THEN 'MCCB-' || a[o_orderkey % 5 + 1] || 'A/3P' WHEN o_orderkey % 11 = 0 THEN '-' ELSE 'MCB-C' || (o_orderkey % 2 * 4 + 16) || 'A/1P' END AS spec FROM orders, amps),
n AS (SELECT code, count(*) AS n, count(*) FILTER (main) AS m, max(amps) AS amps FROM c GROUP BY code),
l AS (SELECT s_suppkey % 7 AS r, 'MCCB-63A/3P' AS spec, 2::BIGINT AS q, '塑壳断路器' AS name FROM supplier WHERE s_suppkey BETWEEN 1 AND 3 UNION ALL SELECT s_suppkey % 7, 'M' || s_suppkey, 3, '电能表' FROM supplier WHERE s_suppkey BETWEEN 4 AND 6),
p AS (SELECT code, spec, q, name FROM x JOIN l ON code % 7 = r), need AS (SELECT code, spec, q FROM p UNION ALL SELECT code, spec, 1 FROM c WHERE spec <> '-' AND code NOT IN (SELECT code FROM p WHERE name = '塑壳断路器')),
list AS (SELECT * FROM (VALUES ('MCB-C16A/1P', 4800, true), ('MCCB-63A/3P', 42000, false), ('MCCB-160A/3P', 89000, false), ('MCCB-400A/3P', 285000, false)) AS t(spec, list, mcb)),
unit AS (SELECT spec, brand, (list::BIGINT * 2 * CASE WHEN mcb THEN small ELSE large END * times + 10000) // 20000 AS cost FROM list, brands UNION ALL SELECT 'MCB-C20A/1P', '正泰', 1777),
need2 AS (SELECT code, spec, sum(q) AS q FROM need GROUP BY ALL),
mat AS (SELECT code, brands.brand, sum(q * coalesce(cost, 0))::BIGINT AS material, count(*) FILTER (cost IS NULL) AS n_open FROM need2 CROSS JOIN brands LEFT JOIN unit ON unit.spec = need2.spec AND unit.brand = brands.brand GROUP BY ALL),
e AS (SELECT x.code, cab, coalesce(n, 0) AS n, coalesce(m, 0) AS m, amps, CASE WHEN coalesce(n, 0) >= 25 THEN 145000 WHEN n >= 13 THEN 58000 WHEN n >= 7 THEN 36000 ELSE 22000 END AS box FROM x LEFT JOIN n ON x.code = n.code),
g AS (SELECT *, CASE WHEN amps IS NULL THEN NULL WHEN cab AND amps >= 250 THEN map {400: 32040, 630: 38448}[amps] ELSE (5600 * map {16: 534, 63: 534, 160: 668, 400: 1424, 630: 2225}[amps] + 5000) // 10000 * 10 END::BIGINT AS grams FROM e),
q AS (SELECT g.code, n AS n_circuits, n_open, brands.brand, box, coalesce(material, 0) AS material, coalesce((grams * 7650 + 500) // 1000, 0) AS bus, m * 12000 + (n - m) * 4500 AS labour FROM g CROSS JOIN brands LEFT JOIN mat ON mat.code = g.code AND mat.brand = brands.brand),
f AS (SELECT *, box + material + bus + (material * 65 + 500) // 1000 + labour AS made, (material * CASE WHEN brand = '施耐德' THEN 120 ELSE 167 END + 500) // 1000 AS aux FROM q),
r AS (SELECT *, made + (made * 20 + 500) // 1000 AS factory FROM f)"""


@query(f"""WITH {_QUOTED} SELECT code, brand, n_circuits, coalesce(n_open, 0)::BIGINT AS n_open, material, bus AS busbar, factory, CAST((factory * 1220400 + 500000) // 1000000 AS BIGINT) AS final, CAST(material + aux + ((material + aux) * CASE WHEN brand = '施耐德' THEN 183 ELSE 197 END + 500) // 1000 + box + bus AS BIGINT) AS ab_total FROM r""")
def box_quotations(spark, d):
    return _quoted(spark, d).select("code", "brand", "n_circuits", "n_open", "material", "busbar", "factory", "final", "ab_total")


@query(f"""WITH {_QUOTED}, w AS (SELECT code, max((factory * 1220400 + 500000) // 1000000) FILTER (brand = '施耐德') AS a, max((factory * 1220400 + 500000) // 1000000) FILTER (brand = '良信') AS b, max((factory * 1220400 + 500000) // 1000000) FILTER (brand = '正泰') AS c FROM r GROUP BY code)
SELECT code, a::BIGINT AS first, b::BIGINT AS second, c::BIGINT AS third, CAST(sign(a - c) * ((abs(a - c) * 2000 + a) // (2 * a)) AS BIGINT) AS saving FROM w""")
def brand_comparison(spark, d):
    a, b, c = quotes.COMPARED
    return quotes.brand_matrix(_quoted(spark, d), ["code"]).withColumnsRenamed({a: "first", b: "second", c: "third"})


def _quoted(spark, d):
    k, o, s, none = F.col("c_custkey"), F.col("o_orderkey"), F.col("s_suppkey"), F.lit("")
    boxes = table(spark, d, "customer").select(k.alias("code"), F.when(k % 4 == 0, "GGD").otherwise("PZ30").alias("box_type"))
    main, amps = o % 9 == 0, pick(o % 5, 16, 63, 160, 400, 630)
    breaker = F.when(main, F.concat(text("MCCB-", amps), F.lit("A/3P"))).when(o % 11 == 0, " - ").otherwise(F.concat(text("MCB-C", o % 2 * 4 + 16), F.lit("A/1P")))
    circuits = table(spark, d, "orders").select(F.col("o_custkey").alias("code"), F.when(main & (o % 2 == 0), "incoming").alias("kind"), none.alias("circuit_no"), F.when(main & (o % 2 == 1), "进线柜").alias("load_name"), breaker.alias("breaker"))
    few = table(spark, d, "supplier").where("s_suppkey BETWEEN 1 AND 6").select((s % 7).alias("r"), F.when(s < 4, "塑壳断路器").otherwise("电能表").alias("name"), F.when(s < 4, "MCCB-63A/3P").otherwise(text("M", s)).alias("spec"), F.when(s < 4, 2).otherwise(3).alias("quantity"))
    parts = table(spark, d, "customer").select(k.alias("code"), (k % 7).alias("r")).join(few, "r").drop("r")
    n = F.col("n_nationkey").cast("int")
    base = table(spark, d, "nation").where("n_nationkey < 4").select(pick(n, "MCB-1P-16A", "MCCB-3P-63A", "MCCB-3P-160A", "MCCB-3P-400A").alias("key"), pick(n, 4800, 42000, 89000, 285000).cast("long").alias("list_price"))
    prices = table(spark, d, "nation").where("n_nationkey = 0").select(F.lit("P0").alias("code"), F.lit("正泰").alias("brand"), F.lit("其他").alias("category"), F.lit("MCB-C20A 1P").alias("model"), none.alias("remark"), F.lit(1777).cast("long").alias("price"))
    return quotes.quotations(boxes, circuits, parts, prices, base, {"MCB": ["微型断路器"], "MCCB": ["塑壳断路器"]}, quotes.COMPARED, ["code"])


_REPLACED = """i AS (SELECT p_partkey AS k, p_partkey % 5 AS s, p_partkey % 3 AS b, p_size AS a, p_partkey % 4 + 1 AS p, p_partkey % 8 = 0 AS hi, p_partkey % 11 <> 0 AS has, CAST(round(p_retailprice * 100) AS BIGINT) AS price FROM part),
r AS (SELECT *, 'BRAND ' || CASE s WHEN 0 THEN 'C' || a || 'A/' || p || 'P' WHEN 1 THEN 'C' || a || 'A/' || p || 'P 30mA' WHEN 2 THEN a || 'A/' || p || 'P' WHEN 3 THEN a || 'A' ELSE a || 'A' END || CASE WHEN hi THEN ' 10kA' ELSE '' END AS said,
CASE b WHEN 0 THEN '正泰' WHEN 1 THEN '良信' ELSE '德力西' END AS target FROM i),
m AS (SELECT *, CASE s WHEN 0 THEN CASE b WHEN 0 THEN CASE WHEN hi THEN 'NXB-63H' ELSE 'NXB-63' END WHEN 1 THEN CASE WHEN hi THEN 'NDB2-63' ELSE 'NDB1-63' END ELSE CASE WHEN hi THEN 'CDB6H-63' ELSE 'CDB6i-63' END END
WHEN 1 THEN CASE b WHEN 0 THEN CASE WHEN hi THEN 'NXBLE-63H' ELSE 'NXBLE-63' END WHEN 1 THEN 'NDB1LE-63' ELSE 'CDB6LE-63' END WHEN 2 THEN ['NM8N-125S', 'NDM1-125S', 'CDM3-125S'][b + 1] WHEN 3 THEN ['NC1', 'NDC1', 'CJX2s'][b + 1] ELSE ['NXA', 'NDW1', 'CDW3'][b + 1] END AS series FROM r),
v AS (SELECT *, series || CASE s WHEN 0 THEN ' C' || a || '/' || p || 'P' WHEN 1 THEN ' C' || a || '/' || p || 'P 30mA' WHEN 2 THEN '/3300 ' || a || 'A ' || p || 'P' WHEN 3 THEN '-' || lpad(a::VARCHAR, greatest(2, length(a::VARCHAR))::INT, '0') || ' 交流接触器' ELSE ' 智能型框架断路器 ' || a || 'A 1P' END AS model FROM m),
o AS (SELECT said, min(price) AS price FROM v WHERE has GROUP BY said), t AS (SELECT DISTINCT target, model, 40000 + 1000 * a AS price FROM v WHERE k % 2 = 0),
z AS (SELECT v.k, v.target, v.series, v.model, o.price AS old, t.price AS new FROM v LEFT JOIN o ON o.said = v.said LEFT JOIN t ON t.target = v.target AND t.model = v.model),
y AS (SELECT k, target, series, model, CASE WHEN old IS NULL OR new IS NULL THEN 'missing_price' WHEN new < old THEN 'cost_saving' WHEN new > old THEN 'cost_increase' ELSE 'cost_equal' END AS status, CASE WHEN new < old THEN (200 * (old - new) + old) // (2 * old) WHEN new >= old THEN 0 END::BIGINT AS saving FROM z)"""


@query(f"""WITH {_REPLACED} SELECT k AS p_partkey, target, series, model, status, saving FROM y""")
def replacement_models(spark, d):
    return _replaced(spark, d).select("p_partkey", "target", "series", "model", "status", "saving")


@query(f"""WITH {_REPLACED} SELECT target, count(*) AS items, sum(k % 6 + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END)::DOUBLE AS total, coalesce(sum(CASE WHEN k % 6 = 0 THEN 1 ELSE k % 6 END) FILTER (saving > 0), 0)::DOUBLE AS replaceable, coalesce(sum(CASE WHEN k % 6 = 0 THEN 1 ELSE k % 6 END) FILTER (status = 'cost_increase'), 0)::DOUBLE AS dearer,
coalesce(sum(CASE WHEN k % 6 = 0 THEN 1 ELSE k % 6 END) FILTER (saving IS NULL), 0)::DOUBLE AS unquoted, CAST(floor(coalesce(sum(CASE WHEN k % 6 = 0 THEN 1 ELSE k % 6 END * saving) FILTER (saving > 0), 0) / sum(CASE WHEN k % 6 = 0 THEN 1 ELSE k % 6 END) + 0.5) AS BIGINT) AS saving FROM y GROUP BY target""")
def replacement_totals(spark, d):
    return replacements.replacement_report(_replaced(spark, d), ["target"])


def _replaced(spark, d):
    k, a, p = F.col("p_partkey"), F.col("p_size"), F.concat((F.col("p_partkey") % 4 + 1).cast("string"), F.lit("P"))
    s, n = k % 5, F.col("p_size").cast("string")
    form = F.when(s == 0, F.concat(F.lit("C"), n, F.lit("A/"), p)).when(s == 1, F.concat(F.lit("C"), n, F.lit("A/"), p, F.lit(" 30mA"))).when(s == 2, F.concat(n, F.lit("A/"), p)).otherwise(F.concat(n, F.lit("A")))
    said = F.concat(F.lit("BRAND "), form, F.when(k % 8 == 0, " 10kA").otherwise(""))
    target = pick(k % 3, "正泰", "良信", "德力西")
    part = table(spark, d, "part")
    devices = part.select(k, a, pick(s, "微型断路器", "微断", "塑壳断路器", "交流接触器", "框架断路器").alias("name"), said.alias("spec"), target.alias("target"), (k % 6).alias("quantity"), cents("p_retailprice").alias("cents"))
    old = devices.where(k % 11 != 0).groupBy("spec").agg(F.min("cents").alias("price")).select(F.col("spec").alias("model"), "price").withColumn("brand", F.lit("通用/国标"))
    none = part.sparkSession.createDataFrame([], "code string, brand string, category string, model string, remark string, price long")
    listed = replacements.recommend(devices.where(k % 2 == 0), none, {}).select("model", (40000 + 1000 * a).cast("long").alias("price"), F.col("target").alias("brand")).distinct()
    prices = old.unionByName(listed).withColumns({"code": F.concat_ws(" ", "brand", "model"), "category": F.lit("其他"), "remark": F.lit("")})
    return replacements.recommend(devices, prices, {"MCB": ["微型断路器"], "MCCB": ["塑壳断路器"]})

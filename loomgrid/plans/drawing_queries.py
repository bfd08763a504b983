"""The operators on drawing texts and shapes, on the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import panels, specs
from ..operators import claims, drawings, schedules, spatial, topology
from ..sources.tables import table
from .queries import query


def _string(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


@query("""WITH t AS (SELECT p_partkey, p_partkey % 9 AS kind, CAST(p_size AS BIGINT) AS n, p_partkey % 40 + 1 AS k FROM part)
SELECT p_partkey, CASE kind WHEN 0 THEN k || 'AL' || n WHEN 1 THEN 'AP' || n || ',' || k || 'AT' || n || '-A' WHEN 2 THEN k || 'KX' || n || '/' || n ELSE '' END AS codes,
CASE kind WHEN 0 THEN k || 'AL' || n END AS feed,
CASE kind WHEN 3 THEN 'circuit' WHEN 4 THEN 'rating' WHEN 5 THEN 'quantity' WHEN 6 THEN 'product' WHEN 7 THEN 'not a panel' WHEN 8 THEN 'long number' END AS fault FROM t""")
def panel_lexer(spark, d):
    n, k = _string(F.col("p_size").cast("long")), _string(F.col("p_partkey") % 40 + 1)
    made = [F.concat(k, F.lit("al"), n, F.lit(" ："), F.lit("1AL1")), F.concat(F.lit("消防AP"), n, F.lit("、"), k, F.lit("AT"), n, F.lit("-A（AP"), n, F.lit("）")), F.concat(k, F.lit("KX"), n, F.lit("/"), n, F.lit(" 63A")),
            F.concat(k, F.lit("-WL"), n), F.concat(F.lit("XL-"), n, F.lit("A")), F.concat(F.lit("AC"), n, F.lit("V")), F.concat(k, F.lit("x"), n, F.lit("AL")), F.concat(F.lit("ATSE"), n), F.concat(F.lit("AL1"), F.lpad(n, 4, "0"))]
    text = F.element_at(F.array(*made), (F.col("p_partkey") % 9 + 1).cast("int"))
    fault = F.when(F.col("p_partkey") % 9 > 2, panels.token_fault(F.upper(text)))
    return table(spark, d, "part").select("p_partkey", F.array_join(panels.panel_codes(text), ",").alias("codes"), panels.feed_code(text).alias("feed"), fault.alias("fault"))


@query("""WITH t AS (SELECT l_linenumber % 7 AS b, l_orderkey % 6 AS c, CAST(l_quantity AS BIGINT) * 5 AS q FROM lineitem)
SELECT CASE b WHEN 0 THEN '施耐德' WHEN 1 THEN 'ABB' WHEN 2 THEN '西门子' WHEN 3 THEN '正泰' WHEN 4 THEN '德力西' WHEN 5 THEN '良信' ELSE '通用/国标' END AS brand,
CASE WHEN c = 0 THEN '剩余电流动作断路器' WHEN c = 1 THEN '隔离开关' WHEN c = 2 THEN '双电源自动转换开关' WHEN c = 3 THEN '塑壳断路器' WHEN c = 4 AND q <= 125 THEN '微型断路器' WHEN c = 4 THEN '塑壳断路器' ELSE '断路器（其他）' END AS category, count(*) AS n FROM t GROUP BY ALL""")
def brands_and_breakers(spark, d):
    names = F.array(*(F.lit(x) for x in ("ic65n", "Tmax", "5sl6", "NXB-63", "cdm3", "NDC1", "MCB")))
    amps = _string(F.col("l_quantity").cast("long") * 5)
    devices = F.array(F.concat(F.lit("RCB-"), amps), F.concat(F.lit("HR17-"), amps), F.concat(F.lit("WATS"), amps), F.concat(F.lit("3va1 "), amps), F.concat(F.lit("c"), amps, F.lit("/3P")), F.concat(F.lit("QF"), amps))
    at = lambda a, c: F.get(a, c.cast("int"))
    # equal texts are counted before they are read
    said = table(spark, d, "lineitem").select(at(names, F.col("l_linenumber") % 7).alias("name"), at(devices, F.col("l_orderkey") % 6).alias("device")).groupBy("name", "device").agg(F.count("*").alias("n"))
    each = said.select(specs.brand(F.col("name")).alias("brand"), specs.breaker_category(F.col("device")).alias("category"), "n")
    return each.groupBy("brand", "category").agg(F.sum("n").alias("n"))


@query("""WITH RECURSIVE p AS (SELECT p_brand, p_partkey AS id, CAST(p_size AS DOUBLE) AS x, floor(p_retailprice / 10) AS y FROM part),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.p_brand = b.p_brand AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
r AS (SELECT id, id AS root FROM p UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a)
SELECT p_brand, p.id AS p_partkey, min(root) AS cluster FROM p JOIN r USING (id) GROUP BY ALL""")
def clusters_2d(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("x"), F.floor(F.col("p_retailprice") / 10).alias("y"))
    return spatial.clusters(p, ["p_brand"], "p_partkey", "x", "y", 1.0)


@query("""SELECT c_custkey, s_suppkey, greatest(abs(c_acctbal - s_acctbal), abs(c_nationkey - s_nationkey) * 100.0) AS distance FROM customer JOIN supplier ON c_custkey % 3 = s_suppkey % 3
WHERE greatest(abs(c_acctbal - s_acctbal), abs(c_nationkey - s_nationkey) * 100.0) <= 400 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY distance, s_suppkey) = 1""")
def nearest_2d(spark, d):
    c = table(spark, d, "customer").withColumns({"ck": F.col("c_custkey") % 3, "cy": F.col("c_nationkey") * 100.0})
    s = table(spark, d, "supplier").withColumns({"sk": F.col("s_suppkey") % 3, "sy": F.col("s_nationkey") * 100.0})
    return spatial.nearest(c, s, "c_custkey", "s_suppkey", [("c_acctbal", "s_acctbal"), ("cy", "sy")], [("ck", "sk")], within=400.0)


_BOXES = "SELECT p_partkey AS id, CAST(p_partkey * 7 % 997 AS DOUBLE) AS x0, CAST(p_partkey * 13 % 991 AS DOUBLE) AS y0, CAST(p_partkey * 7 % 997 + p_size AS DOUBLE) AS x1, CAST(p_partkey * 13 % 991 + (p_partkey % 40) AS DOUBLE) AS y1 FROM part"


def _boxes(spark, d):
    k = F.col("p_partkey")
    x, y = k * 7 % 997, k * 13 % 991
    return table(spark, d, "part").select(k.alias("id"), *(c.cast("double").alias(n) for n, c in (("x0", x), ("y0", y), ("x1", x + F.col("p_size")), ("y1", y + k % 40))))


@query(f"WITH b AS ({_BOXES}) SELECT l.id AS left_id, r.id AS right_id FROM b l JOIN b r ON l.id % 2 = 0 AND r.id % 2 = 1 AND l.x0 <= r.x1 AND r.x0 <= l.x1 AND l.y0 <= r.y1 AND r.y0 <= l.y1")
def box_pairs(spark, d):
    b = _boxes(spark, d)
    return spatial.box_pairs(b.where("id % 2 = 0").withColumnRenamed("id", "left_id"), b.where("id % 2 = 1").withColumnRenamed("id", "right_id"), "left_id", "right_id")


@query(f"""WITH b AS ({_BOXES}) SELECT id FROM b s WHERE NOT EXISTS (SELECT 1 FROM b k WHERE k.x0 <= s.x0 AND k.y0 <= s.y0 AND k.x1 >= s.x1 AND k.y1 >= s.y1
AND ((k.x1 - k.x0) * (k.y1 - k.y0) > (s.x1 - s.x0) * (s.y1 - s.y0) OR ((k.x1 - k.x0) * (k.y1 - k.y0) = (s.x1 - s.x0) * (s.y1 - s.y0) AND k.id < s.id)))""")
def outer_boxes(spark, d):
    return spatial.outer_boxes(_boxes(spark, d), "id", slack=0.0, covered=2.0).select("id")


@query("""WITH t AS (SELECT 'N' || c_nationkey AS block, c_custkey AS id, c_custkey % 100 AS x, CAST(floor(c_acctbal) AS BIGINT) AS y FROM customer UNION ALL SELECT 'R' || n_regionkey, -n_nationkey - 1, n_nationkey, 5 FROM nation),
i AS (SELECT 'N' || n_nationkey AS block, 'R' || n_regionkey AS owner, n_nationkey % 3 + 1 AS s, n_nationkey % 2 AS turned, n_nationkey * 10 AS e, n_nationkey AS f FROM nation),
l AS (SELECT block, id, x, y, 0 AS depth FROM t UNION ALL SELECT owner, id, CASE WHEN turned = 1 THEN -s * y ELSE s * x END + e, CASE WHEN turned = 1 THEN s * x ELSE s * y END + f, 1 FROM t JOIN i ON t.block = i.block)
SELECT l.block, id, CAST(CASE k WHEN 0 THEN x ELSE -x END + k * 1000 AS DOUBLE) AS x, CAST(y + r_regionkey AS DOUBLE) AS y, depth + 1 AS depth FROM l JOIN region ON l.block = 'R' || r_regionkey, (SELECT unnest([0, 1]) AS k)""")
def block_texts(spark, d):
    name = lambda p, c: F.concat(F.lit(p), _string(c))
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    texts = c.select(name("N", "c_nationkey").alias("block"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 100).cast("double").alias("x"), F.floor("c_acctbal").cast("double").alias("y"))
    texts = texts.unionByName(n.select(name("R", "n_regionkey").alias("block"), (-F.col("n_nationkey") - 1).cast("long").alias("id"), F.col("n_nationkey").cast("double").alias("x"), F.lit(5.0).alias("y")))
    size, turned = (F.col("n_nationkey") % 3 + 1).cast("double"), F.col("n_nationkey") % 2 == 1
    entry = lambda straight, turn: F.when(turned, turn).otherwise(straight)
    inner = n.select(name("i", "n_nationkey").alias("insert_id"), name("R", "n_regionkey").alias("owner"), name("N", "n_nationkey").alias("block"), entry(size, F.lit(0.0)).alias("a"), entry(F.lit(0.0), -size).alias("b"), entry(F.lit(0.0), size).alias("c"), entry(size, F.lit(0.0)).alias("d"), (F.col("n_nationkey") * 10.0).alias("e"), F.col("n_nationkey").cast("double").alias("f"))
    outer = r.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "r_regionkey").select(F.concat(name("m", "r_regionkey"), name("-", "k")).alias("insert_id"), F.lit(None).cast("string").alias("owner"), name("R", "r_regionkey").alias("block"), F.when(F.col("k") == 0, 1.0).otherwise(-1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(1.0).alias("d"), (F.col("k") * 1000.0).alias("e"), F.col("r_regionkey").cast("double").alias("f"))
    return drawings.explode_blocks(texts, inner.unionByName(outer)).select("block", "id", "x", "y", F.size("path").alias("depth"))


_RISER = "SELECT p_brand AS b, 'X' || p_partkey % 11 AS code, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey * 37 % 1009 AS DOUBLE) AS y, p_partkey AS id FROM part"


@query(f"""WITH RECURSIVE p AS ({_RISER}), n AS (SELECT s.b, s.x AS seed, p.code, p.x, p.y, row_number() OVER (PARTITION BY s.b, s.x ORDER BY p.y, p.x, p.code) AS k FROM (SELECT DISTINCT b, x FROM p) s JOIN p ON s.b = p.b AND abs(s.x - p.x) <= 8),
w AS (SELECT b, seed, k, y AS last, CAST(NULL AS DOUBLE) AS step, 1 AS run, true AS kept FROM n WHERE k = 1
UNION ALL SELECT b, seed, k, CASE WHEN g <= 2 THEN last ELSE y END, CASE WHEN g <= 2 OR follows THEN coalesce(step, CASE WHEN follows THEN g END) END, CASE WHEN g <= 2 OR follows THEN run ELSE run + 1 END, g > 2
FROM (SELECT w.b, w.seed, n.k, n.y, w.last, w.step, w.run, n.y - w.last AS g, CASE WHEN w.step IS NULL THEN n.y - w.last BETWEEN 8 AND 160 ELSE n.y - w.last <= 320 AND round_even((n.y - w.last) / w.step, 0) BETWEEN 1 AND 2 AND abs((n.y - w.last) / w.step - round_even((n.y - w.last) / w.step, 0)) <= 0.35 END AS follows FROM w JOIN n ON n.b = w.b AND n.seed = w.seed AND n.k = w.k + 1)),
r AS (SELECT w.b, w.seed, run, max(step) AS step, count(DISTINCT code) FILTER (WHERE kept) AS codes FROM w JOIN n USING (b, seed, k) GROUP BY w.b, w.seed, run)
SELECT DISTINCT w.b AS p_brand, code, x, y FROM w JOIN n USING (b, seed, k) JOIN r ON r.b = w.b AND r.seed = w.seed AND r.run = w.run WHERE kept AND r.step IS NOT NULL AND codes >= 4""")
def riser_columns(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_brand", F.concat(F.lit("X"), _string(k % 11)).alias("code"), F.col("p_size").cast("double").alias("x"), (k * 37 % 1009).cast("double").alias("y"), F.lit(4.0).alias("h"))
    return drawings.risers(p, ["p_brand"], "code", "x", "y", "h")


_SCORED = """g AS (SELECT c_custkey // 40 AS drawing, c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'WL' || c_custkey % 7 END AS number, c_mktsegment AS box, c_nationkey AS f FROM customer),
s AS (SELECT drawing, 1000000000 - id AS id, number, CASE WHEN id % 11 = 0 THEN 'OTHER' ELSE box END AS box, CASE WHEN id % 6 = 0 THEN f + 1 ELSE f END AS f FROM g WHERE id % 13 <> 0)"""


@query(f"""WITH RECURSIVE {_SCORED},
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY drawing ORDER BY gid, tier, sid) AS k FROM (SELECT g.drawing, g.id AS gid, s.id AS sid, CASE WHEN g.number = '' THEN 3 WHEN g.box = s.box THEN 1 ELSE 2 END AS tier FROM g JOIN s ON g.drawing = s.drawing AND g.number = s.number AND (g.number <> '' OR g.box = s.box))),
w AS (SELECT drawing, 0::BIGINT AS k, []::BIGINT[] AS gs, []::BIGINT[] AS ss FROM (SELECT DISTINCT drawing FROM p)
UNION ALL SELECT w.drawing, w.k + 1, CASE WHEN free THEN list_append(gs, gid) ELSE gs END, CASE WHEN free THEN list_append(ss, sid) ELSE ss END FROM (SELECT w.*, p.gid, p.sid, NOT list_contains(gs, p.gid) AND NOT list_contains(ss, p.sid) AS free FROM w JOIN p ON p.drawing = w.drawing AND p.k = w.k + 1) w),
m AS (SELECT drawing, unnest(gs) AS gid, unnest(ss) AS sid FROM (SELECT drawing, arg_max(gs, k) AS gs, arg_max(ss, k) AS ss FROM w GROUP BY drawing)),
h AS (SELECT m.drawing, count(*) AS taken, count(*) FILTER (WHERE g.box = s.box) AS split, count(*) FILTER (WHERE g.box = s.box AND g.f = s.f) AS content FROM m JOIN g ON g.id = gid JOIN s ON s.id = sid GROUP BY 1),
n AS (SELECT drawing, max(a) AS gold, max(b) AS said FROM (SELECT drawing, count(*) AS a, 0 AS b FROM g GROUP BY 1 UNION ALL SELECT drawing, 0, count(*) FROM s GROUP BY 1) GROUP BY 1),
o AS (SELECT drawing, gold, said, coalesce(split, 0) AS split, coalesce(content, 0) AS content, said - coalesce(taken, 0) AS extra FROM n LEFT JOIN h USING (drawing))
SELECT *, coalesce(split / nullif(gold, 0), 1) AS split_recall, coalesce(split / nullif(split + extra, 0), 1) AS split_precision, coalesce(content / nullif(gold, 0), 1) AS content_recall, coalesce(content / nullif(content + extra, 0), 1) AS content_precision FROM o""")
def scored_rows(spark, d):
    k = F.col("c_custkey")
    gold = table(spark, d, "customer").select((k / 40).cast("long").alias("drawing"), k.alias("id"), F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("wl "), _string(k % 7))).alias("number"), F.col("c_mktsegment").alias("box"), _string("c_nationkey").alias("f"))
    said = gold.where("id % 13 <> 0").select("drawing", (F.lit(1_000_000_000) - F.col("id")).alias("id"), "number", F.when(F.col("id") % 11 == 0, "other").otherwise(F.lower("box")).alias("box"), F.when(F.col("id") % 6 == 0, _string(F.col("f").cast("int") + 1)).otherwise(F.col("f")).alias("f"))
    return drawings.score_rows(gold, said, "drawing", "id", "number", "box", ["f"])


@query("""WITH RECURSIVE p AS MATERIALIZED (SELECT c_nationkey AS n, c_custkey AS c, s_suppkey AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment <> 'BUILDING', abs(c_acctbal - s_acctbal), c_custkey, s_suppkey) AS k FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 300),
w AS (SELECT n, 0::BIGINT AS k, []::BIGINT[] AS cs, []::BIGINT[] AS ss FROM (SELECT DISTINCT n FROM p)
UNION ALL SELECT n, k + 1, CASE WHEN free THEN list_append(cs, c) ELSE cs END, CASE WHEN free THEN list_append(ss, s) ELSE ss END FROM (SELECT w.*, p.c, p.s, NOT list_contains(cs, p.c) AND NOT list_contains(ss, p.s) AS free FROM w JOIN p ON p.n = w.n AND p.k = w.k + 1))
SELECT unnest(cs) AS c_custkey, unnest(ss) AS s_suppkey FROM (SELECT n, arg_max(cs, k) AS cs, arg_max(ss, k) AS ss FROM w GROUP BY n)""")
def claims_once(spark, d):
    c = table(spark, d, "customer").withColumn("tier", (F.col("c_mktsegment") != "BUILDING").cast("int"))
    return claims.claim_near(c, table(spark, d, "supplier"), "c_custkey", "s_suppkey", "c_acctbal", "s_acctbal", 300.0, [("c_nationkey", "s_nationkey")], "tier")


@query("""WITH RECURSIVE k AS (SELECT c_custkey AS k, CASE c_custkey % 100 WHEN 98 THEN c_custkey + 1 WHEN 99 THEN c_custkey - 1 ELSE c_custkey // 7 END AS p FROM customer WHERE c_custkey >= 1),
known AS (SELECT c_custkey AS code, false AS virtual, c_custkey AS bo FROM customer WHERE c_custkey % 60 <> 59 UNION ALL SELECT p, true, min(k) + 1099511627776 FROM k WHERE p % 60 = 59 GROUP BY p),
claim AS (SELECT k AS child, p AS parent, k AS feed FROM k UNION ALL SELECT k + 1, p, k FROM k WHERE k % 4 = 0),
w AS (SELECT child, arg_min(parent, (b.bo, feed)) AS parent, arg_min(feed, (b.bo, feed)) AS feed FROM claim JOIN known c ON child = c.code JOIN known b ON parent = b.code WHERE child <> parent GROUP BY child),
t AS (SELECT code, virtual, NULL::BIGINT AS parent, NULL::BIGINT AS feed, 0 AS depth FROM known WHERE code NOT IN (SELECT child FROM w) UNION ALL SELECT known.code, known.virtual, w.parent, w.feed, t.depth + 1 FROM w JOIN t ON w.parent = t.code JOIN known ON known.code = w.child WHERE t.depth < 6),
n AS (SELECT p, count(*) AS n, sum(k % 10)::BIGINT AS kw FROM k GROUP BY p)
SELECT 'C' || code || 'AL' AS code, CASE WHEN code IN (SELECT parent FROM w) THEN 'cabinet' ELSE 'box' END AS type, CASE WHEN parent IS NULL THEN '' ELSE 'C' || parent || 'AL' END AS parent, CASE WHEN feed IS NULL THEN '' ELSE 'W' || feed END AS feed, coalesce(n, 0) AS circuits, CASE WHEN kw > 0 THEN kw * 10 END AS kw_tenths, depth, virtual FROM t LEFT JOIN n ON p = code""")
def topology_tree(spark, d):
    k = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("C"), _string(c.cast("long")), F.lit("AL"))
    c = table(spark, d, "customer")
    boxes = c.where("c_custkey % 60 <> 59").select(F.lit("all").alias("job"), k.cast("long").alias("ord"), name(k).alias("code"), F.lit("箱").alias("name"), F.lit("").alias("note"))
    parent = F.when(k % 100 == 98, k + 1).when(k % 100 == 99, k - 1).otherwise(F.floor(k / 7))
    circuits = c.where("c_custkey >= 1").select(F.lit("all").alias("job"), k.cast("long").alias("ord"), name(parent).alias("box"), F.concat(F.lit("W"), _string(k)).alias("circuit_no"), F.concat(F.lit("至"), name(k), F.lit("配电箱")).alias("load_name"), F.when(k % 4 == 0, F.concat(F.lit("供 "), name(k + 1))).alias("note"), F.lit("").alias("secondary_ref"), F.concat(_string(k % 10), F.lit("kW")).alias("power_kw"))
    tree = topology.distribution_tree(boxes, circuits)
    return tree.select("code", "type", "parent", "feed", "circuits", (F.col("kw") * 10).cast("long").alias("kw_tenths"), "depth", "virtual")


@query("""WITH s AS (SELECT s_nationkey AS t, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS c FROM supplier),
x AS (SELECT t, c, 0 AS r, CASE WHEN k % 3 <> 1 THEN 'C' || k ELSE '' END AS x, k % 3 <> 1 AS ruled FROM s UNION ALL SELECT t, c, 1, 'MCB-' || k % 5, true FROM s UNION ALL SELECT t, c, 2, CASE WHEN k % 7 = 0 THEN '' ELSE 'W' || k END, true FROM s UNION ALL SELECT t, c, 3, CASE WHEN k % 2 = 0 THEN 'load' || k ELSE '' END, k % 4 <> 3 FROM s
UNION ALL SELECT DISTINCT t, 0, r, ['柜编号', '断路器', '回路编号', '回路名称'][r + 1], true FROM s, (SELECT unnest([0, 1, 2, 3]) AS r)),
g AS (SELECT *, sum(CASE WHEN ruled OR c = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY t, r ORDER BY c) AS g FROM x), o AS (SELECT t, r, g, min(nullif(x, '')) AS a, max(nullif(x, '')) AS b FROM g GROUP BY ALL),
f AS (SELECT t, c, r, CASE WHEN a = b THEN a ELSE x END AS x FROM g JOIN o USING (t, r, g))
SELECT * FROM (SELECT t AS s_nationkey, c AS col, max(x) FILTER (WHERE r = 0) AS code, max(x) FILTER (WHERE r = 1) AS breaker, max(x) FILTER (WHERE r = 2) AS circuit_no, max(x) FILTER (WHERE r = 3) AS load FROM f WHERE c > 0 GROUP BY ALL) WHERE code NOT IN ('', '柜编号')""")
def schedule_columns(spark, d):
    k = F.col("s_suppkey")
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    cell = lambda text, ruled: F.struct(text.alias("text"), ruled.alias("ruled"))
    held = F.array(cell(F.when(k % 3 != 1, F.concat(F.lit("C"), _string(k))).otherwise(""), k % 3 != 1), cell(F.concat(F.lit("MCB-"), _string(k % 5)), F.lit(True)), cell(F.when(k % 7 == 0, "").otherwise(F.concat(F.lit(" W"), _string(k))), F.lit(True)), cell(F.when(k % 2 == 0, F.concat(F.lit("load "), _string(k))).otherwise(""), k % 4 != 3))
    names = F.array(*(cell(F.lit(x), F.lit(True)) for x in ("柜编号", "断路器", "回路编号", "回路名称")))
    s = table(spark, d, "supplier").select("s_nationkey", place.alias("col"), held.alias("cells"))
    grid = s.unionByName(s.select("s_nationkey").distinct().select("s_nationkey", F.lit(0).alias("col"), names.alias("cells"))).select("s_nationkey", "col", F.posexplode("cells").alias("row", "x"))
    cells = grid.select("s_nationkey", "row", "col", "x.text", "x.ruled", F.col("row").cast("double").alias("top"), (F.col("row") + 1.0).alias("bottom"))
    return schedules.schedule_circuits(cells, "s_nationkey").select("s_nationkey", F.col("col").cast("long").alias("col"), "code", "breaker", "circuit_no", "load")

"""The operators on the sample tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions import panels, specs
from ..operators import bom, circuits, hierarchy, pricing, rules, spatial, store
from ..sources.staged import parsed_once
from ..sources.tables import table
from ..streaming import ledger

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


CENTS = "CAST(round({} * 100) AS BIGINT)"


def qty():
    return F.col("l_quantity").cast("long")


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


@query("""
WITH j AS (SELECT p_brand, p_type, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS f, l_orderkey * 10 + l_linenumber AS o FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT p_brand, p_type, f, min(o) AS o FROM j GROUP BY ALL)
SELECT p_brand, p_type, quantity, uses FROM (SELECT p_brand, p_type, sum(q)::BIGINT AS quantity FROM j GROUP BY ALL)
JOIN (SELECT p_brand, p_type, string_agg(f, '、' ORDER BY o, f) AS uses FROM s GROUP BY ALL) USING (p_brand, p_type)""")
def bom_rollup(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return bom.rollup_bom(j, ["p_brand", "p_type"], qty(), {"uses": "l_returnflag"}, F.col("l_orderkey") * 10 + F.col("l_linenumber"))


@query("""
WITH q AS (SELECT p_type, n_name, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT p_type, sum(q)::BIGINT AS total, string_agg(n_name || '=' || q, ',' ORDER BY n_name) AS parts FROM q GROUP BY p_type""")
def project_bom_distribution(spark, d):
    li, o, c, n, p = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "part"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    out = bom.spread(j, ["p_type"], "n_name", qty())
    return out.select("p_type", "total", F.array_join(F.transform(F.map_entries("parts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("parts"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey, l_extendedprice)::BIGINT AS place FROM lineitem""")
def stable_circuit_order(spark, d):
    rank = circuits.circuit_rank(F.when(F.col("l_returnflag") == "A", circuits.INCOMING).when(F.col("l_returnflag") == "N", "N1").otherwise(" "), F.lit("灯"))
    w = Window.partitionBy("l_orderkey").orderBy(rank, "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def dangling_reference_anti(spark, d):
    c = table(spark, d, "customer")
    return bom.unmatched(c, table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'MCB-63' AS series, 'C' AS curve, CAST(l_quantity AS DOUBLE) AS amps, l_linenumber % 4 + 1 AS poles FROM lineitem")
def parse_breaker_roundtrip(spark, d):
    text = F.concat(F.lit("MCB-63/C"), qty().cast("string"), F.lit("A/"), (F.col("l_linenumber") % 4 + 1).cast("string"), F.lit("P"))
    b = parsed_once(table(spark, d, "lineitem"), text, specs.breaker, "b")
    return b.select("l_orderkey", "l_linenumber", "l_partkey", "b.series", "b.curve", "b.amps", "b.poles")


@query("""SELECT 'DEV-' || l_partkey AS spec, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'SPD', count(*) FROM lineitem""")
def parse_devices_explode(spark, d):
    text = F.concat(F.col("l_linenumber").cast("string"), F.lit("×DEV-"), F.col("l_partkey").cast("string"), F.lit(" + SPD"))
    return table(spark, d, "lineitem").select(F.explode(specs.devices(text, begins=("DEV-", "SPD"), combos=True)).alias("x")).groupBy("x.spec").agg(F.sum("x.count").alias("n"))


@query("SELECT p_partkey, 'YJV' AS family, p_partkey % 5 + 1 AS cores, CAST(p_size AS DOUBLE) AS section, 1 AS earth_cores, CAST(p_size + 1 AS DOUBLE) AS earth_section FROM part")
def parse_cable_roundtrip(spark, d):
    s = lambda c: c.cast("string")
    text = F.concat(F.lit("YJV-"), s(F.col("p_partkey") % 5 + 1), F.lit("x"), s(F.col("p_size")), F.lit("+1×"), s(F.col("p_size") + 1))
    return table(spark, d, "part").withColumn("c", specs.cable(text)).select("p_partkey", "c.family", F.col("c.cores").cast("long").alias("cores"), "c.section", "c.earth_cores", "c.earth_section")


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN p_type LIKE '%ECONOMY%' THEN 'low' WHEN p_type LIKE '%STANDARD%' OR p_type LIKE '%MEDIUM%' THEN 'mid' ELSE 'other' END AS kind FROM part) GROUP BY kind""")
def brand_category_case(spark, d):
    return table(spark, d, "part").select(C.pattern_case(F.col("p_type"), [("ECONOMY", "low"), ("STANDARD|MEDIUM", "mid")], "other").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT 'QTY_HIGH' AS rule_code, 'ERROR' AS severity, l_orderkey AS target FROM lineitem WHERE l_quantity > 45
UNION ALL SELECT 'FLAG_SUSPECT', 'WARNING', l_orderkey FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')""")
def rule_qty_unit(spark, d):
    return rules.findings(table(spark, d, "lineitem"), [("QTY_HIGH", "ERROR", F.col("l_quantity") > 45), ("FLAG_SUSPECT", "WARNING", ~F.col("l_returnflag").isin("A", "N"))], F.col("l_orderkey"))


@query("""WITH s AS (SELECT l_orderkey, sum(CASE WHEN l_linenumber % 4 = 3 THEN q WHEN l_linenumber % 4 = 0 THEN 3 * q ELSE 0 END)::BIGINT AS phase_0, sum(CASE WHEN l_linenumber % 4 = 3 THEN q WHEN l_linenumber % 4 = 1 THEN 3 * q ELSE 0 END)::BIGINT AS phase_1, sum(CASE WHEN l_linenumber % 4 = 3 THEN q WHEN l_linenumber % 4 = 2 THEN 3 * q ELSE 0 END)::BIGINT AS phase_2 FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY l_orderkey)
SELECT * FROM s WHERE least(phase_0, phase_1, phase_2) > 0 AND greatest(phase_0, phase_1, phase_2) > 3 AND (greatest(phase_0, phase_1, phase_2) - least(phase_0, phase_1, phase_2)) * 100 > greatest(phase_0, phase_1, phase_2) * 15""")
def phase_unbalance(spark, d):
    phase = F.col("l_linenumber") % 4
    return rules.phase_unbalance(table(spark, d, "lineitem"), "l_orderkey", phase, qty(), three_phase=phase == 3)


@query("""WITH m AS (SELECT l_orderkey, min(CAST(l_quantity AS BIGINT)) AS least_incomer FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS amps, least_incomer FROM lineitem JOIN m USING (l_orderkey) WHERE l_linenumber <> 1 AND CAST(l_quantity AS BIGINT) > least_incomer""")
def cascade_min(spark, d):
    return rules.cascade(table(spark, d, "lineitem"), "l_orderkey", F.col("l_linenumber") == 1, qty()).select("l_orderkey", "l_linenumber", "l_partkey", qty().alias("amps"), "least_incomer")


@query("""SELECT o_orderkey AS l_orderkey, o_orderkey % 5 + 1 AS expected, coalesce(n, 0) AS found FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 5 + 1 <> coalesce(n, 0)""")
def count_mismatch(spark, d):
    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 5 + 1).alias("expected"))
    return rules.count_mismatch(expected, table(spark, d, "lineitem"), ["l_orderkey"])


@query("SELECT n_nationkey, 'JX' || unnest(generate_series(n_nationkey + 1, n_nationkey + 1 + n_regionkey)) AS code FROM nation")
def range_expand(spark, d):
    text = F.concat(F.lit("JX"), (F.col("n_nationkey") + 1).cast("string"), F.lit(" ~ JX"), (F.col("n_nationkey") + 1 + F.col("n_regionkey")).cast("string"))
    return table(spark, d, "nation").select("n_nationkey", F.explode(panels.panel_range(text)).alias("code"))


@query("""WITH d AS (SELECT p_partkey AS item, (p_partkey // 500) || 'JXA' || unnest(generate_series(p_partkey % 500 + 1, p_partkey % 500 + 4)) AS c FROM part), h AS (SELECT DISTINCT (l_partkey // 500) || 'JXA' || (l_partkey % 500) AS c FROM lineitem WHERE l_returnflag = 'A'),
x AS (SELECT item, count(*) AS n_declared, count(h.c) AS n_matched, coalesce(string_agg(CASE WHEN h.c IS NULL THEN d.c END, ',' ORDER BY d.c), '') AS missing FROM d LEFT JOIN h ON d.c = h.c GROUP BY item)
SELECT *, CASE WHEN n_declared = n_matched THEN 'COVERED' WHEN n_matched > 0 THEN 'PARTIAL' ELSE 'MISSING' END AS status FROM x""")
def reconcile_coverage(spark, d):
    # the block number stands before what is read as a code: a block of four digits would make it a long number to the lexer
    block = lambda key: F.expr(f"string({key} div 500)")
    place = lambda more: (F.col("p_partkey") % 500 + more).cast("string")
    codes = panels.panel_range(F.concat(F.lit("JXA"), place(1), F.lit("~"), place(4)))
    declared = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.transform(codes, lambda c: F.concat(block("p_partkey"), c)).alias("codes"))
    found = table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.concat(block("l_partkey"), F.lit("JXA"), (F.col("l_partkey") % 500).cast("string")).alias("code"))
    return rules.coverage(declared, found, "item", "codes", "code")


@query("""SELECT coalesce(a.k, b.k) AS value, CASE WHEN a.k IS NULL THEN 'only_b' WHEN b.k IS NULL THEN 'only_a' ELSE 'both' END AS side FROM (SELECT DISTINCT c_nationkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) b ON a.k = b.k""")
def set_algebra(spark, d):
    return rules.set_algebra(table(spark, d, "customer").select("c_nationkey"), table(spark, d, "supplier").select("s_nationkey"))


@query("""SELECT source, count(*) AS n_rows, (arg_min(text, (-length(text), doc_id))) AS text, arg_min(lang, doc_id) FILTER (WHERE lang <> '') AS lang, count(DISTINCT CASE WHEN lang <> '' THEN lang END) <= 1 AS lang_agreed FROM documents GROUP BY source""")
def survivorship_merge(spark, d):
    return bom.survivors(table(spark, d, "documents").select("doc_id", "source", "text", "lang"), ["source"], F.col("doc_id"), ["text"], ["lang"], ["lang"])


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY text")
def keep_first_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return bom.first_by(docs, ["digest"], [F.col("doc_id")])


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1")
def tile_merge_interior(spark, d):
    return bom.first_by(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("value"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("""WITH x AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_retailprice, p_partkey) = 1), f AS (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) = 1),
q AS (SELECT l_orderkey, l_linenumber, l_partkey, p_brand AS b, p_type AS t, CAST(l_quantity AS INTEGER) AS s FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN x.p_partkey IS NOT NULL THEN 'exact' WHEN f.p_partkey IS NOT NULL THEN 'feature' ELSE 'none' END AS basis, coalesce(x.p_partkey, f.p_partkey) AS price_key
FROM q LEFT JOIN x ON x.p_brand = b AND x.p_type = t AND x.p_size = s LEFT JOIN f ON f.p_brand = b""")
def price_exact_then_feature(spark, d):
    part = table(spark, d, "part")
    demand = table(spark, d, "lineitem").join(part.select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", "p_type", F.col("l_quantity").cast("int").alias("p_size"))
    out = pricing.exact_then_feature(demand, part, "l_partkey", ["p_brand", "p_type", "p_size"], ["p_brand"], [F.col("p_retailprice"), F.col("p_partkey")])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "basis", F.col("price.p_partkey").alias("price_key"))


@query("""SELECT p_brand, p_partkey, CAST(CASE WHEN p_type = 'ECONOMY' THEN 10 ELSE 0 END + CASE WHEN p_size BETWEEN 10 AND 30 THEN 5 ELSE 0 END AS INTEGER) AS score FROM part
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type = 'ECONOMY' THEN 10 ELSE 0 END + CASE WHEN p_size BETWEEN 10 AND 30 THEN 5 ELSE 0 END DESC, p_retailprice, p_partkey) = 1""")
def top1_scoring(spark, d):
    score = F.when(F.col("p_type") == "ECONOMY", 10).otherwise(0) + F.when(F.col("p_size").between(10, 30), 5).otherwise(0)
    return pricing.top_scored(table(spark, d, "part"), "p_brand", score, [F.col("p_retailprice"), F.col("p_partkey")]).select("p_brand", "p_partkey", "score")


@query("""SELECT p_partkey, CASE WHEN p_size <= 6 THEN 6 WHEN p_size <= 16 THEN 16 WHEN p_size <= 32 THEN 32 ELSE 40 END AS at_least,
(SELECT arg_min(t, (abs(p_size - t), i)) FROM (VALUES (6, 1), (16, 2), (32, 3), (40, 4)) v(t, i)) AS nearest FROM part""")
def nearest_tier(spark, d):
    tiers = [6, 16, 32, 40]
    return table(spark, d, "part").select("p_partkey", C.tier_at_least(F.col("p_size"), tiers).alias("at_least"), C.nearest_tier(F.col("p_size"), tiers).alias("nearest"))


@query(f"""WITH m AS (SELECT l_orderkey, sum({CENTS.format('l_extendedprice')})::BIGINT AS material FROM lineitem GROUP BY 1), a AS (SELECT *, material * 65 // 1000 AS auxiliary FROM m), t AS (SELECT *, (material + auxiliary) * 108 // 100 AS net FROM a)
SELECT l_orderkey, material, auxiliary::BIGINT AS auxiliary, net::BIGINT AS net, (net * 113 // 100)::BIGINT AS gross FROM t""")
def quotation_ab(spark, d):
    return pricing.quotation(table(spark, d, "lineitem"), ["l_orderkey"], cents("l_extendedprice"), {"auxiliary": "material * 65 div 1000", "net": "(material + auxiliary) * 108 div 100", "gross": "net * 113 div 100"})


@query(f"""SELECT user_id, count(*) AS calls, sum(CASE WHEN event_type <> 'error' THEN {CENTS.format('value')} ELSE 0 END)::BIGINT AS amount, count(*) FILTER (WHERE event_type <> 'error') AS priced, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources FROM events GROUP BY user_id""")
def ledger_totals(spark, d):
    return store.ledger_totals(table(spark, d, "events"), ["user_id"], cents("value"), F.col("event_type") != "error", "event_type")


@query(f"SELECT count(*) AS calls, sum(v)::BIGINT AS amount FROM (SELECT {CENTS.format('value')} AS v FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)")
def latest_500_total(spark, d):
    return store.latest_total(table(spark, d, "events"), 500, [F.desc("ts"), F.desc("event_id")], cents("value"))


@query("""WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1 ELSE o_custkey END AS c FROM orders WHERE o_orderkey % 13 <> 0 UNION ALL SELECT -o_orderkey - 1, 'N', o_custkey FROM orders WHERE o_orderkey % 1000 = 0),
j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.o_orderkey AS a, n.o_orderkey AS b, o_orderstatus, s, o_custkey, c FROM orders o FULL JOIN n ON o.o_orderkey = n.o_orderkey)
SELECT o_orderkey, '*' AS field, NULL::VARCHAR AS old, NULL::VARCHAR AS new, CASE WHEN b IS NULL THEN 'remove' ELSE 'add' END AS change FROM j WHERE a IS NULL OR b IS NULL
UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus, s, 'update' FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND o_orderstatus <> s
UNION ALL SELECT o_orderkey, 'o_custkey', o_custkey::VARCHAR, c::VARCHAR, 'update' FROM j WHERE a IS NOT NULL AND b IS NOT NULL AND o_custkey <> c""")
def row_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    k = F.col("o_orderkey")
    new = o.where(k % 13 != 0).select("o_orderkey", F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 11 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"))
    new = new.unionByName(o.where(k % 1000 == 0).select((-k - 1).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_custkey"))
    return store.row_diff(o, new, "o_orderkey", ["o_orderstatus", "o_custkey"])


@query("SELECT event_id, lead(1) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) IS NULL AS can_revert FROM events")
def revert_guard(spark, d):
    return store.revertible(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "can_revert")


@query("""SELECT coalesce(o.o_orderkey, n.k) AS o_orderkey, CASE WHEN n.k IS NOT NULL AND NOT (o.o_orderkey IS NOT NULL AND n.s = '') THEN n.s ELSE o.o_orderstatus END AS o_orderstatus
FROM orders o FULL JOIN (SELECT o_orderkey + (SELECT max(o_orderkey) * 9 // 10 FROM orders) AS k, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'U' END AS s FROM orders) n ON o.o_orderkey = n.k""")
def upsert_keeps_filled(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    shift = old.agg(F.max("o_orderkey")).first()[0] * 9 // 10
    new = old.select((F.col("o_orderkey") + shift).alias("o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("U").alias("o_orderstatus"))
    return store.upsert(old, new, "o_orderkey", {"o_orderstatus": F.col("n_o_orderstatus") == ""})


def _tree(spark, d):
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    s = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edges = r.select(s("R", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    return edges.unionByName(n.select(s("N", "n_nationkey").alias("node"), s("R", "n_regionkey").alias("parent"))).unionByName(c.select(s("C", "c_custkey").alias("node"), s("N", "c_nationkey").alias("parent")))


_TREE_SQL = """e AS (SELECT 'R' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer),
t AS (SELECT node, parent, 0 AS depth, [node] AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.node, e.parent, t.depth + 1, list_append(t.path, e.node) FROM e JOIN t ON e.parent = t.node WHERE t.depth < 6)"""


@query(f"WITH RECURSIVE {_TREE_SQL} SELECT node, parent, depth, array_to_string(path, '>') AS path FROM t")
def tree_of_nodes(spark, d):
    return hierarchy.tree_paths(_tree(spark, d)).withColumn("path", F.array_join("path", ">"))


@query(f"""WITH RECURSIVE {_TREE_SQL}, v AS (SELECT 'C' || o_custkey AS node, count(*) AS v FROM orders GROUP BY 1), x AS (SELECT unnest(path) AS node, v FROM t LEFT JOIN v USING (node)) SELECT node, coalesce(sum(v), 0)::BIGINT AS total FROM x GROUP BY node""")
def subtree_rollup(spark, d):
    values = table(spark, d, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("node"), F.lit(1).alias("value"))
    return hierarchy.subtree_sums(hierarchy.tree_paths(_tree(spark, d)), values, "node", "value")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def corroborate_contains(spark, d):
    claims = table(spark, d, "benchmark").select("item_id", F.col("text").alias("claim"))
    return rules.contained(claims, table(spark, d, "documents").select("doc_id", "text"), "claim", "text", "item_id", "doc_id")


@query("""SELECT count(*) FILTER (WHERE g AND p) AS hits, count(*) FILTER (WHERE g) AS gold, count(*) FILTER (WHERE p) AS predicted, count(*) FILTER (WHERE g AND p) / count(*) FILTER (WHERE g) AS recall, count(*) FILTER (WHERE g AND p) / count(*) FILTER (WHERE p) AS precision
FROM (SELECT quality = 0 AS g, contains(text, '|') OR contains(text, '###') AS p FROM labels JOIN documents USING (doc_id))""")
def score_recall(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rules.recall_precision(j, F.col("quality") == 0, F.contains("text", F.lit("|")) | F.contains("text", F.lit("###")))


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON abs(c_acctbal - s_acctbal) <= 20")
def bucket_range_join(spark, d):
    return spatial.near_join(table(spark, d, "customer"), table(spark, d, "supplier"), "c_acctbal", "s_acctbal", 20.0).select("c_custkey", "s_suppkey")


@query("""WITH b AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800000000 THEN 1 ELSE 0 END AS n FROM events)
SELECT event_id, user_id, (sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1)::BIGINT AS island FROM b""")
def gap_islands(spark, d):
    e = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return spatial.islands(e, ["user_id"], "at", 1_800_000_000, ["event_id"]).select("event_id", "user_id", "island")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber * 10 AS lo, l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS hi FROM lineitem), u AS (SELECT l_orderkey, unnest(range(lo, hi)) AS x FROM i), w AS (SELECT DISTINCT l_orderkey, x FROM u),
g AS (SELECT l_orderkey, x, lag(x) OVER (PARTITION BY l_orderkey ORDER BY x) AS p FROM w) SELECT l_orderkey, count(*) FILTER (WHERE p IS NULL OR x > p + 1) AS stretches, count(*) AS covered FROM g GROUP BY 1""")
def interval_cover(spark, d):
    i = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10).cast("long").alias("lo"), (F.col("l_linenumber") * 10 + qty()).alias("hi"))
    return spatial.covered_length(i, ["l_orderkey"], "lo", "hi")


@query("""WITH s AS (SELECT DISTINCT p_brand, p_size FROM part), b AS (SELECT *, CASE WHEN p_size - lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) > 1 THEN 1 ELSE 0 END AS n FROM s) SELECT p_brand, p_size, (sum(n) OVER (PARTITION BY p_brand ORDER BY p_size) + 1)::BIGINT AS island FROM b""")
def cluster_1d(spark, d):
    return spatial.islands(table(spark, d, "part").select("p_brand", "p_size").distinct(), ["p_brand"], "p_size", 1)


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) = 1")
def nearest_in_cluster(spark, d):
    found = spatial.nearest(table(spark, d, "customer"), table(spark, d, "supplier"), "c_custkey", "s_suppkey", [("c_acctbal", "s_acctbal")], [("c_nationkey", "s_nationkey")])
    return found.select("c_custkey", "s_suppkey")


@query(f"SELECT time_bucket(INTERVAL '15 minutes', ts) AS window_start, event_type, count(*) AS calls, sum({CENTS.format('value')})::BIGINT AS amount FROM events GROUP BY ALL")
def tumbling_ledger(spark, d):
    out = ledger.tumbling(_event_stream(spark, d), "ts", "15 minutes", ["event_type"], cents("value"))
    return ledger.drain(out, ["window_start", "event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH b AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM b)
SELECT user_id, min(ts) AS session_start, count(*) AS calls FROM s GROUP BY user_id, s""")
def session_ledger(spark, d):
    out = ledger.sessions(_event_stream(spark, d), "ts", "30 minutes", ["user_id"], cents("value"))
    return ledger.drain(out, ["user_id", "session_start"], "complete").select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "calls")


_STEPS = {"": ("signup",), "signup": ("view", "error"), "view": ("click", "error"), "click": ("purchase", "error"), "purchase": ("signup",), "error": ("signup",)}


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT DISTINCT user_id, 0::BIGINT AS k, '' AS status, 0::BIGINT AS taken, 0::BIGINT AS refused FROM events
UNION ALL SELECT user_id, k, CASE WHEN ok THEN t ELSE status END, taken + CASE WHEN ok THEN 1 ELSE 0 END, refused + CASE WHEN ok THEN 0 ELSE 1 END FROM (SELECT w.user_id, e.k, e.t, status, taken, refused,
(status IN ('', 'purchase', 'error') AND t = 'signup') OR (status = 'signup' AND t IN ('view', 'error')) OR (status = 'view' AND t IN ('click', 'error')) OR (status = 'click' AND t IN ('purchase', 'error')) AS ok FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1))
SELECT user_id, status, taken, refused FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def job_states(spark, d):
    return ledger.drain(ledger.job_states(_event_stream(spark, d), "user_id", "ts", "event_id", "event_type", _STEPS), ["user_id"])


def _event_stream(spark, d):
    return ledger.read_events(spark, f"{d}/events.parquet*", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


@query("SELECT c_nationkey, c_mktsegment, grouping_id(c_nationkey, c_mktsegment) AS level, count(*) AS boxes FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def quotation_summary_rollup(spark, d):
    return table(spark, d, "customer").rollup("c_nationkey", "c_mktsegment").agg(F.grouping_id().alias("level"), F.count("*").alias("boxes"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, regexp_replace(upper(' mcb - ' || l_returnflag || '_' || l_linestatus), '[ _-]', '', 'g') AS form, CASE WHEN l_returnflag = 'A' THEN '''=A' ELSE l_returnflag END AS cell FROM lineitem")
def normal_forms(spark, d):
    raw = F.concat(F.lit(" mcb - "), "l_returnflag", F.lit("_"), "l_linestatus")
    cell = F.when(F.col("l_returnflag") == "A", "=A").otherwise(F.col("l_returnflag"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.match_form(raw).alias("form"), C.safe_cell(cell).alias("cell"))


from . import drawing_queries, project_queries, quote_queries  # noqa: E402, F401  (they add their queries)

"""Project, issue, component and cost operators on the sample tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly, checks, circuits, patches, pricing, projects
from ..sources.tables import table
from .queries import cents, query

PEAK = ((9 * 60, 12 * 60), (14 * 60, 18 * 60))
RATES, PEAK_RATES = (20, 1000, 4000), (40, 2000, 8000)
KINDS = ("ECONOMY", "STANDARD", "PROMO")


@query("""SELECT * FROM (SELECT c_mktsegment AS name, min(c_custkey) AS first FROM customer WHERE c_custkey % 50 = 7 GROUP BY 1)
UNION ALL SELECT c_mktsegment, min(c_custkey) FROM customer WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_custkey % 50 = 7) GROUP BY 1""")
def insert_or_ignore(spark, d):
    all_rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("first"))
    had = all_rows.where("first % 50 = 7").groupBy("name").agg(F.min("first").alias("first"))
    return projects.insert_or_ignore(had, all_rows, "name")


@query("""WITH t AS (SELECT 'projects' AS tbl, n_name AS project FROM nation UNION ALL SELECT 'jobs', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'exports', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT tbl, CASE WHEN project = 'NATION_3' THEN 'NATION_NEW' ELSE project END AS project, count(*) AS n FROM t GROUP BY ALL""")
def rename_cascade(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("project"))
    tables = {"projects": nation, "jobs": table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "exports": table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))}
    tables = projects.rename(tables, "project", "projects", "NATION_3", "NATION_NEW")
    tables = projects.rename(tables, "project", "projects", "NATION_4", "NATION_5")  # the name is taken: nothing changes
    counts = [t.groupBy(F.lit(n).alias("tbl"), "project").agg(F.count("*").alias("n")) for n, t in tables.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR n_name IS NULL THEN 'old' ELSE n_name END AS project, CASE WHEN c_custkey % 5 = 0 THEN 'manual' WHEN n_name IS NULL THEN NULL ELSE 'auto' END AS source
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey > 0""")
def assign_projects(spark, d):
    nation = table(spark, d, "nation").where("n_regionkey > 0").select("n_nationkey", "n_name")
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.lit("old").alias("project"), F.when(F.col("c_custkey") % 5 == 0, "manual").alias("source"))
    return projects.assign(rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"), F.col("n_name")).select("c_custkey", "project", "source")


@query("""SELECT coalesce(p.k, j.k) AS project, coalesce(drawings, 0) AS drawings, coalesce(balance, 0) AS balance, coalesce(open, 0) AS open, coalesce(latest, 0) AS latest
FROM (SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_regionkey <> 2) p FULL JOIN (SELECT c_nationkey::BIGINT AS k, count(*) AS drawings, sum(CAST(round(c_acctbal * 100) AS BIGINT))::BIGINT AS balance, count(*) FILTER (c_mktsegment = 'FURNITURE') AS open, max(c_custkey) AS latest FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1) j ON p.k = j.k""")
def project_totals(spark, d):
    named = table(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").cast("long").alias("project"))
    jobs = table(spark, d, "customer").where("c_nationkey % 3 <> 0").withColumn("project", F.col("c_nationkey").cast("long"))
    totals = {"drawings": F.count("*"), "balance": F.sum(cents("c_acctbal")), "open": F.count_if(F.col("c_mktsegment") == "FURNITURE"), "latest": F.max("c_custkey")}
    return projects.project_totals(named, jobs, "project", totals)


@query("""SELECT p_name AS text, min(p_partkey) AS at FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 9 = 0) GROUP BY 1""")
def issue_sync(spark, d):
    part = table(spark, d, "part").select(F.col("p_name").alias("text"), F.col("p_partkey").alias("at"))
    return projects.new_issues(part.where("at % 9 = 0"), part, "text", "at")


@query("""SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, o_orderdate, o_orderpriority, o_orderkey)::BIGINT AS place FROM orders""")
def issue_order(spark, d):
    return projects.issue_places(table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F", "o_orderdate", "o_orderpriority", "o_orderkey").select("o_orderkey", "o_custkey", "place")


@query("""SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 WHEN 'PROMO' THEN 3 ELSE 4 END, p_name, p_partkey)::BIGINT AS place FROM part""")
def component_order(spark, d):
    return projects.component_places(table(spark, d, "part"), "p_brand", "p_type", KINDS, ["p_name", "p_partkey"]).select("p_partkey", "p_brand", "place")


@query("""SELECT p_partkey, n_nationkey FROM part JOIN nation ON n_nationkey IN (p_partkey % 25, p_partkey % 7, p_size % 25)""")
def components_to_boxes(spark, d):
    code = lambda c: F.concat(F.lit("B"), c.cast("string"))
    used = F.concat(code(F.col("p_partkey") % 25), F.lit("、"), code(F.col("p_partkey") % 7), F.lit(" , "), code(F.col("p_size") % 25))
    boxes = table(spark, d, "nation").select("n_nationkey", code(F.col("n_nationkey")).alias("code"))
    return projects.components_of_boxes(table(spark, d, "part").withColumn("used_in", used), boxes, "used_in", "code").select("p_partkey", "n_nationkey")


@query("""SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'O') AS status, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 3 = 0) AS priority FROM orders GROUP BY 1""")
def first_project_info(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).otherwise("").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("priority"))
    return projects.first_filled(o, "o_custkey", ["status", "priority"], ["o_orderkey"])


@query("""SELECT g.l_orderkey, g.l_linenumber, g.l_partkey, s.o_orderkey AS met FROM
(SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS n FROM lineitem WHERE l_returnflag = 'R') g
LEFT JOIN (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) s ON g.l_suppkey = s.o_custkey AND g.n = s.n""")
def one_to_one_match(spark, d):
    gold = table(spark, d, "lineitem").where("l_returnflag = 'R'").withColumn("key", F.col("l_suppkey"))
    said = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("met"))
    return projects.one_to_one(gold, said, ["key"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], ["met"]).select("l_orderkey", "l_linenumber", "l_partkey", "met")


@query("""SELECT user_id, peak, sum(least(hit, prompt) * CASE WHEN peak THEN 40 ELSE 20 END + (prompt - least(hit, prompt)) * CASE WHEN peak THEN 2000 ELSE 1000 END + done * CASE WHEN peak THEN 8000 ELSE 4000 END)::BIGINT AS cost, count(*) AS calls FROM
(SELECT user_id, event_id % 4000 AS prompt, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 5000 END AS hit, event_id % 700 AS done,
isodow(ts) <= 5 AND (hour(ts) BETWEEN 9 AND 11 OR hour(ts) BETWEEN 14 AND 17) AS peak FROM events) GROUP BY ALL""")
def cost_by_period(spark, d):
    i = F.col("event_id")
    calls = table(spark, d, "events").select("user_id", (i % 4000).alias("prompt"), F.when(i % 3 != 0, i % 5000).alias("hit"), (i % 700).alias("done"), projects.in_peak(F.col("ts"), PEAK).alias("peak"))
    cost = F.when(F.col("peak"), projects.call_cost(F.col("prompt"), F.col("hit"), F.col("done"), PEAK_RATES)).otherwise(projects.call_cost(F.col("prompt"), F.col("hit"), F.col("done"), RATES))
    return calls.groupBy("user_id", "peak").agg(F.sum(cost).alias("cost"), F.count("*").alias("calls"))


@query("""SELECT p_partkey, list_aggregate(list_distinct(regexp_extract_all(p_brand || ' ' || p_name || ' ' || p_brand, '[A-Z][a-z]*#[0-9]+')), 'string_agg', ',') AS marks FROM part""")
def title_markers(spark, d):
    text = F.concat_ws(" ", "p_brand", "p_name", "p_brand")
    return table(spark, d, "part").select("p_partkey", F.array_join(projects.markers(text, "[A-Z][a-z]*#[0-9]+"), ",").alias("marks"))


@query("""SELECT o_custkey, state, count(*) AS n FROM (SELECT o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'reserved' WHEN o_orderstatus NOT IN ('F', 'P') THEN 'active' WHEN o_orderkey % 3 = 0 THEN 'installed_spare' ELSE 'reserved' END AS state FROM orders) GROUP BY ALL""")
def circuit_states(spark, d):
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    load = F.when(status == "F", "备用 回路").when(status == "P", "预留").otherwise("备用照明")
    state = circuits.spare_disposition(load, F.when(key % 5 == 0, "未安装"), F.when(key % 3 == 0, "C65N"), F.lit(None).cast("string"))
    return table(spark, d, "orders").groupBy("o_custkey", state.alias("state")).agg(F.count("*").alias("n"))


@query("""SELECT 'PHASE_INVALID' AS rule_code, 'WARNING' AS severity, p_partkey AS target FROM part WHERE p_size % 6 NOT IN (1, 2, 3)""")
def phase_invalid(spark, d):
    phase = F.concat(F.lit("L"), (F.col("p_size") % 6).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "/N/PE").otherwise(""))
    return table(spark, d, "part").where(~circuits.valid_phase(phase)).select(F.lit("PHASE_INVALID").alias("rule_code"), F.lit("WARNING").alias("severity"), F.col("p_partkey").alias("target"))


_MODELS = """SELECT 'P' || p_partkey AS code, p_brand AS b, p_type AS c, CAST(round(p_retailprice * 100) AS BIGINT) AS price, p_size AS got, p_partkey % 5 = 0 AND p_partkey % 10 <> 0 AS ka10, p_partkey % 3 = 0 AND p_partkey % 10 <> 0 OR p_partkey % 10 = 0 AS curved,
CASE WHEN p_partkey % 10 = 0 THEN 'MCBC' || p_size || 'A' || (p_partkey % 4 + 1) || 'P' ELSE 'M' || CASE p_partkey % 3 WHEN 0 THEN 'C' || p_size WHEN 1 THEN p_size || 'A' ELSE 'D' || p_size END || (p_partkey % 4 + 1) || 'P' || CASE WHEN p_partkey % 5 = 0 THEN '10KA' ELSE '' END END AS norm FROM part"""


@query(f"""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, 'Brand#' || (l_partkey % 27 + 1) AS b, CAST(l_quantity AS BIGINT) AS q, l_linenumber % 4 + 1 AS p, CASE WHEN l_orderkey % 5 = 0 THEN 10 ELSE 6 END AS ka, l_orderkey % 97 = 0 AS noamp, l_orderkey % 89 = 0 AS nospec FROM lineitem),
m AS MATERIALIZED ({_MODELS}), x AS (SELECT b, norm, min(code) AS code, arg_min(price, code) AS price FROM m GROUP BY ALL), f AS (SELECT DISTINCT b, q, p, ka FROM d),
r AS (SELECT f.b, f.q, f.p, f.ka, code, price FROM f JOIN m ON f.b = m.b AND c IN ('ECONOMY', 'STANDARD') AND (norm LIKE '%' || q || 'A%' OR norm LIKE '%C' || q || '%' OR norm LIKE '%D' || q || '%') AND norm LIKE '%' || p || 'P%' AND (f.ka = 6 OR ka10)
QUALIFY row_number() OVER (PARTITION BY f.b, f.q, f.p, f.ka ORDER BY CASE WHEN got = q THEN 25 WHEN abs(got - q) <= 25 THEN 15 WHEN abs(got - q) > 150 THEN -80 ELSE 0 END + CASE WHEN f.ka = 10 AND ka10 THEN 6 ELSE 0 END + CASE WHEN f.p >= 3 AND ka10 THEN 8 ELSE 0 END + CASE WHEN curved THEN 5 ELSE 0 END DESC, price, code) = 1),
l AS (SELECT n_nationkey % 4 + 1 AS lp, [10, 16, 20, 25, 32, 40, 50, 63, 80, 100, 125, 160, 200, 250, 400, 630][n_nationkey + 1] AS la, (n_nationkey + 1) * 1001 AS list FROM nation WHERE n_nationkey < 16),
s AS (SELECT d.*, x.code AS xc, x.price AS xp, r.code AS rc, r.price AS rp, list FROM d LEFT JOIN x ON d.b = x.b AND x.norm = 'MCBC' || q || 'A' || p || 'P' || CASE WHEN d.ka = 10 THEN '10KA' ELSE '' END LEFT JOIN r ON r.b = d.b AND r.q = d.q AND r.p = d.p AND r.ka = d.ka
LEFT JOIN l ON lp = d.p AND la = (SELECT arg_min(t, (abs(d.q - t), t)) FROM (SELECT unnest([10, 16, 20, 25, 32, 40, 50, 63]) AS t)))
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN nospec THEN 'no_spec' WHEN noamp THEN 'no_amps' WHEN xc IS NOT NULL THEN 'exact' WHEN rc IS NOT NULL THEN 'matched' WHEN list IS NOT NULL THEN 'catalogue' ELSE 'unknown' END AS basis,
CASE WHEN NOT nospec AND NOT noamp THEN coalesce(xc, rc) END AS price_code, CAST(CASE WHEN nospec OR noamp THEN 0 ELSE coalesce(xp, rp, (list * 8000 + 10000) // 20000, 0) END AS BIGINT) AS cost FROM s""")
def price_ladder(spark, d):
    k, text = F.col("p_partkey"), lambda c: c.cast("string")
    poles, size = F.concat(text(k % 4 + 1), F.lit("P")), text(F.col("p_size"))
    form = F.when(k % 3 == 0, F.concat(F.lit("C"), size)).when(k % 3 == 1, F.concat(size, F.lit("a"))).otherwise(F.concat(F.lit("D"), size))
    model = F.when(k % 10 == 0, F.concat(F.lit("MCB-C"), size, F.lit("A/"), poles)).otherwise(F.concat(F.lit("M-"), form, F.lit(" "), poles, F.when(k % 5 == 0, " 10kA").otherwise("")))
    prices = table(spark, d, "part").select(F.concat(F.lit("P"), text(k)).alias("code"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), model.alias("model"), F.lit("").alias("remark"), F.round(F.col("p_retailprice") * 100).cast("long").alias("price"))
    o = F.col("l_orderkey")
    spec = F.when(o % 89 == 0, "-").when(o % 97 == 0, "MCB-1P").otherwise(F.concat(F.lit("MCB-C"), text(F.col("l_quantity").cast("long")), F.lit("A/"), text(F.col("l_linenumber") % 4 + 1), F.lit("P"), F.when(o % 5 == 0, " 10kA").otherwise("")))
    demand = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", spec.alias("spec"), F.concat(F.lit("Brand#"), text(F.col("l_partkey") % 27 + 1)).alias("brand"))
    n = F.col("n_nationkey")
    amps = F.get(F.array(*(F.lit(a) for a in pricing.STANDARD_AMPS)), n.cast("int"))
    base = table(spark, d, "nation").where("n_nationkey < 16").select(F.concat(F.lit("MCB-"), text(n % 4 + 1), F.lit("P-"), text(amps), F.lit("A")).alias("key"), ((n + 1) * 1001).cast("long").alias("list_price"))
    return pricing.unit_prices(demand, prices, base, {"MCB": ["ECONOMY", "STANDARD"]}).drop("spec", "brand")


@query("""WITH c AS (SELECT c_nationkey AS job, c_custkey::VARCHAR AS ord, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'W' || c_custkey % 97 END AS no, 'L' || c_custkey % 211 AS name, c_mktsegment AS phase FROM customer),
no AS (SELECT job, no AS target, count(*) AS c, min(ord) AS key, arg_min(phase, ord) AS phase FROM c WHERE no <> '' GROUP BY ALL), nm AS (SELECT job, name AS target, count(*) AS c, min(ord) AS key, arg_min(phase, ord) AS phase FROM c GROUP BY ALL),
p AS (SELECT o_orderkey AS n, o_custkey % 25 AS job, o_orderkey % 7 = 0 AS box, CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'N' || o_custkey % 25 ELSE 'N99' END ELSE CASE o_orderkey % 4 WHEN 0 THEN 'W' || o_orderkey % 97 WHEN 1 THEN 'L' || o_orderkey % 211 WHEN 2 THEN '' ELSE 'W' || o_orderkey % 97 END END AS target,
CASE WHEN o_orderkey % 7 = 0 THEN ['quantity', 'code', 'name'][o_orderkey % 3 + 1] ELSE ['phase', 'breaker', 'box'][o_orderkey % 3 + 1] END AS field, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 14 = 0 AND o_orderkey % 5 = 0 THEN '4.0' ELSE 'BUILDING' END AS value FROM orders),
j AS (SELECT p.*, no.c AS a, nm.c AS b, coalesce(no.key, nm.key) AS key, coalesce(no.phase, nm.phase) AS phase FROM p LEFT JOIN no ON no.job = p.job AND no.target = p.target LEFT JOIN nm ON nm.job = p.job AND nm.target = p.target),
r AS (SELECT *, CASE WHEN box THEN CASE WHEN target = 'N99' THEN 'unknown_box' WHEN field = 'code' THEN 'code_is_fixed' WHEN value = '' THEN 'empty' WHEN field = 'quantity' AND value <> '4.0' THEN 'not_a_number' END
WHEN target = '' THEN 'no_target' WHEN a > 1 THEN 'ambiguous_number' WHEN a IS NULL AND b > 1 THEN 'ambiguous_name' WHEN a IS NULL AND b IS NULL THEN 'unknown_circuit' WHEN field = 'box' THEN 'field' WHEN value = '' THEN 'empty' WHEN field = 'phase' AND phase = value THEN 'unchanged' END AS reason FROM j)
SELECT n, reason, CASE WHEN reason IS NULL THEN CASE WHEN box THEN target ELSE key END END AS key, CASE WHEN reason IS NULL THEN CASE WHEN field = 'quantity' THEN '4' ELSE value END END AS new FROM r""")
def patch_reasons(spark, d):
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    k, o, none = F.col("c_custkey"), F.col("o_orderkey"), F.lit("")
    job = F.col("o_custkey") % 25
    circuits = table(spark, d, "customer").select(F.col("c_nationkey").alias("job"), k.alias("ord"), F.when(k % 3 == 0, "").otherwise(text("W", k % 97)).alias("circuit_no"), F.col("c_mktsegment").alias("phase"), none.alias("breaker"), none.alias("cable"), none.alias("power_kw"), text("L", k % 211).alias("load_name"))
    boxes = table(spark, d, "nation").select(F.col("n_nationkey").alias("job"), text("N", F.col("n_nationkey")).alias("code"), *(none.alias(f) for f in patches.BOX_FIELDS))
    devices = boxes.where("false").select("job", *(none.alias(f) for f in patches.DEVICE_FIELDS))
    is_box = o % 7 == 0
    pick = lambda *names: F.get(F.array(*map(F.lit, names)), (o % 3).cast("int"))
    target = F.when(is_box, F.when(o % 2 == 0, text("N", job)).otherwise("N99")).when(o % 4 == 1, text("L", o % 211)).when(o % 4 == 2, " ").otherwise(text("W", o % 97))
    value = F.when(o % 11 == 0, " ").when((o % 14 == 0) & (o % 5 == 0), "4.0").otherwise(" BUILDING")
    patch = table(spark, d, "orders").select(job.alias("job"), o.alias("n"), F.when(is_box, "box").otherwise("").alias("kind"), none.alias("action"), target.alias("target"), F.when(is_box, pick("quantity", "code", "name")).otherwise(pick("phase", "breaker", "box")).alias("field"), value.alias("value"))
    return patches.judge(patch, circuits, boxes, devices).select("n", "reason", "key", "new")


_ASSEMBLED = """x AS (SELECT c_nationkey AS job, 'B' || c_custkey // 75 AS code, c_custkey AS ord, c_custkey % 4 AS q, c_custkey % 5 <> 0 AS c FROM customer),
n AS (SELECT *, lag(c) OVER w AS before, row_number() OVER w AS k, count(*) OVER (PARTITION BY job, code) AS n FROM x WINDOW w AS (PARTITION BY job, code ORDER BY ord)),
b AS (SELECT job, code, CASE WHEN arg_max(c, ord) THEN arg_max(greatest(q, 1), ord) FILTER (WHERE k = 1 OR (c AND NOT before)) ELSE 1 END AS times, arg_max(c, ord) AS confirmed, count(*) AS n FROM n GROUP BY job, code)"""


@query(f"""WITH {_ASSEMBLED},
c AS (SELECT c_nationkey AS job, 'B' || CASE WHEN o_orderkey % 40 = 0 THEN 999999 ELSE o_custkey // 75 END AS box, o_orderkey AS o FROM orders JOIN customer ON o_custkey = c_custkey),
p AS (SELECT c.*, times, o % 7 = 0 AS spare FROM c JOIN b ON c.job = b.job AND c.box = b.code),
l AS (SELECT job, '配电箱体' AS name, code AS spec, '台' AS unit, times AS q FROM b
UNION ALL SELECT job, '微型断路器', 'MCB-63/C16A/1P', '只', 2 * times FROM p WHERE o % 5 = 0
UNION ALL SELECT job, '双电源自动转换开关', 'ATSE-63A/4P', '只', times FROM p WHERE o % 5 = 0
UNION ALL SELECT job, '微型断路器', 'MCB 1P+N', '只', times FROM p WHERE o % 5 = 1
UNION ALL SELECT job, '剩余电流动作断路器', 'DZ47LE-63/2P', '只', times FROM p WHERE o % 5 = 2
UNION ALL SELECT job, '交流接触器', '145A', '只', 3 * times FROM p WHERE o % 6 = 0
UNION ALL SELECT s_nationkey, '电能表', 'M' || s_suppkey % 3, '块', coalesce(times, 1) FROM supplier LEFT JOIN b ON s_nationkey = b.job AND 'B' || s_suppkey % 20 = b.code)
SELECT job, name, spec, unit, sum(q)::DOUBLE AS quantity FROM l GROUP BY ALL""")
def assembled_components(spark, d):
    return _assembled(spark, d)[0].select("job", "name", "spec", "unit", "quantity")


@query(f"""WITH {_ASSEMBLED} SELECT job, bool_and(confirmed) AS released, coalesce(string_agg(code, ',' ORDER BY first) FILTER (WHERE NOT confirmed), '') AS blocked, count(*) AS boxes, count(*) FILTER (WHERE NOT confirmed) AS reasons FROM b JOIN (SELECT job, code, min(ord) AS first FROM x GROUP BY ALL) USING (job, code) GROUP BY job""")
def release_verdict(spark, d):
    return _assembled(spark, d)[2].select("job", "released", F.array_join("blocked", ",").alias("blocked"), "boxes", F.size("reasons").cast("long").alias("reasons"))


def _assembled(spark, d):
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    k, o, none = F.col("c_custkey"), F.col("o_orderkey"), F.lit("")
    customer = table(spark, d, "customer")
    boxes = customer.select(F.col("c_nationkey").alias("job"), k.alias("ord"), text("B", F.floor(k / 75)).alias("code"), F.lit("箱").alias("name"), none.alias("size"), none.alias("install"), none.alias("ip_rating"), none.alias("location"), (k % 4).alias("quantity"), (k % 5 != 0).alias("quantity_confirmed"))
    breaker = F.when(o % 5 == 0, "MCB-63/C16A/1P×2+ATSE-63A/4P").when(o % 5 == 1, "MCB 1P+N").when(o % 5 == 2, "DZ47LE-63/2P").otherwise("")
    rows = table(spark, d, "orders").join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == k)
    box = F.when(o % 40 == 0, "B999999").otherwise(text("B", F.floor(F.col("o_custkey") / 75)))
    rows = rows.select(F.col("c_nationkey").alias("job"), o.alias("ord"), box.alias("box"), text("W", o).alias("circuit_no"), none.alias("phase"), breaker.alias("breaker"), F.when(o % 6 == 0, "3×145A").otherwise("").alias("contactor"), none.alias("ct"), none.alias("thermal"), F.when(o % 7 == 0, "备用").otherwise("灯").alias("load_name"), none.alias("note"), none.alias("cable"), none.alias("power_kw"))
    s = F.col("s_suppkey")
    devices = table(spark, d, "supplier").select(F.col("s_nationkey").alias("job"), s.alias("ord"), F.lit("电能表").alias("name"), text("M", s % 3).alias("spec"), F.lit("块").alias("unit"), F.lit(1.0).alias("quantity"), F.concat(text("B", s % 20), F.lit(" 进线侧 "), s.cast("string")).alias("used_in"), none.alias("note"))
    return assembly.assemble(boxes, rows, devices)


@query("""WITH b AS (SELECT s_nationkey AS job, s_suppkey AS k, s_suppkey % 5 - 1 AS q FROM supplier), c AS (SELECT c_nationkey AS job, c_custkey AS k, 'B' || c_custkey % 400 AS box, ['L1', 'L2', 'L3', 'XX', ''][c_custkey % 5 + 1] AS phase, 10 * (c_custkey % 9 + 1) AS amps, c_custkey % 6 = 0 AS incoming FROM customer),
p AS (SELECT p_partkey % 25 AS job, p_partkey AS k, p_size - 2 AS q, ['只', '台', '箱'][p_partkey % 3 + 1] AS unit FROM part), i AS (SELECT job, box, min(amps) AS least FROM c WHERE incoming GROUP BY ALL)
SELECT job, 'BOX_QTY_INVALID' AS rule_code, 'ERROR' AS severity, '箱体 B' || k AS target, '箱体 B' || k || ' 数量为 ' || q || '，请核对' AS detail FROM b WHERE q <= 0
UNION ALL SELECT job, 'BOX_NOT_FOUND', 'ERROR', '第 ' || k + 1 || ' 条回路', '第 ' || k + 1 || ' 条回路引用箱体 ' || box || '，箱体清单中未找到，请核对' FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.job = c.job AND 'B' || b.k = c.box)
UNION ALL SELECT job, 'PHASE_INVALID', 'WARNING', '第 ' || k + 1 || ' 条回路', '第 ' || k + 1 || ' 条回路相序“XX”不在常见值中，请对照图纸核对' FROM c WHERE phase = 'XX'
UNION ALL SELECT job, 'COMPONENT_QTY_INVALID', 'ERROR', '第 ' || k + 1 || ' 项元器件', '第 ' || k + 1 || ' 项元器件 电能表 数量无效，请核对' FROM p WHERE q <= 0
UNION ALL SELECT job, 'COMPONENT_UNIT_SUSPECT', 'WARNING', '第 ' || k + 1 || ' 项元器件', '第 ' || k + 1 || ' 项元器件单位“箱”需对照图纸核对' FROM p WHERE unit = '箱'
UNION ALL SELECT job, 'BREAKER_COUNT_MISMATCH', 'WARNING', '断路器 C' || amps || 'A', '断路器 C' || amps || 'A：回路逐条计数 ' || sum(b.q) || ' 只，元器件汇总未找到同规格项，请核对' FROM c JOIN b USING (job) WHERE 'B' || b.k = c.box AND b.q > 0 GROUP BY job, amps
UNION ALL SELECT job, 'CASCADE_OVERCURRENT', 'WARNING', box || ' 出线回路 W' || k, '开关级配核验（' || box || '）：出线 W' || k || ' 额定电流 ' || amps || 'A（C' || amps || 'A）大于进线主开关 ' || least || 'A，存在越级跳闸风险，请核对图纸' FROM c JOIN i USING (job, box) WHERE NOT incoming AND amps > least""")
def named_findings(spark, d):
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    s, k, p = F.col("s_suppkey"), F.col("c_custkey"), F.col("p_partkey")
    at = lambda c, *names: F.get(F.array(*map(F.lit, names)), c.cast("int"))
    boxes = table(spark, d, "supplier").select(F.col("s_nationkey").alias("job"), text("B", s).alias("code"), (s % 5 - 1).alias("quantity"))
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("job"), k.alias("ord"), text("B", k % 400).alias("box"), text("W", k).alias("circuit_no"), at(k % 5, "L1", "L2", "L3", "XX", "").alias("phase"), F.concat(F.lit("C"), (10 * (k % 9 + 1)).cast("string"), F.lit("A")).alias("breaker"), F.lit("").alias("power_kw"), F.when(k % 6 == 0, "进线柜").otherwise("灯").alias("load_name"))
    parts = table(spark, d, "part").select((p % 25).alias("job"), p.alias("ord"), F.lit("电能表").alias("name"), F.lit("M1").alias("spec"), at(p % 3, "只", "台", "箱").alias("unit"), (F.col("p_size") - 2).cast("double").alias("quantity"))
    return checks.all_findings(boxes, rows, parts)


@query("""WITH e AS (SELECT event_type AS t, event_id AS i, ts + INTERVAL 8 HOUR AS l FROM events), c AS (SELECT CASE WHEN t IN ('signup', 'view', 'click') THEN 'deepseek-flash' ELSE t END AS model, t NOT IN ('purchase', 'error') AS known, i % 4000 AS p, least(i % 5000, i % 4000) AS h, i % 700 AS d, isodow(l) <= 5 AND (hour(l) BETWEEN 9 AND 11 OR hour(l) BETWEEN 14 AND 17) AS pk FROM e)
SELECT model, CASE WHEN known THEN 'priced' ELSE 'unavailable' END AS status, known AND pk AS peak, count(*) AS calls, sum(CASE WHEN NOT known THEN 0 WHEN pk THEN h * 40 + (p - h) * 2000 + d * 8000 ELSE h * 20 + (p - h) * 1000 + d * 4000 END)::BIGINT AS cost FROM c GROUP BY ALL""")
def cost_by_model(spark, d):
    i, kind = F.col("event_id"), F.col("event_type")
    model = F.when(kind == "signup", "deepseek-flash").when(kind == "view", " DeepSeek-V4-flash ").when(kind == "click", "deepseek-v4-flash-vision-exp").otherwise(kind)
    card = {"deepseek-flash": {"off_peak": RATES, "peak": PEAK_RATES, "windows": PEAK}}
    cost = projects.model_cost(model, i % 4000, i % 5000, i % 700, F.col("ts").cast("timestamp"), card, {"deepseek-v4-flash": "deepseek-flash", "deepseek-v4-flash-vision-exp": "deepseek-flash"})
    return table(spark, d, "events").select(cost.alias("c")).groupBy("c.model", "c.status", "c.peak").agg(F.count("*").alias("calls"), F.sum("c.cost").alias("cost"))


@query("""SELECT p_brand, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity, coalesce(sum(CASE WHEN p_size > 10 THEN CAST(l_quantity AS BIGINT) END), 0)::BIGINT AS priced, coalesce(sum(CASE WHEN p_size > 10 THEN CAST(l_quantity AS BIGINT) * (p_size - 20) END), 0)::BIGINT AS saved FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def replacement_saving(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return pricing.weighted_saving(lines, ["p_brand"], F.col("l_quantity").cast("long"), F.when(F.col("p_size") > 10, (F.col("p_size") - 20).cast("long")))

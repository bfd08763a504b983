"""Named checks of an extraction: each finding has a job, a rule code, a severity, a target and a detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import specs
from ..functions.columns import code_of
from .circuits import is_incoming, valid_phase

# Units that components may have, names of breakers, marks of three phases, what can be a physical origin, severities by deficit and status.
UNITS = ("只", "台", "套", "米", "块", "个", "组")
BREAKER_NAMES = ("微型断路器", "剩余电流动作断路器", "塑壳断路器", "双电源自动转换开关", "隔离开关", "断路器（其他）")
THREE_PHASES = ("L123", "3P", "3PH", "L1,L2,L3")
PHYSICAL = ("cad_native", "pdf_text", "ocr", "human")
SEVERITIES = {("system", "MISSING"): "ERROR", ("system", "PARTIAL"): "WARNING", ("plan", "MISSING"): "WARNING", ("plan", "PARTIAL"): "INFO"}
UNNAMED_BOX = "未指定箱体"


def _bare(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def _plain(c: Column) -> Column:
    """A number without a needless point."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def _found(df: DataFrame, code: str, severity: str | Column, target: Column, *detail: Column | str) -> DataFrame:
    text = F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in detail))
    return df.select("job", F.lit(code).alias("rule_code"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), target.alias("target"), text.alias("detail"))


def box_findings(boxes: DataFrame) -> DataFrame:
    """Boxes (job, code, quantity) with a quantity that isn't above zero."""
    name = F.concat(F.lit("箱体 "), F.coalesce(F.nullif(F.col("code"), F.lit("")), F.lit("(未编号)")))
    return _found(boxes.where("quantity <= 0"), "BOX_QTY_INVALID", "ERROR", name, name, " 数量为 ", F.col("quantity"), "，请核对")


def circuit_findings(circuits: DataFrame, boxes: DataFrame) -> DataFrame:
    """Circuits (job, ord from 0, box, phase) that refer to no box, and those with a phase that isn't one of the usual marks."""
    place = F.concat(F.lit("第 "), (F.col("ord") + 1).cast("string"), F.lit(" 条回路"))
    named = circuits.withColumn("__code", _bare("box")).where("__code <> ''")
    lost = named.join(boxes.select("job", _bare("code").alias("__code")).distinct(), ["job", "__code"], "left_anti")
    odd = circuits.where((F.coalesce("phase", F.lit("")) != "") & ~valid_phase(F.col("phase")))
    return _found(lost, "BOX_NOT_FOUND", "ERROR", place, place, "引用箱体 ", F.col("__code"), "，箱体清单中未找到，请核对").unionByName(_found(odd, "PHASE_INVALID", "WARNING", place, place, "相序“", F.col("phase"), "”不在常见值中，请对照图纸核对"))


def component_findings(components: DataFrame) -> DataFrame:
    """Components (job, ord from 0, name, spec, unit, quantity) whose quantity isn't a number above zero, and those with an unusual unit."""
    place = F.concat(F.lit("第 "), (F.col("ord") + 1).cast("string"), F.lit(" 项元器件"))
    label = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("spec"), F.lit("")), F.lit("(未命名)"))
    good = F.coalesce((F.col("quantity") > 0) & ~F.isnan(F.col("quantity").cast("double")) & (F.col("quantity") < float("inf")), F.lit(False))
    unit = F.coalesce("unit", F.lit(""))
    return _found(components.where(~good), "COMPONENT_QTY_INVALID", "ERROR", place, place, " ", label, " 数量无效，请核对").unionByName(_found(components.where((unit != "") & ~unit.isin(*UNITS)), "COMPONENT_UNIT_SUSPECT", "WARNING", place, place, "单位“", unit, "”需对照图纸核对"))


def breaker_findings(circuits: DataFrame, boxes: DataFrame, components: DataFrame) -> DataFrame:
    """Breakers whose count over circuits, times their boxes, isn't the components' quantity; specifications are compared without blanks and case."""
    times = boxes.where("quantity > 0").groupBy("job", _bare("code").alias("__code")).agg(F.max("quantity").alias("__times"))
    said = circuits.withColumn("__code", _bare("box")).join(times, ["job", "__code"]).select("job", "__times", F.explode(specs.devices(F.coalesce("breaker", F.lit("")), combos=True)).alias("d"))
    expected = said.groupBy("job", code_of(F.col("d.spec")).alias("spec")).agg(F.sum(F.col("d.count") * F.col("__times")).alias("expected"))
    actual = components.where(F.col("name").isin(*BREAKER_NAMES) & (_bare("spec") != "")).groupBy("job", code_of(F.col("spec")).alias("spec")).agg(F.sum("quantity").alias("actual"))
    off = expected.join(actual, ["job", "spec"], "left").where("actual IS NULL OR actual <> expected")
    target = F.concat(F.lit("断路器 "), "spec")
    rest = F.when(F.col("actual").isNull(), "未找到同规格项，请核对").otherwise(F.concat(F.lit(" "), _plain(F.col("actual")), F.lit(" 只，请核对")))
    return _found(off, "BREAKER_COUNT_MISMATCH", "WARNING", target, target, "：回路逐条计数 ", _plain(F.col("expected")), " 只，元器件汇总", rest)


def load_findings(circuits: DataFrame, percent: float = 15, least: float = 1) -> DataFrame:
    """Boxes whose three phase loads are all above zero, the largest over least kW, and off by over percent of it; a three-phase load lies on each phase with a third."""
    box = F.coalesce(F.nullif(_bare("box"), F.lit("")), F.lit(UNNAMED_BOX))
    kw, phase = F.regexp_extract(F.coalesce("power_kw", F.lit("")), "([0-9]+(?:[.][0-9]+)?)", 1).try_cast("decimal(18,4)"), F.upper(_bare("phase"))
    on = [F.coalesce(F.sum(F.when(phase == p, kw * 3).when(phase.isin(*THREE_PHASES), kw)), F.lit(0)).alias(p) for p in ("L1", "L2", "L3")]
    sums = circuits.groupBy("job", box.alias("__box")).agg(*on)
    high, low = F.greatest("L1", "L2", "L3"), F.least("L1", "L2", "L3")
    off = sums.where((low > 0) & (high > 3 * least) & ((high - low) * 100 > high * percent))
    third = lambda c: F.format_string("%.1f", (F.col(c) / 3).cast("double"))
    prefix = F.when(F.col("__box") != UNNAMED_BOX, F.concat(F.lit("（"), "__box", F.lit("）"))).otherwise("")
    share = F.format_string("%.1f", ((high - low) * 100 / high).cast("double"))
    return _found(off, "PHASE_UNBALANCE", "WARNING", F.concat("__box", F.lit(" 三相负荷平衡")), "三相负荷平衡核验", prefix, "：L1=", third("L1"), "kW, L2=", third("L2"), "kW, L3=", third("L3"), "kW，三相负荷不平衡度达 ", share, "%（超出国标15%限值），存在偏载风险，请核对配电分配")


def cascade_findings(circuits: DataFrame) -> DataFrame:
    """Outgoing breakers of a box with a larger current than the least of its incoming ones."""
    rated = circuits.select("job", F.coalesce(F.nullif(_bare("box"), F.lit("")), F.lit(UNNAMED_BOX)).alias("__box"), F.coalesce(F.nullif(F.col("circuit_no"), F.lit("")), F.lit("出线回路")).alias("no"), "breaker", specs.rated_amps(F.col("breaker")).alias("amps"), is_incoming(F.col("circuit_no"), F.col("load_name")).alias("incoming")).where("amps > 0")
    least = rated.where("incoming").groupBy("job", "__box").agg(F.min("amps").alias("least"))
    over = rated.where("NOT incoming").join(least, ["job", "__box"]).where("amps > least")
    prefix = F.when(F.col("__box") != UNNAMED_BOX, F.concat(F.lit("（"), "__box", F.lit("）"))).otherwise("")
    return _found(over, "CASCADE_OVERCURRENT", "WARNING", F.concat("__box", F.lit(" 出线回路 "), "no"), "开关级配核验", prefix, "：出线 ", F.col("no"), " 额定电流 ", _plain(F.col("amps")), "A（", F.col("breaker"), "）大于进线主开关 ", _plain(F.col("least")), "A，存在越级跳闸风险，请核对图纸")


def evidence_findings(evidence: DataFrame, claims: DataFrame, policy: DataFrame) -> DataFrame:
    """Evidence of a type that its field doesn't allow, and claims marked as confirmed that no physical evidence bears out.

    evidence: job, evidence_id, evidence_type, origin; claims: job, field_path, value_evidence_ids, review_status; policy: field_path, allowed (array).
    An evidence belongs to the fields whose path is in its id; paths are joined by the id's own runs of two dotted words.
    """
    words = F.split("evidence_id", "[.]")
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.concat_ws(".", F.get(words, i), F.get(words, i + 1)))
    of_fields = evidence.withColumn("__path", F.explode(F.array_distinct(pairs))).join(policy.withColumnRenamed("field_path", "__path"), "__path").where(~F.array_contains("allowed", F.col("evidence_type")))
    bad = _found(of_fields, "EVIDENCE_POLICY_VIOLATION", "ERROR", F.col("__path"), "【证据违规拦截】字段 '", F.col("__path"), "' (证据 ", F.col("evidence_id"), ") 仅含 '", F.col("evidence_type"), "' 证据，违反证据政策，严禁无据臆测！")
    sure = claims.where("review_status = 'CONFIRMED'").withColumn("__claim", F.struct("field_path", "value_evidence_ids"))
    used = sure.select("job", "__claim", "field_path", F.explode_outer("value_evidence_ids").alias("evidence_id")).join(evidence.select("job", "evidence_id", "origin"), ["job", "evidence_id"], "left")
    origins = used.groupBy("job", "__claim", "field_path").agg(F.array_sort(F.collect_set("origin")).alias("o")).where(~F.exists("o", lambda o: o.isin(*PHYSICAL)))
    names = F.when(F.size("o") == 0, "无").otherwise(F.array_join("o", ", "))
    return bad.unionByName(_found(origins, "EVIDENCE_STATUS_MISMATCH", "WARNING", F.col("field_path"), "【证据状态不符】字段 '", F.col("field_path"), "' 被标为已确认，但支撑证据来源只有 ", names, "，缺少独立于模型自述的物理证据"))


def catalogue_findings(items: DataFrame, sample: int = 5) -> DataFrame:
    """Declared panels that weren't found: items are job, sheet_title, deficit (system or plan), status and missing (array); the severity comes from deficit and status, a detail names the first few."""
    open_items = items.where((F.size("missing") > 0) & F.col("status").isin("MISSING", "PARTIAL"))
    severity = reduce(lambda out, kv: F.when((F.col("deficit") == kv[0][0]) & (F.col("status") == kv[0][1]), kv[1]).otherwise(out), SEVERITIES.items(), F.lit("INFO"))
    n = F.size("missing")
    panels = F.concat(F.array_join(F.slice("missing", 1, sample), ", "), F.when(n > sample, F.concat(F.lit(" 等共 "), n.cast("string"), F.lit(" 台"))).otherwise(F.concat(F.lit(" (共 "), n.cast("string"), F.lit(" 台)"))))
    what = F.when(F.col("deficit") == "plan", "【目录声明、图面未切出单元】").when(F.col("status") == "MISSING", "【范围缺失】").otherwise("【部分缺失】")
    found = _found(open_items, "", severity, F.lit("图纸目录对账"), what, "《", F.coalesce("sheet_title", F.lit("")), "》[", panels, "]")
    return found.withColumn("rule_code", F.when(F.col("severity") == "ERROR", "CATALOG_RANGE_MISSING").otherwise("CATALOG_RANGE_PARTIAL"))


def all_findings(boxes: DataFrame, circuits: DataFrame, components: DataFrame) -> DataFrame:
    """The findings about boxes, circuits and components."""
    return reduce(DataFrame.unionByName, [box_findings(boxes), circuit_findings(circuits, boxes), component_findings(components), breaker_findings(circuits, boxes, components), load_findings(circuits), cascade_findings(circuits)])

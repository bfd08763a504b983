"""The bill of material of extracted boxes, circuits and devices: merged boxes, devices times boxes, issues, and the release verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import specs
from . import bom, circuits

# Names that are no box, codes of other things, notes, issue texts and titles.
GENERIC_BOXES = ("控制箱", "排烟风机控制箱", "消防控制箱", "配电箱", "动力箱", "照明箱", "照明配电箱", "动力配电箱", "空压机控制箱", "控制箱体", "二次控制箱", "就地控制箱")
NOT_BOXES = ("PY-", "BP-", "XF-", "AKPM")
CANDIDATE, UNCONFIRMED, INSTALLED_SPARE = "单箱候选，项目总量未放行", "图面未标明台数，已保留单箱候选，项目总量未放行", "已安装备用，按一件器件计入，极数不另乘"
AS_WRITTEN, NO_SPEC, BOX_NAME, BOX_UNIT, DEVICE_UNIT = "图纸写法无法安全拆分，按原文计入，数量待人工确认", "(规格未标注)", "配电箱体", "台", "只"
DEVICES = (("contactor", "交流接触器"), ("ct", "电流互感器"), ("thermal", "热继电器"))


def _bare(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def real_box(code: Column, name: Column) -> Column:
    """A code with a letter or digit that is no general term and doesn't begin like another thing's; the name stands in for no code."""
    return ~F.upper(code).rlike("^(?:" + "|".join(NOT_BOXES) + ")") & ~code.isin(*GENERIC_BOXES) & ((code != "") | ((name != "") & ~name.isin(*GENERIC_BOXES))) & code.rlike("[A-Za-z0-9]")


def merged_boxes(boxes: DataFrame) -> DataFrame:
    """(job, code, name, size, install, ip_rating, location, quantity, confirmed, ord, places): one row per box code.

    The longest name and the first of each other text stay. Sightings (rows of one code, in the order of ord) are walked: one at another
    place takes the confirmation away (places lists the pair); a confirmed one confirms an unconfirmed box with its own
    quantity; an unconfirmed one takes the confirmation away. A quantity is whole and one at least. Only the sightings of
    one code are folded together.
    """
    rows = boxes.withColumns({"code": _bare("code"), "__name": _bare("name")}).where(real_box(F.col("code"), F.col("__name")))
    whole = F.greatest(F.coalesce(F.col("quantity").try_cast("double").cast("long"), F.lit(1)), F.lit(1).cast("long"))
    seen = F.struct("ord", _bare("location").alias("place"), whole.alias("q"), F.coalesce(F.col("quantity_confirmed"), F.lit(True)).alias("c"))
    start = F.struct(F.lit("").alias("place"), F.lit(1).cast("long").alias("q"), F.lit(True).alias("c"), F.lit(False).alias("begun"), F.array().cast("array<string>").alias("places"))

    def step(s: Column, r: Column) -> Column:
        place = F.when(s["place"] == "", r["place"]).otherwise(s["place"])
        apart = (r["place"] != "") & (place != r["place"])
        pair = F.concat(place, F.lit(" / "), r["place"])
        first = F.struct(r["place"].alias("place"), r["q"].alias("q"), r["c"].alias("c"), F.lit(True).alias("begun"), s["places"].alias("places"))
        later = F.struct(place.alias("place"), F.when(~apart & r["c"] & ~s["c"], r["q"]).otherwise(s["q"]).alias("q"), (~apart & r["c"]).alias("c"), F.lit(True).alias("begun"), F.when(apart & ~F.array_contains(s["places"], pair), F.array_append(s["places"], pair)).otherwise(s["places"]).alias("places"))
        return F.when(s["begun"], later).otherwise(first)

    fold = F.aggregate(F.array_sort(F.collect_list(seen)), start, step)
    filled = lambda c: F.coalesce(F.min_by(F.when(_bare(c) != "", F.col(c)), F.when(_bare(c) != "", F.col("ord"))), F.lit("")).alias(c)
    name = F.coalesce(F.min_by("name", F.struct(-F.char_length(F.coalesce("name", F.lit(""))), "ord")), F.lit("")).alias("name")
    out = rows.groupBy("job", "code").agg(name, *map(filled, ("size", "install", "ip_rating", "location")), fold.alias("f"), F.min("ord").alias("ord"))
    return out.select("job", "code", "name", "size", "install", "ip_rating", "location", F.col("f.q").alias("quantity"), F.col("f.c").alias("confirmed"), "ord", F.col("f.places").alias("places"))


def distinct_circuits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): numbered circuits that agree in box, number, phase, breaker, load, cable and power are one, the first; those without a number all stay (see bom.merge_sightings for their places)."""
    same = ["job", *(_bare(c) for c in ("box", "circuit_no", "phase", "breaker", "load_name", "cable", "power_kw"))]
    key = F.when(_bare("circuit_no") != "", F.lit(0)).otherwise(F.col("ord"))
    placed = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*same, key).orderBy("ord")))
    return placed.where("__n = 1").drop("__n"), placed.where("__n > 1").drop("__n")


def _notes(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*(F.nullif(p, F.lit("")) for p in parts))), "；")


def lines(boxes: DataFrame, kept: DataFrame, devices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, issues) of merged boxes, circuits and devices outside circuits.

    A line is job, name, spec, unit, quantity, used_in, note, place (an order). A box counts its confirmed quantity, an unconfirmed one counts one and
    says so. A circuit whose box isn't known, or that is reserved, counts nothing and is an issue. A device text that can't be
    split safely stays as one line as written, and is an issue. A device outside circuits is multiplied by the box that its used_in
    names, alone or before a blank (the box with the least ord of several); without a specification it stays as written.
    """
    times = F.when(F.col("confirmed"), F.col("quantity")).otherwise(1).cast("long")
    candidate = F.when(F.col("confirmed"), "").otherwise(CANDIDATE)
    known = boxes.select("job", "code", F.col("ord").alias("box_ord"), times.alias("times"), candidate.alias("candidate"), "confirmed", "size", "ip_rating", "install", "places")
    at = lambda *cols: F.struct(*(c.cast("long").alias(f"p{i}") for i, c in enumerate(cols)))
    zero = F.lit(0)
    of_boxes = known.select("job", F.lit(BOX_NAME).alias("name"), F.trim(F.concat_ws(" ", "code", "size")).alias("spec"), F.lit(BOX_UNIT).alias("unit"), F.col("times").cast("double").alias("quantity"), F.col("code").alias("used_in"), F.array_join(F.array_compact(F.array(*(F.nullif(F.col(c), F.lit("")) for c in ("ip_rating", "install", "candidate")))), "，").alias("note"), at(zero, F.col("box_ord"), zero, zero).alias("place"))
    issue = lambda df, kind, text: df.select("job", F.lit(kind).alias("kind"), text.alias("text"))
    issues = issue(known.where("NOT confirmed"), "quantity", F.concat("code", F.lit(f"：{UNCONFIRMED}")))
    issues = issues.unionByName(issue(known.withColumn("pair", F.explode("places")), "location", F.concat("code", F.lit("：同一箱号出现在不同安装位置（"), "pair", F.lit("），不能按箱号合并成确认总量"))))

    placed = kept.withColumn("__box", _bare("box")).join(known.select(F.col("job").alias("__j"), F.col("code").alias("__c"), "times", "candidate"), (F.col("job") == F.col("__j")) & (F.col("__box") == F.col("__c")), "left")
    label = circuits.circuit_label(F.col("circuit_no"), F.col("load_name"), F.col("phase"))
    placed = placed.withColumns({"label": label, "where": F.concat_ws(" ", "__box", label), "state": circuits.spare_disposition(F.col("load_name"), F.col("note"), F.col("breaker"), F.col("contactor"))})
    issues = issues.unionByName(issue(placed.where("times IS NULL"), "box", F.concat(F.lit("回路 "), "label", F.lit(": 箱体 "), F.coalesce(F.nullif(F.col("__box"), F.lit("")), F.lit("(未标注)")), F.lit(" 数量无法确认，未计入元器件汇总"))))
    counted = placed.where("times IS NOT NULL")
    issues = issues.unionByName(issue(counted.where("state = 'reserved'"), "spare", F.concat(F.lit("回路 "), "where", F.lit(": 标明备用或预留，没有已安装器件规格，不计入采购数量"))))
    spare = F.when(F.col("state") == "installed_spare", INSTALLED_SPARE).otherwise("")
    texts = F.array(F.struct(F.lit("").alias("name"), _bare("breaker").alias("text"), specs.devices(F.coalesce("breaker", F.lit("")), combos=True).alias("found")), *(F.struct(F.lit(n).alias("name"), _bare(c).alias("text"), specs.devices(F.coalesce(F.col(c), F.lit(""))).alias("found")) for c, n in DEVICES))
    each = counted.where("state <> 'reserved'").select("job", "ord", "times", "candidate", "where", spare.alias("spare"), F.posexplode(texts).alias("i", "d")).select("*", "d.name", "d.text", F.col("d.found").isNull().alias("odd"), F.posexplode(F.coalesce("d.found", F.array(F.struct(F.col("d.text").alias("spec"), F.lit(1).cast("long").alias("count"))))).alias("k", "x"))
    name = F.when(F.col("i") > 0, F.col("name")).otherwise(specs.breaker_category(F.col("x.spec")))
    note = _notes(F.when(F.col("odd"), AS_WRITTEN).otherwise(""), F.col("spare"), F.col("candidate"))
    of_circuits = each.select("job", name.alias("name"), F.col("x.spec").alias("spec"), F.lit(DEVICE_UNIT).alias("unit"), (F.col("x.count") * F.col("times")).cast("double").alias("quantity"), F.col("where").alias("used_in"), note.alias("note"), at(F.lit(1), F.col("ord"), F.col("i"), F.col("k")).alias("place"))
    issues = issues.unionByName(issue(each.where("odd"), "device", F.concat(F.lit("回路 "), "where", F.lit(": "), name, F.lit(" 的写法“"), "text", F.lit("”无法安全拆分，已按图纸原文计入 1 只/台箱体，数量待人工确认"))))

    first = bom.first_by(devices.withColumns({"name": _bare("name"), "spec": _bare("spec"), "used_in": _bare("used_in")}), ["job", "name", "spec", "used_in"], [F.col("ord")])
    words = F.split("used_in", " ")
    heads = F.array_distinct(F.array_append(F.transform(words, lambda w, i: F.array_join(F.slice(words, 1, i + 1), " ")), F.col("used_in")))
    named = first.select("job", F.col("ord").alias("__o"), F.explode(heads).alias("code")).where("code <> ''").join(known, ["job", "code"]).groupBy(F.col("job").alias("__j"), "__o").agg(F.min_by(F.struct("times", "candidate"), "box_ord").alias("b"))
    extra = first.join(named.withColumnRenamed("__o", "__n"), (F.col("job") == F.col("__j")) & (F.col("ord") == F.col("__n")), "left")
    bare = F.col("spec") == ""
    amount = F.coalesce(F.col("quantity"), F.lit(1.0)) * F.when(bare, 1).otherwise(F.coalesce("b.times", F.lit(1)))
    of_devices = extra.select("job", "name", F.when(bare, NO_SPEC).otherwise(F.col("spec")).alias("spec"), F.coalesce(F.nullif(_bare("unit"), F.lit("")), F.when(bare, "项").otherwise("")).alias("unit"), amount.cast("double").alias("quantity"), "used_in", F.when(bare, AS_WRITTEN).otherwise(_notes(_bare("note"), F.coalesce("b.candidate", F.lit("")))).alias("note"), at(F.lit(2), F.col("ord"), zero, zero).alias("place"))
    issues = issues.unionByName(issue(extra.where(bare), "spec", F.concat(F.lit("非回路设备 "), "name", F.lit(": 规格未标注，已按原文计入，请补全规格后核对"))))
    return of_boxes.unionByName(of_circuits).unionByName(of_devices), issues.distinct()


def components(rows: DataFrame) -> DataFrame:
    """(job, name, spec, unit, quantity, used_in, note): lines with equal name, specification and unit added up, with their places and notes in the order of first sight."""
    return bom.rollup_bom(rows, ["job", "name", "spec", "unit"], F.col("quantity"), {"used_in": "used_in", "note": "note"}, F.col("place"), {"note": "；"})


def release(boxes: DataFrame, issues: DataFrame) -> DataFrame:
    """(job, released, blocked, boxes, total, reasons): a job is released if all its boxes are confirmed; blocked names the others in order, reasons are the issues about quantities and places."""
    per = boxes.groupBy("job").agg(F.array_sort(F.collect_list(F.when(~F.col("confirmed"), F.struct("ord", "code")))).alias("b"), F.count("*").alias("boxes"), F.sum("quantity").alias("total"))
    why = issues.where("kind IN ('quantity', 'location')").groupBy("job").agg(F.array_sort(F.collect_set("text")).alias("reasons"))
    return per.join(why, "job", "left").select("job", (F.size("b") == 0).alias("released"), F.transform("b", lambda x: x["code"]).alias("blocked"), "boxes", "total", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def assemble(boxes: DataFrame, rows: DataFrame, devices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components, issues, release) of boxes (job, ord, code, name, size, install, ip_rating, location, quantity, quantity_confirmed), circuits (job, ord, box,
    circuit_no, phase, breaker, contactor, ct, thermal, load_name, note, cable, power_kw) and devices outside circuits (job, ord, name, spec, unit, quantity, used_in, note)."""
    whole = merged_boxes(boxes)
    kept, dropped = distinct_circuits(rows)
    found, issues = lines(whole, kept, devices)
    twice = dropped.select("job", F.lit("twice").alias("kind"), F.concat(F.lit("疑似重复回路 "), _bare("box"), F.lit(" "), _bare("circuit_no"), F.lit("（断路器 "), _bare("breaker"), F.lit("）已去重保留一条，请核对")).alias("text"))
    issues = issues.unionByName(twice.distinct())
    return components(found), issues, release(whole, issues)

"""Whole quotations of boxes: sheet-metal enclosure, copper bars, priced components, two models of cost, brands side by side. Money is whole cents, half cents go up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import case_of
from .pricing import features, unit_prices

# Folds added to width and height and to depth (mm); tenths of a back's area by structure; cents a square metre by material and tenths of a millimetre.
FOLD, DEPTH_FOLD = 50, 20
STRUCTURES = {
    "空箱": 15, "安装板": 20, "安装版": 20, "立板": 20, "安装立板": 20, "立板+支架": 28, "立板+封板": 28, "立板+支架+封板": 35, "立板+横梁": 25, "安装板+支架+封板": 35, "安装版+支架+封板": 35, "安装板+帽子": 30, "安装版+帽子": 30,
    "空箱-横梁": 20, "横梁": 20, "隔板": 20, "双门": 28, "带内门": 28, "二层门": 28, "安装板+支架+封板+帽子": 45, "面盖": 0, "单独面盖": 0, "仅门": 0, "门": 0,
}
COLD, STEEL_201, STEEL_304, PLASTIC = "冷轧钢板", "201#不锈钢板", "304#不锈钢板", "塑料面板（PC料，阻燃）"
SHEETS = {COLD: {10: 12300, 12: 12995, 15: 14690, 20: 18080}, STEEL_201: {10: 19500, 12: 23504, 15: 28815, 20: 37290}, STEEL_304: {10: 26500, 12: 30500, 15: 37000, 20: 46000}, PLASTIC: {12: 40500}}
# Surcharges by protection in hundredths, in this order; enclosure prices by the least number of circuits; usual thicknesses in tenths (plastic, floor or tall, small, others).
PREMIUMS = {"IP55": 135, "IP65": 135, "IP44": 115}
CIRCUIT_TIERS = ((25, 145000), (13, 58000), (7, 36000), (0, 22000))
USUAL_PLASTIC, USUAL_TALL, USUAL_SMALL, USUAL = 12, 20, 12, 15
TALL, SMALL = 1600, 450
# Copper at cents a kilogram; bars of boxes up to a current (grams a metre); bars of power cabinets from a current (width, thickness), 12 m of 8.9 g a cubic centimetre; box width and allowances in mm.
COPPER = 7650
BARS = ((100, "TM-20x3", 534), (160, "TM-25x3", 668), (250, "TM-30x4", 1068), (400, "TM-40x4", 1424), (630, "TM-50x5", 2225), (800, "TM-60x6", 3204), (1000, "TM-80x8", 5696), (1250, "TM-100x8", 7120), (1600, "TM-100x10", 8900))
CABINET_BARS = ((1600, 100, 10), (1000, 80, 10), (630, 60, 6), (250, 60, 5), (125, 30, 4), (63, 20, 3))
BAR_METRES, DENSITY_TENTHS, USUAL_WIDTH, MAIN_ALLOWANCE, EARTH_ALLOWANCE, CABINET_FROM = 12, 89, 800, 400, 200, 250
# Rates in thousandths (auxiliaries, certificate, profit, tax; auxiliaries and assembly of the two-rate model), labour in cents, brands.
AUXILIARY, CERTIFICATE, PROFIT, TAX = 65, 20, 80, 130
JOINT_RATES, DOMESTIC_RATES = (120, 183), (167, 197)
LABOUR_IN, LABOUR_OUT = 12000, 4500
JOINT_BRANDS, COMPARED, BENCHMARK, SUBSTITUTE = ("施耐德", "ABB", "西门子"), ("施耐德", "良信", "正泰"), "施耐德", "正泰"
# Words of floor-standing boxes, power cabinets, breakers, incoming circuits, texts that state no breaker.
FLOOR_WORD, FLOOR_TYPES, CABINET_TYPES, BREAKER_WORDS, INCOMING, UNSTATED = "落地", ("GGD", "XL"), ("GGD", "GCK", "MNS", "动力柜"), ("断路器", "开关", "微断"), "进线", ("", "-", "待确认")

#: Columns that a box may have; those that are missing count as null.
BOX_TEXTS = ("name", "size", "structure", "box_type", "type", "install", "note", "material", "thickness", "ip_rating", "main_switch", "incoming_spec", "main_breaker")


def share(amount: Column, part: int | Column, whole: int) -> Column:
    """amount * part / whole in whole numbers, halves up."""
    return F.floor((amount.cast("long") * part + whole // 2) / F.lit(whole).cast("decimal(20,0)")).cast("long")


def _holds(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(words))


def dimensions(text: Column) -> Column:
    """struct(width, height, depth) in mm of the first three numbers of two to four digits with multiplication signs between: the least is the depth; null if there are none."""
    triple = F.regexp_extract(F.coalesce(text, F.lit("")), "[0-9]{2,4}(?:\\s*[*xX×]\\s*[0-9]{2,4}){2}", 0)
    n = F.transform(F.regexp_extract_all(triple, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("long"))
    rest = F.filter(n, lambda x: x != F.array_min(n))
    two = F.when(F.size(rest) == 2, rest).otherwise(F.slice(n, 1, 2))
    return F.when(triple != "", F.struct(two[0].alias("width"), two[1].alias("height"), F.array_min(n).alias("depth")))


def _material(stated: Column, texts: Column) -> Column:
    """A stated material that names a known kind decides, else what all texts say, else cold-rolled sheet."""
    known = _holds(stated, ("冷轧", "不锈钢", "塑料", "PC"))
    said = F.when(known, stated).otherwise(texts)
    plastic = F.when(known, _holds(stated, ("塑料", "PC"))).otherwise(_holds(texts, ("塑料", "PC料", "PC面板")))
    return case_of([(said.contains("304"), STEEL_304), (said.contains("201"), STEEL_201), (said.contains("不锈钢"), STEEL_304), (plastic, PLASTIC)], COLD)


def _structure(stated: Column, texts: Column, large: Column) -> Column:
    """A stated structure of the table decides; else the named parts, those of an upright plate in their order; else what the size asks for."""
    in_order = lambda name: texts.rlike(".*".join(name.split("+")))
    upright = [(in_order(name), name) for name in ("立板+支架+封板", "立板+支架", "立板+横梁", "立板+封板", "立板")]
    full, roofed = "安装板+支架+封板", _holds(texts, ("防雨", "室外")) & _holds(texts, ("帽", "檐"))
    mounted = [
        (texts.contains(full) & _holds(texts, ("防雨", "帽子")), f"{full}+帽子"), (texts.contains(full) | texts.contains("安装版+支架+封板"), full),
        (texts.contains("安装板+帽子") | texts.contains("安装版+帽子") | roofed, "安装板+帽子"),
    ]
    others = [(texts.contains("空箱") & texts.contains("横梁"), "空箱-横梁"), (texts.contains("空箱"), "空箱"), (_holds(texts, ("面盖", "仅门")), "面盖"), (_holds(texts, ("双门", "带内门", "二层门")), "双门"), (texts.contains("横梁"), "横梁")]
    return F.when(stated.isin(*STRUCTURES), stated).otherwise(case_of([*upright, *mounted, *others, (large, full)], "安装板"))


def enclosure(boxes: DataFrame, circuits: str = "n_circuits") -> DataFrame:
    """boxes (see BOX_TEXTS) with width, height, depth, floor, structure_used, material_used, thickness_tenths, enclosure_basis and enclosure.

    With a size the price is the unfolded sheet: back times its structure's share, four sides and door at the material's price
    (basis unfolded). A material or thickness without a price gives 0 and the basis unknown_material, never another one's price.
    Without a size the number of circuits decides (basis circuits). Protection adds its surcharge. Null texts count as empty,
    a null number of circuits as 0.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in boxes.columns else F.lit("") for c in BOX_TEXTS}
    whole = F.concat_ws(" ", *(text[c] for c in ("structure", "box_type", "type", "install", "note", "name", "material")))
    size = dimensions(F.when(text["size"] != "", text["size"]).otherwise(text["box_type"]))
    floor = text["install"].contains(FLOOR_WORD) | _holds(F.upper(text["box_type"]), FLOOR_TYPES)
    out = boxes.withColumns({"__size": size, "floor": floor, "__texts": whole}).withColumns({"width": F.col("__size.width"), "height": F.col("__size.height"), "depth": F.col("__size.depth")})
    longest = F.coalesce(F.greatest("width", "height"), F.lit(0))
    large = F.col("floor") | (longest >= TALL)
    out = out.withColumns({"material_used": _material(F.trim(text["material"]), F.col("__texts")), "structure_used": _structure(F.trim(text["structure"]), F.col("__texts"), large)})
    stated = text["thickness"].try_cast("double")
    named = F.regexp_extract("__texts", "(?i)(?:厚度?|δ|t)\\s*[:=]?\\s*([0-2](?:[.][0-9]+)?)\\s*m", 1).try_cast("double")
    alone = F.regexp_extract("__texts", "(?i)(?<![0-9A-Za-z_.])([12][.][025])\\s*mm(?![0-9A-Za-z_])", 1).try_cast("double")
    usual = case_of([(F.col("material_used") == PLASTIC, USUAL_PLASTIC), (large, USUAL_TALL), (longest <= SMALL, USUAL_SMALL)], USUAL)
    out = out.withColumn("thickness_tenths", F.coalesce(F.round(F.coalesce(F.when(stated > 0, stated), named, alone) * 10, 4), usual.cast("double")))
    price = case_of([((F.col("material_used") == m) & (F.col("thickness_tenths") == t), p) for m, sheets in SHEETS.items() for t, p in sheets.items()], None)
    parts = case_of([(F.col("structure_used") == s, a) for s, a in STRUCTURES.items()], STRUCTURES["安装板"])
    face = (F.col("width") + FOLD) * (F.col("height") + FOLD)
    sides = (F.col("width") + F.col("height") + 2 * FOLD) * (F.col("depth") + DEPTH_FOLD) * 2
    sheet = share(face * parts, price, 10_000_000) + share(sides, price, 1_000_000) + share(face, price, 1_000_000)
    tier = case_of([(F.coalesce(F.col(circuits), F.lit(0)) >= least, p) for least, p in CIRCUIT_TIERS], CIRCUIT_TIERS[-1][1])
    basis = F.when(F.col("__size").isNull(), "circuits").when(price.isNull(), "unknown_material").otherwise("unfolded")
    protection = F.upper(text["ip_rating"])
    premium = case_of([(protection.contains(ip), p) for ip, p in PREMIUMS.items()], 100)
    base = F.when(basis == "circuits", tier).when(basis == "unfolded", sheet).otherwise(0)
    return out.withColumns({"enclosure_basis": basis, "enclosure": share(base, premium, 100)}).drop("__size", "__texts")


def busbar(amps: Column, width_mm: Column, cabinet: Column) -> Column:
    """struct(spec, grams, cost) of the bars for a main current: three phases, neutral and earth along the box, or 12 m of standard bar in power cabinets from CABINET_FROM. No current costs nothing; a current above the table takes its last row."""
    at = lambda i: case_of([(amps <= bar[0], bar[i]) for bar in BARS], BARS[-1][i])
    length = (width_mm + MAIN_ALLOWANCE) * 3 + (width_mm + EARTH_ALLOWANCE) * 2
    along = share(length, at(2), 10_000)  # tens of grams, as a weight is rounded before it is priced
    high = lambda f: case_of([(amps >= bar[0], f(bar)) for bar in CABINET_BARS], f(CABINET_BARS[-1]))
    grams = high(lambda bar: bar[1] * bar[2] * BAR_METRES * DENSITY_TENTHS // 10)
    standard = cabinet & (amps >= CABINET_FROM)
    priced = F.when(
        standard, F.struct(high(lambda bar: f"TM-{bar[1]}x{bar[2]}").alias("spec"), grams.cast("long").alias("grams"), share(grams, COPPER, 1000).alias("cost"))
    ).otherwise(F.struct(at(1).alias("spec"), (along * 10).alias("grams"), share(along, COPPER, 100).alias("cost")))
    nothing = F.struct(F.lit("").alias("spec"), F.lit(0).cast("long").alias("grams"), F.lit(0).cast("long").alias("cost"))
    return F.when(F.coalesce(amps, F.lit(0)) > 0, priced).otherwise(nothing)


def quotations(boxes: DataFrame, circuits: DataFrame, components: DataFrame, prices: DataFrame, base: DataFrame, synonyms: Mapping[str, Sequence[str]], brands: Sequence[str], keys: Sequence[str] = ("job", "code"), profit: int = PROFIT, tax: int = TAX) -> DataFrame:
    """One row per box and brand: (keys..., brand, n_circuits, list of costs, final, ab_* of the two-rate model).

    circuits have keys, kind, circuit_no, load_name, breaker; components have keys, name, spec, quantity (missing or 0: 1). If none of a
    box's components is a breaker by its name, the breakers of its circuits are priced too. Components without a price cost 0
    and are counted in n_open, so no sum hides them. Circuits and components of unknown boxes are left out; a box without
    any is quoted by itself.

    Components are summed per box and specification before they meet the brands, and each different specification is priced
    once per brand.
    """
    keys = list(keys)
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    main = (said("kind") == "incoming") | said("load_name").contains(INCOMING) | said("circuit_no").contains(INCOMING)
    rows = circuits.select(*keys, main.alias("main"), F.trim(said("breaker")).alias("spec"), F.when(main, features(F.trim(said("breaker")))["amps"]).alias("amps"))
    per_box = rows.groupBy(*keys).agg(F.count("*").alias("n_circuits"), F.count_if("main").alias("n_main"), F.max("amps").alias("main_amps"))
    listed = components.select(*keys, _holds(said("name"), BREAKER_WORDS).alias("breaker"), said("spec").alias("spec"), F.coalesce(F.nullif(F.col("quantity").try_cast("double").cast("long"), F.lit(0)), F.lit(1)).alias("quantity"))
    has = listed.groupBy(*keys).agg(F.max("breaker").alias("has"))
    drawn = rows.where(~F.col("spec").isin(*UNSTATED)).select(*keys, "spec", F.lit(1).cast("long").alias("quantity"))
    drawn = drawn.join(has.where("has"), keys, "left_anti")
    needed = listed.select(*keys, "spec", "quantity").unionByName(drawn).groupBy(*keys, "spec").agg(F.sum("quantity").alias("quantity"))
    offered = F.explode(F.array(*map(F.lit, brands))).alias("brand")
    priced = unit_prices(needed.select("*", offered), prices, base, synonyms)
    material = priced.groupBy(*keys, "brand").agg(F.sum(F.col("cost") * F.col("quantity")).alias("material"), F.count_if(F.col("cost") == 0).alias("n_open"))

    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in boxes.columns else F.lit("") for c in BOX_TEXTS}
    noted = F.coalesce(*(features(text[c])["amps"] for c in ("main_switch", "incoming_spec", "main_breaker", "note")))
    known = boxes.join(per_box, keys, "left").fillna(0, ["n_circuits", "n_main"]).withColumn("main_amps", F.coalesce(F.nullif("main_amps", F.lit(0)), noted))
    known = enclosure(known).withColumn("__bar", busbar(F.col("main_amps"), F.coalesce("width", F.lit(USUAL_WIDTH)), _holds(F.upper(text["box_type"]), CABINET_TYPES)))
    out = known.select(*keys, "n_circuits", "n_main", "main_amps", "enclosure_basis", "enclosure", F.col("__bar.spec").alias("bar"), F.col("__bar.grams").alias("bar_grams"), F.col("__bar.cost").alias("busbar"), offered)
    out = out.join(material, [*keys, "brand"], "left").fillna(0, ["material", "n_open"])
    rate = lambda i: F.when(F.col("brand").isin(*JOINT_BRANDS), JOINT_RATES[i]).otherwise(DOMESTIC_RATES[i])
    steps = {
        "auxiliary": share(F.col("material"), AUXILIARY, 1000),
        "labour": F.col("n_main") * LABOUR_IN + (F.col("n_circuits") - F.col("n_main")) * LABOUR_OUT,
        "certificate": share(F.col("enclosure") + F.col("material") + F.col("busbar") + F.col("auxiliary") + F.col("labour"), CERTIFICATE, 1000),
        "factory": F.col("enclosure") + F.col("material") + F.col("busbar") + F.col("auxiliary") + F.col("labour") + F.col("certificate"),
        "final": share(F.col("factory"), (1000 + profit) * (1000 + tax), 1_000_000),
        "ab_auxiliary": share(F.col("material"), rate(0), 1000),
        "ab_assembly": share(F.col("material") + F.col("ab_auxiliary"), rate(1), 1000),
        "ab_total": F.col("material") + F.col("ab_auxiliary") + F.col("ab_assembly") + F.col("enclosure") + F.col("busbar"),
    }
    for name, value in steps.items():
        out = out.withColumn(name, value)
    return out


def brand_matrix(quotes: DataFrame, keys: Sequence[str] = ("job", "code"), brands: Sequence[str] = COMPARED, benchmark: str = BENCHMARK, substitute: str = SUBSTITUTE) -> DataFrame:
    """One row per box: its final price by each brand and saving, the tenths of a percent by which the substitute is below the benchmark (0 where that costs nothing)."""
    wide = quotes.groupBy(*keys).pivot("brand", list(brands)).agg(F.first("final"))
    off = F.col(benchmark) - F.col(substitute)
    saved = F.signum(off).cast("long") * F.floor((F.abs(off) * 2000 + F.col(benchmark)) / (F.col(benchmark) * 2).cast("decimal(30,0)")).cast("long")
    return wide.withColumn("saving", F.when(F.coalesce(F.col(benchmark), F.lit(0)) != 0, saved).otherwise(0))

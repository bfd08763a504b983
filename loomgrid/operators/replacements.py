"""Replacement of devices by a target brand's series, with the saving that the price list proves, and a report over all devices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import specs
from ..functions.columns import case_of
from ..sources.staged import staged
from .pricing import from_library

# Kinds of devices by words of name and specification, in this order.
KIND_WORDS = (
    ("MCB", ("微断", "小型断路器", "MCB", "微型断路器", "空气开关", "空开")), ("MCCB", ("塑壳", "MCCB", "断路器\\s*(?:NM|NSX|CDM|CM1|3VA|XT)")), ("ACB", ("万能式", "框架", "ACB")), ("RCBO", ("漏电", "RCBO", "RCD", "RCB", "VIGI", "残余电流")),
    ("SPD", ("浪涌", "避雷", "SPD", "防雷")), ("KM", ("接触器", "KM", "CJX2", "LC1")), ("ATS", ("双电源", "ATS", "互投")),
)
OTHER = "OTHER"
# Series by brand (plain and high breaking capacity where a kind has both), the brand whose series stand in for a brand without any, frames of moulded-case breakers, leakage current where none is stated (mA).
SERIES = {
    "正泰": {"RCBO": ("NXBLE-63", "NXBLE-63H"), "MCB": ("NXB-63", "NXB-63H"), "MCCB": ("NM8N-{frame}S", "NM8N系列"), "ACB": ("NXA",), "SPD": ("NU6-II",), "KM": ("NC1",), "ATS": ("NZ7",)},
    "良信": {"RCBO": ("NDB1LE-63", "NDB1LE-63"), "MCB": ("NDB1-63", "NDB2-63"), "MCCB": ("NDM1-{frame}S", "NDM1系列"), "ACB": ("NDW1",), "SPD": ("NDY1",), "KM": ("NDC1",), "ATS": ("NDQ1",)},
    "德力西": {"RCBO": ("CDB6LE-63", "CDB6LE-63"), "MCB": ("CDB6i-63", "CDB6H-63"), "MCCB": ("CDM3-{frame}S", "CDM3系列"), "ACB": ("CDW3",), "SPD": ("CDY1",), "KM": ("CJX2s",), "ATS": ("CDQ3",)},
}
FALLBACK, FRAMES, LEAKAGE = "德力西", (125, 250, 400, 630), 30
# Models with a known current and without one; of surge protectors with current and poles, without poles, without both.
MODELS = {
    "MCB": ("{series} {curve}{amps}/{poles}", "{series}系列（待核定电流）"), "RCBO": ("{series} {curve}{amps}/{poles} {leakage}mA", "{series}系列（待核定电流）"), "MCCB": ("{series}/3300 {amps}A {poles}", "{series}（壳架与电流待核定）"), "ACB": ("{series} 智能型框架断路器 {amps}A {poles}", "{series}系列智能型框架断路器（电流待核）"),
    "KM": ("{series}-{amps} 交流接触器", "{series}-?? 交流接触器（电流待核）"), "ATS": ("{series} 双电源自动转换开关 {amps}A {poles}", "{series} 双电源自动转换开关（电流待核）"),
}
SURGE = ("{series}/{surge}kA/{surge_poles} 浪涌保护器", "{series}/{surge}kA 浪涌保护器（极数待核）", "{series}系列 浪涌保护器（放电电流待核）")
GENERIC = "{brand} 优质匹配型号 ({text})"
POLE_WORDS = {"3P": ("3极", "三极"), "4P": ("4极", "四极"), "2P": ("2极", "二极"), "1P": ("1极", "单极")}
SURGE_POLES = (("2P", ("1P", "2P", "单相")), ("4P", ("3P", "4P", "三相")))
#: The kind that a price is looked up as; other kinds have none in the list.
PRICED_AS = {"MCB": "MCB", "RCBO": "MCB", "MCCB": "MCCB"}


def device_kind(text: Column) -> Column:
    """The kind of a device by the first words found, in any case, else OTHER."""
    said = F.upper(F.coalesce(text, F.lit("")))
    return case_of([(said.rlike("|".join(words)), kind) for kind, words in KIND_WORDS], OTHER)


def _filled(template: Column, values: Mapping[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def recommend(devices: DataFrame, prices: DataFrame, synonyms: Mapping[str, Sequence[str]], target: str = "target", series: Mapping[str, Mapping[str, Sequence[str]]] = SERIES) -> DataFrame:
    """devices (name, spec, target brand) with kind, from_brand, series, model, price, target_price (cents), saving (whole percent) and status.

    The model carries the device's own current, poles, curve, leakage current and class of breaking capacity; what the text
    doesn't state is never made up: the model then says what is open. A plain breaker with a leakage current is replaced by a
    leakage breaker. A brand without series uses those of FALLBACK. Prices are the list's, by model, else by features; status
    is cost_saving, cost_equal, cost_increase or, where one of the two is missing, missing_price with a null saving. Half
    percents go up. Each different (name, spec, target) is worked out once; null texts count as empty.
    """
    key = [F.coalesce(F.col(c), F.lit("")).alias(f"__{c}") for c in ("name", "spec")] + [F.col(target).alias("__target")]
    text = F.concat_ws(" ", "__name", "__spec")
    upper = F.upper(text)
    d = devices.select(*key).distinct().withColumn("__p", specs.breaker(text))
    said_poles = F.coalesce(F.col("__p.pole_text"), case_of([(text.rlike("|".join(w)), p) for p, w in POLE_WORDS.items()], None))
    d = d.withColumns({"__kind": device_kind(text), "__amps": F.col("__p.amps").cast("int"), "__poles": F.coalesce(said_poles, F.lit("1P")), "__curve": F.coalesce("__p.curve", F.lit("C")), "__from": specs.brand(text)})
    kind = F.when((F.col("__kind") == "MCB") & F.col("__p.leakage_ma").isNotNull(), "RCBO").otherwise(F.col("__kind"))
    high = upper.rlike("(?<![A-Z0-9.])10\\s*KA?(?![A-Z0-9])|[A-Z0-9][HM](?![A-Z0-9])")
    d = d.withColumns({"__use": kind, "__high": high})
    amps, use, frame = F.col("__amps"), F.col("__use"), case_of([(F.col("__amps") <= f, f) for f in FRAMES], FRAMES[-1])

    def of_brand(table: Mapping[str, Sequence[str]]) -> Column:
        pick = {"MCB": F.col("__high"), "RCBO": F.col("__high"), "MCCB": amps.isNull()}  # when the second name of a kind is meant
        return case_of([((use == k) & pick.get(k, F.lit(False)), names[-1]) for k, names in table.items()] + [(use == k, names[0]) for k, names in table.items()], "")

    named = F.coalesce(*(F.when(F.col("__target") == b, of_brand(t)) for b, t in series.items()), of_brand(series[FALLBACK]))
    d = d.withColumn("series", _filled(named, {"frame": frame}))
    surge, poles = F.nullif(F.regexp_extract(upper, "([0-9]{1,3})\\s*KA?", 1), F.lit("")), case_of([(upper.rlike("|".join(w)), p) for p, w in SURGE_POLES], None)
    template = case_of([((use == k) & amps.isNotNull(), m[0]) for k, m in MODELS.items()] + [(use == k, m[1]) for k, m in MODELS.items()] + [((use == "SPD") & surge.isNotNull() & poles.isNotNull(), SURGE[0]), ((use == "SPD") & surge.isNotNull(), SURGE[1]), (use == "SPD", SURGE[2])], GENERIC)
    shown = F.when((use == "KM") & (amps < 10), F.lpad(amps.cast("string"), 2, "0")).otherwise(amps.cast("string"))
    own = F.when(F.col("__spec") != "", F.col("__spec")).otherwise(F.col("__name"))
    values = {"series": F.col("series"), "curve": F.col("__curve"), "amps": shown, "poles": F.col("__poles"), "leakage": F.coalesce("__p.leakage_ma", F.lit(LEAKAGE)), "surge": surge, "surge_poles": poles, "brand": F.col("__target"), "text": own}
    d = staged(d.withColumn("model", _filled(template, values)))

    priced_as = case_of([(F.col("__kind") == k, c) for k, c in PRICED_AS.items()], OTHER)
    feature = F.struct(priced_as.alias("kind"), F.col("__poles").alias("poles"), F.col("__amps").alias("amps"), F.lit(6).alias("breaking_ka"), F.col("__curve").alias("curve"), F.lit("").alias("release"), F.lit(False).alias("electronic"))
    sides = F.explode(F.array(F.struct(F.col("__from").alias("b"), F.col("__spec").alias("s")), F.struct(F.col("__target").alias("b"), F.col("model").alias("s")))).alias("x")
    asked = d.where("__amps IS NOT NULL").select(feature.alias("__f"), sides).select("__f", F.col("x.b").alias("__brand"), F.col("x.s").alias("__spec")).distinct()
    found = staged(from_library(asked, prices, synonyms).select("__f", "__brand", "__spec", F.coalesce("__exact.price", "__matched.price").alias("p")).where("p IS NOT NULL"))
    for name, b, s in (("price", "__from", "__spec"), ("target_price", "__target", "model")):
        at = found.select(F.col("__f").alias("__g"), F.col("__brand").alias("__b"), F.col("__spec").alias("__s"), F.col("p").alias(name))
        d = d.join(at, (feature == F.col("__g")) & (F.col(b) == F.col("__b")) & (F.col(s) == F.col("__s")), "left").drop("__g", "__b", "__s")
    old, new = F.col("price"), F.col("target_price")
    both = old.isNotNull() & new.isNotNull()
    d = d.withColumns({"price": F.when(both, old), "target_price": F.when(both, new)})
    status = F.when(old.isNull() | new.isNull(), "missing_price").when(new < old, "cost_saving").when(new > old, "cost_increase").otherwise("cost_equal")
    answers = d.select("__name", "__spec", "__target", F.col("__kind").alias("kind"), F.col("__from").alias("from_brand"), "series", "model", "price", "target_price", status.alias("status"))
    answers = answers.withColumn("saving", F.when(F.col("status") == "cost_saving", F.floor((200 * (old - new) + old) / (2 * old).cast("decimal(20,0)"))).when(F.col("status") != "missing_price", 0).cast("long"))
    on = [F.coalesce(F.col(c), F.lit("")) == F.col(f"__{c}") for c in ("name", "spec")] + [F.col(target).eqNullSafe(F.col("__target"))]
    return devices.join(answers, on).drop("__name", "__spec", "__target")


def replacement_report(recommended: DataFrame, keys: Sequence[str], quantity: str = "quantity") -> DataFrame:
    """(keys..., items, total, replaceable, dearer, unquoted, saving): quantities by what the prices prove; saving is the percent over all of them, those without a price included. A missing quantity or zero counts as one."""
    n = F.coalesce(F.nullif(F.col(quantity).cast("double"), F.lit(0.0)), F.lit(1.0))
    of = lambda condition: F.coalesce(F.sum(F.when(condition, n)), F.lit(0.0))
    saved = F.coalesce(F.sum(F.when(F.col("saving") > 0, n * F.col("saving"))), F.lit(0.0))
    out = recommended.groupBy(*keys).agg(F.count("*").alias("items"), F.sum(n).alias("total"), of(F.col("saving") > 0).alias("replaceable"), of(F.col("status") == "cost_increase").alias("dearer"), of(F.col("saving").isNull()).alias("unquoted"), saved.alias("__saved"))
    return out.withColumn("saving", F.when(F.col("total") > 0, F.floor(F.col("__saved") / F.col("total") + 0.5)).otherwise(0).cast("long")).drop("__saved")

"""Price lookup by exact key and then by features, top-scored candidates, and quotations in exact decimals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import nearest_tier, price_form
from ..sources.staged import staged


def exact_then_feature(demand: DataFrame, prices: DataFrame, key: str, exact: Sequence[str], feature: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Each demand row with its price row: by the exact columns, else by the feature columns; basis is exact, feature or none.

    Each side is first reduced to the best row per key, so no join multiplies rows.
    """

    def best(cols: Sequence[str], tag: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*cols).orderBy(*order))
        rows = prices.withColumn("__r", rank).where("__r = 1").drop("__r")
        return rows.select(*(F.col(c).alias(f"__{tag}_{c}") for c in cols), F.struct(*prices.columns).alias(f"__{tag}"))

    def joined(df: DataFrame, cols: Sequence[str], tag: str) -> DataFrame:
        on = [F.col(c) == F.col(f"__{tag}_{c}") for c in cols]
        return df.join(best(cols, tag), on, "left").drop(*(f"__{tag}_{c}" for c in cols))

    out = joined(joined(demand, exact, "x"), feature, "f")
    basis = F.when(F.col("__x").isNotNull(), "exact").when(F.col("__f").isNotNull(), "feature").otherwise("none")
    return out.select(*demand.columns, basis.alias("basis"), F.coalesce("__x", "__f").alias("price"))


def top_scored(candidates: DataFrame, key: str, score: Column, order: Sequence[Column]) -> DataFrame:
    """The candidate with the highest score per key; order settles ties."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(score.desc(), *order))
    return candidates.withColumn("score", score).withColumn("__r", rank).where("__r = 1").drop("__r")


def quotation(lines: DataFrame, keys: Sequence[str], amount: Column, steps: Mapping[str, str]) -> DataFrame:
    """Per key the decimal total of amount and the steps computed from it in turn (SQL expressions over earlier columns)."""
    out = lines.groupBy(*keys).agg(F.sum(amount).alias("material"))
    for name, expr in steps.items():
        out = out.withColumn(name, F.expr(expr))
    return out


def weighted_saving(df: DataFrame, keys: Sequence[str], quantity: Column, saving: Column) -> DataFrame:
    """(keys..., quantity, priced, saved): savings weighted by quantity; quantity counts the rows without a saving too, so they lower the rate."""
    known = F.when(saving.isNotNull(), quantity)
    return df.groupBy(*keys).agg(F.sum(quantity).alias("quantity"), F.coalesce(F.sum(known), F.lit(0)).alias("priced"), F.coalesce(F.sum(known * saving), F.lit(0)).alias("saved"))


# Device kinds by the words a specification holds, in this order; poles and breaking capacity where it states none; discounts in hundredths by brand (breakers up to 125 A, larger ones, transfer switches, multiplier).
KINDS = (("ATS", ("ATS", "双电源")), ("RCBO", ("RCBO", "LE", "VM", "漏电")), ("MCCB", ("MCCB", "NM", "NSX", "塑壳")), ("MCB", ("MCB", "NXB", "IC65", "微断", "(?:^|/)[CD][0-9]")), ("SPD", ("SPD", "浪涌", "避雷")), ("KM", ("KM", "接触器")), ("CT", ("CT", "互感器", "/5")))
KIND_POLES, KIND_BREAKING = {"MCCB": "3P", "KM": "3P", "ATS": "4P", "SPD": "4P"}, {"MCCB": 35}
TIERS = {"施耐德": (40, 38, 45, 100), "ABB": (39, 37, 44, 98), "西门子": (41, 39, 46, 102), "良信": (48, 45, 50, 72), "正泰": (55, 50, 55, 58), "德力西": (53, 48, 52, 55)}
STANDARD_AMPS, FRAMES = (10, 16, 20, 25, 32, 40, 50, 63, 80, 100, 125, 160, 200, 250, 400, 630), {80: 125, 100: 125, 160: 250, 200: 250, 315: 400, 350: 400}
#: Points of a candidate: release code, current equal, near (within 25 A) and far (over 150 A), breaking capacity from 35 and from 10 kA, 10 kA for 3P and 4P, curve, electronic release not asked for, not a special edition.
POINTS = {"release": 20, "equal": 25, "near": 15, "far": -80, "high": 10, "standard": 6, "multi": 8, "curve": 5, "electronic": -15, "ordinary": 5}


def features(spec: Column) -> Column:
    """struct(kind, poles, amps, breaking_ka, curve, release, electronic) of a device text; amps is null where it states no current."""
    s = F.upper(F.regexp_replace(F.coalesce(spec, F.lit("")), "(?U)\\s+", ""))
    number = lambda pattern: F.regexp_extract(s, pattern, 1).try_cast("int")
    kind = F.lit("OTHER")
    for name, words in reversed(KINDS):
        kind = F.when(s.rlike("|".join(words)), name).otherwise(kind)
    of_kind = lambda table, default: F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in table.items()), F.lit(default))
    stated = F.regexp_extract(s, "([0-9])P", 1)
    return F.struct(
        kind.alias("kind"), F.when(stated != "", F.concat(stated, F.lit("P"))).otherwise(of_kind(KIND_POLES, "1P")).alias("poles"), F.coalesce(number("([0-9]{1,4})A"), number("[CD]([0-9]{1,3})")).alias("amps"),
        F.coalesce(number("([0-9]{1,3})KA"), of_kind(KIND_BREAKING, 6)).alias("breaking_ka"), F.when(s.rlike("D(?:16|20|32|型)"), "D").otherwise("C").alias("curve"),
        F.regexp_extract(s, "/(3300|3200|4300|4200)", 1).alias("release"), s.rlike("电子|MIC|ETC|ELECTRONIC").alias("electronic"),
    )


def model_tokens(model: Column) -> Column:
    """What a normalised model can be asked for: a current before A (A16 for ..116A, as a pattern %16A% finds it), after C or D, and frame sizes."""
    ends = lambda runs: F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r)), lambda i: F.concat(F.lit("A"), F.right(r, i)))))
    heads = lambda runs: F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(2), F.char_length(r)), lambda i: F.left(r, i))))
    frames = F.transform(F.filter(F.array(*(F.lit(str(f)) for f in sorted(set(FRAMES.values())))), lambda f: F.contains(model, f)), lambda f: F.concat(F.lit("F"), f))
    return F.array_distinct(F.concat(ends(F.regexp_extract_all(model, F.lit("([0-9]+)A"), F.lit(1))), heads(F.regexp_extract_all(model, F.lit("([CD][0-9]+)"), F.lit(1))), frames))


def asked_tokens(kind: Column, amps: Column) -> Column:
    n = amps.cast("string")
    frame = F.lit(None).cast("string")
    for a, f in FRAMES.items():
        frame = F.when((kind == "MCCB") & (amps == a), f"F{f}").otherwise(frame)
    return F.array_compact(F.array(F.concat(F.lit("A"), n), F.concat(F.lit("C"), n), F.concat(F.lit("D"), n), frame))


def ranked_prices(demand: DataFrame, prices: DataFrame, synonyms: Mapping[str, Sequence[str]]) -> DataFrame:
    """(brand, features..., price struct): for each different brand and features of demand the best price row that fits, if any.

    demand has brand and feature columns (see features); prices has code, brand, category, model, remark, price (whole cents). A price
    row fits if its category holds a synonym of the kind and is no spare part or accessory, its normalised model holds the poles and the
    current in one of its forms, and, where over 6 kA are asked for, its breaking capacity reaches that: too low a one is
    never taken instead. The fitting rows are scored by POINTS, then the cheaper, then the smaller code is the best.

    The patterns are tokens of an index: prices are exploded by the tokens of their model, demand asks for a few, so both meet by
    equal brand and token; what they stand for is then the same as the patterns. Equal demands ask once.
    """
    keys = ["brand", "kind", "poles", "amps", "breaking_ka", "curve", "release", "electronic"]
    asked = demand.select(*keys).where("amps > 0").distinct()
    model, words = price_form(F.col("model")), F.upper(F.concat_ws(" ", "model", "category", "remark"))
    stated = F.regexp_extract(words, "([0-9]{1,3})\\s*KA(?![A-Z0-9])", 1).try_cast("int")
    rows = prices.where((F.col("price") > 0) & ~F.col("category").startswith("零部件") & ~F.contains("category", F.lit("附件"))).select(
        F.col("brand").alias("__brand"), F.struct(*prices.columns).alias("price"), model.alias("__model"), F.col("category").alias("__category"), F.upper("model").alias("__text"),
        F.coalesce(stated, F.when(words.rlike("[A-Z0-9]H(?![A-Z0-9])|高分断"), 10).otherwise(6)).alias("__ka"), F.explode(model_tokens(model)).alias("__token"))
    met = asked.withColumn("__asks", F.explode(asked_tokens(F.col("kind"), F.col("amps")))).join(rows, (F.col("brand") == F.col("__brand")) & (F.col("__asks") == F.col("__token")))
    known = F.lit(False)
    for kind, names in synonyms.items():
        known = known | ((F.col("kind") == kind) & F.col("__category").rlike("|".join(names)))
    known = known | (~F.col("kind").isin(*synonyms) & F.contains("__category", "kind"))
    digit = F.left("poles", F.lit(1))
    poled = F.contains("__model", "poles") | F.contains("__model", F.concat(digit, F.lit("极")))
    fit = met.where(known & poled & ((F.col("breaking_ka") <= 6) | (F.col("__ka") >= F.col("breaking_ka"))))
    has = lambda *parts: F.col("__text").rlike("|".join(parts))
    got = F.coalesce(F.regexp_extract("__text", "([0-9]{1,4})A", 1).try_cast("int"), F.regexp_extract("__text", "[CD]([0-9]{1,3})", 1).try_cast("int"))
    off, ka, p = F.abs(got - F.col("amps")), F.col("breaking_ka"), POINTS
    either = F.col("__text").rlike("电子|ETC|MIC") | F.col("__category").rlike("电子|ETC|MIC")
    score = (
        F.when((F.col("release") != "") & F.contains("__text", "release"), p["release"]).otherwise(0) + F.when(off == 0, p["equal"]).when(off <= 25, p["near"]).when(off > 150, p["far"]).otherwise(0)
        + F.when((ka >= 35) & has("H", "35KA"), p["high"]).when((ka >= 10) & has("H", "10KA"), p["standard"]).otherwise(0)
        + F.when(F.col("poles").isin("3P", "4P") & (F.col("kind") == "MCB") & has("H", "10KA"), p["multi"]).otherwise(0) + F.when(F.contains("__text", "curve"), p["curve"]).otherwise(0)
        + F.when(~F.col("electronic") & either, p["electronic"]).otherwise(0) + F.when(has("专供") | F.contains("__category", F.lit("专供")), 0).otherwise(p["ordinary"])
    )
    best = fit.groupBy(*keys).agg(F.min(F.struct((-score).alias("s"), F.col("price.price").alias("c"), F.col("price.code").alias("k"), F.col("price").alias("row"))).alias("m"))
    return best.select(*keys, F.col("m.row").alias("price"), (-F.col("m.s")).alias("score"))


def from_library(asked: DataFrame, prices: DataFrame, synonyms: Mapping[str, Sequence[str]]) -> DataFrame:
    """asked (__spec, __brand, __f the features or null) with __exact and __matched, struct(code, price) or null.

    __exact is the price row whose normalised model is the specification's, __matched the best one by features, asked only where there is no exact one.
    """
    d = asked.withColumn("__model", price_form(F.col("__spec")))
    exact = prices.where(F.col("price") > 0).groupBy(F.col("brand").alias("__eb"), price_form(F.col("model")).alias("__em")).agg(F.min_by(F.struct("code", "price"), F.struct("code")).alias("__exact"))
    d = d.join(exact, (F.col("__brand") == F.col("__eb")) & (F.col("__model") == F.col("__em")) & F.col("__f.amps").isNotNull(), "left")
    names = ["kind", "poles", "amps", "breaking_ka", "curve", "release", "electronic"]
    open_rows = d.where("__exact IS NULL AND __f IS NOT NULL").select(F.col("__brand").alias("brand"), "__f.*")
    best = ranked_prices(open_rows, prices, synonyms).select(F.col("brand").alias("__mb"), F.struct(*names).alias("__mf"), F.struct("price.code", "price.price").alias("__matched"))
    return d.join(best, (F.col("__brand") == F.col("__mb")) & (F.col("__f") == F.col("__mf")), "left").drop("__eb", "__em", "__mb", "__mf", "__model")


def unit_prices(demand: DataFrame, prices: DataFrame, base: DataFrame, synonyms: Mapping[str, Sequence[str]], spec: str = "spec", brand: str = "brand") -> DataFrame:
    """demand with basis (no_spec, no_amps, exact, matched, catalogue, unknown), price_code and cost (whole cents): the price ladder, which never makes up a price.

    A missing specification or current gives 0 and says so. Then, in turn: the price row whose normalised model is the specification's; the best
    one by features; the list price (base: key like MCB-1P-16A, list_price in cents) at the nearest standard current (the
    first on a tie) times the brand's discount and multiplier, half cents up; else 0 and unknown. Brands without a tier have
    the discounts of the first one.
    """
    missing = F.trim(F.coalesce(F.col("__spec"), F.lit(""))).isin("", "-", "待确认", "待定")
    f = features(F.col("__spec"))
    asked = demand.select(F.col(spec).alias("__spec"), F.col(brand).alias("__brand")).distinct()
    d = staged(asked.withColumn("__f", F.when(~missing, f)))
    d = from_library(d, prices, synonyms)
    near = nearest_tier(F.col("__f.amps"), STANDARD_AMPS)
    d = d.withColumn("__key", F.concat_ws("-", "__f.kind", "__f.poles", F.concat(near.cast("string"), F.lit("A")))).join(base.select(F.col("key").alias("__key"), "list_price"), "__key", "left")
    default = next(iter(TIERS.values()))
    tier = lambda i: F.coalesce(*(F.when(F.col("__brand") == b, F.lit(t[i])) for b, t in TIERS.items()), F.lit(default[i]))
    # discounts in two-hundredths, as other kinds take the mean of two; times hundredths of the multiplier
    share = F.when(F.col("__f.kind").isin("MCB", "RCBO"), 2 * tier(0)).when(F.col("__f.kind") == "MCCB", 2 * tier(1)).when(F.col("__f.kind") == "ATS", 2 * tier(2)).otherwise(tier(0) + tier(1))
    listed = F.expr("(list_price * __share + 10000) div 20000")
    d = d.withColumn("__share", (share * tier(3)).cast("long"))
    basis = F.when(F.col("__f").isNull(), "no_spec").when(F.col("__f.amps").isNull(), "no_amps").when(F.col("__exact").isNotNull(), "exact").when(F.col("__matched").isNotNull(), "matched").when(F.col("list_price").isNotNull(), "catalogue").otherwise("unknown")
    cost = F.when(basis.isin("exact", "matched"), F.coalesce("__exact.price", "__matched.price")).when(basis == "catalogue", listed).otherwise(0)
    answers = d.select("__spec", "__brand", basis.alias("basis"), F.when(basis.isin("exact", "matched"), F.coalesce("__exact.code", "__matched.code")).alias("price_code"), cost.cast("long").alias("cost"))
    return demand.join(answers, F.col(spec).eqNullSafe(F.col("__spec")) & F.col(brand).eqNullSafe(F.col("__brand"))).drop("__spec", "__brand")

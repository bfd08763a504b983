"""Parsers of device and cable specifications, device lists and issue lines, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


# What breaker and accessory texts begin with, pole marks of two series, cable families and their fire-safety marks, laying methods and places.
BREAKERS, ACCESSORIES = ("MCB", "RCB", "MCCB", "ATSE", "IS-", "DS-"), ("VM", "OF", "SD", "MX", "MN", "VIGI", "30MA", "MV")
SERIES_POLES = ((("3300", "3308"), "3P"), (("4300", "4308"), "4P"))
CABLES, CABLE_MARKS = ("BYJ", "YJV", "YJY", "VV", "BVR", "BV", "RVVP", "RVV"), ("WDZ", "ZR", "NH", "FS")
LAYING, PLACES = ("SC", "PC", "KBG", "JDG", "CT", "MR", "PR", "CP", "RC", "PVC"), ("CC", "WC", "FC", "WS", "CE", "ACC", "SR", "MR", "CT", "WE")
# Brands and the words that name them, tried in this order; a number sign stands for a digit.
BRANDS = (
    ("施耐德", ("SCHNEIDER", "施耐德", "IC65", "ACTI9", "NSX", "NSC", "EA9", "EASYPACT", "GV2", "LC1D")),
    ("ABB", ("ABB", "S20#", "S200", "TMAX", "XT1", "XT2", "XT3", "XT4", "A9", "AF#", "AX#", "OT160")),
    ("西门子", ("SIEMENS", "西门子", "5SY", "5SL", "5SU", "3VM", "3VA", "3VT", "3TF", "3RT")),
    ("正泰", ("CHINT", "正泰", "NXB", "NM8", "NM1", "NM5", "NXBLE", "CJX2", "NXZ")),
    ("德力西", ("DELIXI", "德力西", "CDB6", "CDM3", "CDM6", "CDCH8", "CDX2")),
    ("良信", ("NADER", "良信", "NDB", "NDM", "NDC", "NDQ")),
    ("常熟开关", ("常熟", "常开", "CM1", "CM3", "CM5", "CA1", "CW1", "CW2", "CW3")),
)
NO_BRAND = "通用/国标"
# Breaker categories by what a text begins with; then by what it begins with or holds; then by the current of a bare curve.
BREAKER_HEADS = (("MCB", "微型断路器"), ("RCB", "剩余电流动作断路器"), ("MCCB", "塑壳断路器"), ("ATSE", "双电源自动转换开关"), ("IS-", "隔离开关"), ("DS-", "隔离开关"))
BREAKER_KINDS = (
    ("剩余电流动作断路器", (), ("RCB", "RCBO", "RCD", "LE", "VIGI", "漏电", "30MA")),
    ("双电源自动转换开关", ("ATSE", "ATS", "NZ7", "NDQ", "WATS", "双电源"), ()),
    ("隔离开关", ("IS-", "DS-", "HR", "NH40", "GL-", "GL", "HD", "HS"), ("隔离开关", "隔离")),
    ("塑壳断路器", ("MCCB", "NM1", "NM8", "NXM", "NM", "NSX", "NS", "CVS", "EZD", "TMAX", "XT", "3VA", "3VM", "CDM", "NDM", "CM1", "CM3", "CM5"), ("塑壳",)),
    ("微型断路器", ("MCB", "DZ47", "IC65", "C65", "EA9", "EASY9", "ACTI9", "NXB", "NB1", "NDB", "CDB6", "CDB", "S200", "5SY", "5SL"), ()),
)
CURVE_SPLIT, SMALL_CURVE, LARGE_CURVE, OTHER_BREAKER = 125, "微型断路器", "塑壳断路器", "断路器（其他）"


def _any_of(names: Sequence[str]) -> str:
    return "(?:" + "|".join(names).replace("#", "[0-9]") + ")"


def _words(spec: Column) -> Column:
    """The words of a device text in upper case: cut at slashes, hyphens, blanks and other signs; C 16, 30 mA and In: 63 A are one word each."""
    s = F.upper(F.translate(F.coalesce(spec, F.lit("")), "（）／", "()/"))
    s = F.regexp_replace(F.regexp_replace(s, "(^|[^A-Z0-9])([BCD]) +(?=[1-9])", "$1$2"), "([0-9]) +(?=(?:MA|KA|A)(?![A-Z0-9]))", "$1")
    s = F.regexp_replace(s, "(^|[^A-Z0-9])IN *[:=]? *(?=[1-9])", "$1IN=")
    return F.filter(F.split(s, "[^A-Z0-9.+=]+|[+](?!N(?![A-Z0-9]))"), lambda w: w != "")


def _class(words: Column, pattern: str, group: int = 1) -> Column:
    """What the first word of a class says: the group of its pattern."""
    return F.regexp_extract(F.get(F.filter(words, lambda w: w.rlike(pattern)), F.lit(0)), pattern, group)


# The classes of words, with the value in a group.
STATED, CURVE, AMPS, BARE = "^IN=([0-9.]+)A?$", "^([BCD])([1-9][0-9.]*)A?$", "^([1-9][0-9.]*)A$", "^[1-9][0-9]{0,3}(?:[.][0-9]+)?$"
POLES, LEAKAGE, BREAKING = "^([1-4]P(?:[+]?N)?|3PH)$", "^([0-9]{2,4})MA$", "^([0-9]{1,2}(?:[.][0-9]+)?)KA$"


def _amps(words: Column) -> Column:
    head = F.get(words, F.lit(0))
    return F.coalesce(_class(words, STATED), _class(words, CURVE, 2), _class(words, AMPS), F.when(head.rlike(BARE), head)).try_cast("double")


def rated_amps(spec: Column) -> Column:
    """The rated current: said with In, else after a trip curve, else before the unit A, else a number that the text begins with."""
    return _amps(_words(spec))


def breaker(spec: Column) -> Column:
    """struct(series, curve, amps, poles, pole_text, leakage_ma, breaking_ka, manufacturer): parameters of a breaker text, null where the text doesn't say.

    Each is the first word of its class. A series is what the text begins with up to a slash or blank, without a curve behind
    a hyphen; the curve may also be said in words, and a series number may stand for the poles.
    """
    said, w = F.upper(F.coalesce(spec, F.lit(""))), _words(spec)
    poles = F.regexp_replace(_class(w, POLES), "([0-9]P)N$", "$1+N")
    for numbers, mark in reversed(SERIES_POLES):
        poles = F.coalesce(poles, F.when(F.exists(w, lambda x: x.isin(*numbers)), mark))
    named = lambda letter, other: F.exists(w, lambda x: x == letter) | (said.contains(other) if other else F.lit(False))
    curve = F.coalesce(_class(w, CURVE), F.when(named("D", "动力型"), "D").when(named("C", "照明型"), "C").when(named("B", None), "B"))
    parts = F.split(F.get(F.filter(F.split(F.regexp_replace(said, "IN *[:=] *", ""), "[^A-Z0-9-]+"), lambda x: x.rlike("[A-Z0-9]")), F.lit(0)), "-")
    tail = F.get(parts, F.lit(1))
    series = F.when(tail.isNull() | (tail == "") | tail.rlike("^[BCD][0-9]"), parts[0]).otherwise(F.concat_ws("-", parts[0], tail))
    return F.struct(
        F.when((F.char_length(series) >= 3) & ~series.rlike("^(?:[0-9]+|[BCD][0-9]+A?)$"), series).alias("series"), curve.alias("curve"), _amps(w).alias("amps"),
        F.left(poles, F.lit(1)).try_cast("int").alias("poles"), poles.alias("pole_text"), _class(w, LEAKAGE).try_cast("int").alias("leakage_ma"), _class(w, BREAKING).try_cast("double").alias("breaking_ka"),
        F.nullif(brand(spec), F.lit(NO_BRAND)).alias("manufacturer"),
    )


def brand(text: Column) -> Column:
    """The first brand one of whose words the text holds, in any case, else NO_BRAND."""
    s = F.upper(F.coalesce(text, F.lit("")))
    out = F.lit(NO_BRAND)
    for name, known in reversed(BRANDS):
        out = F.when(s.rlike(_any_of(known)), name).otherwise(out)
    return out


def breaker_category(text: Column) -> Column:
    """A breaker's category: by what the text begins with, by what it begins with or holds, or, for a bare curve and current, by the current."""
    s = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    amps = F.regexp_extract(s, "^[CDB]([0-9]{1,3})(?:A|/|$|[^A-Z0-9])", 1).try_cast("int")
    out = F.when(amps <= CURVE_SPLIT, SMALL_CURVE).when(amps > CURVE_SPLIT, LARGE_CURVE).otherwise(OTHER_BREAKER)
    for kind, heads, parts in reversed(BREAKER_KINDS):
        holds = s.rlike("|".join([*(["^" + _any_of(heads)] if heads else []), *([_any_of(parts)] if parts else [])]))
        out = F.when(holds, kind).otherwise(out)
    for head, kind in reversed(BREAKER_HEADS):
        out = F.when(s.startswith(head), kind).otherwise(out)
    return out


def cable(spec: Column) -> Column:
    """struct(family, cores, section, earth_cores, earth_section, laying) of 4x25+1x16, 3x2.5+E2.5, 5x6 or BV-2.5; a single section is one core.

    The conductors are the first word of the form cores x section, cut at its plus sign into the phases and the earth.
    """
    s = F.upper(F.trim(F.translate(F.coalesce(spec, F.lit("")), "×＊*（）", "XXX()")))
    words = F.split(F.regexp_replace(s, " *([X+]) *(?=[E0-9])", "$1"), "[ ,;/()_-]+")
    sizes = F.split(F.regexp_extract(F.get(F.filter(words, lambda w: w.rlike("[0-9]X[0-9]")), F.lit(0)), "[0-9]+X[0-9].*", 0), "[+]")
    phases, earth = F.split(sizes[0], "X"), F.split(F.regexp_replace(F.get(sizes, F.lit(1)), "^E", "1X"), "X")
    single = F.regexp_extract(F.get(F.filter(words, lambda w: w.rlike("^[1-9][0-9]{0,2}(?:[.][0-9]+)?(?:MM[2²]?|平方)?$")), F.lit(0)), "^[0-9.]+", 0)
    number = lambda c: F.regexp_extract(c, "^[0-9.]+", 0)
    section = F.coalesce(number(F.get(phases, F.lit(1))), single).try_cast("double")
    second = F.when(F.size(earth) > 1, number(F.get(earth, F.lit(1)))).otherwise(number(earth[0])).try_cast("double")
    marked = rf"(?<![A-Z0-9])((?:{_any_of(CABLE_MARKS)}[A-Z]*)?-?{_any_of(CABLES)}(?:[A-Z]*|22|23|32))(?=[ _X(*-]|[0-9]|$)"
    laid = rf"(?<![A-Z0-9])({_any_of(LAYING)}[0-9]{{0,3}}(?:[/-]{_any_of(PLACES)})*)(?![A-Z0-9])"
    return F.struct(
        _found(s, marked).alias("family"), F.coalesce(F.when(F.size(phases) > 1, phases[0]).try_cast("int"), F.when(section.isNotNull(), 1)).alias("cores"), section.alias("section"),
        F.when(second.isNotNull(), F.when(F.size(earth) > 1, earth[0].try_cast("int")).otherwise(1)).alias("earth_cores"), second.alias("earth_section"), _found(s, laid).alias("laying"),
    )


def devices(text: Column, begins: tuple[str, ...] = BREAKERS, accessories: tuple[str, ...] = ACCESSORIES, combos: bool = False) -> Column:
    """array(struct(spec, count)) of a device text, each with a count before (3×spec) or after (spec×3), 1 if there is none.

    An empty text is an empty array. Pieces joined by + are one device if the first is a breaker and the others its
    accessories; with combos, they are devices of their own if each begins like one. All else that is ambiguous is null: a
    piece without a name, a count of zero, other joined pieces, a null text.
    """
    whole = F.trim(text)
    pieces = F.transform(F.split(whole, "[+＋]"), lambda p: F.trim(p))
    starts = lambda p, names: F.upper(p).rlike("^(?:" + "|".join(names) + ")")
    before, after = r"^(\d+)\s*[×xX*＊]\s*(.+)$", r"^(.+?)\s*[×xX*＊]\s*(\d+)$"
    device = lambda spec, count: F.struct(F.trim(spec).alias("spec"), count.cast("long").alias("count"))

    def one(p: Column) -> Column:
        counted = F.when(p.rlike(before), device(F.regexp_extract(p, before, 2), F.regexp_extract(p, before, 1))).when(p.rlike(after), device(F.regexp_extract(p, after, 1), F.regexp_extract(p, after, 2)))
        return counted.otherwise(device(p, F.lit(1)))

    parsed = F.transform(pieces, one)
    odd = F.exists(parsed, lambda x: (x["count"] <= 0) | (x["spec"] == ""))
    fitted = starts(pieces[0], begins) & F.forall(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: starts(p, accessories))
    apart = F.forall(pieces, lambda p: starts(F.regexp_replace(p, r"^\d+\s*[×xX*＊]\s*", ""), begins)) if combos else F.lit(False)
    many = F.when(fitted, F.array(device(whole, F.lit(1)))).when(apart & ~odd, parsed)
    return F.when(whole == "", F.slice(parsed, 1, 0)).when(F.size(pieces) > 1, many).when(~odd, parsed)


def box_size(text: Column) -> Column:
    """struct(width, height, depth) of a size such as 600x800x200: the least number is the depth, the others keep their order."""
    n = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("\\d+(?:\\.\\d+)?"), F.lit(0)), lambda x: x.cast("double"))
    at = F.array_position(n, F.array_min(n))
    rest = F.filter(n, lambda x, i: i + 1 != at)
    return F.when(F.size(n) == 3, F.struct(rest[0].alias("width"), rest[1].alias("height"), F.array_min(n).alias("depth")))


def issue(text: Column, longest_head: int = 40) -> Column:
    """struct(location, detail, severity, resolved) of an issue line: head：detail with tags in brackets."""
    tagged = F.upper(F.coalesce(text, F.lit("")))
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "(?i)\\[(?:ERROR|WARNING|INFO|RESOLVED)\\]", ""))
    at = F.instr(bare, F.lit("："))
    split = (at > 1) & (at <= longest_head + 1)
    return F.struct(
        F.when(split, F.substring(bare, F.lit(1), at - 1)).otherwise("").alias("location"), F.when(split, F.ltrim(F.substring(bare, at + 1, F.char_length(bare)))).otherwise(bare).alias("detail"),
        F.when(tagged.contains("[ERROR]"), "ERROR").when(tagged.contains("[WARNING]"), "WARNING").when(tagged.contains("[INFO]"), "INFO").otherwise("").alias("severity"), tagged.contains("[RESOLVED]").alias("resolved"),
    )

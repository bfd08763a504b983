"""Panel codes in drawing text: a token scanner, a table of reasons why a token is no code, and ranges of codes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Box families, units, circuit and feeder marks, conduits, words that standards, conductors and devices begin with.
FAMILIES = ("AL", "AP", "AT", "AW", "AA", "AH", "AM", "APE", "ALE", "ATE", "AWE", "JX", "KZ", "XF", "GGD", "GCK", "MNS", "XL", "AC", "AK")
UNITS = ("A", "KA", "MA", "KW", "KVAR", "W", "V", "KV", "HZ", "H", "KVA", "VA", "MM", "MM2", "M", "MIN", "S", "LX", "LM", "KN", "MPA", "DB")
CIRCUIT_MARKS = ("WL", "WP", "WX", "WD", "WS", "WY", "WE", "W", "P", "N", "E", "QF")
LINE_MARKS = ("WL", "WP", "WX", "WD", "WS", "WY", "QF")
FEEDER_MARKS = ("PY", "BF", "XF", "FS", "FP", "XP", "ZL")
CONDUITS = ("SC", "PC", "KBG", "JDG", "MT")
NO_PANELS = ("SC", "PC", "KBG", "JDG", "CT", "FC", "WC", "CC", "WS", "BV", "BVR", "YJV", "KVV", "RVV", "WDZ", "ZR", "NH", "ZA", "ZB", "ZC", "BBTRZ", "GB", "JGJ", "CECS", "ISO", "IEC", "MCB", "MCCB", "RCBO", "ACB", "ATSE", "SPD", "C65", "NSX", "EZD", "IC65", "DZ47", "NM1", "CM1", "ESB")
DEVICES = ("ATS", "IS-", "DS-", "GL", "HD-", "HS-", "ACTI9", "EA9", "EASY9", "NS", "CVS", "MTZ", "MVS", "COMPACT", "NXB", "NB1", "NM8", "NZ7", "S200", "S280", "TMAX", "EMAX", "FORMULA")
NUMBERED_DEVICES = ("NM", "CDM", "CDG", "CDB", "NDM", "NDB", "NDQ", "NDW", "XT", "5SY", "5SL", "3VA", "3VM", "3WL", "DZ", "CM", "TM", "DW", "CW", "RMW")
PIPES = ("DN", "RG", "SCB", "SC", "KVA", "MM")
LONGEST_RANGE = 150


def words(names: Sequence[str]) -> str:
    return "(?:" + "|".join(names) + ")"


def _part(test: Callable[[Column], Column], token: Column) -> Column:
    return F.exists(F.split(token, "[/-]"), test)


def core_part(part: Column) -> Column:
    """A part that names a panel: a letter and two digits (C01), or two letters together and a digit; rooms (A116, PK306) aren't."""
    room = part.rlike("^[A-Z]{1,2}[0-9]{3,}$")
    return part.rlike("^[A-Z][0-9]{2}$") | (part.rlike("[A-Z]{2}") & part.rlike("[0-9]") & ~room)


def panel_shape(token: Column) -> Column:
    """A token with a core part; or of letters alone, one part a box family and another one of three letters or more (XFDT-AT)."""
    family, letters = words(FAMILIES), lambda p: p.rlike("^[A-Z]{2,}$")
    named = _part(lambda p: p.rlike(f"^{family}$"), token) & _part(lambda p: letters(p) & (F.char_length(p) > 2) & ~p.rlike(f"^{family}$"), token)
    return _part(core_part, token) | named


def _circuit() -> str:
    """WL3, 2-N1, 1AL-WP2A, N1-2, fans' PY-1-2, control lines (D01-C1, K1-1)."""
    plain = f"(?:B?[0-9]{{1,2}}-?)?{words(CIRCUIT_MARKS)}[0-9]+(?:[A-Z]|-[0-9]+)?$"
    return f"^{plain}|-{words(LINE_MARKS)}[0-9]+[A-Z]?$|^{words(FEEDER_MARKS)}-|^D[0-9]{{2}}(?:-C[0-9]+)?$|^K[0-9]+-[0-9]+$"


#: Why a token in upper case is no panel code, in order: a name, a pattern of the token, a pattern of one of its parts. A last
#: reason is the shape of the token, see panel_shape. The patterns of standards' numbers, device frames and sample numbers.
RULES: tuple[tuple[str, str | None, str | None], ...] = (
    ("no letter", "^[^A-Z]*$", None),
    ("long number", "[0-9]{4}", None),
    ("standard", r"^\d{2}[A-Z]{1,2}\d{3}(?:-\d+)?$", None),
    ("rating", None, "^(?:[0-9]+A|[1-4]P|[CDB][0-9]{1,3}A|[0-9]{1,3}P[0-9]{1,3}|RS[0-9]{3})$"),
    ("quantity", None, f"^(?:[AD]C)?[0-9]+{words(UNITS)}$"),
    ("phase", "^L[1-3][L1-3NPE/-]*$", None),
    ("circuit", _circuit(), None),
    ("product", "[0-9]X[0-9]", None),
    ("conduit", f"{words(CONDUITS)}[0-9]", None),
    ("not a panel", None, f"^{words(NO_PANELS)}|^IP[0-9]"),
    ("device", f"^{words(DEVICES)}|^{words(NUMBERED_DEVICES)}[0-9]", None),
    ("frame", r"^[A-Z]{1,4}\d{0,2}-[A-Z]\d{2,3}[A-Z]{0,3}$", None),
    ("sample", r"^[A-Z]{3,}\d+[A-Z]+\d+[A-Z]+(?:[/-]|$)", None),
)
SHAPE = "shape"


def token_fault(token: Column) -> Column:
    """The first reason that holds, null for a panel code."""
    out = F.when(~panel_shape(token), SHAPE)
    for name, whole, part in reversed(RULES):
        out = F.when(token.rlike(whole) if whole else _part(lambda p: p.rlike(part), token), name).otherwise(out)  # noqa: B023
    return out


def is_token_code(token: Column) -> Column:
    """No reason holds: as token_fault, with the rules of each kind as one pattern."""
    whole, part = ("|".join(r[i] for r in RULES if r[i]) for i in (1, 2))
    return ~token.rlike(whole) & ~_part(lambda p: p.rlike(part), token) & panel_shape(token)


def tokens(text: Column) -> Column:
    """The tokens of a text in upper case: letters and digits, joined by single hyphens and slashes; what follows a hyphen alone is none."""
    pieces = F.split(F.upper(text), "[^A-Z0-9/-]+|//+")
    return F.filter(F.transform(pieces, lambda p: F.regexp_extract(p, "^/?([A-Z0-9]+(?:[/-][A-Z0-9]+)*)", 1)), lambda p: p != "")


def panel_codes(text: Column) -> Column:
    """array of the panel codes of a text, each once, in order. Only what stands before a colon counts; a null text has none."""
    head = F.regexp_replace(F.trim(F.split(F.coalesce(text, F.lit("")), "[:：]")[0]), "^消防", "")
    return F.array_distinct(F.filter(tokens(head), is_token_code))


def first_panel_code(text: Column) -> Column:
    return F.get(panel_codes(text), F.lit(0))


def is_panel_code(code: Column) -> Column:
    """The whole of code, in upper case, is one panel code and no pipe or cable size."""
    return (F.get(tokens(code), F.lit(0)) == code) & ~code.rlike(f"^[0-9]*{words(PIPES)}[0-9]*$") & is_token_code(code)


def feed_code(text: Column) -> Column:
    """The code of a text that is nothing but a code, or a code, a colon and more; else null."""
    head = F.regexp_replace(F.split(F.coalesce(text, F.lit("")), "[:：]")[0], "(?U)\\s+", "")
    code = first_panel_code(head)
    return F.when(F.upper(head) == code, code)


def panel_range(text: Column, longest: int = LONGEST_RANGE) -> Column:
    """array of the panel codes of a text, each once, in order: ranges (JX1~JX21, 1AL1至5, AP01–03, 3~10RDAL), then what is named beside them.

    A range ascends by longest at most and keeps the zeros of a padded start; an end may repeat the start's prefix. What
    isn't a range, or one that doesn't hold, gives the codes it names; codes side by side (AP1/AP2) are several if each is a
    code of its own, else one (AW1/2/3). Each code passes is_panel_code. A null text has none.
    """
    s = F.upper(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s*([~～至到–—])\s*|\s*-\s+|\s+-\s*", "~"))
    pieces = F.filter(F.split(s, "[^A-Z0-9_/.~*×+=%-]+"), lambda t: t != "")
    by_end, by_start = "^([0-9]+)~([0-9]+)([A-Z][A-Z0-9]*)$", "^((?:[A-Z0-9_-]*[A-Z_-])?)([0-9]+)[~-](?:\\1)?([0-9]+)$"

    def numbers(low: Column, high: Column, name) -> Column:
        a, b = low.try_cast("int"), high.try_cast("int")
        good = F.coalesce((b > a) & (b - a <= longest) & (a > 0), F.lit(False))
        padded = lambda i: F.when(low.startswith("0"), F.lpad(i.cast("string"), F.char_length(low), F.lit("0"))).otherwise(i.cast("string"))
        return F.when(good, F.transform(F.sequence(F.when(good, a).otherwise(1), F.when(good, b).otherwise(1)), lambda i: name(padded(i))))

    def one(t: Column) -> Column:
        tail, head = F.regexp_extract(t, by_end, 3), F.regexp_extract(t, by_start, 1)
        suffixed = F.when(tail != "", numbers(F.regexp_extract(t, by_end, 1), F.regexp_extract(t, by_end, 2), lambda n: F.concat(n, tail)))
        prefixed = F.when(head.rlike("[A-Z]"), numbers(F.regexp_extract(t, by_start, 2), F.regexp_extract(t, by_start, 3), lambda n: F.concat(head, n)))
        sides = lambda c: F.when(F.forall(F.split(c, "/"), is_panel_code), F.split(c, "/")).otherwise(F.array(c))
        return F.filter(F.coalesce(suffixed, prefixed, F.flatten(F.transform(tokens(t), sides))), is_panel_code)

    # ranges first, then the rest, each in the order of the text
    ranked = F.array_sort(F.transform(pieces, lambda t, i: F.struct((~t.rlike(f"{by_end}|{by_start}")).alias("rest"), i.alias("at"), one(t).alias("codes"))))
    return F.array_distinct(F.flatten(F.transform(ranked, lambda x: x["codes"])))

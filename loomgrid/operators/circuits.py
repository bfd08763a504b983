"""Predicates and labels of circuits, boxes and drawings, as column expressions. A null text counts as an empty one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Load names of spare and reserved circuits, notes of devices that aren't installed and one that only looks like them, phase marks.
SPARE_LOADS, RESERVED_LOADS = ("备用", "备用回路", "备用开关"), ("预留", "预留回路", "备用预留")
NOT_INSTALLED, UNDECORATED = ("未安装", "不安装", "仅预留", "未装"), "未装饰"
PHASE_MARKS = ("L1L2L3", "L1L2L3PE", "L1L2L3NPE", "1P", "2P", "3P", "4P", "三相", "单相", "A", "B", "C", "ABC")
INCOMING, SPARE, NO_NUMBER = "进线", "备用", "未编号回路"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _compact(c: Column) -> Column:
    return F.regexp_replace(_text(c), "(?U)\\s+", "")


def is_incoming(number: Column, load: Column) -> Column:
    """An incoming circuit by its number or the start of its load name; notes don't count."""
    return (F.trim(_text(number)) == INCOMING) | F.trim(_text(load)).startswith(INCOMING)


def circuit_label(number: Column, load: Column, phase: Column) -> Column:
    """The circuit's number, else its load name (a spare one with its phase), else a fixed name."""
    spare = F.when(_text(phase) != "", F.concat(F.lit(f"{SPARE}("), phase, F.lit(")"))).otherwise(SPARE)
    return F.when(_text(number) != "", number).when(load == SPARE, spare).when(_text(load) != "", load).otherwise(NO_NUMBER)


def spare_disposition(load: Column, note: Column, breaker: Column, contactor: Column) -> Column:
    """active, installed_spare or reserved.

    The load's whole name decides, the note's only where there is no name. A spare or reserved circuit that states a breaker
    or contactor is installed, unless a text says that it isn't; one without a device is reserved.
    """
    name, said = _compact(load), _compact(note)
    named = F.when(name == "", said).otherwise(name).isin(*SPARE_LOADS, *RESERVED_LOADS)
    missing = F.replace(F.concat_ws(" ", name, said), F.lit(UNDECORATED), F.lit("")).rlike("|".join(NOT_INSTALLED))
    device = (F.trim(_text(breaker)) != "") | (F.trim(_text(contactor)) != "")
    return F.when(missing, "reserved").when(~named, "active").when(device, "installed_spare").otherwise("reserved")


def box_multiplier(quantity: Column, confirmed: Column) -> Column:
    """How many boxes a roll-up counts: the whole part of a confirmed positive quantity (a missing one or zero is one), else one."""
    whole = quantity.try_cast("double").cast("long")
    return F.when(F.coalesce(confirmed, F.lit(True)) & (whole > 0), whole).otherwise(F.lit(1).cast("long"))


def valid_phase(phase: Column) -> Column:
    """An empty phase, or one of the usual marks once separators are out: L and up to three of the digits 1 to 3, or L1L3 for L1 to L3, then N and PE if stated."""
    bare = F.upper(F.regexp_replace(_text(phase), r"(?U)[\s,./~_、-]+", ""))
    lines = F.regexp_replace(bare, "N?(?:PE)?$", "")
    digits = F.substring(lines, 2, 4)
    return (_text(phase) == "") | bare.isin(*PHASE_MARKS) | (lines == "L1L3") | (lines.startswith("L") & digits.rlike("^[123]{1,3}$"))


def thin_text(geometry: Column, texts: Column, least: int = 80, ratio: int = 40) -> Column:
    """A drawing of at least so many shapes with under one text for ratio of them."""
    shapes = F.coalesce(geometry, F.lit(0))
    return (shapes >= least) & (F.coalesce(texts, F.lit(0)) * ratio < shapes)


def conversion_accepted(exit_code: Column, filled: Column) -> Column:
    return F.coalesce((exit_code == 0) & filled, F.lit(False))


def circuit_rank(number: Column, load: Column) -> Column:
    """The order of circuits: 0 for an incoming one, 2 for one without a number, 1 for the rest."""
    return F.when(is_incoming(number, load), 0).when(F.trim(_text(number)) != "", 1).otherwise(2)

"""Column helpers: normalisers, rule tables turned into CASE, ordered folds and joins of strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY_SPACE = "(?U)\\s+"


def code_of(c: Column) -> Column:
    """A panel code: all white space out, upper case; null is an empty code."""
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), ANY_SPACE, ""))


def match_form(c: Column) -> Column:
    """The form in which drawing text is compared: upper case, one kind of multiplication sign and comma, no blanks, hyphens or underscores."""
    return F.regexp_replace(F.translate(F.upper(F.coalesce(c, F.lit(""))), "×＊，", "X*,"), "(?U)[\\s_-]+", "")


def price_form(c: Column) -> Column:
    """The form in which device models are looked up: upper case, no blanks, hyphens, underscores, slashes or semicolons."""
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)[\\s_/;-]+", ""))


def case_of(rules: Sequence[tuple[Column, object]], default) -> Column:
    """The value of the first rule that holds."""
    out = F.lit(default)
    for when, value in reversed(rules):
        out = F.when(when, F.lit(value)).otherwise(out)
    return out


def pattern_case(c: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern found in c."""
    return case_of([(c.rlike(p), label) for p, label in rules], default)


def tier_at_least(value: Column, tiers: Sequence[float], last: bool = True) -> Column:
    """The first tier of an ascending table that reaches value; the last one (or null) if none does."""
    out = F.lit(tiers[-1] if last else None)
    for t in reversed(tiers):
        out = F.when(value <= t, F.lit(t)).otherwise(out)
    return out


def nearest_tier(value: Column, tiers: Sequence[float]) -> Column:
    """The tier with the least difference, the earlier one on a tie."""
    out, best = F.lit(tiers[0]), F.abs(value - tiers[0])
    for t in tiers[1:]:
        near = F.abs(value - t) < best
        out, best = F.when(near, F.lit(t)).otherwise(out), F.least(best, F.abs(value - t))
    return out


def safe_cell(c: Column) -> Column:
    """A value that a spreadsheet won't run as a formula, without control characters."""
    bare = F.regexp_replace(c.cast("string"), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    return F.when(bare.rlike("^[=+@\\t\\r-]"), F.concat(F.lit("'"), bare)).otherwise(bare)

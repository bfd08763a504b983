"""Projects, their jobs, issues and components: inserts, renames, assignments, totals and orders, all as new snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Marks between the codes of a used-in text.
BETWEEN = r"[、,，\s]+"


def insert_or_ignore(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table and the rows of new whose key it doesn't have, one a key (the least row); rows of new without a key are left out."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*new.columns))
    once = new.where(F.col(key).isNotNull()).withColumn("__r", first).where("__r = 1").drop("__r")
    return table.unionByName(once.join(table.select(key).distinct(), key, "left_anti").select(*table.columns))


def rename(tables: Mapping[str, DataFrame], project_col: str, owner: str, old: str, new: str) -> dict[str, DataFrame]:
    """All tables with the project old called new; as they were if the table owner already has a project new or has none called old."""
    names = F.col(project_col)
    held = tables[owner].where(names.isin(old, new)).agg(F.count_if(names == old), F.count_if(names == new)).first()
    if not held[0] or held[1]:
        return dict(tables)
    return {n: t.withColumn(project_col, F.when(names == old, new).otherwise(names)) for n, t in tables.items()}


def assign(rows: DataFrame, found: Column, project: str = "project", source: str = "source") -> DataFrame:
    """rows with the project found for them, marked auto; a project that was set by hand stays, as does one for which nothing is found."""
    take = (F.coalesce(F.col(source), F.lit("")) != "manual") & found.isNotNull()
    return rows.withColumns({project: F.when(take, found).otherwise(F.col(project)), source: F.when(take, "auto").otherwise(F.col(source))})


def project_totals(projects: DataFrame, jobs: DataFrame, key: str, totals: Mapping[str, Column]) -> DataFrame:
    """(key, totals...): a row per project that either side names; totals are aggregates over jobs, 0 where a number has no job."""
    sums = jobs.where(F.col(key).isNotNull()).groupBy(key).agg(*(c.alias(n) for n, c in totals.items()))
    return projects.select(key).distinct().join(sums, key, "full_outer").na.fill(0)


def new_issues(known: DataFrame, found: DataFrame, text: str, order: str) -> DataFrame:
    """(text, order): issues of found that known doesn't hold, each once, where it stands first; empty texts are none."""
    first = found.where(F.col(text) != "").groupBy(text).agg(F.min(order).alias(order))
    return first.join(known.select(text).distinct(), text, "left_anti")


def issue_places(issues: DataFrame, key: str, resolved: Column, file: str, severity: str, tie: str) -> DataFrame:
    """issues with place (long) in their key: unresolved first, then by file and the severity's text."""
    order = Window.partitionBy(key).orderBy(resolved.cast("int"), file, severity, tie)
    return issues.withColumn("place", F.row_number().over(order).cast("long"))


def component_places(parts: DataFrame, key: str, category: str, known: Sequence[str], then: Sequence[str]) -> DataFrame:
    """parts with place (long) in their key: by the category's place among known, others last, then by the columns then."""
    at = F.array_position(F.array(*map(F.lit, known)), F.col(category))
    order = Window.partitionBy(key).orderBy(F.when(F.coalesce(at, F.lit(0)) == 0, len(known) + 1).otherwise(at), *then)
    return parts.withColumn("place", F.row_number().over(order).cast("long"))


def used_codes(used_in: Column) -> Column:
    """The box codes that a used-in text may name: its parts between commas or blanks, and the text as a whole; each once."""
    bare = F.trim(F.coalesce(used_in, F.lit("")))
    return F.filter(F.array_distinct(F.array_append(F.split(bare, BETWEEN), bare)), lambda c: c != "")


def components_of_boxes(parts: DataFrame, boxes: DataFrame, used_in: str, code: str) -> DataFrame:
    """boxes joined to the parts whose used-in text names them, each pair once; parts are spread by code before the join."""
    return parts.withColumn("__code", F.explode(used_codes(F.col(used_in)))).join(boxes, F.col("__code") == F.col(code)).drop("__code")


def first_filled(rows: DataFrame, key: str, fields: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(key, fields...): of each field the first value in order that isn't empty, null if there is none."""
    at = lambda f: F.when(F.coalesce(F.col(f), F.lit("")) != "", F.struct(*order, F.col(f).alias("__v")))
    return rows.groupBy(key).agg(*(F.min(at(f))["__v"].alias(f) for f in fields))


def markers(text: Column, pattern: str) -> Column:
    """The different matches of a pattern in a text, in the order of their first place."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)))


def one_to_one(gold: DataFrame, said: DataFrame, keys: Sequence[str], gold_order: Sequence[str], said_order: Sequence[str]) -> DataFrame:
    """gold left joined to said: the nth row of a key in gold's order meets the nth in said's, so that no row is used twice."""
    nth = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return gold.withColumn("__n", nth(gold_order)).join(said.withColumn("__n", nth(said_order)), [*keys, "__n"], "left").drop("__n")


def call_cost(prompt: Column, hit: Column, completion: Column, rates: tuple[int, int, int]) -> Column:
    """The cost of a model call in billionths, for rates in thousandths per million tokens (cache hit, cache miss, output).

    No more tokens are charged than the prompt has: hits first, all others are misses, whether reported so or not.
    """
    whole = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long")
    hits = F.least(whole(hit), whole(prompt))
    return hits * rates[0] + (whole(prompt) - hits) * rates[1] + whole(completion) * rates[2]


def in_peak(ts: Column, windows: Sequence[tuple[int, int]]) -> Column:
    """Whether a time lies on Monday to Friday in one of the windows (minutes of the day, end left out)."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    inside = F.lit(False)
    for start, end in windows:
        inside = inside | ((minute >= start) & (minute < end))
    return (F.weekday(ts) < 5) & inside


def model_cost(model: Column, prompt: Column, hit: Column, completion: Column, at: Column, card: Mapping[str, Mapping], aliases: Mapping[str, str], zone: str = "Asia/Shanghai") -> Column:
    """struct(model, status, peak, cost): the cost of a call in billionths by a price card, at a UTC time.

    A card has for each model off_peak and peak rates (see call_cost) and windows (minutes of a working day in zone). A model goes by its
    alias, in any case; one without a card is unavailable and costs 0, as nothing is known of it.
    """
    asked = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    named = asked
    for alias, name in aliases.items():
        named = F.when(asked == alias, name).otherwise(named)
    local = F.from_utc_timestamp(at, zone)
    peak, cost = F.lit(False), F.lit(0).cast("long")
    for name, rates in card.items():
        high = in_peak(local, rates["windows"])
        price = F.when(high, call_cost(prompt, hit, completion, rates["peak"])).otherwise(call_cost(prompt, hit, completion, rates["off_peak"]))
        peak, cost = F.when(named == name, high).otherwise(peak), F.when(named == name, price).otherwise(cost)
    known = named.isin(*card)
    return F.struct(named.alias("model"), F.when(known, "priced").otherwise("unavailable").alias("status"), F.coalesce(peak, F.lit(False)).alias("peak"), cost.alias("cost"))

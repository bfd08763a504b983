"""Edits of extracted lists: proposals are resolved and judged, with a reason for each that is refused, and what is accepted is merged."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields that may be edited, those that are numbers, the unit of a device that states none.
CIRCUIT_FIELDS = ("phase", "breaker", "cable", "power_kw", "load_name")
BOX_FIELDS = ("name", "ip_rating", "install", "location", "size", "quantity", "note")
DEVICE_FIELDS = ("name", "spec", "unit", "quantity", "used_in", "note")
NUMBERS, UNIT = ("quantity",), "套"


def _bare(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def _values(fields: Sequence[str]) -> Column:
    return F.create_map(*(x for f in fields for x in (F.lit(f), F.coalesce(F.col(f).cast("string"), F.lit("")))))


def _number(c: Column) -> Column:
    """A positive number as text, a whole one without a point; null for anything else."""
    n = c.try_cast("double")
    return F.when((n > 0) & ~F.isnan(n) & (n < float("inf")), F.when(n == F.floor(n), F.floor(n).cast("string")).otherwise(n.cast("string")))


def judge(patch: DataFrame, circuits: DataFrame, boxes: DataFrame, devices: DataFrame) -> DataFrame:
    """patch rows with scope, key (of the row meant), old, new and reason; null for what is accepted.

    patch: job, n, kind (circuit if empty, box, device), action (update if empty; add or remove for devices), target, field, value.
    circuits: job, ord, circuit_no and CIRCUIT_FIELDS; boxes: job, code and BOX_FIELDS; devices: job and DEVICE_FIELDS (for an
    added one the value is its specification). A circuit is meant by its number if one alone has it, else by its load name.

    Reasons: no_target, ambiguous_number, ambiguous_name, unknown_circuit, unknown_box, unknown_device, no_name, exists,
    code_is_fixed, field, empty, not_a_number, unchanged. Targets are counted per name first, so a list with very many
    rows of one name sends one of them.
    """
    p = patch.withColumns({"kind": F.when(_bare("kind") == "", "circuit").otherwise(_bare("kind")), "action": F.when(_bare("action") == "", "update").otherwise(_bare("action")), "target": _bare("target"), "field": _bare("field"), "value": _bare("value")})
    c = circuits.select("job", _bare("circuit_no").alias("no"), _bare("load_name").alias("name"), F.struct(F.col("ord").cast("string").alias("key"), _values(CIRCUIT_FIELDS).alias("old")).alias("row"))
    tally = lambda df, name, tag: df.where(F.col(name) != "").groupBy("job", F.col(name).alias("target")).agg(F.count("*").alias(f"{tag}_n"), F.min_by("row", "row.key").alias(f"{tag}_row"))
    b = boxes.where(_bare("code") != "").groupBy("job", F.col("code").alias("target")).agg(F.first(F.struct(F.col("code").alias("key"), _values(BOX_FIELDS).alias("old"))).alias("box_row"))
    d = devices.select("job", F.explode(F.array_distinct(F.array(F.col("name"), F.concat_ws("|", "name", F.coalesce("spec", F.lit("")))))).alias("target"), F.struct(F.concat_ws("|", "name", F.coalesce("spec", F.lit(""))).alias("key"), _values(DEVICE_FIELDS).alias("old")).alias("row"))
    d = d.groupBy("job", "target").agg(F.min_by("row", "row.key").alias("device_row"))
    met = p.join(tally(c, "no", "no"), ["job", "target"], "left").join(tally(c, "name", "name"), ["job", "target"], "left").join(b, ["job", "target"], "left").join(d, ["job", "target"], "left")
    is_box, is_device, adds = F.col("kind") == "box", F.col("kind") == "device", (F.col("kind") == "device") & (F.col("action") == "add")
    circuit = F.coalesce(F.when(F.col("no_n") == 1, F.col("no_row")), F.when(F.col("no_n").isNull() & (F.col("name_n") == 1), F.col("name_row")))
    key = F.when(adds, F.col("target")).when(is_device, F.col("device_row.key")).when(is_box, F.col("box_row.key")).otherwise(circuit["key"])
    removes = is_device & (F.col("action") == "remove")
    old = F.when(adds | removes, None).when(is_device, F.try_element_at("device_row.old", F.col("field"))).when(is_box, F.try_element_at("box_row.old", F.col("field"))).otherwise(F.try_element_at(circuit["old"], F.col("field")))
    new = F.when(F.col("field").isin(*NUMBERS) & (is_box | is_device), _number(F.col("value"))).otherwise(F.col("value"))
    known = F.when(is_device, F.col("field").isin(*DEVICE_FIELDS)).when(is_box, F.col("field").isin(*BOX_FIELDS)).otherwise(F.col("field").isin(*CIRCUIT_FIELDS))
    missing = (
        F.when(adds & (F.col("target") == ""), "no_name").when(adds & F.col("device_row").isNotNull(), "exists").when(adds, None)
        .when(is_device & F.col("device_row").isNull(), "unknown_device").when(is_box & F.col("box_row").isNull(), "unknown_box").when(is_box | is_device, None)
        .when(F.col("target") == "", "no_target").when(F.col("no_n") > 1, "ambiguous_number").when(F.col("no_n") == 1, None).when(F.col("name_n") > 1, "ambiguous_name").when(F.col("name_n").isNull(), "unknown_circuit")
    )
    wrong = F.when(adds | removes, None).when(is_box & (F.col("field") == "code"), "code_is_fixed").when(~known, "field").when(F.col("value") == "", "empty").when(new.isNull(), "not_a_number").when(old == new, "unchanged")
    reason = F.coalesce(missing, wrong)
    return met.select("job", "n", F.col("kind").alias("scope"), "action", "field", F.when(reason.isNull(), key).alias("key"), F.when(reason.isNull(), old).alias("old"), F.when(reason.isNull() & ~removes, new).alias("new"), reason.alias("reason"))


def _merged(rows: DataFrame, accepted: DataFrame, scope: str, key: Column, fields: Sequence[str]) -> DataFrame:
    """rows with the last accepted value of each field."""
    last = accepted.where((F.col("scope") == scope) & (F.col("action") == "update")).groupBy("job", "key", "field").agg(F.max_by("new", "n").alias("v"))
    put = last.groupBy(F.col("job").alias("__job"), F.col("key").alias("__key")).agg(F.map_from_entries(F.collect_list(F.struct("field", "v"))).alias("__put"))
    out = rows.join(put, (F.col("job") == F.col("__job")) & (key == F.col("__key")), "left")
    kinds = dict(rows.dtypes)
    return out.select(*(F.coalesce(F.try_element_at("__put", F.lit(f)).cast(kinds[f]), F.col(f)).alias(f) if f in fields else F.col(f) for f in rows.columns))


def apply(judged: DataFrame, circuits: DataFrame, boxes: DataFrame, devices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three lists after the accepted edits: of several for one field the last one; removed devices go, added ones come with one piece."""
    yes = judged.where("reason IS NULL")
    own = F.concat_ws("|", "name", F.coalesce("spec", F.lit("")))
    gone = yes.where("scope = 'device' AND action = 'remove'").select(F.col("job").alias("__j"), F.col("key").alias("__k")).distinct()
    kept = devices.join(gone, (F.col("job") == F.col("__j")) & (own == F.col("__k")), "left_anti")
    kinds = dict(devices.dtypes)
    first = yes.where("scope = 'device' AND action = 'add'").groupBy("job", "key").agg(F.min_by("new", "n").alias("spec"))
    fill = {"name": F.col("key"), "spec": F.col("spec"), "unit": F.lit(UNIT), "quantity": F.lit(1), "used_in": F.lit(""), "note": F.lit("")}
    new = first.select(*(F.col("job") if c == "job" else fill.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in devices.columns))
    return _merged(circuits, yes, "circuit", F.col("ord").cast("string"), CIRCUIT_FIELDS), _merged(boxes, yes, "box", F.col("code"), BOX_FIELDS), _merged(kept, yes, "device", own, DEVICE_FIELDS).unionByName(new)


def patch_columns(rows: DataFrame, changes: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """rows with the values of changes (one row per key) where they aren't null, in the allowed columns only; keys that rows don't have change nothing."""
    there = [c for c in allowed if c in changes.columns]
    put = changes.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in there))
    out = rows.join(put, F.col(key) == F.col("__key"), "left")
    return reduce(lambda df, c: df.withColumn(c, F.coalesce(f"__{c}", F.col(c))), there, out).select(*rows.columns)

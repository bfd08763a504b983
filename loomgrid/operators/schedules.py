"""Schedule tables: bands of rules, chains of columns, merged cells, row roles, and columns turned into boxes and circuits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spatial import islands

# Words in row names and the field that the row holds, in this order.
ROLES = (("load", ("回路名称",)), ("circuit_no", ("回路编号",)), ("breaker", ("空气开关", "断路器")), ("cable", ("导线",)), ("power", ("容量",)))
CODE_WORD, NOT_CODE = "编号", "回路"
FIELDS = ("code", "breaker", "circuit_no", "cable", "load", "power")


def rule_bands(rules: DataFrame, keys: Sequence[str], at: str, gap: float = 0.04, least: int = 10) -> DataFrame:
    """rules with island (1, 2, ... per key): bands of rules, broken where the next one is over gap away, of at least so many rules."""
    banded = islands(rules, keys, at, gap)
    counted = banded.groupBy(*keys, "island").count().where(F.col("count") >= least).drop("count")
    return banded.join(counted, [*keys, "island"], "left_semi")


def column_chain(lines: DataFrame, keys: Sequence[str], at: str, low: float = 0.018, high: float = 0.12) -> DataFrame:
    """The lines of each key's longest run whose gaps all lie between low and high, the first one on a tie."""
    w = Window.partitionBy(*keys).orderBy(at)
    step = F.col(at) - F.lag(at).over(w)
    runs = lines.withColumn("__b", F.when(step.between(low, high), 0).otherwise(1)).withColumn("__run", F.sum("__b").over(w)).drop("__b")
    best = runs.groupBy(*keys, "__run").count().groupBy(*keys).agg(F.min_by("__run", F.struct(-F.col("count"), F.col("__run"))).alias("__run"))
    return runs.join(best, [*keys, "__run"], "left_semi").drop("__run")


def cell_role(text: Column) -> Column:
    """The field that a row with this name holds, empty if the text is no row name."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)\\s+", "")
    out = F.when(F.contains(bare, F.lit(CODE_WORD)) & ~F.contains(bare, F.lit(NOT_CODE)), "code").otherwise("")
    for role, words in reversed(ROLES):
        out = F.when(bare.rlike("|".join(words)), role).otherwise(out)
    return out


def clean_cell(text: Column) -> Column:
    """A cell's lines without blanks, empty ones left out; a written \\n is a line's end too."""
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\\n"), F.lit("\n")), "[\r\n]+")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, "(?U)\\s+", "")), lambda x: x != ""), "\n")


def label_columns(cells: DataFrame, table: str, least: int = 3) -> DataFrame:
    """(table, label): the column of each table with the most row names, the first on a tie; tables with fewer than least names have none."""
    hits = cells.where(cell_role(F.col("text")) != "").groupBy(table, "col").count()
    best = hits.groupBy(table).agg(F.max_by(F.struct("col", "count"), F.struct("count", -F.col("col"))).alias("m"))
    return best.where(F.col("m.count") >= least).select(table, F.col("m.col").alias("label"))


def role_rows(cells: DataFrame, labels: DataFrame, table: str) -> DataFrame:
    """(table, role, row): the first row of each field by the names in the label column."""
    named = cells.join(labels, table).where("col = label").select(table, "row", cell_role(F.col("text")).alias("role")).where("role <> ''")
    return named.groupBy(table, "role").agg(F.min("row").alias("row"))


def realign(cells: DataFrame, table: str, tall: float = 1.7) -> DataFrame:
    """cells with texts moved up where one row is drawn about twice as high as the (upper) median and was read as two.

    This holds if exactly one row is so high and the load names stand three rows below it. Then the next row's text joins the high
    one's if it has a letter (a second cable; a number isn't one), later rows move up by one, and the last one is left empty.
    """
    rows = cells.groupBy(table, "row").agg(F.max(F.col("bottom") - F.col("top")).alias("h"))
    w = Window.partitionBy(table)
    ranked = rows.withColumns({"n": F.count("*").over(w), "i": F.row_number().over(w.orderBy("h"))})
    median = ranked.where("i = n div 2 + 1").select(table, F.col("h").alias("m"), "n")
    high = rows.join(median, table).where((F.col("m") > 0) & (F.col("h") >= tall * F.col("m"))).groupBy(table).agg(F.count("*").alias("k"), F.min("row").alias("tall"), F.first("n").alias("n")).where("k = 1")
    loads = role_rows(cells, label_columns(cells, table), table).where("role = 'load'").select(table, F.col("row").alias("__load"))
    moved = high.join(loads, table).where("__load = tall + 3").select(table, "tall", "n")
    texts = cells.join(moved, table, "left")
    nxt = F.lead("text").over(Window.partitionBy(table, "col").orderBy("row"))
    second = F.when((F.col("row") == F.col("tall")) & nxt.rlike("[A-Za-z]"), F.concat_ws("\n", F.nullif(F.col("text"), F.lit("")), nxt)).otherwise(F.col("text"))
    shift = F.when(F.col("row") > F.col("tall") + 1, F.col("row") - 1).otherwise(F.col("row"))
    up = texts.withColumn("text", second).where("tall IS NULL OR row <> tall + 1").select(table, "col", shift.alias("row"), "text")
    return cells.drop("text").join(up, [table, "col", "row"], "left").withColumn("text", F.coalesce("text", F.lit(""))).select(*cells.columns)


def fill_merged(cells: DataFrame, table: str) -> DataFrame:
    """cells with the text of merged ones: a row's cells up to the next ruled border are one cell, and share its text if they hold a single one among them."""
    w = Window.partitionBy(table, "row").orderBy("col")
    grouped = cells.withColumn("__g", F.sum(F.when(F.col("ruled") | (F.col("col") == 0), 1).otherwise(0)).over(w))
    filled = F.nullif(F.col("text"), F.lit(""))
    one = grouped.groupBy(table, "row", "__g").agg(F.min(filled).alias("__low"), F.max(filled).alias("__high"))
    text = F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(F.col("text"))
    return grouped.join(one, [table, "row", "__g"]).withColumn("text", text).select(*cells.columns)


def schedule_circuits(cells: DataFrame, table: str) -> DataFrame:
    """(table, col, code, breaker, circuit_no, cable, load, power): a row per column that names a box; empty where the table has no such row.

    cells: table, row, col, text, ruled (the border at a cell's left is drawn through its row), top, bottom. A table without a
    label column or a row of codes gives none; a column whose code is a row name is none. A box has all the columns with its code.
    """
    clean = realign(cells, table).withColumn("text", clean_cell(F.col("text")))
    labels = label_columns(clean, table)
    roles = role_rows(clean, labels, table)
    rows = fill_merged(clean, table).join(roles, [table, "row"]).join(labels, table).where("col <> label")
    wide = rows.groupBy(table, "col").pivot("role", list(FIELDS)).agg(F.first("text"))
    named = wide.where((F.coalesce("code", F.lit("")) != "") & (cell_role(F.col("code")) == ""))
    return named.select(table, "col", "code", *(F.coalesce(f, F.lit("")).alias(f) for f in FIELDS[1:]))

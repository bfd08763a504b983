"""ASCII DXF as tables: group-code pairs, entities and their texts, file checks and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.drawings import explode_blocks, insert_matrix


def drawing_files(spark: SparkSession, path: str, least_bytes: int = 200) -> DataFrame:
    """(path, sha256, length, sound): a drawing is sound if it is long enough, has a SECTION near its head and EOF at its tail."""
    raw = spark.read.format("binaryFile").load(path)
    head, tail = F.substring("content", 1, 65536).cast("string"), F.substring("content", -1024, 1024).cast("string")
    return raw.select("path", F.sha2("content", 256).alias("sha256"), "length", ((F.col("length") >= least_bytes) & F.contains(head, F.lit("SECTION")) & F.contains(tail, F.lit("EOF"))).alias("sound"))


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, code, value): the group-code pairs of each drawing in order."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "\r?\n").alias("x"))
    numbers = F.sequence(F.lit(0), F.greatest(F.floor(F.size("x") / 2).cast("int") - 1, F.lit(0)))
    rows = text.select("path", F.explode(F.transform(numbers, lambda i: F.struct(i.alias("n"), F.trim(F.get("x", 2 * i)).try_cast("int").alias("code"), F.get("x", 2 * i + 1).alias("value")))).alias("p"))
    return rows.select("path", "p.n", "p.code", "p.value").where("code IS NOT NULL")


def entities(spark: SparkSession, path: str) -> DataFrame:
    """(path, entity, section, block, base_x, base_y, kind, name, handle, layer, x, y, height, scale_x, scale_y, degrees, text): what a drawing holds, in order.

    block is the definition that an entity stands in, with its base point; null outside of definitions. A drawing is walked in
    the order of its pairs, so its entities are in one partition, as pairs of one file are read together.
    """
    by = Window.partitionBy("path").orderBy("n")
    rows = pairs(spark, path).withColumn("entity", F.sum(F.when(F.col("code") == 0, 1).otherwise(0)).over(by))
    first = lambda code: F.min_by(F.when(F.col("code") == code, F.col("value")), F.when(F.col("code") == code, F.col("n")))
    number = {10: "x", 20: "y", 40: "height", 41: "scale_x", 42: "scale_y", 50: "degrees"}
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("code").isin(1, 3), F.struct("n", "value")))), lambda s: s["value"]), "")
    each = rows.groupBy("path", "entity").agg(F.trim(first(0)).alias("kind"), F.trim(first(2)).alias("name"), F.trim(first(5)).alias("handle"), first(8).alias("layer"), *(first(c).try_cast("double").alias(a) for c, a in number.items()), text.alias("text"))
    so_far = Window.partitionBy("path").orderBy("entity").rowsBetween(Window.unboundedPreceding, 0)
    kind, edge = F.col("kind"), F.col("kind").isin("BLOCK", "ENDBLK")
    opened = F.last(F.when(edge, F.struct(F.when(kind == "BLOCK", F.col("name")).alias("block"), F.col("x").alias("base_x"), F.col("y").alias("base_y"))), ignorenulls=True).over(so_far)
    placed = each.withColumns({"section": F.last(F.when(kind == "SECTION", F.col("name")), ignorenulls=True).over(so_far), "__b": opened})
    return placed.select("path", "entity", "section", "__b.block", "__b.base_x", "__b.base_y", "kind", "name", "handle", "layer", *number.values(), "text")


def text_entities(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, kind, layer, x, y, height, text) of TEXT, MTEXT and ATTRIB entities outside of block definitions, from the top of the sheet down and left to right."""
    texts = entities(spark, path).where(F.col("kind").isin("TEXT", "MTEXT", "ATTRIB") & F.col("block").isNull()).withColumn("text", plain_text(F.col("text")))
    return texts.select("path", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("y"), "x", "entity")).alias("ord"), "kind", "layer", "x", "y", "height", "text")


def drawing_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, kind, layer, handle, x, y, height, text, insert_path): the texts of a drawing at their places on the sheet, those of inserted blocks too.

    insert_path (array) names the inserts that a block's text came through, as block@handle: a text of a block inserted
    several times is there each time, told apart by its path. Texts outside of blocks have an empty one.
    """
    found = entities(spark, path)
    texts = found.where(F.col("kind").isin("TEXT", "MTEXT", "ATTRIB") & F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("text", plain_text(F.col("text"))).where("text <> ''")
    cols = ["path", "block", "kind", "layer", "handle", "x", "y", "height", "text"]
    bases = found.where("kind = 'BLOCK'").groupBy("path", F.col("name").alias("of")).agg(F.first("base_x").alias("bx"), F.first("base_y").alias("by"))
    placed = found.where("kind = 'INSERT'").withColumnRenamed("block", "owner").join(bases.withColumnRenamed("path", "__path"), (F.col("path") == F.col("__path")) & (F.col("name") == F.col("of")))
    matrix = insert_matrix(*(F.col(c) for c in ("x", "y", "scale_x", "scale_y", "degrees", "bx", "by")))
    inserts = placed.select("path", F.concat_ws("@", "name", F.coalesce("handle", F.col("entity").cast("string"))).alias("insert_id"), "owner", F.col("name").alias("block"), matrix.alias("m")).select("path", "insert_id", "owner", "block", "m.*")
    inner = explode_blocks(texts.where("block IS NOT NULL").select(*(F.col(c).alias("sheet" if c == "path" else c) for c in cols)), inserts.withColumnRenamed("path", "sheet"), ["sheet"])
    inner = inner.withColumnRenamed("path", "insert_path").withColumnRenamed("sheet", "path")
    return texts.where("block IS NULL").select(*cols, F.array().cast("array<string>").alias("insert_path")).unionByName(inner)


def plain_text(c):
    """Drawing text without format codes: %%c is a diameter, %%d a degree, %%p plus-minus, %%nnn a character by its number; \\P ends a line, other switches and braces go."""
    for code, sign in (("[cC]", "Ø"), ("[dD]", "°"), ("[pP]", "±"), ("[uUoO]", "")):
        c = F.regexp_replace(c, f"%%{code}", sign)
    parts = F.split(c, "%%(?=[0-9]{3})")
    c = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.char(F.left(p, F.lit(3)).try_cast("int")), F.substring(p, 4, 1 << 30)))), "")
    c = F.regexp_replace(F.regexp_replace(c, "\\\\P", "\n"), "\\\\[A-OQ-Za-z][^;\\\\]*;", "")
    return F.regexp_replace(c, "[{}]", "")

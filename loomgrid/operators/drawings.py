"""Drawings: texts and bounds of nested blocks, riser columns, and marks of extracted rows against confirmed ones."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import code_of
from ..sources.staged import staged
from .graphs import claim_once

#: How deep inserts are followed below a block.
DEPTH = 4


def insert_matrix(x: Column, y: Column, scale_x: Column, scale_y: Column, degrees: Column, base_x: Column, base_y: Column) -> Column:
    """struct(a, b, c, d, e, f) of an insert at (x, y): scaled about the block's base point, turned, moved; (x, y) becomes (a x + b y + e, c x + d y + f)."""
    one = lambda c: F.coalesce(c, F.lit(1.0))
    none = lambda c: F.coalesce(c, F.lit(0.0))
    turn = F.radians(none(degrees))
    a, b, c, d = F.cos(turn) * one(scale_x), -F.sin(turn) * one(scale_y), F.sin(turn) * one(scale_x), F.cos(turn) * one(scale_y)
    return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), (x - a * none(base_x) - b * none(base_y)).alias("e"), (y - c * none(base_x) - d * none(base_y)).alias("f"))


def _moved(x: Column, y: Column) -> tuple[Column, Column]:
    return F.col("a") * x + F.col("b") * y + F.col("e"), F.col("c") * x + F.col("d") * y + F.col("f")


def local_texts(texts: DataFrame, inserts: DataFrame, keys: Sequence[str] = (), depth: int = DEPTH) -> DataFrame:
    """texts of every block in the block's own coordinates, those of inserted blocks too, with path (array of the inserts they came through).

    texts has keys (a drawing), block, x, y and more; inserts has keys, insert_id, owner (the block it stands in, null in model space), block
    and a matrix a to f. One join a level, each from the inner blocks outwards, so a block inserted a thousand times is worked
    out once; an insert that leads back to a block on its way is left out, and so is what lies deeper than depth inserts.
    """
    inner = inserts.where("owner IS NOT NULL").select(*keys, "insert_id", F.col("owner").alias("__owner"), "block", "a", "b", "c", "d", "e", "f")
    level = texts.withColumns({"path": F.array().cast("array<string>"), "__seen": F.array("block")})
    out = [level]
    for _ in range(depth):
        x, y = _moved(F.col("x"), F.col("y"))
        level = staged(level.join(inner, [*keys, "block"]).where(~F.array_contains("__seen", F.col("__owner"))).withColumns({"__x": x, "__y": y}).withColumns({"x": F.col("__x"), "y": F.col("__y"), "block": F.col("__owner"), "path": F.concat(F.array(F.col("insert_id").cast("string")), "path"), "__seen": F.concat(F.array("__owner"), "__seen")}).select(*level.columns))
        if level.isEmpty():
            break
        out.append(level)
    return reduce(DataFrame.unionByName, out).drop("__seen")


def explode_blocks(texts: DataFrame, inserts: DataFrame, keys: Sequence[str] = (), depth: int = DEPTH) -> DataFrame:
    """The texts of all blocks inserted in model space at their places there, with block (the outermost) and path from it inwards."""
    outer = inserts.where("owner IS NULL").select(*keys, F.col("insert_id").cast("string").alias("__i"), "block", "a", "b", "c", "d", "e", "f")
    local = local_texts(texts, inserts, keys, depth)
    x, y = _moved(F.col("x"), F.col("y"))
    placed = local.join(outer, [*keys, "block"]).withColumns({"__x": x, "__y": y, "path": F.concat(F.array("__i"), "path")})
    return placed.withColumns({"x": F.col("__x"), "y": F.col("__y")}).select(*local.columns)


def block_bounds(bounds: DataFrame, inserts: DataFrame, keys: Sequence[str] = (), depth: int = DEPTH) -> DataFrame:
    """(keys..., block, x0, y0, x1, y1): bounds of a block's own shapes and of the blocks inserted in it, each as the corners of its bounds."""
    ends = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    own = bounds.select(*keys, "block", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    inner = inserts.where("owner IS NOT NULL").select(*keys, F.col("owner").alias("__owner"), "block", "a", "b", "c", "d", "e", "f")
    now = own.groupBy(*keys, "block").agg(*ends)
    for _ in range(depth):
        corners = [_moved(F.col(x), F.col(y)) for x in ("x0", "x1") for y in ("y0", "y1")]
        box = [F.least(*(c[0] for c in corners)).alias("x0"), F.least(*(c[1] for c in corners)).alias("y0"), F.greatest(*(c[0] for c in corners)).alias("x1"), F.greatest(*(c[1] for c in corners)).alias("y1")]
        met = now.join(inner, [*keys, "block"]).select(*keys, F.col("__owner").alias("block"), *box)
        now = staged(own.unionByName(met).groupBy(*keys, "block").agg(*ends))
    return now


def step_matches(gap: float, step: float, slack: float) -> bool:
    """A gap of about one or two steps: off a whole number of them by slack at most."""
    whole = round(gap / step) if step > 0 else 0
    return 1 <= whole <= 2 and abs(gap / step - whole) <= slack


def risers(codes: DataFrame, keys: Sequence[str], code: str, x: str, y: str, height: str, tolerance: float = 2, least: int = 4, slack: float = 0.35, highest: float = 40) -> DataFrame:
    """(keys..., code, x, y): codes that stand in a riser, a column in which at least so many different codes follow one another in even steps.

    A band is what lies within tolerance heights along x of one of its own places, so a sheet isn't chained into one column. A
    band is walked upwards: a row less than half a height above the last one is passed over, the first gap between two and
    highest heights is the step, and rows follow while gaps match one or two steps; anything else begins anew. Bands are those of
    one drawing (keys), so a task walks one column of one drawing at a time.
    """
    p = codes.select(*keys, F.col(code).alias("__code"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), F.col(height).cast("double").alias("__h")).dropna()
    wide = F.col("__h") * tolerance
    seeds = p.groupBy(*keys, F.col("__x").alias("__seed")).agg(F.max("__h").alias("__sh")).withColumn("__cell", F.explode(F.array(*(F.floor(F.col("__seed") / (F.col("__sh") * tolerance)) + i for i in (-1, 0, 1))))).drop("__sh")
    bands = p.withColumn("__cell", F.floor(F.col("__x") / wide)).join(seeds, [*keys, "__cell"]).where(F.abs(F.col("__x") - F.col("__seed")) <= wide).drop("__cell")

    def walk(band: pd.DataFrame) -> pd.DataFrame:
        rows = band.sort_values(["__y", "__x", "__code"], kind="stable")
        kept, run, last, step = [], [], None, None
        for i, (place, h) in enumerate(zip(rows["__y"], rows["__h"], strict=True)):
            gap = None if last is None else place - last
            if gap is not None and gap <= h / 2:
                continue
            if gap is not None and step is None and 2 * h <= gap <= highest * h:
                step = gap
            elif gap is None or step is None or gap > 2 * highest * h or not step_matches(gap, step, slack):
                kept += [run] if step is not None else []
                run, step = [], None
            run.append(i)
            last = place
        kept += [run] if step is not None else []
        names = rows["__code"].tolist()
        found = [i for r in kept if len({names[i] for i in r}) >= least for i in r]
        return rows.iloc[found]

    found = bands.groupBy(*keys, "__seed").applyInPandas(walk, bands.schema)
    return found.select(*keys, F.col("__code").alias(code), F.col("__x").alias(x), F.col("__y").alias(y)).distinct()


def match_rows(gold: DataFrame, said: DataFrame, drawing: str, row_id: str, number: str, box: str) -> DataFrame:
    """(drawing, gold_id, said_id, tier): which extracted row each confirmed row takes, in the order of row_id, none twice.

    A numbered row takes the first free row with its number and box (tier 1), else the first free one with its number (2); a row
    without a number takes the first free one of its box without a number (3). Numbers and boxes are compared as codes.
    """
    form = lambda df, name: df.select(F.col(drawing).alias(f"__d{name}"), F.col(row_id).alias(f"{name}_id"), code_of(F.col(number)).alias(f"__n{name}"), code_of(F.col(box)).alias(f"__b{name}"))
    g, s = form(gold, "gold"), form(said, "said")
    same = (F.col("__dgold") == F.col("__dsaid")) & (F.col("__ngold") == F.col("__nsaid"))
    numbered = g.where("__ngold <> ''").join(s.where("__nsaid <> ''"), same).withColumn("tier", F.when(F.col("__bgold") == F.col("__bsaid"), 1).otherwise(2))
    bare = g.where("__ngold = ''").join(s.where("__nsaid = ''"), same & (F.col("__bgold") == F.col("__bsaid"))).withColumn("tier", F.lit(3))
    pairs = numbered.unionByName(bare).select(F.col("__dgold").alias(drawing), "gold_id", "said_id", "tier", F.struct("__dgold", "gold_id").alias("__g"), F.struct("__dsaid", "said_id").alias("__s"), F.col("gold_id").alias("__first"))
    return claim_once(pairs, "__g", "__s", ["__first", "tier"]).select(drawing, "gold_id", "said_id", "tier")


def score_rows(gold: DataFrame, said: DataFrame, drawing: str, row_id: str, number: str, box: str, fields: Sequence[str]) -> DataFrame:
    """One row per drawing of either side: gold, said, split (matched in their box), content (all fields equal as codes too), extra (said rows not taken), and recall and precision of split and content; an empty denominator gives 1."""
    found = match_rows(gold, said, drawing, row_id, number, box)
    g = gold.select(F.col(drawing).alias("__gd"), F.col(row_id).alias("__gi"), code_of(F.col(box)).alias("__gb"), *(code_of(F.col(f)).alias(f"__g_{f}") for f in fields))
    s = said.select(F.col(drawing).alias("__sd"), F.col(row_id).alias("__si"), code_of(F.col(box)).alias("__sb"), *(code_of(F.col(f)).alias(f"__s_{f}") for f in fields))
    met = found.join(g, (F.col(drawing) == F.col("__gd")) & (F.col("gold_id") == F.col("__gi"))).join(s, (F.col(drawing) == F.col("__sd")) & (F.col("said_id") == F.col("__si")))
    split = F.col("__gb") == F.col("__sb")
    equal = reduce(lambda a, f: a & (F.col(f"__g_{f}") == F.col(f"__s_{f}")), fields, split)
    hits = met.groupBy(drawing).agg(F.count("*").alias("taken"), F.count_if(split).alias("split"), F.count_if(equal).alias("content"))
    sizes = gold.groupBy(drawing).agg(F.count("*").alias("gold")).join(said.groupBy(drawing).agg(F.count("*").alias("said")), drawing, "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = sizes.join(hits, drawing, "left").select(drawing, *map(zero, ("gold", "said", "taken", "split", "content"))).withColumn("extra", F.col("said") - F.col("taken"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), b), F.lit(1.0))
    rates = {f"{n}_{k}": ratio(n, F.col("gold") if k == "recall" else F.col(n) + F.col("extra")) for n in ("split", "content") for k in ("recall", "precision")}
    return out.withColumns(rates).drop("taken")

"""Distribution trees from box and circuit lists: types, links read from texts, virtual nodes, and the tree as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.panels import panel_codes, tokens
from ..sources.staged import staged
from .hierarchy import tree_paths

# Words in names of control drawings and main cabinets, families of main cabinets, marks of a named upstream box, the note where none is named, a box without a name.
SECONDARY = ("二次", "控制原理", "控制电路", "原理图", "二次接线")
CABINETS = ("总配电", "动力总", "进线柜", "变压器出线", "低压配电屏", "主配", "总箱", "母线联络")
CABINET_FAMILIES = ("AA", "ALZ", "APZ", "ZAP", "GGD", "MNS", "GCK", "GCS")
UPSTREAM, NO_UPSTREAM, UNNAMED = ("上级", "引自", "引来"), "上级箱号未在图中标明", "配电箱"
#: Levels below a root.
DEPTH = 6


def box_type(code: Column, name: Column) -> Column:
    """secondary (a control drawing) before cabinet (by name, then by code: a family between digits, or one ending in ALZ or APZ) before box."""
    main = code.rlike(f"(?i)^[0-9]*(?:{'|'.join(CABINET_FAMILIES)})[0-9]*$|^[0-9A-Z]*A[LP]Z[0-9]*$")
    return F.when(name.rlike("|".join(SECONDARY)), "secondary").when(name.rlike("|".join(CABINETS)) | main, "cabinet").otherwise("box")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def all_boxes(boxes: DataFrame, circuits: DataFrame) -> DataFrame:
    """(job, code, name, note, ord, virtual): the first row of each box code, then a virtual box for each code that only circuits name."""
    listed = boxes.where(_text("code") != "").groupBy("job", "code").agg(F.min_by(F.struct(_text("name").alias("name"), _text("note").alias("note")), "ord").alias("b"), F.min("ord").cast("long").alias("ord"))
    named = circuits.where(_text("box") != "").groupBy("job", F.col("box").alias("code")).agg(F.min("ord").cast("long").alias("first"))
    both = listed.join(named, ["job", "code"], "full_outer")
    name = F.when(F.coalesce(F.col("b.name"), F.lit("")) != "", F.col("b.name")).otherwise(UNNAMED)
    return both.select("job", "code", name.alias("name"), F.coalesce("b.note", F.lit("")).alias("note"), F.coalesce("ord", F.col("first") + (1 << 40)).alias("ord"), F.col("b").isNull().alias("virtual"))


def links(nodes: DataFrame, circuits: DataFrame) -> DataFrame:
    """(job, child, parent, feed, downstream): of all links that circuits state, the first one for each child.

    A load name or note with an upstream mark names the parent of the circuit's own box, the first known code in it. Any other
    text feeds each known box that it names as a whole word. Codes are taken out of the texts and joined to the known ones,
    so no text is tried against every code. First means: by the feeding box, its circuit, upstream before downstream, the
    load name before the note, the place in the text.
    """
    known = nodes.select("job", F.col("code").alias("other"), F.upper("code").alias("__key"))
    own = nodes.select("job", F.col("code").alias("box"), F.col("ord").alias("box_ord"))
    texts = circuits.join(own, ["job", "box"]).select("job", "box", "box_ord", "ord", _text("circuit_no").alias("feed"), F.posexplode(F.array(_text("load_name"), _text("note"))).alias("field", "text"))
    up = F.col("text").rlike("|".join(UPSTREAM))
    found = F.when(up, panel_codes(F.col("text"))).otherwise(F.array_distinct(tokens(F.col("text"))))
    said = texts.select("job", "box", "box_ord", "ord", "feed", "field", (~up).cast("int").alias("down"), F.posexplode(found).alias("at", "__key"))
    met = said.join(known, ["job", "__key"]).where("other <> box")
    place = F.struct("box_ord", "ord", "down", "field", "at", "other")
    child, parent = F.when(F.col("down") == 1, F.col("other")).otherwise(F.col("box")), F.when(F.col("down") == 1, F.col("box")).otherwise(F.col("other"))
    best = met.select("job", child.alias("child"), parent.alias("parent"), "feed", (F.col("down") == 1).alias("downstream"), place.alias("p")).groupBy("job", "child").agg(F.min(F.struct("p", "parent", "feed", "downstream")).alias("m"))
    return best.select("job", "child", "m.parent", "m.feed", "m.downstream")


def _control_links(nodes: DataFrame, circuits: DataFrame) -> DataFrame:
    """Parents of control drawings: the box whose code stands before their last hyphen, else the first circuit that refers to them."""
    base = F.regexp_extract("code", "^(.+)-[^-]*$", 1)
    drawn = nodes.where("type = 'secondary'").select("job", F.col("code").alias("child"), base.alias("base"), F.upper("code").alias("__key"))
    by_code = drawn.join(nodes.select("job", F.col("code").alias("base")), ["job", "base"]).select("job", "child", F.col("base").alias("parent"), F.lit("").alias("feed"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("box_ord"), F.lit(0).cast("long").alias("ord"))
    refs = circuits.where(_text("secondary_ref") != "").join(nodes.select("job", F.col("code").alias("box"), F.col("ord").alias("box_ord")), ["job", "box"])
    refs = refs.select("job", F.col("box").alias("parent"), _text("circuit_no").alias("feed"), "box_ord", F.col("ord").cast("long").alias("ord"), F.explode(F.array_distinct(F.array_append(tokens(F.col("secondary_ref")), F.upper("secondary_ref")))).alias("__key"))
    by_ref = refs.join(drawn, ["job", "__key"]).where("parent <> child").select("job", "child", "parent", "feed", F.lit(1).alias("rank"), "box_ord", "ord")
    best = by_code.unionByName(by_ref).groupBy("job", "child").agg(F.min(F.struct("rank", "box_ord", "ord", "parent", "feed")).alias("m"))
    return best.select("job", "child", "m.parent", "m.feed", F.lit(False).alias("downstream"))


def distribution_tree(boxes: DataFrame, circuits: DataFrame) -> DataFrame:
    """(job, code, name, type, parent, feed, circuits, kw, note, depth, virtual, path): the tree of each job, a row per node.

    boxes: job, ord, code, name, note; circuits: job, ord, box, circuit_no, load_name, note, secondary_ref, power_kw. A box
    that feeds another one is a cabinet unless it is a control drawing; a control drawing without a link hangs on its box; a
    reference to a drawing that is no box is a virtual node. kw is the sum of the first number of each circuit, in tenths
    (null if none is above zero). path (codes from the root with the ranks of their types) sorts a job's rows in the
    order of the tree, children by type and code. Boxes on a cycle of links hang on no root and are left out, as is what
    lies deeper than DEPTH. A missing upstream is said in the note where a text speaks of one without naming it.
    """
    known = all_boxes(boxes, circuits)
    first = links(known, circuits)
    typed = known.withColumn("type", box_type(F.col("code"), F.col("name")))
    control = _control_links(typed, circuits).join(first.select("job", "child"), ["job", "child"], "left_anti")
    parents = staged(first.unionByName(control))
    feeds = parents.where("downstream").select("job", F.col("parent").alias("code")).distinct().withColumn("__feeds", F.lit(True))
    nodes = staged(typed.join(feeds, ["job", "code"], "left").withColumn("type", F.when(F.col("__feeds") & (F.col("type") != "secondary"), "cabinet").otherwise(F.col("type"))).drop("__feeds"))
    number = F.regexp_extract(_text("power_kw"), "[0-9]*[.]?[0-9]+", 0).try_cast("decimal(18,4)")
    marked = F.col("t").rlike("|".join(UPSTREAM))
    loads = circuits.groupBy("job", F.col("box").alias("code")).agg(F.count("*").alias("circuits"), F.sum(number).alias("kw"))
    spoken = circuits.select("job", F.col("box").alias("code"), F.explode(F.array(_text("load_name"), _text("note"))).alias("t")).unionByName(known.select("job", "code", F.col("note").alias("t")))
    spoken = spoken.where(marked).groupBy("job", "code").agg(F.bool_or(F.size(panel_codes(F.col("t"))) > 0).alias("__named"))
    refs = circuits.where(_text("secondary_ref") != "").join(known.select("job", F.col("code").alias("secondary_ref")), ["job", "secondary_ref"], "left_anti")
    refs = refs.groupBy("job", F.col("box").alias("parent"), F.col("secondary_ref").alias("code")).agg(F.min_by(F.struct(_text("circuit_no").alias("feed"), _text("load_name").alias("load"), _text("power_kw").alias("kw")), "ord").alias("m"))
    drawn = refs.select("job", "code", F.concat(F.when(F.col("m.load") != "", F.col("m.load")).otherwise(F.col("m.feed")), F.lit(" 控制原理图")).alias("name"), F.lit("secondary").alias("type"), "parent", F.col("m.feed").alias("feed"), F.lit(0).cast("long").alias("circuits"), F.regexp_extract("m.kw", "[0-9]*[.]?[0-9]+", 0).try_cast("decimal(18,4)").alias("kw"), F.lit("").alias("note"), F.lit(True).alias("virtual"))
    full = nodes.join(parents.select("job", F.col("child").alias("code"), "parent", "feed"), ["job", "code"], "left").join(loads, ["job", "code"], "left").join(spoken, ["job", "code"], "left")
    lost = F.col("parent").isNull() & ~F.coalesce("__named", F.lit(True)) & ~F.contains("note", F.lit(NO_UPSTREAM))
    note = F.when(lost, F.concat_ws("；", F.nullif(F.col("note"), F.lit("")), F.lit(NO_UPSTREAM))).otherwise(F.col("note"))
    rows = full.select("job", "code", "name", "type", "parent", F.coalesce("feed", F.lit("")).alias("feed"), F.coalesce("circuits", F.lit(0)).cast("long").alias("circuits"), "kw", note.alias("note"), "virtual").unionByName(drawn)
    root = F.col("parent").isNull()
    rank = F.when(F.col("type") == "secondary", 2).when((F.col("type") == "cabinet") == root, 0).otherwise(1)
    rows = staged(rows.withColumns({"rank": rank, "node": F.struct("job", "code", "virtual", F.when(F.col("virtual") & ~root, F.col("parent")).alias("under")), "above": F.when(~root, F.struct("job", F.col("parent").alias("code")))}))
    heads = rows.groupBy("job", "code").agg(F.min("node").alias("__up")).select(F.struct("job", "code").alias("above"), "__up")
    edges = rows.join(heads, "above", "left").select("node", F.col("__up").alias("parent"), F.struct("rank", "code").alias("__step"))
    paths = tree_paths(edges.select("node", "parent"), max_depth=DEPTH)
    steps = edges.select("node", "__step")
    sort_key = paths.select("node", "depth", F.posexplode("path").alias("at", "n")).join(steps.withColumnRenamed("node", "n"), "n").groupBy("node", "depth").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "__step"))), lambda x: x["__step"]).alias("path"))
    tenths = F.when(F.col("kw") > 0, F.round("kw", 1).cast("decimal(18,1)"))
    return rows.join(sort_key, "node").select("job", "code", "name", "type", F.coalesce("parent", F.lit("")).alias("parent"), "feed", "circuits", tenths.alias("kw"), "note", "depth", "virtual", "path")

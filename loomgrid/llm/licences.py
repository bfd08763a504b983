"""License scans by diagonal voting: rolling word k-grams meet template positions, offsets vote, neighbouring diagonals merge, spans are verified."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii, materialize

WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
GRAM = 3
#: Templates are given with the call; their k-grams are broadcast only up to this number, and beyond it joined by shuffle.
BROADCAST_GRAMS = 50_000

# Phrases and labels of the base rule, and short license notices as their owners publish them.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",),
    "cc-by-nd": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",),
    "cc-by-nc-sa": ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",),
    "cc-by-nc-nd": ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",),
    "gpl-2": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "lgpl-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "lgpl-3": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "agpl-3": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "mpl-2": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "gpl-3": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
}
#: Words that tell near relatives apart: those that a span of the label must have, and those that it must not have.
_CC, _GNU = frozenset("noncommercial sharealike noderivatives noderivs nc sa nd".split()), frozenset("lesser library affero".split())
REQUIRED = {
    "cc-by": (("attribution",), _CC),
    "cc-by-sa": (("sharealike",), _CC - {"sharealike", "sa"}),
    "cc-by-nd": (("noderivatives",), _CC - {"noderivatives", "noderivs", "nd"}),
    "cc-by-nc": ((), _CC - {"noncommercial", "nc"}),
    "cc-by-nc-sa": (("noncommercial", "sharealike"), _CC - {"noncommercial", "nc", "sharealike", "sa"}),
    "cc-by-nc-nd": (("noncommercial", "noderivatives"), _CC - {"noncommercial", "nc", "noderivatives", "noderivs", "nd"}),
    "gpl-2": (("2",), _GNU),
    "gpl-3": (("3",), _GNU),
    "lgpl-2.1": (("lesser", "2", "1"), frozenset({"affero"})),
    "lgpl-3": (("lesser", "3"), frozenset({"affero"})),
    "agpl-3": (("affero", "3"), frozenset({"lesser"})),
    "apache-2": (("apache", "2"), frozenset()),
    "mpl-2": (("mozilla", "2"), frozenset()),
}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def rolling_grams(words: Column, k: int) -> Column:
    """Hashes of all k-word windows of an array of words, in order."""
    h = F.transform(words, lambda w: F.xxhash64(w))
    out = h
    for step in range(1, k):
        out = F.zip_with(out, F.slice(h, step + 1, F.greatest(F.size(h) - step, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.slice(out, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))


def template_grams(spark, templates: Mapping[str, tuple[str, ...]], k: int) -> DataFrame:
    """(template, label, size, at, gram, h): the k-grams of every template; size is their number in the template."""
    rows = [(f"{label}/{i}", label, text) for label, texts in templates.items() for i, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "template string, label string, text string").withColumn("w", words_of(F.col("text")))
    table = table.withColumn("g", rolling_grams(F.col("w"), k)).select("template", "label", "w", F.size("g").alias("size"), F.posexplode("g").alias("at", "h"))
    return table.select("template", "label", "size", "at", F.slice("w", F.col("at") + 1, k).alias("gram"), "h")


def license_spans(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, k: int = GRAM, gap: int = 2, least_cover: float = 0.8, required: Mapping[str, tuple] = REQUIRED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, template, label, first_word, last_word long, cover double): verified spans of templates in whole texts.

    Every k-gram of every text is joined to the template positions with the same hash; the words are then compared, so a
    hash alone proves nothing. Hits are counted per offset (position in the text less position in the template), summed
    in the tasks before the shuffle; offsets at most gap apart that follow one another merge, which bridges words put in
    or left out. A span stands if its share of the template's k-grams (cover) is at least least_cover, it is no longer
    than the template by more than half, and the words in and beside its k-grams have what required says of its label. Of
    spans that overlap only the one with the best cover stays (of those the longest, then the least label), so a notice
    has one label. Rows with a null id or text find nothing; rows that repeat an id count as one; a very long text is a
    longer array in its row; an empty table gives an empty one.
    """
    grams = template_grams(docs.sparkSession, templates, k)
    few = grams.count() <= BROADCAST_GRAMS
    words = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    # outer: a text without grams gives a null that joins nothing; else Spark would build all grams once more to test for empty arrays
    each = words.select("id", "words", F.posexplode_outer(rolling_grams(F.col("words"), k)).alias("pos", "hash"))
    here = F.slice("words", F.col("pos") + 1, k)
    telling = sorted({w for must, without in required.values() for w in (*must, *without)})
    low = F.greatest(F.col("pos") + 1 - gap, F.lit(1))
    beside = F.filter(F.slice("words", low, F.col("pos") + 1 + k + gap - low), lambda w: w.isin(telling))
    if few:
        hits = each.join(F.broadcast(grams), F.col("hash") == F.col("h")).where(here == F.col("gram")).withColumn("beside", beside)
    else:  # only a gram's own words go through the shuffle, not its text's
        hits = each.select("id", "pos", "hash", here.alias("here"), beside.alias("beside")).join(grams, F.col("hash") == F.col("h")).where("here = gram")
    diagonals = hits.groupBy("id", "template", "label", "size", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.collect_set("at").alias("ats"), F.collect_set("beside").alias("beside"))
    order = Window.partitionBy("id", "template").orderBy("diagonal")
    joined = (F.col("diagonal") - F.lag("diagonal").over(order) <= gap) & (F.col("low") - F.lag("high").over(order) <= k + gap)
    runs = diagonals.withColumn("run", F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(order))
    spans = runs.groupBy("id", "template", "label", "size", "run").agg(F.min("low").alias("first_word"), (F.max("high") + (k - 1)).alias("last_word"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("n"), F.array_distinct(F.flatten(F.flatten(F.collect_list("beside")))).alias("seen"))
    spans = spans.withColumn("cover", F.col("n") / F.col("size")).where((F.col("cover") >= least_cover) & (F.col("last_word") - F.col("first_word") + 1 <= 1.5 * (F.col("size") + k - 1) + 1))
    fits = F.lit(True)
    for label, (must, without) in required.items():
        own = F.forall(F.array(*map(F.lit, must)).cast("array<string>"), lambda w: F.array_contains("seen", w)) & ~F.arrays_overlap("seen", F.array(*map(F.lit, sorted(without))).cast("array<string>"))
        fits = F.when(F.col("label") == label, own).otherwise(fits)
    spans = spans.where(fits)
    before = Window.partitionBy("id").orderBy("first_word", "last_word", "template").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.col("first_word") > F.max("last_word").over(before), F.lit(True))
    places = spans.withColumn("apart", apart).withColumn("place", F.sum(F.col("apart").cast("int")).over(Window.partitionBy("id").orderBy("first_word", "last_word", "template")))
    best = F.row_number().over(Window.partitionBy("id", "place").orderBy(F.desc("cover"), F.desc("size"), "template"))
    return places.withColumn("best", best).where("best = 1").select("id", "template", "label", F.col("first_word").cast("long"), F.col("last_word").cast("long"), "cover")


def phrase_columns(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, text_col: str = "text") -> DataFrame:
    """docs with n_words, n_base (places of all phrases), first_word, last_word (least and greatest start, else null) and base (labels)."""
    out = docs.withColumn("__words", words_of(F.col(text_col)))
    out = out.withColumn("__line", F.concat(F.lit(" "), F.array_join("__words", "  "), F.lit(" ")))
    count, first, last, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in phrases.items():
        mark = " " + phrase.replace(" ", "  ") + " "
        has = F.contains(F.col("__line"), F.lit(mark))
        before = lambda part: F.expr("0") + F.floor((F.char_length(part) - F.char_length(F.replace(part, F.lit(" "), F.lit("")))) / 2)
        count = count + F.when(has, F.floor((F.char_length("__line") - F.char_length(F.replace(F.col("__line"), F.lit(mark), F.lit("")))) / len(mark))).otherwise(0)
        first.append(F.when(has, before(F.substring_index("__line", mark, 1))))
        last.append(F.when(has, before(F.left(F.col("__line"), F.char_length("__line") - F.char_length(F.substring_index("__line", mark, -1)) - len(mark)))))
        labels.append(F.when(has, F.lit(label)))
    return out.select(*docs.columns, F.size("__words").cast("long").alias("n_words"), count.cast("long").alias("n_base"), F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"), F.array_compact(F.array(*labels)).alias("base"))


def license_labels(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col with the columns of phrase_columns(), base_labels, labels (distinct, sorted, comma-joined; empty if none) and score.

    score is the largest cover of a verified span, at least 1 where a base phrase stands, 0 if nothing is found. A null
    text is empty; a row with a null id gets its base labels only. One row per row of docs, none for an empty table.
    """
    spans = license_spans(docs, templates, id_col=id_col, text_col=text_col)
    found = materialize(spans.groupBy(F.col("id").alias("__id")).agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover")))
    base = phrase_columns(docs.select(id_col, text_col), phrases, text_col).drop(text_col)
    out = base.join(found, F.col(id_col) == F.col("__id"), "left")
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.least(F.coalesce("cover", F.lit(0.0)), F.lit(1.0)))
    return out.select(id_col, "n_words", "n_base", "first_word", "last_word", join(F.col("base")).alias("base_labels"), join(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"), score.alias("score"))


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    return license_labels(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op9_licenses": op9_licenses}

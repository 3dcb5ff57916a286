"""License scans by diagonal voting, with DataFrame functions only.

All word pairs of a text (rolling word 2-grams) are joined by hash to the positions of the
same pairs in notice templates and compared word by word. A hit at document word p and
template word t votes for diagonal p - t. Neighbouring diagonals (inserted or missing words) are
merged into bands. Within a band the best window is verified, never the band's hull: of all
stretches of at most STRETCH times the template's pairs that start at a hit, the one that holds most of
the template's different pairs, then the shorter, then the earlier. It is a span if it holds COVERED of
them. So hits that happen to lie near a true notice neither hide nor lengthen it. Of several
occurrences in one band (they share the label) the best is reported.

Templates have two words or more, and no upper bound. The default list of notices is fixed and is
broadcast; a table of notices is joined as Spark chooses.

A base phrase counts only where one diagonal carries all of its pairs: its words stand there
consecutively. `score` is the largest share of a template that a window covers.

Defined results: null text counts as empty and has no words; a text of one word has no pair
and no label; labels are distinct and sorted, '' if none. Equal rows, also of equal doc_id,
are scanned each on its own. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's pairs that a window must cover, and its length in these pairs.
COVERED, STRETCH = 0.8, 1.5
#: Diagonals this close are one band.
BAND = 2

#: The base phrases with their labels.
BASE = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
#: Notices as their licenses word them.
NOTICES = [
    ("apache", "licensed under the apache license version"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("gpl", "licensed under the gnu general public license version"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
]


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def templates(spark: SparkSession, notices: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """(tmpl, label, base, pairs, t, t1, t2, hash): one row for each word pair of the base phrases and
    of `notices`, a list or a table (label, text), which is cut into words as documents are."""
    rows = [F.struct(F.lit(k).cast("long").alias("tmpl"), F.lit(label).alias("label"), F.lit(k < len(BASE)).alias("base"), F.lit(text).alias("text"))
            for k, (label, text) in enumerate(BASE + (notices if isinstance(notices, list) else []))]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    if isinstance(notices, DataFrame):
        table = table.unionByName(notices.select((F.monotonically_increasing_id() + len(BASE)).alias("tmpl"), "label", F.lit(False).alias("base"), "text"))
    table = table.withColumn("ws", words(F.col("text"))).where(F.size("ws") > 1)
    pairs = F.posexplode(F.arrays_zip(F.expr("slice(ws, 1, size(ws) - 1)").alias("t1"), F.expr("slice(ws, 2, size(ws) - 1)").alias("t2")))
    return table.select("tmpl", "label", "base", (F.size("ws") - 1).alias("pairs"), pairs.alias("t", "p")).select(
        "tmpl", "label", "base", "pairs", "t", F.col("p.t1").alias("t1"), F.col("p.t2").alias("t2"),
        F.xxhash64("p.t1", "p.t2").alias("hash"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words and spans, an array of (label, base,
    first, last, coverage), words from 0."""
    table = templates(docs.sparkSession, NOTICES if notices is None else notices)
    if not isinstance(notices, DataFrame):
        table = F.broadcast(table)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("ws"))
    pairs = rows.select("row_id", "doc_id", F.size("ws").cast("long").alias("n_words"), F.posexplode_outer(
        F.arrays_zip(F.col("ws").alias("w1"), F.expr("slice(ws, 2, size(ws))").alias("w2"))).alias("p", "pair"))
    pairs = pairs.select("row_id", "doc_id", "n_words", F.coalesce("p", F.lit(0)).alias("p"), F.col("pair.w1").alias("w1"), F.col("pair.w2").alias("w2"))
    same = F.coalesce((F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")), F.lit(False))
    hits = pairs.join(table, F.xxhash64("w1", "w2") == F.col("hash"), "left").withColumn("same", same)
    # the first pair of each text stays without a hit too, so that every row has a result
    hits = hits.where("same or p = 0").select(
        "row_id", "doc_id", "n_words", F.when(F.col("same"), F.col("tmpl")).alias("tmpl"), "label", "base", "pairs", "p", "t",
        F.when(F.col("same"), F.col("p") - F.col("t")).alias("diagonal"))
    order = Window.partitionBy("row_id", "tmpl").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(order)
    fresh = F.coalesce(step > F.when(F.col("base"), 0).otherwise(BAND), F.lit(True))
    banded = hits.withColumn("fresh", fresh.cast("int")).withColumn("band", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the range takes a place or two too many; the filter is exact
    reach = F.floor(F.col("pairs") * STRETCH).cast("int")
    ahead = Window.partitionBy("row_id", "tmpl", "band").orderBy(F.col("p") / reach).rangeBetween(0, 1)
    near = F.filter(F.collect_list(F.struct("p", "t")).over(ahead), lambda x: x["p"] < F.col("p") + reach)
    windows = banded.withColumn("near", near).select(
        "row_id", "doc_id", "n_words", "tmpl", "band", "label", "base", "pairs", "p",
        F.size(F.array_distinct(F.transform("near", lambda x: x["t"]))).alias("held"), (F.array_max(F.transform("near", lambda x: x["p"])) + 1).alias("last"))
    best = F.min(F.struct((-F.col("held")).alias("held"), (F.col("last") - F.col("p")).alias("length"), F.col("p").alias("first"), "last", "label", "base", "pairs")).alias("best")
    bands = windows.groupBy("row_id", "doc_id", "n_words", "tmpl", "band").agg(best).select("row_id", "doc_id", "n_words", "tmpl", "best.*").withColumn(
        "coverage", -F.col("held") / F.col("pairs"))
    fits = F.when(F.col("base"), F.col("coverage") == 1).otherwise(F.col("coverage") >= COVERED)
    span = F.when(F.col("tmpl").isNotNull() & fits, F.struct("label", "base", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "coverage"))
    return bands.groupBy("row_id", "doc_id", "n_words").agg(
        F.array_sort(F.collect_list(span)).alias("spans"),
        F.coalesce(F.max(F.when(F.col("tmpl").isNotNull(), F.col("coverage"))), F.lit(0.0)).alias("score")).drop("row_id")


def report(spans: DataFrame) -> DataFrame:
    """The digest columns of scan()."""
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda a: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(a, lambda s: s["label"]))))
    starts = F.transform(base, lambda s: s["first"])
    return spans.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), listed(base).alias("base_labels"), listed(F.col("spans")).alias("labels"), "score")

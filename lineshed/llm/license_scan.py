"""License scan with DataFrame functions only: MinHash bands over windows, then exact containment.

Templates are cut into segments of at most `SEGMENT` five-word shingles, each place of a shingle in one segment. For
segments of m words a document is cut into overlapping windows of m + s - 1 words, s apart, with
s = 1 + (m - 4) div 4: any run of m words lies whole in one of them, and the window has at most 1.25 times
the segment's shingles, so that a window with a share c of them has a Jaccard similarity of c / (2.25 - c)
or more. At c = 0.8 that is 0.55, and `BANDS` bands of `ROWS` MinHash values meet with probability
1 - (1 - 0.55^2)^24, over 0.999. Found pairs are verified exactly: the share of the whole template's shingles
that the best windows of its segments hold must be `CONTAINMENT` or more.

A window gets MinHash values only if it holds an anchor: every template shingle has one of the anchor
words, so a window without any shares no shingle with any template.

Words are lower-cased runs of letters and digits. Edge cases: null, empty and word-less texts match
nothing, nor does an empty table; very long texts are read whole; of windows that hold as much of a segment
all count in n_windows and the first gives start_word; a template of fewer than five words has one shingle
of all its words; further columns of the documents, whatever their names, are ignored; rows with equal ids
are reported as one document; a null id is an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 5
SEGMENT = 40
BANDS, ROWS = 24, 2
CONTAINMENT = 0.8
#: An index of up to so many segments (some 50 MB) is sent to all tasks; a larger one is joined by a shuffle.
MOST_SENT = 5000

# Words that make poor anchors; a choice of speed only.
COMMON = "a all an and any are as at be been by can do for from had has have if in is it its may more no not of on or other out over shall so such than that the their them there these they this those to under up was were which who will with without you your".split()

# Notices by which texts state their license, as their publishers word them. Those that
# don't name a version stand for all versions of their license.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(NOTICES)], "template_id long, license string, template string")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def shingles(w: Column) -> Column:
    """Distinct hashes of the runs of SIZE words; of all words if they are fewer."""
    whole = F.array(F.xxhash64(F.array_join(w, " ")))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SIZE + 1, F.lit(1))), lambda k: F.xxhash64(F.array_join(F.slice(w, k, SIZE), " ")))
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) <= SIZE, whole).otherwise(F.array_distinct(runs))


def band_keys(s: Column) -> Column:
    """BANDS keys, each of ROWS MinHash values."""

    def least(seed: int) -> Column:
        return F.array_min(F.transform(s, lambda x: F.xxhash64(x, F.lit(seed))))

    return F.array(*[F.xxhash64(F.lit(b), *[least(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])


def segments(templates: DataFrame) -> DataFrame:
    """(template_id, license, segment, m, w, own, n_own): templates in parts of nearly as many shingles, at most SEGMENT.

    A shingle that stands in several parts counts in each.
    """
    w = templates.withColumn("w", words(F.col("template"))).filter("size(w) > 0")
    n = F.greatest(F.size("w") - (SIZE - 1), F.lit(1))
    w = w.withColumn("__n", n).withColumn("__parts", F.ceil(F.col("__n") / SEGMENT).cast("int"))
    first = lambda k: F.floor(k * F.col("__n") / F.col("__parts")).cast("int")
    cut = w.withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).withColumn("__first", first(F.col("segment")))
    size = F.greatest(first(F.col("segment") + 1) - F.col("__first"), F.lit(1)) + (SIZE - 1)
    cut = cut.withColumn("w", F.slice("w", F.col("__first") + 1, size)).withColumn("own", shingles(F.col("w")))
    return cut.select("template_id", "license", "segment", F.size("w").alias("m"), "w", "own", F.size("own").alias("n_own"))


def anchors(cut: DataFrame) -> list[str]:
    """For each shingle its longest uncommon word, the first by name of several: one of these is in every shingle."""
    runs = cut.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - SIZE + 1, F.lit(1))), lambda k: F.slice("w", k, SIZE))).alias("run"))
    rank = lambda x: F.struct((~x.isin(*COMMON)).alias("rare"), F.length(x).alias("n"), x.alias("x"))
    best = runs.select(F.array_max(F.transform("run", rank))["x"].alias("x"))
    return sorted(r["x"] for r in best.distinct().collect())  # at most the templates' words


def scan(docs: DataFrame, templates: DataFrame, text: str = "text", key: str = "doc_id", containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, template_id, license, containment, start_word, n_windows): the templates whose segments a document holds.

    containment is the share of the template's shingles that the best windows of its segments hold, n_windows
    how many windows hold that share of a segment, and start_word where the first of them begins.
    """
    cut = segments(templates)
    sizes = sorted(r["m"] for r in cut.select("m").distinct().collect())  # at most SEGMENT
    listed = anchors(cut)
    known = F.array(*[F.lit(a) for a in listed])
    found = docs.select(F.col(key).alias("doc_id"), words(F.col(text)).alias("w")).filter(F.arrays_overlap("w", known))
    at = F.filter(F.transform("w", lambda x, k: F.when(x.isin(*listed), k)), lambda k: k.isNotNull())
    located = found.withColumn("at", at)

    def starts(m: int) -> Column:
        """Multiples of the step whose windows hold an anchor."""
        step = 1 + max(0, (m - 4) // 4)
        size = m + step - 1
        each = F.transform("at", lambda p: F.sequence(F.greatest(F.ceil((p - size + 1) / step), F.lit(0)).cast("int"), F.floor(p / step).cast("int")))
        return F.transform(F.array_distinct(F.flatten(each)), lambda k: F.struct(F.lit(m).alias("m"), (k * step).cast("int").alias("start"), F.lit(size).alias("size")))

    windows = located.select("doc_id", "w", F.explode(F.concat(*[starts(m) for m in sizes])).alias("x")).select(
        "doc_id", "x.m", "x.start", shingles(F.slice("w", F.col("x.start") + 1, F.col("x.size"))).alias("s")
    )
    banded = windows.withColumn("band", F.explode(band_keys(F.col("s"))))
    totals = cut.groupBy("template_id").agg(F.sum("n_own").alias("n_all"))
    index = cut.join(totals, "template_id").select("template_id", "license", "segment", "n_all", "n_own", "m", "own", F.explode(band_keys(F.col("own"))).alias("band"))
    index = F.broadcast(index) if cut.count() <= MOST_SENT else index
    pairs = banded.join(index, ["m", "band"]).withColumn("held", F.size(F.array_intersect("s", "own"))).filter("held > 0")
    enough = F.col("held") / F.col("n_own") >= containment
    best = pairs.groupBy("doc_id", "template_id", "license", "segment", "n_all").agg(
        F.max("held").alias("held"), F.min(F.when(enough, F.col("start"))).alias("start"), F.min_by("start", F.struct(-F.col("held"), F.col("start"))).alias("near"), F.count_distinct(F.when(enough, F.col("start"))).alias("windows")
    )
    return (
        best.groupBy("doc_id", "template_id", "license", "n_all")
        .agg((F.sum("held") / F.col("n_all")).alias("containment"), F.coalesce(F.min("start"), F.min("near")).cast("long").alias("start_word"), F.sum("windows").alias("n_windows"))
        .filter(F.col("containment") >= containment)
        .drop("n_all")
    )

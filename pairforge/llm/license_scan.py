"""Licence notices in documents by MinHash over text windows, in DataFrame functions only.

Words are runs of letters and digits in lower case; a shingle is ``SHINGLE``
words.  Templates are cut into pieces of at most ``PIECE`` shingles.

1. Windows of a document overlap so that every piece lies whole in one of them:
   ``WINDOW`` shingles, each starting ``WINDOW - PIECE + 1`` after the one
   before; and for templates of at most ``TINY`` shingles windows of that many,
   starting at every shingle.
2. Each window has ``BANDS`` MinHashes, each a band of its own.  A window that
   holds 80 % of a piece of three or more shingles resembles it by 0.3 or more,
   so all bands miss it with probability 0.7 ** 24 = 2e-4 at worst, 1e-6 and
   less for full-sized pieces; tiny templates are missed with 0.5 ** 24.
3. Candidates are verified exactly: at least ``CONTAINED`` percent of the
   template's distinct shingles stand in the document.

A band can only hit if the window holds the template's least shingle under that
band, so documents and windows with none of those shingles are passed over;
that drops no hit.  Templates come from a mapping in the
driver of at most ``MAX_TEMPLATES`` entries, their bands are broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairforge.llm.inputs import ids_and_texts, or_empty
from pairforge.session import stage

SHINGLE = 3
PIECE, WINDOW, TINY = 6, 10, 2
BANDS = 24
CONTAINED = 80
MAX_TEMPLATES = 10_000

#: Notices as they are commonly written.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation"
    ),
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Hashes of all runs of ``SHINGLE`` words; none if there are fewer words."""
    tail = [lambda i, k=k: F.get(words, i + k) for k in range(1, SHINGLE)]
    return F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[f(i) for f in tail]),
    )


def _least(shingles: Column, band: int) -> Column:
    """The shingle whose hash with the band's number is least."""
    ordered = F.transform(shingles, lambda h: F.struct(F.xxhash64(h, F.lit(band)).alias("order"), h.alias("shingle")))
    return F.array_min(ordered).getField("shingle")


def _bands(shingles: Column) -> Column:
    """The least shingle under each band."""
    return F.array(*[_least(shingles, k) for k in range(BANDS)])


def template_table(spark: SparkSession, templates: Mapping[str, str]) -> DataFrame:
    """license and its distinct shingles; refuses templates of fewer words than a shingle has."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    rows = spark.createDataFrame(list(templates.items()), "license string, text string")
    table = rows.select("license", _shingles(_words(F.col("text"))).alias("shingles"))
    short = [r[0] for r in table.filter(F.size("shingles") == 0).collect()]
    if short:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    return table


def _windows(shingles: Column, size: int, step: int) -> Column:
    """Windows of ``size`` shingles (fewer in shorter texts), each ``step`` after the one before, to the end."""
    last = F.greatest(F.size(shingles) - size, F.lit(0))
    starts = F.sequence(F.lit(0), F.ceil(last / step).cast("int"))
    return F.transform(starts, lambda i: F.slice(shingles, F.least(i * step, last) + 1, F.lit(size)))


def _pieces(shingles: Column) -> Column:
    return _windows(shingles, PIECE, PIECE)


def _keys(windows: Column, scale: int) -> Column:
    """Scale, band and least shingle of all windows, once each."""
    keyed = F.flatten(F.transform(windows, lambda w: F.transform(_bands(w), lambda h, k: F.struct(F.lit(scale).alias("scale"), k.alias("band"), h.alias("least")))))
    return F.array_distinct(keyed)


def _both_scales(shingles: Column, own: Column) -> Column:
    """Keys of all windows that hold one of ``own``, the shingles that some template has under some band."""
    holding = lambda windows: F.filter(windows, lambda w: F.arrays_overlap(w, own))
    return F.concat(
        _keys(holding(_windows(shingles, WINDOW, WINDOW - PIECE + 1)), 1), _keys(holding(_windows(shingles, TINY, 1)), 0)
    )


def scan(documents: DataFrame, templates: Mapping[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words and found (license, percent of its shingles, sorted by name) for every row of ``documents``.

    Null, empty and very short texts have no shingles and find nothing.  Repeated
    rows find the same, rows without an id are scanned like others, other columns
    are not read.  Without templates nothing is found.
    """
    spark = documents.sparkSession
    table = template_table(spark, TEMPLATES if templates is None else templates)
    tiny = F.size("shingles") <= TINY
    sketch = table.select(
        "license",
        "shingles",
        F.explode(F.when(tiny, _keys(F.array("shingles"), 0)).otherwise(_keys(_pieces(F.col("shingles")), 1))).alias("key"),
    ).select("license", "shingles", "key.*")
    # The shingles themselves that are least in some piece: BANDS for each piece at most.
    least = [r[0] for r in sketch.select("least").distinct().collect()]
    docs = ids_and_texts(documents, doc_id, text)
    known = F.array(*[F.lit(x) for x in least]).cast("array<bigint>")
    shingled = docs.select(
        F.coalesce("doc_id", F.lit(0)).alias("_id"),
        F.xxhash64("text", F.col("doc_id").isNull()).alias("_key"),
        "doc_id",
        _words(or_empty("text")).alias("words"),
    ).select("_id", "_key", "doc_id", F.size("words").cast("long").alias("n_words"), _shingles(F.col("words")).alias("all"))
    rows = stage(
        shingled.withColumn("own", F.array_intersect("all", known))
        .withColumn("shingles", F.when(F.size("own") > 0, F.col("all")))
        .drop("all"),
        "shingles",
    )
    near = rows.filter("shingles IS NOT NULL").dropDuplicates(["_id", "_key"])
    keys = near.select("_id", "_key", F.explode(_both_scales(F.col("shingles"), F.col("own"))).alias("key")).select("_id", "_key", "key.*")
    candidates = keys.join(F.broadcast(sketch.drop("shingles")), ["scale", "band", "least"]).select("_id", "_key", "license").distinct()
    wanted = F.broadcast(table.select("license", F.array_distinct("shingles").alias("wanted")))
    percent = 100 * F.size(F.array_intersect("shingles", "wanted")) / F.size("wanted")
    verified = (
        near.select("_id", "_key", "shingles")
        .join(candidates, ["_id", "_key"])
        .join(wanted, "license")
        .select("_id", "_key", F.struct("license", percent.alias("percent")).alias("hit"))
        .filter(F.col("hit.percent") >= CONTAINED)
        .groupBy("_id", "_key")
        .agg(F.array_sort(F.collect_list("hit")).alias("found"))
    )
    none = F.array().cast("array<struct<license: string, percent: double>>")
    return rows.join(verified, ["_id", "_key"], "left").select("doc_id", "n_words", F.coalesce("found", none).alias("found"))

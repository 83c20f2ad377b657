"""License texts by diagonal voting of word pairs (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, stage
from .words import LOWER, PLAIN, hashes, rolling, spans

#: Words of a rolling gram: as many as the shortest phrase has.
K = 2
#: Diagonals this close belong to one occurrence, which may lack or add a few words.
BAND = 3
#: Share of a template's grams that an occurrence must hold.
COVERAGE = 0.6

# Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

# Opening passages of public licenses and usual notices, and their labels.
PASSAGES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "apache-2.0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl-notice"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("The software is provided as is, without warranty of any kind, express or implied", "no-warranty"),
]


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every word: letters, digits and characters beyond ASCII, after lower-casing A-Z."""
    data = LOWER[data]
    start, end, text = spans(offsets, data, PLAIN)
    return hashes(data, start, end), text


def templates(spark: SparkSession) -> DataFrame:
    """gram, template, tpos of every gram of every template; as large as the fixed lists."""
    rows = []
    for number, (text, _) in enumerate(PHRASES + PASSAGES):
        data = np.frombuffer(text.encode(), np.uint8)
        word, owner = word_hashes(np.array([0, len(data)]), data)
        gram, at = rolling(word, owner, K)
        rows += [(int(g), number, int(p)) for g, p in zip(gram.view(np.int64), at)]
    return spark.createDataFrame(rows, "gram long, template int, tpos int")


def template_grams() -> list[int]:
    """Grams each template has."""
    size = lambda text: int((np.diff(PLAIN[LOWER[np.frombuffer(f" {text} ".encode(), np.uint8)]].astype(int)) == 1).sum())
    return [size(t) - K + 1 for t, _ in PHRASES + PASSAGES]


def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, text) to one row per text (pos -1 - words, no gram) and one per rolling gram."""
    for b in batches:
        number, ids = b.column(0).to_numpy(), b.column(1)
        for row, end, offsets, data in pieces(b.column(2)):
            word, text = word_hashes(offsets, data)
            per_text = np.bincount(text, minlength=end - row)
            gram, at = rolling(word, text, K)
            pos = at - (np.cumsum(per_text) - per_text)[text[at]]
            heads = pa.RecordBatch.from_arrays([pa.array(number[row:end]), ids.slice(row, end - row), pa.array(-1 - per_text), pa.nulls(end - row, pa.int64())],
                                               ["row", "doc_id", "pos", "gram"])
            yield heads
            yield pa.RecordBatch.from_arrays([pa.array(number[row:end][text[at]]), pa.nulls(len(at), pa.int64()), pa.array(pos), pa.array(gram.view(np.int64))],
                                             ["row", "doc_id", "pos", "gram"])


def scan(df: DataFrame) -> DataFrame:
    """One row per row of `df` (doc_id, text): doc_id, n_words, places and spans.

    Every rolling gram of every text joins the templates' grams. Votes are counted
    per text, template and diagonal (place in the text less place in the template).
    A phrase stands where its diagonal has all votes. For passages, diagonals at most
    BAND apart are one occurrence; it counts if it holds COVERAGE of the passage's
    grams in a span no longer than twice the passage. `places` are (label, start)
    of phrases, `spans` (label, start, end, coverage) of passages, in words from 0.
    A null or empty text has none. Rows repeat in the result as often as in `df`.
    """
    spark = df.sparkSession
    every = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(grams, "row long, doc_id long, pos long, gram long")
    met = stage(every.join(F.broadcast(templates(spark)), "gram", "left").filter("gram is null or template is not null")
                .select("row", "doc_id", "pos", "template", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal")), "votes")
    needs = F.array(*[F.lit(n) for n in template_grams()])
    labels = F.array(*[F.lit(label) for _, label in PHRASES + PASSAGES])
    need, label = F.get(needs, F.col("template")), F.get(labels, F.col("template"))

    votes = met.filter(F.col("template") < len(PHRASES)).groupBy("row", "template", "diagonal").agg(F.count(F.lit(1)).alias("votes"))
    places = (votes.filter(F.col("votes") == need).groupBy("row")
              .agg(F.array_sort(F.collect_list(F.struct(F.col("diagonal").alias("start"), label.alias("label")))).alias("places")))

    seeds = met.filter(F.col("template") >= len(PHRASES))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    lines = seeds.select("row", "template", "diagonal").distinct()
    lines = lines.withColumn("_new", (F.col("diagonal") - F.coalesce(F.lag("diagonal").over(along), F.col("diagonal")) > BAND).cast("int"))
    lines = lines.withColumn("_group", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    found = (seeds.join(lines, ["row", "template", "diagonal"]).groupBy("row", "template", "_group")
             .agg(F.count_distinct("tpos").alias("_held"), F.min("pos").alias("start"), (F.max("pos") + K).alias("end")))
    found = found.withColumn("coverage", F.col("_held") / need).filter((F.col("coverage") >= COVERAGE) & (F.col("end") - F.col("start") <= 2 * (need + K)))
    passages = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", label.alias("label"), "coverage"))).alias("spans"))

    heads = met.filter("template is null").select("row", "doc_id", (-1 - F.col("pos")).alias("n_words"))
    out = heads.join(places, "row", "left").join(passages, "row", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return out.select("doc_id", "n_words", none("places", "array<struct<start:bigint,label:string>>").alias("places"),
                      none("spans", "array<struct<start:bigint,end:bigint,label:string,coverage:double>>").alias("spans"))

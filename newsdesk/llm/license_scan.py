"""License scans by diagonal voting, with DataFrame functions only.

Every run of ``K`` words of every document is hashed and joined to the positions at which the license
templates hold it (a fixed table of a few hundred rows).  A match votes for the diagonal document
position - template position.  A diagonal that all of a template's runs vote for is the template
word for word; diagonals a few words apart merge, which lets a text differ by inserted or dropped
words, and a merged span counts if it is about as long as the template and covers most of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 3
#: Diagonals at most so far apart merge.
GAP = 3
#: Share of a template's runs that a verified span covers, and its length against the template's.
COVER, STRETCH = 0.75, 1.5

#: Phrases whose consecutive words are the base labels.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Openings of license notices in public use, as words; each has at most 62 runs of three.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_rows() -> list[tuple[int, str, bool, int, int, str, str, str]]:
    """(template, label, base, runs, position, three words) of every run of every template."""
    rows = []
    for t, (base, label, text) in enumerate([(True, *p) for p in BASE_PHRASES] + [(False, *n) for n in NOTICES]):
        words = text.split()
        runs = len(words) - K + 1
        rows += [(t, label, base, runs, p, *words[p : p + K]) for p in range(runs)]
    return rows


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_rows(), "template int, label string, base boolean, runs int, at int, ta string, tb string, tc string").withColumn("gram", F.xxhash64("ta", "tb", "tc"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` of every row.

    Null, empty and wordless texts have no words, no places and empty labels.  Repeated rows and null
    ids each come back.  Other columns are ignored.  An empty table gives an empty result.
    """
    # lower() also lowers non-ASCII letters, which no template holds; of these only the Kelvin sign would become an ASCII one.
    text = F.lower(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("K"), F.lit("ĸ")))
    words = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"))
    n = F.size("w")
    rolled = words.select(
        "row", "doc_id", n.cast("long").alias("n_words"),
        F.posexplode_outer(F.arrays_zip(F.col("w").alias("a"), F.when(n > 1, F.slice("w", 2, F.greatest(n - 1, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("b"), F.when(n > 2, F.slice("w", 3, F.greatest(n - 2, F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("c"))),
    ).select("row", "doc_id", "n_words", "pos", F.col("col.a").alias("a"), F.col("col.b").alias("b"), F.col("col.c").alias("c"))
    # The templates are constants: their table's size is fixed.
    matched = rolled.withColumn("gram", F.xxhash64("a", "b", "c")).join(F.broadcast(templates(docs.sparkSession)), "gram", "left").select(
        "row", "doc_id", "n_words", "pos", "template", "label", "base", "runs", "at",
        ((F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")) & (F.col("c") == F.col("tc"))).alias("same"),
    ).filter("same or pos = 0 or pos is null")
    key = ["row", "doc_id", "n_words"]
    hit = F.coalesce(F.col("same"), F.lit(False))
    diagonals = (
        matched.select(*key, *[F.when(hit, F.col(c)).alias(c) for c in ("template", "label", "base", "runs")], F.when(hit, F.col("pos") - F.col("at")).alias("diagonal"), F.when(hit, F.col("pos")).alias("pos"), F.when(hit, F.expr("shiftleft(1L, at)")).alias("bit"))
        .groupBy(*key, "template", "label", "base", "runs", "diagonal")
        .agg(F.bit_or("bit").alias("mask"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    full = F.bit_count("mask") == F.col("runs")
    spans = (
        diagonals.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= GAP, 0).otherwise(1))
        .withColumn("span", F.sum("new").over(order))
        .groupBy(*key, "template", "label", "base", "runs", "span")
        .agg(
            F.bit_or("mask").alias("mask"), F.min("first").alias("first"), F.max("last").alias("last"), F.max(F.bit_count("mask") / F.col("runs")).alias("best"),
            F.count(F.when(full, 1)).alias("places"), F.min(F.when(full, F.col("diagonal"))).alias("low"), F.max(F.when(full, F.col("diagonal"))).alias("high"),
        )
    )
    merged = F.bit_count("mask") / F.col("runs")
    fits = F.col("last") - F.col("first") + 1 <= STRETCH * F.col("runs") + GAP
    cover = F.greatest(F.col("best"), F.when(fits, merged))
    found = F.when(F.col("base"), F.col("places") > 0).otherwise(cover >= COVER)
    joined = lambda of: F.array_join(F.array_sort(F.collect_set(of)), ",")
    return spans.groupBy(*key).agg(
        F.sum(F.when(F.col("base"), F.col("places")).otherwise(0)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("low"))).cast("long").alias("first_word"), F.max(F.when(F.col("base"), F.col("high"))).cast("long").alias("last_word"),
        joined(F.when(F.col("base") & found, F.col("label"))).alias("base_labels"), joined(F.when(found, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(found, F.when(F.col("base"), F.lit(1.0)).otherwise(cover)).otherwise(F.when(~F.col("base"), cover / 2))), F.lit(0.0)).alias("score"),
    ).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

"""License scans by diagonal voting.

Every rolling hash of ``K`` words of a document is joined to the positions of license templates that have it. A hit votes
for the diagonal (document position minus template position); votes are gathered per diagonal as a set of template
positions, neighbouring diagonals (small insertions or deletions) are merged, and spans are verified word by word. A
phrase stands where one diagonal holds all of its positions.

Only DataFrame operations. The templates are fixed text (a few hundred positions), so they are sent to every executor;
hashes of a text are made and looked up inside the scan, and only verified hits are shuffled.

Defined results: null texts count as empty and have no words; rows equal in id and text get the same result each; an id
may be null; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrid.llm.common import ascii_lower, split_words, text_key, text_of
from pagegrid.plans.lineage import cut

#: words per hash
K = 3
#: what stands between words (fixed by the contract)
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: phrases whose places are counted, and their labels (fixed by the contract)
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: opening words of common licenses, matched in part (fixed text of the licenses)
TEXTS = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "all-rights-reserved": "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher",
}


def words_of(text: Column) -> Column:
    return split_words(ascii_lower(text_of(text)), GAPS)


def _gram(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(K)])


def _templates(spark) -> DataFrame:
    """(gram, words, template, label, phrase, at, grams): one row per template position."""
    rows = [(i, label, phrase, text.split()) for i, (text, label, phrase) in enumerate([*((p, x, True) for p, x in PHRASES.items()), *((t, x, False) for x, t in TEXTS.items())])]
    table = spark.createDataFrame(rows, "template int, label string, phrase boolean, words array<string>")
    at = table.select("*", (F.size("words") - (K - 1)).alias("grams"), F.explode(F.sequence(F.lit(0), F.size("words") - K)).alias("at"))
    return at.select(_gram(F.col("words"), F.col("at")).alias("gram"), F.slice("words", F.col("at") + 1, F.lit(K)).alias("standing"), "template", "label", "phrase", "at", "grams")


def hits(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, template, label, phrase, grams, diagonal, seen): verified template positions of a diagonal as bits."""
    words = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), words_of(F.col(text_col)).alias("words"))
    # each gram takes its own words along, not the whole text
    placed = F.transform(F.sequence(F.lit(0), F.size("words") - K), lambda i: F.struct(i.alias("pos"), F.array(*[F.get("words", i + k) for k in range(K)]).alias("own")))
    grams = words.where(F.size("words") >= K).select("id", "key", F.explode(placed).alias("g")).select("id", "key", "g.*").withColumn("gram", _gram(F.col("own"), F.lit(0)))
    met = grams.join(F.broadcast(_templates(docs.sparkSession)), "gram").where(F.col("own") == F.col("standing"))
    return met.groupBy("id", "key", "template", "label", "phrase", "grams", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("seen"),
    )


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 4, cover: float = 0.5) -> DataFrame:
    """(id, key, label, phrase, first_word, coverage): a row per place of a phrase, and per merged group of diagonals of a
    license text of which at least ``cover`` of the positions stand. ``gap``: words that may be added or left out between
    two diagonals that are merged.
    """
    found = cut(hits(docs, id_col, text_col))  # few rows, read for phrases and for license texts
    places = found.where(F.col("phrase") & (F.bit_count("seen") == F.col("grams"))).select(
        "id", "key", "label", "phrase", F.col("diagonal").cast("long").alias("first_word"), F.lit(1.0).alias("coverage"),
    )
    order = Window.partitionBy("id", "key", "template").orderBy("diagonal")
    far = (F.col("diagonal") - F.lag("diagonal").over(order) > gap) | F.lag("diagonal").over(order).isNull()
    grouped = found.where(~F.col("phrase")).withColumn("group", F.sum(far.cast("int")).over(order))
    merged = grouped.groupBy("id", "key", "template", "label", "phrase", "grams", "group").agg(F.bit_or("seen").alias("seen"), F.min("diagonal").cast("long").alias("first_word"))
    partly = merged.withColumn("coverage", F.bit_count("seen") / F.col("grams")).where(F.col("coverage") >= cover)
    return places.unionByName(partly.select("id", "key", "label", "phrase", "first_word", "coverage"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 4, cover: float = 0.5) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score (best coverage)."""
    phrase = F.col("phrase")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    found = spans(docs, id_col, text_col, gap, cover).groupBy("id", "key").agg(
        F.count(F.when(phrase, 1)).alias("n_base"), F.min(F.when(phrase, F.col("first_word"))).alias("first_word"), F.max(F.when(phrase, F.col("first_word"))).alias("last_word"),
        joined(F.collect_set(F.when(phrase, F.col("label")))).alias("base_labels"), joined(F.collect_set("label")).alias("labels"), F.max("coverage").alias("score"),
    )
    rows = docs.select(F.col(id_col).alias("own"), text_key(F.col(text_col)).alias("own_key"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    return rows.join(found, rows["own"].eqNullSafe(found["id"]) & (rows["own_key"] == found["key"]), "left").select(
        F.col("own").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )

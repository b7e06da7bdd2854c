"""License scans by diagonal voting (operator 2).

All rolling word k-grams of all texts are hashed and joined by Spark with the positions of the same k-grams in the templates.
A hit votes for the diagonal (word in the text minus word in the template); votes are aggregated per text, template and diagonal as
a bit set of template positions. A phrase stands where every position of one diagonal has voted. For longer license texts,
neighbouring diagonals are merged, so that inserted or missing words do not break a match, and the merged span is verified: the
share of the template's positions that it covers must reach COVERAGE.

The template table is a fixed value of this module (some hundred rows), so it is broadcast. Base phrases take two-word grams,
longer texts four-word grams.

Defined results: null and empty texts have no words and no labels (empty strings, score 0); places may overlap and all count;
rows that repeat doc_id and text vote once and each get the full result; a null doc_id is treated like any other value.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyspark.llm.text import ALPHANUMERIC, LOWER, Chunk, each_chunk, kind_of, signed, span_hashes, table_of, window_hashes, window_rows, word_hashes, words

SHORT_GRAM, LONG_GRAM = 2, 4
#: Templates of up to this many words are phrases: they must stand unbroken, and take short grams.
PHRASE_WORDS = 5
#: Diagonals up to this far apart are one match; least share of a long template's grams that a match must cover.
MERGE_DISTANCE, COVERAGE = 3, 0.6

# Phrases that the scan must count, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further phrases, and opening passages of public license texts, with their labels (60 grams at most).
TEMPLATES = {
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons": "cc",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files (the \"Software\"), to deal in the Software without restriction": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met": "bsd",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
    "License. You may obtain a copy of the License at": "apache",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "gpl",
    "This work is licensed under the GNU General Public License, version 3": "gpl",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
    "with this file, You can obtain one at": "mpl",
    "This is free and unencumbered software released into the public domain": "unlicense",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
}


def _grams(text: str) -> tuple[int, list[int]]:
    """Gram length of a template, and the hashes of its grams as Spark longs."""
    found = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode())
    k = SHORT_GRAM if len(found) <= PHRASE_WORDS else LONG_GRAM
    data = np.frombuffer(b" ".join(found), dtype=np.uint8)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    hashes = span_hashes(data, ends - [len(w) for w in found], ends, ALPHANUMERIC)
    return k, signed(window_hashes(hashes, k, salt=k)).tolist()


def template_positions(base: dict[str, str], more: dict[str, str]) -> list[tuple]:
    """(gram, template, place, grams of the template, label, is it a base phrase, is it a phrase)."""
    rows = []
    for number, (text, label) in enumerate([*base.items(), *more.items()]):
        k, hashes = _grams(text)
        if len(hashes) > 60:
            raise ValueError("a template holds at most 60 grams; cut it into passages")
        rows += [(h, number, at, len(hashes), label, number < len(base), k == SHORT_GRAM) for at, h in enumerate(hashes)]
    return rows


def gram_rows(docs: DataFrame) -> DataFrame:
    """gram, doc_id, key, word: every rolling short and long gram of every text; key is a hash of the text."""

    def kernel(chunk: Chunk) -> pa.RecordBatch:
        hashes, first = word_hashes(chunk, ALPHANUMERIC, lower=True)
        grams, rows, word = [], [], []
        for k in (SHORT_GRAM, LONG_GRAM):
            row, at = window_rows(first, k)
            grams.append(window_hashes(hashes, k, salt=k)[at] if len(at) else np.zeros(0, np.uint64))
            rows.append(row)
            word.append(at - first[row])
        row = pa.array(np.concatenate(rows))
        return table_of(["gram", "doc_id", "key", "word"], [pa.int64(), None, None, pa.int32()],
                        [signed(np.concatenate(grams)), chunk.ids.take(row), chunk.kept["key"].take(row), np.concatenate(word)])

    return each_chunk(docs, kernel, f"gram long, doc_id {kind_of(docs)}, key long, word int", keep=["key"])


def matches(docs: DataFrame, base: dict[str, str] = BASE, more: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, key, template, label, base, first_word, last_word (place in the text), coverage: all verified matches."""
    spark = docs.sparkSession
    table = spark.createDataFrame(template_positions(base, more), "gram long, template int, place int, grams int, label string, base boolean, phrase boolean")
    votes = (gram_rows(docs).join(F.broadcast(table), "gram")  # a fixed table
             .groupBy("doc_id", "key", "template", "label", "base", "phrase", "grams", (F.col("word") - F.col("place")).alias("diagonal"))
             .agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("places")))
    phrases = (votes.where("phrase").where(F.bit_count("places") == F.col("grams"))
               .select("doc_id", "key", "template", "label", "base", F.col("diagonal").alias("first_word"),
                       (F.col("diagonal") + F.col("grams")).alias("last_word"), F.lit(1.0).alias("coverage")))
    along = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > MERGE_DISTANCE, F.lit(True))
    merged = (votes.where(~F.col("phrase")).withColumn("match", F.sum(fresh.cast("int")).over(along))
              .groupBy("doc_id", "key", "template", "label", "base", "grams", "match")
              .agg(F.bit_or("places").alias("places"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high")))
    coverage = F.bit_count("places") / F.col("grams")
    lead = F.length(F.regexp_replace(F.reverse(F.bin("places")), "1.*", ""))
    spans = merged.where(coverage >= COVERAGE).select(
        "doc_id", "key", "template", "label", "base", F.greatest(F.col("low") + lead, F.lit(0)).alias("first_word"),
        (F.col("high") + F.length(F.bin("places")) + LONG_GRAM - 2).alias("last_word"), coverage.alias("coverage"))
    return phrases.union(spans)


def scan(docs: DataFrame, base: dict[str, str] = BASE, more: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    found = matches(keyed, base, more).groupBy("doc_id", "key").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("first_word"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("first_word"))).alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_set"), F.collect_set("label").alias("all_set"),
        F.max("coverage").alias("score")).withColumnsRenamed({"doc_id": "of", "key": "of_key"})

    def kernel(chunk: Chunk) -> pa.RecordBatch:
        _, _, first = words(chunk, ALPHANUMERIC, LOWER[chunk.data])
        return table_of(["doc_id", "key", "n_words"], [None, None, pa.int64()], [chunk.ids, chunk.kept["key"], np.diff(first)])

    counted = each_chunk(keyed, kernel, f"doc_id {kind_of(docs)}, key long, n_words long", keep=["key"])
    joined = counted.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & F.col("key").eqNullSafe(F.col("of_key")), "left")

    def listed(name: str):
        return F.coalesce(F.concat_ws(",", F.array_sort(name)), F.lit("")).alias(name.replace("_set", "_labels") if name != "all_set" else "labels")

    return joined.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
                         F.col("last_word").cast("long").alias("last_word"), listed("base_set"), listed("all_set"),
                         F.coalesce("score", F.lit(0.0)).alias("score"))

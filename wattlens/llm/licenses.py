"""License scans: exact phrases, and known notices found by diagonal voting although words were changed.

Every rolling k-gram of words of every text is joined to the places where the notices have it. A place in a notice and one
in a text vote for a diagonal, the difference of the two. Hits of one copy with at most `e` word edits lie on diagonals at
most `e` apart, and at least `m - k + 1 - k * e` of the notice's m - k + 1 grams survive `e` edits (the q-gram lemma). So
neighbouring diagonals are merged, bands with fewer votes are dropped without losing a copy, and what is left is verified by
the edit distance between the notice and the best span of the band.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from wattlens.llm.arrow_text import LOWER, U64, add_columns, flat, mix, ship, span_hashes, spans, sub_batches
from wattlens.plans.joins import lookup_join
from wattlens.plans.staging import stage

GRAM_WORDS = 3
TOLERANCE = 20  # percent of a notice's words that may be edited
PART_GRAMS = 65_536  # grams of one text in a row on their way to the join
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

# The phrases that name a license by themselves.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices as the licenses' owners word them.
NOTICES = [
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
             "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
             "(at your option) any later version."),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
               "compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("bsd", "Released under the BSD License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
            "this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
             "General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions"),
    ("mit", "Released under the MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and the bounds of each text among them."""
    data, offsets = flat(texts)
    data = LOWER[data]
    starts, ends, doc = spans(IN_WORD[data], offsets)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    return (span_hashes(data, starts, ends) if len(starts) else np.zeros(0, U64)), bounds


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """One hash for every k consecutive words; k - 1 fewer than there are words."""
    count = max(0, len(words) - k + 1)
    chain = np.zeros(count, U64)
    for i in range(k):
        chain += mix(words[i:i + count] + U64((i + 1) * 0x9E3779B97F4A7C15 % 2 ** 64))
    return mix(chain)


def edits_allowed(words: int, tolerance: int, k: int) -> int:
    """The tolerated share, and never so many that all grams of a copy could be lost."""
    return min(words * tolerance // 100, (words - k) // k)


def last_rows(notice: np.ndarray, words: np.ndarray, anchored: bool) -> np.ndarray:
    """Edit distances of the whole notice to the words before each place, from any place on or (anchored) from the first."""
    place = np.arange(len(words) + 1)
    row = place.copy() if anchored else np.zeros(len(words) + 1, np.int64)
    for i, word in enumerate(notice, 1):
        base = np.empty_like(row)
        base[0] = i
        base[1:] = np.minimum(row[1:] + 1, row[:-1] + (words != word))
        row = np.minimum.accumulate(base - place) + place
    return row


def best_span(notice: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the span of `words` nearest to the notice: the earliest end, then the shortest."""
    row = last_rows(notice, words, False)
    end = int(row.argmin())
    low = max(0, end - 2 * len(notice))  # more words before `end` would cost more edits than there are
    back = last_rows(notice[::-1], words[low:end][::-1], True)
    return int(row[end]), end - int(back.argmin()), end


def without_overlaps(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """(label, start, length, score): where spans overlap the better one stays, then the longer, the earlier, by label."""
    kept: list[tuple[str, int, int, float]] = []
    for one in sorted(set(found), key=lambda s: (-s[3], -s[2], s[1], s[0])):
        if all(one[1] >= k[1] + k[2] or k[1] >= one[1] + one[2] for k in kept):
            kept.append(one)
    return sorted(kept, key=lambda s: (s[1], s[0]))


def phrase_places(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """Add n_words and places (label, start) of all phrases to rows with a text."""
    wanted = [(text_words(pa.array([p]))[0], label) for p, label in phrases.items()]

    def compute(texts):
        words, bounds = text_words(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        hits = [np.zeros(0, np.int64)]
        for phrase, _ in wanted:
            count = max(0, len(words) - len(phrase) + 1)
            same = doc[:count] == doc[len(phrase) - 1:] if count else np.zeros(0, bool)
            for i, word in enumerate(phrase):
                same &= words[i:i + count] == word
            hits.append(np.flatnonzero(same))
        at = np.concatenate(hits)
        label = np.repeat(np.arange(len(hits)) - 1, [len(h) for h in hits])
        order = np.lexsort((label, at))
        at, label = at[order], label[order]
        places = pa.StructArray.from_arrays([pa.array([wanted[i][1] for i in label], pa.string()),
                                             pa.array(at - bounds[doc[at]], pa.int64())], names=["label", "start"])
        ends = np.searchsorted(at, bounds).astype(np.int32)
        return [np.diff(bounds).astype(np.int64), pa.ListArray.from_arrays(ends, places)]

    return add_columns(docs, "text", "n_words bigint, places array<struct<label: string, start: bigint>>", compute,
                       ["id", "k1", "k2"])


def candidate_bands(rows: DataFrame, notices: list[tuple[str, str]], k: int, tolerance: int) -> DataFrame:
    """(k1, k2, bands): per text the merged diagonals of notices with enough votes, as notice and range of words."""
    spark, known = rows.sparkSession, [text_words(pa.array([text]))[0] for _, text in notices]
    if any(len(words) < k for words in known):
        raise ValueError("a notice has fewer words than a gram")
    places: dict[int, list[tuple[int, int]]] = {}
    for i, words in enumerate(known):
        for at, gram in enumerate(grams(words, k).view(np.int64).tolist()):
            places.setdefault(gram, []).append((i, at))
    table = spark.createDataFrame(list(places.items()), "gram bigint, places array<struct<notice: int, at: int>>")
    edits = [edits_allowed(len(words), tolerance, k) for words in known]
    sizes = F.broadcast(spark.createDataFrame(  # as many rows as notices
        [(i, len(w), e, len(w) - k + 1 - k * e) for i, (w, e) in enumerate(zip(known, edits))],
        "notice int, words int, edits int, least int"))
    schema = StructType.fromDDL("k1 bigint, k2 bigint, first bigint, grams array<bigint>")

    def rolling(batches):
        for batch in batches:
            for part in sub_batches(batch, 2):
                words, bounds = text_words(part.column(2))
                count, own = np.maximum(np.diff(bounds) - k + 1, 0), grams(words, k).view(np.int64)
                parts = -(-count // PART_GRAMS)
                doc = np.repeat(np.arange(len(count)), parts)
                first = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * PART_GRAMS
                size = np.minimum(count[doc] - first, PART_GRAMS)
                ends = np.concatenate([[0], np.cumsum(size)])
                where = np.repeat(bounds[doc] + first - ends[:-1], size) + np.arange(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), pa.array(first),
                     pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(own[where]))], names=schema.names)

    rolled = ship(rows.select("k1", "k2", "text")).mapInArrow(rolling, schema)
    all_grams = rolled.select("k1", "k2", "first", F.posexplode("grams").alias("i", "gram"))
    hits = (lookup_join(all_grams, table, ["gram"], spread=["k1", "i"], how="inner")
            .select("k1", "k2", (F.col("first") + F.col("i")).alias("pos"), F.explode("places").alias("p")))
    votes = (hits.groupBy("k1", "k2", F.col("p.notice").alias("notice"), (F.col("pos") - F.col("p.at")).alias("diagonal"))
             .agg(F.count("*").alias("votes")).join(sizes, "notice"))
    along = Window.partitionBy("k1", "k2", "notice").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.col("edits"), F.lit(True))
    banded = votes.withColumn("new", apart.cast("int")).withColumn("band", F.sum("new").over(along))
    bands = (banded.groupBy("k1", "k2", "notice", "band")
             .agg(F.sum("votes").alias("votes"), F.min(F.col("diagonal") - F.col("edits")).alias("low"),
                  F.max(F.col("diagonal") + F.col("words") + F.col("edits")).alias("high"), F.first("least").alias("least"))
             .filter(F.col("votes") >= F.col("least")))
    return bands.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("notice", "low", "high"))).alias("bands"))


def verified_spans(rows: DataFrame, bands: DataFrame, notices: list[tuple[str, str]], k: int,
                   tolerance: int) -> DataFrame:
    """(k1, k2, spans): of every band the best span, if it is within the tolerated edits; overlaps resolved."""
    known = [(label, text_words(pa.array([text]))[0]) for label, text in notices]
    schema = StructType.fromDDL(
        "k1 bigint, k2 bigint, spans array<struct<label: string, start: bigint, length: bigint, score: double>>")
    chosen = lookup_join(rows, bands, ["k1", "k2"], spread=["id", "text"], how="inner").select("k1", "k2", "text", "bands")

    def verify(batches):
        for batch in batches:
            for part in sub_batches(batch, 2):
                words, bounds = text_words(part.column(2))
                out = []
                for i, text_bands in enumerate(part.column(3).to_pylist()):
                    own, found = words[bounds[i]:bounds[i + 1]], []
                    for band in text_bands:
                        label, notice = known[band["notice"]]
                        low = max(0, band["low"])
                        edits, start, end = best_span(notice, own[low:max(0, band["high"])])
                        if edits <= edits_allowed(len(notice), tolerance, k):
                            found.append((label, low + start, end - start, 1 - edits / len(notice)))
                    out.append([dict(zip(("label", "start", "length", "score"), s)) for s in without_overlaps(found)])
                kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
                                           ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, kind)], names=schema.names)

    found = ship(chosen).mapInArrow(verify, schema).filter(F.size("spans") > 0)
    return found.groupBy("k1", "k2").agg(F.first("spans").alias("spans"))  # rows that repeat an id and its text


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES,
                 notices: list[tuple[str, str]] = NOTICES, k: int = GRAM_WORDS, tolerance: int = TOLERANCE) -> DataFrame:
    """Per row: the id, n_words, places (label, start) of exact phrases, spans (label, start, length, score) of notices.

    Words are runs of digits, letters and everything beyond ASCII, with A-Z lower-cased; starts count words from 0. A span is
    the part of a band that is nearest to a notice; score is one less the share of the notice's words that are edited. One
    band gives one span, so copies of a notice that stand closer than its tolerated edits count once; of overlapping
    spans the better one stays (ties: the longer, the earlier, the smaller label). A null, empty or wordless
    text has no words, places or spans; very long ones are scanned whole. Repeated rows each get their result, rows
    with a null id too. Other columns are left out, whatever their names are. Empty table: no rows.
    """
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(key.alias("id"), text.alias("text"), F.xxhash64(F.lit(1), key, text).alias("k1"),
                       F.xxhash64(F.lit(2), text, key).alias("k2"))
    bands = stage(candidate_bands(rows, notices, k, tolerance), "license-bands")
    found = lookup_join(phrase_places(rows, phrases), verified_spans(rows, bands, notices, k, tolerance), ["k1", "k2"],
                        spread=["id", "k1"])
    none = F.array().cast("array<struct<label: string, start: bigint, length: bigint, score: double>>")
    return found.select(F.col("id").alias(id_col), "n_words", "places", F.coalesce("spans", none).alias("spans"))


def op13_diagonal_licenses(spark, sf_dir: str) -> DataFrame:
    """score: 1 where a phrase stands (it is whole), else the best span's score, else 0."""
    rows = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    own, method = F.col("places.label"), F.col("spans.label")
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"), listed(own).alias("base_labels"),
        listed(F.concat(own, method)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.score"), F.lit(0.0))).alias("score"), "spans")

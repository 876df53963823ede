"""Operator 10: license texts by diagonal voting.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Every rolling
window of ``GRAM`` words that occurs in a template is a hit; the hits are joined with the template
positions on the window's hash. A hit of a document at word p with a template at word q lies on the
diagonal p - q. Hits are counted by document, template and diagonal; diagonals up to ``SLACK`` apart are
merged, as inserted or missing words shift the rest of a text. A merged group is verified on the
distinct template positions it covers: a label needs ``NEED`` of the template's windows, and its score
is that share.

The templates are the fixed list below, so their table is bounded. Documents are read once; only
hits leave the scan. A document that repeats a license any number of times has one row for each
diagonal, and the windows over them lie in one document.

Base labels are whole phrases; they stay whatever the method says. A null text has no words. Every row is a document of its
own, also with a repeated or null doc_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.sources.staging import cut

from .words import ALNUM, Words, blocks

GRAM = 3
SLACK = 3
NEED = 0.6

# Phrases of the contract with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Public license notices, opening sentences.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def _words(texts: list[str]) -> Words:
    raw = [t.encode() for t in texts]
    return Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), ALNUM, lower=True)


def positions(templates: tuple[tuple[str, str], ...] = TEMPLATES, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(window hash, template number, word position) of all windows of all templates."""
    words = _words([text for _, text in templates])
    at, h = words.grams(gram)
    return [(int(x), int(words.row[i]), int(i - words.first[words.row[i]])) for x, i in zip(h.view(np.int64), at, strict=True)]


def _hits(gram: int, wanted: np.ndarray, phrases: tuple[tuple[str, str], ...]):
    """Per document: words, base places, and its hits as (word, hash)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, wholes = [], []
        for phrase, label in phrases:
            w = _words([phrase])
            sizes.append(len(w))
            wholes.append((len(w), int(w.windows(np.array([0]), np.array([len(w)]))[0]), phrase.encode().split(), label))
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for low, high, data, offsets in blocks(batch.column("text")):
                words = Words(data, offsets, ALNUM, lower=True)
                first = words.first
                base: list[list[tuple[int, str]]] = [[] for _ in range(high - low)]
                for n, h, spelled, label in wholes:
                    at, hashes = words.grams(n)
                    for i in at[hashes == np.uint64(h)].tolist():
                        if words.data[words.start[i] : words.end[i + n - 1]].tobytes() and [words.data[a:b].tobytes() for a, b in zip(words.start[i : i + n], words.end[i : i + n], strict=True)] == spelled:
                            row = int(words.row[i])
                            base[row].append((i - int(first[row]), label))
                at, hashes = words.grams(gram)
                slot = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                hit = wanted[slot] == hashes
                at, hashes = at[hit], hashes[hit].view(np.int64)
                bounds = np.searchsorted(words.row[at], np.arange(high - low + 1))
                for r in range(high - low):
                    places = sorted(p for p, _ in base[r])
                    mine = slice(bounds[r], bounds[r + 1])
                    columns[0].append(int(first[r + 1] - first[r]))
                    columns[1].append(len(places))
                    columns[2].append(places[0] if places else None)
                    columns[3].append(places[-1] if places else None)
                    columns[4].append(sorted({x for _, x in base[r]}))
                    columns[5].append((at[mine] - first[r]).tolist())
                    columns[6].append(hashes[mine].tolist())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base", "at", "hash"])

    return run


HITS = "row long, doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, at array<long>, hash array<long>"


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, gram: int = GRAM, slack: int = SLACK, need: float = NEED) -> tuple[DataFrame, DataFrame]:
    """Documents (row, doc_id) with base results, and the verified spans (row, template, label, start, stop, score)."""
    spark = docs.sparkSession
    table = positions(templates, gram)
    wanted = np.unique(np.array([h for h, _, _ in table], np.int64).view(np.uint64))
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(_hits(gram, wanted, PHRASES), HITS), "licenses")
    grams = [text.split() for _, text in templates]
    names = spark.createDataFrame([(i, label, max(len(grams[i]) - gram + 1, 1)) for i, (label, _) in enumerate(templates)], "template int, label string, grams int")
    where = spark.createDataFrame(table, "hash long, template int, position int")
    one = rows.select("row", F.explode(F.arrays_zip("at", "hash")).alias("x")).select("row", "x.at", "x.hash")
    votes = one.join(where, "hash").withColumn("diagonal", F.col("at") - F.col("position"))
    votes = votes.groupBy("row", "template", "diagonal").agg(
        F.collect_set("position").alias("covered"), F.min("at").alias("start"), (F.max("at") + gram).alias("stop")
    )
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal").over(order) > slack).cast("int")
    grouped = votes.withColumn("group", F.sum(F.coalesce(new, F.lit(1))).over(order))
    merged = grouped.groupBy("row", "template", "group").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("positions"), F.min("start").alias("start"), F.max("stop").alias("stop")
    )
    spans = merged.join(names, "template").withColumn("score", F.col("positions") / F.col("grams"))
    return rows, spans.where(F.col("score") >= need).select("row", "template", "label", "start", "stop", "score")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    rows, spans = scan(docs)
    found = spans.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("score").alias("score"))
    out = rows.drop("at", "hash").join(found, "row", "left")
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    best = F.greatest(F.coalesce("score", F.lit(0.0)), (F.size("base") > 0).cast("double"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.least(best, F.lit(1.0)).alias("score"),
    )

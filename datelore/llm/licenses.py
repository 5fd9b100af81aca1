"""License scans by diagonal voting.

All rolling word k-gram hashes of the documents are joined to their positions in license templates; matches vote
for diagonals (document position minus template position), neighbouring diagonals are merged, and the spans that remain are
verified word by word, in the template's order. All of it is DataFrame work: no Python runs on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from datelore.llm.common import WORD, read_table, written

#: Words in a k-gram.
K = 4
#: Diagonals this far apart belong to one alignment: words put in or left out on the way shift it.
GAP = 4
#: Share of a template's words that a span has to hold, in order of the alignment.
COVERAGE = 0.6

#: Phrases whose places are counted, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public license notices, as (label, text).
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions"""),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer."""),
)


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: str | Column) -> Column:
    """The words of a text; A-Z count as a-z."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _CAPITALS.lower()), F.lit(WORD), F.lit(0))


def in_order(found: Column) -> Column:
    """The most pairs (at, t) of an array that can follow each other with both numbers rising.

    found is sorted by at, then by falling t. ends[n] is the least t that n + 1 such pairs can end with; each pair replaces one, or adds one.
    """
    step = lambda ends, p: F.when(
        (F.size(ends) == 0) | (F.try_element_at(ends, F.lit(-1)) < p["t"]), F.concat(ends, F.array(p["t"]))
    ).otherwise(F.transform(ends, lambda e, n: F.when((e >= p["t"]) & ((n == 0) | (F.get(ends, n - 1) < p["t"])), p["t"]).otherwise(e)))
    return F.aggregate(found, F.array().cast("array<int>"), step, F.size)


def _grams(array: str | Column, k: int) -> Column:
    """A hash for each run of k words."""
    array = F.col(array) if isinstance(array, str) else array
    runs = F.when(F.size(array) >= k, F.sequence(F.lit(1), F.size(array) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(runs, lambda p: F.xxhash64(F.slice(array, p, k)))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, label, words) of license texts, words as the documents' words."""
    rows = [(k, label, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())) for k, (label, text) in enumerate(templates)]
    return spark.createDataFrame(rows, "template int, label string, words array<string>")


def phrase_places(array: str, phrases=PHRASES) -> tuple[Column, Column]:
    """(places, labels): the starts, in order, of all places where a phrase's words stand consecutively, and the labels of those phrases."""
    split = [(p.split(), label) for p, label in phrases]
    heads = sorted({p[0] for p, _ in split})
    starts = F.filter(F.transform(F.col(array), lambda w, k: F.when(w.isin(heads), k)), lambda k: k.isNotNull())
    at = lambda k, words: F.slice(F.col(array), k + 1, len(words)) == F.array(*map(F.lit, words))
    hits = F.flatten(F.transform(starts, lambda k: F.array_compact(F.array(*[F.when(at(k, p), F.struct(k.alias("at"), F.lit(label).alias("label"))) for p, label in split]))))
    return F.transform(hits, lambda h: h["at"]), F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"])))


def scan_licenses(docs: DataFrame, templates: DataFrame, phrases=PHRASES, k: int = K, gap: int = GAP, coverage: float = COVERAGE, text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, base_labels, spans) of every row of docs.

    places and base_labels are those of the phrases; spans (template, label, first, last, share) are verified
    alignments: share is the part of the template's words that stand in the span along its diagonals and in the template's order, each
    counted once, coverage at least. templates are of fixed size; the join sends them to every executor, within Spark's own limit for that.
    Texts are cut into words once; what is kept of them is written to the shared folder: counts, and the words of documents whose
    k-grams meet a template's. A null text is empty; equal rows get equal results, each its own row; doc_id may be null or repeat with
    other texts; other columns are ignored; empty tables give no rows.
    """
    key = ["doc_id", "_text"]
    spots = templates.where(F.size("words") >= k).select("template", F.posexplode(_grams("words", k)).alias("t_pos", "gram"))
    grams = [r.gram for r in spots.select("gram").distinct().collect()]  # some hundreds: the templates are fixed
    shared = F.arrays_overlap("grams", F.array(*map(F.lit, grams)) if grams else F.array().cast("array<bigint>"))
    # The one-element explodes keep the words and hashes of a row as values: without them the optimiser would write
    # the expressions into the lambdas, to be computed again for every word.
    base = docs.select("doc_id", F.xxhash64(text_col).alias("_text"), F.explode(F.array(words(text_col))).alias("words"))
    places, labels = phrase_places("words", phrases)
    told = written(
        base.withColumn("grams", F.explode(F.array(_grams("words", k)))).select(
            *key, F.size("words").cast("long").alias("n_words"), places.alias("places"), labels.alias("base_labels"), F.when(shared, F.col("words")).alias("words")
        )
    )
    near = told.where("words is not null").select(*key, "words")
    votes = (
        near.select(*key, F.posexplode(_grams("words", k)).alias("pos", "gram"))
        .join(F.broadcast(spots), "gram")
        .groupBy(*key, "template", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
        .agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    )
    along = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(along) > gap) | (F.col("first") > F.lag("last").over(along) + 8 * k) | (F.col("last") < F.lag("first").over(along) - 8 * k)
    merged = (
        votes.withColumn("_run", F.sum(F.coalesce(apart.cast("int"), F.lit(1))).over(along))
        .groupBy(*key, "template", "_run")
        .agg(F.min("first").alias("first"), (F.max("last") + (k - 1)).alias("last"), F.array_sort(F.collect_set("diagonal")).alias("diagonals"))
    )
    # all words of the template that stand where a diagonal of the run says, within the span
    along_one = lambda d: F.filter(
        F.transform("t_words", lambda w, t: F.when((t + d).between(F.col("first"), F.col("last")) & (F.get("words", t + d) == w), F.struct((t + d).alias("at"), (-t).alias("back"), t.alias("t")))),
        lambda p: p.isNotNull(),
    )
    same = F.array_sort(F.flatten(F.transform("diagonals", along_one)))
    # a row of merged is one template's run; repeated rows of one document have one run each, whichever row its words come from
    texts = near.select(*[F.col(c).alias(f"_{c}") for c in key], "words").dropDuplicates(["_doc_id", "__text"])
    verified = (
        merged.join(texts, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_text") == F.col("__text")))
        .join(F.broadcast(templates.withColumnRenamed("words", "t_words")), "template")
        .withColumn("_same", F.explode(F.array(same)))
        .withColumn("share", in_order(F.col("_same")) / F.size("t_words"))
        .where(F.col("share") >= coverage)
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("template", "label", "first", "last", "share"))).alias("spans"))
    )
    right = verified.select(*[F.col(c).alias(f"_{c}") for c in key], "spans")
    found = told.drop("words").join(right, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("_text") == F.col("__text")), "left")
    return found.select("doc_id", "n_words", "places", "base_labels", F.coalesce("spans", F.array().cast(right.schema["spans"].dataType)).alias("spans"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and aligned license notices of every document. Each place of a phrase halves the doubt that the score leaves; a notice has its share."""
    found = scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"), template_table(spark))
    by_method = F.transform("spans", lambda s: s["label"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", by_method)), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)), 1 - F.pow(F.lit(0.5), F.size("places"))).alias("score"),
    )


QUERIES = {"op8_license_scan": op8_license_scan}

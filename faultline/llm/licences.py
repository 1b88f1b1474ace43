"""License texts in documents by diagonal voting.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Every run of `K` words of every
document, and every run of `K_TEXT` words for templates that are whole license texts, is hashed and joined to the places of the same
run in the templates. A hit votes for a diagonal, the word of the document at which the template would start. Votes are counted
per document, template and diagonal:

* a base phrase stands wherever all its runs vote for one diagonal, which is exact;
* for longer templates diagonals with at least `VOTES` votes stay, neighbours at most `GAP` apart (words put in or left
  out) are merged, and the merged span is verified: the share of the template's words it covers must reach
  `LEAST` and the span be at most `STRETCH` times as long as the template.

Template runs are sent to all tasks while they are fewer than `BROADCAST_RUNS`; beyond that the join shuffles.

A null or empty text has no words, no labels and score 0. Repeated rows are judged each on their own; very long texts give one row
per run and no more than that at a time in a task; other columns are left out. The score is the share covered by the best verified span, 1 for a base phrase, else 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import small_batches, stage
from faultline.llm.licence_texts import TEXTS
from faultline.llm.words import NOT_ALNUM, grams, hashed_words

K, K_TEXT, VOTES, GAP, LEAST, STRETCH = 2, 5, 2, 3, 0.75, 1.5
BROADCAST_RUNS = 1_000_000
# Phrases and labels of the base.
BASE = {
    "gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit",
}
# Sentences of public licenses and the usual notices, with the labels this method adds.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2.0-notice",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-text",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
}


def template_runs(spark, base: dict[str, str], templates: dict[str, str], texts: dict[str, str]) -> DataFrame:
    """run, template, is_base, label, at, t_words, runs, k of every run of k words of every template."""
    rows = []
    given = [(t, x, True, K) for t, x in base.items()] + [(t, x, False, K) for t, x in templates.items()]
    for number, (text, label, is_base, k) in enumerate(given + [(t, x, False, K_TEXT) for x, t in texts.items()]):
        h = hashed_words(text, NOT_ALNUM)[0]
        runs = grams(h, k).view(np.int64).tolist()
        if not runs:
            raise ValueError(f"a template needs at least {k} words: {text}")
        rows += [(g, number, is_base, label, at, len(h), len(runs), k) for at, g in enumerate(runs)]
    return spark.createDataFrame(rows, "run long, template int, is_base boolean, label string, at int, t_words int, runs int, k int")


def rolled(docs: DataFrame) -> DataFrame:
    """row, pos, run of every run of K and of K_TEXT words; for each row also one with pos -1 that has doc_id and n_words."""
    import pyarrow as pa

    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def work(batches):
        for batch in batches:
            for row, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                h = hashed_words(text, NOT_ALNUM)[0]
                runs = [grams(h, k).view(np.int64) for k in (K, K_TEXT)]
                n = sum(map(len, runs))
                rest = np.arange(n + 1) > 0
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n + 1, row, np.int64)), pa.array(np.concatenate([np.array([-1]), *(np.arange(len(x)) for x in runs)])),
                    pa.array(np.concatenate([np.zeros(1, np.int64), *runs])),
                    pa.array(np.full(n + 1, doc or 0, np.int64), mask=rest | (doc is None)),
                    pa.array(np.full(n + 1, len(h), np.int64), mask=rest),
                ], names=["row", "pos", "run", "doc_id", "n_words"])

    return rows.mapInArrow(work, "row long, pos long, run long, doc_id long, n_words long")


def scan(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES, texts: dict[str, str] = TEXTS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    spark = docs.sparkSession
    known = stage(template_runs(spark, base, templates, texts), "templates")
    joined = rolled(docs).join(F.broadcast(known) if known.count() <= BROADCAST_RUNS else known, "run", "left")
    hits = stage(joined.where("template is not null or pos = -1"), "hits")
    votes = hits.where("pos >= 0").groupBy(
        "row", "template", "is_base", "label", "t_words", "runs", "k", (F.col("pos") - F.col("at")).alias("diagonal"),
    ).agg(F.collect_set("at").alias("ats"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    votes = stage(votes.where(F.size("ats") >= F.when(F.col("is_base"), F.col("runs")).otherwise(F.least(F.lit(VOTES), "runs"))), "votes")
    places = votes.where("is_base").select("row", "label", "is_base", "diagonal", F.lit(1.0).alias("share"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > GAP, F.lit(False))
    merged = votes.where("not is_base").withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(order))
    spans = merged.groupBy("row", "template", "label", "t_words", "k", "span").agg(
        F.flatten(F.collect_set("ats")).alias("ats"), F.min("low").alias("low"), F.max("high").alias("high"))
    words = F.array_distinct(F.flatten(F.transform("ats", lambda x: F.sequence(x, x + F.col("k") - 1))))
    spans = spans.withColumn("share", F.size(words) / F.col("t_words")).where(
        (F.col("share") >= LEAST) & (F.col("high") + F.col("k") - F.col("low") <= STRETCH * F.col("t_words")))
    # Of templates alike that start at one word the best covered stay; sentences and whole texts are not alike.
    best = F.rank().over(Window.partitionBy("row", "low", "k").orderBy(F.desc("share")))
    spans = spans.withColumn("best", best).where("best = 1")
    found = places.unionByName(spans.select(
        "row", "label", F.lit(False).alias("is_base"), F.lit(None).cast("long").alias("diagonal"), "share"))
    joined_labels = lambda label: F.array_join(F.sort_array(F.collect_set(label)), ",")
    judged = found.groupBy("row").agg(
        F.sum(F.col("is_base").cast("long")).alias("n_base"), F.min("diagonal").alias("first_word"),
        F.max("diagonal").alias("last_word"), joined_labels(F.when(F.col("is_base"), F.col("label"))).alias("base_labels"),
        joined_labels(F.col("label")).alias("labels"), F.max("share").alias("score"))
    marks = hits.where("pos = -1").select("row", "doc_id", "n_words")
    return marks.join(judged, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))

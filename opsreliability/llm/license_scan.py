"""License scan by diagonal voting, in DataFrame functions only.

All rolling word 3-gram hashes of a text are joined to the positions of the same grams in license
templates.  A match at word i of the text and position j of a template votes for the diagonal
i - j; a copied license collects its votes on one diagonal, one with words added or lost on
neighbouring diagonals, which are merged.  A merged span is verified by the share of the template's
grams that it covers.  The template table has some hundred rows whatever the data, so the join is a
broadcast hash join and texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from opsreliability.llm.common import ascii_lower, let, narrow
from opsreliability.session import materialise

#: Phrases whose places are counted, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: License texts by label: opening or grant sentences of public licenses (at most 63 grams each).
TEMPLATES = {
    "apache": "licensed under the apache license version 2 0 the license you may not use this file "
              "except in compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are "
           "permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the "
                  "terms of the gnu general public license as published by the free software foundation",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this "
           "software and associated documentation files the software to deal in the software "
           "without restriction",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
#: Templates that share a label.
LABEL = {"gpl-notice": "gpl"}
GRAM = 3
#: Diagonals this close are one span; share of a template's grams that a span must cover.
REACH, COVER = 3, 0.6
WORDS = "([^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+)"


def template_grams(spark) -> DataFrame:
    """(template, label, grams, place, gram): at most 63 rows for each template."""
    rows = []
    for name, text in TEMPLATES.items():
        w = text.split()
        rows += [(name, LABEL.get(name, name), len(w) - GRAM + 1, i, *w[i:i + GRAM])
                 for i in range(len(w) - GRAM + 1)]
    t = spark.createDataFrame(rows, "template string, label string, grams int, place int, a string, "
                                    "b string, c string")
    return t.select("template", "label", "grams", "place", F.xxhash64("a", "b", "c").alias("gram"))


def _phrase_at(w: Column, x: Column, i: Column) -> Column:
    """Label of the phrase that starts at word i, else null."""
    out = None
    for phrase, label in PHRASES.items():
        first, *rest = phrase.split()
        hit = x == first
        for k, word in enumerate(rest, 1):
            hit = hit & (F.get(w, i + k) == word)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def _parsed(w: Column) -> Column:
    places = F.filter(F.transform(w, lambda x, i: F.struct(
        i.alias("at"), _phrase_at(w, x, i).alias("label"))), lambda p: p["label"].isNotNull())
    grams = F.transform(F.slice(w, 1, F.greatest(F.size(w) - GRAM + 1, F.lit(0))),
                        lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, GRAM)]))
    return F.struct(F.size(w).alias("n"), places.alias("base"), grams.alias("grams"))


def matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each document (``gram`` null, with its words and phrases) and one for each of
    its grams that some template has."""
    d = narrow(docs, id_col, text_col)
    words = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(WORDS), F.lit(1))
    p = d.select("k1", "k2", "doc_id", let(words, _parsed).alias("p"))
    own = F.lit(None).cast("long")
    rows = p.select("k1", "k2", "doc_id", F.col("p.n").alias("n"), F.col("p.base").alias("base"),
                    F.posexplode(F.concat(F.col("p.grams"), F.array(own))).alias("at", "gram"))
    out = rows.join(F.broadcast(template_grams(docs.sparkSession)), "gram", "left")
    return out.filter("gram is null or template is not null").withColumn(
        "base", F.when(F.col("gram").isNull(), F.col("base")))


def spans(found: DataFrame) -> DataFrame:
    """(k1, k2, template, label, first, last, cover): verified spans, in words."""
    votes = found.filter("template is not null").groupBy(
        "k1", "k2", "template", "label", "grams", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.min("at").alias("first"), (F.max("at") + GRAM - 1).alias("last"),
        F.bit_or(F.expr("shiftleft(1L, place)")).alias("seen"))
    along = W.partitionBy("k1", "k2", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > REACH
    runs = votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "run", F.sum("new").over(along))
    return (runs.groupBy("k1", "k2", "template", "label", "grams", "run")
            .agg(F.min("first").alias("first"), F.max("last").alias("last"),
                 F.bit_or("seen").alias("seen"))
            .withColumn("cover", F.bit_count("seen") / F.col("grams"))
            .filter(F.col("cover") >= COVER).drop("seen", "run", "grams"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is 1 where a phrase is found, else the best cover of a verified span, else 0.  Null
    and empty texts have no words, null places and empty labels.  Repeated rows stay repeated.
    """
    found = materialise(matches(docs, id_col, text_col), "license-matches")
    added = spans(found).groupBy("k1", "k2").agg(F.collect_set("label").alias("added"),
                                                 F.max("cover").alias("cover"))
    rows = found.filter("gram is null").join(added, ["k1", "k2"], "left")
    base = F.array_sort(F.array_distinct(F.col("base.label")))
    every = F.array_sort(F.array_union(base, F.coalesce("added", F.array().cast("array<string>"))))
    return rows.select(
        "k1", "k2", "doc_id", F.col("n").alias("n_words"), F.size("base").alias("n_base"),
        F.array_min(F.col("base.at")).alias("first_word"), F.array_max(F.col("base.at")).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"))
